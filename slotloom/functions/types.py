"""Normalisation of type annotations as Catalyst expressions; only nesting depth needs an Arrow UDF."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The module prefixes that are deleted wherever they occur, and the same at word starts only.
PREFIXES = r"typing\.|typing_extensions\.|t\.|builtins\.|collections\."
PREFIXES_ANCHORED = r"\b(?:typing_extensions|typing|builtins|collections|t)\."

# Alias rewrites, in the order in which they apply.
ALIASES: tuple[tuple[str, str], ...] = (
    (r"any|unknown", "Any"),
    (r"^\{\}$|^Dict$|^Dict\[\]$|Dict\[Any, *?Any\]|^Dict\[unknown, *Any\]$", "dict"),
    (r"^Set$|Set\[\]|^Set\[Any\]$", "set"),
    (r"^Tuple$|Tuple\[\]|^Tuple\[Any\]$|Tuple\[Any, *?\.\.\.\]|^Tuple\[unknown, *?unknown\]$|^Tuple\[unknown, *?Any\]$|tuple\[\]", "tuple"),
    (r"^Tuple\[(.+), *?\.\.\.\]$", "Tuple[$1]"),
    (r"\bText\b", "str"),
    (r"^\[\]$|List\[\]|^List\[Any\]$|^List$", "list"),
    (r"^\[\{\}\]$", "List[dict]"),
    (r"Literal\['.*?'\]", "Literal"),
    (r"Literal\[\d+\]", "Literal"),
    (r"^Callable\[\.\.\., *?Any\]$|^Callable\[\[Any\], *?Any\]$|^Callable[\[Named(x, Any)], Any\]$", "Callable"),
    (r"^Iterator[Any]$", "Iterator"),
    (r"^OrderedDict[Any, *?Any]$", "OrderedDict"),
    (r"^Counter[Any]$", "Counter"),
    (r"Match[Any]", "Match"),
)
PARAMETRIC = r"^(.+)\[(.+)\]"
MAX_DEPTH = 2


def strip_prefixes(c: Column, anchored: bool = False) -> Column:
    """Deletes module prefixes; ``anchored`` only where a name starts (the default also cuts ``pytest.`` to ``pytes``)."""
    return F.regexp_replace(c, PREFIXES_ANCHORED if anchored else PREFIXES, "")


def unquote(c: Column) -> Column:
    """``'X'`` becomes ``X`` when the whole string is quoted."""
    return F.regexp_replace(c, r"^'(.+)'$", "$1")


def resolve_aliases(c: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, rule[0], rule[1]), ALIASES, c)


def is_parametric(c: Column) -> Column:
    return c.rlike(PARAMETRIC)


def outer_name(c: Column) -> Column:
    """What stands before the last bracketed argument list (greedy); empty for plain names."""
    return F.regexp_extract(c, PARAMETRIC, 1)


def _reduced(annotation: str, depth: int) -> str | None:
    """Arguments that have arguments of their own beyond ``depth`` levels become Any; None if brackets don't match."""
    out: list[list[str]] = [[]]
    for piece in _pieces(annotation):
        if piece == "[":
            out.append([])
        elif piece == "]":
            if len(out) == 1:
                return None
            inside, level = "".join(out.pop()), len(out)
            if level > depth:
                # The name just before the bracket, if there is one, goes with its arguments.
                if out[-1] and out[-1][-1].strip() not in (",", ""):
                    out[-1].pop()
                out[-1].append("Any")
            elif out[-1]:
                out[-1][-1] += f"[{inside}]"
            else:
                out[-1].append(f"[{inside}]")
        else:
            out[-1].append(piece)
    return "".join(out[0]) if len(out) == 1 else None


def _pieces(annotation: str):
    word = ""
    for ch in annotation:
        if ch in "[],":
            if word:
                yield word
            yield ch
            word = ""
        elif ch == " " and not word:
            yield " "
        else:
            word += ch
    if word:
        yield word


@F.pandas_udf(StringType())
def _reduce_depth(types: pd.Series) -> pd.Series:
    known: dict[str, str | None] = {}
    for t in types.dropna().unique():
        known[t] = _reduced(t, MAX_DEPTH)
    return types.map(lambda t: known.get(t) if t is not None else None)


def reduce_depth(c: Column) -> Column:
    """Nesting limited to MAX_DEPTH; only parametric annotations reach the UDF, null if brackets don't match."""
    return F.when(c.rlike(r"^.+\[.+\]"), _reduce_depth(c)).otherwise(c)


def normalised(c: Column, anchored: bool = False) -> Column:
    """Prefixes, quotes, aliases: all built-in expressions."""
    return resolve_aliases(unquote(strip_prefixes(c, anchored)))


def names_in(c: Column) -> Column:
    """Distinct identifiers of an annotation."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1)))


def importable(predictions: Column, imports: Column, builtins: Column) -> Column:
    """Keeps predictions (type, score) whose names are built in, or of which some other name is imported."""

    def keeps(p):
        foreign = F.array_except(names_in(p["type"]), builtins)
        return (F.size(foreign) == 0) | F.arrays_overlap(foreign, imports)

    return F.filter(predictions, keeps)
