"""Expressions over identifier lists, expressions and token sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def argument_string(names: Column) -> Column:
    """Argument names without ``self``, joined by spaces."""
    return F.array_join(F.filter(names, lambda x: x != "self"), " ")


def return_string(expressions: Column) -> Column:
    """Expressions without ``self`` and ``self.``, joined by spaces."""
    return F.array_join(F.transform(expressions, lambda x: F.regexp_replace(x, r"self\.?", "")), " ")


def clean_occurrences(occurrences: Column) -> Column:
    """Where a token is ``self``, every ``self`` goes and the rest is trimmed."""
    return F.transform(occurrences, lambda x: F.when(F.array_contains(F.split(x, r"\s+"), "self"), F.trim(F.replace(x, F.lit("self"), F.lit("")))).otherwise(x))


def split_identifier(name: Column) -> Column:
    """``maxHTTPSize_v2`` becomes ``max http size v 2``: snake, camel and digit boundaries, lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(spaced, r"([A-Za-z])([0-9])", "$1 $2"), r"[\s_\W]+", " ")))


def return_expression(e: Column, in_class: bool = False) -> Column:
    plain = F.replace(e, F.lit("return "), F.lit(""))
    return F.regexp_replace(plain, r"self\.?", "") if in_class else plain


def tokens(sequence: Column) -> Column:
    """Split at white space; empty and null sequences have no tokens."""
    return F.filter(F.split(F.coalesce(sequence, F.lit("")), r"\s+"), lambda x: x != "")


def fixed_length(items: Column, length: int, filler: str = "") -> Column:
    """Cut or padded to ``length``."""
    cut = F.slice(items, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(filler), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))


def without_varargs(params: Column, in_class: bool = False) -> Column:
    """A parameter map without ``args`` and ``kwargs``, and in classes without ``self``."""
    skipped = ["args", "kwargs"] + ["self"] * in_class
    return F.map_filter(params, lambda k, v: ~k.isin(*skipped))


# Endings of English words and what stands for them, the first that fits.
ENDINGS = (("sses$", "ss"), ("(ch|sh|x|z)es$", "$1"), ("([^aeiou])ies$", "$1y"), ("([^su])s$", "$1"))


def lemma(word: Column) -> Column:
    """A plural's singular by its ending; words of up to three letters stay."""
    fitted = F.when(word.rlike(ENDINGS[0][0]), F.regexp_replace(word, *map(F.lit, ENDINGS[0])))
    for pattern, to in ENDINGS[1:]:
        fitted = fitted.when(word.rlike(pattern), F.regexp_replace(word, F.lit(pattern), F.lit(to)))
    return F.when(F.length(word) > 3, F.coalesce(fitted.otherwise(word), word)).otherwise(word)


def sentence(c: Column, stop_words: Sequence[str]) -> Column:
    """The words of a text or identifier, split and lower-cased, without stop words and digits, as lemmas, joined by spaces."""
    words = F.filter(tokens(split_identifier(c)), lambda w: ~w.isin(*stop_words) & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.transform(words, lemma), " ")
