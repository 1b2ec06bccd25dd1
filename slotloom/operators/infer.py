"""From sources to ranked type predictions: slots, vectors, embeddings, neighbours, vote, names, write-back.

Works on any number of files at once; a file without slots gives no predictions, one that
doesn't parse a row with its error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.functions import text, types, vectors
from slotloom.operators import encoder, extract, features, knn, reduce, scopes
from slotloom.sources.tables import spread

#: Types that need no import.
# Names of the built-in and typing modules that predictions may use.
BUILTINS = (
    "int", "str", "float", "bool", "bytes", "object", "list", "dict", "set", "tuple", "complex", "None", "type", "Any", "List", "Dict", "Set", "Tuple", "Optional", "Union", "Callable", "Iterator", "Iterable",
    "Sequence", "Mapping", "Generator", "Type", "Literal", "FrozenSet",
)
IDENTIFIER_PLACES, TOKEN_PLACES = 31, 21


def words_of(c: Column) -> Column:
    return text.tokens(text.split_identifier(c))


def placed(points: DataFrame, parity: bool = False, stop_words: Sequence[str] = ()) -> DataFrame:
    """Adds the 31 identifier places and the 21 token places of each datapoint (task, name, function, arguments, occurrences).

    With ``stop_words`` occurrences are read as sentences: split, without those words, as lemmas.
    """
    others = F.flatten(F.transform(F.coalesce("arguments", F.array()), lambda a: F.split(text.split_identifier(a), " ")))
    identifiers = vectors.identifier_layout(F.col("task"), words_of(F.col("name")), words_of(F.col("function")), others, parity)
    read = (lambda o: F.split(text.sentence(o, stop_words), " ")) if stop_words else (lambda o: F.split(o, r"\s+"))
    usage = F.flatten(F.transform("occurrences", read))
    return points.withColumns({"identifiers": identifiers, "tokens": vectors.token_layout(F.col("task"), usage)})


def matrices(rows: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """``rows`` (id, identifiers, tokens as words) with their words as vectors; ``words`` (word, vector)."""
    kept = [c for c in rows.columns if c not in ("identifiers", "tokens")]
    out = rows.select(*kept)
    for column, length in (("identifiers", IDENTIFIER_PLACES), ("tokens", TOKEN_PLACES)):
        sequence = F.array_join(F.transform(column, lambda w: F.when(w == "", "_").otherwise(w)), " ")
        found = features.vectorised(rows.select("id", sequence.alias("sequence")), words, length, size)
        out = out.join(found.withColumnRenamed("matrix", column), "id")
    return out


def slots_of_documents(modules: DataFrame) -> DataFrame:
    """Slots, as ``extract.extracted`` gives them, of module documents (file, module): at module, class, function and method level.

    Parameters named args and kwargs are left out, and in classes self.
    """
    base = modules.select("file", "module.*")
    functions = base.select("file", F.explode("funcs").alias("f"), F.lit(False).alias("in_class"))
    classes = base.select("file", F.explode("classes").alias("c"))
    functions = functions.unionByName(classes.select("file", F.explode("c.funcs").alias("f"), F.lit(True).alias("in_class")))
    params = F.when(F.col("in_class"), text.without_varargs(F.col("f.params"), True)).otherwise(text.without_varargs(F.col("f.params")))
    used = lambda occur: F.transform(F.coalesce(F.try_element_at(occur, F.col("name")), F.array()), lambda o: F.array_join(o, " "))

    def rows(df, scope, level, kind, types_of, occur):
        return df.select("file", scope.alias("scope"), F.lit(level).alias("level"), F.lit(kind).alias("kind"), F.explode(types_of).alias("name", "annotation"), occur.alias("occur")).select("file", "scope", "level", "kind", "name", "annotation", used(F.col("occur")).alias("occurrences"))

    parts = [
        rows(base, F.lit(""), "module", "Variable", F.col("variables"), F.col("mod_var_occur")),
        rows(classes, F.col("c.q_name"), "class", "Variable", F.col("c.variables"), F.col("c.cls_var_occur")),
        rows(functions, F.col("f.q_name"), "function", "Variable", F.col("f.variables"), F.col("f.fn_var_occur")),
        rows(functions, F.col("f.q_name"), "function", "Parameter", params, F.col("f.params_occur")),
        functions.where("size(f.ret_exprs) > 0").select("file", F.col("f.q_name").alias("scope"), F.lit("function").alias("level"), F.lit("Return").alias("kind"), F.col("f.name").alias("name"), F.coalesce("f.ret_type", F.lit("")).alias("annotation"), F.col("f.ret_exprs").alias("occurrences")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({c: F.lit(None).cast("int") for c in ("line", "at", "owner", "place")} | {"error": F.lit(None).cast("string")})


def slot_id() -> Column:
    """One number per slot: definitions of one name differ by their line and place."""
    return F.xxhash64("file", "scope", "kind", "name", F.coalesce("line", F.lit(0)), F.coalesce("place", F.lit(0)))


def with_arguments(slots: DataFrame) -> DataFrame:
    """Adds ``arguments``: the parameters of the slot's own definition, in the order of the source."""
    named = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    arguments = slots.where("kind = 'Parameter'").groupBy(F.col("file").alias("__f"), F.col("scope").alias("__s"), F.col("at").alias("__a")).agg(named.alias("arguments"))
    return slots.join(arguments, (F.col("file") == F.col("__f")) & (F.col("scope") == F.col("__s")) & F.col("at").eqNullSafe(F.col("__a")), "left").drop("__f", "__s", "__a")


def datapoints(slots: DataFrame, hint: int) -> DataFrame:
    """Slots as datapoints; the hint is the same for all, as nothing is known of visible types."""
    rows = with_arguments(slots.where("error is null"))
    function = F.element_at(F.split("scope", r"\."), -1)
    return rows.select(slot_id().alias("id"), F.col("kind").alias("task"), "file", "scope", "name", "line", function.alias("function"), "arguments", "occurrences", F.lit(hint).alias("hint"))


def imported(sources: DataFrame) -> DataFrame:
    """(file, imports): the names that a source imports and their aliases, as the parser finds them; none where it doesn't parse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"file": batch["file"], "imports": [scopes.imported_names(t or "") for t in batch["text"]]})

    return spread(sources.select("file", "text"), "file").mapInPandas(run, "file string, imports array<string>")


def ranked(points: DataFrame, neighbours: DataFrame, codes: DataFrame) -> DataFrame:
    """(id, predictions): types by falling score, from the neighbours of each id."""
    named = knn.vote(neighbours).join(codes.select(F.col("code").cast("int").alias("label"), "type"), "label")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "type", "score"))), lambda x: F.struct(x["type"].alias("type"), x["score"].alias("score")))
    return named.groupBy(F.col("query_id").alias("id")).agg(listed.alias("predictions"))


def predicted(sources: DataFrame, bundle, filter_types: bool = True, slots: DataFrame | None = None) -> DataFrame:
    """(file, scope, level, kind, name, line, at, owner, place, predictions, error) of every slot of (file, text).

    ``bundle``: a trained Bundle; ``slots``: those of the sources, where they are known already.  With ``filter_types`` predictions that are neither built in
    nor imported go; a slot keeps its row when none is left.
    """
    from slotloom.sources.tables import written

    slots = written(extract.extracted(sources) if slots is None else slots, "slots")
    points = datapoints(slots, bundle.n_hints - 1)
    rows = matrices(placed(points).select("id", "hint", "identifiers", "tokens"), bundle.words, bundle.vector_size)
    embedded = encoder.embedded(rows, bundle.encoder, bundle.n_hints).withColumnRenamed("id", "vec_id")
    if bundle.projection is not None:
        embedded = reduce.projected(embedded, bundle.projection)
    found = ranked(points, bundle.index.search(written(embedded, "embedded"), bundle.k, bundle.probes), bundle.codes)
    none = F.array().cast("array<struct<type:string,score:double>>")
    keyed = slots.withColumn("id", slot_id()).join(found, "id", "left")
    keyed = keyed.select("file", "scope", "level", "kind", "name", "line", "at", "owner", "place", F.coalesce("predictions", none).alias("predictions"), "error")
    if filter_types:
        allowed = F.array(*[F.lit(b) for b in BUILTINS])
        keyed = keyed.join(imported(sources).withColumnRenamed("file", "f"), F.col("file") == F.col("f"), "left")
        keyed = keyed.withColumn("predictions", types.importable(F.col("predictions"), F.coalesce("imports", F.array().cast("array<string>")), allowed)).drop("f", "imports")
    return keyed


class _Slot(NamedTuple):
    scope: str
    level: str
    kind: str
    name: str
    at: int
    owner: int
    place: int
    predictions: list


def _lists(column: pa.ListArray, values: list) -> list[list]:
    """The lists of a column, whose items are ``values``."""
    ends = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    return [values[lo:hi] for lo, hi in zip(ends, ends[1:])]


def _slots(column: pa.ListArray) -> list[list[_Slot]]:
    """The slots of every file: Arrow gives each field of all slots at once."""
    *fields, predictions = column.flatten().flatten()
    types, scores = predictions.flatten().flatten()
    pairs = _lists(predictions, [[t, round(x, 3)] for t, x in zip(types.to_pylist(), scores.to_pylist())])
    return _lists(column, [_Slot(*values) for values in zip(*(f.to_pylist() for f in fields), pairs)])


def _document(slots: list[_Slot]) -> str:
    """The slots of one file as its module document."""
    module = {"variables_p": {}, "classes": [], "funcs": []}
    classes, functions = {}, {}

    def class_of(scope: str, at: int) -> dict:
        if (scope, at) not in classes:
            classes[scope, at] = {"name": scope.rpartition(".")[2], "q_name": scope, "variables_p": {}, "funcs": []}
        return classes[scope, at]

    known = {s.scope for s in slots if s.level == "class"}
    for row in sorted(slots, key=lambda s: (s.scope, s.at, s.place, s.name)):
        pairs = row.predictions
        if row.level == "module":
            module["variables_p"][row.name] = pairs
        elif row.level == "class":
            class_of(row.scope, row.at)["variables_p"][row.name] = pairs
        else:
            held = functions.setdefault((row.scope, row.at), {"owner": row.owner, "name": row.scope.rpartition(".")[2], "q_name": row.scope, "params_p": {}, "variables_p": {}})
            if row.kind == "Return":
                held["ret_type_p"] = pairs
            else:
                held["params_p" if row.kind == "Parameter" else "variables_p"][row.name] = pairs
    # The qualified names of the classes, by their lines; a class without slots of its own is that of the shortest method's scope.
    at_line = {at: scope for scope, at in classes if at}
    for (scope, _), held in sorted(functions.items(), key=lambda x: (len(x[0][0].split(".")), x[0])):
        if held["owner"] > 0:
            at_line.setdefault(held["owner"], scope.rpartition(".")[0])
    for (scope, _), held in sorted(functions.items()):
        owner, outer = held.pop("owner"), scope.rpartition(".")[0]
        if owner > 0:
            class_of(at_line[owner], owner)["funcs"].append(held)
        elif owner < 0 and outer in known:
            class_of(outer, 0)["funcs"].append(held)
        else:
            module["funcs"].append(held)
    module["classes"] = [c for _, c in sorted(classes.items())]
    return json.dumps(module)


def module_documents(predictions: DataFrame) -> DataFrame:
    """(file, module as JSON): the predictions written back into a document per file, in the layout of the service.

    ``variables_p`` are those of the module; ``classes`` and ``funcs`` are listed by qualified name and line, each definition for
    itself, and methods (and functions inside of them) stand in the ``funcs`` of their class.  Functions have ``params_p``,
    ``variables_p`` and, if they return something, ``ret_type_p``; a slot's predictions are [type, score] pairs with
    scores of 3 digits.  A file with an error has it under ``error``.  Where ``at``, ``owner`` and ``place`` aren't
    known, a scope is one definition, and a method one whose scope before its name is a class.
    """
    known = {c: F.lit(None).cast("int") for c in ("at", "owner", "place") if c not in predictions.columns}
    rows = predictions.withColumns(known).where("error is null")
    rows = rows.select(
        "file", "scope", "level", "kind", "name", F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("owner", F.lit(-1)).alias("owner"), F.coalesce("place", F.lit(0)).alias("place"),
        F.transform("predictions", lambda p: F.struct(p["type"].alias("type"), p["score"].cast("double").alias("score"))).alias("predictions"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_document(s) for s in _slots(batch.column(1))], pa.string())], ["file", "module"])

    # All slots of one file are one list: its size is that of a source.  Files go to Python many at a time.
    listed = spread(rows, "file").groupBy("file").agg(F.collect_list(F.struct(*_Slot._fields)).alias("slots"))
    whole = listed.mapInArrow(run, "file string, module string")
    failed = predictions.where("error is not null").select("file", F.to_json(F.struct("error")).alias("module"))
    return whole.unionByName(failed)
