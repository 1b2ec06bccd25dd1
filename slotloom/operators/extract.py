"""Python sources to module documents and type slots, with the standard library's parser.

A source that doesn't parse gives an error column, not a failed job.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.operators import scopes
from slotloom.sources.tables import spread

SLOTS = "file string, scope string, level string, kind string, name string, annotation string, occurrences array<string>, line int, at int, owner int, place int, error string"
_NAMES = [c.split()[0] for c in SLOTS.split(", ")]
#: What a source that the parser refuses raises.
REFUSED = (SyntaxError, ValueError, RecursionError)


def slots_of(source: str) -> list[scopes.Slot]:
    return scopes.Analysis(source).slots


def _rows(file: str | None, text: str | None) -> list[tuple]:
    try:
        return [(file, *slot, None) for slot in slots_of(text or "")]
    except REFUSED as e:
        return [(file, *[None] * (len(_NAMES) - 2), type(e).__name__)]


def extracted(sources: DataFrame) -> DataFrame:
    """One row per slot of (file, text); a file without slots gives none, a broken one a row with its error.

    ``at`` is the line of the definition that holds the slot, ``owner`` that of its class (0: none), ``place`` the slot's
    number in its file, which keeps overloads apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for file, text in zip(batch["file"], batch["text"]) for row in _rows(file, text)], columns=_NAMES)

    return spread(sources.select("file", "text"), "file").mapInPandas(run, SLOTS)


class SourceSlots:
    """The handler of ``source_slots``: the rows of a partition are the lines, or parts, of one file in their order."""

    def __init__(self):
        self.file, self.parts = None, []

    def eval(self, row):
        self.file = row["file"]
        self.parts.append(row["text"] or "")

    def terminate(self):
        if self.parts:
            yield from _rows(self.file, "\n".join(self.parts))


def register(spark: SparkSession) -> None:
    """Makes ``source_slots`` callable from SQL: ``SELECT * FROM source_slots(TABLE(lines) PARTITION BY file ORDER BY line)``.

    The table has the columns file and text, one row per line, part or whole source; each file is put
    together and analysed where its partition is.
    """
    spark.udtf.register("source_slots", F.udtf(SourceSlots, returnType=SLOTS))


class _Untyped(ast.NodeTransformer):
    """Removes annotations; a bare declaration becomes ``pass`` where nothing else is left."""

    def visit_arg(self, node: ast.arg) -> ast.arg:
        node.annotation = None
        return node

    def visit_FunctionDef(self, node):
        node.returns = None
        self.generic_visit(node)
        node.body = node.body or [ast.Pass()]
        return node

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self.generic_visit(node)
        node.body = node.body or [ast.Pass()]
        return node

    def visit_AnnAssign(self, node):
        if node.value is None:
            return None
        return ast.copy_location(ast.Assign(targets=[node.target], value=self.visit(node.value)), node)


def without_annotations(source: str) -> str:
    return ast.unparse(ast.fix_missing_locations(_Untyped().visit(ast.parse(source))))


def untyped(sources: DataFrame) -> DataFrame:
    """(file, text) without type annotations; texts that don't parse stay as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                try:
                    out.append(without_annotations(text or ""))
                except REFUSED:
                    out.append(text)
            yield pd.DataFrame({"file": batch["file"], "text": out})

    return spread(sources.select("file", "text"), "file").mapInPandas(run, "file string, text string")


def coverage(slots: DataFrame) -> DataFrame:
    """Per file the annotated and unannotated slots, and the annotated share rounded to 2 digits."""
    known = (F.col("annotation") != "").cast("int")
    counted = slots.where("error is null").groupBy("file").agg(F.sum(known).alias("declared"), F.sum(1 - known).alias("unknown"))
    return counted.withColumn("coverage", F.round(F.try_divide(F.col("declared").cast("double"), F.col("declared") + F.col("unknown")), 2))
