"""Lossless annotation of sources: edits at token positions, so comments, layout and line breaks stay byte for byte.

An edit replaces the bytes [start, end) of the source with a text.  ``apply_edits`` also gives the offset map of the
result, with which ``undone`` gives the source back.  Places are those of ``scopes.Analysis``.
Slots that Python can't annotate where they are bound (``for`` and ``with`` targets, ``:=``, tuples, names in parentheses) have no edit.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.operators import scopes
from slotloom.operators.extract import REFUSED
from slotloom.sources.tables import spread


class Edit(NamedTuple):
    start: int
    end: int
    text: bytes


class _Places:
    """Byte offsets of (line, column) positions, as the parser counts them."""

    def __init__(self, source: str):
        self.raw = source.encode()
        self.lines = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", self.raw))]

    def at(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def around_returns(self, node) -> tuple[int, int] | None:
        """Where ``-> type`` goes: from behind the parenthesis that ends the parameters to the colon, without white space before it."""
        lines = self.raw[self.at(node.lineno, 0) : self.at(node.end_lineno, node.end_col_offset)].decode()
        depth, behind = 0, None
        for token in tokenize.generate_tokens(io.StringIO(lines, newline="").readline):
            if token.type != tokenize.OP:
                continue
            line, column = token.end
            at = self.at(node.lineno + line - 1, len(token.line[:column].encode()))
            if token.string in "([{":
                parameters = depth == 0 and token.string == "(" and behind is None
                depth += 1
                if parameters:
                    behind = 0
            elif token.string in ")]}":
                depth -= 1
                if depth == 0 and behind == 0:
                    behind = at
            elif token.string == ":" and depth == 0 and behind:
                return behind, behind + len(self.raw[behind : at - 1].rstrip(b" \t\f"))
        return None


def slot_edit(places: _Places, kind: str, name: str, node: ast.AST, annotation: str) -> Edit | None:
    """The edit that gives a slot this annotation, or takes it away (empty); None where there can't be one, or nothing changes."""
    if kind == "Return":
        if node.returns is not None and annotation:
            return Edit(*places.span(node.returns), annotation.encode())
        around = places.around_returns(node)
        if around is None or (node.returns is None and not annotation):
            return None
        return Edit(*around, b"") if node.returns is not None else Edit(around[0], around[0], f" -> {annotation}".encode())
    if isinstance(node, ast.arg):
        start = places.span(node)[0] + len(name.encode())
        end = places.span(node.annotation)[1] if node.annotation is not None else start
    elif isinstance(node, ast.AnnAssign):
        if not annotation and node.value is None:
            return None  # a bare declaration has to stay
        start, end = places.span(node.target)[1], places.span(node.annotation)[1]
        if places.raw[start : places.span(node.annotation)[0]].strip() != b":":
            return None  # a target in parentheses
    elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], (ast.Name, ast.Attribute)):
        low, start = places.span(node.targets[0])
        if places.raw[start:].lstrip()[:1] != b"=" or low != places.span(node)[0]:
            return None
        end = start
    else:
        return None
    return Edit(start, end, f": {annotation}".encode() if annotation else b"") if annotation or start != end else None


def apply_edits(source: str, edits: list[Edit]) -> tuple[str, list[Edit]]:
    """The edited source and the edits that lead back; edits mustn't overlap."""
    raw, out, back, at, grown = source.encode(), [], [], 0, 0
    for e in sorted(edits):
        out += [raw[at : e.start], e.text]
        back.append(Edit(e.start + grown, e.start + grown + len(e.text), raw[e.start : e.end]))
        grown += len(e.text) - (e.end - e.start)
        at = e.end
    return b"".join([*out, raw[at:]]).decode(), back


def undone(source: str, back: list[Edit]) -> str:
    return apply_edits(source, back)[0]


class Annotator:
    """A source whose slots can be annotated again and again: the source is analysed once."""

    def __init__(self, source: str):
        self.source, self.places, self.analysis = source, _Places(source), scopes.Analysis(source)
        self.names = {s.place: (s.kind, s.name, s.annotation) for s in self.analysis.slots}

    def edits(self, wanted: dict[int, str]) -> list[Edit]:
        """The edits that give slots, by place, their annotations; those that have them already are left out."""
        found = []
        for place, annotation in wanted.items():
            if place in self.names and self.names[place][2] != annotation:
                kind, name, _ = self.names[place]
                found.append(slot_edit(self.places, kind, name, self.analysis.positions[place][1], annotation))
        return [e for e in found if e is not None]

    def annotated(self, wanted: dict[int, str]) -> str:
        return apply_edits(self.source, self.edits(wanted))[0]

    def bare(self) -> tuple[str, list[Edit]]:
        """The source without the annotations of its slots, and the edits that lead back."""
        return apply_edits(self.source, self.edits({p: "" for p, (_, _, a) in self.names.items() if a}))


def annotated_sources(sources: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, text, edits): the sources (file, text) with the annotations of ``wanted`` (file, place, annotation).

    ``edits`` lists the changed spans of the new text in bytes, with what stood there: putting it back gives the
    source byte for byte.  Sources that don't parse, and those without wanted annotations, stay as they are;
    of several annotations of a slot the last in their order counts.
    """
    chosen = wanted.groupBy("file", "place").agg(F.max("annotation").alias("annotation"))
    chosen = chosen.groupBy(F.col("file").alias("__f")).agg(F.collect_list("place").alias("places"), F.collect_list("annotation").alias("annotations"))
    schema = "file string, text string, edits array<struct<start:int,end:int,text:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, text, places, annotations in zip(batch["file"], batch["text"], batch["places"], batch["annotations"]):
                back = []
                if places is not None and text is not None:
                    try:
                        source = Annotator(text)
                        new, back = apply_edits(text, source.edits(dict(zip(places, annotations))))
                        ast.parse(new)
                        text = new
                    except REFUSED:
                        back = []
                out.append((file, text, [(e.start, e.end, e.text.decode()) for e in back]))
            yield pd.DataFrame(out, columns=["file", "text", "edits"])

    joined = sources.join(chosen, F.col("file") == F.col("__f"), "left").select("file", "text", "places", "annotations")
    return spread(joined, "file").mapInPandas(run, schema)


def restored(annotated: DataFrame) -> DataFrame:
    """(file, text): the sources that ``annotated_sources`` changed, as they were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if t is None else undone(t, [Edit(e["start"], e["end"], e["text"].encode()) for e in back]) for t, back in zip(batch["text"], batch["edits"])]
            yield pd.DataFrame({"file": batch["file"], "text": texts})

    return spread(annotated.select("file", "text", "edits"), "file").mapInPandas(run, "file string, text string")
