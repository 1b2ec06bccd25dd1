"""Type-checker output, verdicts, and checking of predicted annotations.

Parsing and ratios are DataFrame operations over captured output.  Running a checker is
a subprocess per file, in ``mapInPandas``; within a file candidates are tried in order,
as a later trial depends on what earlier ones left in the source.
"""

from __future__ import annotations

import ast
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.operators import edits

# Error codes that count, by checker.
INCLUDED_CODES = {
    "mypy": (
        "[arg-type]", "[assignment]", "[call-args]", "[call-overload]", "[dict-item]", "[name-defined]", "[attr-defined]", "[exit-return]", "[func-returns-value]", "[index]",
        "[list-item]", "[misc]", "[operator]", "[override]", "[return-value]", "[return]", "[type-var]", "[typeddict-item]", "[union-attr]", "[valid-newtype]", "[valid-type]",
    ),
    "pytype": (
        "annotation-type-mismatch", "attribute-error", "bad-concrete-type", "bad-function-defaults", "bad-return-type", "bad-slots", "bad-unpacking", "base-class-error", "duplicate-keyword-argument",
        "ignored-type-comment", "invalid-annotation", "invalid-function-type-comment", "invalid-namedtuple-arg", "invalid-type-comment", "invalid-typevar", "key-var", "missing-parameter", "name-error",
        "not-callable", "not-indexable", "redundant-function-type-comment", "unsupported-operands", "wrong-arg-count", "wrong-arg-types", "wrong-keyword-args",
    ),
}
# All error codes of each checker, counted or not.
ALL_CODES = {
    "mypy": (
        "[abstract]", "[arg-type]", "[assignment]", "[call-arg]", "[name-defined]", "[attr-defined]", "[call-overload]", "[dict-item]", "[exit-return]", "[func-returns-value]", "[has-type]", "[import]", "[index]", "[list-item]",
        "[misc]", "[no-redef]", "[operator]", "[override]", "[return-value]", "[return]", "[syntax]", "[type-var]", "[typeddict-item]", "[union-attr]", "[valid-newtype]", "[valid-type]", "[var-annotated]",
    ),
    "pytype": (
        "annotation-type-mismatch", "attribute-error", "bad-concrete-type", "bad-function-defaults", "bad-return-type", "bad-slots", "bad-unpacking", "base-class-error", "duplicate-keyword-argument", "ignored-abstractmethod",
        "ignored-metaclass", "ignored-type-comment", "import-error", "invalid-annotation", "invalid-directive", "invalid-function-definition", "invalid-function-type-comment", "invalid-namedtuple-arg", "invalid-super-call",
        "invalid-type-comment", "invalid-typevar", "key-error", "late-directive", "missing-parameter", "module-attr", "mro-error", "name-error", "not-callable", "not-indexable", "not-instantiable", "not-supported-yet", "not-writable",
        "pyi-error", "python-compiler-error", "recursion-error", "redundant-function-type-comment", "reveal-type", "unbound-type-param", "unsupported-operands", "wrong-arg-count", "wrong-arg-types", "wrong-keyword-args",
    ),
}
COMMAND = {"mypy": ("mypy", "--show-error-codes", "--no-incremental", "--cache-dir=/dev/null")}
TIMEOUT_S = 20


def parsed(outputs: DataFrame, checker: str = "mypy") -> DataFrame:
    """file, status, n_errors, n_files, n_ignored, n_warnings, breakdown from (file, retcode, lines).

    status: ok, or unparsable (no lines, or a last line of another form).
    """
    codes = F.array(*[F.lit(c) for c in INCLUDED_CODES[checker]])
    last = F.try_element_at("lines", F.lit(-1))
    found = F.flatten(F.transform("lines", lambda line: F.filter(codes, lambda c: line.endswith(c))))
    numbers = F.transform(F.filter(F.split(last, r"\s+"), lambda w: w.rlike("^[0-9]+$")), lambda w: w.cast("int"))
    fine = (F.col("retcode") == 0) & last.startswith("Success: ")
    failed = (F.col("retcode") != 0) & last.startswith("Found ") & last.endswith(" source file)")
    distinct = F.array_distinct("__found")
    counts = F.map_from_arrays(distinct, F.transform(distinct, lambda c: F.size(F.filter("__found", lambda x: x == c))))
    rows = outputs.withColumns({"__found": found, "__numbers": numbers, "__fine": F.coalesce(fine, F.lit(False)), "__failed": F.coalesce(failed, F.lit(False))})
    n = F.when(F.col("__fine"), F.lit(0)).when(F.col("__failed"), F.size("__found"))
    number = lambda k: F.try_element_at("__numbers", F.lit(k))
    return rows.select(
        "file", F.when(F.col("__fine") | F.col("__failed"), F.lit("ok")).otherwise(F.lit("unparsable")).alias("status"), n.alias("n_errors"),
        F.when(F.col("__fine"), number(1)).when(F.col("__failed"), number(2)).alias("n_files"),
        F.when(F.col("__fine"), F.lit(0)).when(F.col("__failed"), number(1) - n).alias("n_ignored"),
        F.size(F.filter("lines", lambda line: line.contains(": warning: "))).alias("n_warnings"), F.when(F.col("__failed"), counts).alias("breakdown"),
    )


def light(outputs: DataFrame, checker: str = "mypy") -> DataFrame:
    """file, passed: no line ends with an included code."""
    codes = F.array(*[F.lit(c) for c in INCLUDED_CODES[checker]])
    return outputs.select("file", (~F.exists("lines", lambda line: F.exists(codes, lambda c: line.endswith(c)))).alias("passed"))


def accepted(outputs: DataFrame, checker: str = "mypy") -> DataFrame:
    """file, passed: parsed, and no included error."""
    return parsed(outputs, checker).select("file", F.coalesce((F.col("status") == "ok") & (F.col("n_errors") == 0), F.lit(False)).alias("passed"))


def by_code(outputs: DataFrame, checker: str = "mypy") -> DataFrame:
    """file, code, n, included: how often each known code ends a line, and whether it counts as an error; a line with the ends of several codes counts for each."""
    codes = tuple(dict.fromkeys((*ALL_CODES[checker], *INCLUDED_CODES[checker])))
    known = F.array(*[F.lit(c) for c in codes])
    found = outputs.select("file", F.explode("lines").alias("line")).select("file", F.explode(F.filter(known, lambda c: F.col("line").endswith(c))).alias("code"))
    return found.groupBy("file", "code").agg(F.count(F.lit(1)).alias("n")).withColumn("included", F.col("code").isin(*INCLUDED_CODES[checker]))


def prediction_kind(prediction, truth):
    """p_equal_gt, p_wo_gt (no ground truth) or p_not_equal_gt."""
    return F.when(prediction == truth, F.lit("p_equal_gt")).when(truth == "", F.lit("p_wo_gt")).otherwise(F.lit("p_not_equal_gt"))


def ratios(verdicts: DataFrame) -> DataFrame:
    """Per kind: passed, total and their ratio, for all three kinds (null ratio if there is none), from (kind, is_tc)."""
    kinds = verdicts.sparkSession.createDataFrame([("p_equal_gt",), ("p_not_equal_gt",), ("p_wo_gt",)], "kind string")
    counted = verdicts.groupBy("kind").agg(F.sum(F.col("is_tc").cast("long")).alias("passed"), F.count(F.lit(1)).alias("total"))
    return kinds.join(counted, "kind", "left").select("kind", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("total", F.lit(0)).alias("total"), F.try_divide(F.col("passed").cast("double"), F.col("total")).alias("ratio"))


def run_checker(source: str, command: tuple[str, ...], timeout: float = TIMEOUT_S) -> tuple[str, int, list[str]]:
    """(status, return code, lines) of the checker on a source; the file lives in a folder of its own."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "checked.py").write_text(source)
        try:
            done = subprocess.run([*command, "checked.py"], cwd=folder, capture_output=True, text=True, timeout=timeout)
        except subprocess.TimeoutExpired:
            return "timeout", -1, []
        except FileNotFoundError:
            return "missing", -1, []
        return "ran", done.returncode, done.stdout.splitlines()


def checked(sources: DataFrame, command: tuple[str, ...] = COMMAND["mypy"], timeout: float = TIMEOUT_S) -> DataFrame:
    """file, status, retcode, lines of every source (file, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(f, *run_checker(t or "", command, timeout)) for f, t in zip(batch["file"], batch["text"])]
            yield pd.DataFrame(out, columns=["file", "status", "retcode", "lines"])

    return sources.select("file", "text").mapInPandas(run, "file string, status string, retcode int, lines array<string>")


def passes(status: str, code: int, lines: list[str], checker: str = "mypy") -> bool:
    """Whether a run of the checker, by the rule of ``parsed``, ended with no included error; a run whose output has another form failed."""
    last = lines[-1] if lines else ""
    fine = code == 0 and last.startswith("Success: ")
    told = code != 0 and last.startswith("Found ") and last.endswith(" source file)")
    return status == "ran" and (fine or told) and not any(x.endswith(c) for x in lines for c in INCLUDED_CODES[checker])


def annotated(source: str, slots: dict[str, str]) -> str:
    """The source with annotations at slots: ``f.x`` (argument or local), ``f.return``, ``Class.f.x``, or a module variable."""
    tree = ast.parse(source)

    def typed(name: str) -> ast.expr:
        return ast.parse(name, mode="eval").body

    def visit(body: list, path: tuple[str, ...]) -> None:
        for i, node in enumerate(body):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                here = ".".join((*path, node.name))
                for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs):
                    if slots.get(f"{here}.{a.arg}"):
                        a.annotation = typed(slots[f"{here}.{a.arg}"])
                if slots.get(f"{here}.return"):
                    node.returns = typed(slots[f"{here}.return"])
                visit(node.body, (*path, node.name))
            elif isinstance(node, ast.ClassDef):
                visit(node.body, (*path, node.name))
            elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                wanted = slots.get(".".join((*path, node.targets[0].id)))
                if wanted:
                    body[i] = ast.copy_location(ast.AnnAssign(target=node.targets[0], annotation=typed(wanted), value=node.value, simple=1), node)

    visit(tree.body, ())
    return ast.unparse(ast.fix_missing_locations(tree))


def greedy_verdicts(candidates: DataFrame, command: tuple[str, ...] = COMMAND["mypy"], checker: str = "mypy", restore: bool = True) -> DataFrame:
    """file, slot, prediction, kind, is_tc, place (the order of the trials): tries every prediction of every slot of a file in order.

    Input: file, text, slot, truth, predictions (array of types).  A failed trial puts the
    ground truth back (``restore``), or else leaves the slot as it was tried; a later trial
    overwrites an earlier one.  Files are groups: sequential inside, parallel across.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        source, state, out = group["text"].iloc[0], {s: t for s, t in zip(group["slot"], group["truth"]) if t}, []
        for row in group.sort_values("slot").itertuples():
            for p in row.predictions:
                state[row.slot] = p
                try:
                    status, code, lines = run_checker(annotated(source, state), command)
                    ok = passes(status, code, lines, checker)
                except SyntaxError:
                    ok = False
                kind = "p_equal_gt" if p == row.truth else "p_wo_gt" if row.truth == "" else "p_not_equal_gt"
                out.append((row.file, row.slot, p, kind, ok, len(out)))
                if not ok and restore:
                    state[row.slot] = row.truth
        return pd.DataFrame(out, columns=["file", "slot", "prediction", "kind", "is_tc", "place"])

    return candidates.groupBy("file").applyInPandas(run, "file string, slot string, prediction string, kind string, is_tc boolean, place int")


def typed_sources(sources: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(file, text): the sources (file, text) with what the trials left: the last prediction of each slot if it passed; files without any stay as they are.

    ``verdicts``: (file, slot, prediction, is_tc, place), as ``greedy_verdicts`` gives them.
    """
    last = verdicts.groupBy("file", "slot").agg(F.max_by(F.struct("prediction", "is_tc"), "place").alias("last"))
    chosen = last.where("last.is_tc").select("file", "slot", "last.prediction")
    chosen = chosen.groupBy(F.col("file").alias("f")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "prediction"))).alias("slots"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if s is None else annotated(t, dict(s)) for t, s in zip(batch["text"], batch["slots"])]
            yield pd.DataFrame({"file": batch["file"], "text": texts})

    return sources.join(chosen, F.col("file") == F.col("f"), "left").select("file", "text", "slots").mapInPandas(run, "file string, text string")


def trial_order() -> Column:
    """The order of the trials of a file's slots: module variables; functions by line, their parameters, variables and return; classes by line, their variables, then their methods."""
    kind = F.when(F.col("kind") == "Parameter", 0).when(F.col("kind") == "Variable", 1).otherwise(2)
    group = F.when(F.col("level") == "module", 0).when(F.col("owner") == 0, 1).otherwise(2)
    return F.struct(group.alias("group"), F.col("owner"), (F.col("level") == "function").alias("method"), F.col("at"), kind.alias("kind"), F.col("place"))


def slot_verdicts(sources: DataFrame, candidates: DataFrame, command: tuple[str, ...] = COMMAND["mypy"], checker: str = "mypy") -> DataFrame:
    """file, place (of the slot), prediction, kind, is_tc, step: tries every prediction of every slot, in the sources as they are.

    ``candidates``: file, place, truth, trial (what the slots of a file are ordered by), predictions (array of types).
    A trial edits the annotation in its source (``edits``); what passes stays, after a failure the ground truth stands there
    again.  A source travels once, with all candidates of its file; a prediction that can't stand there, or doesn't parse, failed.
    """
    listed = candidates.groupBy(F.col("file").alias("__f")).agg(F.array_sort(F.collect_list(F.struct("trial", "place", "truth", "predictions"))).alias("c"))
    # A field of an array of structs is an array of its values.
    rows = sources.select("file", "text").join(listed, F.col("file") == F.col("__f")).select("file", "text", "c.place", "c.truth", "c.predictions")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                try:
                    source = edits.Annotator(row.text or "")
                except edits.REFUSED:
                    continue
                state, step = {}, 0
                for place, truth, predictions in zip(row.place, row.truth, row.predictions):
                    for p in predictions:
                        tried = state | {int(place): p}
                        try:
                            text = source.annotated(tried)
                            ast.parse(text)
                            ok = (p == truth or bool(source.edits({int(place): p}))) and passes(*run_checker(text, command), checker)
                        except edits.REFUSED:
                            ok = False
                        state.pop(int(place), None)
                        if ok:
                            state[int(place)] = p
                        kind = "p_equal_gt" if p == truth else "p_wo_gt" if truth == "" else "p_not_equal_gt"
                        out.append((row.file, int(place), p, kind, ok, step))
                        step += 1
            yield pd.DataFrame(out, columns=["file", "place", "prediction", "kind", "is_tc", "step"])

    return rows.mapInPandas(run, "file string, place int, prediction string, kind string, is_tc boolean, step int")


def applied(sources: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(file, text): the sources with what the trials of ``slot_verdicts`` left in them, all else byte for byte as it was."""
    last = verdicts.groupBy("file", "place").agg(F.max_by(F.struct("prediction", "is_tc"), "step").alias("last"))
    wanted = last.where("last.is_tc").select("file", "place", F.col("last.prediction").alias("annotation"))
    return edits.annotated_sources(sources, wanted).select("file", "text")


def without_failing(predictions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Predictions (file, slot, type, ..) without those that failed their check; with ``place`` for ``slot`` where the verdicts have that."""
    slot = "slot" if "slot" in verdicts.columns else "place"
    failed = verdicts.where("not is_tc").select("file", slot, F.col("prediction").alias("type")).distinct()
    return predictions.join(failed, ["file", slot, "type"], "left_anti")
