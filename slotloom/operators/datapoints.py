"""Parameter, return and variable datapoints, and their split by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.functions.text import argument_string, clean_occurrences, return_string
from slotloom.operators.filters import filter_arguments, filter_returns

TEST_SHARE, VALID_SHARE = 20, 10
SPLITS = ("train", "valid", "test")


def arguments(functions: DataFrame) -> DataFrame:
    """One row per function and argument, without ``self`` and without uninformative types."""
    keep = ["file", "name", "func_descr", "aval_types", argument_string(F.col("arg_names")).alias("other_args")]
    zipped = F.arrays_zip("arg_names", "arg_types", "arg_descrs", "args_occur")
    rows = functions.select(*keep, F.inline(zipped))
    rows = rows.select("file", F.col("name").alias("func_name"), "func_descr", F.col("arg_names").alias("arg_name"), F.expr("trim(BOTH '\"' FROM arg_types)").alias("arg_type"), F.col("arg_descrs").alias("arg_comment"), "other_args", clean_occurrences(F.col("args_occur")).alias("arg_occur"), "aval_types")
    return filter_arguments(rows)


def returns(functions: DataFrame) -> DataFrame:
    """One row per function with a known return type."""
    rows = filter_returns(functions).withColumns({"arg_names_str": argument_string(F.col("arg_names")), "return_expr_str": return_string(F.col("return_expr"))})
    return rows.drop("author", "repo", "has_type", "arg_names", "arg_types", "arg_descrs", "args_occur", "return_expr")


def bucket(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 99 that depends on the key and seed only."""
    text = key if not seed else F.concat(key, F.lit(f"#{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 100).cast("int")


def split_of(file: Column, seed: int = 0) -> Column:
    """By file: 20 % test, and 10 % of the rest valid."""
    at = bucket(file, seed)
    return F.when(at < TEST_SHARE, F.lit("test")).when(at < TEST_SHARE + (100 - TEST_SHARE) * VALID_SHARE // 100, F.lit("valid")).otherwise(F.lit("train"))


def with_split(df: DataFrame, seed: int = 0) -> DataFrame:
    """The file's own split if every file has one of SPLITS, else a split by hash of the file."""
    if "set" in df.columns:
        given = df.agg(F.coalesce(F.bool_and(F.coalesce(F.col("set").isin(*SPLITS), F.lit(False))), F.lit(False)).alias("all")).first()
        if given["all"]:
            return df.withColumn("split", F.col("set"))
    return df.withColumn("split", split_of(F.col("file"), seed))


def shared_files(df: DataFrame) -> DataFrame:
    """Files that lie in more than one split; empty if the splits are disjoint."""
    return df.groupBy("file").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def combined(params: DataFrame, rets: DataFrame, variables: DataFrame) -> DataFrame:
    """The three tasks as one table in task order, with a task column."""
    named = [d.withColumn("task", F.lit(t)) for d, t in ((params, "Parameter"), (rets, "Return"), (variables, "Variable"))]
    return named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)


def task_by_bounds(position: Column, n_params: int, n_returns: int) -> Column:
    """Task names by bounds of length minus one with strict comparison: the last row of a task counts as the next task."""
    return F.when(position < n_params - 1, F.lit("Parameter")).when(position < n_params + n_returns - 1, F.lit("Return")).otherwise(F.lit("Variable"))


#: Columns of each model variant: the complete one, and without identifiers, code or visible types.
VARIANTS = {"complete": ("identifiers", "tokens", "hint"), "woi": ("tokens", "hint"), "woc": ("identifiers", "hint"), "wov": ("identifiers", "tokens")}


def load_split(table: DataFrame, split: str, variant: str = "complete", task: str | None = None, with_label: bool = True) -> DataFrame:
    """What a model variant reads of one split, for all tasks or one; columns and partitions are pruned by the scan."""
    rows = table.where(F.col("split") == split)
    rows = rows if task is None else rows.where(F.col("task") == task)
    return rows.select("task", *VARIANTS[variant], *["label"] * with_label)
