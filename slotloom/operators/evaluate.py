"""Exact, parametric and reciprocal-rank metrics of predictions, in one pass.

Input rows: original_type, task, predictions (array of struct(type, score), best first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.functions.types import PARAMETRIC, is_parametric, outer_name
from slotloom.operators.labels import tier

TOP_N = 10


def reciprocal_rank(predicted: Column, true: Column) -> Column:
    """1 / position of the true type, 0 if it is not there."""
    at = F.array_position(predicted, true)
    return F.when(at > 0, F.lit(1.0) / at).otherwise(F.lit(0.0))


def parametric_rank(predicted: Column, true: Column) -> Column:
    """1 / position of the first prediction with the true outer name; plain predictions compare whole, ignoring case."""
    outer = outer_name(true)
    fits = F.transform(predicted, lambda p: F.when(p.rlike(PARAMETRIC), F.regexp_extract(p, PARAMETRIC, 1) == outer).otherwise(F.lower(p) == F.lower(outer)))
    return reciprocal_rank(fits, F.lit(True))


def judged(predictions: DataFrame, common: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Adds tier, rr, hit, attempt (a parametric second chance), prr and phit to each row; ``common`` has a column type."""
    flagged = common.select(F.col("type").alias("original_type")).distinct().withColumn("__common", F.lit(True))
    rows = predictions.join(flagged, "original_type", "left")
    names = F.slice(F.transform("predictions", lambda p: p["type"]), 1, top_n)
    rows = rows.withColumn("tier", tier(F.col("original_type"), F.coalesce("__common", F.lit(False)))).withColumn("rr", reciprocal_rank(names, F.col("original_type")))
    rows = rows.withColumn("hit", (F.col("rr") > 0).cast("int"))
    attempt = (F.col("hit") == 0) & (F.col("tier") != "ubiquitous") & is_parametric(F.col("original_type"))
    rows = rows.withColumn("attempt", attempt.cast("int")).withColumn("prr", F.when(attempt, parametric_rank(names, F.col("original_type"))).otherwise(F.lit(0.0)))
    return rows.withColumn("phit", (F.col("prr") > 0).cast("int")).drop("__common")


def _share(top: Column, of: Column) -> Column:
    return F.try_divide(F.lit(100.0) * top, of)


def report(rows: DataFrame) -> DataFrame:
    """Metrics per task and for all tasks (Combined), from judged rows; empty tiers give null."""
    of = lambda name, tiers: F.sum(F.when(F.col("tier").isin(*tiers), F.col(name)).otherwise(0))
    one = lambda tiers: F.sum(F.col("tier").isin(*tiers).cast("int"))
    every = ("ubiquitous", "common", "rare")
    columns = [F.count(F.lit(1)).alias("n"), _share(F.sum("hit"), F.count(F.lit(1))).alias("exact_all")]
    columns += [_share(of("hit", (t,)), one((t,))).alias(f"exact_{t}") for t in every]
    columns += [_share(F.sum("hit") + F.sum("phit"), F.count(F.lit(1))).alias("param_all")]
    columns += [_share(of("hit", (t,)) + of("phit", (t,)), one((t,))).alias(f"param_{t}") for t in ("common", "rare")]
    columns += [_share(F.sum("rr"), F.count(F.lit(1))).alias("mrr_all")]
    columns += [_share(of("rr", (t,)), one((t,))).alias(f"mrr_{t}") for t in every]
    # Ranks of exact and parametric attempts are lists that are joined, so an attempted row counts twice.
    columns += [_share(F.sum("rr") + F.sum("prr"), F.count(F.lit(1)) + F.sum("attempt")).alias("mrr_param_all")]
    columns += [_share(of("rr", (t,)) + of("prr", (t,)), one((t,)) + of("attempt", (t,))).alias(f"mrr_param_{t}") for t in ("common", "rare")]
    total = rows.rollup("task").agg(F.grouping("task").alias("__all"), *columns)
    return total.withColumn("task", F.when(F.col("__all") == 1, F.lit("Combined")).otherwise(F.col("task"))).drop("__all")


def code_metrics(rows: DataFrame, ubiquitous: Sequence[int], common: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """One row: n and the exact matches in percent, in all and by tier, of (label, predicted as an array of codes).

    ``common`` has a column label; empty tiers give null.
    """
    flagged = common.select("label").distinct().withColumn("__common", F.lit(True))
    hit = F.array_contains(F.slice("predicted", 1, top_n), F.col("label")).cast("int")
    tier_of = F.when(F.col("label").isin(*ubiquitous), F.lit("ubiquitous")).when(F.coalesce("__common", F.lit(False)), F.lit("common")).otherwise(F.lit("rare"))
    judged_rows = rows.join(F.broadcast(flagged), "label", "left").select(hit.alias("hit"), tier_of.alias("tier"))
    each = [_share(F.sum(F.when(F.col("tier") == t, F.col("hit"))), F.sum((F.col("tier") == t).cast("int"))).alias(f"exact_{t}") for t in ("ubiquitous", "common", "rare")]
    return judged_rows.agg(F.count(F.lit(1)).alias("n"), _share(F.sum("hit"), F.count(F.lit(1))).alias("exact_all"), *each)


def parametric_code_matches(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (id, label, predicted as an array of codes) with ``match``: the outer name of the label's type is that of some prediction.

    ``names``: (code, type).  Predictions aren't cut to a top n here.
    """
    true = names.select(F.col("code").alias("label"), F.col("type").alias("__true"))
    listed = rows.select("id", F.explode("predicted").alias("code")).join(names, "code").groupBy("id").agg(F.collect_list("type").alias("__types"))
    known = rows.join(true, "label", "left").join(listed, "id", "left")
    rank = parametric_rank(F.coalesce("__types", F.array().cast("array<string>")), F.col("__true"))
    return known.withColumn("match", F.coalesce(is_parametric(F.col("__true")) & (rank > 0), F.lit(False))).drop("__true", "__types")
