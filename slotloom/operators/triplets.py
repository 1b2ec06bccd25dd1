"""Triplets of datapoints and the margin loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.functions.vectors import distance
from slotloom.operators.labels import dense_ids

MARGIN = 2.0


def mined(rows: DataFrame, seed: int = 0) -> DataFrame:
    """(anchor, positive, negative) ids: for each row another row of its label and a row of another label.

    Rows have dense places in the order of their labels, so a label is a range of places.  An
    anchor's hash draws a place in its label's range besides its own, and one outside of the
    range; equality joins fetch the rows at these places.  A label with one row has no
    triplet, and null labels are left out.
    """
    labelled = rows.where("label is not null").select("vec_id", "label", F.struct("label", "vec_id").alias("__order"))
    placed = dense_ids(labelled, "__order", "__place").select("vec_id", "label", "__place")
    ranges = placed.groupBy("label").agg(F.min("__place").alias("__start"), F.count(F.lit(1)).alias("__n"))
    n = placed.count()
    # 60 bits of a hash that other engines have too.
    number = lambda k: F.conv(F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(f"#{seed + k}"))), 1, 15), 16, 10).cast("long")
    draw = lambda k, size: number(k) % size
    own, other = draw(2, F.col("__n") - 1), draw(3, F.lit(n) - F.col("__n"))
    drawn = placed.join(ranges, "label").where((F.col("__n") > 1) & (F.col("__n") < n)).select(
        F.col("vec_id").alias("anchor"),
        (F.col("__start") + own + (F.col("__start") + own >= F.col("__place")).cast("long")).alias("__own"),
        F.when(other < F.col("__start"), other).otherwise(other + F.col("__n")).alias("__other"),
    )
    for name, at in (("positive", "__own"), ("negative", "__other")):
        drawn = drawn.join(placed.select(F.col("__place").alias(at), F.col("vec_id").alias(name)), at)
    return drawn.select("anchor", "positive", "negative")


def neighbours_as_triplets(rows: DataFrame) -> DataFrame:
    """Deterministic triplets: the next row of the label (by vec_id), and the first row of the next label.

    Rows have dense places by label and vec_id, labels by their own order, so what is next is an
    equality join, and no task needs all rows of a label.
    """
    placed = dense_ids(rows.where("label is not null").select("vec_id", "label", F.struct("label", "vec_id").alias("__order")), "__order", "__place").select("vec_id", "label", "__place")
    following = placed.select(F.col("vec_id").alias("positive"), F.col("label").alias("__label"), (F.col("__place") - 1).alias("__before"))
    pairs = placed.join(following, (F.col("__place") == F.col("__before")) & (F.col("label") == F.col("__label"))).select(F.col("vec_id").alias("anchor"), "label", "positive")
    heads = dense_ids(placed.groupBy("label").agg(F.min("vec_id").alias("negative")), "label", "__turn")
    n = heads.count()
    ring = heads.select("negative", F.pmod(F.col("__turn") - 1, F.lit(max(n, 1))).alias("__turn")).join(heads.select("label", "__turn"), "__turn").select("label", "negative")
    return pairs.join(ring, "label").select("anchor", "positive", "negative")


def margin_losses(triplets: DataFrame, rows: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Adds d_ap, d_an and loss = max(d_ap - d_an + margin, 0) by three equality joins on ids."""
    v = rows.select("vec_id", "embedding")
    joined = triplets
    for name in ("anchor", "positive", "negative"):
        joined = joined.join(v.select(F.col("vec_id").alias(name), F.col("embedding").alias(f"__{name}")), name)
    joined = joined.select("anchor", "positive", "negative", distance(F.col("__anchor"), F.col("__positive")).alias("d_ap"), distance(F.col("__anchor"), F.col("__negative")).alias("d_an"))
    return joined.withColumn("loss", F.greatest(F.col("d_ap") - F.col("d_an") + margin, F.lit(0.0)))


def mean_loss(losses: DataFrame) -> DataFrame:
    return losses.agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"))
