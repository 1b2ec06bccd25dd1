"""Label codes, frequencies, vocabularies and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.operators import postings
from slotloom.sources.tables import written

# Types that training and evaluation set aside as ubiquitous.
UBIQUITOUS_TRAINING = ("str", "int", "list", "bool", "float")
UBIQUITOUS_EVALUATION = ("str", "int", "list", "bool", "float", "typing.Text", "typing.List", "typing.List[typing.Any]", "typing.list")
MIN_SUPPORT, COMMON_SUPPORT = 3, 100


def dense_ids(df: DataFrame, order: str, name: str) -> DataFrame:
    """Ids 0, 1, 2, ... in the order of a column whose values are unique.

    Range partitions number their own rows, and a table with one row per partition
    holds what earlier partitions have, so no single task sees all rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mask = (1 << 33) - 1
    # The numbered rows are written once: ranges that are drawn twice might differ.
    numbered = written(df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "dense-ids")
    counts = sorted((r.part, r.n) for r in numbered.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, rows = 0, []
    for part, count in counts:
        rows.append((part, before))
        before += count
    starts = spark.createDataFrame(rows, "__part long, __before long")
    joined = numbered.join(F.broadcast(starts), F.shiftright("__at", 33) == F.col("__part"))
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(mask)).drop("__at", "__part", "__before")


def frequencies(types: DataFrame) -> DataFrame:
    """(type, n) of a DataFrame with a column type; null types are left out."""
    return types.where("type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def encoded(types: DataFrame) -> DataFrame:
    """(type, n, code): codes 0.. in the order of the distinct types."""
    return dense_ids(frequencies(types), "type", "code")


def with_codes(df: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """Adds the code of a column's type; rows with unknown types go, as the encoder knows them all."""
    return df.join(codes.select(F.col("type").alias(column), F.col("code").alias(name)), column)


def top_types(types: DataFrame, n: int) -> DataFrame:
    """The n most frequent types with their rank from 0 (ties alphabetically)."""
    top = frequencies(types).orderBy(F.desc("n"), "type").limit(n)
    rows = [(r.type, r.n, i) for i, r in enumerate(top.collect())]  # n rows at most
    return df_of(types, rows)


def df_of(types: DataFrame, rows: list) -> DataFrame:
    return types.sparkSession.createDataFrame(rows, "type string, n long, rank int")


def without_last(counts: DataFrame) -> DataFrame:
    """The vocabulary (type, n) without its least frequent type (of ties the alphabetically last)."""
    last = counts.groupBy().agg(F.max_by(F.struct("type"), F.struct(-F.col("n"), "type")).alias("last")).select(F.col("last.type").alias("type"))
    return counts.join(F.broadcast(last), "type", "left_anti")


def supported(df: DataFrame, column: str, least: int = MIN_SUPPORT) -> DataFrame:
    """Rows whose label occurs ``least`` times or more; counts combine before the shuffle, so hot labels are no burden."""
    many = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(column)
    return df.join(many, column, "left_semi")


def common_types(types: DataFrame, least: int = COMMON_SUPPORT, ubiquitous=UBIQUITOUS_TRAINING) -> DataFrame:
    return frequencies(types).where((F.col("n") >= least) & ~F.col("type").isin(*ubiquitous))


def tier(column: Column, is_common: Column, ubiquitous=UBIQUITOUS_EVALUATION) -> Column:
    return F.when(column.isin(*ubiquitous), F.lit("ubiquitous")).when(is_common, F.lit("common")).otherwise(F.lit("rare"))


def tier_shares(types: DataFrame, least: int = COMMON_SUPPORT, ubiquitous=UBIQUITOUS_TRAINING) -> DataFrame:
    """Share of rows per tier, from counts per type."""
    counts = frequencies(types)
    tiers = counts.select(tier(F.col("type"), F.col("n") >= least, ubiquitous).alias("tier"), "n")
    total = counts.agg(F.sum("n").alias("total"))
    return tiers.groupBy("tier").agg(F.sum("n").alias("n")).join(F.broadcast(total)).select("tier", "n", (F.col("n") / F.col("total")).alias("share"))


def hint_codes(types: DataFrame, ranked: DataFrame, column: str = "type") -> DataFrame:
    """(column, hint): the first ranked type that contains the string, else the last rank.

    Distinct strings meet the ranked types, of which there is a bounded number, by postings; see ``postings``.
    """
    distinct = types.select(column).where(F.col(column).isNotNull()).distinct()
    found = postings.first_containing(distinct, ranked, column).withColumnsRenamed({column: "__s", "rank": "__r"})
    last = ranked.count() - 1
    return distinct.join(found, F.col(column) == F.col("__s"), "left").select(column, F.coalesce("__r", F.lit(last)).cast("int").alias("hint"))


def random_hint_codes(df: DataFrame, ranked: DataFrame, column: str = "aval_types", probability: float = 0.5, seed: int = 0) -> DataFrame:
    """Like hint_codes on each row's own visible types, each match kept by a seeded coin."""
    types = [r.type for r in ranked.orderBy("rank").select("type").collect()]
    listed = F.array(*[F.lit(t) for t in types])
    coin = lambda i: F.conv(F.substring(F.md5(F.concat_ws("#", F.col(column), i.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") % 1000
    hits = F.filter(F.sequence(F.lit(0), F.lit(len(types) - 1)), lambda i: listed[i].contains(F.col(column)) & (coin(i) >= int(1000 * probability)))
    return df.withColumn("hint", F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(len(types) - 1)))
