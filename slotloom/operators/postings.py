"""Which texts of a bounded, ranked list contain a string: a substring join by postings instead of all pairs.

The list's texts are indexed by their grams of three characters (text by text, each once).  A string of three
characters or more is looked up by the rarest of its own grams and then verified in the few texts that
have it; one with a gram that no text has is done at once.  Shorter strings are grams of an index
of their own, with the least rank of each.  Both indexes have as many rows as the list has characters, so they
are broadcast; the strings are joined by equality and never come to the driver.

Characters are code points, and case counts.  Null strings match nothing; the empty string is in every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of so many characters."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def first_containing(strings: DataFrame, ranked: DataFrame, column: str = "type") -> DataFrame:
    """(column, rank): of each distinct string the least rank of a text of ``ranked`` (type, rank) that contains it; strings in none are left out."""
    asked = strings.select(F.col(column).alias("s")).where("s is not null").distinct()
    listed = ranked.select(F.col("type").alias("t"), F.col("rank").alias("r"))
    of_size = lambda size: listed.select("t", "r", F.explode(grams(F.col("t"), size)).alias("gram"))

    # One and two characters: the answer is in the index.
    short = of_size(1).unionByName(of_size(2)).groupBy("gram").agg(F.min("r").alias("rank"))
    empty = listed.groupBy().agg(F.min("r").alias("rank")).where("rank is not null").select(F.lit("").alias("gram"), "rank")
    by_short = asked.where(F.length("s") < GRAM).join(F.broadcast(short.unionByName(empty)), F.col("s") == F.col("gram")).select("s", "rank")

    postings = of_size(GRAM)
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = asked.where(F.length("s") >= GRAM).select("s", F.explode(grams(F.col("s"), GRAM)).alias("gram"))
    known = own.join(F.broadcast(counts), "gram", "left").groupBy("s").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
    met = known.where("least > 0").join(F.broadcast(postings), "gram").where(F.expr("contains(t, s)"))
    by_gram = met.groupBy("s").agg(F.min("r").alias("rank"))
    return by_short.unionByName(by_gram).select(F.col("s").alias(column), "rank")
