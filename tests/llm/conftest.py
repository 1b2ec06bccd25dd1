"""A small documents table with every odd case, and the brute-force versions of the contracts."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def odd_documents(seed: int = 0) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgö") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(200)]
    rows = [(None, "no id here"), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "two words"), (6, "ONE"), (7, "one "), (7, "again seven"), (7, "again seven"), (None, None)]
    rows += [(10 + i, f"{word()} {passage} {word()} {word()}") for i in range(4)]
    for i in range(6):
        copy = list(base)
        copy[r.randrange(200)] = word()
        rows.append((20 + i, " ".join(copy)))
    rows += [(30 + i, " ".join(base).upper() if i else " ".join(base)) for i in range(3)]
    rows += [(40 + i, "\n".join(" ".join(word() for _ in range(8)) for _ in range(r.randint(1, 30)))) for i in range(20)]
    rows.append((70, " ".join(word() for _ in range(30_000)) + " " + passage))
    rows.append((71, "loop " * 120))
    return [(i, t, "en", "src0", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def odd_rows():
    return odd_documents()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHING = ("key", "hash", "part", "fp", "removed", "node", "score", "tokens", "features", "digest", "norm", "row", "own", "at", "copies", "copy", "posteriors", "__key", "__kept_key", "__removed", "__tokens", "__features", "__posteriors", "__copies", "__copy", "__hit_key", "kept", "Sha", "a.b", "c`d")


@pytest.fixture(scope="session")
def crowded(odd):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})
