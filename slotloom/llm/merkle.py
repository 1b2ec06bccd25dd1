"""A Merkle manifest of a dataset: one tree per source, one tree over their roots, and a proof for each row.

All of it is DataFrame expressions, so nothing leaves the JVM.

1. Rows become leaves, H of (doc_id, source, lang, n_chars, text), each ``-`` if null, else
   byte count, ``:``, value.  Only digests are kept from here on.
2. Leaves are sorted by (source, doc_id) in ranges; a row's index is its place in its range
   plus the counts of the ranges before, so no source meets in one task.
3. Levels are built and written one after the other: a node is H of at most ``FANOUT`` nodes.
4. Proofs come down the same levels: a node explodes the coordinates of its siblings from its
   index and the size of its level, looks them up in the node table, orders and concatenates
   them, and puts them before the proof of its parent.  Each coordinate is asked for by
   ``FANOUT`` - 1 siblings and each proof by ``FANOUT`` children, so no key is hot, however large
   the dataset or one source of it is.
5. A proof is folded from a leaf to the root by concatenation and H.

Defined results: null columns count as ``-``, null texts and empty ones differ; rows with the
same doc_id ascend by their leaf, and equal rows are leaves of their own, in any order; a null
doc_id comes first and is never tampered with; a null source is a source, before all others; an
empty table gives no rows; very long texts are only hashed; columns besides the five and the name
of the index are not looked at, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotloom.llm.shared import stored

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROOF = "array<struct<before:binary,after:binary>>"
_LOCAL = (1 << 33) - 1


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*(F.encode(p, "UTF-8") for p in parts)), 256)


def digest_of(nodes: Column) -> Column:
    """H of an array of structs with a ``digest``, as 32 bytes: tables and shuffles hold bytes, only H takes hex."""
    return F.unhex(digest(hexed(_bytes(nodes))))


def hexed(data: Column) -> Column:
    return F.lower(F.hex(data))


def _bytes(nodes: Column) -> Column:
    """The digests of the array one after the other."""
    return F.aggregate(nodes, F.lit(b""), lambda all_bytes, node: F.concat(all_bytes, node["digest"]))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*(_field(c) for c in (doc_id, source, lang, n_chars, text)))


def tampered(doc_id: Column, one_in: int = 5) -> Column:
    """Which rows are tampered with: those where ``one_in`` divides the CRC-32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % one_in == 0, F.lit(False))


def numbered(rows: DataFrame, order: Sequence[str], tree: Sequence[str]) -> DataFrame:
    """The rows with ``tree`` (a number that rises with the ``tree`` columns), ``index`` (place inside the tree) and ``n`` (size of the tree).

    ``order`` must begin with the ``tree`` columns.  Ranges are sorted where they are; only a count per
    range and a row per tree are joined, so one tree may hold nearly all rows.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranges.withColumn("id", F.monotonically_increasing_id()), "merkle-sorted")
    part, local = F.shiftright("id", 33), F.col("id").bitwiseAND(_LOCAL)
    # One row per range of the shuffle, however many rows there are.
    before = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = before.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("base"))
    placed = placed.withColumns({"part": part, "local": local}).join(F.broadcast(before), "part").withColumn("at", F.col("base") + F.col("local"))
    trees = stored(placed.groupBy(*tree).agg(F.min("at").alias("first"), F.count("*").alias("n")), "merkle-trees")
    same = F.lit(True)
    for c in tree:
        same = same & placed[c].eqNullSafe(trees[c])
    # A tree's number is the place of its first row.
    return placed.join(trees, same).select(*(placed[c] for c in rows.columns), F.col("first").alias("tree"), (F.col("at") - F.col("first")).alias("index"), "n")


def node_levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Written tables (tree, index, n, digest) of each level; ``n`` counts the tree's nodes there, and a tree ends at the level where it is 1."""
    levels = [stored(leaves.select("tree", "index", "n", "digest"), "merkle-nodes")]
    while (below := levels[-1].where("n > 1")).take(1):
        up = F.floor(F.col("index") / fanout).alias("index")
        children = F.array_sort(F.collect_list(F.struct("index", "digest")))
        nodes = below.groupBy("tree", up, F.ceil(F.col("n") / fanout).alias("n")).agg(digest_of(children).alias("digest"))
        levels.append(stored(nodes.select("tree", "index", "n", "digest"), "merkle-nodes"))
    return levels


def sibling_coordinates(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, own, index): a row for each sibling of each node, from its index and the size of its level alone."""
    first = F.col("index") - F.col("index") % fanout
    run = F.sequence(first, F.least(first + fanout, F.col("n")) - 1)
    return nodes.select("tree", F.col("index").alias("own"), F.explode(F.array_except(run, F.array("index"))).alias("index"))


def _steps(level: DataFrame, fanout: int) -> DataFrame:
    """(tree, own, step): the siblings' digests, left to right, before and after the node."""
    asked = sibling_coordinates(level, fanout)
    found = asked.join(level.select("tree", "index", "digest"), ["tree", "index"])
    ordered = found.groupBy("tree", "own").agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("siblings"))
    side = lambda wanted: _bytes(F.filter("siblings", wanted))
    return ordered.select("tree", "own", F.struct(side(lambda s: s["index"] < F.col("own")).alias("before"), side(lambda s: s["index"] > F.col("own")).alias("after")).alias("step"))


def _described(rows: DataFrame, level: DataFrame, parents: DataFrame | None, above: DataFrame, fanout: int) -> DataFrame:
    """``rows`` (nodes of the level and their columns) with their proofs: those of their trees' ends from ``above``, others from ``parents``."""
    found = rows.where("n = 1").join(above, "tree")
    if parents is None:
        return found
    steps = _steps(level.where("n > 1"), fanout).withColumnRenamed("own", "index")
    up = parents.select("tree", F.col("index").alias("up"), F.col("proof").alias("rest"))
    mine = rows.where("n > 1").join(steps, ["tree", "index"], "left").withColumn("up", F.floor(F.col("index") / fanout)).join(up, ["tree", "up"])
    # A run of one node has no siblings but is hashed all the same.
    alone = F.struct(F.lit(b"").alias("before"), F.lit(b"").alias("after"))
    proof = F.concat(F.array(F.coalesce("step", alone)), "rest").cast(PROOF)
    return found.unionByName(mine.withColumn("proof", proof).select(*found.columns))


def with_proofs(leaves: DataFrame, levels: list[DataFrame], above: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` with ``proof``, an array of (before, after) up to the root; ``above`` (tree, proof) goes on from the trees' roots.

    Proofs of the inner levels are written; the leaves' own, ``FANOUT`` times as many, are made where they are used.
    """
    if above is None:
        above = levels[0].select("tree").distinct().withColumn("proof", F.array().cast(PROOF))
    parents = None
    for level in reversed(levels[1:]):
        parents = stored(_described(level.select("tree", "index", "n"), level, parents, above, fanout), "merkle-proofs")
    return _described(leaves, levels[0], parents, above, fanout)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda at, step: digest(hexed(step["before"]), at, hexed(step["after"])))


def proof_digest(proof: Column) -> Column:
    return digest(F.array_join(F.transform(proof, lambda s: hexed(F.concat(s["before"], s["after"]))), ""))


def manifest(docs: DataFrame, other: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof (array of before, after: digests as bytes) of every row, and ``other_leaf`` where a column ``other`` of other texts is given."""
    fields = [F.col(c) for c in COLUMNS[:-1]]
    rows = docs.select("doc_id", "source", leaf_digest(*fields, F.col("text")).alias("leaf"), *([] if other is None else [leaf_digest(*fields, other).alias("other_leaf")]))
    # Ranges are drawn from the rows before they are dealt: texts are hashed once, and stay behind.
    leaves = stored(numbered(stored(rows, "merkle-rows"), ["source", "doc_id", "leaf"], ["source"]), "merkle-leaves")
    levels = node_levels(leaves.withColumn("digest", F.unhex("leaf")), fanout)
    subroots = levels[0].where("n = 1").select("tree", "digest")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "digest"))
    # Trees are numbered in the order of their sources.
    subroots = stored(subroots.select(F.col("tree").alias("below"), "digest"), "merkle-subroots")
    top = stored(numbered(subroots.withColumn("all", F.lit(0)), ["all", "below"], ["all"]), "merkle-top")
    top_levels = node_levels(top, fanout)
    root = top_levels[-1].select(hexed(F.col("digest")).alias("root"))
    above = stored(with_proofs(top, top_levels, None, fanout).select(F.col("below").alias("tree"), "proof"), "merkle-proofs")
    found = with_proofs(leaves, levels, above, fanout)
    return found.join(subroots.select(F.col("below").alias("tree"), hexed(F.col("digest")).alias("subroot")), "tree").join(F.broadcast(root)).drop("tree", "index", "n")


def verified_manifest(docs: DataFrame, one_in: int = 5, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; where ``one_in`` divides the
    CRC-32 of the decimal doc_id, the text is lower-cased (A-Z) before the fold."""
    other = F.when(tampered(F.col("doc_id"), one_in), F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    out = manifest(docs, other, fanout).withColumn("folded_root", folded(F.col("other_leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return verified_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Levels that the SQL writes out: up to 16^5 rows of a source and 16^3 sources.
SQL_LEVELS, SQL_TOP_LEVELS = 5, 3


def _sql_tree(name: str, levels: int) -> str:
    """Tables ``name``0 .. of nodes (tree, i, n, h) and ``name``_r0 .. of their runs (tree, run, n, hs); a tree of one node keeps it."""
    return ", ".join(
        f"{name}_r{k} AS (SELECT tree, i // 16 AS run, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY tree, i // 16), "
        f"{name}{k + 1} AS (SELECT tree, run AS i, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}_r{k})"
        for k in range(levels)
    )


def _sql_fold(name: str, tree: str, levels: int) -> str:
    """Tables ``name``1 .. that fold ``f`` and gather the proof ``p`` of ``name``0 (id, tree, i, f, p) level by level."""
    return ", ".join(
        f"{name}{k + 1} AS (SELECT id, a.tree, i // 16 AS i, CASE WHEN n = 1 THEN f ELSE sha256(array_to_string(hs[1 : i % 16], '') || f || array_to_string(hs[i % 16 + 2 :], '')) END AS f, "
        f"CASE WHEN n = 1 THEN p ELSE p || array_to_string(hs[1 : i % 16], '') || array_to_string(hs[i % 16 + 2 :], '') END AS p FROM {name}{k} a JOIN {tree}_r{k} r ON a.tree = r.tree AND a.i // 16 = r.run)"
        for k in range(levels)
    )


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_SQL_CRC = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))), 4294967295::UBIGINT)"
)

OP13_SQL = f"""
WITH d AS (SELECT *, CASE WHEN {_SQL_CRC} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other FROM documents),
l AS (SELECT doc_id, {_sql_leaf("text")} AS leaf, {_sql_leaf("other")} AS other_leaf, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, source FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS id FROM l),
s0 AS (SELECT tree, i, n, leaf AS h FROM g), {_sql_tree("s", SQL_LEVELS)},
t0 AS (SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, h FROM s{SQL_LEVELS}), {_sql_tree("t", SQL_TOP_LEVELS)},
f0 AS (SELECT id, tree, i, other_leaf AS f, '' AS p FROM g), {_sql_fold("f", "s", SQL_LEVELS)},
e0 AS (SELECT id, 0 AS tree, tree AS i, f, p FROM f{SQL_LEVELS}), {_sql_fold("e", "t", SQL_TOP_LEVELS)}
SELECT g.doc_id, g.leaf, s.h AS subroot, r.h AS root, sha256(e.p) AS proof_sha256, e.f AS folded_root, e.f = r.h AS verified
FROM g JOIN s{SQL_LEVELS} s ON g.tree = s.tree JOIN e{SQL_TOP_LEVELS} e ON g.id = e.id CROSS JOIN t{SQL_TOP_LEVELS} r
"""
