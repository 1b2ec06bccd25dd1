"""Registry of the engine's queries and their SQL.

Each query takes (spark, sf_dir) and runs its operator over whole tables; SQL holds the
equivalent for DuckDB where SQL can express it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.functions import text, types, vectors
from slotloom.operators import cbow, datapoints, encoder, evaluate, extract, features, filters, infer, knn, labels, reduce, triplets, typecheck
from slotloom.sources import corpus, tables
from slotloom.streaming import admission, service

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- nearest neighbours and vote --------------------------------------------------------------------------------------

_TOPK = """
WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, e.label, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dist
           FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, item_id) AS rn FROM d QUALIFY rn <= 10),
w AS (SELECT *, 1 / power(dist + 1e-10, 2) AS w FROM k),
s AS (SELECT *, w / sum(w) OVER (PARTITION BY query_id) AS share FROM w),
v AS (SELECT query_id, label, sum(share) AS score, min(rn) AS first_rn FROM s GROUP BY query_id, label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first_rn) AS rank FROM v)
"""


def _neighbours(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return knn.nearest(rows.where("vec_id % 100 = 0"), rows)


@query("knn_topk", _TOPK + "SELECT query_id, item_id, label, round(dist, 6) AS dist, rn FROM k")
def knn_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("query_id", "item_id", "label", F.round("dist", 6).alias("dist"), F.col("rn").cast("long"))


@query("knn_vote", _TOPK + "SELECT query_id, label, round(score, 6) AS score, rank FROM r")
def knn_vote(spark, sf_dir):
    return knn.vote(_neighbours(spark, sf_dir)).select("query_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("vote_top1", _TOPK + "SELECT query_id, r.label AS predicted, e.label AS actual, r.label = e.label AS hit FROM r JOIN embeddings e ON e.vec_id = query_id WHERE rank = 1")
def vote_top1(spark, sf_dir):
    best = knn.vote(_neighbours(spark, sf_dir)).where("rank = 1")
    actual = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("actual"))
    return best.join(actual, "query_id").select("query_id", F.col("label").alias("predicted"), "actual", (F.col("label") == F.col("actual")).alias("hit"))


@query("knn_ann")
def knn_ann(spark, sf_dir):
    """Approximate neighbours by the inverted file; its recall is measured in the tests."""
    rows = table(spark, sf_dir, "embeddings")
    found = knn.InvertedFile.build(rows).search(rows.where("vec_id % 100 = 0"))
    return found.select("query_id", "item_id", "label", F.round("dist", 6).alias("dist"), F.col("rn").cast("long"))


@query(
    "type_clusters",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 3), keep AS (SELECT label FROM c EXCEPT SELECT label FROM (SELECT label FROM c ORDER BY n, label DESC LIMIT 1))
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS item_id FROM embeddings WHERE label IN (SELECT label FROM keep)""",
)
def type_clusters(spark, sf_dir):
    rows = labels.supported(table(spark, sf_dir, "embeddings"), "label")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # The label itself orders ties here, so the last one is found by number.
    last = counts.agg(F.max_by("label", F.struct(-F.col("n"), "label")).alias("label"))
    vocabulary = counts.join(F.broadcast(last), "label", "left_anti")
    return knn.clusters(rows.select("vec_id", "label"), vocabulary).select("vec_id", "label", "item_id")


# -- labels -----------------------------------------------------------------------------------------------------------

_TYPES = "(SELECT p_type AS type, 'Return' AS task FROM part UNION ALL SELECT event_type, 'Parameter' FROM events UNION ALL SELECT source, 'Variable' FROM documents)"


def _types(spark, sf_dir: str) -> DataFrame:
    parts = [(table(spark, sf_dir, t).select(F.col(c).alias("type"), F.lit(k).alias("task"))) for t, c, k in (("part", "p_type", "Return"), ("events", "event_type", "Parameter"), ("documents", "source", "Variable"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("label_encode", f"WITH t AS {_TYPES}, c AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS code FROM (SELECT DISTINCT type FROM t WHERE type IS NOT NULL)) SELECT task, t.type, code, count(*) AS n FROM t JOIN c USING (type) GROUP BY ALL")
def label_encode(spark, sf_dir):
    rows = _types(spark, sf_dir)
    coded = labels.with_codes(rows, "type", labels.encoded(rows), "code")
    return coded.groupBy("task", "type", "code").agg(F.count(F.lit(1)).alias("n"))


@query("label_frequency", f"WITH t AS {_TYPES} SELECT type, count(*) AS n, row_number() OVER (ORDER BY type) - 1 AS code FROM t WHERE type IS NOT NULL GROUP BY type")
def label_frequency(spark, sf_dir):
    return labels.encoded(_types(spark, sf_dir)).select("type", "n", "code")


@query("vocab_head_minus1", f"WITH c AS (SELECT type, count(*) AS n FROM {_TYPES} WHERE type IS NOT NULL GROUP BY type) SELECT type, n FROM (SELECT *, row_number() OVER (ORDER BY n, type DESC) AS r FROM c) WHERE r > 1")
def vocab_head_minus1(spark, sf_dir):
    return labels.without_last(labels.frequencies(_types(spark, sf_dir))).select("type", "n")


@query("top_types", f"SELECT type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, type) - 1 AS rank FROM {_TYPES} WHERE type IS NOT NULL GROUP BY type ORDER BY n DESC, type LIMIT 12")
def top_types(spark, sf_dir):
    return labels.top_types(_types(spark, sf_dir), 12).select("type", "n", F.col("rank").cast("long"))


@query("min_support", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)")
def min_support(spark, sf_dir):
    return labels.supported(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("common_types", "SELECT p_brand AS type, count(*) AS n FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY p_brand HAVING count(*) >= 80")
def common_types(spark, sf_dir):
    return labels.common_types(table(spark, sf_dir, "part").select(F.col("p_brand").alias("type")), 80, ("Brand#1", "Brand#2"))


@query("tier_share", "WITH c AS (SELECT p_brand AS type, count(*) AS n FROM part GROUP BY p_brand) SELECT CASE WHEN type IN ('Brand#1', 'Brand#2') THEN 'ubiquitous' WHEN n >= 80 THEN 'common' ELSE 'rare' END AS tier, sum(n)::BIGINT AS n, round(sum(n) / (SELECT sum(n) FROM c), 6) AS share FROM c GROUP BY 1")
def tier_share(spark, sf_dir):
    found = labels.tier_shares(table(spark, sf_dir, "part").select(F.col("p_brand").alias("type")), 80, ("Brand#1", "Brand#2"))
    return found.select("tier", "n", F.round("share", 6).alias("share"))


_RANKED = "(SELECT p_type AS type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS rank FROM part GROUP BY p_type)"


@query(
    "hint_encode",
    f"""WITH r AS {_RANKED}, t AS (SELECT DISTINCT substr(p_type, 1 + p_partkey % 3, p_partkey % 4) AS type FROM part UNION SELECT p_brand FROM part)
    SELECT type, coalesce((SELECT min(rank) FROM r WHERE contains(r.type, t.type)), (SELECT count(*) - 1 FROM r))::INTEGER AS hint FROM t""",
)
def hint_encode(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ranked = labels.top_types(part.select(F.col("p_type").alias("type")), 1024)
    asked = part.select(F.expr("substr(p_type, cast(1 + p_partkey % 3 as int), cast(p_partkey % 4 as int))").alias("type")).unionByName(part.select(F.col("p_brand").alias("type")))
    return labels.hint_codes(asked, ranked)


# -- normalisation and filters ----------------------------------------------------------------------------------------

_STRINGS = (
    "typing.List[int]", "t.Dict[str, t.Any]", "builtins.str", "collections.OrderedDict", "pytest.Foo", "concurrent.futures.Future", "'Foo'", "'a.b'", "any", "unknown", "company", "{}", "Dict", "Dict[]", "Dict[Any, Any]",
    "Dict[str, Any]", "Set", "Set[]", "Set[Any]", "Tuple", "Tuple[]", "Tuple[Any]", "Tuple[int, ...]", "Tuple[Any, ...]", "tuple[]", "Text", "List[Text]", "[]", "List[]", "List[Any]", "List", "[{}]", "Literal['a', 'b']",
    "Literal[3]", "Callable[..., Any]", "Callable[[Any], Any]", "Callable[[int], str]", "Iterator[Any]", "IteratorA", "OrderedDictA, Any]", "CounterA", "MatchA", "Match[str]", "List[List[List[int]]]", "Optional[Dict[str, List[int]]]",
    "Dict[str, Dict[str, Any]]", "List[Callable[..., Any]]", "Union[int, List[Tuple[int, str]]]", "List[int", "",
)
_LISTED = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in _STRINGS) + "]"
_RAW = f"""(SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN a WHEN 1 THEN 'typing.List[' || a || ']' WHEN 2 THEN 'Union[' || a || ', ' || b || ']' ELSE 't.Dict[str, ' || b || ']' END AS raw
    FROM (SELECT o_orderkey, ({_LISTED})[(o_orderkey % {len(_STRINGS)}) + 1] AS a, ({_LISTED})[(o_custkey % {len(_STRINGS)}) + 1] AS b FROM orders))"""


def _annotations(spark, sf_dir: str) -> DataFrame:
    """An annotation for each order: one of _STRINGS, alone or inside of another."""
    listed = F.array(*[F.lit(x) for x in _STRINGS])
    a, b = (F.get(listed, (F.col(c) % len(_STRINGS)).cast("int")) for c in ("o_orderkey", "o_custkey"))
    kind = F.col("o_orderkey") % 4
    raw = F.when(kind == 0, a).when(kind == 1, F.concat(F.lit("typing.List["), a, F.lit("]"))).when(kind == 2, F.concat(F.lit("Union["), a, F.lit(", "), b, F.lit("]"))).otherwise(F.concat(F.lit("t.Dict[str, "), b, F.lit("]")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"))


def _duck(expression: str, rules) -> str:
    for pattern, to in rules:
        p, t = pattern.replace("'", "''"), to.replace("$1", "\\1")
        expression = f"regexp_replace({expression}, '{p}', '{t}', 'g')"
    return expression


_PLAIN = _duck("raw", [(types.PREFIXES, "")])
_UNQUOTED = _duck(_PLAIN, [("^'(.+)'$", "$1")])


@query("strip_prefix", f"SELECT id, {_PLAIN} AS type FROM {_RAW}")
def strip_prefix(spark, sf_dir):
    return _annotations(spark, sf_dir).select("id", types.strip_prefixes(F.col("raw")).alias("type"))


@query("unquote", f"SELECT id, {_duck('raw', [(chr(94) + chr(39) + '(.+)' + chr(39) + '$', '$1')])} AS type FROM {_RAW}")
def unquote(spark, sf_dir):
    return _annotations(spark, sf_dir).select("id", types.unquote(F.col("raw")).alias("type"))


@query("alias_chain", f"SELECT id, {_duck(_UNQUOTED, types.ALIASES)} AS type FROM {_RAW}")
def alias_chain(spark, sf_dir):
    return _annotations(spark, sf_dir).select("id", types.normalised(F.col("raw")).alias("type"))


@query("parametric", f"SELECT id, regexp_matches(raw, '{types.PARAMETRIC}') AS is_parametric, regexp_extract(raw, '{types.PARAMETRIC}', 1) AS outer_name FROM {_RAW}")
def parametric(spark, sf_dir):
    return _annotations(spark, sf_dir).select("id", types.is_parametric(F.col("raw")).alias("is_parametric"), types.outer_name(F.col("raw")).alias("outer_name"))


@query(
    "depth2",
    f"""WITH RECURSIVE t AS (SELECT id, raw FROM {_RAW}), d AS (SELECT DISTINCT raw FROM t WHERE regexp_matches(raw, '^.+\\[.+\\]')),
    s AS (SELECT raw, 1 AS i, 0 AS depth, '' AS reduced, true AS fine FROM d
      UNION ALL SELECT raw, i + 1, depth + CASE raw[i] WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END,
        CASE WHEN raw[i] = '[' AND depth = 2 THEN regexp_replace(reduced, '[^\\[\\], ][^\\[\\],]*$', '') || 'Any' WHEN depth > 2 THEN reduced ELSE reduced || raw[i] END, fine AND NOT (raw[i] = ']' AND depth = 0)
      FROM s WHERE i <= length(raw)),
    r AS (SELECT raw, CASE WHEN depth = 0 AND fine THEN reduced END AS type FROM s WHERE i > length(raw))
    SELECT id, CASE WHEN r.raw IS NULL THEN t.raw ELSE r.type END AS type FROM t LEFT JOIN r ON r.raw = t.raw""",
)
def depth2(spark, sf_dir):
    return _annotations(spark, sf_dir).select("id", types.reduce_depth(F.col("raw")).alias("type"))


@query("filter_functions", "SELECT p_partkey, p_name, lower(p_type) AS name FROM part WHERE lower(p_type) NOT IN ('promo', 'small')")
def filter_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lower("p_type").alias("name"))
    return filters.filter_functions(rows, ("promo", "small"))


@query("filter_variables", "SELECT doc_id, nullif(source, 'src3') AS var_type FROM documents WHERE nullif(source, 'src3') IS NOT NULL AND source NOT IN ('src1', 'src2')")
def filter_variables(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.col("source"), F.lit("src3")).alias("var_type"))
    return filters.with_type(filters.filter_variables(rows, ("src1", "src2")))


_RETURNS = "(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN 'None' WHEN 3 THEN 'int' ELSE 'List[str]' END AS return_type, list_filter(string_split(text, chr(10)), x -> length(x) < 40) AS return_expr FROM documents)"


@query("filter_returns", _RETURNS.join(("SELECT doc_id, return_type, len(return_expr)::INTEGER AS n_exprs FROM ", " WHERE return_type IS NOT NULL AND return_type NOT IN ('nan', 'None', 'Any') AND len(return_expr) > 0")).replace("x -> length(x) < 40", "lambda x: length(x) < 40"))
def filter_returns(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 5 == 1, "nan").when(F.col("doc_id") % 5 == 2, "None").when(F.col("doc_id") % 5 == 3, "int").when(F.col("doc_id") % 5 == 4, "List[str]")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) < 40)
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("return_type"), lines.alias("return_expr"))
    return filters.filter_returns(rows).select("doc_id", "return_type", F.size("return_expr").alias("n_exprs"))


# -- datapoints -------------------------------------------------------------------------------------------------------

_FUNCTIONS = """(SELECT conv_id, list(CASE WHEN turn = 0 THEN 'self' ELSE role || turn END ORDER BY turn) AS names, list(CASE turn % 4 WHEN 0 THEN 'Any' WHEN 1 THEN '"int"' WHEN 2 THEN 'List[str]' ELSE '' END ORDER BY turn) AS kinds,
    list(text ORDER BY turn) AS descrs FROM conversations GROUP BY conv_id)"""


def _functions(spark, sf_dir: str) -> DataFrame:
    """Conversations as functions: turns are arguments.  A conversation is as long as it is, so lists are bounded by its turns."""
    kind = F.when(F.col("turn") % 4 == 0, "Any").when(F.col("turn") % 4 == 1, '"int"').when(F.col("turn") % 4 == 2, "List[str]").otherwise("")
    name = F.when(F.col("turn") == 0, "self").otherwise(F.concat("role", F.col("turn").cast("string")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("name"), kind.alias("kind"), F.col("text").alias("descr"))
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "name", "kind", "descr"))).alias("a"))
    each = lambda f: F.transform("a", lambda x: x[f])
    return lists.select(
        F.col("conv_id"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("file"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("name"), F.lit("").alias("func_descr"), F.lit("").alias("aval_types"),
        each("name").alias("arg_names"), each("kind").alias("arg_types"), each("descr").alias("arg_descrs"), F.transform("a", lambda x: F.array(F.lit("self a"), F.lit("selfish"), x["name"])).alias("args_occur"),
    )


@query(
    "args_explode",
    f"""WITH f AS {_FUNCTIONS}, r AS (SELECT 'f' || conv_id AS func_name, unnest(names) AS arg_name, trim(unnest(kinds), '"') AS arg_type, unnest(descrs) AS arg_comment, array_to_string(list_filter(names, lambda x: x <> 'self'), ' ') AS other_args FROM f)
    SELECT func_name, arg_name, arg_type, arg_comment, other_args, CASE WHEN arg_name = 'self' THEN '' ELSE 'a|selfish|' || arg_name END AS occurrences FROM r WHERE arg_name <> 'self' AND arg_type NOT IN ('', 'Any', 'None', 'object')""",
)
def args_explode(spark, sf_dir):
    found = datapoints.arguments(_functions(spark, sf_dir))
    return found.select("func_name", "arg_name", "arg_type", "arg_comment", "other_args", F.array_join("arg_occur", "|").alias("occurrences"))


@query("args_string", f"SELECT conv_id, array_to_string(list_filter(names, lambda x: x <> 'self'), ' ') AS args FROM {_FUNCTIONS}")
def args_string(spark, sf_dir):
    return _functions(spark, sf_dir).select("conv_id", text.argument_string(F.col("arg_names")).alias("args"))


@query(
    "occurrence_cleanup",
    r"""WITH t AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\bthe\b', 'self', 'g'), chr(10))) AS line FROM documents)
    SELECT doc_id, sum(length(CASE WHEN list_contains(regexp_split_to_array(line, '\s+'), 'self') THEN trim(replace(line, 'self', '')) ELSE line END))::BIGINT AS n_chars, count(*) AS n FROM t GROUP BY doc_id""",
)
def occurrence_cleanup(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split(F.regexp_replace("text", r"\bthe\b", "self"), "\n").alias("occur"))
    cleaned = lines.select("doc_id", text.clean_occurrences(F.col("occur")).alias("occur"))
    return cleaned.select("doc_id", F.aggregate("occur", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("n_chars"), F.size("occur").cast("long").alias("n"))


@query("return_string", "SELECT conv_id, regexp_replace(array_to_string(list_transform(names, lambda x: regexp_replace('return ' || x || '.self.a', 'self\\.?', '', 'g')), ' '), 'return ', '', 'g') AS exprs FROM " + _FUNCTIONS)
def return_string(spark, sf_dir):
    rows = _functions(spark, sf_dir).select("conv_id", F.transform("arg_names", lambda x: F.concat(F.lit("return "), x, F.lit(".self.a"))).alias("exprs"))
    return rows.select("conv_id", text.return_expression(text.return_string(F.col("exprs"))).alias("exprs"))


_BUCKET = "(('0x' || substr(md5({0}), 1, 8))::BIGINT % 100)"
_SPLIT = f"CASE WHEN {_BUCKET} < 20 THEN 'test' WHEN {_BUCKET} < 28 THEN 'valid' ELSE 'train' END"


@query("split_by_file", f"SELECT {_SPLIT.format('p_name')} AS split, count(*) AS n, count(DISTINCT p_name) AS n_files FROM part GROUP BY 1")
def split_by_file(spark, sf_dir):
    rows = datapoints.with_split(table(spark, sf_dir, "part").select(F.col("p_name").alias("file")))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"))


@query("split_disjoint", f"WITH s AS (SELECT p_brand AS file, {_SPLIT.format('p_name')} AS split FROM part) SELECT file, count(DISTINCT split) AS n_splits FROM s GROUP BY file HAVING count(DISTINCT split) > 1")
def split_disjoint(spark, sf_dir):
    """Brands as files whose rows were split by their names: the files that the check has to find."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), datapoints.split_of(F.col("p_name")).alias("split"))
    return datapoints.shared_files(rows)


@query(
    "task_bounds",
    """WITH n AS (SELECT (SELECT count(*) FROM nation) AS p, (SELECT count(*) FROM region) AS r), u AS (SELECT n_nationkey AS k, 0 AS t, 'Parameter' AS task FROM nation UNION ALL SELECT r_regionkey, 1, 'Return' FROM region UNION ALL SELECT s_suppkey, 2, 'Variable' FROM supplier),
    o AS (SELECT *, row_number() OVER (ORDER BY t, k) - 1 AS i FROM u) SELECT i AS position, task, CASE WHEN i < p - 1 THEN 'Parameter' WHEN i < p + r - 1 THEN 'Return' ELSE 'Variable' END AS by_bounds FROM o, n""",
)
def task_bounds(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).cast("long").alias("k")) for t, c in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey"))]
    sizes = [p.count() for p in parts[:2]]
    rows = datapoints.combined(*parts)
    order = F.when(F.col("task") == "Parameter", 0).when(F.col("task") == "Return", 1).otherwise(2)
    keyed = rows.withColumn("key", F.format_string("%d-%020d", order, F.col("k")))
    placed = labels.dense_ids(keyed, "key", "position")
    return placed.select("position", "task", datapoints.task_by_bounds(F.col("position"), *sizes).alias("by_bounds"))


# -- features ---------------------------------------------------------------------------------------------------------


@query("token_vocab", r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents) WHERE token <> '' GROUP BY token HAVING count(*) >= 5")
def token_vocab(spark, sf_dir):
    return features.vocabulary(table(spark, sf_dir, "documents"), "text")


@query("seq_truncate_pad", r"SELECT doc_id AS id, array_to_string(list_resize(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:21], 21, ''), '|') AS tokens FROM documents")
def seq_truncate_pad(spark, sf_dir):
    rows = features.truncated(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("sequence")), 21)
    return rows.select("id", F.array_join("tokens", "|").alias("tokens"))


@query("one_hot", "SELECT vec_id, array_to_string(list_transform(range(0, 10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS hot FROM embeddings")
def one_hot(spark, sf_dir):
    hot = vectors.one_hot(F.col("label"), 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(hot, lambda x: x.cast("string")), "").alias("hot"))


_LAYOUT = r"""WITH t AS (SELECT conv_id, turn, role, regexp_split_to_array(trim(text), '\s+') AS w FROM conversations), p AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Parameter' WHEN 1 THEN 'Return' ELSE 'Variable' END AS task, [role] AS f, w[1:2] AS n, w[3:14] AS a FROM t)
SELECT conv_id, turn, array_to_string(CASE task WHEN 'Parameter' THEN list_resize(n, 10, '') || ['<sep>'] || list_resize(f, 10, '') || list_resize(a[1:10], 10, '') WHEN 'Return' THEN list_resize(f, 10, '') || ['<sep>'] || list_resize(a[1:10], 10, '') || list_resize([''], 10, '') ELSE list_resize(n, 31, '') END, ' ') AS layout FROM p"""


@query("identifier_layout", _LAYOUT)
def identifier_layout(spark, sf_dir):
    words = F.split(F.trim("text"), r"\s+")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "Parameter").when(F.col("turn") % 3 == 1, "Return").otherwise("Variable").alias("task"), F.array("role").alias("f"), F.slice(words, 1, 2).alias("n"), F.slice(words, 3, 12).alias("a"))
    return rows.select("conv_id", "turn", F.array_join(vectors.identifier_layout(F.col("task"), F.col("n"), F.col("f"), F.col("a")), " ").alias("layout"))


@query(
    "token_layout",
    r"""WITH t AS (SELECT conv_id, turn, regexp_split_to_array(trim(text), '\s+') AS w FROM conversations)
    SELECT conv_id, turn, array_to_string(CASE WHEN turn % 3 = 1 THEN list_resize(w[1:7], 21, '') ELSE list_resize(w[1:21], 21, '') END, '|') AS layout FROM t""",
)
def token_layout(spark, sf_dir):
    task = F.when(F.col("turn") % 3 == 1, "Return").otherwise("Parameter")
    layout = vectors.token_layout(task, F.split(F.trim("text"), r"\s+"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(layout, "|").alias("layout"))


# -- evaluation -------------------------------------------------------------------------------------------------------

# Type names that stand for the labels of the test data.
_NAMES = ("str", "List[int]", "Dict[str, int]", "bool", "Foo", "list", "List[str]", "Optional[int]", "Set[str]", "dict")
_COMMON = ("List[int]", "Foo", "dict", "list")


def _name(c):
    return F.element_at(F.array(*[F.lit(n) for n in _NAMES]), c + 1)


def _predictions(spark, sf_dir: str) -> DataFrame:
    votes = knn.vote(_neighbours(spark, sf_dir))
    lists = votes.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))), lambda x: F.struct(_name(x["label"]).alias("type"), x["score"].alias("score"))).alias("predictions"))
    actual = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), _name(F.col("label")).alias("original_type"), F.element_at(F.array(F.lit("Parameter"), F.lit("Return"), F.lit("Variable")), ((F.col("vec_id") / 100).cast("int") % 3) + 1).alias("task"))
    return actual.join(lists, "query_id")


def _judged(spark, sf_dir: str) -> DataFrame:
    common = spark.createDataFrame([(c,) for c in _COMMON], "type string")
    return evaluate.judged(_predictions(spark, sf_dir), common)


_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_JUDGED = (
    _TOPK
    + f""", a AS (SELECT vec_id AS query_id, ({_LIST})[label + 1] AS original_type, (['Parameter', 'Return', 'Variable'])[((vec_id // 100) % 3) + 1] AS task FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query_id, rank, ({_LIST})[label + 1] AS type FROM r),
j AS (SELECT query_id, task, original_type, CASE WHEN original_type IN ('str', 'int', 'list', 'bool', 'float') THEN 'ubiquitous' WHEN original_type IN {_COMMON} THEN 'common' ELSE 'rare' END AS tier,
  coalesce(min(rank) FILTER (type = original_type AND rank <= 10), 0) AS pos,
  coalesce(min(rank) FILTER (rank <= 10 AND CASE WHEN regexp_matches(type, '^(.+)\\[(.+)\\]') THEN regexp_extract(type, '^(.+)\\[(.+)\\]', 1) = regexp_extract(original_type, '^(.+)\\[(.+)\\]', 1) ELSE lower(type) = lower(regexp_extract(original_type, '^(.+)\\[(.+)\\]', 1)) END), 0) AS ppos
  FROM a JOIN p USING (query_id) GROUP BY query_id, task, original_type),
g AS (SELECT *, CASE WHEN pos > 0 THEN 1.0::DOUBLE / pos ELSE 0 END AS rr, (pos > 0)::INTEGER AS hit, (pos = 0 AND tier <> 'ubiquitous' AND regexp_matches(original_type, '^(.+)\\[(.+)\\]'))::INTEGER AS attempt FROM j),
h AS (SELECT *, CASE WHEN attempt = 1 AND ppos > 0 THEN 1.0::DOUBLE / ppos ELSE 0 END AS prr, (attempt = 1 AND ppos > 0)::INTEGER AS phit FROM g)
"""
)


@query("eval_rows", _JUDGED + "SELECT query_id, task, original_type, tier, round(rr, 6) AS rr, hit, attempt, round(prr, 6) AS prr, phit FROM h")
def eval_rows(spark, sf_dir):
    return _judged(spark, sf_dir).select("query_id", "task", "original_type", "tier", F.round("rr", 6).alias("rr"), "hit", "attempt", F.round("prr", 6).alias("prr"), "phit")


def _metric(name: str, top: str, of: str) -> str:
    return f"round(100.0 * ({top}) / nullif({of}, 0), 6) AS {name}"


def _tiers(name: str, tier: str) -> str:
    return f"sum({name}) FILTER (tier = '{tier}')"


_N = "count(*) FILTER (tier = '{0}')"
_METRICS = {
    "eval_exact": [("exact_all", "sum(hit)", "count(*)")] + [(f"exact_{t}", _tiers("hit", t), _N.format(t)) for t in ("ubiquitous", "common", "rare")],
    "eval_param": [("param_all", "sum(hit) + sum(phit)", "count(*)")] + [(f"param_{t}", f"{_tiers('hit', t)} + {_tiers('phit', t)}", _N.format(t)) for t in ("common", "rare")],
    "eval_mrr": [("mrr_all", "sum(rr)", "count(*)")] + [(f"mrr_{t}", _tiers("rr", t), _N.format(t)) for t in ("ubiquitous", "common", "rare")]
    + [("mrr_param_all", "sum(rr) + sum(prr)", "count(*) + sum(attempt)")] + [(f"mrr_param_{t}", f"{_tiers('rr', t)} + {_tiers('prr', t)}", f"{_N.format(t)} + {_tiers('attempt', t)}") for t in ("common", "rare")],
}


def _evaluation(name: str):
    columns = [m[0] for m in _METRICS[name]]

    def run(spark, sf_dir):
        return evaluate.report(_judged(spark, sf_dir)).select("task", "n", *[F.round(c, 6).alias(c) for c in columns])

    run.__name__ = name
    metrics = ", ".join(_metric(*m) for m in _METRICS[name])
    query(name, _JUDGED + f"SELECT coalesce(task, 'Combined') AS task, count(*) AS n, {metrics} FROM h GROUP BY GROUPING SETS ((task), ())")(run)


for _each in _METRICS:
    _evaluation(_each)


# -- triplets ---------------------------------------------------------------------------------------------------------

_TRIPLETS = """WITH h AS (SELECT label, min(vec_id) AS head FROM embeddings GROUP BY label), g AS (SELECT label, coalesce(lead(head) OVER (ORDER BY label), first(head) OVER (ORDER BY label)) AS negative FROM h),
t AS (SELECT vec_id AS anchor, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS positive FROM embeddings), p AS (SELECT anchor, positive, negative FROM t JOIN g USING (label) WHERE positive IS NOT NULL)"""
_LOSSES = (
    _TRIPLETS
    + """, d AS (SELECT p.*, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d_ap, list_distance(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS d_an
FROM p JOIN embeddings a ON a.vec_id = anchor JOIN embeddings b ON b.vec_id = positive JOIN embeddings c ON c.vec_id = negative), l AS (SELECT *, greatest(d_ap - d_an + 2, 0) AS loss FROM d)"""
)


@query("triplet_pairs", _TRIPLETS + " SELECT anchor, positive, negative FROM p")
def triplet_pairs(spark, sf_dir):
    return triplets.neighbours_as_triplets(table(spark, sf_dir, "embeddings"))


@query("margin_loss", _LOSSES + " SELECT anchor, round(d_ap, 6) AS d_ap, round(d_an, 6) AS d_an, round(loss, 6) AS loss FROM l")
def margin_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = triplets.margin_losses(triplets.neighbours_as_triplets(rows), rows)
    return found.select("anchor", *[F.round(c, 6).alias(c) for c in ("d_ap", "d_an", "loss")])


@query("mean_margin_loss", _LOSSES + " SELECT count(*) AS n, round(avg(loss), 6) AS loss FROM l")
def mean_margin_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = triplets.mean_loss(triplets.margin_losses(triplets.neighbours_as_triplets(rows), rows))
    return found.select("n", F.round("loss", 6).alias("loss"))


def _drawn(number: int, size: str) -> str:
    return f"(('0x' || substr(md5(vec_id || '#{number}'), 1, 15))::BIGINT % {size})"


@query(
    "triplet_mining",
    f"""WITH p AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS place, count(*) OVER () AS total FROM embeddings), g AS (SELECT label, min(place) AS first_place, count(*) AS n FROM p GROUP BY label),
    d AS (SELECT vec_id AS anchor, place, first_place, n, {_drawn(3, '(n - 1)')} AS own, {_drawn(4, '(total - n)')} AS other FROM p JOIN g USING (label) WHERE n > 1 AND n < total),
    x AS (SELECT anchor, first_place + own + (first_place + own >= place)::INTEGER AS own, CASE WHEN other < first_place THEN other ELSE other + n END AS other FROM d)
    SELECT anchor, a.vec_id AS positive, b.vec_id AS negative FROM x JOIN p a ON a.place = own JOIN p b ON b.place = other""",
)
def triplet_mining(spark, sf_dir):
    return triplets.mined(table(spark, sf_dir, "embeddings"), seed=1)


# -- predictions and type checks --------------------------------------------------------------------------------------

_BUILTINS = ("int", "str", "List", "Dict", "Optional", "bool", "Any")


@query(
    "import_filter",
    r"""WITH p AS (SELECT p_partkey, (['int', 'List[Foo]', 'Bar', 'Dict[str, Baz]', 'Optional[os.PathLike]'])[(p_partkey % 5) + 1] AS type, (CASE p_partkey % 3 WHEN 0 THEN ['Foo'] WHEN 1 THEN ['Bar', 'Baz'] ELSE [] END) AS imports FROM part),
    d AS (SELECT *, list_filter(list_distinct(regexp_extract_all(type, '([A-Za-z_][A-Za-z0-9_.]*)')), lambda x: NOT list_contains(['int', 'str', 'List', 'Dict', 'Optional', 'bool', 'Any'], x)) AS fo FROM p)
    SELECT p_partkey, type FROM d WHERE len(fo) = 0 OR list_has_any(fo, imports)""",
)
def import_filter(spark, sf_dir):
    kinds = F.array(*[F.lit(x) for x in ("int", "List[Foo]", "Bar", "Dict[str, Baz]", "Optional[os.PathLike]")])
    imports = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("Foo"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("Bar"), F.lit("Baz"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.struct(F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")).alias("type"), F.lit(1.0).alias("score"))).alias("preds"), imports.alias("imports"))
    kept = types.importable(F.col("preds"), F.col("imports"), F.array(*[F.lit(b) for b in _BUILTINS]))
    return rows.select("p_partkey", F.explode(kept).alias("p")).select("p_partkey", F.col("p.type").alias("type"))


# Endings of a checker's lines, some that count and some that don't.
_ENDINGS = ("[arg-type]", "[call-arg]", "[name-defined]", "[misc]", "[return-value]", "note")
_CODES = "[" + ", ".join(f"'{c}'" for c in typecheck.INCLUDED_CODES["mypy"]) + "]"
_ENDING_LIST = "[" + ", ".join(f"'{c}'" for c in _ENDINGS) + "]"
_OUTPUT_SQL = f"""(SELECT file, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 0 ELSE 1 END AS retcode,
    CASE k WHEN 0 THEN ['Success: no issues found in ' || n || ' source file'] WHEN 3 THEN ['usage'] WHEN 4 THEN ['nothing'] WHEN 5 THEN []::VARCHAR[]
      ELSE list_transform(range(0, n), lambda i: file || ':' || i || ': error: x  ' || ({_ENDING_LIST})[((n + i) % {len(_ENDINGS)}) + 1]) || ['Found ' || n || ' errors in 1 file (checked ' || (n + k) || ' source file)'] END AS lines
    FROM (SELECT 'm' || p_partkey || '.py' AS file, p_partkey % 7 AS k, p_size % 5 + 1 AS n FROM part))"""


def _outputs(spark, sf_dir: str) -> DataFrame:
    """What a checker might say of a file for each part: success, errors, or nothing that can be read."""
    n, k = (F.col("p_size") % 5 + 1).cast("int"), F.col("p_partkey") % 7
    file = F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    ending = F.array(*[F.lit(e) for e in _ENDINGS])
    errors = F.transform(F.sequence(F.lit(0), n - 1), lambda i: text(file, ":", i, ": error: x  ", F.get(ending, (n + i) % len(_ENDINGS))))
    found = F.concat(errors, F.array(text("Found ", n, " errors in 1 file (checked ", n + k, " source file)")))
    lines = F.when(k == 0, F.array(text("Success: no issues found in ", n, " source file"))).when(k == 3, F.array(F.lit("usage"))).when(k == 4, F.array(F.lit("nothing"))).when(k == 5, F.array().cast("array<string>")).otherwise(found)
    retcode = F.when(k.isin(0, 4), 0).when(k == 3, 2).otherwise(1)
    return table(spark, sf_dir, "part").select(file.alias("file"), retcode.alias("retcode"), lines.alias("lines"))


_PARSED = f"""WITH o AS (SELECT *, lines[-1] AS last, list_filter(flatten(list_transform(lines, lambda l: list_filter({_CODES}, lambda c: ends_with(l, c)))), lambda x: true) AS found, list_filter(string_split(lines[-1], ' '), lambda w: regexp_full_match(w, '[0-9]+')) AS nums FROM {_OUTPUT_SQL}),
k AS (SELECT *, coalesce(retcode = 0 AND starts_with(last, 'Success: '), false) AS fine, coalesce(retcode <> 0 AND starts_with(last, 'Found ') AND ends_with(last, ' source file)'), false) AS failed FROM o),
r AS (SELECT file, CASE WHEN fine OR failed THEN 'ok' ELSE 'unparsable' END AS status, CASE WHEN fine THEN 0 WHEN failed THEN len(found) END AS n_errors, CASE WHEN fine THEN nums[1]::INTEGER WHEN failed THEN nums[2]::INTEGER END AS n_files,
  CASE WHEN fine THEN 0 WHEN failed THEN nums[1]::INTEGER - len(found) END AS n_ignored FROM k)"""


@query("tc_parse", _PARSED + " SELECT file, status, coalesce(n_errors, -1)::INTEGER AS n_errors, coalesce(n_files, -1) AS n_files, coalesce(n_ignored, -1)::INTEGER AS n_ignored FROM r")
def tc_parse(spark, sf_dir):
    return typecheck.parsed(_outputs(spark, sf_dir)).select("file", "status", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("n_errors", "n_files", "n_ignored")])


@query("tc_light", f"SELECT file, NOT coalesce(list_bool_or(list_transform(lines, lambda l: coalesce(list_bool_or(list_transform({_CODES}, lambda c: ends_with(l, c))), false))), false) AS passed FROM {_OUTPUT_SQL}")
def tc_light(spark, sf_dir):
    return typecheck.light(_outputs(spark, sf_dir))


_VERDICTS = "(SELECT p_partkey, p_type AS prediction, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN '' ELSE p_brand END AS truth, p_size % 2 = 0 AS is_tc FROM part)"
_KIND = "CASE WHEN prediction = truth THEN 'p_equal_gt' WHEN truth = '' THEN 'p_wo_gt' ELSE 'p_not_equal_gt' END"


def _verdicts(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    truth = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.lit("")).otherwise(F.col("p_brand"))
    rows = part.select("p_partkey", F.col("p_type").alias("prediction"), truth.alias("truth"), (F.col("p_size") % 2 == 0).alias("is_tc"))
    return rows.withColumn("kind", typecheck.prediction_kind(F.col("prediction"), F.col("truth")))


@query("verdict_classify", f"SELECT p_partkey, {_KIND} AS kind, is_tc FROM {_VERDICTS}")
def verdict_classify(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("p_partkey", "kind", "is_tc")


@query(
    "tc_ratios",
    f"""WITH c AS (SELECT {_KIND} AS kind, sum(is_tc::INTEGER)::BIGINT AS passed, count(*) AS total FROM {_VERDICTS} GROUP BY 1)
    SELECT k.kind, coalesce(passed, 0) AS passed, coalesce(total, 0) AS total, round(passed::DOUBLE / nullif(total, 0), 6) AS ratio FROM (VALUES ('p_equal_gt'), ('p_not_equal_gt'), ('p_wo_gt')) k(kind) LEFT JOIN c USING (kind)""",
)
def tc_ratios(spark, sf_dir):
    return typecheck.ratios(_verdicts(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


# -- service tables ---------------------------------------------------------------------------------------------------


def _requests(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("sess_valid", "SELECT event_id, user_id, value FROM events a WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'view' AND r.user_id = a.user_id)")
def sess_valid(spark, sf_dir):
    events = _requests(spark, sf_dir)
    accepted = events.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("sess_id"), "value")
    asked = events.where("event_type = 'view'").select(F.col("user_id").alias("sess_id"))
    return service.valid_acceptances(accepted, asked).select("event_id", F.col("sess_id").alias("user_id"), "value")


@query("accept_rank", "SELECT user_id, floor(value)::INTEGER % 10 AS rank, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def accept_rank(spark, sf_dir):
    return _requests(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id", (F.floor("value").cast("int") % 10).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query("latency", "SELECT event_id, round(epoch_us(ts + to_microseconds((value * 1000000)::BIGINT)) / 1e6 - epoch_us(ts) / 1e6, 4) AS latency_s FROM events")
def latency(spark, sf_dir):
    rows = _requests(spark, sf_dir).select("event_id", F.col("ts").alias("start_t"), F.expr("ts + make_dt_interval(0, 0, 0, cast(value as decimal(18, 6)))").alias("finished_t"))
    return service.latency(rows).select("event_id", F.round("latency_s", 4).alias("latency_s"))


@query("hash_ip", "SELECT event_id, sha1('10.0.0.' || user_id) AS \"hashed_IP\" FROM events")
def hash_ip(spark, sf_dir):
    rows = _requests(spark, sf_dir).select("event_id", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"))
    return service.logged_requests(rows).select("event_id", "hashed_IP")


for _unit in ("hour", "day"):

    def _counts(spark, sf_dir, unit=_unit):
        return service.request_counts(_requests(spark, sf_dir), unit)

    query(f"rate_limit_{_unit}", f"SELECT user_id, date_trunc('{_unit}', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY ALL")(_counts)


@query("rate_admitted", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def rate_admitted(spark, sf_dir):
    return service.admitted(_requests(spark, sf_dir), 2, "day").select("event_id", "admitted")


@query("json_props", "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events")
def json_props(spark, sf_dir):
    return _requests(spark, sf_dir).select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("dedup_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id < d.doc_id)")
def dedup_anti(spark, sf_dir):
    """Files that a duplicate list names are left out; the list is every document with an earlier equal text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = docs.join(first, "sha").where("doc_id <> first_id").select(F.col("doc_id").alias("file"))
    return corpus.without_duplicates(docs.select(F.col("doc_id").alias("file")), again).select(F.col("file").alias("doc_id"))


@query("stream_window_count", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_count(spark, sf_dir):
    return admission.run_to_table(service.windowed_counts(_stream(spark, sf_dir, "events"), "1 day", "1 hour"), "stream_window_count", "complete")


# -- models -----------------------------------------------------------------------------------------------------------


@query("w2v")
def w2v(spark, sf_dir):
    """Word vectors of the documents' tokens, as (word, vector)."""
    sentences = table(spark, sf_dir, "documents").select(text.tokens(F.col("text")).alias("sentence"))
    return features.train_word_vectors(sentences).getVectors()


@query("cbow_vectors")
def cbow_vectors(spark, sf_dir):
    """Word vectors of the documents by continuous bags of words with negative sampling, on parameters sharded by word."""
    sentences = table(spark, sf_dir, "documents").select(text.tokens(F.col("text")).alias("sentence"))
    return cbow.train(sentences)


@query("pca")
def pca(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return reduce.reduced(rows, reduce.fit_pca(rows, 16))


@query("lsh")
def lsh(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return reduce.similar(rows.where("vec_id % 100 = 0"), rows, 1.2)


@query("encoder_forward")
def encoder_forward(spark, sf_dir):
    """A small random encoder over 4 x 8 identifier and token matrices that are cut out of the embeddings."""
    cut = lambda at: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding").cast("array<float>"), i * 8 + at, 8))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), cut(1).alias("identifiers"), cut(33).alias("tokens"), F.col("label").alias("hint"))
    return encoder.embedded(rows, encoder.Encoder.random(8, 16, 10, 12), n_hints=10)


_MODULES = "(SELECT 'm' || p_partkey || '.py' AS file, regexp_replace(p_name, '[^A-Za-z]+', '_', 'g') AS f, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS c FROM part)"
_SLOTS = """(VALUES ('', 'module', 'Variable', 'limit', 'int', 'limit int', 3), ('{f}', 'function', 'Parameter', 'self', '', '', 6), ('{f}', 'function', 'Parameter', 'size', 'int', 'total size other', 6),
    ('{f}', 'function', 'Parameter', 'other', '', 'total size other', 6), ('{f}', 'function', 'Return', '{f}', '', 'return total', 6), ('{f}', 'function', 'Variable', 'total', '', 'total size other|total', 7),
    ('{c}', 'class', 'Variable', 'kind', '', 'kind|self kind', 12), ('{c}.get', 'function', 'Return', 'get', '', 'return self.kind', 14)) v(scope, level, kind, name, annotation, occurrences, line)"""


@query("extract_slots", f"SELECT file, replace(replace(scope, '{{f}}', f), '{{c}}', c) AS scope, level, kind, replace(name, '{{f}}', f) AS name, annotation, occurrences, line FROM {_MODULES}, {_SLOTS}")
def extract_slots(spark, sf_dir):
    """Slots of small modules that are built from part names."""
    name = F.regexp_replace("p_name", "[^A-Za-z]+", "_")
    source = F.concat(F.lit("import os\n\nlimit: int = 3\n\n\ndef "), name, F.lit("(self, size: int, other):\n    total = size + other\n    return total\n\n\nclass "), F.initcap(F.lower("p_type")), F.lit(":\n    kind = '"), F.col("p_brand"), F.lit("'\n\n    def get(self):\n        return self.kind\n"))
    found = extract.extracted(table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), source.alias("text")))
    return found.where("error is null").select("file", "scope", "level", "kind", "name", "annotation", F.array_join("occurrences", "|").alias("occurrences"), "line")


@query("slot_documents", f"SELECT file, 'Class' || f AS class_name, scope, count(*) AS n FROM (SELECT file, replace(scope, '{{f}}', f) AS scope, f FROM {_MODULES}, {_SLOTS} WHERE scope = '{{f}}') GROUP BY ALL")
def slot_documents(spark, sf_dir):
    """Predictions for the slots of a function written back into documents, which are read again."""
    found = extract_slots(spark, sf_dir).where("level = 'function' and name not in ('get')").withColumn("predictions", F.array(F.struct(F.lit("int").alias("type"), F.lit(0.5).alias("score")))).withColumn("error", F.lit(None).cast("string"))
    shape = "variables_p map<string,array<array<string>>>, funcs array<struct<q_name:string,params_p:map<string,array<array<string>>>,variables_p:map<string,array<array<string>>>,ret_type_p:array<array<string>>>>"
    read = infer.module_documents(found).select("file", F.inline(F.from_json("module", shape)["funcs"]))
    n = F.size(F.coalesce("params_p", F.create_map().cast("map<string,array<array<string>>>"))) + F.size(F.coalesce("variables_p", F.create_map().cast("map<string,array<array<string>>>"))) + F.size(F.coalesce("ret_type_p", F.array().cast("array<array<string>>")))
    return read.select("file", F.concat(F.lit("Class"), F.col("q_name")).alias("class_name"), F.col("q_name").alias("scope"), n.cast("long").alias("n"))


@query("source_files", "SELECT n_regionkey || '/' || n_name || '/m' || n_nationkey || '.py' AS file, n_regionkey::VARCHAR AS author, n_name AS repo, 'x = ' || n_nationkey || chr(10) AS text FROM nation")
def source_files(spark, sf_dir):
    """A source tree, one file per nation, written to the shared folder and read by its reader; hidden folders and other files stay out."""
    root = tables.new_folder(spark, "tree")
    for r in table(spark, sf_dir, "nation").collect():  # a table of fixed size
        folder = f"{root}/{r.n_regionkey}/{r.n_name}"
        tables.write_file(spark, f"{folder}/m{r.n_nationkey}.py", f"x = {r.n_nationkey}\n")
        tables.write_file(spark, f"{folder}/readme.md", "no")
        tables.write_file(spark, f"{root}/.git/{r.n_name}/m.py", "no")
    return corpus.source_files(spark, root).select("file", "author", "repo", "text")


# -- streams ----------------------------------------------------------------------------------------------------------


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it a file or a folder of files; the brackets are a pattern for a plain dot, as a stream's path has to be a folder or a pattern."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}[.]parquet")


@query("rate_admitted_stream", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM events")
def rate_admitted_stream(spark, sf_dir):
    """Admission with state per client, as requests come in."""
    return admission.run_to_table(service.admitted_stream(_stream(spark, sf_dir, "events"), 2, "day"), "rate_admitted_stream", "append").select("event_id", "admitted")


@query(
    "accept_join_stream",
    """SELECT a.event_id AS accepted_id, r.event_id AS request_id FROM events a JOIN events r ON a.event_type = 'purchase' AND r.event_type = 'view' AND r.user_id = a.user_id AND a.ts >= r.ts AND a.ts <= r.ts + INTERVAL 1 HOUR""",
)
def accept_join_stream(spark, sf_dir):
    """Acceptances (purchases) with the requests (views) of their session at most an hour before."""
    accepted = _stream(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("accepted_id"), F.col("user_id").alias("sess_id"), F.col("ts").cast("timestamp").alias("timestamp"))
    requests = _stream(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("sess_id"), F.col("ts").alias("start_t"))
    return admission.run_to_table(service.joined_acceptances(accepted, requests).select("accepted_id", "request_id"), "accept_join_stream", "append")


@query("live_votes", _TOPK + "SELECT query_id, label, round(score, 6) AS score, rank FROM r")
def live_votes(spark, sf_dir):
    """Votes for vectors that come in as a stream, against the stored rows."""
    path, checkpoint = tables.new_folder(spark, "votes"), tables.new_folder(spark, "votes-checkpoint")
    asked = _stream(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    service.predicted_batches(asked, table(spark, sf_dir, "embeddings"), path, checkpoint).start().awaitTermination()
    found = spark.read.parquet(path)
    return found.select("query_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query("request_log", "SELECT event_id, sha1('10.0.0.' || user_id) AS hashed_ip, ts AS start_t FROM events")
def request_log(spark, sf_dir):
    """Requests appended to a log, as they come in, with their address as a hash."""
    path, checkpoint = tables.new_folder(spark, "log"), tables.new_folder(spark, "log-checkpoint")
    rows = _stream(spark, sf_dir, "events").select("event_id", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"), F.col("ts").alias("start_t"))
    service.append_batches(service.logged_requests(rows), path, checkpoint).start().awaitTermination()
    return spark.read.parquet(path).select("event_id", F.col("hashed_IP").alias("hashed_ip"), "start_t")


# -- metrics on codes -------------------------------------------------------------------------------------------------

_CODED = _TOPK + ", p AS (SELECT query_id, label, rank FROM r WHERE rank <= 5), j AS (SELECT e.vec_id AS query_id, e.label, max((p.label = e.label)::INTEGER) AS hit, CASE WHEN e.label IN (0, 1) THEN 'ubiquitous' WHEN e.label IN (2, 3, 4) THEN 'common' ELSE 'rare' END AS tier FROM embeddings e JOIN p ON p.query_id = e.vec_id GROUP BY ALL)"


@query("eval_codes", _CODED + " SELECT count(*) AS n, " + ", ".join([_metric("exact_all", "sum(hit)", "count(*)"), *[_metric(f"exact_{t}", _tiers("hit", t), _N.format(t)) for t in ("ubiquitous", "common", "rare")]]) + " FROM j")
def eval_codes(spark, sf_dir):
    """Exact matches on label codes, by tier."""
    votes = knn.vote(_neighbours(spark, sf_dir))
    lists = votes.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("predicted"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "label").join(lists, "query_id")
    found = evaluate.code_metrics(rows, (0, 1), spark.createDataFrame([(2,), (3,), (4,)], "label int"), 5)
    return found.select("n", *[F.round(c, 6).alias(c) for c in found.columns if c != "n"])


from slotloom.plans import catalog_build  # noqa: E402, F401  adds its queries
