"""Queries of the batch build's own readers, writers and steps, with their SQL.

What a query reads back it has written to the shared folder first, from whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.functions import types
from slotloom.operators import datapoints, edits, evaluate, extract, features, filters, forest, infer, knn, labels, pivots, typecheck
from slotloom.plans import modules
from slotloom.plans.catalog import _BUCKET, _FUNCTIONS, _OUTPUT_SQL, _RANKED, _SPLIT, _TOPK, _TYPES, _VERDICTS, _functions, _neighbours, _outputs, _stream, _types, _verdicts, query, table
from slotloom.sources import corpus, records, tables, tensors
from slotloom.streaming import admission, service

# -- tables and text --------------------------------------------------------------------------------------------------


@query("csv_table", "SELECT conv_id, turn, role, text FROM conversations")
def csv_table(spark, sf_dir):
    """Conversations as CSV, with all their line breaks and quotes, and back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = tables.new_folder(spark, "csv")
    corpus.write_csv(rows, path)
    return corpus.read_csv(spark, path, rows.schema)


_POINTS = f"(SELECT CASE p_partkey % 3 WHEN 0 THEN 'Parameter' WHEN 1 THEN 'Return' ELSE 'Variable' END AS task, {_SPLIT.format('p_name || p_partkey')} AS split, p_size AS identifiers, p_size * 2 AS tokens, p_size * 3 AS hint, p_partkey % 7 AS label FROM part)"


def _points(spark, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    task = F.when(F.col("p_partkey") % 3 == 0, "Parameter").when(F.col("p_partkey") % 3 == 1, "Return").otherwise("Variable")
    split = datapoints.split_of(F.concat("p_name", F.col("p_partkey").cast("string")))
    rows = part.select(task.alias("task"), split.alias("split"), F.col("p_size").alias("identifiers"), (F.col("p_size") * 2).alias("tokens"), (F.col("p_size") * 3).alias("hint"), (F.col("p_partkey") % 7).alias("label"))
    path = tables.new_folder(spark, "datapoints")
    corpus.write_datapoints(rows, path)
    return spark.read.parquet(path)


@query(
    "load_variants",
    f"""WITH p AS {_POINTS}, v AS (SELECT * FROM (VALUES ('complete', 1, 1, 1), ('woc', 1, 0, 1), ('woi', 0, 1, 1), ('wov', 1, 1, 0)) v(variant, i, t, h))
    SELECT variant, split, task, count(*) AS n, sum(i * identifiers + t * tokens + h * hint)::BIGINT AS total, sum(label)::BIGINT AS labels FROM p, v GROUP BY ALL""",
)
def load_variants(spark, sf_dir):
    """What each model variant reads of each split."""
    points, parts = _points(spark, sf_dir), []
    for variant, columns in datapoints.VARIANTS.items():
        for split in datapoints.SPLITS:
            rows = datapoints.load_split(points, split, variant)
            total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
            parts.append(rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum(total).cast("long").alias("total"), F.sum("label").cast("long").alias("labels")).select(F.lit(variant).alias("variant"), F.lit(split).alias("split"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("load_task", f"SELECT label, count(*) AS n FROM {_POINTS} WHERE split = 'train' AND task = 'Return' GROUP BY label HAVING count(*) >= 3")
def load_task(spark, sf_dir):
    """One task's training labels with enough support."""
    rows = labels.supported(datapoints.load_split(_points(spark, sf_dir), "train", task="Return"), "label")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("visible_top", "SELECT p_type AS type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, type LIMIT 4")
def visible_top(spark, sf_dir):
    """Lists of visible types, one per line, and the most frequent of them."""
    path = tables.new_folder(spark, "visible")
    table(spark, sf_dir, "part").select("p_type").write.text(path)
    return labels.top_types(corpus.visible_types(spark, path), 4).select("type", "n")


@query("label_decode", f"WITH t AS {_TYPES} SELECT type, count(*) AS n FROM t WHERE type IS NOT NULL GROUP BY type")
def label_decode(spark, sf_dir):
    """Types as codes, and back by the saved dictionary."""
    rows = _types(spark, sf_dir)
    codes = tables.written(labels.encoded(rows), "codes")
    coded = labels.with_codes(rows, "type", codes, "code").select("code")
    return coded.join(codes.select("code", "type"), "code").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "hint_random",
    f"""WITH r AS {_RANKED}, t AS (SELECT DISTINCT substr(p_type, 1 + p_partkey % 3, p_partkey % 4) AS aval_types FROM part)
    SELECT aval_types, coalesce((SELECT min(rank) FROM r WHERE contains(r.type, t.aval_types) AND ('0x' || substr(md5(t.aval_types || '#' || rank || '#3'), 1, 8))::BIGINT % 1000 >= 500), (SELECT count(*) - 1 FROM r))::INTEGER AS hint FROM t""",
)
def hint_random(spark, sf_dir):
    """Hints of visible types, each match kept by a seeded coin."""
    part = table(spark, sf_dir, "part")
    asked = part.select(F.expr("substr(p_type, cast(1 + p_partkey % 3 as int), cast(p_partkey % 4 as int))").alias("aval_types")).distinct()
    return labels.random_hint_codes(asked, labels.top_types(part.select(F.col("p_type").alias("type")), 1024), seed=3)


# -- project documents ------------------------------------------------------------------------------------------------

GROUP = 100


def _documents(spark, sf_dir: str) -> DataFrame:
    """Modules of projects, read from JSON files: each conversation is a project with one function whose parameters are its turns."""
    used = F.transform("arg_names", lambda n: F.array(F.array(n, F.lit("used"))))
    function = F.struct(
        F.lit("run").alias("name"), F.concat(F.lit("run"), F.col("conv_id").cast("string")).alias("q_name"), F.struct(F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("func")).alias("docstring"), F.map_from_arrays("arg_names", "arg_types").alias("params"),
        F.map_from_arrays("arg_names", used).alias("params_occur"), F.map_from_arrays("arg_names", "arg_descrs").alias("params_descr"), F.array(F.concat(F.lit("return "), F.element_at("arg_names", -1))).alias("ret_exprs"), F.lit("int").alias("ret_type"),
        F.create_map(F.lit("total"), F.lit("int")).alias("variables"), F.create_map(F.lit("total"), F.array(F.array(F.lit("total"), F.lit("x")))).alias("fn_var_occur"),
    )
    module = F.struct(F.array(function).alias("funcs"), F.array().cast("array<string>").alias("classes"), F.create_map(F.lit("limit"), F.lit("str")).alias("variables"), F.create_map(F.lit("limit"), F.array(F.array(F.lit("limit")))).alias("mod_var_occur"))
    project = F.concat(F.lit("ann/p"), F.col("conv_id").cast("string"))
    content = F.struct(F.create_map(F.concat(project, F.lit("/m.py")), module).alias("src_files"))
    rows = _functions(spark, sf_dir).select(F.floor(F.col("conv_id") / GROUP).alias("g"), F.struct(project.alias("key"), content.alias("value")).alias("entry"))
    files = rows.groupBy("g").agg(F.to_json(F.map_from_entries(F.collect_list("entry"))).alias("value"))
    path = tables.new_folder(spark, "projects")
    files.repartition("g").write.partitionBy("g").text(path)
    return corpus.project_documents(spark, [f"{path}/*"])


@query(
    "project_functions",
    f"""SELECT 'ann' AS author, 'p' || conv_id AS repo, 'ann/p' || conv_id || '/m.py' AS file, 'run' AS name, 'Talk ' || conv_id AS func_descr, array_to_string(names, '|') AS arg_names, array_to_string(kinds, '|') AS arg_types, array_to_string(descrs, '|') AS arg_descrs,
    array_to_string(list_transform(names, lambda n: n || ' used'), '|') AS args_occur, 'int' AS return_type, 'return ' || names[-1] AS return_expr FROM {_FUNCTIONS}""",
)
def project_functions(spark, sf_dir):
    found = corpus.function_rows(_documents(spark, sf_dir))
    return found.select("author", "repo", "file", "name", "func_descr", *[F.array_join(c, "|").alias(c) for c in ("arg_names", "arg_types", "arg_descrs")], F.array_join(F.flatten("args_occur"), "|").alias("args_occur"), "return_type", F.array_join("return_expr", "|").alias("return_expr"))


@query("project_variables", f"SELECT 'ann/p' || conv_id || '/m.py' AS file, var_name, var_type, var_occur FROM {_FUNCTIONS}, (VALUES ('limit', 'str', 'limit'), ('total', 'int', 'total x')) v(var_name, var_type, var_occur)")
def project_variables(spark, sf_dir):
    return corpus.variable_rows(_documents(spark, sf_dir)).select("file", "var_name", "var_type", F.array_join("var_occur", "|").alias("var_occur"))


@query(
    "document_slots",
    f"""WITH f AS {_FUNCTIONS}, s AS (SELECT conv_id, 'function' AS level, 'Parameter' AS kind, unnest(names) AS name, unnest(kinds) AS annotation, unnest(names) || ' used' AS occurrences FROM f
      UNION ALL SELECT conv_id, 'function', 'Return', 'run', 'int', 'return ' || names[-1] FROM f UNION ALL SELECT conv_id, 'function', 'Variable', 'total', 'int', 'total x' FROM f UNION ALL SELECT conv_id, 'module', 'Variable', 'limit', 'str', 'limit' FROM f)
    SELECT 'ann/p' || conv_id || '/m.py' AS file, CASE level WHEN 'module' THEN '' ELSE 'run' || conv_id END AS scope, level, kind, name, annotation, occurrences FROM s""",
)
def document_slots(spark, sf_dir):
    """Slots at all levels of the documents."""
    found = infer.slots_of_documents(_documents(spark, sf_dir).select("file", "module"))
    return found.select("file", "scope", "level", "kind", "name", "annotation", F.array_join("occurrences", "|").alias("occurrences"))


@query("repositories", "SELECT DISTINCT n_regionkey::VARCHAR AS author, n_name AS repo FROM nation")
def repositories(spark, sf_dir):
    files = table(spark, sf_dir, "nation").select(F.concat_ws("/", "n_regionkey", "n_name", F.lit("m.py")).alias("file"), F.col("n_regionkey").cast("string").alias("author"), F.col("n_name").alias("repo"))
    return corpus.repositories(files.unionByName(files.select(F.concat(F.lit(".x/"), "file").alias("file"), F.lit(".x").alias("author"), "repo")))


@query(
    "return_datapoints",
    f"""SELECT 'f' || conv_id AS file, CASE conv_id % 3 WHEN 0 THEN 'int' ELSE 'List[str]' END AS return_type, array_to_string(list_filter(names, lambda x: x <> 'self'), ' ') AS arg_names_str,
    array_to_string(list_transform(names, lambda x: regexp_replace('return ' || x || '.self.a', 'self\\.?', '', 'g')), ' ') AS return_expr_str FROM {_FUNCTIONS} WHERE conv_id % 3 <> 2""",
)
def return_datapoints(spark, sf_dir):
    """Functions with a known return type, and their strings."""
    kind = F.when(F.col("conv_id") % 3 == 0, "int").when(F.col("conv_id") % 3 == 1, "List[str]").otherwise("None")
    rows = _functions(spark, sf_dir).select("file", "arg_names", kind.alias("return_type"), F.transform("arg_names", lambda x: F.concat(F.lit("return "), x, F.lit(".self.a"))).alias("return_expr"))
    return datapoints.returns(rows).select("file", "return_type", "arg_names_str", "return_expr_str")


# -- features ---------------------------------------------------------------------------------------------------------


@query(
    "sequence_vectors",
    """WITH w AS (SELECT 'w' || vec_id AS word, embedding[1:4] AS v FROM embeddings WHERE vec_id < 5), s AS (SELECT conv_id, turn, [role, 'w' || (turn % 7), 'zzz', 'w' || (conv_id % 6), 'w1'] AS words FROM conversations),
    p AS (SELECT conv_id, turn, unnest(range(1, 5)) AS i, words FROM s)
    SELECT conv_id, turn, round(sum(coalesce(i * (v[1] + 2 * v[2] + 3 * v[3] + 4 * v[4]), 0))::DOUBLE, 4) AS weighed FROM p LEFT JOIN w ON word = words[i] GROUP BY ALL""",
)
def sequence_vectors(spark, sf_dir):
    """The first four words of a sequence as vectors in their places; unknown words leave theirs empty."""
    words = table(spark, sf_dir, "embeddings").where("vec_id < 5").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.slice("embedding", 1, 4).cast("array<float>").alias("vector"))
    text = F.concat_ws(" ", "role", F.concat(F.lit("w"), (F.col("turn") % 7).cast("string")), F.lit("zzz"), F.concat(F.lit("w"), (F.col("conv_id") % 6).cast("string")), F.lit("w1"))
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), text.alias("sequence"))
    found = features.vectorised(rows, words, 4, 4)
    each = F.transform("matrix", lambda row, i: F.aggregate(F.transform(row, lambda x, j: x.cast("double") * (i + 1) * (j + 1)), F.lit(0.0), lambda s, x: s + x))
    return found.select("id.*", F.round(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), 4).alias("weighed"))


@query(
    "sequence_vectors_whole",
    """WITH w AS (SELECT 'w' || vec_id AS word, embedding AS v FROM embeddings), s AS (SELECT conv_id, turn, list_transform(regexp_extract_all(translate(coalesce(text, ''), chr(160), ' '), '\\S+')[1:21], lambda t: 'w' || (strlen(t) * 7)) AS words FROM conversations),
    p AS (SELECT conv_id, turn, unnest(range(1, 22)) AS i, words FROM s)
    SELECT conv_id, turn, round(sum(coalesce(i * list_sum(v::DOUBLE[]), 0))::DOUBLE, 3) AS weighed FROM p LEFT JOIN w ON word = words[i] GROUP BY ALL""",
)
def sequence_vectors_whole(spark, sf_dir):
    """The words of whole texts, each as the vector that its length picks out of all embeddings, in 21 places of 64 components."""
    words = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").cast("array<float>").alias("vector"))
    spelled = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "\u00a0", " "), "\\s+"), lambda t: t != "")
    text = F.array_join(F.transform(spelled, lambda t: F.concat(F.lit("w"), (F.octet_length(t) * 7).cast("string"))), " ")
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), text.alias("sequence"))
    found = features.vectorised(rows, words, 21, 64)
    each = F.transform("matrix", lambda row, i: (i + 1) * F.aggregate(row, F.lit(0.0), lambda s, x: s + x.cast("double")))
    return found.select("id.*", F.round(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), 3).alias("weighed"))


@query("imports", "SELECT 'm' || p_partkey || '.py' AS file, array_to_string(['os', upper(p_type), 'Kind' || p_size, 'k'], '|') AS imports FROM part")
def imports(spark, sf_dir):
    """The names that sources import."""
    text = F.concat(F.lit("import os\nfrom shop.items import "), F.upper("p_type"), F.lit(", Kind"), F.col("p_size").cast("string"), F.lit(" as k\n\nx = 'import y'\n"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), text.alias("text"))
    return infer.imported(rows).select("file", F.array_join("imports", "|").alias("imports"))


# -- neighbours and metrics -------------------------------------------------------------------------------------------


@query("index_all_cells", _TOPK + "SELECT query_id, item_id, label, round(dist, 6) AS dist, rn FROM k")
def index_all_cells(spark, sf_dir):
    """The inverted file, saved and loaded, with all cells probed: exact."""
    rows, path = table(spark, sf_dir, "embeddings"), tables.new_folder(spark, "index")
    knn.InvertedFile.build(rows).save(path)
    index = knn.InvertedFile.load(spark, path)
    found = index.search(rows.where("vec_id % 100 = 0"), probes=len(index.centroids))
    return found.select("query_id", "item_id", "label", F.round("dist", 6).alias("dist"), F.col("rn").cast("long"))


_ALL = _TOPK.replace("WHERE q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id", "WHERE q.vec_id <> e.vec_id")


@query("knn_join", _ALL + "SELECT query_id, item_id, label, round(dist, 6) AS dist, rn FROM k")
def knn_join(spark, sf_dir):
    """The nearest rows of every row, by cells that the triangle inequality leaves."""
    rows = table(spark, sf_dir, "embeddings")
    return pivots.PivotJoin(rows).join(rows).select("query_id", "item_id", "label", F.round("dist", 6).alias("dist"), F.col("rn").cast("long"))


def _forest(spark, sf_dir) -> forest.Forest:
    """Trees over three quarters of the rows; the rest is appended, and the index read from its folder."""
    rows, path = table(spark, sf_dir, "embeddings"), tables.new_folder(spark, "forest")
    forest.Forest.build(rows.where("vec_id % 4 <> 0"), path).append(rows.where("vec_id % 4 = 0"), 1)
    return forest.Forest(spark, path)


@query("forest_ann")
def forest_ann(spark, sf_dir):
    """Approximate neighbours by best-first descent over the trees."""
    return _forest(spark, sf_dir).search(table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0"))


@query("forest_all_leaves", _TOPK + "SELECT query_id, item_id, label, round(dist, 6) AS dist, rn FROM k")
def forest_all_leaves(spark, sf_dir):
    """The trees with all leaves opened: exact."""
    index = _forest(spark, sf_dir)
    found = index.search(table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0"), reach=index.trees * index.rows.count())
    return found.select("query_id", "item_id", "label", F.round("dist", 6).alias("dist"), F.col("rn").cast("long"))


@query(
    "parametric_codes",
    _TOPK
    + """, n AS (SELECT * FROM (VALUES (0, 'str'), (1, 'List[int]'), (2, 'Dict[str, int]'), (3, 'bool'), (4, 'Foo'), (5, 'list'), (6, 'List[str]'), (7, 'Optional[int]'), (8, 'Set[str]'), (9, 'dict')) n(code, type)),
    o AS (SELECT code, type, regexp_matches(type, '^(.+)\\[(.+)\\]') AS parametric, regexp_extract(type, '^(.+)\\[(.+)\\]', 1) AS outer_type FROM n)
    SELECT e.vec_id AS id, e.label, coalesce(bool_or(t.parametric AND CASE WHEN p.parametric THEN p.outer_type = t.outer_type ELSE lower(p.type) = lower(t.outer_type) END), false) AS match
    FROM embeddings e JOIN r ON r.query_id = e.vec_id JOIN o p ON p.code = r.label JOIN o t ON t.code = e.label GROUP BY ALL""",
)
def parametric_codes(spark, sf_dir):
    """Whether some predicted code has the outer name of the true one."""
    names = ("str", "List[int]", "Dict[str, int]", "bool", "Foo", "list", "List[str]", "Optional[int]", "Set[str]", "dict")
    lists = knn.vote(_neighbours(spark, sf_dir)).groupBy(F.col("query_id").alias("id")).agg(F.collect_list("label").alias("predicted"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label").join(lists, "id")
    return evaluate.parametric_code_matches(rows, spark.createDataFrame(list(enumerate(names)), "code int, type string")).select("id", "label", "match")


# -- type checks ------------------------------------------------------------------------------------------------------


_KNOWN = ", ".join(f"('{c}')" for c in dict.fromkeys((*typecheck.ALL_CODES["mypy"], *typecheck.INCLUDED_CODES["mypy"])))
_INCLUDED = ", ".join(f"'{c}'" for c in typecheck.INCLUDED_CODES["mypy"])


@query("tc_codes", f"SELECT file, code, count(*) AS n, code IN ({_INCLUDED}) AS included FROM (SELECT file, unnest(lines) AS line FROM {_OUTPUT_SQL}) JOIN (VALUES {_KNOWN}) v(code) ON ends_with(line, code) GROUP BY file, code")
def tc_codes(spark, sf_dir):
    """How often each known error code occurs in a checker's output, counted or not."""
    return typecheck.by_code(_outputs(spark, sf_dir))


@query(
    "typed_sources",
    """SELECT 'm' || p_partkey || '.py' AS file, CASE WHEN p_size % 3 = 0 THEN 'def f(a):' || chr(10) || '    return a' || chr(10)
      ELSE 'def f(a' || CASE WHEN p_size % 3 = 1 THEN ': ' || lower(p_type) ELSE '' END || ')' || CASE WHEN p_size % 3 = 2 THEN ' -> ' || lower(p_type) ELSE '' END || ':' || chr(10) || '    return a' END AS text FROM part""",
)
def typed_sources(spark, sf_dir):
    """Sources with the predictions that passed."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), "p_size", F.lower("p_type").alias("prediction"))
    slots = F.explode(F.array(F.struct(F.lit("f.a").alias("slot"), (F.col("p_size") % 3 == 1).alias("is_tc"), F.lit(0).alias("place")), F.struct(F.lit("f.return").alias("slot"), (F.col("p_size") % 3 == 2).alias("is_tc"), F.lit(1).alias("place"))))
    verdicts = part.select("file", "prediction", slots.alias("s")).select("file", "prediction", "s.*")
    return typecheck.typed_sources(part.select("file", F.lit("def f(a):\n    return a\n").alias("text")), verdicts)


@query("passing_predictions", f"SELECT p_partkey AS file, prediction AS type FROM {_VERDICTS} WHERE is_tc")
def passing_predictions(spark, sf_dir):
    """Predictions without those that failed their check."""
    verdicts = _verdicts(spark, sf_dir).select(F.col("p_partkey").alias("file"), F.lit("x").alias("slot"), "prediction", "is_tc")
    listed = verdicts.select("file", "slot", F.col("prediction").alias("type"))
    return typecheck.without_failing(listed, verdicts).select("file", "type")


@query("known_types", "SELECT doc_id, source AS var_type FROM documents WHERE source IS NOT NULL")
def known_types(spark, sf_dir):
    return filters.with_type(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("var_type")))


@query("anchored_prefix", "SELECT event_id, regexp_replace(t, '(^|[^A-Za-z0-9_])(typing_extensions|typing|builtins|collections|t)\\.', '\\1', 'g') AS type FROM (SELECT event_id, (['pytest.', 'typing.List[t.', 'x[builtins.', 'a.t.'])[(event_id % 4) + 1] || event_type AS t FROM events)")
def anchored_prefix(spark, sf_dir):
    """Prefixes where names start only."""
    start = F.get(F.array(*[F.lit(x) for x in ("pytest.", "typing.List[t.", "x[builtins.", "a.t.")]), (F.col("event_id") % 4).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(start, "event_type").alias("t"))
    return rows.select("event_id", types.strip_prefixes(F.col("t"), anchored=True).alias("type"))


# -- service ----------------------------------------------------------------------------------------------------------


@query("acceptance_log", "SELECT event_id, user_id AS sess_id FROM events a WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'view' AND r.user_id = a.user_id)")
def acceptance_log(spark, sf_dir):
    """Valid acceptances, appended to their log and read again."""
    events, path = table(spark, sf_dir, "events"), tables.new_folder(spark, "accepted")
    service.append_acceptances(events.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("sess_id")), events.where("event_type = 'view'").select(F.col("user_id").alias("sess_id")), path)
    return spark.read.parquet(path)


@query("telemetry", "SELECT event_id::VARCHAR AS response, CASE WHEN event_type = 'error' THEN 'failed' END AS error, CASE WHEN event_type <> 'error' THEN 's' || user_id END AS session_id FROM events")
def telemetry(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("sess_id"), F.col("event_id").cast("string").alias("response"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"))
    return service.telemetry(rows)


@query("split_bucket", f"SELECT c_custkey, {_BUCKET.format('c_name')}::INTEGER AS bucket FROM customer")
def split_bucket(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", datapoints.bucket(F.col("c_name")).alias("bucket"))


# -- scopes and edits -------------------------------------------------------------------------------------------------


def _literal(x) -> str:
    return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


_SLOT_VALUES = ", ".join("(" + ", ".join(_literal(x) for x in row) + ")" for row in modules.slot_rows())


@query(
    "scope_slots",
    f"""SELECT 'm' || p_partkey || '.py' AS file, replace(scope, 'NAME', 'n' || p_partkey) AS scope, kind, replace(name, 'NAME', 'n' || p_partkey) AS name, annotation, line, at_line, owner
    FROM part JOIN (VALUES {_SLOT_VALUES}) v(module, scope, kind, name, annotation, line, at_line, owner) ON p_partkey % {len(modules.MODULES)} = module""",
)
def scope_slots(spark, sf_dir):
    """Slots of a table of source lines, by the table function and its partitions: hand-written modules of every kind of statement, one per part."""
    extract.register(spark)
    texts = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(modules.MODULES)], "module int, text string")
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(modules.MODULES)).alias("module"))
    named = part.join(F.broadcast(texts), "module").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), F.replace("text", F.lit("NAME"), F.concat(F.lit("n"), F.col("p_partkey").cast("string"))).alias("text"))
    named.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text")).createOrReplaceTempView("slotloom_source_lines")
    found = spark.sql("SELECT * FROM source_slots(TABLE(slotloom_source_lines) PARTITION BY file ORDER BY line)")
    return found.where("error is null").select("file", "scope", "kind", "name", "annotation", "line", F.col("at").alias("at_line"), "owner")


#: Comments, decorators and line breaks that an unparser would lose; {x: T} marks what an annotation adds.
_MARKED = "# head of NAME\n@dec  # why\ndef NAME(a{: T},  # first\n         b{: T} = 1, *c):{}  # second\n    x{: T} = a ;  y = b\n    for z in c : pass\n    return (x,\n            y)\n\n\nclass K :   # no base\n\tv{: T}=  'ö'\n\tdef get(self){ -> T} : return self.v"


@query(
    "lossless_annotations",
    "SELECT 'm' || p_partkey || '.py' AS file, replace(replace(" + _literal(re.sub(r"\{(.*?)\}", r"\1", _MARKED)).replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + ", 'NAME', 'n' || p_partkey), ': T', ': List[' || lower(p_type) || ']').replace(' -> T', ' -> List[' || lower(p_type) || ']') AS text, true AS same FROM part",
)
def lossless_annotations(spark, sf_dir):
    """Sources with annotations put in, all else byte for byte as it was, and whether taking them out gives the source back."""
    plain = F.replace(F.lit(re.sub(r"\{.*?\}", "", _MARKED)), F.lit("NAME"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")))
    sources = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("file"), plain.alias("text"), F.concat(F.lit("List["), F.lower("p_type"), F.lit("]")).alias("type"))
    slots = extract.extracted(sources.select("file", "text")).where("error is null and name not in ('y', 'z')").where("kind <> 'Return' or name = 'get'")
    wanted = slots.select("file", "place").join(sources.select("file", F.col("type").alias("annotation")), "file")
    found = tables.written(edits.annotated_sources(sources, wanted), "annotated")
    back = edits.restored(found).select("file", F.col("text").alias("back")).join(sources.select("file", F.col("text").alias("before")), "file")
    return found.select("file", "text").join(back, "file").select("file", "text", (F.col("back") == F.col("before")).alias("same"))


# -- substrings, records, tensors and limits --------------------------------------------------------------------------


@query(
    "hint_postings",
    f"""WITH r AS {_RANKED}, t AS (SELECT DISTINCT p_type AS type FROM part UNION SELECT lower(p_type) FROM part UNION SELECT right(p_type, length(p_type) - 1) FROM part UNION SELECT substr(p_type, 1 + p_size % 4) FROM part
      UNION SELECT reverse(p_type) FROM part UNION SELECT p_name FROM part UNION SELECT left(p_name, p_size % 6) FROM part)
    SELECT type, coalesce((SELECT min(rank) FROM r WHERE contains(r.type, t.type)), (SELECT count(*) - 1 FROM r))::INTEGER AS hint FROM t""",
)
def hint_postings(spark, sf_dir):
    """The first ranked type that contains a string, for whole strings of every length."""
    part = table(spark, sf_dir, "part")
    asked = None
    for c in ("p_type", "lower(p_type)", "right(p_type, length(p_type) - 1)", "substr(p_type, 1 + p_size % 4)", "reverse(p_type)", "p_name", "left(p_name, p_size % 6)"):
        one = part.select(F.expr(c).alias("type"))
        asked = one if asked is None else asked.unionByName(one)
    return labels.hint_codes(asked, labels.top_types(part.select(F.col("p_type").alias("type")), 1024))


_EVENT = "event_id, user_id, event_type, ts"


@query("record_stream", f"SELECT {_EVENT} FROM events")
def record_stream(spark, sf_dir):
    """Request records read as a stream, in row ranges, into a table by epoch."""
    spark.dataSource.register(records.RequestRecords)
    schema = table(spark, sf_dir, "events").select(*_EVENT.split(", ")).schema
    stream = spark.readStream.format("request_records").schema(schema).option("rows", 2000).option("glob", "events.parquet").load(sf_dir)
    return admission.run_to_table(stream, "records")


@query("record_table", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def record_table(spark, sf_dir):
    """The same records as a batch."""
    spark.dataSource.register(records.RequestRecords)
    schema = table(spark, sf_dir, "events").select(*_EVENT.split(", ")).schema
    rows = spark.read.format("request_records").schema(schema).option("glob", "events.parquet").option("rows", 2000).load(sf_dir)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), F.sum("user_id").cast("long").alias("users"))


@query("tensor_files", "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings")
def tensor_files(spark, sf_dir):
    """Embeddings as tensor files in two commits, and back by row ranges."""
    spark.dataSource.register(tensors.Tensors)
    rows, path = table(spark, sf_dir, "embeddings"), tables.new_folder(spark, "tensors")
    for part in (rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")):
        part.select("vec_id", "embedding", "label").write.format("tensors").mode("append").save(path)
    back = spark.read.format("tensors").option("rows", 100).load(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", "label", F.round(total, 4).alias("total"), F.col("embedding")[0].cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"))


@query(
    "admission_stream",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) <= 1 AND row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 2 AS admitted FROM events",
)
def admission_stream(spark, sf_dir):
    """Both limits of a client in one stateful operator."""
    return admission.run_to_table(admission.admissions(_stream(spark, sf_dir, "events"), 1, 2), "admission")
