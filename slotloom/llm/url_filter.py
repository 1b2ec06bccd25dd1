"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Rules are ``domain/path`` strings with a verdict.  A rule fits its host and all
subdomains if the url's path starts with the rule's; the longest fitting rule
wins, of equally long ones the first listed.  Urls that a rule judges are the labelled ones; the trees
learn from a bounded sample of them (``SAMPLE_ROWS`` rows with the smallest hash
of url) and judge the others.  The trained trees become nested ``CASE``
expressions, so judging is one codegen'd projection without Python.

Suffix statistics are smoothed block shares of the last label of hosts, of their
last two labels, and of these with the first path segment, over all labelled urls,
in ``SUFFIX_CELLS`` hash cells each: a table of fixed size.  A share leans on that of the
shorter suffix, so an unseen suffix has its.  They are counted in
``FOLDS`` folds of urls, and a sample row gets the shares of the other folds, so a tree
never sees a row's own label (nor that of equal urls) in its features.

Defined results: null urls and urls without ``://`` have an empty host and path
and are allowed unless the trees say otherwise; with fewer than two classes among
the labelled urls the verdict is allow; repeated urls are judged alike; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import stored

SAMPLE_ROWS, SAMPLE_PARTS = 20_000, 4
SUFFIX_CELLS = 4096
FOLDS = 5
TREES, DEPTH = 10, 4
MAX_RULE_EXPRESSIONS = 256
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix1", "suffix2", "suffix3")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule's text, else null; for lists short enough to be an expression."""
    if len(rules) > MAX_RULE_EXPRESSIONS:
        raise ValueError("too many rules for one expression: use rule_table")
    out = None
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == F.lit(domain)) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out if out is not None else F.lit(None).cast("string")


def judged_by_rules(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict of every page."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if len(rules) <= MAX_RULE_EXPRESSIONS:
        rows = rows.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
        verdict = F.lit(None).cast("string")
        for rule, v in reversed(list(dict(reversed(list(rules))).items())):
            verdict = F.when(F.col("rule") == rule, F.lit(v)).otherwise(verdict)
        return rows.withColumn("rule_verdict", verdict)
    # Many rules: each host meets the rules of its own suffixes, by an equality join on the domain.
    table = rows.sparkSession.createDataFrame([(r.partition("/")[0], "".join(r.partition("/")[1:]), r, v, i) for i, (r, v) in enumerate(rules)], "domain string, prefix string, rule string, rule_verdict string, place int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("host", "path").distinct().withColumn("domain", F.explode(suffixes))
    best = hosts.join(table, "domain").where(F.expr("startswith(path, prefix)")).groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), -F.col("place"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def _cell(labels: int) -> Column:
    """Hash cell of a row's suffix: one label, two labels, or (3) two labels and the first path segment."""
    suffix = F.substring_index("host", ".", -min(labels, 2))
    parts = [suffix, F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(2)), F.lit(""))] if labels == 3 else [suffix]
    return F.pmod(F.xxhash64(*parts, F.lit(labels)), F.lit(SUFFIX_CELLS)).cast("int")


def lexical_features(rows: DataFrame, suffixes: DataFrame, own_fold: bool = False) -> DataFrame:
    """``rows`` (url, host, path) with the columns FEATURES; with ``own_fold`` suffix shares come from the folds that the url isn't in."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    times = lambda c: (F.length(url) - F.length(F.replace(url, F.lit(c)))).cast("double")
    chars = F.array_distinct(F.split(url, ""))

    def spread(total, c):
        share = (F.length(url) - F.length(F.replace(url, c))) / size
        return total - F.when(share > 0, share * F.log2(share)).otherwise(F.lit(0.0))

    rows = rows.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"), "labels": F.size(F.split("host", r"\.")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / size, "entropy": F.aggregate(chars, F.lit(0.0), spread),
        "parameters": F.when(url.contains("?"), times("&") + 1).otherwise(F.lit(0.0)), "hyphens": times("-"), **{f"cell{k}": _cell(k) for k in (1, 2, 3)},
    })
    shorter = F.lit(0.5)
    for k in (1, 2, 3):
        table = suffixes.where(F.col("labels") == k)
        if own_fold:
            blocked, n = F.col("blocked") - F.element_at("by_fold", _fold() + 1)["blocked"], F.col("n") - F.element_at("by_fold", _fold() + 1)["n"]
        else:
            blocked, n = F.col("blocked"), F.col("n")
        table = table.select(F.col("cell").alias(f"cell{k}"), "blocked", "n", "by_fold")
        rows = rows.join(F.broadcast(table), f"cell{k}", "left").withColumn(f"suffix{k}", (F.coalesce(blocked, F.lit(0.0)) + 2 * shorter) / (F.coalesce(n, F.lit(0.0)) + 2)).drop("blocked", "n", "by_fold")
        shorter = F.col(f"suffix{k}")
    return rows


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit(5)), F.lit(FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(labels, cell, blocked, n, by_fold) over all labelled urls; at most 3 * SUFFIX_CELLS rows, each with FOLDS pairs."""
    blocked = (F.col("rule_verdict") == "block").cast("double")
    each = []
    for k in (1, 2, 3):
        of_fold = [F.struct(F.sum(F.when(_fold() == f, blocked).otherwise(0.0)).alias("blocked"), F.sum((_fold() == f).cast("double")).alias("n")) for f in range(FOLDS)]
        found = labelled.groupBy(_cell(k).alias("cell")).agg(F.sum(blocked).alias("blocked"), F.count(F.lit(1)).cast("double").alias("n"), F.array(*of_fold).alias("by_fold"))
        each.append(found.select(F.lit(k).alias("labels"), "cell", "blocked", "n", "by_fold"))
    return each[0].unionByName(each[1]).unionByName(each[2])


def _expression(node, columns: Sequence[str]) -> Column:
    """A regression tree of the JVM as nested CASE expressions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = _expression(node.leftChild(), columns), _expression(node.rightChild(), columns)
    return F.when(F.col(columns[split.featureIndex()]) <= F.lit(float(split.threshold())), left).otherwise(right)


def fitted_model(labelled: DataFrame, suffixes: DataFrame):
    """Gradient-boosted trees on FEATURES of a bounded sample; None without both classes."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = labelled.orderBy(F.xxhash64("url"), "page_id").limit(SAMPLE_ROWS)
    sample = stored(lexical_features(sample, suffixes, own_fold=True).coalesce(SAMPLE_PARTS).select(*FEATURES, (F.col("rule_verdict") == "block").cast("double").alias("label")), "sample")
    if sample.select("label").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label").cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, labelCol="label").fit(data)
    data.unpersist()
    return model


def trained_trees(labelled: DataFrame, suffixes: DataFrame) -> Column | None:
    """The boosted margin (above 0: block) as an expression of FEATURES; None without both classes."""
    model = fitted_model(labelled, suffixes)
    return None if model is None else margin_of(model)


def margin_of(model) -> Column:
    margin = F.lit(0.0)
    for weight, tree in zip(model.treeWeights, model.trees):
        margin = margin + F.lit(float(weight)) * _expression(tree._java_obj.rootNode(), FEATURES)
    return margin


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' margin of every page."""
    rows = judged_by_rules(pages, rules)
    labelled = rows.where("rule is not null and url is not null")
    suffixes = stored(suffix_statistics(labelled), "suffixes")
    margin = trained_trees(labelled, suffixes)
    if margin is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("margin"))
    full = lexical_features(rows, suffixes).withColumn("margin", F.round(margin, 9))
    verdict = F.coalesce("rule_verdict", F.when(F.col("margin") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return full.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "margin")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
