"""Mixing, URL filter, toxicity, HTML extraction and the pipeline."""

import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotloom.llm import html_extract, mixing, toxicity, url_filter
from slotloom.llm.labelled_pages import labelled_pages


# -- mixing -----------------------------------------------------------------------------------------------------------


def test_mixture_meets_targets(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    mixture, members = mixing.fit(docs, mixing.known_domains(docs, labels), mixing.TARGET_WEIGHTS)
    assert np.allclose(mixture.expected, mixture.targets, rtol=1e-5)
    rows = mixing.rates(docs, mixing.known_domains(docs, labels), mixing.TARGET_WEIGHTS).collect()
    for d, target in zip(mixture.domains, mixture.targets):
        assert np.isclose(sum(r.rate * r.tokens * r.posteriors[d] for r in rows), target, rtol=1e-5)
    # The classifier finds the language of all but a few documents.
    true = {r.doc_id: r.lang for r in docs.collect()}
    right = [max(r.posteriors, key=r.posteriors.get) == true[r.doc_id] for r in rows]
    assert np.mean(right) > 0.95


def test_rates_match_a_plain_solver(spark):
    """Soft memberships that no rates can meet exactly: the result is the constrained optimum."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.5, 0.5, 0.5], 40)
    t = rng.integers(1, 100, 40).astype(float)
    targets = np.array([t.sum() * 2, t.sum() * 0.01, t.sum() * 0.3])
    scale = np.array([(t * p[:, d] * p.sum(1)).sum() for d in range(3)])
    history, r, y = [], np.ones(40), np.ones(40)
    for k in range(20_000):
        g = ((y * t) @ p - targets) / scale
        if k < 60:
            history.append([*g.tolist(), mixing.momentum(k)])
        new = np.maximum(0, y - p @ g)
        r, y = new, new + mixing.momentum(k) * (new - r)
        first = r if k == 59 else first if k > 59 else None
    rows = spark.createDataFrame([(row.tolist(),) for row in p], "posteriors array<double>")
    got = np.array([x[0] for x in rows.select(mixing.rate(rows.posteriors, history)).collect()])
    assert np.allclose(np.sort(got), np.sort(first))
    # Karush-Kuhn-Tucker: the gradient vanishes where the rate is positive and isn't negative elsewhere.
    gradient = p @ (((r * t) @ p - targets) / scale)
    assert (np.abs(gradient[r > 1e-6]) < 1e-2).all() and (gradient[r <= 1e-6] > -1e-2).all()
    # 60 steps come close to the optimum.
    value = lambda x: ((((x * t) @ p - targets) ** 2) / scale).sum()
    assert value(first) < 0.001 * value(np.ones(40)) + 1.1 * value(r)


def test_mixing_edges(spark, odd, crowded, odd_rows, no_documents):
    labelled = spark.createDataFrame([(10, "en"), (11, "de"), (12, None), (None, "en"), (13, "xx"), (10, "en")], "doc_id long, domain string")
    assert mixing.rates(odd, labelled, {"en": 1, "de": 1}).count() == len(odd_rows)
    assert mixing.rates(no_documents, labelled, {"en": 1, "de": 1}).count() == 0
    assert {r.rate for r in mixing.rates(odd, labelled.limit(0), {"en": 1, "de": 1}).collect()} == {1.0}
    out = mixing.mixed(crowded, labelled, {"en": 1, "de": 3}, at_least=1)
    assert out.columns == crowded.columns and out.count() >= len(odd_rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_query_matches_brute_force(spark, sf_dir):
    """Features, classifier and rates on whole documents, by plain arrays."""
    from slotloom.llm import registry

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    known = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").collect()}
    texts = [(r.text or "") for r in docs]
    t = np.array([len(re.findall(r"[^ \t\n\x0b\f\r]+", x)) for x in texts], float)
    f = np.array([[x.lower().count(c) / max(len(x.lower()), 1) for c in mixing.FEATURE_CHARS] for x in texts])
    domains = sorted(mixing.TARGET_WEIGHTS)
    logs = np.full((len(docs), len(domains)), -np.inf)
    groups = [[i for i, r in enumerate(docs) if r.doc_id in known and r.lang == d and t[i] > 0] for d in domains]
    for d, at in enumerate(groups):
        mean, var = f[at].mean(0), np.maximum(f[at].var(0), mixing.VARIANCE_FLOOR)
        density = (-0.5 * ((f - mean) ** 2 / var + np.log(var))).sum(1)
        logs[:, d] = np.where(t > 0, density, 0) + np.log(len(at) / sum(map(len, groups)))
    p = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -700))
    p /= p.sum(1, keepdims=True)
    now = t @ p
    share = np.array([mixing.TARGET_WEIGHTS[d] for d in domains])
    targets = share * (now / share).max()
    scale = np.array([(t * p[:, d] * p.sum(1)).sum() for d in range(len(domains))])
    r = y = np.ones(len(docs))
    for k in range(mixing.MAX_ITERATIONS):
        if np.abs((r * t) @ p - targets).sum() <= mixing.TOLERANCE * targets.sum():
            break
        new = np.maximum(0, y - p @ (((y * t) @ p - targets) / scale))
        r, y = new, new + mixing.momentum(k) * (new - r)
    got = {x.doc_id: x for x in registry.QUERIES["op1_mixing"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, doc in enumerate(docs):
        x = got[doc.doc_id]
        assert x.tokens == t[i] and np.allclose([x[f"p_{d}"] for d in domains], p[i], atol=2e-6) and np.isclose(x.rate, r[i], atol=2e-5)
        assert x.copies in (int(np.floor(x.rate)), int(np.floor(x.rate)) + 1)


def test_unreached_targets_are_told(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "aaa bbb " * 5 if i % 2 else "zzz uuu " * 5) for i in range(20)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "doc_id long, domain string")
    mixture, _ = mixing.fit(docs, labelled, {"x": 1, "y": 5})
    assert mixture.converged and mixture.gap < 1e-6
    monkeypatch.setattr(mixing, "MAX_ITERATIONS", 0)
    with pytest.warns(UserWarning, match="mixing stopped"):
        mixture, _ = mixing.fit(docs, labelled, {"x": 1, "y": 5}, budget=10_000.0)
    assert not mixture.converged and mixture.gap > 0.01


# -- urls -------------------------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://A.Example.NET/en/1?x=://y", "https://foo.net", "https://foo.net?x", "https://xnet/", "ftp://de.example.com/de/", "https://example.com/DE/", "http://b.org/fr/#f", "http://b.org/frx", "x://net/", "a://b://c/d", "http://H:80/p;q?#"]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in url_filter.RULES:
        domain, _, tail = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


@pytest.mark.parametrize("most", [256, 1])
def test_rules(spark, most, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_RULE_EXPRESSIONS", most)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    for r in url_filter.judged_by_rules(pages, url_filter.RULES).collect():
        host, path, best = brute_rule(r.url)
        assert (r.host, r.path, r.rule, r.rule_verdict) == (host, path, *(best or (None, None))), r.url


@pytest.mark.parametrize("most", [256, 1])
def test_ties_and_bare_rules(spark, most, monkeypatch):
    """Of equally long rules the first listed wins; a rule without a slash fits every path of its host."""
    monkeypatch.setattr(url_filter, "MAX_RULE_EXPRESSIONS", most)
    rules = (("a.org/x", "block"), ("b.org/x", "allow"), ("z.a.org", "allow"), ("org/xyz", "block"), ("net", "block"), ("net", "allow"))
    urls = {"http://z.a.org/xyz": "a.org/x", "http://a.org/xyz": "a.org/x", "http://q.net": "net", "http://net/": "net", "http://z.a.org/q": "z.a.org", "http://a.com/": None}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in url_filter.judged_by_rules(pages, rules).collect():
        assert (r.rule, r.rule_verdict) == (urls[r.url], dict(reversed(rules)).get(urls[r.url])), r.url


def plain_features(url, host, path, shares):
    from collections import Counter

    n = max(len(url), 1)
    entropy = sum(-c / n * math.log2(c / n) for c in Counter(url).values())
    return [len(url), len(host), len(path), len([x for x in path.split("/") if x]), len(host.split(".")), sum("0" <= c <= "9" for c in url) / n, entropy, url.count("&") + 1 if "?" in url else 0, url.count("-"), *shares]


def test_verdicts_match_brute_force(spark, sf_dir):
    """Features by plain Python, the trees by the library's own prediction."""
    from pyspark.ml.linalg import Vectors

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = url_filter.judged_by_rules(pages, url_filter.RULES)
    labelled = rows.where("rule is not null")
    suffixes = url_filter.suffix_statistics(labelled)
    model = url_filter.fitted_model(labelled, suffixes)
    known = [(r.url, *brute_rule(r.url)) for r in pages.collect()]
    counts = {}
    key = lambda host, path, k: (k, ".".join(host.split(".")[-min(k, 2) :]), (path.split("/") + ["", ""])[1] if k == 3 else "")
    for _, host, path, best in known:
        if best:
            for k in (1, 2, 3):
                blocked, n = counts.get(key(host, path, k), (0, 0))
                counts[key(host, path, k)] = blocked + (best[1] == "block"), n + 1
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    features = {r.page_id: r for r in url_filter.lexical_features(rows, suffixes).collect()}
    for r in pages.collect():
        host, path, best = brute_rule(r.url)
        shares, shorter = [], 0.5
        for k in (1, 2, 3):
            blocked, n = counts.get(key(host, path, k), (0, 0))
            shorter = (blocked + 2 * shorter) / (n + 2)
            shares.append(shorter)
        want = plain_features(r.url or "", host, path, shares)
        assert np.allclose([features[r.page_id][c] for c in url_filter.FEATURES], want), r.url
        margin = sum(w * t.predict(Vectors.dense(want)) for w, t in zip(model.treeWeights, model.trees))
        assert np.isclose(got[r.page_id].margin, margin, atol=1e-6)
        assert got[r.page_id].verdict == (best[1] if best else "block" if margin > 0 else "allow")


def test_sample_rows_do_not_see_their_own_label(spark, monkeypatch):
    """Suffixes that occur once, each in a cell of its own, say nothing about their own row."""
    monkeypatch.setattr(url_filter, "SUFFIX_CELLS", 1 << 24)
    rows = spark.createDataFrame([(i, f"http://h.d{i}/", f"h.d{i}", "/", "block" if i % 2 else "allow") for i in range(40)], "page_id long, url string, host string, path string, rule_verdict string")
    suffixes = url_filter.suffix_statistics(rows)
    own = url_filter.lexical_features(rows, suffixes, own_fold=True).collect()
    seen = url_filter.lexical_features(rows, suffixes).collect()
    assert {r.suffix3 for r in own} == {0.5} and all((r.suffix3 > 0.5) == (r.rule_verdict == "block") for r in seen)


def test_url_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = url_filter.judge(pages)
    got = {r.page_id: r for r in found.collect()}
    for r in pages.collect():
        host, path, best = brute_rule(r.url)
        row = got[r.page_id]
        assert (row.host, row.path, row.rule) == (host, path, best and best[0])
        assert row.verdict == (best[1] if best else "block" if row.margin > 0 else "allow")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_trees_learn_held_out_urls(spark, sf_dir):
    """Urls with a rule whose page_id is odd are learned, the even ones are judged by the trees alone."""
    folder = os.path.dirname(sf_dir.rstrip("/"))
    rows = url_filter.judged_by_rules(spark.read.parquet(f"{folder}/sf0.1/pages.parquet"), url_filter.RULES).where("rule is not null")
    learned = rows.where("page_id % 2 = 1")
    suffixes = url_filter.suffix_statistics(learned)
    margin = url_filter.trained_trees(learned, suffixes)
    judged = url_filter.lexical_features(rows.where("page_id % 2 = 0"), suffixes).select((margin > 0).alias("block"), (rows.rule_verdict == "block").alias("true")).collect()
    assert np.mean([r.block == r.true for r in judged]) >= 0.95


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x"), (None, None, "y")], "page_id long, url string, host string")
    assert {r.verdict for r in url_filter.judge(pages).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0)).count() == 0


# -- toxicity ---------------------------------------------------------------------------------------------------------


def toxic_tables(spark, n=1200):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 6))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(20, 120)))
        toxic = i % 7 == 0
        if toxic:
            for at in rng.integers(0, len(text), 3):
                text[at] = rng.choice(["vile", "nasty", "foul"])
        docs.append((i, " ".join(text), "x"))
        if i % 3:
            labels.append((i, int(toxic), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), {i: i % 7 == 0 for i in range(n)}


def test_toxicity_held_out(spark):
    docs, labels, true = toxic_tables(spark)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == true[r.doc_id] for r in held]) > 0.97
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows)


def test_continuation_counts_match_brute_force(spark):
    docs, labels, _ = toxic_tables(spark, 60)
    known = toxicity.label_map(labels)
    marked = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 > 1)
    counts = toxicity.continuation_counts(docs.select(F.xxhash64("doc_id").alias("key"), "text"), spark.sparkContext.broadcast(known))
    pairs = {(r.toxic, a, b) for r in marked.collect() for a, b in zip(["<s>", *r.text.split()], r.text.split())}
    assert counts.sum() == len(pairs) and counts[1].sum() == sum(p[0] == 1 for p in pairs)


def test_every_label_is_counted_per_word(spark, monkeypatch):
    docs, labels, _ = toxic_tables(spark, 60)
    rows = docs.select(F.xxhash64("doc_id").alias("key"), "text")
    whole = toxicity.toxicity_scores(docs, labels).orderBy("doc_id").collect()
    monkeypatch.setattr(toxicity, "BLOCK_LABELS", 10)
    sent = toxicity.sent_labels(labels)
    assert len(sent) > 2
    marked = docs.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 > 1).collect()
    pairs = {(r.toxic, a, b) for r in marked for a, b in zip(["<s>", *r.text.split()], r.text.split())}
    assert toxicity.continuation_counts(rows, *sent).sum() == len(pairs)
    assert toxicity.toxicity_scores(docs, labels).orderBy("doc_id").collect() == whole
    # More words than cells of any fixed size would keep apart.
    many = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(200)), int(i % 7 == 0)) for i in range(60)], "doc_id long, text string, toxic int")
    counts = toxicity.continuation_counts(many.select(F.xxhash64("doc_id").alias("key"), "text"), *toxicity.sent_labels(many))
    assert counts.shape[1] == counts.sum() == 200 * many.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 > 1).count()


class PlainModels:
    """Both classes' interpolated models from dictionaries, as the module's docstring states them."""

    def __init__(self, rows, slack, spread):
        from collections import defaultdict

        words, pairs, self.slack, self.spread = (set(), set()), (set(), set()), slack, spread
        for text, toxic in rows:
            seen = ["", "", *self.split(text)]
            for second, first, word in zip(seen, seen[1:], seen[2:]):
                words[toxic].add((first, word))
                pairs[toxic].add((second, first, word))
        self.word, self.pair, self.of = ([defaultdict(int) for _ in range(2)] for _ in range(3))
        for k in (0, 1):
            for _, w in words[k]:
                self.word[k][w] += 1
            for _, u, w in pairs[k]:
                self.pair[k][u, w] += 1
                self.of[k][u] += 1
        self.n = [len(x) for x in words]
        self.spare = [1 - sum(self.kept_word(w, k) for w in self.word[k]) / self.n[k] for k in (0, 1)]
        self.kept_after = [defaultdict(float), defaultdict(float)]
        for k in (0, 1):
            for u, w in self.pair[k]:
                self.kept_after[k][u] += self.kept_pair(u, w, k)

    @staticmethod
    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())

    def left(self, count, discount, expected):
        return max(count - discount - self.slack * expected - self.spread * expected**0.5, 0)

    def kept_word(self, w, k):
        return self.left(self.word[k][w], toxicity.DISCOUNT, (self.word[0][w] + self.word[1][w]) * self.n[k] / sum(self.n))

    def kept_pair(self, u, w, k):
        both = self.of[0][u] + self.of[1][u]
        return self.left(self.pair[k][u, w], toxicity.PAIR_DISCOUNT, (self.pair[0][u, w] + self.pair[1][u, w]) * self.of[k][u] / both) if both else 0

    def log_p(self, u, w, k):
        shared = (self.word[0][w] + self.word[1][w]) / sum(self.n)
        if not shared:  # in no model: the backoff's share alone counts
            return np.log(self.spare[k]) + (np.log(1 - self.kept_after[k][u] / self.of[k][u]) if self.of[k][u] else 0)
        p = self.kept_word(w, k) / self.n[k] + self.spare[k] * shared
        if self.of[k][u]:
            p = self.kept_pair(u, w, k) / self.of[k][u] + (1 - self.kept_after[k][u] / self.of[k][u]) * p
        return np.log(p)

    def ratio(self, text):
        words = self.split(text)
        steps = [self.log_p(u, w, 1) - self.log_p(u, w, 0) for u, w in zip(["", *words], words)]
        return np.mean(steps) if steps else np.log(self.spare[1] / self.spare[0])


def paired_tables(spark):
    """Two words that are toxic only one after the other, in documents of their own words."""
    docs, labels, true = toxic_tables(spark, 700)
    own = lambda start, end: F.concat(F.lit(f" {start}"), F.col("doc_id").cast("string"), F.lit(f" {end} "))
    text = F.when(F.col("doc_id") % 14 == 0, F.concat(own("p", "get lost"), "text")).otherwise(F.concat(own("p", "get it"), "text", own("q", "was lost")))
    return docs.withColumn("text", text), labels, true


def test_scores_match_brute_force(spark):
    docs, labels, _ = paired_tables(spark)
    rows, toxic = docs.collect(), {r.doc_id: r.toxic for r in labels.collect()}
    fold = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5
    learned = [(r.text, toxic[r.doc_id]) for r in rows if r.doc_id in toxic and fold(r) > 1]
    model = toxicity.fit(docs, labels)
    assert len(model.pairs) and len(model.words)
    found = [(d, PlainModels(learned, *d)) for d in toxicity.DISCOUNTS]
    ratios = {d: np.array([m.ratio(r.text) for r in rows]) for d, m in found}
    import pyarrow as pa

    from slotloom.llm.words import buffers

    got = model.ratio(*buffers(pa.array([r.text for r in rows])))
    chosen = [d for d, x in ratios.items() if np.allclose(x, got, atol=1e-6)]
    assert chosen
    # No other threshold and no other discount makes fewer errors on the rows that set it.
    checks = [i for i, r in enumerate(rows) if fold(r) == 1 and r.doc_id in toxic]
    y = np.array([toxic[rows[i].doc_id] for i in checks])
    errors = lambda x, at: int(((x >= at) != y).sum())
    least = min(errors(x[checks], at) for x in ratios.values() for at in [*x[checks], np.inf])
    assert errors(got[checks], model.threshold) <= least + 1
    scores = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    for r, x in zip(rows, ratios[chosen[0]]):
        want = 1 / (1 + np.exp(-np.clip((x - model.threshold) / model.scale, -500, 500)))
        assert np.isclose(scores[r.doc_id].score, want, atol=1e-4) and scores[r.doc_id].predicted == int(scores[r.doc_id].score >= 0.5)


def test_toxicity_query_on_held_out_documents(spark, sf_dir):
    folder = f"{os.path.dirname(sf_dir.rstrip('/'))}/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    held = toxicity.op3_toxicity(spark, folder).where("held_out").join(labels, "doc_id").toPandas()
    rank = held["score"].rank()
    n = held["toxic"].sum()
    area = (rank[held["toxic"] == 1].sum() - n * (n + 1) / 2) / (n * (len(held) - n))
    assert area >= 0.8 and ((held["predicted"] == 1) & (held["toxic"] == 0)).sum() == 0


def test_one_class_or_none_scores_nothing(spark):
    docs, labels, _ = toxic_tables(spark, 60)
    assert {(r.score, r.predicted) for r in toxicity.toxicity_scores(docs, labels.withColumn("toxic", F.lit(1))).collect()} == {(0.0, 0)}
    # Only one class among the rows that set the threshold.
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    lonely = labels.where((fold != 1) | (F.col("toxic") == 0))
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(docs, lonely).collect())


def test_toxicity_edges(spark, odd, crowded, odd_rows, no_documents):
    labels = spark.createDataFrame([(10, 1, 1), (11, 0, 1), (12, None, 1), (None, 1, 1), (10, 0, 0)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity_scores(crowded, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity_scores(no_documents, labels).count() == 0


# -- html -------------------------------------------------------------------------------------------------------------


def test_blocks():
    page = "<p>a<br>b &amp; c&nbsp;d<p>e<script>x<p></script><!-- <p> --><ul><li>f<li>g <b>h</b></ul>i</p><div title='a>b'>j</div>&lt;k"
    assert [t for _, t, _ in html_extract.leaf_blocks(page)] == ["a b & c d", "e", "f", "g h", "i", "j", "<k"]
    assert html_extract.leaf_blocks("") == [] and html_extract.leaf_blocks("<p") == []
    assert [t for _, t, _ in html_extract.leaf_blocks("<div class='x" + "<p>y" * 3)] == ["y"] * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><title-bar>T</title-bar><p>One.</p><p>Two.</p></article>", ["T", "One.", "Two."]), ("<p>Zero.</p><svg class='i'/><p>One.</p>", ["Zero.", "One."]), ("<p>A</p><object-card><p>B</p></object-card>", ["A", "B"]),
        ("<p>A</p><select><option>x<p>B</p>", ["A", "x", "B"]), ("<p>A</p><svg><p>B</p>", ["A", "B"]), ("<p>A</p><svg><text>q</text><svg>r</svg>s</svg><p>B</p>", ["A", "B"]), ("<p>A</p><noscript>x</noscript><p>B", ["A", "B"]),
        ("<p>A<!-->B<!-- x -->C", ["ABC"]), ("<script>a<p>x</script ><p>B", ["B"]), ("<style><p>x", []), ("<p>A<template>t<template>u</template>v</template>B<object>o<p>C", ["ABo", "C"]), ("<p>A</svg>B<textarea>t</textarea>C", ["AB C"]),
    ],
)
def test_elements_that_swallow_nothing(page, want):
    assert [t for _, t, _ in html_extract.leaf_blocks(page)] == want


def test_many_unclosed_elements_take_linear_time():
    import time

    began = time.time()
    assert [t for _, t, _ in html_extract.leaf_blocks("<svg>" * 100_000 + "<p>A")] == ["A"]
    assert time.time() - began < 5


def test_field_on_held_out_layouts():
    model, wrong, total = html_extract.trained(), 0, 0
    for page in labelled_pages(80, seed=9):
        blocks = html_extract.leaf_blocks(page)
        marked = [(p, t[1:] or "x", n) for p, t, n in blocks]
        for (_, t, _), y in zip(blocks, model.decode(marked)):
            if t[0] in "\ue000\ue001":
                total += 1
                wrong += (ord(t[0]) - 0xE000) != y
    assert wrong < 0.01 * total


def test_viterbi_is_the_best_labelling():
    from itertools import product

    model = html_extract.trained()
    blocks = html_extract.leaf_blocks(labelled_pages(1, seed=3)[0])[:9]
    e = [model.emission(html_extract.path_features(p)) + model.emission(html_extract.text_features(t, n)) for p, t, n in blocks]

    def score(ys):
        return model.start[ys[0]] + sum(x * y for x, y in zip(e, ys)) + sum(model.moves[a, b] for a, b in zip(ys, ys[1:]))

    assert np.isclose(score(model.decode(blocks)), max(score(ys) for ys in product((0, 1), repeat=len(blocks))))


def test_pages(spark, sf_dir):
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extracted(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        parts = [" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside[1])] if inside else []
        want = "\n".join(p for p in parts if p)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_other_layouts(spark):
    page = "<body><header><h2>Site</h2></header><nav><a href=x>Menu</a></nav><aside>More <p>things to see today.</p></aside><article><h1>Title</h1><p>First.</p><div class='advert'>Buy this.</div><p>Second one.</p></article><div class='cookie-notice'>We use cookies.</div><form><label>Name</label></form><section class='comments'><p>Nice read, thank you!</p></section><footer>(c) us</footer>"
    rows = spark.createDataFrame([(1, "u", page), (None, None, None), (2, "v", "")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extracted(rows).collect()} == {1: "Title\nFirst.\nSecond one.", None: "", 2: ""}


def plain_text(html):
    """The text of blocks, tag by tag, of an article without boilerplate."""
    from html import unescape

    blocks, text = [], ""
    for piece in re.findall(r"<[^>]*>|[^<]+", html):
        if piece[0] != "<":
            text += unescape(piece)
        elif re.match(r"</?(p|h[1-6]|li|ul|ol|div|section|table|tr|td|th|blockquote|pre|dl|dt|dd|figure|figcaption)\b", piece):
            blocks.append(text)
            text = ""
        elif re.match(r"<br\b", piece):
            text += " "
    return "\n".join(" ".join(b.split()) for b in [*blocks, text] if b.split())


ARTICLES = (
    "<h1>On tables</h1><p>Here is a table of the years.</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>Nineteen hundred and one was good.</td><td>12 of them were left.</td></tr></table><p>That was the table.</p>",
    "<h2>Lists</h2><ul><li>The first thing to say is long.</li><li>The second thing has <b>bold</b> words.</li></ul><ol><li>One more point is made here.</li></ol><p>And that is all of it.</p>",
    "<div><div><p>Nested divisions hold this text.</p><div>And this one stands in another.</div></div></div><blockquote><p>A quotation that goes on for a while.</p></blockquote>",
    "<p>Einstein wrote <math><mi>E</mi><mo>=</mo><mi>mc</mi><msup>2</msup></math> in that paper.</p><p>An <svg><text>inline drawing</text></svg> has words of its own.</p>",
    "<object><p>This paragraph stands in an object element.</p></object><noscript><p>This one is for those without scripts.</p></noscript><p>The last one is plain text.</p>",
    "<p>AT&am<b>p;</b> isn't a reference, &lt;b&gt; and &amp;amp; are.</p><p>Caf&eacute;&nbsp;au lait &#8212; it costs &#x20AC;5,<br>at least here.</p><pre>keep   these words\n  together</pre>",
    "<dl><dt>A term that is explained here</dt><dd>Its explanation comes right behind it.</dd></dl><figure><figcaption>What the picture shows to us.</figcaption></figure><p>It ends here, at last.</p>",
)


@pytest.mark.parametrize("frame", ["<body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{}</article><footer>(c) us</footer></body>", "<html><body><div class='header'>Site</div><main><div class='content'>{}</div></main><aside><p>More to see.</p></aside></body></html>"])
def test_whole_articles_stay(spark, frame):
    """Everything inside of the article, whatever elements it is in."""
    rows = spark.createDataFrame([(i, "u", frame.format(a)) for i, a in enumerate(ARTICLES)] * 2, "page_id int, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = html_extract.extracted(rows).collect()
    assert len(got) == 2 * len(ARTICLES)
    for r in got:
        assert (r.text, r.n_chars) == (plain_text(ARTICLES[r.page_id]), len(plain_text(ARTICLES[r.page_id])))


def test_a_very_long_page(spark):
    paragraphs = [f"Paragraph number {i} says something of its own." for i in range(20_000)]
    html = "<body><nav><a href=x>Menu</a></nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body>"
    assert html_extract.extracted(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).first().text == "\n".join(paragraphs)


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    from slotloom.llm.decontaminate import contamination
    from slotloom.llm.near_dedup import near_duplicates
    from slotloom.llm.shared import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    clean = stored(corpus_pipeline.toxicity(spark, docs, sf_dir), "t1")
    assert ids(clean) == ids(toxicity.toxicity_scores(docs, labels).where("predicted = 0")) and clean.columns == docs.columns
    apart = stored(corpus_pipeline.near_duplicates(spark, clean, sf_dir), "t2")
    assert ids(apart) == ids(near_duplicates(clean, 5, (80, 100)).where("kept")) and apart.columns == docs.columns
    fair = stored(corpus_pipeline.decontamination(spark, apart, sf_dir), "t3")
    assert ids(fair) == ids(contamination(apart, benchmark).where("not contaminated"))
    mixed = stored(corpus_pipeline.mixing(spark, fair, sf_dir), "t4")
    assert set(ids(mixed)) == set(ids(fair)) and mixed.columns == docs.columns
    result = corpus_pipeline.run(spark, sf_dir, f"file://{tmp_path}/tokens").collect()
    assert sorted(r.doc_id for r in result) == ids(mixed)
    # The files stay in the folder that was given, and hold the texts of what is left.
    from slotloom.llm.token_files import ShardReader, encoder, tokenizer_file

    tokenizer = encoder(tokenizer_file()).tokenizer
    texts = {r.doc_id: r.text for r in fair.collect()}
    found = []
    for path in sorted(tmp_path.glob("tokens/*.sltb")):
        shard = ShardReader(f"file://{path}")
        for i in range(shard.n_docs):
            found.append(shard.doc_ids[i].as_py())
            assert shard.document(i).tolist() == [*tokenizer.encode(texts[found[-1]] or "", add_special_tokens=False).ids, 0]
    assert sorted(found) == ids(mixed)
    # Expected tokens of the drawn copies by language are near the weights.
    tokens = {r.lang: r.n for r in mixed.groupBy("lang").agg(F.sum(mixing.token_count(F.col("text"))).alias("n")).collect()}
    share = {k: n / sum(tokens.values()) for k, n in tokens.items()}
    assert all(abs(share[k] - w) < 0.08 for k, w in mixing.TARGET_WEIGHTS.items())


def test_pipeline_edges(spark, odd, crowded, no_documents, tmp_path):
    """Null and empty texts, repeated rows, clashing columns, and empty tables pass all five stages."""
    import corpus_pipeline

    benchmark, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, (docs, count) in {"none": (no_documents, 0), "odd": (odd, None), "crowded": (crowded, None)}.items():
        folder = f"file://{tmp_path}/{name}"
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
            df.write.option("mergeSchema", "true").parquet(f"{folder}/{table}.parquet")
        read = spark.read.parquet(f"{folder}/documents.parquet")
        for i, (stage, run) in enumerate(corpus_pipeline.STAGES):
            run(spark, read, folder).write.parquet(f"{folder}/stage{i}")
            out = spark.read.parquet(f"{folder}/stage{i}")
            if stage != "tokens":
                assert out.columns == docs.columns
            read = out
        kept = {r.doc_id for r in read.collect()}
        assert (read.count() == 0) if count == 0 else {1, 2, 3, 4, 5, 20} <= kept and not kept & {21, 22, 23, 24, 25}
