"""Mixing sources to target weights by soft membership, with DataFrame expressions only.

A labelled table says which documents' domains are known.  A Gaussian naive Bayes
classifier over letter frequencies (closed-form: one grouped aggregate over all
labelled rows) gives every document posteriors over the domains.  Nonnegative
document rates r then solve

    min over r >= 0 of  sum over domains d of (sum_i r_i t_i p_id - T_d)^2 / s_d

(t tokens, p posteriors, T target tokens, s_d = sum_i,e t_i p_id p_ie), by
projected gradient steps preconditioned with 1/t_i, for which step 1 is safe.
A step of document i needs the D residuals only: r_i <- max(0, r_i - p_i . g).  So
each iteration is one aggregate of D sums over a small table, and the rate of a
document is a fold over the residuals of all iterations; nothing is shuffled or
checkpointed between them.

``Mixture.gap`` is the share of the target tokens that the rates miss; it isn't 0 where the
memberships can't meet the targets, or if the iterations end first (``converged`` is false
then, and a warning says so).  The domains of the registered query are languages: a source
can't be told from a text, a language can, and posteriors need what a text shows.

Defined results: null or empty texts have no tokens, the prior as posterior, and a
rate like any other; unknown or null domains in labelled rows are ignored; a domain
without labelled rows gets no membership; domains with no weight aim at zero tokens;
an empty table gives no rows; without labelled rows all rates are 1; columns of the
input pass through in ``mixed``, whatever their names.
"""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import quoted, stored, unused

#: Characters whose frequencies are the classifier's features.
FEATURE_CHARS = ("a", "c", "d", "e", "h", "i", "n", "o", "q", "s", "t", "u", "w", "z", "é", "è", "ä", "ü", "ó", "ñ")
MAX_ITERATIONS, TOLERANCE, STALL = 60, 1e-7, 1e-9
VARIANCE_FLOOR = 1e-5
#: Target shares of expected tokens by domain (language), as used by the query.
TARGET_WEIGHTS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


class Mixture(NamedTuple):
    """What was fitted: per domain prior, means and variances, targets, and the residuals of all iterations."""

    domains: list[str]
    stats: list[tuple[float, list[float], list[float]]]
    targets: list[float]
    history: list[list[float]]
    expected: list[float]
    converged: bool = True

    @property
    def gap(self) -> float:
        return sum(abs(n - x) for n, x in zip(self.expected, self.targets)) / (sum(self.targets) or 1.0)


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def feature_array(text: Column) -> Column:
    """Relative frequencies of the feature characters; the text is lower-cased once."""

    def shares(x):
        return F.array(*[(x["n"] - F.length(F.replace(x["low"], F.lit(c)))) / F.greatest(x["n"], F.lit(1)).cast("double") for c in FEATURE_CHARS])

    low = F.lower(F.coalesce(text, F.lit("")))
    return _let(low, lambda t: _let(F.struct(t.alias("low"), F.length(t).alias("n")), shares))


def posterior_array(features: Column, tokens: Column, stats) -> Column:
    """Posteriors by Bayes' rule; rows without tokens have the prior."""

    def log_shares(x):
        logs = []
        for prior, mean, var in stats:
            if prior <= 0:
                logs.append(F.lit(-1e300))
                continue
            terms = [F.pow(x["f"][k] - F.lit(m), 2) * F.lit(-0.5 / v) for k, (m, v) in enumerate(zip(mean, var))]
            total = terms[0]
            for t in terms[1:]:
                total = total + t
            logs.append(F.when(x["n"] > 0, total + F.lit(-0.5 * sum(math.log(v) for v in var))).otherwise(F.lit(0.0)) + F.lit(math.log(prior)))
        return F.array(*logs)

    def scaled(logs):
        return _let(F.array_max(logs), lambda top: F.transform(logs, lambda x: F.when(x > F.lit(-1e299), F.exp(F.greatest(x - top, F.lit(-700.0)))).otherwise(F.lit(0.0))))

    def normalised(shares):
        return _let(F.aggregate(shares, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(shares, lambda x: x / total))

    return _let(F.struct(features.alias("f"), tokens.alias("n")), lambda x: _let(log_shares(x), lambda logs: _let(scaled(logs), normalised)))


def _folded(posteriors: Column, history: list[list[float]], field: str) -> Column:
    """``r`` or ``y`` after all iterations; an iteration is its residuals, then its momentum."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in history])
    n = len(history[0]) - 1

    def fold(p):
        def step(s, g):
            dot = p[0] * g[0]
            for k in range(1, n):
                dot = dot + p[k] * g[k]
            moved = F.greatest(F.lit(0.0), s["y"] - dot)
            return _let(moved, lambda r: F.struct(r.alias("r"), (r + g[n] * (r - s["r"])).alias("y")))

        return F.aggregate(steps, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), step, lambda s: s[field])

    return _let(posteriors, fold)


def rate(posteriors: Column, history: list[list[float]]) -> Column:
    """The document's rate after all iterations."""
    return _folded(posteriors, history, "r")


def momentum(k: int) -> float:
    return k / (k + 3.0)


def _classifier(featured: DataFrame, labelled: DataFrame, domains: list[str]):
    """(prior, means, variances) per domain from all labelled rows (doc_id, domain)."""
    rows = featured.join(labelled.where(F.col("domain").isin(*domains)).dropDuplicates(["doc_id", "domain"]), "doc_id").where("tokens > 0")
    each = range(len(FEATURE_CHARS))
    aggregates = [F.avg(F.col("features")[k]).alias(f"m{k}") for k in each] + [F.var_pop(F.col("features")[k]).alias(f"v{k}") for k in each]
    found = {r.domain: r for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *aggregates).collect()}
    total = sum(r.n for r in found.values())
    if not total:
        return None
    blank = (0.0, [0.0] * len(FEATURE_CHARS), [1.0] * len(FEATURE_CHARS))
    return [(found[d].n / total, [found[d][f"m{k}"] for k in each], [max(VARIANCE_FLOOR, found[d][f"v{k}"]) for k in each]) if d in found else blank for d in domains]


def fit(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None) -> tuple[Mixture, DataFrame]:
    """The mixture, and (doc_id, tokens, posteriors) of all documents.

    ``budget``: target tokens in all; None takes the least at which no domain has to shrink.
    """
    domains = sorted(weights)
    size = len(domains)
    featured = stored(docs.select("doc_id", token_count(F.col("text")).alias("tokens"), feature_array(F.col("text")).alias("features")), "features")
    stats = _classifier(featured, labelled, domains)
    if stats is None:
        return Mixture(domains, [], [], [], []), featured.select("doc_id", "tokens", F.array(*[F.lit(1.0 / size)] * size).alias("posteriors"))
    members = stored(featured.select("doc_id", "tokens", posterior_array(F.col("features"), F.col("tokens"), stats).alias("posteriors")), "members")
    p, t = F.col("posteriors"), F.col("tokens")
    first = members.agg(*[F.sum(t * p[d]).alias(f"t{d}") for d in range(size)], *[F.sum(t * p[d] * p[e]).alias(f"s{d}_{e}") for d in range(size) for e in range(d, size)]).first()
    now = [float(first[f"t{d}"] or 0) for d in range(size)]
    scale = [sum(float(first[f"s{min(d, e)}_{max(d, e)}"] or 0) for e in range(size)) or 1.0 for d in range(size)]
    share = [weights[d] / (sum(weights.values()) or 1) for d in domains]
    if budget is None:
        budget = max((n / s for n, s in zip(now, share) if s > 0), default=0.0)
    targets = [s * budget for s in share]
    history: list[list[float]] = []
    at, before, converged = now, math.inf, False
    for k in range(MAX_ITERATIONS + 1):
        value = sum((n - x) ** 2 / s for n, x, s in zip(now, targets, scale))
        converged = sum(abs(n - x) for n, x in zip(now, targets)) <= TOLERANCE * max(budget, 1) or 0 <= before - value <= STALL * value
        if converged or k == MAX_ITERATIONS:
            break
        before = value
        history.append([(n - x) / s for n, x, s in zip(at, targets, scale)] + [momentum(k)])
        moved = members.select("tokens", "posteriors", _folded(p, history, "r").alias("r"), _folded(p, history, "y").alias("y"))
        sums = moved.agg(*[F.sum(F.col(v) * t * p[d]).alias(f"{v}{d}") for v in "ry" for d in range(size)]).first()
        now, at = ([float(sums[f"{v}{d}"] or 0) for d in range(size)] for v in "ry")
    mixture = Mixture(domains, stats, targets, history, now, converged)
    if not converged:
        warnings.warn(f"mixing stopped after {MAX_ITERATIONS} iterations, {mixture.gap:.2g} of the target tokens away", stacklevel=2)
    return mixture, members


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None) -> DataFrame:
    """doc_id, tokens, posteriors (map of domain to share) and rate of every document."""
    mixture, members = fit(docs, labelled, weights, budget)
    named = F.map_from_arrays(F.array(*[F.lit(d) for d in mixture.domains]), F.col("posteriors"))
    rated = members.withColumn("rate", rate(F.col("posteriors"), mixture.history))
    return rated.select("doc_id", "tokens", named.alias("posteriors"), "rate")


def copies(doc_id: Column, rate_of: Column, seed: int = 0, at_least: int = 0) -> Column:
    """Whole copies with the rate as their mean: the fraction is drawn by a hash of doc_id."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return F.greatest(F.lit(at_least), F.floor(rate_of + draw).cast("int"))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], budget: float | None = None, seed: int = 0, at_least: int = 0) -> DataFrame:
    """``docs`` with each row as often as its rate says, all columns kept.

    The rates are expressions over the text, so the documents themselves are never shuffled.
    """
    mixture, _ = fit(docs, labelled, weights, budget)
    if not mixture.history:
        return docs
    tokens, features, posteriors, times, copy = unused(docs.columns, "tokens", "features", "posteriors", "copies", "copy")
    rows = docs.withColumns({tokens: token_count(F.col("text")), features: feature_array(F.col("text"))})
    rows = rows.withColumn(posteriors, posterior_array(F.col(features), F.col(tokens), mixture.stats))
    rows = rows.withColumn(times, copies(F.col("doc_id"), rate(F.col(posteriors), mixture.history), seed, at_least))
    return rows.select(*quoted(docs.columns), F.explode(F.array_repeat(F.lit(1), F.col(times))).alias(copy)).drop(copy)


def known_domains(docs: DataFrame, labels: DataFrame, column: str = "lang") -> DataFrame:
    """(doc_id, domain) of the documents that the labelled table lists."""
    return docs.select("doc_id", F.col(column).alias("domain")).join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = rates(docs, known_domains(docs, labels), TARGET_WEIGHTS)
    shares = [F.round(F.col("posteriors")[d], 6).alias(f"p_{d}") for d in sorted(TARGET_WEIGHTS)]
    return found.select("doc_id", "tokens", *shares, F.round("rate", 6).alias("rate"), copies(F.col("doc_id"), F.col("rate")).alias("copies"))
