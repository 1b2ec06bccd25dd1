"""Toxicity by class-conditional Kneser-Ney models.

Both label classes have an interpolated model of word pairs

    P(w | u, class) = kept(u, w, class) / N(u, class) + spare(u, class) * P(w | class)
    P(w | class)    = kept(w, class) / N(class)       + spare(class)    * P_shared(w)

and one backoff P_shared that both classes share.  Counts are continuation counts,
as Kneser-Ney takes them: a word's is the number of different words before it, a
pair's the number of different words before the pair, so copies and repeated lines
don't inflate them; N are their sums, and spare is what the discount takes.  A
document's score compares its length-normalised log-likelihoods under both classes.

The discount is ``DISCOUNT`` (for pairs ``PAIR_DISCOUNT``: what follows up to two words
only is a rare expression) plus what the counts of both classes together make one expect
in the class (a slack times, and a spread in standard deviations).  So rare expressions and
those which both classes use alike come from the shared counts, and a class keeps what is
peculiar to it.  With a constant discount the noise of rare words drowns the rest (README
has the figures).  Slack and spread are those of ``DISCOUNTS`` with the fewest errors on the
rows that set the threshold.

Every labelled row is learned from.  Labels are broadcast in blocks of about
``BLOCK_LABELS`` rows, and the documents are read once per block, so no text is
shuffled; words of all blocks are counted together.  Counts are held per word and pair (by
hashes of ``WORD_BITS`` bits a word) however many there are; only words and pairs that are
peculiar to a class reach the driver and the scoring, as all others have the ratio of their
backoff.  Rows with crc32(doc_id) mod 5 = 0 are never learned from; those
with remainder 1 set the threshold, the others are counted.

Defined results: null and word-less texts get the score of a text without any
peculiar word; labels without a doc_id or a class are ignored, of several labels
of a doc_id the larger counts; without both classes in the training rows every
score is 0; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotloom.llm.shared import even_keys, mapped, partitions, planned_bytes, send, stored
from slotloom.llm.words import ALNUM, U64, chunks, mix, scan, settled, text_column, tidy, word_hashes

WORD_BITS = 32
DISCOUNT, PAIR_DISCOUNT = 0.75, 2.75
#: (slack, spread)
DISCOUNTS = ((3.0, 4.0), (2.0, 3.0), (1.5, 2.0), (2.0, 1.0))
BINS = 10_000
#: Labels of a broadcast, about 10 bytes each.
BLOCK_LABELS = 4_000_000
COUNT_BLOCKS = 64
BLOCK_WORDS = 1_000_000
_START = U64(0x5851F42D4C957F2D)
_LOW = U64((1 << WORD_BITS) - 1)
#: A counted pair: its words' keys, its counts in both classes, and those of its first word.
PAIR = np.dtype([("first", "<u4"), ("word", "<u4"), ("n", "<i8", 2), ("of", "<i8", 2)])
TRIPLE = np.dtype([("pair", "<u8"), ("before", "<u4")])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, key of WORD_BITS bits, document) of each word."""
    starts, ends, doc = scan(data, offsets, ALNUM)
    hashed = word_hashes(data, starts, ends, True)
    return hashed, (hashed >> U64(64 - WORD_BITS)).astype(np.uint32), doc


def _before(hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The word before each; a mark at the start of a document."""
    out = np.empty_like(hashed)
    out[:1], out[1:] = _START, hashed[:-1]
    out[np.flatnonzero(np.diff(doc, prepend=-1))] = _START
    return out


def _key(hashed: np.ndarray) -> np.ndarray:
    return hashed >> U64(64 - WORD_BITS)


def _distinct(triples: np.ndarray) -> np.ndarray:
    order = np.lexsort((triples["before"], triples["pair"]))
    triples = triples[order]
    new = np.ones(len(triples), bool)
    new[1:] = triples[1:] != triples[:-1]
    return triples[new]


def counted_words(rows: DataFrame, labels_sent: list) -> DataFrame:
    """Continuation counts of words (``block`` from 0 on) and peculiar pairs (``block`` -1), by class and range.

    ``rows``: (key, text); ``labels_sent``: broadcast LabelMaps; only rows with a label of
    the learned folds are read.
    """
    spark = rows.sparkSession
    n_parts = max(2 * partitions(spark), planned_bytes(rows) // (32 << 20))
    keys = even_keys(spark, 2 * int(n_parts))
    parts = len(keys) // 2
    of_pairs = np.sort(keys[parts:])

    def split(found: np.ndarray, by: np.ndarray, numbers: np.ndarray, toxic: int) -> list[tuple]:
        """Rows of what is sorted by its 32-bit number ``by``, for ranges of it."""
        edges = np.searchsorted((by * U64(parts)) >> U64(32), np.arange(parts + 1))
        return [(int(numbers[p]), toxic, found[edges[p] : edges[p + 1]].tobytes()) for p in np.flatnonzero(np.diff(edges)).tolist()]

    def words_of(sent):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {0: [], 1: []}

            def flush(toxic: int):
                hashed, before, second = (np.concatenate([h[i] for h in held[toxic]]) for i in range(3))
                held[toxic].clear()
                # A pair is its hash with the word's key in the low bits; ranges go by what is above, so words of a range are mixed.
                pairs = np.unique((mix(hashed * U64(3) + before) & ~_LOW) | _key(hashed))
                triples = np.empty(len(hashed), TRIPLE)
                triples["pair"], triples["before"] = (_key(before) << U64(32)) | _key(hashed), _key(second)
                triples = _distinct(triples)
                rows = split(pairs, pairs >> U64(32), keys[:parts], toxic) + split(triples, triples["pair"] >> U64(32), keys[parts:], toxic)
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["part", "toxic", "found"])

            for batch in batches:
                toxic, fold = sent.value.find(np.asarray(batch.column(0)))
                learned = (toxic >= 0) & (fold > 1)
                batch, toxic = batch.filter(pa.array(learned)), toxic[learned]
                for lo, _, data, offsets in chunks(text_column(batch.column(1))):
                    hashed, _, doc = _words(data, offsets)
                    if not len(doc):
                        continue
                    before = _before(hashed, doc)
                    second = _before(before, doc)
                    for k in (0, 1):
                        at = toxic[lo + doc] == k
                        held[k].append((hashed[at], before[at], second[at]))
                for k in (0, 1):
                    if sum(len(h[0]) for h in held[k]) >= BLOCK_WORDS:
                        yield flush(k)
            for k in (0, 1):
                if sum(len(h[0]) for h in held[k]):
                    yield flush(k)

        return run

    @settled
    def count(group: pd.DataFrame) -> pd.DataFrame:
        part, rows = group["part"].iloc[0], []
        by_class = [b"".join(group["found"][group["toxic"] == k]) for k in (0, 1)]
        if of_pairs[min(np.searchsorted(of_pairs, part), len(of_pairs) - 1)] == part:
            rows.append((-1, 0, _peculiar_pairs([_distinct(np.frombuffer(b, TRIPLE)) for b in by_class]).tobytes(), b""))
        else:
            for toxic, raw in enumerate(by_class):
                word, n = np.unique((np.unique(np.frombuffer(raw, U64)) & _LOW).astype(np.uint32), return_counts=True)
                edges = np.searchsorted((word.astype(np.int64) * COUNT_BLOCKS) >> WORD_BITS, np.arange(COUNT_BLOCKS + 1))
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    at = slice(edges[b], edges[b + 1])
                    rows.append((b, toxic, word[at].tobytes(), n[at].astype(np.int32).tobytes()))
        return pd.DataFrame(rows, columns=["block", "toxic", "words", "counts"])

    counted = None
    for sent in labels_sent:
        found = rows.select("key", "text").mapInArrow(words_of(sent), "part int, toxic int, found binary")
        counted = found if counted is None else counted.unionByName(found)
    return counted.groupBy("part").applyInPandas(count, "block int, toxic int, words binary, counts binary")


def _peculiar_pairs(triples: list[np.ndarray]) -> np.ndarray:
    """Of a range of first words, the pairs of which some discount leaves something, from both classes' distinct triples."""
    of = [np.unique(t["pair"], return_counts=True) for t in triples]
    pairs = np.unique(np.concatenate([p for p, _ in of]))
    out = np.zeros(len(pairs), PAIR)
    for k, (p, n) in enumerate(of):
        out["n"][np.searchsorted(pairs, p), k] = n
    out["first"], out["word"] = (pairs >> U64(32)).astype(np.uint32), (pairs & _LOW).astype(np.uint32)
    if len(out):
        starts = np.flatnonzero(np.append(True, out["first"][1:] != out["first"][:-1]))
        out["of"] = np.repeat(np.add.reduceat(out["n"], starts), np.diff(np.append(starts, len(out))), axis=0)
    return out[np.any([kept_pairs(out, *d).any(0) for d in DISCOUNTS], axis=0)]


def kept_pairs(pairs: np.ndarray, slack: float, spread: float) -> np.ndarray:
    """What the discount leaves of the pairs' counts: (2, pairs)."""
    n, of = pairs["n"].T.astype(float), pairs["of"].T.astype(float)
    expected = n.sum(0) * of / np.maximum(of.sum(0), 1)
    return np.maximum(n - PAIR_DISCOUNT - slack * expected - spread * np.sqrt(expected), 0)


def word_counts(counted: DataFrame) -> DataFrame:
    """Counts of words by ranges of them: (words, ordinary, toxic as arrays' bytes, n_ordinary, n_toxic)."""

    @settled
    def total(group: pd.DataFrame) -> pd.DataFrame:
        of, n = np.frombuffer(b"".join(group["words"]), np.uint32), np.frombuffer(b"".join(group["counts"]), np.int32)
        toxic = np.repeat(group["toxic"].to_numpy(), [len(w) // 4 for w in group["words"]])
        words, at = np.unique(of, return_inverse=True)
        sums = [np.bincount(at[toxic == k], n[toxic == k], len(words)).astype(np.int64) for k in (0, 1)]
        return pd.DataFrame({"words": [words.tobytes()], "ordinary": [sums[0].tobytes()], "toxic": [sums[1].tobytes()], "n_ordinary": [int(sums[0].sum())], "n_toxic": [int(sums[1].sum())]})

    return counted.where("block >= 0").groupBy("block").applyInPandas(total, "words binary, ordinary binary, toxic binary, n_ordinary long, n_toxic long")


def _gathered(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(words in order, their counts (2, words)) of a table of word_counts."""
    found = counted.select("words", "ordinary", "toxic").collect()
    words = np.frombuffer(b"".join(r.words for r in found), np.uint32)
    counts = np.stack([np.frombuffer(b"".join(r[k] for r in found), np.int64) for k in ("ordinary", "toxic")])
    order = np.argsort(words)
    return words[order], counts[:, order]


def continuation_counts(rows: DataFrame, *labels_sent) -> np.ndarray:
    """How many different words each word follows, per class: an array (2, words)."""
    return _gathered(word_counts(counted_words(rows, list(labels_sent))))[1]


def kept_counts(counts: np.ndarray, n: np.ndarray, slack: float, spread: float) -> np.ndarray:
    """What the discount leaves of the counts; ``n``: all pairs of each class."""
    expected = counts.sum(0) * (n / n.sum())[:, None]
    return np.maximum(counts - DISCOUNT - slack * expected - spread * np.sqrt(expected), 0)


def peculiar(counted: DataFrame, n: np.ndarray, also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words in order, counts) of the words of which some discount leaves something, and of the words ``also``."""
    wanted = np.unique(also)

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            for r in group.itertuples():
                words, counts = np.frombuffer(r.words, np.uint32), np.stack([np.frombuffer(r.ordinary, np.int64), np.frombuffer(r.toxic, np.int64)])
                some = np.any([kept_counts(counts, n, *d).any(0) for d in DISCOUNTS], axis=0) | np.isin(words, wanted)
                yield pd.DataFrame({"words": [words[some].tobytes()], "ordinary": [counts[0, some].tobytes()], "toxic": [counts[1, some].tobytes()]})

    return _gathered(counted.select("words", "ordinary", "toxic").mapInPandas(run, "words binary, ordinary binary, toxic binary"))


def log_ratios(words: np.ndarray, counts: np.ndarray, n: np.ndarray, pairs: np.ndarray, slack: float, spread: float) -> dict:
    """Logarithms of P(toxic) / P(ordinary): of words, of pairs, of the backoff after a first word, and of any other word."""
    kept, p_shared = kept_counts(counts, n, slack, spread), counts.sum(0) / n.sum()
    spares = 1 - kept.sum(1) / n
    p_word = kept / n[:, None] + spares[:, None] * p_shared
    some = kept.any(0)
    logs = np.log(p_word[:, some])
    left = kept_pairs(pairs, slack, spread)
    pairs, left = pairs[left.any(0)], left[:, left.any(0)]
    share = left / np.maximum(pairs["of"].T, 1)
    firsts, which = np.unique(pairs["first"], return_inverse=True)
    spare = np.maximum(1 - np.stack([np.bincount(which, x, len(firsts)) for x in share]), 1e-12)
    both = share + spare[:, which] * p_word[:, np.searchsorted(words, pairs["word"])]
    named = (pairs["first"].astype(U64) << U64(32)) | pairs["word"].astype(U64)
    order = np.argsort(named)
    return {
        "words": words[some], "ratios": (logs[1] - logs[0]).astype(np.float32), "neutral": float(np.log(spares[1] / spares[0])),
        "pairs": named[order], "pair_ratios": np.log(both[1] / both[0])[order].astype(np.float32), "firsts": firsts, "first_ratios": np.log(spare[1] / spare[0]).astype(np.float32),
    }


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, otherwise) -> np.ndarray:
    if not len(known):
        return np.broadcast_to(otherwise, len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], otherwise)


class ToxicityModel(NamedTuple):
    words: np.ndarray | None
    ratios: np.ndarray | None = None
    neutral: float = 0.0
    pairs: np.ndarray | None = None
    pair_ratios: np.ndarray | None = None
    firsts: np.ndarray | None = None
    first_ratios: np.ndarray | None = None
    threshold: float = 0.0
    scale: float = 1.0

    def ratio(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The length-normalised log-likelihood ratio of each document."""
        n = len(offsets) - 1
        if self.ratios is None:
            return np.zeros(n)
        hashed, word, doc = _words(data, offsets)
        ratios = _looked_up(word, self.words, self.ratios, self.neutral)
        if len(self.pairs):
            first = _key(_before(hashed, doc))
            backoff = ratios + _looked_up(first.astype(np.uint32), self.firsts, self.first_ratios, np.float32(0))
            ratios = _looked_up((first << U64(32)) | word.astype(U64), self.pairs, self.pair_ratios, backoff)
        words = np.bincount(doc, minlength=n)
        return np.where(words > 0, np.bincount(doc, ratios, n) / np.maximum(words, 1), self.neutral)

    def score(self, ratio: np.ndarray) -> np.ndarray:
        if self.ratios is None:
            return np.zeros(len(ratio))
        return 1 / (1 + np.exp(-np.clip((ratio - self.threshold) / self.scale, -500, 500)))


def _remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


class LabelMap:
    """Label and fold of labelled rows by the hash of their doc_id, as sorted arrays."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, fold: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.toxic, self.fold = keys[order], toxic[order].astype(np.int8), fold[order].astype(np.int8)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label or -1, fold or 0) of each key."""
        if not len(self.keys):
            return np.full(len(keys), -1), np.zeros(len(keys), int)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.toxic[at], -1).astype(int), np.where(known, self.fold[at], 0).astype(int)


def _learnable(labels: DataFrame) -> DataFrame:
    """doc_id, key, toxic and fold of the labelled rows that may be learned from."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return marked.select("doc_id", F.xxhash64("doc_id").alias("key"), "toxic", _remainder(F.col("doc_id")).cast("int").alias("fold")).where("fold <> 0")


def label_map(labels: DataFrame, block: int = 0, blocks: int = 1) -> LabelMap:
    """The labelled rows that may be learned from; of ``blocks`` parts by hash of doc_id one."""
    marked = _learnable(labels)
    if blocks > 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(blocks)) == block)
    rows = marked.select("key", "toxic", "fold").toArrow()
    return LabelMap(*[np.asarray(rows[c].combine_chunks() if hasattr(rows[c], "combine_chunks") else rows[c]) for c in ("key", "toxic", "fold")])


def sent_labels(labels: DataFrame) -> list:
    """All labelled rows that may be learned from, as broadcast LabelMaps of about BLOCK_LABELS rows."""
    blocks = max(1, -(-_learnable(labels).count() // BLOCK_LABELS))
    return [send(labels.sparkSession, label_map(labels, b, blocks)) for b in range(blocks)]


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Counts the training rows of ``docs`` (doc_id, text) and sets the threshold on those with remainder 1."""
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id").alias("key"), "text")
    marked = sent_labels(labels)
    found = stored(counted_words(rows, marked), "counted")
    counted = stored(word_counts(found), "word-counts")
    n = np.array(counted.agg(F.coalesce(F.sum("n_ordinary"), F.lit(0)), F.coalesce(F.sum("n_toxic"), F.lit(0))).first(), np.int64)
    if (n == 0).any():
        return ToxicityModel(None)
    pairs = np.frombuffer(b"".join(r.words for r in found.where("block < 0").select("words").collect()), PAIR)
    words, counts = peculiar(counted, n, pairs["word"])
    models = [ToxicityModel(**log_ratios(words, counts, n, pairs, *d)) for d in DISCOUNTS]
    sent = send(spark, models)
    names = [f"r{i}" for i in range(len(models))]

    def checks_of(known):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                toxic, fold = known.value.find(np.asarray(batch.column(0)))
                checks = (toxic >= 0) & (fold == 1)
                batch, toxic = batch.filter(pa.array(checks)), toxic[checks]
                for lo, hi, data, offsets in chunks(text_column(batch.column(1))):
                    found = [pa.array(m.ratio(data, offsets)) for m in sent.value]
                    yield pa.RecordBatch.from_arrays([pa.array(toxic[lo:hi].astype(np.int32)), *found], ["toxic", *names])

        return run

    checked = None
    for known in marked:
        found = rows.mapInArrow(checks_of(known), "toxic int, " + ", ".join(f"{r} double" for r in names))
        checked = found if checked is None else checked.unionByName(found)
    checked = stored(checked, "checked")
    for known in marked:
        known.destroy()
    sent.destroy()
    found = [_threshold(checked.select("toxic", F.col(n).alias("ratio")), m) for n, m in zip(names, models)]
    return min(found, key=lambda x: x[0])[1]


def _threshold(checked: DataFrame, model: ToxicityModel) -> tuple[float, ToxicityModel]:
    """(errors, the model with threshold and scale) from (toxic, ratio); a histogram of BINS bins is all the driver sees."""
    spread = checked.agg(F.min("ratio").alias("lo"), F.max("ratio").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("toxic").alias("a"), F.max("toxic").alias("b")).first()
    if not spread.n or spread.a == spread.b:
        high = float(model.ratios.max(initial=model.neutral))
        return 0.0, model._replace(threshold=model.neutral + 0.05 * (high - model.neutral), scale=max(1e-6, 0.01 * (high - model.neutral)))
    lo, width = spread.lo, max(1e-9, (spread.hi - spread.lo) / BINS)
    bins = checked.groupBy(F.least(F.floor((F.col("ratio") - lo) / width), F.lit(BINS - 1)).cast("int").alias("bin"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.zeros((2, BINS + 1))
    for r in bins:
        n[r.toxic, r.bin] += r.n
    # Errors if everything from bin k on counts as toxic: toxic rows below it, ordinary rows from it on.
    wrong = np.concatenate([[0], np.cumsum(n[1])[:-1]]) + n[0][::-1].cumsum()[::-1]
    best = np.flatnonzero(wrong == wrong.min())
    widest = max(np.split(best, np.flatnonzero(np.diff(best) > 1) + 1), key=len)
    centre = np.arange(BINS + 1) + 0.5
    means = [(n[k] * centre).sum() / n[k].sum() for k in (0, 1)]
    # Inside the widest gap, a third of the way from the ordinary side.
    at = widest[0] + (widest[-1] - widest[0]) / 3
    return float(wrong.min()), model._replace(threshold=lo + at * width, scale=max(1e-9, abs(means[1] - means[0]) * width / 8))


def _scored(model, text_at: int, names: list[str], keep_clean: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.score(model.value.ratio(data, offsets)) for _, _, data, offsets in chunks(text_column(batch.column(text_at)))]
            score = np.concatenate(found) if found else np.zeros(0)
            if keep_clean:
                yield batch.filter(pa.array(score < 0.5))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names)

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = send(docs.sparkSession, fit(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(_remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    names = ["doc_id", "held_out", "score", "predicted"]
    return rows.mapInArrow(_scored(model, 1, names, False), f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted to be toxic, all columns kept."""
    model = send(docs.sparkSession, fit(docs, labels))
    return mapped(docs, _scored(model, docs.columns.index("text"), [], True), docs.columns)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
