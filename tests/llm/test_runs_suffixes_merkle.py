"""Periodic runs, suffix-array deduplication and the Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotloom.llm import merkle, periodic_runs, suffix_dedup
from slotloom.llm.words import NON_SPACE, scan
from tests.llm.conftest import SCHEMA
from tests.llm.test_text_operators import SPACED, key, rows, sha

# -- periodic runs ----------------------------------------------------------------------------------------------------


def brute_runs(w):
    """(start, length, period) of all runs, by looking at every period from every place."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q) and not any(all(w[x] == w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.add((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def folded(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def reported(doc_id, text, fold=True):
    w = SPACED.findall(text or "")
    w = folded(w, doc_id) if fold else w
    found = brute_runs(w)
    gone = {i for s, x, q in found for i in range(s + q, s + x)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    exponent = 1000 * best[1] // best[2] if found else None
    return doc_id, len(found), *best, exponent, sha("".join(f"{s},{x},{q}\n" for s, x, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


REPORTED = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic_rows():
    r = random.Random(7)
    out = [(None, "a b " * 20), (1, None), (2, ""), (3, " \n\t"), (4, "x " * 11), (5, "x " * 12), (6, "x " * 13), (7, "a b c d e f g " * 2), (8, "a b c d e f " * 2 + "a"), (9, "ä b " * 9 + "end"), (9, "ä b " * 9 + "end")]
    out += [(i, " ".join(r.choice("abc" if i % 3 else "abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 90)))) for i in range(20, 110)]
    out.append((200, " ".join(("one two three four five six seven eight nine ten " * 3 + str(i)) for i in range(4))))
    return [(i, t, "en", "src0", 0) for i, t in out]


def test_runs_of_texts(spark, no_documents):
    plain = periodic_rows()
    df = spark.createDataFrame(plain, SCHEMA).repartition(3)
    assert rows(periodic_runs.run_report(df, fold=True), *REPORTED) == sorted((reported(i, t) for i, t, *_ in plain), key=key)
    listed = Counter(tuple(r) for r in periodic_runs.runs(df).collect())
    assert listed == Counter((i, *run) for i, t, *_ in plain for run in brute_runs(SPACED.findall(t or "")))
    assert periodic_runs.run_report(no_documents, True).count() == 0 and periodic_runs.runs(no_documents).count() == 0


def test_collapsed_texts(spark, crowded, odd_rows, no_documents):
    cleaned = periodic_runs.collapse_runs(crowded)
    assert cleaned.columns == crowded.columns and cleaned.count() == len(odd_rows)
    by_id = {r.doc_id: r.text for r in cleaned.collect()}
    assert by_id[71] == "loop" and by_id[1] is None and by_id[3] == "  \n\t " and by_id[5] == "two words"
    assert periodic_runs.collapse_runs(no_documents).count() == 0


@pytest.mark.parametrize(("block", "levels"), [(5, 24), (100, 3), (1 << 18, 24)])
def test_runs_of_random_words(block, levels, monkeypatch):
    """Small blocks and few levels give the same."""
    monkeypatch.setattr(periodic_runs, "BLOCK", block)
    monkeypatch.setattr(periodic_runs, "LEVELS", levels)
    r = random.Random(block)
    for _ in range(60):
        docs = []
        for _ in range(r.randint(1, 4)):
            k, n = r.choice([1, 2, 3, 40]), r.randint(0, 110)
            w = [r.randrange(k) for _ in range(n)]
            if n > 20 and r.random() < 0.6:
                p, a = r.randint(1, 20), r.randrange(n)
                w[a:] = [w[a + (i - a) % p] for i in range(a, n)]
            docs.append(w)
        texts = [" ".join(f"w{x}" for x in w).encode() for w in docs]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        starts, ends, doc = scan(data, offsets, NON_SPACE)
        own, *found = periodic_runs.find_runs(periodic_runs.word_numbers(data, starts, ends, doc), doc, len(docs))
        for i, w in enumerate(docs):
            assert [tuple(map(int, run)) for o, *run in zip(own, *found) if o == i] == brute_runs(w)


def test_runs_of_a_very_long_text():
    """Half a million words: a run from end to end, and few candidates elsewhere."""
    words = ["w%d" % (i % 1000) for i in range(250_000)] + ["v%d" % i for i in range(250_000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, doc = scan(data, np.array([0, len(data)]), NON_SPACE)
    found = periodic_runs.find_runs(periodic_runs.word_numbers(data, starts, ends, doc), doc, 1)
    assert [tuple(int(x) for x in f) for f in zip(*found)] == [(0, 0, 250_000, 1000)]


def test_query_on_whole_documents(spark, sf_dir):
    got = {r.doc_id: tuple(r[c] for c in REPORTED) for r in periodic_runs.op11_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert set(got) == {r.doc_id for r in docs}
    for r in docs:
        if len((r.text or "").split()) < 400:  # the brute force is cubic
            assert got[r.doc_id] == reported(r.doc_id, r.text)


# -- suffix arrays ----------------------------------------------------------------------------------------------------


def brute_bytes(plain, length):
    texts = [(t or "").encode() for _, t, *_ in plain]
    counts = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(plain, texts):
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(gone[k] and not gone[k - 1] for k in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def shared_lines(odd_rows):
    """Odd documents, and many that share one line between texts of their own."""
    r = random.Random(5)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 6)))
    line = " ".join(word("abcdefgö") for _ in range(40))
    own = lambda: " ".join(word("xyzuvw") for _ in range(r.randint(0, 90)))
    return [*odd_rows, *((100 + i, own() + line + own(), "en", "src0", 0) for i in range(40)), (300, "\0" * 450, "en", "src0", 0), (301, "ab" * 300, "en", "src0", 0)]


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize(("length", "frequent", "shard"), [(200, 2000, None), (40, 3, None), (200, 5, 200_000)])
def test_repeated_bytes(spark, odd_rows, length, frequent, shard, monkeypatch):
    """Also with shards of a few texts, and with all frequent anchors dealt by window."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "SHARD", shard or suffix_dedup.SHARD)
    plain = shared_lines(odd_rows)
    df = spark.createDataFrame(plain, SCHEMA).repartition(5)
    assert rows(suffix_dedup.byte_report(df, length), *BYTES) == brute_bytes(plain, length)


def test_repeated_bytes_edges(crowded, odd_rows, no_documents):
    assert suffix_dedup.byte_report(no_documents).count() == 0
    cleaned = suffix_dedup.remove_repeated_bytes(crowded)
    assert cleaned.columns == crowded.columns and cleaned.count() == len(odd_rows)
    other = lambda df: sorted((tuple(r[c] for c in df.columns if c != "text") for r in df.collect()), key=str)
    assert other(cleaned) == other(crowded)
    by_id = {r.doc_id: r.text for r in cleaned.collect()}
    assert by_id[1] is None and by_id[5] == "two words" and len(by_id[10]) < 40


def test_suffix_arrays(monkeypatch):
    r = random.Random(3)
    for n in range(120):
        k = r.choice([1, 2, 4, 200])
        t = bytes(r.randrange(k) + (0 if n % 3 else 47) for _ in range(r.randint(1, 300)))
        t = (t + t[: len(t) // 2] + t if n % 4 == 0 else t) + b"\xff"
        sa, rank = suffix_dedup.suffix_array(np.frombuffer(t, np.uint8))
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert sa.tolist() == want and all(rank[i] == p + 1 for p, i in enumerate(want))
        monkeypatch.setattr(suffix_dedup, "LANES", r.choice([1, 3, 64]))

        def common(a, b, t=t):
            return next((x for x in range(20) if t[a + x : a + x + 1] != t[b + x : b + x + 1] or max(a, b) + x >= len(t)), 20)

        assert suffix_dedup.common_prefixes(np.frombuffer(t, np.uint8), sa, 20).tolist() == [0, *(common(a, b) for a, b in zip(want, want[1:]))]


def test_long_texts_come_in_pieces(monkeypatch):
    """Every window once, with its place, whatever the pieces are."""
    monkeypatch.setattr(suffix_dedup, "PIECE", 50)
    r = random.Random(1)
    texts = ["".join(r.choice("abö") for _ in range(n)) for n in (0, 3, 30, 49, 50, 51, 200, 333, 12)]
    got = Counter()
    for data, starts, own, place in suffix_dedup._pieces(pa.array(texts), 20):
        got.update((int(o), int(p), data[s : s + 20].tobytes()) for s, o, p in zip(starts, own, place))
    raw = [t.encode() for t in texts]
    assert got == Counter((i, p, b[p : p + 20]) for i, b in enumerate(raw) for p in range(len(b) - 19))


def test_sorted_lists_merge_by_binary_search():
    rng = np.random.default_rng(0)
    strings = rng.integers(97, 100, (500, 6)).astype(np.uint8).view("S6").reshape(-1)
    lists = [part[np.argsort(strings[part], kind="stable")] for part in np.array_split(rng.permutation(500), 7)]
    order = suffix_dedup._merged(strings, lists)
    assert sorted(order.tolist()) == list(range(500)) and (strings[order] == np.sort(strings)).all()


# -- Merkle manifest --------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes, fanout):
    """(root, the steps of every leaf as (before, after))."""
    steps, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(of):
            low = at - at % fanout
            steps[leaf].append((nodes[low:at], nodes[at + 1 : low + fanout]))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        of = [at // fanout for at in of]
    return nodes[0], steps


def brute_manifest(plain, fanout=16):
    by_source = defaultdict(list)
    for row in plain:
        by_source[row[3]].append((row, leaf_of(row, row[1])))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    below = {s: tree([leaf for _, leaf in by_source[s]], fanout) for s in order}
    root, above = tree([below[s][0] for s in order], fanout)
    out = []
    for n, s in enumerate(order):
        for (row, leaf), own in zip(by_source[s], below[s][1]):
            steps = own + above[n]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None
            at = leaf_of(row, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1])) if changed else leaf
            for before, after in steps:
                at = H(*before, at, *after)
            out.append((row[0], leaf, below[s][0], root, H(*(x for before, after in steps for x in (*before, *after))), at, at == root))
    return sorted(out, key=key)


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sourced(n, sources):
    """Rows with null, odd and unequal sources, null columns, repeated ids and repeated rows."""
    r = random.Random(n)
    out = [(None if i % 17 == 3 else i // 2 if i % 5 == 0 else i, None if i % 7 == 0 else f"Text {i % 40} Äö" * (i % 3), None if i % 11 == 0 else "en", sources[min(int(r.expovariate(1)), len(sources) - 1)], None if i % 13 == 0 else i) for i in range(n)]
    return [*out, *out[:3]]


@pytest.mark.parametrize(("n", "sources", "fanout"), [(120, [None, "", "b", "a", "ä", "Z"], 16), (90, ["a", None], 2), (20, [f"s{i}" for i in range(20)], 3), (1, ["only"], 16), (40, ["one"], 16)])
def test_manifest(spark, n, sources, fanout):
    plain = sourced(n, sources)
    plain = plain[:1] if n == 1 else plain
    df = spark.createDataFrame(plain, SCHEMA).repartition(3)
    assert rows(merkle.verified_manifest(df, fanout=fanout), *PROOF) == brute_manifest(plain, fanout)


def test_manifest_edges(crowded, odd, odd_rows, no_documents):
    assert merkle.verified_manifest(no_documents).count() == 0 and merkle.manifest(no_documents).count() == 0
    assert rows(merkle.verified_manifest(crowded.withColumns({c: F.lit(1) for c in ("tree", "index", "n", "leaf", "proof", "other_leaf", "root")})), *PROOF) == brute_manifest(odd_rows)


def test_a_changed_row_no_longer_folds_to_the_root(spark):
    plain = [(i, f"t{i}", "en", f"s{i % 3}", i) for i in range(50)]
    found = merkle.manifest(spark.createDataFrame(plain, SCHEMA))
    got = found.select("root", merkle.folded(F.col("leaf"), F.col("proof")).alias("right"), merkle.folded(F.lit("0" * 64), F.col("proof")).alias("wrong")).collect()
    assert all(r.right == r.root != r.wrong for r in got) and len({r.root for r in got}) == 1


def test_manifest_stays_in_the_jvm(spark, sf_dir):
    plan = merkle.op13_merkle_manifest(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_siblings_are_asked_for_by_few(spark):
    nodes = spark.createDataFrame([("t", i, 40) for i in range(40)], "tree string, index long, n long")
    asked = merkle.sibling_coordinates(nodes).groupBy("index").count().collect()
    assert len(asked) == 40 and max(r["count"] for r in asked) == 15
