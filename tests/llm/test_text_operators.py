"""Deduplication, decontamination, personal data and token files against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from slotloom.llm import decontaminate, exact_dedup, near_dedup, pii, registry, substring_dedup, token_files
from tests.compare import assert_same

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
key = lambda r: tuple((x is None, x) for x in r)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, registry.QUERIES[name], registry.SQL[name])


# -- exact ------------------------------------------------------------------------------------------------------------


def test_exact(odd, odd_rows, crowded, no_documents):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[(t or "").translate(FOLD)].append(i)
    want = []
    for i, t, *_ in odd_rows:
        text = (t or "").translate(FOLD)
        ids = [x for x in groups[text] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[text]), i == keep, sha(text)))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(exact_dedup.exact_duplicates(odd), *columns) == sorted(want, key=key)
    assert exact_dedup.exact_duplicates(crowded).count() == len(odd_rows)
    assert exact_dedup.exact_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_texts_with_one_digest_are_told_apart(odd, odd_rows, digest_bytes):
    """With digests of one byte nearly all groups hold different texts."""
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(exact_dedup.exact_duplicates(odd, digest_bytes), *columns) == rows(exact_dedup.exact_duplicates(odd), *columns)


def test_drop_exact_duplicates(spark, crowded, odd_rows, no_documents):
    docs = spark.createDataFrame([(1, "a", "p"), (1, "b", "q"), (2, "A", "r"), (None, "c", "s"), (None, "C", "s"), (3, None, "t"), (9, "", "u"), (9, "", "u"), (4, "d", "v")], "doc_id long, text string, norm string")
    got = sorted(((r.doc_id, (r.text or "").lower(), r.norm) for r in exact_dedup.drop_exact_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, "b", "q"), (2, "a", "r"), (None, "c", "s"), (9, "", "u"), (4, "d", "v")], key=str)
    kept = exact_dedup.drop_exact_duplicates(crowded)
    assert kept.columns == crowded.columns
    texts = Counter((t or "").translate(FOLD) for _, t, *_ in odd_rows)
    assert Counter((r.text or "").translate(FOLD) for r in kept.collect()) == dict.fromkeys(texts, 1)
    assert exact_dedup.drop_exact_duplicates(no_documents).count() == 0


def test_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << 63, 500).astype(np.uint64) << np.uint64(1) for _ in range(4)]
    parts[1][:50] = parts[0][:50]
    build = exact_dedup.CountingQuotientFilter.build
    whole = build(np.concatenate(parts))
    merged = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.from_bytes(build(p).to_bytes()) for p in parts])
    assert (merged.fingerprints() == whole.fingerprints()).all() and (merged.counts == whole.counts).all()
    sliced = exact_dedup.CountingQuotientFilter.merge([s for _, s in whole.slices(7)])
    assert (sliced.fingerprints() == whole.fingerprints()).all()
    assert Counter(np.concatenate(parts).tolist()) == dict(zip(whole.fingerprints().tolist(), whole.counts.tolist()))


def test_only_suspects_are_read_with_their_texts(spark, odd, odd_rows):
    """Rows whose fingerprint occurs once don't get as far as a shuffle of texts, whether tables are broadcast or not."""
    from slotloom.llm.keyfilter import sent_filter

    texts = [(t or "").translate(FOLD) for _, t, *_ in odd_rows]
    repeated = [t for t, n in Counter(texts).items() if n > 1]
    keys = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little", signed=True) for t in repeated]
    run = exact_dedup._digests(True, 32, sent_filter(spark.createDataFrame([(k,) for k in keys], "fp long")))
    got = odd.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, sha binary, full binary, norm binary")
    assert Counter(bytes(r.norm).decode() for r in got.collect()) == {t: n for t, n in Counter(texts).items() if n > 1}
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    want = rows(exact_dedup.exact_duplicates(odd), *columns)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = exact_dedup.exact_duplicates(odd)
        assert rows(found, *columns) == want
        assert "norm" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_filters_merge_run_by_run():
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 50, n).astype(np.uint64)) for n in (0, 1, 30, 40, 7)]
    merged = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.build(x) for x in lists])
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist())) == Counter(np.concatenate(lists).tolist())
    assert len(exact_dedup.CountingQuotientFilter.merge([]).fingerprints()) == 0


# -- substrings -------------------------------------------------------------------------------------------------------


def brute_substrings(odd_rows, length):
    words = [SPACED.findall(t or "") for _, t, *_ in odd_rows]
    counts = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (i, *_), w in zip(odd_rows, words):
        gone = set()
        for k in range(len(w) - length + 1):
            if counts[tuple(w[k : k + length])] > 1:
                gone |= set(range(k, k + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), sha(" ".join(kept))))
    return sorted(out, key=key)


@pytest.mark.parametrize("length", [35, 5])
@pytest.mark.parametrize("block", [1_500_000, 300])
def test_substrings(odd, odd_rows, length, block, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", block)
    got = rows(substring_dedup.substring_report(odd, length), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substrings(odd_rows, length)


def test_substring_edges(crowded, odd, odd_rows, no_documents):
    assert substring_dedup.substring_report(no_documents).count() == 0
    cleaned = substring_dedup.remove_repeated_spans(crowded)
    assert cleaned.columns == crowded.columns and cleaned.count() == len(odd_rows)
    by_id = {r.doc_id: r.text for r in cleaned.collect()}
    assert by_id[1] is None and by_id[5] == "two words" and len(by_id[10].split()) == 3


def test_equal_hashes_with_other_tails_differ():
    hashes, tails = np.array([7, 7, 7, 5, 7], np.uint64), np.array([1, 2, 1, 1, 3], np.uint8)
    again, first, _ = substring_dedup._repeats(hashes, tails)
    assert again.tolist() == [True, False, True, False, False] and first.tolist() == [True, True, False, True, True]
    assert substring_dedup._known(hashes, tails, np.array([7, 7], np.uint64), np.array([3, 2], np.uint8)).tolist() == [False, True, False, False, True]


def test_clashing_columns_stay(crowded):
    columns = lambda df: sorted((tuple(r[c] for c in df.columns if c != "text") for r in df.collect()), key=str)
    assert columns(substring_dedup.remove_repeated_spans(crowded)) == columns(crowded)
    for kept in (near_dedup.drop_near_duplicates(crowded), exact_dedup.drop_exact_duplicates(crowded)):
        assert kept.columns == crowded.columns and set(columns(kept)) <= set(columns(crowded))


def test_parts_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    from slotloom.llm.shared import even_keys

    keys = even_keys(spark, 30)
    assert len(keys) == len(set(keys.tolist())) == 32
    rows = spark.createDataFrame([(int(k),) for k in keys], "k int")
    found = rows.select(F.pmod(F.hash("k"), F.lit(4)).alias("p")).groupBy("p").count().collect()
    assert {r["count"] for r in found} == {8} and len(found) == 4


def test_key_filter_grows_and_misses_nothing(spark, monkeypatch):
    from slotloom.llm import keyfilter

    assert keyfilter.bits_for(10) == 1 << 24 and keyfilter.bits_for(4_000_000) == 1 << 25 and keyfilter.bits_for(10**12) == 1 << 29
    monkeypatch.setattr(keyfilter, "LEAST_BITS", 1 << 12)
    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 2000)
    bits = keyfilter.key_filter(spark.createDataFrame([(int(k),) for k in keys[:1000]], "k long"))
    assert len(bits) * 8 == 1 << 13 and keyfilter.among(bits, keys[:1000]).all() and keyfilter.among(bits, keys[1000:]).mean() < 0.2


def test_packed_places_round_trip():
    keys, place = np.array([5, 5, 5, 9, 9], np.int64), np.array([0, 300, 700_000, 4, 5])
    first = substring_dedup._starts(keys, place)
    row = substring_dedup._pack(1, np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.uint8), keys[first], first, place)
    named = type("Row", (), dict(zip(("part", "hashes", "tails", "keys", "runs", "more", "low", "high"), row)))
    k, x = substring_dedup._unpack(named)
    assert (k == keys).all() and (x == place).all() and len(np.frombuffer(named.hashes, np.uint64)) == len(named.tails) == 5


# -- near duplicates --------------------------------------------------------------------------------------------------


def brute_components(odd_rows):
    sets = []
    for _, t, *_ in odd_rows:
        w = SPACED.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and sets[j] and 100 * k >= 85 * (len(a) + len(sets[j]) - k):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for n, (i, *_) in enumerate(odd_rows):
        ids = [odd_rows[m][0] for m in range(len(group)) if group[m] == group[n] and odd_rows[m][0] is not None]
        least = (min(ids) if ids else None) if sets[n] else i
        out.append((i, len(sets[n]), least, i == least))
    return sorted(out, key=key)


@pytest.mark.parametrize("block", [700, 2])
def test_near(odd, odd_rows, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", block)
    monkeypatch.setattr(near_dedup, "CROSS_CLASSES", block)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    got = rows(near_dedup.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components(odd_rows)


@pytest.mark.parametrize("least", [2, 500])
def test_near_with_hot_values(odd, odd_rows, least, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_LEAST", least)
    assert rows(near_dedup.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept") == brute_components(odd_rows)


def test_near_edges(crowded, odd_rows, no_documents):
    assert near_dedup.near_duplicates(no_documents).count() == 0
    kept = near_dedup.drop_near_duplicates(crowded)
    assert kept.columns == crowded.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(20) == 1 and not set(ids) & {21, 22, 23, 24, 25, 30, 32} and 4 in ids and 6 not in ids


def test_pipeline_stage_takes_five_words(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(200)]
    changed = [f"c{i}" if i in (20, 60, 100, 140, 180) else f"v{i}" for i in range(200)]
    texts = [base, [*base, *(f"more{i}" for i in range(45))], [f"v{i}" for i in range(200)], changed]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    # 0.813 on five words (0.815 on three), and 0.774 on five words (0.859 on three).
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3]


@pytest.mark.parametrize(("similarity", "want"), [((85, 100), 42), ((80, 100), 37)])
def test_matches_follow_similarity(similarity, want):
    assert near_dedup.matches(similarity) == want


def test_intersections_by_products():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 80)).astype(np.uint64) for _ in range(9)]
    got = near_dedup._intersections(sets, np.arange(5), np.arange(4, 9))[:4]
    assert got.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in range(4, 9)] for i in range(4)]


def test_many_failing_pairs_are_judged_exactly():
    rng = np.random.default_rng(4)
    core = rng.choice(1 << 40, 90, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([core, rng.choice(1 << 40, 12).astype(np.uint64)])) for _ in range(120)]
    sets[7] = np.unique(np.concatenate([sets[3][:-2], sets[3][-1:]]))
    flat, edges = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    forest = near_dedup._Forest(len(sets))
    near_dedup.confirm(sets, near_dedup.signatures(flat, edges), forest, np.arange(120), np.arange(120))
    assert forest.root(7) == forest.root(3) and len({forest.root(i) for i in range(120)}) == 119


def test_components(spark):
    from slotloom.llm.graph import components

    import random

    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(70)] + [(7, 7)]
    r.shuffle(edges)
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {v.vertex: v.label for v in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: root(v) for a, b in edges if a != b for v in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- decontamination --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def benchmark_rows(odd_rows):
    passage = odd_rows[11][1].split()
    return [(1, " ".join(passage[5:25]).upper()), (2, "two, words!"), (3, None), (4, "..."), (10, " ".join(passage[10:23])), (5, "never seen " * 20), (2, "two words"), (None, "one")]


def brute_contamination(odd_rows, benchmark_rows):
    windows = defaultdict(set)
    for i, t in benchmark_rows:
        w = ALNUM.findall((t or "").translate(FOLD))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t, *_ in odd_rows:
        w = ALNUM.findall((t or "").translate(FOLD))
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(str(x) for x in items if x is not None))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=key)


@pytest.mark.parametrize("most", [4_000_000, 3])
def test_cut_texts_and_reports_agree(spark, crowded, benchmark_rows, most):
    """``decontaminate`` keeps what ``contamination`` calls clean, and cuts as many words as it counts."""
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    report = decontaminate.contamination(crowded, items, max_windows=most)
    kept = decontaminate.decontaminate(crowded, items, max_windows=most)
    assert kept.columns == crowded.columns
    assert rows(kept, "doc_id") == rows(report.where("not contaminated"), "doc_id")
    words = lambda df: Counter((r.doc_id, len(ALNUM.findall((r.text or "").translate(FOLD)))) for r in df.collect())
    cut = decontaminate.decontaminate(crowded, items, spans=True, max_windows=most)
    assert words(cut) == Counter((r.doc_id, r.n_words - r.n_hit) for r in report.collect())


@pytest.mark.parametrize("most", [4_000_000, 3, 1])
def test_contamination(spark, odd, odd_rows, benchmark_rows, most):
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    got = decontaminate.contamination(odd, items, max_windows=most)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_contamination(odd_rows, benchmark_rows)


def test_one_window_in_very_many_items(spark, monkeypatch):
    """Its item list fills block after block; no block is larger than its bound."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20_000)
    sentence = " ".join(f"word{i}" for i in range(13))
    plain = [(i, sentence) for i in range(3000)]
    blocks = list(decontaminate.window_blocks(plain))
    assert len(blocks) > 20 and max(len(b.of[13].items) for b in blocks) < 300
    docs = [(1, f"before {sentence} behind", "en", "s", 0), (2, "clean", "en", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    # Some blocks are enough to see that their items come together.
    some = plain[:400]
    got = decontaminate.contamination(df, spark.createDataFrame(some, "item_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute_contamination(docs, some)


def test_windows_of_one_hash_stay_apart(spark, odd, odd_rows, benchmark_rows, monkeypatch):
    """With one hash for all windows, words alone decide."""
    real = decontaminate.windows
    monkeypatch.setattr(decontaminate, "windows", lambda *a: (real(*a)[0], np.zeros_like(real(*a)[1])))
    known = next(decontaminate.window_blocks(benchmark_rows))
    assert all((w.hashes == 0).all() for w in known.of.values())
    folded = [ALNUM.findall((t or "").translate(FOLD)) for _, t in benchmark_rows]
    assert len(known.of[13].hashes) == len({tuple(w[k : k + 13]) for w in folded for k in range(len(w) - 12)})
    short = [r for r in odd_rows if len(r[1] or "") < 3000]
    for (i, t, *_), want in zip(short, [brute_contamination([r], benchmark_rows)[0] for r in short]):
        raw = (t or "").encode()
        starts, _, _, hit, found = decontaminate.hits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), known)
        assert (i, len(starts), int(hit.sum()), len(found.get(0, ()))) == want[:4]


def test_decontaminated(spark, crowded, odd_rows, benchmark_rows, no_documents):
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    hits = {r[0]: r[2] for r in brute_contamination(odd_rows, benchmark_rows)}
    bad = [r[0] for r in brute_contamination(odd_rows, benchmark_rows) if r[-1]]
    kept = decontaminate.decontaminate(crowded, items)
    assert kept.columns == crowded.columns and kept.count() == len(odd_rows) - len(bad)
    cleaned = {r.doc_id: r.text for r in decontaminate.decontaminate(crowded, items, spans=True).collect()}
    assert cleaned[1] is None and cleaned[5] == "" and len(ALNUM.findall(cleaned[10])) == len(ALNUM.findall(dict((r[0], r[1]) for r in odd_rows)[10])) - hits[10]
    assert decontaminate.contamination(no_documents, items).count() == 0
    assert not [r for r in decontaminate.contamination(crowded, items.limit(0)).collect() if r.n_hit]


def test_decontaminated_by_blocks(spark, crowded, odd_rows, benchmark_rows):
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    for spans in (False, True):
        whole, blocks = (rows(decontaminate.decontaminate(crowded, items, spans=spans, max_windows=m), "doc_id", "text", "score") for m in (4_000_000, 3))
        assert blocks == whole
    # 3 + 3 of 100 words by two blocks: neither is a share of 1 / 20 alone.
    text = " ".join(["a b c", *(f"w{i}" for i in range(94)), "d e f"])
    doc = spark.createDataFrame([(1, text)], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "item_id long, text string")
    assert decontaminate.decontaminate(doc, two, max_windows=1).count() == 0
    # Overlapping items go whole, and what only cutting brings together stays.
    cut = spark.createDataFrame([(1, "p q r s t"), (2, "x p q r y")], "doc_id long, text string")
    three = spark.createDataFrame([(1, "p q r"), (2, "r s"), (3, "x y")], "item_id long, text string")
    assert {r.doc_id: r.text.split() for r in decontaminate.decontaminate(cut, three, spans=True, max_windows=1).collect()} == {1: ["t"], 2: ["x", "y"]}


# -- personal data ----------------------------------------------------------------------------------------------------

PLAIN = "Write to a.b@c-d.example.org, or 10.0.255.1 and 300.1.1.1; card 4111 1111 1111 1111 not 4111111111111112, call +1 (743) 555-3824. IBAN GB82 WEST 1234 5698 7654 32 but GB83WEST12345698765432. ssn 123-45-6789; 123-45-6789 alone"


def test_time_is_linear():
    import time

    for text in ("a" * 10**6 + " x@y.zz", "1" * 10**6, "1." * 500_000, "a@" * 500_000, "+1(" * 300_000, "123-45-6789 " * 80_000):
        began = time.time()
        pii.find(text)
        assert time.time() - began < 4


def test_base_spans_equal_the_patterns():
    import random

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = random.Random(1)
    for _ in range(20_000):
        alphabet = r.choice(["a.@-", "ab@.% ", "1.2 -", "+1( .", "1.", "12 -a@.+"])
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(30)))
        for kind, pattern in patterns.items():
            assert list(pii._candidates(kind, text)) == [m.span() for m in re.finditer(pattern, text)], (kind, text)


def test_secrets():
    assert [(k, a, b) for k, a, b, _ in pii.find('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x')] == [("secret", 9, 49)]
    assert [k for k, *_ in pii.find("api_key: sk-1a2B3c4D5e6F7g8H9i0J")] == ["secret"]
    for text in ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "token aaaaaaaaaaaaaaaaaaaaaaaa1", "token onlyletterswithoutanydigit", "token 1234567890123456789012345", "monkey 04dbebab91ab85687d33eeaaf9ac699e1188f962"):
        assert "secret" not in [k for k, *_ in pii.find(text)], text


def test_context_words_are_whole_words():
    assert pii.find("our hotel has 743 555-3824 rooms") == [] and [k for k, *_ in pii.find("tel 743-555-3824")] == ["localphone"]
    assert pii.find("x" * 37 + "hotel 743-555-3824") == [] and pii.find("743-555-3824 " + "y" * 36 + " telescope") == []
    assert [s for *_, s in pii.find("a@b.cc")] == [0.9] and [s for *_, s in pii.find("mail a@b.cc")] == [1.0]


def test_spans_of_documents(spark, sf_dir):
    """All kinds on whole documents, against patterns and checks written down again."""
    extra = {"iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "localphone": r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])", "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}"}
    near = {"secret": ("token", "secret", "password", "passwd", "key", "credential"), "ssn": ("ssn", "social security"), "localphone": ("phone", "telephone", "call", "tel", "mobile", "fax")}

    def fits(kind, text, a, b):
        if kind == "iban":
            moved = text[a:b].replace(" ", "")
            return 15 <= len(moved) <= 34 and int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in moved[4:] + moved[:4])) % 97 == 1
        words = [m for w in near[kind] for m in re.finditer(rf"(?i)(?<![^\W\d_]){w}s?(?![^\W\d_])", text)]
        if not any(a - 40 <= m.start() and m.end() <= a or b <= m.start() < b + 40 for m in words):
            return False
        if kind == "secret":
            found = text[a:b]
            bits = -sum(found.count(c) / len(found) * np.log2(found.count(c) / len(found)) for c in set(found))
            return bool(re.search("[0-9]", found) and re.search("[A-Za-z]", found)) and bits >= pii.SECRET_BITS
        if kind == "ssn" and not re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", text[a:b]):
            return False
        return not any(int(x) < b and a < int(y) for x, y in (s.split(":")[1:] for s in brute_spans(text)))

    for r in registry.QUERIES["op9_pii"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        text = r.text or ""
        more = [f"{k}:{m.start()}:{m.end()}" for k, p in extra.items() for m in re.finditer(p, text) if fits(k, text, *m.span())]
        assert sorted(filter(None, r.spans.split(","))) == sorted(brute_spans(text) + more) and r.n_spans == len(brute_spans(text) + more)


def test_spans():
    got = {(k, PLAIN[a:b]) for k, a, b, _ in pii.find(PLAIN)}
    assert {("email", "a.b@c-d.example.org"), ("ip", "10.0.255.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")} <= got
    assert not any(v in ("300.1.1.1", "4111111111111112") or v.startswith("GB83") for _, v in got)
    assert pii.find(None) == pii.find("") == pii.find("no data") == []
    assert pii.find("😀 x@y.zz") == [("email", 2, 8, 0.9)]
    assert [k for k, *_ in pii.find("call +1 (743) 555-3824 now")] == ["phone"]
    assert [k for k, *_ in pii.find("call (743) 555-3824 now")] == ["localphone"]
    far = "account 123-45-6789 " + "x" * 60
    assert pii.find(far) == []


def brute_spans(text):
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), ("email", "ip", "card", "phone").index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


def test_pii_digest(spark, sf_dir, crowded, no_documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["op9_pii"](spark, sf_dir).collect()}
    for r in docs.collect():
        want = brute_spans(r.text)
        row = got[r.doc_id]
        assert row.base_sha256 == sha(",".join(want))
        assert set(want) <= set(row.spans.split(",")) | {""}
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]
    assert pii.personal_data(crowded).count() == crowded.count() and pii.personal_data(no_documents).count() == 0
    assert pii.redact(spark.createDataFrame([(1, "mail x@y.zz now")], "doc_id long, text string")).first().text == "mail <email> now"


# -- token files ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 7, 15, 16, 17, 20])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), len(ids), bits) == ids).all()


def test_pieces_equal_whole_texts(odd_rows):
    import random

    import pyarrow as pa

    from slotloom.llm.words import chunks

    encoder = token_files.PieceEncoder(token_files.tokenizer_file())
    r = random.Random(1)
    alphabet = "ab Z'st ll.,!?<|>\n\t é€ 12“”–  'sß 中😀×"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(4000)] + ["<|endoftext|>", "a <|endoftext|> b'<|endoftext|>s", " <|endoftext|>,x"] + [t or "" for _, t, *_ in odd_rows]
    for lo, hi, data, offsets in chunks(pa.array(texts), 1 << 14):
        ids, n = encoder.encode(data, offsets)
        ends = np.cumsum(n)
        for k, whole in enumerate(encoder.tokenizer.encode_batch(texts[lo:hi], add_special_tokens=False)):
            assert ids[ends[k] - n[k] : ends[k]].tolist() == whole.ids, texts[lo + k]


def test_token_query(spark, sf_dir):
    """The query on whole documents against the tokenizer itself."""
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(token_files.tokenizer_file()), 0
    got = {r.doc_id: r for r in registry.QUERIES["op10_token_files"](spark, sf_dir).collect()}
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)
    for r, whole in zip(docs, t.encode_batch([r.text or "" for r in docs], add_special_tokens=False)):
        ids = [*whole.ids, 0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_pieces_that_cannot_be_told_apart(monkeypatch):
    """Equal hashes of different pieces, and tokens over a cut, make no difference to the ids."""
    import pyarrow as pa

    from slotloom.llm.words import buffers

    texts = ["one two three, four", "five six\nseven", "", "one six"]
    data, offsets = buffers(pa.array(texts))
    plain = token_files.PieceEncoder(token_files.tokenizer_file())
    want = [e.ids for e in plain.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, n = plain.encode(data, offsets)
    assert np.split(ids, np.cumsum(n)[:-1])[1].tolist() == want[1]
    monkeypatch.setattr(token_files, "word_hashes", lambda data, starts, ends, fold: (ends - starts).astype(np.uint64))
    clashing = token_files.PieceEncoder(token_files.tokenizer_file())
    ids, n = clashing.encode(data, offsets)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    monkeypatch.undo()
    crossing = token_files.PieceEncoder(token_files.tokenizer_file())
    crossing.width[:] = 1
    ids, n = crossing.encode(data, offsets)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want and not len(crossing.hashes)


def test_other_doc_ids_and_failed_attempts(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "none"), ("b", "again")], "doc_id string, text string")
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/named", token_files.tokenizer_file())
    assert [r.doc_id for r in token_files.read_token_files(manifest, "string").orderBy("start").collect()] == [None, "a", "b", "b"]
    writer = token_files.ShardWriter(f"file://{tmp_path}/failed.sltb", 16)
    writer.abandon()
    assert not list(tmp_path.glob("failed*"))


def test_token_files(spark, odd, odd_rows, no_documents, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_file())
    manifest = token_files.write_token_files(odd, f"file://{tmp_path}/tokens", token_files.tokenizer_file())
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    start = 0
    for r, (i, text, *_) in zip(got, sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(odd_rows)
    reader = token_files.ShardReader(manifest.first().url)
    assert reader.bits == 16 and (reader.document(0) == reader.ids(0, int(reader.starts[1]))).all()
    empty = token_files.write_token_files(no_documents, f"file://{tmp_path}/none", token_files.tokenizer_file())
    assert token_files.read_token_files(empty).count() == 0
