import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from evalquarry.llm import bagminhash, near_dedup, repeats, substring_dedup, suffix_dedup
from evalquarry.llm.automaton import SuffixAutomaton
from evalquarry.llm.components import components
from evalquarry.llm.packed import mix
from evalquarry.llm.segments import segments, sliding_least

from .data import awkward, clashing, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spans_of_words(rows, length=20):
    """Brute force: kept words and numbers of removed ones of each row, in order of rows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = {}, {}
    for i in order:
        words = WORD.findall(rows[i][1] or "")
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            w = tuple(words[s : s + length])
            place = (rows[i][0], rows[i][1], s)
            if seen.setdefault(w, place) != place:
                gone[s : s + length] = [True] * length
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def check_substrings(spark, rows):
    got = substring_dedup.substring_dedup(documents(spark, rows)).collect()
    want = Counter((rows[i][0], *v) for i, v in spans_of_words(rows).items())
    assert Counter((r.doc_id, r.n_words, r.n_removed, " ".join(WORD.findall(r.text or ""))) for r in got) == want
    return got


def test_substrings_match_brute_force(spark):
    got = check_substrings(spark, awkward())
    assert any(r.n_removed for r in got)
    assert any(r.text is None for r in got)


@pytest.mark.parametrize("reference", [repeats.REFERENCE, 3, 0])
def test_substrings_beyond_the_hot_bound(spark, monkeypatch, reference):
    """References through the automaton; for some anchors (3) or all (0) beyond their bound."""
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "REFERENCE", reference)
    check_substrings(spark, awkward())


def check_suffixes(spark, rows, length=200):
    count = Counter()
    texts = [(r[1] or "").encode() for r in rows]
    for t in texts:
        count.update(t[s : s + length] for s in range(len(t) - length + 1))
    want = Counter()
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        want[(r[0], len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g))] += 1
    got = suffix_dedup.suffix_dedup(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_suffixes_match_brute_force(spark):
    check_suffixes(spark, awkward())


@pytest.mark.parametrize("reference", [repeats.REFERENCE, 3, 0])
def test_suffixes_beyond_the_hot_bound(spark, monkeypatch, reference):
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "REFERENCE", reference)
    check_suffixes(spark, awkward())


@pytest.fixture
def tiny_shards(spark, monkeypatch):
    """Workers get the modules by value, with a shard after each anchor and Arrow batches that cut anchors."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(repeats.shards, "__defaults__", (1,))
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1)
    for module in (repeats, substring_dedup, suffix_dedup):
        cloudpickle.register_pickle_by_value(module)
    yield lambda n: spark.conf.set(key, n)
    for module in (repeats, substring_dedup, suffix_dedup):
        cloudpickle.unregister_pickle_by_value(module)
    spark.conf.set(key, before)


@pytest.mark.parametrize("records", [1, 3])
def test_anchors_that_batches_cut_stay_whole(spark, tiny_shards, records):
    tiny_shards(records)
    check_substrings(spark, awkward())
    check_suffixes(spark, awkward())


@pytest.mark.parametrize("records", [1, 2, 3, 50])
def test_shards_are_whole_anchors(records):
    table = pa.table({"anchor": [1, 1, 1, 2, 3, 3, 3, 3, 4, 5, 5], "salt": [0] * 11, "content": pa.array([b"xy"] * 11, pa.binary())})
    for size in (1, 3, 5, 100):
        got = [t["anchor"].to_pylist() for t in repeats.shards(iter(table.to_batches(max_chunksize=records)), size)]
        assert sum(got, []) == table["anchor"].to_pylist()
        assert all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False))
        assert all(2 * len(a) >= size for a in got[:-1])


@pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, near_dedup.near_duplicates])
def test_empty_tables_and_clashing_names(spark, operator):
    assert operator(documents(spark, [])).count() == 0
    plain, extra = operator(documents(spark)), operator(clashing(documents(spark)))
    keep = [c for c in plain.columns if c not in ("lang", "source", "n_chars")]
    assert Counter(map(str, plain.select(keep).collect())) == Counter(map(str, extra.select(keep).collect()))


def test_substrings_keep_other_columns(spark):
    out = substring_dedup.substring_dedup(clashing(documents(spark)))
    assert {r.anchor for r in out.collect()} == {"taken"}
    assert out.columns.count("n_removed") == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), max_size=40))
def test_matching_statistics(reference, stream):
    automaton = SuffixAutomaton()
    automaton.add(reference, 0)
    ref = "".join(map(str, reference))
    for i, (n, end) in enumerate(automaton.matches(stream, 6)):
        text = "".join(map(str, stream[: i + 1]))
        longest = max(k for k in range(min(6, i + 1) + 1) if text[len(text) - k :] in ref)
        assert n == longest
        if n:
            assert end == ref.index(text[len(text) - n :]) + n - 1


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=400).map(lambda b: bytes(x % 3 for x in b)))
def test_deep_shallow_sorting(text):
    data = np.frombuffer(text + bytes(64), np.uint8)
    order, begin = suffix_dedup.multikey_quicksort(suffix_dedup.eights(data), np.arange(len(text)), 16)
    assert [bytes(data[i : i + 16]) for i in order] == sorted(bytes(data[i : i + 16]) for i in range(len(text)))
    heads = [bytes(data[order[b] : order[b] + 16]) for b in begin]
    assert len(set(heads)) == len(heads)
    n = 24
    starts = np.arange(max(len(data) - n + 1, 0))
    count = Counter(bytes(data[i : i + n]) for i in starts)
    assert sorted(suffix_dedup.repeated_starts(data, starts, n, 8)) == [i for i in starts if count[bytes(data[i : i + n])] > 1]


def test_blind_trie_orders_texts():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 2, 12, dtype=np.uint8)) for _ in range(500)]
    trie = suffix_dedup.BlindTrie(12)
    for i, t in enumerate(texts):
        trie.insert(t, i)
    leaves = list(trie.leaves())
    assert [texts[n[0]] for n in leaves] == sorted(set(texts))
    assert sorted(sum(leaves, [])) == list(range(500))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=300), st.integers(1, 9))
def test_sliding_least(values, width):
    x = np.array(values, np.uint64)
    if len(x) >= width:
        assert sliding_least(x, width).tolist() == [min(values[i : i + width]) for i in range(len(x) - width + 1)]


def test_segments_cover_each_window_once():
    x = mix(np.random.default_rng(2).integers(0, 4, 5000).astype(np.uint64))
    bounds = np.array([0, 10, 10, 700, 715, 5000])
    s = segments(x, bounds, 20, 6)
    windows = [(d, w) for d, lo, n in zip(s.doc, s.lo, s.count, strict=True) for w in range(lo, lo + n)]
    assert sorted(windows) == [(d, w) for d in range(5) for w in range(bounds[d + 1] - bounds[d] - 19)]


def test_segments_of_equal_windows_share_an_anchor():
    rng = np.random.default_rng(3)
    shared = mix(rng.integers(0, 50, 40).astype(np.uint64))
    x = np.concatenate([mix(rng.integers(100, 10**6, 33).astype(np.uint64)), shared, mix(rng.integers(100, 10**6, 21).astype(np.uint64)), shared])
    s = segments(x, np.array([0, len(x)]), 20, 6)
    anchor = {w: a for lo, n, a in zip(s.lo, s.count, s.anchor, strict=True) for w in range(lo, lo + n)}
    assert all(anchor[33 + i] == anchor[33 + 40 + 21 + i] for i in range(21))


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    a = {i: int(rng.integers(1, 9)) for i in range(60)}
    b = {i: int(rng.integers(1, 9)) for i in range(20, 90)}
    both = set(a) | set(b)
    j = sum(min(a.get(k, 0), b.get(k, 0)) for k in both) / sum(max(a.get(k, 0), b.get(k, 0)) for k in both)
    hits = []
    for seed in range(60):
        element = mix(np.array([*a, *b], np.uint64), seed + 500)
        s = bagminhash.signatures(np.array([0] * len(a) + [1] * len(b)), element, np.array([*a.values(), *b.values()]), 2)
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - j) < 4 * np.sqrt(j * (1 - j) / 6000)


def test_bagminhash_does_not_depend_on_its_batch():
    element, weight = mix(np.arange(300, dtype=np.uint64)), np.arange(300) % 7 + 1
    alone = bagminhash.signatures(np.zeros(300, int), element, weight, 1)
    owner = np.concatenate([np.zeros(300, int), np.ones(1, int), np.full(40, 3)])
    many = bagminhash.signatures(owner, np.concatenate([element, element[:41]]), np.concatenate([weight, weight[:41]]), 5)
    assert (many[0] == alone[0]).all()
    assert not many[2].any()


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates_match_brute_force(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(r[1] for r in awkward())]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    bags, root = [bag(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            if union and sum((bags[i] & bags[j]).values()) >= 0.8 * union:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == dict(enumerate(root))
    assert len(set(root)) < len(root)


def test_keep_one_leaves_one_of_each_class(spark):
    docs = documents(spark)
    kept = near_dedup.keep_one(docs).collect()
    assert near_dedup.keep_one(documents(spark, kept)).count() == len(kept)
    ids = [r.doc_id for r in kept]
    assert 0 in ids and 1 not in ids and 2 not in ids and 14 not in ids
    assert {5, 6, 7} <= set(ids)  # texts without words are classes of their own
    assert None in ids and ids.count(3) == 1 and ids.count(4) == 2


def test_keep_one_takes_no_column_name(spark):
    taken = ("_id", "_h", "_th", "mark", "row", "text_hash", "class_id", "first", "n", "bands", "bucket", "content", "root", "lead")
    docs = clashing(documents(spark), *taken)
    out = near_dedup.keep_one(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert {r[c] for r in kept for c in taken} == {"taken"}
    key = lambda r: str((r.doc_id, r.text, r.lang))
    assert Counter(map(key, kept)) == Counter(map(key, near_dedup.keep_one(documents(spark)).collect()))


def test_pairs_at_the_threshold_share_a_band():
    """Of many pairs from 0.8 on, hardly one shares no band: the formula's 0.0004 at 0.8."""
    rng = np.random.default_rng(21)
    n, missed, pairs = 90, 0, 0
    for similar in (0.8, 0.81, 0.85, 0.9):
        owner, element = [], []
        for p in range(1500):
            both = round(2 * n * similar / (1 + similar))
            hashes = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            owner += [2 * p] * n + [2 * p + 1] * n
            element += [hashes[:n], hashes[n - both :]]
        keys = bagminhash.band_keys(bagminhash.signatures(np.array(owner), np.concatenate(element), np.ones(len(owner), int), 3000), near_dedup.BANDS)
        missed += int((~(keys[::2] == keys[1::2]).any(axis=1)).sum())
        pairs += 1500
    assert missed <= 5


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    words = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:i], "new", *words[i + 1 :]]), None, None, None) for i in range(0, 60, 3)] + [(99, " ".join(words), None, None, None)]
    classes = {r.class_id for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert classes == {0}


def test_components(spark):
    links = [(str(i).encode(), str(i + 1).encode()) for i in range(10, 30)] + [(b"x", b"y"), (b"x", b"x"), (b"y", b"x")]
    got = {bytes(r.node): bytes(r.root) for r in components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {str(i).encode(): b"10" for i in range(10, 31)} | {b"x": b"x", b"y": b"x"}
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0


@pytest.mark.parametrize("hot", [repeats.HOT, 1, 7])
def test_random_corpora(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        words = [f"q{x}" for x in rng.integers(0, 6, rng.integers(0, 80))]
        rows.append((i, " ".join(words), None, None, None))
    rows += [(100 + i, rows[i][1] + " " + rows[i + 1][1], None, None, None) for i in range(20)]
    check_substrings(spark, rows)
    check_suffixes(spark, rows)


def test_a_passage_of_many_documents(spark, monkeypatch):
    """Each document has other words around it, so that its rims have one anchor and as many segments as documents."""
    monkeypatch.setattr(repeats, "HOT", 10)
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 10**6, n))
    passage = word(45)
    rows = [(i, f"{word(30)} {passage} {word(30)}", None, None, None) for i in range(120)]
    got = check_substrings(spark, rows)
    assert sorted(r.n_removed for r in got) == [0] + [45] * 119
    check_suffixes(spark, rows)


def test_digest_of_query_is_of_kept_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("  a\tb \n c ",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(F.sha2(substring_dedup.word_text(F.col("text")), 256)).collect()]
    assert got == [hashlib.sha256(t).hexdigest() for t in (b"a b c", b"", b"")]


def test_recall_of_near_duplicates_on_documents(spark):
    """Every pair of different texts at 0.8 or more, by an exact search over words of five, is in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    bags = {r.doc_id: bag(r.text or "") for r in docs.collect()}
    at = {}
    for i, b in bags.items():
        for g in b:
            at.setdefault(g, []).append(i)
    shared = Counter((x, y) for ids in at.values() if len(ids) <= 60 for k, x in enumerate(sorted(ids)) for y in sorted(ids)[k + 1 :])
    pairs = [(x, y) for (x, y), _ in shared.items() if (bags[x] & bags[y]).total() >= 0.8 * (bags[x] | bags[y]).total()]
    assert len(pairs) > 20
    missed = [p for p in pairs if classes[p[0]] != classes[p[1]]]
    assert not missed, (len(missed), len(pairs))
