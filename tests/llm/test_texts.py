import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalquarry.llm import decontaminate as decontaminate_
from evalquarry.llm import language, quality, toxicity, trees
from evalquarry.llm.decontaminate import decontaminate
from evalquarry.llm.labelled import held_out, sample
from evalquarry.llm.mixing import emit, mix
from evalquarry.llm.shared import hot_join

from .data import awkward, clashing, documents

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def hits(rows, items, window=10):
    out = Counter()
    for i, text, *_ in rows:
        words = ALNUM.findall(lowered(text))
        gone, found = set(), set()
        for name, item in items:
            w = ALNUM.findall(lowered(item))
            k = min(len(w), window)
            grams = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if w else set()
            for s in range(len(words) - k + 1) if k else ():
                if tuple(words[s : s + k]) in grams:
                    gone |= set(range(s, s + k))
                    found.add("null" if name is None else str(name))
        out[(i, len(words), len(gone), tuple(sorted(found)))] += 1
    return out


ITEMS = [(1, "w1x W2X"), (2, None), (3, ""), (10, " ".join(awkward()[4][1].split()[5:30])), (10, "漢字 é Ü"), (None, "one, TWO!"), (7, "!!!")]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_decontamination_matches_brute_force(spark, broadcast_bytes):
    rows = awkward()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate(documents(spark, rows), items, broadcast_bytes=broadcast_bytes).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out) == hits(rows, ITEMS)
    assert all(r.contaminated == (r.n_hit > 0) for r in out)
    for r in out:
        assert len(ALNUM.findall(r.clean_text or "")) == r.n_words - r.n_hit
        assert r.contaminated or r.clean_text == r.text
    assert any(r.contaminated for r in out)


def test_filter_passes_every_window_of_the_benchmark(spark):
    rng = np.random.default_rng(5)
    grams = rng.integers(-(2**63), 2**63, 5000)
    bits = decontaminate_.bitmap(spark.createDataFrame([(int(g),) for g in grams], "gram long"))
    assert decontaminate_.passes(bits, grams.view(np.uint64)).all()
    assert decontaminate_.passes(bits, rng.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 0.001


def test_equal_hashes_of_different_windows_are_told_apart():
    held = decontaminate_.Grams(np.array([7, 7, 7], np.uint64), {2: (0, 3)}, np.array([0, 3, 6, 9]), b"a ba ca b", np.array([0, 1, 2]), ["x", "y", "z"])
    assert held.of(2, np.uint64(7), b"a b") == ["x", "z"] and held.of(2, np.uint64(8), b"a b") == [] and held.of(2, np.uint64(7), b"q q") == []


@pytest.mark.parametrize("broadcast_bytes", [1 << 30, 0])
def test_a_window_of_very_many_documents(spark, broadcast_bytes):
    rows = [(i, f"d{i} one two three four five six seven eight nine ten e{i} " * 3, None, None, None) for i in range(300)] + [(1000 + i, f"other words {i}", None, None, None) for i in range(100)]
    items = [(i, "one two three four five six seven eight nine ten") for i in range(5)]
    out = decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=broadcast_bytes).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out) == hits(rows, items)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(documents(spark, []), none).count() == 0
    out = decontaminate(clashing(documents(spark), "items", "clean_text"), none)
    assert out.filter("contaminated").count() == 0
    assert {r.size for r in out.collect()} == {"taken"}


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(spark, n=400):
    rng = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 4 == 0
        words = [f"{'abcdefgh'[x % 8]}{x}le" for x in rng.integers(0, 500, rng.integers(30, 200))]
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[5:7] = ["horrid", "Swine"]
        rows.append((i, " ".join(words), "en", "s", 1))
        marks.append((i, int(not bad), int(toxic)))
    return rows, marks


@pytest.mark.parametrize(("module", "column", "threshold"), [(quality, "quality", 0.5), (toxicity, "toxic", 0.7)])
def test_classifiers_on_held_out_rows(spark, module, column, threshold):
    rows, marks = corpus(spark)
    got = {r.doc_id: r for r in module.score(documents(spark, rows), labels(spark, marks)).collect()}
    right = [(got[i].score >= threshold) == bool(dict(quality=q, toxic=t)[column]) for i, q, t in marks if got[i].held_out]
    assert len(right) > 80
    assert np.mean(right) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_handle_awkward_tables(spark, module):
    rows, marks = corpus(spark, 60)
    rows = [*awkward(), *((1000 + r[0], *r[1:]) for r in rows)]
    marks = [(1000 + i, q, t) for i, q, t in marks] + [(1, None, None), (None, 1, 1), (1000, 1, 0), (1000, 0, 1)]
    a = module.score(documents(spark, rows), labels(spark, marks)).collect()
    b = module.score(clashing(documents(spark, rows)), clashing(labels(spark, marks), "label", "text")).collect()
    assert Counter(a) == Counter(b)
    assert len(a) == len(rows)
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in a)
    assert module.score(documents(spark, []), labels(spark, marks)).count() == 0
    assert {r.score for r in module.score(documents(spark, rows), labels(spark, [])).collect()} == {0.5}


def test_no_held_out_label_is_learned_from(spark):
    rows = [(i, 1, 0) for i in range(300)]
    chosen = {r.id for r in sample(labels(spark, rows), "quality").collect()}
    held = {r.i for r in spark.range(300).select(F.col("id").alias("i"), held_out(F.col("id")).alias("h")).filter("h").collect()}
    import zlib

    assert held == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert chosen == set(range(300)) - held
    assert sample(labels(spark, rows), "quality", rows=7).count() == 7


def test_flattened_trees_match_recursion():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = trees.train(x, y, trees=30)

    def one(row):
        raw = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            n = 0
            while f[n] >= 0:
                n = 2 * n + 1 + (row[f[n]] > t[n])
            raw += v[n]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose(forest.scores(x[:50]), [one(r) for r in x[:50]])
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.95


def test_languages(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = language.identify(pages, texts).collect()
    assert len(got) == pages.count()
    assert np.mean([r.language == r.declared for r in got]) > 0.95
    # without markup and address the text alone decides; with hardly any text the other evidence does
    plain = texts.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "lang")
    known = {r.page_id: r.lang for r in plain.collect()}
    assert np.mean([r.language == known[r.page_id] for r in language.identify(plain, texts).collect()]) > 0.95
    odd = [(9001, "https://a.example.fr/fr/1", '<html lang="fr"><body></body></html>'), (9002, None, None), (9003, "not a url", ""), (None, "https://a.example.fr/fr/1", "<p>x</p>"), (9001, "https://a.example.fr/fr/1", '<html lang="fr"><body></body></html>')]
    both = pages.select("page_id", "url", "html").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))
    out = language.identify(clashing(both, "prior", "p", "soft", "host", "declared"), texts).collect()
    assert len(out) == pages.count() + 5
    assert [r.language for r in out if r.page_id == 9001] == ["fr", "fr"]
    assert all(r.language and 0 <= r.probability <= 1.0000001 for r in out)


def test_language_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "https://x.org", "<p>a</p>")], "page_id long, url string, html string")
    texts = spark.createDataFrame([], "text string, lang string")
    assert [r.language for r in language.identify(pages, texts).collect()] == [None]
    some = spark.createDataFrame([("hello there", "en"), (None, "en"), ("x", None)], "text string, lang string")
    assert language.identify(pages.limit(0), some).count() == 0
    assert [r.language for r in language.identify(pages, some).collect()] == ["en"]


def filled(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing the excess round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_reaches_its_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), None, ["a", "b", "é", "B", None, "z"][min(int(rng.exponential(1.2)), 5)], 0) for i in range(4000)]
    out = mix(documents(spark, rows)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want = filled(dict(sizes))
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) < 0.1 * want[s] + 60 for s in want)
    assert Counter(out) == Counter(mix(documents(spark, rows)).collect())
    assert emit(mix(documents(spark, rows))).count() == sum(r.copies for r in out)


def test_mix_of_awkward_tables(spark):
    rows = awkward()
    out = mix(clashing(documents(spark, rows))).collect()
    assert len(out) == len(rows)
    assert {r.size for r in out if r.text is None or not r.text.split()} == {0}
    assert mix(documents(spark, [])).count() == 0
    empty = mix(documents(spark, [(1, None, None, None, None), (2, "", None, "a", 0)])).collect()
    assert [(r.target, r.copies) for r in empty] == [(0.0, 0), (0.0, 0)]


def test_mix_beyond_the_broadcast_bound(spark):
    docs = clashing(documents(spark))
    assert Counter(mix(docs).collect()) == Counter(mix(docs, broadcast_bytes=0).collect())


def test_null_keys_of_a_left_join_are_spread(spark):
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    rows = spark.createDataFrame([(i, None if i < 900 else f"k{i % 3}") for i in range(1000)], "i long, k string")
    keyed = spark.createDataFrame([("k0", 1, "x"), ("k1", 1, "y")], "k string, c long, v string")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = hot_join(rows, keyed, ["k"], "c", ["i"], "left").withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.i, r.k, r.v) for r in got if r.k) == sorted((i, f"k{i % 3}", {0: "x", 1: "y"}.get(i % 3)) for i in range(900, 1000))
    assert sorted(r.i for r in got if r.k is None and r.v is None) == list(range(900))
    assert len({r.part for r in got if r.k is None}) > 1
