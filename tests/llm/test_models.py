"""Scores of fitted models against plain versions, and their quality on rows they never saw."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalquarry.llm import language, quality, toxicity
from evalquarry.llm.labelled import sample

from .data import awkward, documents

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def auc(scores, labels):
    """Share of (1, 0) pairs in which the 1 has the higher score, ties half."""
    one, zero = ([s for s, y in zip(scores, labels, strict=True) if y == v] for v in (1, 0))
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero]))


@pytest.mark.parametrize(("module", "column", "least"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_ranking_of_held_out_documents(spark, module, column, least):
    got = module.score(table(spark, "documents"), table(spark, "labels")).join(table(spark, "labels"), "doc_id").filter(f"held_out AND {column} IS NOT NULL").collect()
    area = auc([r.score for r in got], [r[column] for r in got])
    print(f"{column}: {len(got)} held-out rows, AUC {area:.3f}")
    assert len(got) > 100 and area >= least


def share(a, b):
    return a / b if b else 0.0


def plain_statistics(text):
    raw = (text or "").encode()
    n, out = len(raw), {}
    for name, chars in quality.CLASSES.items():
        out[name] = share(sum(bool(chars[b]) for b in raw), n)
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    size = [len(w) for w in words]
    lines = [x for x in raw.split(b"\n") if x]
    pairs = list(zip(words, words[1:], strict=False))
    mean = share(sum(size), len(words))
    out |= {
        "log_bytes": math.log1p(n), "log_words": math.log1p(len(words)), "word_length": mean, "word_spread": math.sqrt(max(share(sum(s * s for s in size), len(words)) - mean**2, 0)),
        "long_words": share(sum(s > 12 for s in size), len(words)), "distinct_words": share(len(set(words)), len(words)), "distinct_pairs": share(len(set(pairs)), len(pairs)),
        "top_word": share(max(Counter(words).values(), default=0), len(words)), "words_a_line": share(len(words), len(lines)), "repeated_lines": 1 - share(len(set(lines)), len(lines)),
        "entropy": -sum(c / n * math.log2(c / n) for c in Counter(raw).values()), "first_upper": share(sum(0x41 <= w[0] <= 0x5A for w in words), len(words)),
        "symbol_ends": share(sum(not (chr(w[-1]).isascii() and chr(w[-1]).isalpha() or w[-1] >= 0x80 or w[-1] in b".,;:?") for w in words), len(words)),
        "runs": share(sum(a == b != 0x20 for a, b in zip(raw, raw[1:], strict=False)), n),
    }
    return [out[k] for k in quality.NAMES]


def descend(forest, row):
    raw = forest.base
    for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
        node = 0
        while f[node] >= 0:
            node = 2 * node + 1 + (row[f[node]] > t[node])
        raw += v[node]
    return 1 / (1 + math.exp(-raw))


def test_quality_scores_match_a_plain_version(spark):
    rows = [r for r in awkward() if len(r[1] or "") < 10_000]
    docs = table(spark, "documents").select("doc_id", "text", "lang", "source", "n_chars").unionByName(documents(spark, [((r[0] or 0) + 10**6, *r[1:]) for r in rows]))
    keyed = docs.select(F.col("doc_id").alias("id"), "text")
    forest = quality.fit(keyed.mapInArrow(quality.statistics, "id long, features array<double>"), table(spark, "labels"))
    assert len(forest.feature)
    some = docs.filter("doc_id % 37 = 0 OR doc_id >= 1000000").collect()
    got = defaultdict(list)
    for r in quality.score(docs, table(spark, "labels")).filter("doc_id % 37 = 0 OR doc_id >= 1000000").collect():
        got[r.doc_id].append(r.score)
    want = defaultdict(list)
    for r in some:
        want[r.doc_id].append(descend(forest, plain_statistics(r.text)))
    assert set(got) == set(want)
    off = [abs(a - b) for k in got for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True)]
    assert np.mean(np.array(off) < 1e-9) > 0.97  # a sum in another order may fall on the other side of a threshold


def plain_buckets(text):
    flat = b" " + bytes(0x20 if b == 0x20 or 9 <= b <= 13 else b + 32 if 0x41 <= b <= 0x5A else b for b in (text or "").encode()) + b" "
    out = set()
    for n in toxicity.SIZES:
        for i in range(len(flat) - n + 1):
            x = int.from_bytes(flat[i : i + n], "little") * 0x9E3779B97F4A7C15 % 2**64
            out.add((x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64 >> (64 - toxicity.BUCKET_BITS))
    return out


def test_toxicity_scores_match_a_plain_version(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = toxicity.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    assert np.count_nonzero(model.weight) > 100
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    for r in docs.filter("doc_id % 29 = 0").collect():
        raw = sum(model.weight[b] for b in plain_buckets(r.text)) + model.bias
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, raw)))), abs=1e-9)


def test_counts_are_document_frequencies(spark):
    """The counts that the ratios are made of: in how many labelled documents of either kind a bucket occurs."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    labelled = docs.select(F.col("doc_id").alias("id"), "text").join(sample(labels, "toxic", rows=toxicity.SAMPLE), "id").select("label", "text")
    got = labelled.mapInArrow(toxicity.count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
    clean, toxic = Counter(), Counter()
    for r in labelled.collect():
        (toxic if r.label else clean).update(plain_buckets(r.text))
    assert {r.bucket: (r.clean, r.toxic) for r in got} == {b: (clean[b], toxic[b]) for b in clean | toxic}


def test_languages_of_texts_that_did_not_teach(spark):
    docs = table(spark, "documents").filter("lang IS NOT NULL")
    pages = docs.filter("doc_id % 2 = 1").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    known = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(pages, docs.filter("doc_id % 2 = 0")).collect()
    right = float(np.mean([r.language == known[r.page_id] for r in got]))
    print(f"language: {len(got)} held-out texts, accuracy {right:.3f}")
    assert len(got) > 100 and right > 0.95


def test_evidence_fusion_matches_a_plain_version(spark):
    texts = table(spark, "documents")
    langs, _ = language.fit(texts)
    pages = table(spark, "pages").select("page_id", "url", "html").filter("page_id < 150")
    got = {r.page_id: r for r in language.identify(pages, texts).collect()}
    alone = language.identify(pages.withColumn("url", F.lit(None).cast("string")).withColumn("html", language.visible(F.col("html"))), texts, lean=1e12)
    assert set(got) == {r.page_id for r in alone.collect()}
    held = spark.sparkContext.broadcast(language.fit(texts))
    rows = pages.select(F.col("page_id").alias("id"), "url", language.declared(F.col("html")).alias("declared"), language.visible(F.col("html")).alias("text"))
    logs = {r.id: r for r in rows.mapInArrow(language.likelihood(held), "id long, url string, declared string, text_log array<double>").collect()}

    def soft(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    n = len(langs)
    page = {}
    for i, r in logs.items():
        host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", r.url or "")
        host = host and host[1].lower()
        domain, suffix = (re.search(p, host or "") for p in (r"([^.]+\.[^.]+)$", r"\.([^.]+)$"))
        segment = re.match(r"[^?#]*?/([a-zA-Z]{2})(?:/|$|[?#])", r.url or "")
        page[i] = {"log": r.text_log, "soft": soft(r.text_log), "declared": r.declared, "segment": segment and segment[1].lower(), "host": host, "domain": domain and domain[1], "suffix": suffix and suffix[1]}
    total = [sum(p["soft"][k] for p in page.values()) + language.SMOOTH for k in range(n)]
    for i, p in page.items():
        prior = [t / sum(total) for t in total]
        for level in ("suffix", "domain", "host"):
            mates = [q["soft"] for j, q in page.items() if j != i and p[level] and q[level] == p[level]]
            c = [sum(m[k] for m in mates) for k in range(n)]
            prior = [(c[k] + language.LEAN * prior[k]) / (sum(c) + language.LEAN) for k in range(n)]
        log = [p["log"][k] + math.log(prior[k]) for k in range(n)]
        for what in ("declared", "segment"):
            if p[what]:
                kinds = len({q[what] for q in page.values() if q[what]})
                for k in range(n):
                    mine = sum(q["soft"][k] for j, q in page.items() if j != i and q[what] == p[what])
                    every = sum(q["soft"][k] for q in page.values() if q[what])
                    log[k] += math.log((mine + language.SMOOTH) / (every + language.SMOOTH * (kinds + 1)))
        want = soft(log)
        assert got[i].probability == pytest.approx(max(want), abs=1e-6)
        assert got[i].language == langs[want.index(max(want))] or sorted(want)[-1] - sorted(want)[-2] < 1e-6
