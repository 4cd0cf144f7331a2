from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalquarry.llm import near_dedup
from evalquarry.llm.mixing import mix
from evalquarry.llm.quality import score
from evalquarry.llm.queries import ORACLES, QUERIES

from .data import SCHEMA, clashing, documents

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_handle_awkward_documents(spark, name, stage):
    out = stage(spark, clashing(documents(spark)), SF)
    assert out.columns[:5] == corpus_pipeline.COLUMNS
    if name != "mixture":
        assert out.columns == corpus_pipeline.COLUMNS
        assert [f.dataType for f in out.schema] == [f.dataType for f in spark.createDataFrame([], SCHEMA).schema]
    out.collect()
    assert stage(spark, documents(spark, []), SF).count() == 0


def test_decisions_take_effect(spark):
    docs = documents(spark)
    one = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert {0, 1, 2} & {r.doc_id for r in one} == {0}
    two = corpus_pipeline.repeated_passages(spark, docs, SF).collect()
    before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in two}
    assert set(before) == set(after)
    assert len(after[13]) < len(before[13])
    assert all(r.n_chars == len(r.text) for r in two if r.text != before[r.doc_id])


def test_quality_keeps_what_the_classifier_does_not_reject(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.union(documents(spark))  # nulls, empties, repeated rows and ids too
    kept = corpus_pipeline.quality(spark, docs, SF)
    scores = Counter((r.doc_id, r.score >= 0.5) for r in score(docs, labels).collect())
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, good), n in scores.items() if good})
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rejected = Counter(marks.get(i) for (i, good) in scores if not good)
    assert rejected[0] > 3 * rejected[1]
    assert kept.exceptAll(docs.select(corpus_pipeline.COLUMNS)).count() == 0  # rows stay as they are


def test_one_of_each_class_of_near_duplicates_stays(spark):
    docs = documents(spark)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    every = near_dedup.near_duplicates(docs).collect()
    assert max(kept.values()) == 1 and len(kept) == len({(r.doc_id, r.text_hash) for r in every if r.first})
    assert {i for i, _ in kept} == {r.doc_id for r in every if r.first} == {r.class_id for r in every}


def test_benchmark_passages_lose_the_words_of_windows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    words = item.split()
    assert len(words) > 12
    clean = [f"clean{k}" for k in range(15)]
    rows = [(1, " ".join([*clean, *words[:12], *clean]), "en", "s", 1), (2, " ".join(clean), "en", "s", 77), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " ".join([*words[:9], *clean]), "en", "s", 5)]
    got = {r.doc_id: r for r in corpus_pipeline.benchmark_passages(spark, documents(spark, [*rows, rows[0]]), SF).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[1].text.split() == [*clean, *clean] and got[1].n_chars == len(got[1].text)
    for i, text, *_, n in rows[1:]:  # nine words of a window are no window
        assert (got[i].text, got[i].n_chars) == (text, n)


def test_mixture_emits_each_copy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(documents(spark))
    want = Counter()
    for r in mix(docs).collect():
        for k in range(r.copies):
            want[r.doc_id, r.text, k] += 1
    assert Counter((r.doc_id, r.text, r["copy"]) for r in corpus_pipeline.mixture(spark, docs, SF).collect()) == want
    assert {k for _, _, k in want} == {0, 1}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50
    assert out.columns == [*corpus_pipeline.COLUMNS, "copy"]


def test_each_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
