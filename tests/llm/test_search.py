import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalquarry.llm import multi_index
from evalquarry.llm.multi_index import MultiIndex, learn, nearest


def brute(rows, asked, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != len(rows[0][1]):
            continue
        good[i] = np.array(v, float)
    out = {}
    for q in good:
        if asked(q):
            others = sorted(((-float(sum(np.array(good[q]) * good[i])), i) for i in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in others]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def awkward_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # copies: ties
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0] * 7 + [None]), (203, [float("nan")] * 8), (204, [float("inf")] + [1.0] * 7), (205, []), (None, rows[1][1]), (206, [1.0, 2.0])]
    return [*rows, rows[0]]


def test_search_handles_every_awkward_vector(spark):
    rows = awkward_vectors()
    got = {}
    for r in nearest(vectors(spark, rows), lambda i: i % 5 == 0, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows, lambda i: i % 5 == 0, 6)
    assert set(got) == set(want)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    # the copies of a vector are equally near: the least ids come first
    assert [i for i, _ in got[100]] == [3, 101, 102, 103, 104, 105]
    assert [i for i, _ in got[105]] == [3, 100, 101, 102, 103, 104]
    assert all(len(v) == 6 and q not in dict(v) for q, v in got.items())


def test_fewer_candidates_than_k_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])]
    got = nearest(vectors(spark, rows), lambda i: i == 0, k=20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 0.0), (2, -1.0)]
    assert nearest(vectors(spark, []), lambda i: i == 0).count() == 0
    assert nearest(vectors(spark, rows), lambda i: i == 99).count() == 0


def test_clashing_columns_and_several_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    df = vectors(spark, rows).withColumn("score", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("id", F.lit(None)).withColumn("vector", F.lit(0))
    a = {(r.query_id, r.rank): r.vec_id for r in nearest(df, lambda i: i % 20 == 0, index_block=64, query_block=4).collect()}
    b = brute(rows, lambda i: i % 20 == 0, 20)
    assert np.mean([a[q, r + 1] == i for q in b for r, (i, _) in enumerate(b[q])]) > 0.9


def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = nearest(df, lambda i: i % 20 == 0).collect()
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, lambda i: i % 20 == 0, 20)
    found = {(r.query_id, r.vec_id): r.score for r in got}
    hits = [(q, i) in found for q in want for i, _ in want[q]]
    assert np.mean(hits) >= 0.9
    assert all(abs(found[q, i] - s) < 1e-12 for q in want for i, s in want[q] if (q, i) in found)


@pytest.mark.parametrize("radius", [3, 12, 29])
def test_pigeonhole_finds_all_codes_within_the_radius(radius):
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**63, 500, dtype=np.uint64)
    codes[:50] = codes[0] ^ (np.uint64(1) << rng.integers(0, 60, 50, dtype=np.uint64))
    index = MultiIndex(codes)
    for q in codes[:60]:
        assert set(index.within(q, radius)) == set(np.flatnonzero(np.bitwise_count(codes ^ q) <= radius))


@given(st.integers(0, 64), st.sampled_from([2, 4, 8]), st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_some_part_is_within_its_bound(radius, parts, a, b):
    width = 64 // parts
    apart = [((a ^ b) >> (p * width) & ((1 << width) - 1)).bit_count() for p in range(parts)]
    if sum(apart) <= radius:
        assert any(d <= r for d, r in zip(apart, multi_index.reaches(radius, parts), strict=True))


def test_narrow_balls_touch_few_codes():
    """Probing looks up the ball's values and touches a small part of the codes that a scan would."""
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    index = MultiIndex(codes)
    for q in codes[:50]:
        index.within(q ^ np.uint64(5), 7)
    assert index.looked_up == 50 * 4 * 17  # one bit in each of four parts of 16
    assert index.touched < 0.01 * 50 * len(codes)


@pytest.mark.parametrize("slices", [1, 3])
def test_clusters_are_probed_narrowly(spark, monkeypatch, slices):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in centres[i % 60] + 0.02 * rng.normal(size=16)]) for i in range(3000)]
    monkeypatch.setattr(multi_index, "QUERY_BYTES", -(-150 * 16 * 8 // slices))
    got = nearest(vectors(spark, rows), lambda i: i % 20 == 0, k=20, index_block=500, query_block=16).collect()
    want = brute([(i, np.float32(v)) for i, v in rows], lambda i: i % 20 == 0, 20)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(got) == len(found) == 20 * 150
    assert np.mean([(q, i) in found for q in want for i, _ in want[q]]) >= 0.9


def test_rotation_brings_codes_of_near_vectors_together():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 24))
    r = learn(x, float(np.linalg.norm(x, axis=1).max()))
    a, b = r.codes(x), r.codes(x + 0.05 * rng.normal(size=x.shape))
    assert np.bitwise_count(a ^ b).mean() < 12 < np.bitwise_count(a[1:] ^ a[:-1]).mean()
    assert 0 < multi_index.learn_radius(r, x, 5, 400) <= 64


def test_an_id_with_several_vectors(spark):
    rows = [(0, [2.0, 1.0]), (0, [1.0, 5.0]), (0, [1.0, 5.0]), (1, [3.0, 0.0]), (1, [0.0, 3.0]), (2, [-1.0, 1.0])]
    want = [(1, 1, 15.0), (2, 2, 4.0)]  # of [1, 5] against [0, 3] and [-1, 1]
    for _ in range(3):
        got = nearest(vectors(spark, rows).repartition(4), lambda i: i % 2 == 0, k=3).filter("query_id = 0").orderBy("rank").collect()
        assert [(r["rank"], r.vec_id, r.score) for r in got] == want
