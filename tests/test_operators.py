"""DataFrame operators against known answers and plain Python."""

import itertools
import json
import math
import random
import re
import time
from collections import Counter
from datetime import datetime
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalquarry.functions import geometry as G
from evalquarry.operators import audit, metrics, paired, ranking, scene, vectors
from evalquarry.plans import catalog, evaluation, linking_queries, metric_queries, motion_queries, value_queries  # noqa: F401
from evalquarry.sources import io
from evalquarry.streaming import log

SF = "/root/testdata/sf0.001"


def tail_of_half(n, k):
    """Twice the chance of at most k of n, in 60 digits: from the middle term outwards, so that the sum is short for k near n / 2."""
    from decimal import Decimal, localcontext

    with localcontext() as c:
        c.prec = 60
        i = n // 2
        middle = math.comb(n, i)
        low = max(0, middle.bit_length() - 220)  # 220 bits are more than 60 digits
        term = Decimal(middle >> low) * Decimal(2) ** (low - n)
        inner = Decimal(0) if n % 2 else term
        lower = i - 1 if n % 2 == 0 else i
        term = term * i / (n - i + 1) if n % 2 == 0 else term
        while lower > k:
            inner += 2 * term
            term = term * lower / (n - lower + 1)
            lower -= 1
        return float(min(Decimal(1), 1 - inner))


def test_exact_binomial(spark):
    counts = [(0, 0), (0, 1), (5, 5), (12, 127), (3, 9), (700, 600), (0, 1100), (4000, 4200), (15, 15), (15, 17), (16, 18), (16, 2000), (17, 1200), (1, 5000), (999, 1000), (900, 1100), (30, 70), (None, 3)]
    rng = random.Random(2)
    counts += [(x := rng.randrange(1000), rng.randrange(2000 - x)) for _ in range(60)]
    df = spark.createDataFrame(counts, "a long, b long")
    for a, b, got in df.select("a", "b", paired.exact_binomial(F.col("a"), F.col("b"))).collect():
        if a is None:
            assert got is None
            continue
        n, k = a + b, min(a, b)
        want = 1.0 if n == 0 else float(min(Fraction(1), Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n)))
        assert got == pytest.approx(want, rel=1e-12), (a, b)


def test_exact_binomial_of_many_pairs(spark):
    for n, k in [(10**6, 499_000), (10**5, 49_500), (10**5 + 1, 50_000), (10**5 + 1, 49_321)]:
        got = spark.range(1).select(paired.exact_binomial(F.lit(k), F.lit(n - k))).first()[0]
        assert got == pytest.approx(tail_of_half(n, k), rel=1e-12)
    # a billion and far beyond: the normal distribution's tail with a correction for whole numbers is near
    n = 10**9
    rows = spark.range(2000).select((F.lit(n // 2) - 10 * F.col("id")).alias("k")).withColumn("p", paired.exact_binomial(F.col("k"), n - F.col("k")))
    began = time.time()
    for k, p in rows.collect():
        assert p == pytest.approx(min(1.0, math.erfc((n / 2 - k - 0.5) / math.sqrt(n / 2))), rel=1e-6)
    assert time.time() - began < 20  # 2,000 rows: milliseconds each
    assert spark.range(1).select(paired.exact_binomial(F.lit(4 * 10**17), F.lit(4 * 10**17 + 10**9))).first()[0] == pytest.approx(math.erfc(10**9 / math.sqrt(2 * 8 * 10**17)), rel=1e-6)
    assert spark.range(1).select(paired.exact_binomial(F.lit(3), F.lit(10**12))).first()[0] == 0


def test_percentiles_match_numpy_with_a_hot_group_nulls_and_ties(spark):
    rng = random.Random(6)
    rows = [("hot", float(rng.randrange(3000))) for _ in range(6000)] + [(rng.choice(["a", "b", None]), rng.choice([0.0, 1.5, 7.25, None])) for _ in range(60)] + [("nulls", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    at = [0, 0.1, 0.25, 0.5, 0.75, 0.99, 1]
    for ranges in (4, 64):
        got = {r.g: list(r)[1:] for r in metrics.percentiles(df, F.col("x"), at, ["g"], ranges).collect()}
        for g in {g for g, _ in rows}:
            values = [x for k, x in rows if k == g and x is not None]
            assert got.pop(g) == (pytest.approx([np.quantile(values, p) for p in at]) if values else [None] * len(at))
        assert not got
    whole = metrics.percentiles(df, F.col("x"), [0.5]).collect()
    assert [r.p50 for r in whole] == [np.quantile([x for _, x in rows if x is not None], 0.5)]
    assert [tuple(r) for r in metrics.percentiles(df.limit(0), F.col("x"), [0.5]).collect()] == [(None,)]


def test_percentiles_sort_only_the_ranges_that_hold_a_rank(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("g"), F.xxhash64("id").cast("double").alias("x"))
    out = metrics.percentiles(df, F.col("x"), [0.5], ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan.replace("percentile_approx(", "") and "_range" in plan
    values = np.array([r.x for r in df.collect()])
    assert out.first().p50 == pytest.approx(np.quantile(values, 0.5))


def test_numbers_of_all_rows(spark):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(700))).alias("x"), "id").repartition(7)
    out = ranking.numbered(df, [F.col("x").desc(), F.col("id")])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.number, r.x, r.id) for r in out.collect())
    assert [n for n, *_ in got] == list(range(1, 5001))
    assert [(x, i) for _, x, i in got] == sorted(((x, i) for _, x, i in got), key=lambda t: (-t[0], t[1]))
    assert ranking.numbered(df.limit(0), [F.col("id")]).count() == 0
    ids = ranking.sequence_ids(df.limit(3).select("id"), "run_", [], [F.col("id")], 2).orderBy("id").collect()
    assert [r.sequence_id for r in ids] == ["run_01", "run_02", "run_03"]


@pytest.mark.parametrize("rule", metrics.EMPTY_RULES)
def test_micro_scores_without_predictions(spark, rule):
    df = spark.createDataFrame([(0, 0, 3), (0, 0, 0)], "tp long, fp long, fn long")
    got = metrics.micro_scores(df, F.col("tp"), F.col("fp"), F.col("fn"), empty=rule).first()
    assert got.precision == {"zero": 0.0, "one_if_expected": 1.0, "one_if_nothing_expected": 0.0, "null": None}[rule]
    none = metrics.micro_scores(df.filter("fn = 0"), F.col("tp"), F.col("fp"), F.col("fn"), empty=rule).first()
    assert none.precision == {"zero": 0.0, "one_if_expected": None, "one_if_nothing_expected": 1.0, "null": None}[rule]


def test_totals_agree_over_levels(spark):
    df = spark.createDataFrame([(a, b, a == b) for a in "xyz" for b in "xy"], "a string, b string, c boolean")
    got = metrics.grouped_levels(df, [[], ["a"], ["a", "b"]], F.count("*").alias("n")).collect()
    totals = Counter()
    for r in got:
        totals[r.scope] += r.n
    assert totals == {"overall": 6, "a": 6, "a x b": 6}


def test_latest_and_duplicates(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 9, "n")], "k string, s int, v string")
    assert {r.k: r.v for r in ranking.latest(df, ["k"], [F.col("s")]).collect()} == {"a": "y", "b": "z"}
    assert [r.k for r in ranking.duplicates(df, ["k"]).collect()] == ["a"]


def test_representatives_are_distinct(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(6)], "k long, odd int")
    got = ranking.representatives(df, [("odd", F.col("odd") == 1), ("any", F.col("k") >= 1), ("none", F.lit(False))], "k", [F.col("k")]).collect()
    assert {r.spec: r.k for r in got} == {"odd": 1, "any": 2}


def test_balanced_choice(spark):
    df = spark.createDataFrame([(1, i, ["a", "b", "c"]) for i in range(7)], "g int, i int, options array<string>")
    used = Counter(r.chosen for r in ranking.balanced_choice(df, ["g"], ["i"], "options", "s").collect())
    assert max(used.values()) - min(used.values()) <= 1


def test_transitions_and_baselines(spark):
    df = spark.createDataFrame([(1, "C0", True), (1, "C1", False), (2, "C0", True), (2, "C1", True), (3, "C1", True)], "u int, c string, f boolean")
    base = {(r.u, r.c): r.baseline for r in paired.with_baseline(df, ["u"], "c", "C0", "f").collect()}
    assert base == {(1, "C0"): True, (1, "C1"): True, (2, "C0"): True, (2, "C1"): True, (3, "C1"): None}
    t = paired.paired_table(df, ["u"], "c", "C0", "C1", "f").first()
    assert (t.paired_n, t.both, t.left_only, t.right_only, t.neither, t.delta_points) == (2, 1, 1, 0, 0, -50.0)


def test_audits(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(2,), (3,)], "k long")
    assert {(r.k, r.side) for r in audit.completeness(a, b, ["k"]).collect()} == {(1, "missing"), (3, "extra")}
    with pytest.raises(ValueError, match="incomplete"):
        evaluation.checked(a, b, ["k"])
    assert audit.same_rows(a, a).count() == 0
    with pytest.raises(ValueError, match="twice"):
        audit.assert_empty(ranking.duplicates(a.union(a), ["k"]), "twice")


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], "a"), (2, [4.0, 3.0], "a"), (3, [-3.0, -4.0], "b")], "k long, v array<double>, l string")
    pairs = {(r.k_i, r.k_j): r.cosine for r in vectors.cosine_pairs(df, "k", "v", ["l"]).collect()}
    assert pairs == pytest.approx({(1, 2): 0.96, (1, 3): -1.0, (2, 3): -0.96})
    p = df.select(vectors.softmax(F.col("v")).alias("p")).first().p
    assert sum(p) == pytest.approx(1)
    with pytest.raises(Exception, match="zero vector"):
        df.select(vectors.unit(F.array(F.lit(0.0)))).collect()


def test_principal_axes_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1]) @ rng.normal(size=(6, 6)) + 7
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(400, None)], "k long, v array<double>").repartition(5)
    mean, axes, variances = vectors.principal_axes(df, "v", 6, 3)
    values, want = np.linalg.eigh(np.cov(x.T, bias=True))
    assert mean == pytest.approx(x.mean(axis=0).tolist()) and variances == pytest.approx(values[::-1][:3].tolist())
    for got, w in zip(axes, want.T[::-1]):
        assert got == pytest.approx((w * np.sign(w[np.abs(w).argmax()])).tolist(), abs=1e-9)
    out = {r.k: r.pca for r in vectors.projected(df, "v", 6).collect()}
    assert out.pop(400) is None and all(out[i] == pytest.approx(((x[i] - x.mean(axis=0)) @ np.array(axes[:2]).T).tolist(), abs=1e-8) for i in out)
    assert np.allclose(np.ravel(vectors.principal_axes(df, "v", 6, 3)[1]), np.ravel(axes))


def test_principal_axes_query_matches_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    axes = [w * np.sign(w[np.abs(w).argmax()]) for w in axes.T[::-1][:2]]
    got = {r.vec_id: (r.x, r.y) for r in catalog.QUERIES["principal_axes"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r, v in zip(rows, x):
        assert got[r.vec_id] == pytest.approx([(v - x.mean(axis=0)) @ a for a in axes], abs=2e-6)


@pytest.mark.parametrize("limit", [vectors.ASKED_BYTES, 0])
def test_asked_cosines(spark, limit):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(90)] + [(90, None), (7, [1.0] * 6)]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(3)
    out = vectors.asked_cosines(df, "k", "v", F.col("k") % 10 == 0, {"whole": slice(None), "half": slice(0, 3)}, limit)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got = sorted((r.k_i, r.k_j, r.whole, r.half) for r in out.collect())
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = sorted((i, j, cos(a, b), cos(a[:3], b[:3])) for i, a in rows if i % 10 == 0 and a for j, b in rows if j != i and b)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want])
    with pytest.raises(Exception, match="zero vector"):
        vectors.asked_cosines(df.union(spark.createDataFrame([(10, [0.0] * 6)], df.schema)), "k", "v", F.col("k") % 10 == 0, broadcast_bytes=limit).collect()
    assert vectors.asked_cosines(df, "k", "v", F.col("k") > 1000, broadcast_bytes=limit).count() == 0


def all_cosines(spark):
    """ids, labels and the matrix of all cosines of the smallest embeddings, in order of ids."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return [r.vec_id for r in rows], np.array([r.label for r in rows]), x, u @ u.T


def pairs_of(c, ids):
    """What a matrix holds of every 50th vector with every other one."""
    return {(ids[i], ids[j]): c[i, j] for i in range(len(ids)) if ids[i] % 50 == 0 for j in range(len(ids)) if j != i}


def test_gaps_and_families_are_of_all_vectors(spark):
    _, label, _, cos = all_cosines(spark)
    i, j = np.triu_indices(len(label), 1)
    c, same = cos[i, j], label[i] == label[j]
    got = value_queries.group_pair_gap(spark, SF).first()
    assert (got.within_n, got.between_n) == (same.sum(), (~same).sum())
    want = (c[same].mean(), c[~same].mean(), c[same].std(), c[~same].std(), c[same].mean() - c[~same].mean())
    assert (got.within, got.between, got.within_sd, got.between_sd, got.gap) == pytest.approx(want, abs=2e-6)
    family = {r.group: r for r in linking_queries.family_matrix(spark, SF).collect()}
    assert set(family) == set(label)
    for a in family:
        for d in range(4):
            both = np.outer(label == a, label == d) & ~np.eye(len(label), dtype=bool)
            assert family[a][f"with_{d}"] == pytest.approx(cos[both].mean(), abs=2e-6)
    layers = {r.layer: r.gap for r in linking_queries.layerwise_gap(spark, SF).collect()}
    assert set(layers) == {k // 60 + 1 for k in range(len(label))}
    for n, gap in layers.items():
        here = (i // 60 + 1 == n) & (j // 60 + 1 == n)
        assert gap == pytest.approx(c[here & same].mean() - c[here & ~same].mean(), abs=2e-6)


def test_neighbours_and_matrices_reach_all_vectors(spark):
    ids, label, x, cos = all_cosines(spark)
    near = label[np.where(np.eye(len(ids), dtype=bool), -2, cos).argmax(axis=1)]
    want = {k: ((label == k).sum(), ((label == k) & (near == k)).sum()) for k in set(label)}
    assert {r.label: (r.n, r.agree) for r in value_queries.nn1_label_agreement(spark, SF).collect()} == want
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert {r.label: (r.n, r.agree) for r in vectors.nearest_agreement(e, "vec_id", "embedding", "label", block=100).collect()} == want
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    middle, half = unit(x - x.mean(axis=0)), unit(x[:, :32])
    for query, c, name in ((value_queries.cosine_pairs, cos, "cosine"), (value_queries.centered_cosine, middle @ middle.T, "cosine"), (linking_queries.matrix_difference, cos - half @ half.T, "change")):
        assert {(r.vec_id_i, r.vec_id_j): r[name] for r in query(spark, SF).collect()} == pytest.approx(pairs_of(c, ids), abs=2e-6)


def test_nearest_of_clustered_vectors_meets_few(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 25, axis=0) + 0.02 * rng.normal(size=(1000, 16))
    x[500] = x[20]  # copies, and one of three times the length
    x[501] = 3 * x[20]
    ids = rng.permutation(5000)[:1000]
    df = spark.createDataFrame([(int(i), v.tolist(), f"c{n // 25}") for n, (i, v) in enumerate(zip(ids, x))] + [(9999, None, "none")], "k long, v array<double>, l string").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 12)
    np.fill_diagonal(cos, -2)
    got = {r.k: r for r in vectors.nearest_others(df, "k", "v", "l", block=100).collect()}
    assert set(got) == set(ids.tolist())
    for n, i in enumerate(ids.tolist()):
        best = cos[n].max()
        assert got[i].cosine == pytest.approx(best, abs=1e-11)
        assert got[i].ok in ids[cos[n] >= best - 3e-12]
    for n in (20, 500, 501):
        assert got[int(ids[n])].ok == min(int(ids[m]) for m in (20, 500, 501) if m != n)
    share = sum(r.met for r in got.values()) / (1000 * 999)
    assert share < 0.2, share


def test_nearest_among_groups_of_copies(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = rng.integers(-3, 4, (60, 4)).astype(float)
    base = base[np.abs(base).sum(axis=1) > 0]
    x = np.concatenate([np.repeat(base[:1], 400, axis=0), base[rng.integers(0, len(base), 500)], rng.normal(size=(100, 4))])
    ids = rng.permutation(9000)[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist(), None if i % 7 == 0 else f"c{i % 5}") for i, v in zip(ids, x)], "k long, v array<double>, l string").repartition(5)
    labels = {r.k: r.l for r in df.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 12)
    np.fill_diagonal(cos, -2)
    want = {}
    for n, i in enumerate(ids.tolist()):
        want[i] = min(ids[cos[n] >= cos[n].max() - 3e-12].tolist())
    for hot in (10_000, 20):  # without and with groups dealt over salts
        monkeypatch.setattr(vectors, "COPIES", hot)
        got = vectors.nearest_others(df, "k", "v", "l", block=50).collect()
        assert len(got) == len(ids) and {r.k: r.ok for r in got} == want
        assert all(r.ol == labels[r.ok] and r.l == labels[r.k] for r in got)
        assert max(r.met for r in got) < 200  # of 400 copies and as many others
    only = df.filter(F.col("k").isin(sorted(ids[:400].tolist())[:2]))  # nothing but copies
    assert {(r.k, r.ok, r.cosine) for r in vectors.nearest_others(only, "k", "v", "l").collect()} == {(a, b, 1.0) for a, b in itertools.permutations(sorted(ids[:400].tolist())[:2])}


def test_gaps_without_pairs(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], "a"), (2, [3.0, 4.0], "a"), (3, [1.0, 0.0], None), (4, None, "b")], "k long, v array<double>, l string")
    got = vectors.all_pairs_gap(df, "v", "l", 2).first()
    assert (got.within_n, got.between_n, got.within, got.between) == (2 - 1, 0, pytest.approx(1), None)
    assert got.within_sd == pytest.approx(0, abs=1e-6) and got.between_sd is None
    assert vectors.all_pairs_gap(df.filter("false"), "v", "l", 2).first().within_n == 0
    assert {(r.l, r.n, r.agree) for r in vectors.nearest_agreement(df, "k", "v", "l").collect()} == {("a", 2, 2), (None, 1, 0)}


def test_whole_texts_of_all_documents_are_normalised(spark, tmp_path):
    text = "A, b! " * 60 + "Ünd das ENDE."
    rows = [(1, text, "en"), (2, text, "de"), (3, "x\t-- Y", None), (4, None, "en"), (5, "", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.normal for r in value_queries.normalize_text(spark, f"file://{tmp_path}").collect()}
    whole = "a b " * 60 + "nd das ende"
    assert got == {1: whole, 2: whole, 3: "x y", 4: None, 5: ""}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: None if r.text is None else re.sub("[^a-z0-9]+", " ", r.text.lower()).strip() for r in docs}
    assert {r.doc_id: r.normal for r in value_queries.normalize_text(spark, SF).collect()} == want


def test_quantised_duplicates_agree_in_every_component(spark, tmp_path):
    v = [0.01 + i / 64 for i in range(64)]
    rows = [(1, v, 0), (2, [*v[:63], v[63] + 1], 1), (3, [x + 1e-4 for x in v], 2), (4, [*v[:2], *(-x for x in v[2:])], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = metric_queries.near_duplicate_quantized(spark, f"file://{tmp_path}").collect()
    assert [(r.n, r.splits) for r in got] == [(2, [0, 2])]


def test_decoders_take_all_components(spark):
    ids, _, x, _ = all_cosines(spark)
    total = np.log(np.exp(x).sum(axis=1))
    got = {r.vec_id: r for r in value_queries.softmax_decode(spark, SF).collect()}
    marginal = np.log(np.exp(x.reshape(-1, 8, 8)).sum(axis=2))
    two = {r.vec_id: r for r in value_queries.logsumexp_marginal(spark, SF).collect()}
    assert set(got) == set(two) == set(ids)
    for n, k in enumerate(ids):
        assert got[k].choice == x[n].argmax()
        assert (got[k].p, got[k].total, got[k].ce) == pytest.approx((np.exp(x[n].max() - total[n]), total[n], total[n] - x[n, 0]), abs=2e-6)
        d = marginal[n].argmax()
        assert (two[k].direction, two[k].distance) == (d, x[n].reshape(8, 8)[d].argmax())
        assert two[k].marginal == pytest.approx(marginal[n, d], abs=2e-6)


def test_losses(spark):
    logits = F.array(*map(F.lit, (1.0, 2.0, 0.5)))
    ok = F.array(F.lit(False), F.lit(True), F.lit(True))
    r = spark.range(1).select(vectors.acceptable_nll(logits, ok), vectors.cross_entropy(logits, F.lit(1)), vectors.smooth_l1(F.lit(0.5)), vectors.smooth_l1(F.lit(-3.0)), vectors.safe_bounds(F.lit(0.0), F.lit(1.0), 0.1)).first()
    z = sum(map(math.exp, (1.0, 2.0, 0.5)))
    assert list(r)[:4] == pytest.approx([math.log(z / (math.exp(2) + math.exp(0.5))), math.log(z) - 2, 0.125, 2.5])
    assert tuple(r[4]) == (0.1, 0.9)


def test_scene_round_trip(spark):
    px = spark.createDataFrame([(1, 3.0, 4.0, 2.0), (1, 30.0, 14.0, 1.5)], "scene_id long, u double, v double, depth double")
    turn = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    there = scene.backproject(px, 50, 60, 20, 10, turn, [1, 2, 3]).select("scene_id", "x", "y", "z")
    back = scene.project(there, 50, 60, 20, 10, turn, [1, 2, 3]).orderBy("u").collect()
    assert [(round(r.u, 9), round(r.v, 9), round(r.depth, 9)) for r in back] == [(3, 4, 2), (30, 14, 1.5)]


def test_samples_repeat_short_roles(spark):
    pts = spark.createDataFrame([(1, "a", i) for i in range(3)] + [(1, "b", i) for i in range(40)], "scene_id long, role string, point_id long")
    got = scene.sample_points(pts, 8, "s").collect()
    assert Counter(r.role for r in got) == {"a": 8, "b": 8}
    assert len({r.point_id for r in got if r.role == "b"}) == 8
    assert sorted(Counter(r.point_id for r in got if r.role == "a").values()) == [2, 3, 3]


def test_translation_candidates_match_stepping(spark):
    """Every candidate clears the corridor, and no shorter step does."""
    got = value_queries.translation_candidates(spark, SF).collect()
    boxes = {}
    for r in value_queries.boxes(spark, SF).collect():
        boxes.setdefault(r.scene_id, {}).setdefault(r.object_id, []).append(tuple(r.o))
    angle = {"RIGHT": 0, "BACK_RIGHT": 45, "BACK": 90, "BACK_LEFT": 135, "LEFT": 180, "FRONT_LEFT": 225, "FRONT": 270, "FRONT_RIGHT": 315}
    assert got
    for r in got:
        t, b = min(boxes[r.scene_id][1]), min(boxes[r.scene_id][2])
        strip = (t[0] - 0.01, -0.3, t[2] + 0.01, t[1])
        vx, vy = math.cos(math.radians(angle[r.direction])), math.sin(math.radians(angle[r.direction]))

        def over(d, b=b, strip=strip, vx=vx, vy=vy):
            q = (b[0] + vx * d, b[1] + vy * d, b[2] + vx * d, b[3] + vy * d)
            return max(0, min(q[2], strip[2]) - max(q[0], strip[0])) * max(0, min(q[3], strip[3]) - max(q[1], strip[1]))

        assert over(r.distance) <= 1e-9
        assert r.distance <= 0.0011 or over(r.distance - 0.001) > 0
        assert r.distance <= r.limit


def test_path_check(spark):
    def sq(x, y):
        return [(x - 1.0, y - 1.0), (x + 1.0, y - 1.0), (x + 1.0, y + 1.0), (x - 1.0, y + 1.0)]

    kind = "array<struct<x:double,y:double>>"
    moves = spark.createDataFrame([(1, 1, sq(0, 0), 0.0, 10.0), (1, 2, sq(0, 0), 90.0, 3.0), (1, 3, sq(0, 0), 270.0, 30.0)], f"scene_id int, move_id int, polygon {kind}, degrees double, distance double")
    obstacles = spark.createDataFrame([(1, 7, sq(5, 0))], f"scene_id int, object_id int, polygon {kind}")
    got = {r.move_id: r for r in scene.path_check(moves, obstacles, (-20, 20, -20, 20), 0.5).collect()}
    assert (got[1].first_step, got[1].hits, got[1].outside) == (6, [7], False)
    assert got[2].clear and got[2].first_step is None
    assert got[3].outside and got[3].hits == []


def square(x, y, h=1.0):
    return [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]


def test_path_check_turns(spark):
    kind = "array<struct<x:double,y:double>>"
    moves = [(1, 1, "ROTATE", square(0, 0), -1.0, 90.0), (1, 2, "ROTATE", square(0, 10), 1.0, 725.0), (1, 3, "LIFT", square(0, 0), 0.0, 5.0), (1, 4, "TRANSLATE", square(0, 0), 180.0, 0.6), (2, 5, "TRANSLATE", square(0, 0), 0.0, 0.0)]
    moves = spark.createDataFrame(moves, f"scene_id int, move_id int, action string, polygon {kind}, degrees double, distance double")
    objects = spark.createDataFrame([(1, 1, square(0, 0)), (1, 8, square(2.2, 0)), (1, 9, square(0, 2.2))], f"scene_id int, object_id int, polygon {kind}")
    got = {r.move_id: r for r in scene.path_check(moves, objects, (-20, 20, -20, 20), action=F.col("action"), mover=F.lit(1)).collect()}
    # Half a side of 1 reaches 1.2 once cos + sin is 1.2, which is between 10 and 15 degrees.
    assert (got[1].steps, got[1].first_step, got[1].executed, got[1].hits, got[1].outside) == (18, 3, 3, [8, 9], False)
    assert math.isclose(got[1].fraction, 15 / 90) and not got[1].clear
    assert (got[2].steps, got[2].executed, got[2].clear) == (72, 72, True) and math.isclose(got[2].fraction, 360 / 725)
    assert (got[3].steps, got[3].executed, got[3].hits, got[3].fraction) == (1, 1, [], 1.0) and got[3].footprint[0].x == -1
    # The last substep is the rest of the way, no third of it.
    assert (got[4].steps, got[4].clear, got[4].fraction) == (3, True, 1.0) and math.isclose(got[4].footprint[0].x, -1.6)
    assert (got[5].steps, got[5].clear, got[5].fraction) == (1, True, 1.0)


def test_payloads(spark):
    kind = "array<struct<x:double,y:double>>"
    objects = [(1, 1, square(0, 0)), (1, 2, square(4, 0)), (1, 3, square(0, -9)), (2, 1, square(0, 0))]
    objects = spark.createDataFrame(objects, f"scene_id int, object_id int, polygon {kind}").withColumn("centre", G.centroid(F.col("polygon")))
    targets = objects.filter("object_id = 1").select("scene_id", F.lit(1).alias("target_id"))
    (r,) = scene.relation_payloads(objects, targets).collect()
    assert [(n.object_id, n.surface_gap_cm, n.center_bearing_deg) for n in r.R_NUMERIC] == [(2, 2.0, 0.0), (3, 7.0, 270.0)]
    assert [len(n.occupied_angular_sectors_deg) for n in r.R_NUMERIC] == [2, 1]
    assert [(w.center_direction, w.occupied_target_sides, w.clearance_zone) for w in r.R_QUALITATIVE_D4] == [("RIGHT", ["RIGHT"], "CLEARANCE_ZONE_OVERLAP"), ("FRONT", ["FRONT"], "CLEARANCE_ZONE_CLEAR")]
    assert [w.center_direction for w in r.R_QUALITATIVE_D8] == ["RIGHT", "FRONT"]
    got = {(m.scene_id, m.object_id): m for m in scene.motion_payloads(objects, (-20, 20, -20, 20), G.D4).collect()}
    assert got[1, 1].F_NUMERIC == {"RIGHT": 2.0, "BACK": 19.0, "LEFT": 19.0, "FRONT": 7.0}
    assert got[1, 1].F_QUALITATIVE == {"RIGHT": "TIGHT", "BACK": "OPEN", "LEFT": "OPEN", "FRONT": "LIMITED"}
    assert got[1, 1].M_NUMERIC == {"RIGHT": 1, "BACK": 19, "LEFT": 19, "FRONT": 6}
    assert got[1, 1].M_QUALITATIVE["RIGHT"] == "SHORT" and got[1, 1].turn_deg == {"CW": 180, "CCW": 180} and got[1, 1].turn_level["CW"] == "LARGE"
    assert len(got) == 4 and got[2, 1].F_NUMERIC["RIGHT"] == 19.0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n{"k": \n')
    good = io.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "k long")
    assert sorted(r.k for r in good.collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        io.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", "k long").collect()
    rows, broken = io.quarantined(io.read_jsonl(spark, f"file://{tmp_path}/bad.jsonl", "k long", strict=False).cache())
    assert rows.count() == 1 and broken.count() == 1
    assert io.read_jsonl(spark, f"file://{tmp_path}/none.jsonl", "k long", missing_ok=True).count() == 0
    m = {r.path.rsplit("/", 1)[1]: r for r in io.manifest(spark, f"file://{tmp_path}").collect()}
    assert m["a.jsonl"].records == 2 and m["a.jsonl"].size == 19
    io.write_csv(spark.createDataFrame([(1, [2, 3])], "a int, b array<int>"), f"file://{tmp_path}/csv", ["b", "a", "c"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first().asDict() == {"b": "[2,3]", "a": "1", "c": None}
    assert io.markdown(spark.createDataFrame([(1, "x|y")], "a int, b string")).splitlines()[2] == "| 1 | x\\|y |"


def asks(folder):
    """How often each key was asked for, from the files that the client left."""
    return Counter(int(f.name.split("-")[0]) for f in folder.iterdir())


def test_rows_are_asked_again_until_they_are_valid(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    schedule = spark.createDataFrame([(k, f"q{k}") for k in range(20)] + [(3, "q3")], "k long, q string").repartition(3)

    def call(part):
        import uuid

        if 5 in set(part.k):  # a row that no client answers takes its whole batch down
            for k in part.k if len(part) == 1 else []:
                (calls / f"{k}-{uuid.uuid4()}").touch()
            raise RuntimeError("overloaded")
        out = []
        for k in part.k:
            (calls / f"{k}-{uuid.uuid4()}").touch()
            tried = len([f for f in calls.iterdir() if f.name.startswith(f"{k}-")])
            out.append("nonsense" if k % 4 == 1 and tried == 1 else None if k == 7 and tried < 3 else f'{{"a": {k}}}')
        return out

    def valid(text):
        return json.loads(text)["a"] >= 0

    log = f"file://{tmp_path}/log"
    out = {r.k: r for r in evaluation.run_pending(schedule, log, ["k"], call, valid, attempts=3, batch=4).collect()}
    assert set(out) == set(range(20))
    assert all(json.loads(r.response) == {"a": k} and r.error is None for k, r in out.items() if k != 5)
    assert (out[5].response, out[5].error, out[5].attempt) == (None, "overloaded", 3)
    assert {k: r.attempt for k, r in out.items() if r.attempt > 1} == {1: 2, 5: 3, 7: 3, 9: 2, 13: 2, 17: 2}
    assert asks(calls) == Counter({k: 1 for k in range(20)}) + Counter({1: 1, 9: 1, 13: 1, 17: 1, 5: 2, 7: 2})
    again = evaluation.run_pending(schedule, log, ["k"], call, valid, attempts=3)  # nothing is left to ask
    assert again.count() == 20 and asks(calls).total() == 28


def test_a_killed_run_goes_on(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    schedule = spark.createDataFrame([(k,) for k in range(8)], "k long")
    log = f"file://{tmp_path}/log"
    spark.createDataFrame([(0, "yes", None, 1), (1, None, "no answer", 1), (2, None, "lost", 3), (99, "other", None, 1)], "k long, response string, error string, attempt int").write.parquet(log)

    def call(part):
        for k in part.k:
            (calls / f"{k}-x").touch(exist_ok=False)
        return [f"r{k}" for k in part.k]

    out = {r.k: (r.response, r.attempt) for r in evaluation.run_pending(schedule, log, ["k"], call).collect()}
    assert out == {0: ("yes", 1), 1: ("r1", 2), 2: (None, 3)} | {k: (f"r{k}", 1) for k in range(3, 8)}
    assert set(asks(calls)) == {1, 3, 4, 5, 6, 7}


def test_equal_inputs_are_computed_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k long, c string")
    out = io.content_cached(df, F.col("c"), lambda d: d.withColumn("up", F.upper("c")))
    assert {r.k: r.up for r in out.collect()} == {1: "A", 2: "B", 3: "A"}


def test_stream_resumes(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    src.mkdir()

    def step(name, lines):
        (src / name).write_text("\n".join(lines))
        rows = log.first_writes(log.follow(spark, f"file://{src}", "k long, t timestamp, correct boolean"), ["k"], "t", "1 hour")
        log.append_to(rows, f"file://{out}", f"file://{mark}").awaitTermination()
        return sorted(r.k for r in spark.read.schema("k long").json(f"file://{out}").collect())

    at = datetime(2024, 1, 1).isoformat()
    line = lambda k: f'{{"k": {k}, "t": "{at}", "correct": true}}'
    assert step("a.json", [line(1), line(1), line(2)]) == [1, 2]
    assert step("b.json", [line(2), line(3)]) == [1, 2, 3]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_run(spark, name):
    catalog.QUERIES[name](spark, SF).limit(5).collect()


def test_known_answer(spark):
    got = {r.event_type: (r.paired_n, r.lost, r.gained, round(r.p_value, 6)) for r in catalog.QUERIES["mcnemar_exact"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {"click": (599, 73, 79, 0.685209), "error": (569, 68, 70, 0.932202), "purchase": (557, 73, 58, 0.221116), "signup": (588, 71, 70, 1.0)}


def test_a_slide_that_ends_at_its_limit_is_not_free(spark):
    """0.138 - 0.002 - 0.086 is 0.05 and two units in the last place more: a slide of 0.05 would touch."""
    box = lambda x0, x1: G.rect(F.lit(x0), F.lit(0.0), F.lit(x1), F.lit(0.05))
    one = spark.range(1).select(F.lit(1).alias("scene_id"), G.rect(F.lit(-0.2), F.lit(0.1), F.lit(-0.1), F.lit(0.2)).alias("target"), box(0.036, 0.086).alias("blocker"), F.lit(1.0).alias("vx"), F.lit(0.0).alias("vy"))
    moves = one.withColumn("distance", F.explode(F.array(F.lit(0.05), F.lit(0.0499))))
    bounds = G.rect(*(F.lit(b) for b in (-0.3, -0.3, 0.3, 0.3)))
    for distance, free in ((0.05, False), (0.0499, True)):
        (r,) = scene.static_validity(moves.filter(F.col("distance") == distance), one.select("scene_id", box(0.138, 0.2).alias("o")), bounds, 0.01).collect()
        assert r.clearance_limit > 0.05 and r.collision_free is free
    (m,) = scene.catalogue_masks(one.withColumn("direction", F.lit("RIGHT")), one.select("scene_id", box(0.138, 0.2).alias("o")), moves.select("distance"), bounds, 0.01).collect()
    assert m.allowed == [0.0499]
