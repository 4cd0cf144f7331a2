"""Quality rules, the filter audit and periodic runs against brute force."""

import random
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from evalquarry.llm import filter_audit, periodic_runs, queries, quality_rules

from .data import awkward, clashing, documents

SPACE = " \t\n\x0b\f\r"


def split(text):
    return "".join(" " if c in SPACE else c for c in text or "").split(" ")


def words_of(text):
    return [w for w in split(text) if w]


# quality rules


def plain_measures(text):
    text, w = text or "", words_of(text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = Counter(grams)
    hit = {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    stops = sum(x.rstrip(".,;:!?").lower() in quality_rules.STOP_WORDS for x in w)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_capitals": sum("A" <= c <= "Z" for c in text), "n_stop_words": stops, "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_bullet_lines": sum(x[0] in "-*•" for x in lines), "n_cut_lines": sum(x.endswith(("...", "…")) for x in lines), "n_repeat_words": len(hit),
    }


def plain_verdict(m):
    failed = []
    for rule in (*quality_rules.BASE, *quality_rules.RULES):
        of = 1 if rule.of == "one" else m[rule.of]
        if (rule.least is not None and m[rule.measure] * 100 < rule.least * of) or (rule.most is not None and m[rule.measure] * 100 > rule.most * of):
            failed.append(rule.name)
    return failed


TRICKY = ["a b c d e f g h " * 2, "a b c d e f g h", "x " * 8, "x " * 9, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "- one\n- two\n* three\n\n \n- one", "cut...\ncut…\nnot cut", "#$ <b> | & 100 % *", "ÀÉ the, The! THE. der die das", "a\rb\x0bc\fd e f", "line\r\nline\nline\r\n"]


def test_rules_match_a_plain_version(spark):
    rows = awkward() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(TRICKY)]
    got = quality_rules.apply_rules(clashing(documents(spark, rows), "failed_rules", "n_words", "_text", "_words", "kept")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_measures(r.text)
        assert {k: r[k] for k in want} == want, (r.doc_id, r.text and r.text[:50])
        failed = plain_verdict(want)
        assert (r.failed_rules, r.kept) == (failed, not failed)
        assert r.base_failed == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert r.id == "taken"  # a clashing column of another name passes through


def test_rules_keep_prose_and_reject_junk(spark):
    prose = "The river was high in the spring and the people of the town went to the hills. " + " ".join(f"word{i} of the place{i}" for i in range(40))
    rows = [(1, prose, "en", "s", 1), (2, prose.upper(), "en", "s", 1), (3, " | ".join(f"cell{i}" for i in range(60)), "en", "s", 1), (4, "the same line of words\n" * 30, "en", "s", 1), (5, " ".join(f"list{i}" for i in range(60)), "en", "s", 1)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(documents(spark, rows)).collect()}
    assert [got[i].kept for i in range(1, 6)] == [True, False, False, False, False]
    assert "few_capitals" in got[2].failed_rules and "few_symbols" in got[3].failed_rules and "stop_words" in got[5].failed_rules
    assert quality_rules.apply_rules(documents(spark, [])).count() == 0


def test_the_rules_are_one_projection(spark):
    plan = quality_rules.apply_rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# the filter audit


def plain_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails = []
    for i, text, lang in docs:
        text = text or ""
        w = words_of(text)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text)}
        f["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails.append((lang or "", {k for k in f if f[k]}, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [(f, g, t) for p, f, g, t in fails if p == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                here = [x for x in left if k in x[0]]
                left = [x for x in left if k not in x[0]]
                removed_by[k] += len(here)
                failing = sum(k in f for f, _, _ in mine)
                out[part, "".join(order), step] = [len(left), len(here), failing - len(here), sum(f == {k} for f, _, _ in mine), sum(g for _, g, _ in here), sum(t for _, _, t in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def test_audit_matches_a_simulation_of_all_orders(spark):
    rng = random.Random(3)
    docs = [(r[0], r[1], r[2]) for r in awkward()]
    for i in range(150):
        n = rng.choice([3, 199, 200, 260])
        text = " ".join(rng.choice(["the", "word", "X", "A$", "b"]) + (str(rng.randrange(400)) if i % 3 else "") for _ in range(n))
        docs.append((1000 + i, docs[-1][1] if i % 7 == 0 else text, rng.choice(["en", "de", None, ""])))
    docs.append(docs[5])  # a repeated row
    labels = [(d[0], rng.randrange(2), rng.randrange(2)) for d in docs if rng.random() < 0.6] + [(None, 1, 1), (docs[9][0], None, 1)]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string, lang string"), "part", "mask", "own", "first", "n", "step")
    got = filter_audit.filter_audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want) == 600 * len({d[2] or "" for d in docs})
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(documents(spark, []), none).count() == 0
    one = filter_audit.filter_audit(documents(spark, [(1, None, None, None, None)]), none).collect()
    assert len(one) == 600 and {(r.part, r.removed) for r in one if r.filter_order[r.step - 1] == "A"} == {("", 1)}


def test_polynomials_are_the_multilinear_extension(spark):
    rng = random.Random(8)
    counts = [("p", m, rng.randrange(50), 0, 0) for m in range(32) if m % 5]
    r = filter_audit.removal_polynomials(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long")).select("*", filter_audit.corners("cn").alias("at"), *(filter_audit.shapley("cn", k, 120).alias(f"v{k}") for k in range(5))).first()
    for corner in range(32):
        assert r["at"][corner] == sum(n for _, m, n, *_ in counts if m & corner)
    x = [Fraction(rng.randrange(1, 9), 9) for _ in range(5)]
    inside = Fraction(0)
    for _, m, n, *_ in counts:
        stays = Fraction(1)
        for k in range(5):
            stays *= 1 - x[k] if m >> k & 1 else 1
        inside += n * (1 - stays)
    value = Fraction(0)
    for t in range(32):
        term = Fraction(r["cn"][t])
        for k in range(5):
            term *= x[k] if t >> k & 1 else 1
        value += term
    assert value == inside
    for k in range(5):
        exact = sum(Fraction(n, m.bit_count()) for _, m, n, *_ in counts if m >> k & 1)
        assert r[f"v{k}"] == 120 * exact


def test_audit_shuffles_numbers_not_texts(spark):
    counts = filter_audit.masked(documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert not any("text" in line for line in plan.splitlines() if "Exchange" in line)


# periodic runs


def plain_runs(s, least):
    best = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            k = i
            while k + q < len(s) and s[k] == s[k + q]:
                k += 1
            if k - i >= q and k + q - i >= least:
                best.setdefault((i, k + q), q)
            i = k + 1
    return {(a, b, q) for (a, b), q in best.items()}


def plain_edges(s):
    n, out, alike = len(s), [], []
    for i in range(n):
        j = next((j for j in range(i + 1, n) if s[j:] < s[i:]), n)
        out.append(j)
        alike.append(next((m for m in range(n) if j + m >= n or s[i + m] != s[j + m]), 0))
    return out, alike


def symbols(rng):
    n, k = rng.randrange(1, 60), rng.choice([1, 2, 2, 3, 4])
    s = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.4:
        p = min(rng.randrange(1, 9), n)
        s = [s[i % p] if rng.random() < 0.97 else s[i] for i in range(n)]
    return s


def test_lyndon_edges_and_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        s = symbols(rng)
        assert periodic_runs.smaller_suffixes(s) == plain_edges(s), s
        for least in (1, 12):
            assert periodic_runs.runs_of(s, least) == plain_runs(s, least), s


class Counted(int):
    """A number that counts how often it is compared."""

    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return int.__eq__(self, other)

    def __ne__(self, other):
        Counted.seen += 1
        return int.__ne__(self, other)

    def __lt__(self, other):
        Counted.seen += 1
        return int.__lt__(self, other)

    __hash__ = int.__hash__


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [fibonacci, lambda n: [0] * n, lambda n: [bin(i).count("1") % 2 for i in range(n)], lambda n: [((i + 1) & -(i + 1)).bit_length() for i in range(n)], lambda n: [(i % 97 * i) % 2 for i in range(n)], lambda n: [int(i % 500 == 0) for i in range(n)]])
def test_comparisons_grow_with_the_length_alone(make):
    for n in (2000, 16000):
        Counted.seen = 0
        periodic_runs.smaller_suffixes([Counted(x) for x in make(n)])
        assert Counted.seen < 8 * n


def test_runs_of_texts(spark):
    rng = random.Random(4)
    rows = awkward() + [(200 + i, " ".join(f"w{x}" for x in symbols(rng) + symbols(rng)), None, None, 1) for i in range(60)]
    got = periodic_runs.collapse_runs(clashing(documents(spark, rows), "runs", "collapsed")).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words_of(r.text)
        if len(w) > 5000:
            continue  # brute force is quadratic; the copies below have long texts
        want = sorted(plain_runs(w, 12), key=lambda x: (x[0], x[2]))
        assert [(x["start"], x["start"] + x["length"], x["period"]) for x in r.runs] == want
        gone = {i for a, b, q in want for i in range(a + q, b)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
        assert r.id == "taken"
    assert periodic_runs.collapse_runs(documents(spark, [])).count() == 0


def test_a_long_text_of_one_period(spark):
    period = [f"p{i}" for i in range(1000)]
    text = "before " + " ".join(period * 40 + period[:7]) + " after"
    r = periodic_runs.collapse_runs(documents(spark, [(1, text, None, None, 1)])).first()
    assert [tuple(x) for x in r.runs] == [(1, 40007, 1000)] and r.collapsed == "before " + " ".join(period) + " after"


def test_stretches_follow_the_crc(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37)), None, None, 1) for i in range(200)] + [(None, "x y", None, None, 1), (3, None, None, None, 1)]
    got = {(r.doc_id, r.text) for r in queries.stretches(documents(spark, rows).select("doc_id", "text")).collect()}
    want = set()
    for i, text, *_ in rows:
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        w = words_of(text)
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(w[k if k < a else a + (k - a) % p] for k in range(n))
        want.add((i, text))
    assert got == want


def test_split_words_is_the_pattern(spark):
    texts = [None, "", " ", "a", " a  b\t\n", "a b c\x0bd\x1ce"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(quality_rules.split_words(F.coalesce("t", F.lit(""))).alias("w"))
    assert [r.w for r in df.collect()] == [words_of(t) for t in texts]


def test_every_subset_has_its_corner(spark):
    pairs = list(combinations(range(5), 2))
    counts = [("p", 1 << a | 1 << b, 1, 0, 0) for a, b in pairs]
    r = filter_audit.removal_polynomials(spark.createDataFrame(counts, "part string, mask int, n long, good long, toxic long")).select(filter_audit.corners("cn").alias("at")).first()
    assert r["at"][31] == 10 and r["at"][0] == 0 and all(r["at"][1 << k] == 4 for k in range(5))
