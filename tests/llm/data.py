"""Small documents with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def awkward():
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, shared passages."""
    rng = random.Random(5)
    passage = sentence(rng, 60)
    base = sentence(rng, 120)
    near = base.replace(base.split()[60], "other", 1)
    texts = [base, base, near, sentence(rng, 80) + " " + passage + " " + sentence(rng, 30), passage, "", None, "   \t\n", "one two", "one two", "a b a b " * 40, "é ü 漢字 " * 90, sentence(rng, 30000, 20000), sentence(rng, 20) + " " + passage, base.upper(), "x" * 5000, sentence(rng, 300, 3)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, "no id " * 30, None, None, None))
    rows.append((4, "an id that stands twice, with another text", None, "s1", 42))
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def clashing(df, *names):
    """df with extra columns named like those that operators use."""
    from pyspark.sql import functions as F

    for n in ("id", "h", "rest", "anchor", "body", "lo", "hi", "key", "node", "size", "source_size", "target", "copies", "n_words", "n_removed", "spans", "score", *names):
        df = df.withColumn(n, F.lit("taken"))
    return df
