"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .packed import LOWER, SPACED, U64, lists, pieces, ranges, scramble, take
from .shared import bounded_batches, forget, saved

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 10_000
#: Lengths of the n-grams, in bytes; white space counts as one space.
SIZES = (4, 5, 6)
BUCKET_BITS = 20
#: n-grams with the strongest evidence that the linear model weighs.
FEATURES = 4096
FLAT = np.where(SPACED[LOWER], LOWER, np.uint8(0x20))


@dataclass
class Model:
    """weight of each bucket (ratio times coefficient; 0 for buckets that aren't used), and the intercept."""

    weight: np.ndarray
    bias: float


def grams(data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents and buckets of all n-grams (those in ``wanted``, a flag for each bucket); white space also stands before and after each text."""
    docs = len(bounds) - 1
    size = np.diff(bounds)
    edge = bounds + 2 * np.arange(docs + 1)
    padded = np.full(edge[-1] + 8, 0x20, np.uint8)
    padded[ranges(edge[:-1] + 1, size)] = FLAT[data]
    eight = np.ndarray((edge[-1],), np.dtype("<u8"), padded, strides=(1,)).astype(U64)
    at, out = [], []
    for n in SIZES:
        bucket = (scramble((eight & U64((1 << 8 * n) - 1)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - BUCKET_BITS)).astype(np.int32)
        keep = wanted[bucket] if wanted is not None else np.ones(len(bucket), bool)
        for k in range(1, n):  # n-grams that reach into the next text
            keep[np.maximum(edge[1:] - k, 0)] = False
        place = np.flatnonzero(keep)
        at.append(np.searchsorted(edge, place, "right") - 1)
        out.append(bucket[place].astype(np.int64))
    return np.concatenate(at), np.concatenate(out)


def present(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's different buckets."""
    keys = np.unique((doc << BUCKET_BITS) | bucket)
    return keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a bucket: a partition's share of the counts."""
    table = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        label = np.asarray(batch.column("label"))
        for piece in pieces(batch.column("text")):
            doc, bucket = present(*grams(piece.data, piece.bounds))
            mark = label[piece.first + doc]
            for y in (0, 1):
                table[y] += np.bincount(bucket[mark == y], minlength=1 << BUCKET_BITS)
    used = np.flatnonzero(table.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[0, used]), pa.array(table[1, used])], names=["bucket", "clean", "toxic"])


def chosen(used: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text, which of the chosen buckets it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BUCKET_BITS, -1)
        number[used] = np.arange(len(used))
        for batch in batches:
            for piece in pieces(batch.column("text")):
                doc, bucket = present(*grams(piece.data, piece.bounds, number >= 0))
                yield pa.RecordBatch.from_arrays([*take(batch, ["label"], piece.rows), lists(number[bucket], np.bincount(doc, minlength=len(piece.rows)), pa.int32())], names=["label", "has"])

    return run


def logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by accelerated gradient steps; columns are scaled."""
    n, d = len(y), len(scale)
    data = scale[cols]
    # the curvature is bounded by a quarter of the largest mean squared row
    bound = 0.25 * (np.bincount(rows, data**2, n).mean() * 4 + 1) + ridge
    w, b, v, c, t = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, v[cols] * data, n) + c, -50, 50)))
        err = (p - y) / n
        grad = np.bincount(cols, err[rows] * data, d) + ridge * v
        w2, b2 = v - grad / bound * 4, c - err.sum() / bound * 4
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE, features: int = FEATURES) -> Model:
    """The model from (id, text) and labels; see score."""
    labelled = saved(docs.join(sample(labels, label_col, rows=rows), "id").select("label", "text"), "labelled")
    counts = labelled.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = counts.toArrow()  # 2 ** BUCKET_BITS rows at most
    bucket, clean, toxic = (np.asarray(table[c]) for c in ("bucket", "clean", "toxic"))
    kinds = dict(labelled.groupBy("label").count().collect())
    n0, n1 = kinds.get(0, 0), kinds.get(1, 0)
    if not n0 or not n1:
        share = np.clip(n1 / (n0 + n1) if n0 + n1 else 0.5, 1e-3, 1 - 1e-3)
        return Model(np.zeros(1 << BUCKET_BITS), float(np.log(share / (1 - share))))
    p, q = (toxic + 1) / (n1 + 2), (clean + 1) / (n0 + 2)
    ratio = np.log(p / q)
    # evidence: what the bucket adds to the likelihood ratio of all labelled rows, less its noise
    evidence = np.abs(ratio) * np.sqrt(toxic + clean)
    best = np.lexsort((bucket, -evidence))[:features]
    used, ratio = bucket[best], ratio[best]
    got = labelled.mapInArrow(chosen(used), "label int, has array<int>").toArrow()  # ``rows`` lists of ``features`` numbers at most
    forget(labelled)
    has = got["has"].combine_chunks()
    row = np.repeat(np.arange(len(has)), np.asarray(has.value_lengths()))
    w, b = logistic(row, np.asarray(has.flatten()).astype(np.int64), ratio, np.asarray(got["label"]).astype(float))
    weight = np.zeros(1 << BUCKET_BITS)
    weight[used] = w * ratio
    return Model(weight, b)


def scorer(held: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        heavy = model.weight != 0
        for batch in batches:
            for piece in pieces(batch.column("text")):
                doc, bucket = present(*grams(piece.data, piece.bounds, heavy))
                raw = np.bincount(doc, model.weight[bucket], len(piece.rows)) + model.bias
                yield pa.RecordBatch.from_arrays([*take(batch, ["id"], piece.rows), pa.array(1 / (1 + np.exp(-np.clip(raw, -50, 50))))], names=["id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE) -> DataFrame:
    """Each document's held_out and score, the probability that ``label_col`` is 1.

    A text is its set of byte n-grams of SIZES, lower-cased, white space as one
    space each, hashed into 2 ** BUCKET_BITS buckets. Every bucket is scaled by the
    log ratio of its document frequencies among toxic and clean labelled rows; a
    logistic regression weighs the FEATURES strongest. Both learn from at most
    ``rows`` labelled rows that the split doesn't hold out. Whole texts are scored;
    null and empty ones have the score of no n-grams. Repeated documents each get
    their row and, if labelled, each teach; without labels of both kinds every score
    is the labels' share (0.5 without any); without documents there are no rows.
    Other columns play no part, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(keyed, labels, label_col, rows))
    out = keyed.mapInArrow(scorer(model), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score")
