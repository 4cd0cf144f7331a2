"""Quality classifier: gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import SAMPLE, held_out, sample
from .packed import SPACED, U64, byte_table, lists, mix, pieces, take, words
from .shared import bounded_batches, saved
from .trees import Forest, train

CLASSES = {
    "upper": byte_table(range(0x41, 0x5B)),
    "lower": byte_table(range(0x61, 0x7B)),
    "digit": byte_table(range(0x30, 0x3A)),
    "space": ~SPACED,
    "newline": byte_table([0x0A]),
    "high": byte_table(range(0x80, 0x100)),
    "stop": byte_table(b".,;:?"),
    "bang": byte_table(b"!"),
    "symbol": byte_table(b"#$%&*@^~+=<>"),
    "bar": byte_table(b"|\\/_"),
    "bracket": byte_table(b"()[]{}\"'"),
}
NAMES = [*CLASSES, "log_bytes", "log_words", "word_length", "word_spread", "long_words", "distinct_words", "distinct_pairs", "top_word", "words_a_line", "repeated_lines", "entropy", "first_upper", "symbol_ends", "runs"]
LETTER = byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(b)), where=b > 0)


def _distinct(doc: np.ndarray, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: its number of different hashes, and how often its most frequent one occurs."""
    keys = np.sort((doc.astype(U64) << U64(44)) | (hashes >> U64(20)))
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    owner = (keys[first] >> U64(44)).astype(np.int64)
    top = np.zeros(docs)
    np.maximum.at(top, owner, np.diff(np.append(first, len(keys))))
    return np.bincount(owner, minlength=docs).astype(float), top


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NAMES of each text, as a list."""
    for batch in batches:
        for piece in pieces(batch.column("text")):
            docs = len(piece.rows)
            size = np.diff(piece.bounds).astype(float)
            owner = np.repeat(np.arange(docs), np.diff(piece.bounds))
            counts = np.bincount(owner * 256 + piece.data, minlength=docs * 256).reshape(docs, 256).astype(float)
            out = {name: _ratio(counts[:, table].sum(axis=1), size) for name, table in CLASSES.items()}
            share = counts / np.maximum(size, 1)[:, None]
            out["entropy"] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
            same = np.append(False, piece.data[1:] == piece.data[:-1]) & (piece.data != 0x20) if len(piece.data) else np.zeros(0, bool)
            out["runs"] = _ratio(np.bincount(owner, same, docs), size)
            w = words(piece, SPACED)
            n = np.diff(w.bounds).astype(float)
            length = (w.end - w.start).astype(float)
            out["log_bytes"], out["log_words"] = np.log1p(size), np.log1p(n)
            out["word_length"] = _ratio(np.bincount(w.doc, length, docs), n)
            out["word_spread"] = np.sqrt(np.maximum(_ratio(np.bincount(w.doc, length**2, docs), n) - out["word_length"] ** 2, 0))
            out["long_words"] = _ratio(np.bincount(w.doc, length > 12, docs), n)
            distinct, top = _distinct(w.doc, w.hashes, docs)
            out["distinct_words"], out["top_word"] = _ratio(distinct, n), _ratio(top, n)
            pair = w.doc[1:] == w.doc[:-1]
            pairs, _ = _distinct(w.doc[1:][pair], mix(w.hashes[1:] ^ mix(w.hashes[:-1], 6), 7)[pair], docs)
            out["distinct_pairs"] = _ratio(pairs, np.maximum(n - 1, 0))
            lines = words(piece, ~CLASSES["newline"])
            n_lines = np.diff(lines.bounds).astype(float)
            kinds, _ = _distinct(lines.doc, lines.hashes, docs)
            out["words_a_line"], out["repeated_lines"] = _ratio(n, n_lines), 1 - _ratio(kinds, n_lines)
            head, tail = (piece.data[w.start], piece.data[w.end - 1]) if len(w.start) else (np.zeros(0, np.uint8),) * 2
            out["first_upper"] = _ratio(np.bincount(w.doc, CLASSES["upper"][head], docs), n)
            out["symbol_ends"] = _ratio(np.bincount(w.doc, ~LETTER[tail] & ~CLASSES["stop"][tail], docs), n)
            table = np.column_stack([out[k] for k in NAMES])
            yield pa.RecordBatch.from_arrays([*take(batch, ["id"], piece.rows), lists(table.ravel(), np.full(docs, len(NAMES)), pa.float64())], names=["id", "features"])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, len(NAMES))


def scorer(held: object) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(forest.scores(matrix(batch.column("features"))))], names=["id", "score"])

    return run


def fit(features: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE) -> Forest:
    """A forest from the statistics (id, features) of at most ``rows`` labelled documents that aren't held out."""
    table = features.join(sample(labels, label_col, rows=rows), "id").orderBy("id").limit(rows).toArrow()
    y = np.asarray(table["label"]).astype(float)
    if len(y) == 0 or y.min() == y.max():  # nothing to learn from: every text gets the labels' share
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        none = np.zeros((0, 1))
        return Forest(none.astype(int), none, none, float(np.log(share / (1 - share))), 0)
    return train(matrix(table["features"]), y)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE) -> DataFrame:
    """Each document's held_out and score, the probability that ``label_col`` is 1.

    The statistics of every whole text are computed once; the forest is fitted on
    at most ``rows`` labelled rows that the split doesn't hold out. Null and empty
    texts have all-zero statistics and are scored like others. Repeated documents
    each get their row; without labels of both kinds every score is the labels'
    share (0.5 without any); without documents there are no rows. Other columns
    play no part, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    features = saved(keyed.mapInArrow(statistics, f"id {kind}, features array<double>"), "statistics")
    forest = docs.sparkSession.sparkContext.broadcast(fit(features, labels, label_col, rows))
    out = features.mapInArrow(scorer(forest), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE) -> DataFrame:
    """docs without those whose score is below ``least``, in one pass once the forest is fitted.

    Scores are those of ``score``: null and empty texts are scored like others and
    stay or go alike; repeated rows each stay or go; a null id is no label's; without
    labels of both kinds every score is the labels' share (0.5 without any: all stay).
    docs' columns pass through whatever their names; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    chosen = sample(labels, label_col, rows=rows).select("id")
    kind = docs.schema[id_col].dataType.simpleString()
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id", "left_semi")
    forest = docs.sparkSession.sparkContext.broadcast(fit(marked.mapInArrow(statistics, f"id {kind}, features array<double>"), labels, label_col, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            plain = pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(text_col)], names=["id", "text"])
            scores = [forest.value.scores(matrix(s.column("features"))) for s in statistics(iter([plain]))]
            yield batch.filter(pa.array(np.concatenate(scores) >= least))

    return docs.mapInArrow(run, docs.schema)
