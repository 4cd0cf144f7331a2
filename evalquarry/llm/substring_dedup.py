"""Substring dedup: matching statistics against suffix automata of reference shards.

The reference of a corpus that is cleaned of its own repeats is the corpus, which
has no size bound, so the shards' automata are not broadcast: both the reference
and the stream are dealt out by anchor (``repeats.py``), which sends every part
of a document to the one shard that can hold its repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .packed import SPACED, covered, pieces, take, words
from .repeats import borders, content_values, once, repeated_spans, shards, with_spans
from .shared import packed_rest, schema_of, unpacked_rest

LENGTH = 20
ANCHOR = 6


class Runs:
    """Spans of covered windows; windows of one row that follow or overlap one another are one span."""

    def __init__(self) -> None:
        self.row: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []

    def add(self, row: int, start: int, end: int) -> None:
        if self.row and self.row[-1] == row and start <= self.end[-1]:
            self.end[-1] = end
        else:
            self.row.append(row), self.start.append(start), self.end.append(end)


def stream(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of windows that the shard holds at an earlier place.

    Rows come in the order of places. An anchor's rows are both: each is streamed
    through the automaton of those before it and then joins them. Where the anchor
    has a reference (rows that don't stream come first), the automaton is that of
    the reference alone, which has each repeated window where it stands first; a
    window is later unless that place is its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches):
            batch = once(table)
            values, bounds = content_values(batch.column("content"))
            lo, streams = np.asarray(batch.column("lo")), np.asarray(batch.column("streams"))
            ids, h = batch.column("id"), np.asarray(batch.column("h"))
            runs, at = Runs(), 0
            for to in borders(batch).tolist():
                automaton = SuffixAutomaton()
                split = at + int(np.searchsorted(streams[at:to], 1))
                for r in range(at, split):
                    automaton.add(values[bounds[r] : bounds[r + 1]].tolist(), int(bounds[r]))
                for r in range(split, to):
                    symbols = values[bounds[r] : bounds[r + 1]].tolist()
                    if r > at:
                        for i, (matched, end) in enumerate(automaton.matches(symbols, length)):
                            if matched < length:
                                continue
                            if split > at:
                                begin = end - length + 1
                                first = int(np.searchsorted(bounds, begin, "right")) - 1
                                if h[first] == h[r] and lo[first] + begin - bounds[first] == lo[r] + i - length + 1 and ids[first] == ids[r]:
                                    continue
                            runs.add(r, i - length + 1, i + 1)
                    if split == at:
                        automaton.add(symbols, int(bounds[r]))
                at = to
            rows = np.array(runs.row, np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), batch.column("h").take(pa.array(rows)), pa.array(lo[rows] + np.array(runs.start, np.int64)), pa.array(lo[rows] + np.array(runs.end, np.int64))],
                names=["id", "h", "lo", "hi"],
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words in their spans."""
    for batch in batches:
        spans = batch.column("spans")
        for piece in pieces(batch.column("text")):
            w = words(piece, SPACED)
            n = np.diff(w.bounds)
            part = spans.slice(piece.rows.start, len(piece.rows))
            held = part.flatten()
            doc = np.repeat(np.arange(len(part)), np.asarray(part.value_lengths().fill_null(0)))
            gone = covered(w.bounds[doc] + np.asarray(held.field(0)), w.bounds[doc] + np.asarray(held.field(1)), len(w.start))
            removed = np.bincount(w.doc[gone], minlength=len(n))
            changed = removed > 0
            raw = piece.data.tobytes()
            texts = []
            for d in range(len(n)):
                if changed[d]:
                    at = np.arange(w.bounds[d], w.bounds[d + 1])
                    at = at[~gone[at]]
                    texts.append(b" ".join([raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]).decode())
                else:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*take(batch, ["id", "text", "rest"], piece.rows), pa.array(n), pa.array(removed.astype(np.int64)), pa.array(texts, pa.string())], names=["id", "text", "rest", "n_words", "n_removed", "cut_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Each document with the words removed that an earlier place of the corpus has in a window of ``length`` words.

    Words are maximal runs of characters other than space and \\x09-\\x0D. A word
    goes if some window that holds it also starts earlier: in a document of
    smaller id, or in the same one further ahead. Windows are judged on the input.
    Returns docs with text_col (null stays null; untouched texts stay as they are;
    others are the kept words joined by one space), n_words and n_removed.
    Null and empty texts have no words. A null id counts as the smallest. Rows
    that share an id are one place in the order if their texts are equal (so
    neither removes the other) and are ordered by a hash of the text otherwise.
    Other columns of docs pass through, but for two named like the new ones. An
    empty table stays empty.
    """
    own = (id_col, text_col, "n_words", "n_removed")
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), packed_rest(docs, *own))
    spans = repeated_spans(keyed.drop("rest"), "words", length, anchor, True, stream(length))
    out = with_spans(keyed, spans).mapInArrow(_cut, schema_of(keyed, ["id", "text", "rest"], "n_words long, n_removed long, cut_text string"))
    text = F.when(F.col("n_removed") > 0, F.col("cut_text")).otherwise(F.col("text")).alias(text_col)
    return out.select(F.col("id").alias(id_col), text, *unpacked_rest(docs, *own), "n_words", "n_removed")


def word_text(text: Column) -> Column:
    """The text's words joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
