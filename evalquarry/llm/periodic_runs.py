"""Periodic runs of words: maximal repetitions by Lyndon arrays on ordered alphabets, in linear time.

The Lyndon factor that begins at a word ends at its next smaller suffix, and
every run has a root that is such a factor under the order of the words or its
reverse (end of text smallest in both). So the runs are found from the edges
(i, next smaller suffix of i): how far the text goes on alike from both ends,
to the right and to the left, gives the run of that period.

Extensions are never matched twice. Of all matches so far, the one that reaches
furthest is kept, and what lies within it has been compared before at a distance:
its copy's result holds if it ends inside, and matching goes on from the border
otherwise. Each comparison of words so moves a border or ends an extension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import bounded_batches

#: Words of the shortest run.
LEAST = 12


def smaller_suffixes(s: list[int]) -> tuple[list[int], list[int]]:
    """For each place: the next smaller suffix (len(s): none), and how many words both begin with alike.

    Places are taken from left to right; the open ones are a chain of previous
    smaller suffixes. A place j meets the chain's end i: between them all suffixes
    are larger than both. ``alike`` is the match of the last place that j closed,
    ``up`` of that place with i: if they differ, the smaller is j's match with i.
    If they are equal and end inside the furthest match (bi, bj, hi), the copy of
    (i, j) at its distance was met before, or matching reaches the border hi.
    """
    n = len(s)
    following, right = [n] * n, [0] * n
    previous, up = [-1] * n, [0] * n
    bi = bj = hi = 0
    for j in range(1, n):
        i, x, alike, below = j - 1, s[j], -1, -1
        while i >= 0:
            if s[i] != x:
                m = 0
            elif alike >= 0 and alike != below:
                m = alike if alike < below else below
            else:
                m = alike if alike > 0 else 1
                if j + m < hi:
                    ci, cj = i - bj + bi, j - bj + bi
                    m = right[ci] if following[ci] == cj else up[cj] if previous[cj] == ci else n
                    m = min(m, hi - j)
                if j + m >= hi:
                    while j + m < n and s[i + m] == s[j + m]:
                        m += 1
                    bi, bj, hi = i, j, j + m
            if j + m < n and s[i + m] < s[j + m]:
                previous[j], up[j] = i, m
                break
            following[i], right[i], alike, below = j, m, m, up[i]
            i = previous[i]
    return following, right


def runs_of(s: list[int], least: int = LEAST) -> set[tuple[int, int, int]]:
    """All runs (start, end, period) of at least ``least`` words.

    The extensions to the left go from right to left, with the match that reaches
    furthest (bi, bj, lo): a place i inside it has an edge whose copy, to the right,
    is an edge too.
    """
    n, found = len(s), set()
    for order in (s, [-x for x in s]):
        following, right = smaller_suffixes(order)
        left = [0] * n
        bi = bj = lo = n
        for i in range(n - 1, -1, -1):
            j = following[i]
            if j == n:
                continue
            m = 0
            if i and s[i - 1] == s[j - 1]:
                m = 1
                if i > lo:
                    m = min(left[i + bj - bi], i - lo)
                if i - m <= lo:
                    while m < i and s[i - 1 - m] == s[j - 1 - m]:
                        m += 1
                    if i - m < lo:
                        bi, bj, lo = i, j, i - m
                left[i] = m
            r = right[i]
            if m + r >= j - i and m + r + j - i >= least:
                found.add((i - m, j + r, j - i))
    return found


def text_runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a text's words, by start and period.

    Words become numbers in their order by sorting. A word that stands once in the
    text is in no run, so the runs are sought between such words.
    """
    if len(words) < least:
        return []
    ranks = pc.rank(pa.array(words, pa.binary()), sort_keys="ascending", tiebreaker="dense").to_numpy()
    edges = np.flatnonzero(np.bincount(ranks)[ranks] == 1)
    starts, ends = np.append(0, edges + 1), np.append(edges, len(words))
    long = ends - starts >= least
    out = []
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        out += [(a + x, a + y, q) for x, y, q in runs_of(ranks[a:b].tolist(), least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, end, period in runs:
            depth[start + period] += 1
            depth[end] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with runs (start, length, period; by start, then period) and collapsed, the words outside the repeats.

    A run is a maximal stretch of words whose smallest period fits into it at least
    twice, of ``least`` words or more; collapsed keeps the first period of each. Every
    whole text is a task's row of its own: nothing is shuffled, and memory follows
    the longest text. Words are maximal runs of characters other than space and
    \\x09-\\x0D. Null, empty and blank texts have no runs and an empty collapsed text;
    repeated rows each get theirs. docs' columns stay; those named like new ones
    are replaced (the text is read first); an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("runs", "collapsed")]
    schema = T.StructType([docs.schema[c] for c in others] + T._parse_datatype_string("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").fields)
    place = docs.columns.index(text_col)
    kept = [docs.columns.index(c) for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for text in batch.column(place).cast(pa.large_binary()):
                words = (text.as_py() or b"").split()
                found = text_runs(words, least)
                runs.append([{"start": a, "length": b - a, "period": q} for a, b, q in found])
                texts.append(collapsed(words, found))
            new = [pa.array(runs, pa.list_(RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *new], names=schema.names)

    return docs.mapInArrow(run, schema)
