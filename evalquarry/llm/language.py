"""Language ID by Bayesian evidence fusion.

A page's language is inferred from its text's n-gram likelihood, the language its
markup declares, its address's suffix and path, and what the other pages of its
host, domain and suffix are in. Every table of counts is a grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import LOWER, SPACED, U64, lists, pieces, scramble, take
from .shared import bounded_batches, hot_join, saved

#: n-grams of three bytes are hashed into 2 ** BITS buckets.
BITS = 15
#: A text's evidence counts as that of so many n-grams at most: neighbours aren't independent.
GRAMS = 60
#: Pseudo-counts by which a host leans on its domain, a domain on its suffix, a suffix on the whole.
LEAN = 4.0
#: Pseudo-counts of a declaration's or path's confusion table.
SMOOTH = 1.0
FLAT = np.where(SPACED[LOWER] & ~((np.arange(256) < 0x61) | ((np.arange(256) > 0x7A) & (np.arange(256) < 0x80))), LOWER, np.uint8(0x20))
#: Spark regular expressions for what isn't text in markup.
HIDDEN = r"(?is)<(script|style|nav|head)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;"


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and buckets of all letter trigrams; other characters count as spaces."""
    letters = np.concatenate([FLAT[LOWER[data]], np.full(8, 0x20, np.uint8)])
    eight = np.ndarray((len(data),), np.dtype("<u8"), letters, strides=(1,)).astype(U64)
    bucket = (scramble((eight & U64(0xFFFFFF)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)).astype(np.int64)
    keep = np.ones(len(data), bool)
    for k in (1, 2):
        keep[np.maximum(bounds[1:] - k, 0)[bounds[1:] > bounds[:-1]]] = False
    keep &= ~((letters[:-8] == 0x20) & (letters[1:-7] == 0x20))
    place = np.flatnonzero(keep)
    return np.searchsorted(bounds, place, "right") - 1, bucket[place]


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's counts of n-grams by language."""
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        names = np.asarray(batch.column("lang").to_pylist())
        for piece in pieces(batch.column("text")):
            doc, bucket = grams(piece.data, piece.bounds)
            lang = names[piece.first + doc]
            for name in np.unique(lang):
                tables.setdefault(str(name), np.zeros(1 << BITS, np.int64))
                tables[str(name)] += np.bincount(bucket[lang == name], minlength=1 << BITS)
    for name, table in tables.items():
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(table[used])], names=["lang", "bucket", "n"])


def fit(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log likelihood of each bucket in each, from all texts that have a language."""
    given = texts.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    table = given.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))  # 2 ** BITS rows for each language at most
    counts = np.full((len(langs), 1 << BITS), 0.5)
    where = {name: i for i, name in enumerate(langs)}
    counts[[where[x] for x in table["lang"].to_pylist()], np.asarray(table["bucket"])] += np.asarray(table["n"])
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def likelihood(held: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The log likelihood of each text in each language, relative to the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = held.value[1].T
        for batch in batches:
            for piece in pieces(batch.column("text")):
                doc, bucket = grams(piece.data, piece.bounds)
                docs = len(piece.rows)
                n = np.bincount(doc, minlength=docs)
                sums = np.column_stack([np.bincount(doc, column[bucket], docs).astype(float) for column in logs.T]) if logs.shape[1] else np.zeros((docs, 0))
                sums *= (np.minimum(n, GRAMS) / np.maximum(n, 1))[:, None]
                sums -= sums.max(axis=1, keepdims=True, initial=-np.inf) if logs.shape[1] else 0
                kept = [batch.column(c).slice(piece.rows.start, docs) for c in ("id", "url", "declared")]
                yield pa.RecordBatch.from_arrays([*kept, lists(sums.ravel(), np.full(docs, logs.shape[1]), pa.float64())], names=["id", "url", "declared", "text_log"])

    return run


def posterior(logs: Column) -> Column:
    """Probabilities from log weights."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def visible(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " ")


def declared(html: Column) -> Column:
    """The primary subtag of <html lang=...>, lower-cased; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def level_sums(rows: DataFrame, level: str, n: int, name: str) -> DataFrame:
    """For each value of a level its pages and the sums of their text posteriors."""
    return rows.filter(F.col(level).isNotNull()).groupBy(level).agg(F.array(*(F.sum(F.col("soft")[i]) for i in range(n))).alias(name), F.count("*").alias("_n"))


def smoothed(rows: DataFrame, pages: DataFrame, level: str, n: int, above: Column, lean: float) -> DataFrame:
    """rows with the prior of a level: the level's counts of the other pages leaning on the level above."""
    joined = hot_join(rows, saved(level_sums(pages, level, n, "_sums"), level), [level], "_n", ["id", "url"], "left")
    zero = F.array(*(F.lit(0.0) for _ in range(n)))
    others = F.zip_with(F.coalesce("_sums", zero), F.when(F.col(level).isNotNull(), F.col("soft")).otherwise(zero), lambda s, own: F.greatest(s - own, F.lit(0.0)))
    total = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
    return joined.withColumn("prior", F.zip_with(others, above, lambda c, p: (c + F.lit(lean) * p) / (total + lean))).drop("_sums")


def identify(pages: DataFrame, texts: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text", lang_col: str = "lang", lean: float = LEAN) -> DataFrame:
    """The language of each page: id_col, language, probability, text_language, declared, host.

    texts (text_col, lang_col) teach the n-gram likelihoods; every text counts. The
    first posterior of a page is its text's alone. Its sums give P(declared value |
    language), P(path segment | language), and the priors of host, registered
    domain, and suffix, each leaning on the next by ``lean`` pseudo-counts; a page's
    own share is left out. The product of all is the result. What a page lacks (no
    text, no declaration, no address; null or empty) says nothing; a page without
    any evidence has the overall prior. Ties go to the language first in order.
    Repeated rows each count and get their row. Without any labelled text, language
    and probability are null; without pages there are no rows. Other columns play
    no part, whatever their names. The model has 2 ** BITS numbers for each
    different language of the texts, which passes the driver: lang_col is meant to
    hold languages, of which there are few.
    """
    bounded_batches(pages.sparkSession)
    model = fit(texts, text_col, lang_col)
    langs, n = model[0], len(model[0])
    kind = pages.schema[id_col].dataType.simpleString()
    held = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), declared(F.col(html_col)).alias("declared"), visible(F.col(html_col)).alias("text"))
    rows = rows.mapInArrow(likelihood(held), f"id {kind}, url string, declared string, text_log array<double>")
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_language"), "declared", host(F.col("url")).alias("host"))
    name = host(F.col("url"))
    rows = rows.withColumns({"host": name, "soft": posterior(F.col("text_log"))})
    rows = rows.withColumn("domain", F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")))
    rows = rows.withColumn("suffix", F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit("")))
    rows = rows.withColumn("segment", F.nullif(F.lower(F.regexp_extract("url", r"^[^?#]*?/([a-zA-Z]{2})(?:/|$|[?#])", 1)), F.lit("")))
    rows = saved(rows, "language")

    total = rows.agg(F.array(*(F.sum(F.col("soft")[i]) for i in range(n))).alias("s")).first()["s"]
    weight = [(x or 0.0) + SMOOTH for x in total]
    prior = F.array(*(F.lit(x / sum(weight)) for x in weight))
    out = rows.withColumn("prior", prior)
    for level in ("suffix", "domain", "host"):
        out = smoothed(out, rows, level, n, F.col("prior"), lean)
    logs = [F.col("text_log"), F.transform("prior", lambda p: F.log(p))]
    for what in ("declared", "segment"):
        every = rows.filter(F.col(what).isNotNull()).agg(F.array(*(F.sum(F.col("soft")[i]) for i in range(n))).alias("s"), F.count_distinct(what).alias("k")).first()
        norm, kinds = [x or 0.0 for x in every["s"] or [0.0] * n], every["k"]
        out = hot_join(out, saved(level_sums(rows, what, n, f"_{what}"), what), [what], "_n", ["id", "url"], "left")
        # P(value | language), with the page's own share left out
        value = F.array(*(F.log((F.greatest(F.col(f"_{what}")[i] - F.col("soft")[i], F.lit(0.0)) + SMOOTH) / F.lit(norm[i] + SMOOTH * (kinds + 1))) for i in range(n)))
        logs.append(F.when(F.col(what).isNotNull(), value).otherwise(F.array(*(F.lit(0.0) for _ in range(n)))))
    out = out.withColumn("p", posterior(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), logs)))
    known = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(known, F.array_position(c, F.array_max(c)).cast("int"))
    return out.select(F.col("id").alias(id_col), best(F.col("p")).alias("language"), F.array_max("p").alias("probability"), best(F.col("soft")).alias("text_language"), "declared", "host")
