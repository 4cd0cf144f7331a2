"""Parsing, normalising and hashing of strings as columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def phrase_matches(text: Column, phrases: Column) -> Column:
    """Whether the normalised text holds any of the array's phrases as whole words."""
    padded = F.concat(F.lit(" "), normalized(text), F.lit(" "))
    return F.exists(phrases, lambda p: padded.contains(F.concat(F.lit(" "), normalized(p), F.lit(" "))))


def int_list(text: Column) -> Column:
    """"17, 42, 86" as an array of numbers; null if the text is anything else."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(r"^[0-9]+(\s*,\s*[0-9]+)*$"), F.transform(F.split(trimmed, ","), lambda v: F.trim(v).cast("bigint")))


def pipe_records(text: Column, fields: int) -> Column:
    """Lines of ``fields`` parts between bars: struct(records array<array<string>>, error string).

    Blank lines are skipped; the error names the first line (from 1, blank ones not
    counted) with another number of parts, and records are null then.
    """
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    parts = F.transform(lines, lambda x: F.transform(F.split(x, r"\|"), lambda y: F.trim(y)))
    bad = F.array_position(F.transform(parts, lambda p: F.size(p) != fields), True)
    error = F.when(F.size(lines) == 0, "empty").when(bad > 0, F.concat(F.lit("line "), bad.cast("string"), F.lit(f": expected {fields} fields")))
    return F.struct(F.when(error.isNull(), parts).alias("records"), error.alias("error"))


def json_error(raw: Column, keys: Sequence[str]) -> Column:
    """What is wrong with a JSON object that must have exactly these keys: not_json, not_object, duplicate_key, keys, or null."""
    found = F.json_object_keys(raw)
    return (
        F.when(raw.isNull(), "not_json")
        .when(F.try_parse_json(raw).isNull(), "not_json")
        .when(found.isNull(), "not_object")
        .when(F.size(found) != F.size(F.array_distinct(found)), "duplicate_key")
        .when(F.array_sort(found) != F.array(*map(F.lit, sorted(keys))), "keys")
    )


def strict_json(raw: Column, schema: str, keys: Sequence[str]) -> Column:
    """struct(value, error): the parsed object if it has exactly the keys and no field lost its value to its type."""
    error = json_error(raw, keys)
    value = F.from_json(raw, schema)
    typed = reduce(lambda a, b: a & b, (value[k].isNotNull() for k in keys))
    error = F.coalesce(error, F.when(~typed, "type"))
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def canonical_json(columns: Sequence[str]) -> Column:
    """The columns as a JSON object with sorted keys and no blanks; nulls stay."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def canonical_map_json(m: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def content_key(text: Column) -> Column:
    return F.sha2(text, 256)


def seed64(text: Column) -> Column:
    """The first eight bytes of the text's SHA-256, big-endian, as decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_rank(*values: Column) -> Column:
    """A hash that orders rows alike everywhere: SHA-256 of the values joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *(v.cast("string") for v in values)), 256)


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced by its column."""
    return reduce(lambda text, item: F.replace(text, F.lit("{" + item[0] + "}"), item[1].cast("string")), values.items(), F.lit(template))


def percent(value: Column, digits: int = 1) -> Column:
    """0.125 as 12.5%; null as n/a."""
    return F.coalesce(F.concat(F.format_number(value * 100, digits), F.lit("%")), F.lit("n/a"))


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differ > 0, differ - 1).otherwise(n)


def html_escaped(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def leaks(payload: Column, terms: Sequence[str]) -> Column:
    """Terms that occur in the lower-cased payload."""
    low = F.lower(payload)
    return F.filter(F.array(*map(F.lit, terms)), lambda t: low.contains(F.lower(t)))


def headed_records(text: Column, fields: int, header: str = "visible_ids") -> Column:
    """Records below a line "header: [17, 42]": struct(ids, records, error). The header must be the first line that isn't blank."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    inner = F.regexp_extract(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), rf"^\s*{header}\s*:\s*\[([0-9,\s]*)\]\s*$", 1)
    has = F.coalesce(F.get(lines, F.lit(0)).rlike(rf"^\s*{header}\s*:\s*\[[0-9,\s]*\]\s*$"), F.lit(False))
    ids = F.when(F.trim(inner) == "", F.array().cast("array<bigint>")).otherwise(int_list(inner))
    rest = pipe_records(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n"), fields)
    error = F.when(~has | ids.isNull(), F.lit("header")).otherwise(rest["error"])
    return F.struct(F.when(error.isNull(), ids).alias("ids"), F.when(error.isNull(), rest["records"]).alias("records"), error.alias("error"))
