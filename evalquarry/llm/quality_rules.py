"""Quality rules: a table of thresholds over length, symbol, stop-word and line ratios, compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to in a is that for it as was on with by be this are at from
de la le et les des en un du une que pour est dans qui par sur pas au avec
der die und den von zu das mit sich auf für ist im dem nicht ein eine als
el y los se las del por con no una su para al es lo
""".split()
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\f\r"
BLANKS = r"[\x20\x09-\x0D]+"
#: Words in a window (a power of two), of which two equal ones in a text repeat all their words.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``measure`` is from ``least`` to ``most`` hundredths of ``of`` (a measure, or "one" for a plain number)."""

    name: str
    measure: str
    of: str
    least: int | None = None
    most: int | None = None


#: What a document must not fail to be looked at at all.
BASE = (
    Rule("enough_words", "n_words", "one", least=2000),
    Rule("few_repeated_words", "n_repeat_words", "n_words", most=30),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1400),
    Rule("few_symbols", "n_symbols", "n_words", most=10),
    Rule("few_capitals", "n_capitals", "word_chars", most=30),
    Rule("stop_words", "n_stop_words", "n_words", least=6),
    Rule("few_repeated_lines", "n_dup_lines", "n_lines", most=30),
    Rule("few_bullets", "n_bullet_lines", "n_lines", most=90),
    Rule("few_cut_lines", "n_cut_lines", "n_lines", most=30),
)
NEW = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines", "n_repeat_words", "failed_rules", "base_failed", "kept"]


def split_words(text: Column) -> Column:
    """The maximal runs of characters other than space and \\x09-\\x0D."""
    inner = F.trim(text, F.lit(BLANK))
    return F.when(inner != "", F.split(inner, BLANKS)).otherwise(F.array().cast("array<string>"))


def bound(value: Column, use: object) -> Column:
    """use(value), with the value computed once however often ``use`` names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Number of words in windows of WINDOW words that stand twice or more among words, the first ones included.

    Hashes of all windows say whether any may be repeated; the words of those that
    may are compared themselves: sorted, equal ones are neighbours. The starts of
    repeated windows cover WINDOW words each, or as many as to the next start.
    """

    def neighbours(rows: Column, key: str) -> Column:
        """The i of the sorted rows whose key is that of the row before or after."""
        return F.transform(F.filter(rows, lambda x, k: x[key].eqNullSafe(F.get(rows, k - 1)[key]) | x[key].eqNullSafe(F.get(rows, k + 1)[key])), lambda x: x["i"])

    def starts(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        maybe = bound(pairs, lambda rows: neighbours(rows, "h"))
        grams = F.sort_array(F.transform(maybe, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("g"), i.alias("i"))))
        return F.sort_array(bound(grams, lambda rows: neighbours(rows, "g")))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def whole(hashed: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashed) - WINDOW), lambda i: F.xxhash64(*(F.get(hashed, i + k) for k in range(WINDOW))))
        return bound(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), bound(starts(h), covered)).otherwise(0))

    return F.when(F.size(words) > WINDOW, bound(F.transform(words, lambda w: F.xxhash64(w)), whole)).otherwise(0)


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Every measure that a rule may name, from a text that isn't null, its words, and its lines that have a word."""
    out = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(STOP_WORDS))),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: F.left(x, F.lit(1)).isin("-", "*", "•"))),
        "n_cut_lines": F.size(F.filter(lines, lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…")))),
        "n_repeat_words": repeated_words(words),
    }
    return {k: v.cast("long") for k, v in out.items()}


def holds(rule: Rule) -> Column:
    """Whether a row of measures is within a rule's thresholds, in whole numbers."""
    of = F.lit(1) if rule.of == "one" else F.col(rule.of)
    sides = [] if rule.least is None else [F.col(rule.measure) * 100 >= of * rule.least]
    sides += [] if rule.most is None else [F.col(rule.measure) * 100 <= of * rule.most]
    return reduce(Column.__and__, sides, F.lit(True))


def apply_rules(docs: DataFrame, text_col: str = "text", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the measures, failed_rules (names, in the table's order), base_failed and kept.

    A projection of built-in functions over each whole text: nothing is shuffled,
    and a text's work grows with its length (times its logarithm where windows
    repeat). Nulls, empty texts and texts of spaces alone have no words and fail the
    base; ties and repeated rows are rows like others. docs' columns stay; those named like
    new ones are replaced (the text is read first); an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW]
    own = "_" * max(len(c) for c in docs.columns)  # names of which docs has none
    out = docs.select(*others, text.alias(f"{own}text"), split_words(text).alias(f"{own}words"), F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias(f"{own}lines"))
    out = out.select(*others, *(v.alias(k) for k, v in measures(*(F.col(own + k) for k in ("text", "words", "lines"))).items()))
    failed = F.array_compact(F.array(*(F.when(~holds(r), F.lit(r.name)) for r in (*base, *rules))))
    base_failed = ~reduce(Column.__and__, map(holds, base), F.lit(True))
    return out.withColumns({"failed_rules": failed, "base_failed": base_failed, "kept": F.size(failed) == 0})
