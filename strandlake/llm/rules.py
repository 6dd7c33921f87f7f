"""Quality rules [native], lines first: lines that fail are removed, then documents that lost too much text go.

A line is text between newlines.  It fails where one of three rules holds:

* punctuation: it does not end like a sentence, or more than ``SYMBOL_PERCENT`` of 100 of its characters are
  symbols, or half of its words and more carry an exclamation mark;
* navigation: it holds ``SEPARATORS`` or more separators of menus and tables, or is nothing but a menu's words;
* boilerplate: it holds a phrase of licences, notices, cookie banners or calls to subscribe.

Lines without a word take no part: they never fail, and hold no text that could be lost.  A document is rejected where
the lines that failed held more than ``LOST_PERCENT`` of 100 of the characters of its words, or where its base counts
fail (too few words, or too many words in repeated windows of three).

All of it is built from column functions inside a row, so that nothing is shuffled and no Python runs; the work of a
text grows with its length (n log n for the windows).

Defined results: a null text has no words, and its counts are 0; an empty text and one of white space alone as well.
Rows that repeat, and null ids, are judged each by itself.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, whole_text

#: White space that parts words, for patterns and as the characters themselves.
BLANK, BLANKS = "[\\x20\\x09-\\x0D]", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOL_PERCENT, SEPARATORS, LOST_PERCENT = 10, 3, 50
#: A line of menu words has so many characters at most.
MENU_CHARS = 200

#: The end of a sentence, with quotes or brackets that close after it.
SENTENCE_END = "[.!?:;\\x{2026}\\x{3002}\\x{FF01}\\x{FF1F}][\"'\\x{201D}\\x{2019}\\x{BB})\\]]*\\z"
#: A separator of menus, paths and tables, between blanks or at an end of the line.
SEPARATOR = "(^|[\\x20\\x09])[|>/\\x{BB}\\x{B7}\\x{2022}]([\\x20\\x09]|\\z)"
MENU_WORDS = "home|menu|search|about|about us|contact|contact us|login|log in|log out|sign in|sign up|register|next|previous|back|back to top|read more|more|share|print|skip to content|sitemap|help|faq|archive|categories|tags"
MENU_LINE = f"^({MENU_WORDS})([\\x20\\x09]+({MENU_WORDS}))*[\\x20\\x09.!:]*\\z"
#: Plain phrases, each in lower case.
PHRASES = (
    "all rights reserved", "copyright (c)", "is licensed under", "licensed under the", "general public license", "creative commons", "terms of use",
    "terms of service", "privacy policy", "cookie policy", "uses cookies", "accept cookies", "enable javascript", "subscribe to our", "sign up for our",
    "click here", "lorem ipsum", "powered by", "page not found",
)
BOILERPLATE = "|".join(p.replace("(", "\\(").replace(")", "\\)") for p in PHRASES)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def solid(text: Column) -> Column:
    """Characters that stand in words."""
    return F.length(F.regexp_replace(text, f"{BLANK}+", "")).cast("long")


def symbols_in(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long")


def _total(numbers: Column, start: int = 0) -> Column:
    return F.aggregate(numbers, F.lit(start).cast("long"), lambda n, x: n + x)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often and wherever ``then`` names it.

    The optimiser may write a column that is named once into the place where it is named, also inside a lambda, which
    would compute it again for each element; an array of one keeps it out.
    """
    return F.transform(F.array(value), then)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window of ``window`` words found twice or more in the same text.

    The windows are sorted as strings, so that equal ones are neighbours; the union of the windows that repeat is
    summed from the gaps between their starts.
    """

    def shingles(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        text = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(window)])
        return F.when(F.size(w) >= window, F.sort_array(F.transform(starts, lambda i: F.struct(text(i).alias("w"), i.alias("i")))))

    def twice(s: Column) -> Column:
        rest = F.size(s) - 1
        met = F.zip_with(F.slice(s, F.lit(1), rest), F.slice(s, F.lit(2), rest), lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(met, lambda m: m.isNotNull()))))

    def union(r: Column) -> Column:
        rest = F.size(r) - 1
        gaps = F.zip_with(F.slice(r, F.lit(2), rest), F.slice(r, F.lit(1), rest), lambda x, y: F.least(x - y, F.lit(window)).cast("long"))
        return F.when(F.size(r) > 0, _total(gaps, window)).otherwise(F.lit(0).cast("long"))

    counted = bound(words, lambda w: bound(shingles(w), lambda s: F.when(s.isNotNull(), bound(twice(s), union))))
    return F.coalesce(counted, F.lit(0).cast("long"))


def line_fails(bare: Column, symbolic: Column, loud: Column, parted: Column, stock: Column) -> Column:
    """Whether a line, bare of blanks at its ends, fails one of the rules; false for a line without a word.

    The other columns say of its whole text whether it holds any symbol, exclamation mark, separator or phrase at all;
    where it holds none, its lines need not be looked through for them.
    """
    marked = symbols_in(bare) * 100 > solid(bare) * SYMBOL_PERCENT
    words = F.split(bare, f"{BLANK}+")
    shouted = (F.size(words) > 2) & (F.size(F.filter(words, lambda w: w.contains("!"))) * 2 >= F.size(words))
    menu = (F.length(bare) <= MENU_CHARS) & bare.rlike(f"(?i){MENU_LINE}")
    table = parted & (F.regexp_count(bare, F.lit(SEPARATOR)) >= SEPARATORS)
    return (bare != "") & (~bare.rlike(SENTENCE_END) | menu | (symbolic & marked) | (loud & shouted) | table | (stock & bare.rlike(f"(?i){BOILERPLATE}")))


def _lines(text: Column) -> Column:
    """Every line, what is left of it without blanks at its ends, and whether it fails."""

    def flags(t: Column) -> Column:
        low = F.lower(t)
        stock = bound(low, lambda x: reduce(lambda a, b: a | b, [x.contains(p) for p in PHRASES]))
        parted = t.rlike("[|>/\\x{BB}\\x{B7}\\x{2022}]")
        return F.struct(t.alias("t"), t.rlike(f"[{SYMBOLS}]").alias("symbolic"), t.contains("!").alias("loud"), parted.alias("parted"), stock.alias("stock"))

    def judged(d: Column) -> Column:
        bare = F.transform(F.split(d["t"], "\n"), lambda x: F.struct(x.alias("line"), F.trim(x, F.lit(BLANKS)).alias("bare")))
        fails = lambda b: line_fails(b, d["symbolic"], d["loud"], d["parted"], d["stock"])
        return F.transform(bare, lambda x: F.struct(x["line"].alias("line"), x["bare"].alias("bare"), fails(x["bare"]).alias("fails")))

    return bound(text, lambda t: bound(flags(t), judged))


def _cleaned(df: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """keep..., _text, _words, _lines."""
    text = whole_text(text_col)
    return df.select(*keep, text.alias("_text"), words_of(text).alias("_words"), _lines(text).alias("_lines"))


def _judged(cleaned: DataFrame, *keep: str) -> DataFrame:
    worded = F.filter("_lines", lambda x: x["bare"] != "")
    failed = F.filter("_lines", lambda x: x["fails"])
    none = F.lit(0).cast("long")
    counted = cleaned.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        symbols_in(F.col("_text")).alias("n_symbols"),
        bound(worded, lambda x: F.size(x) - F.size(F.array_distinct(x["line"]))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        bound(failed, lambda x: F.when(F.size(x) > 0, solid(F.array_join(x["bare"], "\n"))).otherwise(none)).alias("lost_chars"),
        F.size(failed).cast("long").alias("n_failed_lines"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    lost = F.col("lost_chars") * 100 > F.col("word_chars") * LOST_PERCENT
    return counted.withColumn("base_failed", base).withColumn("kept", ~base & ~lost)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, n_failed_lines, base_failed, kept.

    Nulls, blanks, repeated rows and empty tables: as the module says.  Other columns take no part, whatever their names.
    """
    keep = col(id_col).alias("_id")
    return _judged(_cleaned(df, text_col, [keep]), "_id").withColumnRenamed("_id", id_col)


def clean_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that stay, without the lines that failed; all columns, whatever their names, ``text_col`` rewritten.

    A null text has no words, so its row goes.
    """
    rest = F.struct(*[col(c) for c in df.columns if c != text_col]) if len(df.columns) > 1 else F.lit(None)
    stay = F.transform(F.filter("_lines", lambda x: ~x["fails"]), lambda x: x["line"])
    cleaned = _cleaned(df, text_col, [rest.alias("_row")]).withColumn("_new", F.array_join(stay, "\n"))
    kept = _judged(cleaned, "_row", "_new").where("kept")
    return kept.select(*[F.col("_new").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in df.columns])


def _sql_line_fails(line: str) -> str:
    q = lambda p: p.replace("'", "''")
    bare = f"trim({line}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    solid_of = f"length(regexp_replace({bare}, '{BLANK}+', '', 'g'))"
    parts = f"regexp_split_to_array({bare}, '{BLANK}+')"
    return f"""({bare} <> '' AND (
        NOT regexp_matches({bare}, '{q(SENTENCE_END)}')
        OR 100 * length(regexp_replace({bare}, '[^#*$%&|<>]', '', 'g')) > {SYMBOL_PERCENT} * {solid_of}
        OR (2 * len(list_filter({parts}, lambda w: contains(w, '!'))) >= len({parts}) AND len({parts}) > 2)
        OR len(regexp_extract_all({bare}, '{SEPARATOR}')) >= {SEPARATORS}
        OR (length({bare}) <= {MENU_CHARS} AND regexp_matches({bare}, '(?i){MENU_LINE}'))
        OR regexp_matches({bare}, '(?i){BOILERPLATE}')))"""


#: The contract columns in DuckDB SQL over ``documents``.
CONTRACT_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, list_filter(regexp_split_to_array(t, '{BLANK}+'), lambda x: x <> '') AS words FROM d
), windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 1} + 1)) AS i FROM w WHERE len(words) >= {WINDOW})
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range({WINDOW})) AS k) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), left_over AS (
  SELECT r, sum(length(regexp_replace(x, '{BLANK}+', '', 'g'))) AS n
  FROM (SELECT r, unnest(ls) AS x FROM lines) WHERE NOT {_sql_line_fails('x')} GROUP BY r
), counts AS (
  SELECT d.doc_id, len(w.words) AS n_words, length(regexp_replace(d.t, '{BLANK}+', '', 'g')) AS word_chars,
         length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines.ls) - len(list_distinct(lines.ls)) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words, coalesce(left_over.n, 0) AS kept_chars
  FROM d JOIN w USING (r) JOIN lines USING (r) LEFT JOIN repeats USING (r) LEFT JOIN left_over USING (r)
), judged AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM counts
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT 100 * (word_chars - kept_chars) > {LOST_PERCENT} * word_chars AS kept
FROM judged
"""
