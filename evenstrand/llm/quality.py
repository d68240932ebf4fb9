"""Quality rules: clean line by line, then reject documents that lose too much.

A line with words fails when it
- has no sentence mark (one of .!? or its full-width forms, before a space, a closing
  quote or bracket, or the line's end), or more than a tenth of its characters are symbols;
- is navigation: two separators or more, at least one for every three words;
- is boilerplate: it contains one of BOILERPLATE, upper or lower case.
Failing lines are removed.  A document is rejected if a base rule fails (under MIN_WORDS
words, or over 20 percent of them in repeated 5-word windows) or if the lines kept hold
less than half of its word characters.

All of it is Spark expressions within the row: nothing is shuffled.  Repeated windows
are found by hash (64 bits, within one text).  Null texts have no words and are
rejected; other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.llm import scratch

SEPARATORS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
NAVIGATION = "|»›•·"
SENTENCE = "[.!?…。！？][\"'”’»)\\]]*([\\x20\\x09-\\x0D]|$)"
#: Phrases of page furniture.
BOILERPLATE = ["all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under", "lorem ipsum", "log in", "powered by", "privacy policy", "read more", "sign up", "subscribe to", "terms of service", "terms of use"]
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    """text without the characters: a pass over the bytes for each, which is faster than translate()."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def word_chars(text: Column) -> Column:
    return F.length(_without(text, SPACES))


def _furnished(text: Column) -> Column:
    """Whether text holds a phrase of BOILERPLATE."""
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(text, F.lit(phrase))
    return found


def bound(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(grams: Column) -> Column:
    """Words within windows found twice or more, of the hashes of all windows in order."""

    def among(s: Column) -> Column:
        twin = lambda x, i: F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))
        starts = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")))["n"]

    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(bound(pairs, among))


def line_passes(line: Column, marks: Column | None = None, symbols: Column | None = None, furnished: Column | None = None) -> Column:
    """Whether a line with words stays. The others say whether its text holds any separator, symbol or phrase at all: lines of most texts need not be searched for them."""
    yes = F.lit(True)
    n = _count(line, NAVIGATION)
    navigation = (yes if marks is None else marks) & (n >= 2) & (3 * n >= F.size(_words(line)))
    laden = (yes if symbols is None else symbols) & (10 * _count(line, SYMBOLS) > word_chars(line))
    boilerplate = (yes if furnished is None else furnished) & _furnished(F.lower(line))
    return (F.endswith(line, F.lit(".")) | line.rlike(SENTENCE)) & ~navigation & ~laden & ~boilerplate


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column `quality`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, text (the clean lines)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"))
    holds = [(_count(F.col("text"), NAVIGATION) > 0).alias("marks"), _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"), _furnished(F.lower("text")).alias("furnished")]
    cut = packed.select("row", "text", *holds, _words(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    gram = lambda i: F.xxhash64(*(F.col("words")[i + j] for j in range(WINDOW)))
    grams = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), gram)).otherwise(F.array().cast("array<long>"))
    clean_lines = F.filter("lines", lambda x: line_passes(x, F.col("marks"), F.col("n_symbols") > 0, F.col("furnished")))
    seen = cut.select("row", "text", "lines", "n_symbols", F.size("words").cast("long").alias("n_words"), grams.alias("grams"), clean_lines.alias("clean"))
    counted = seen.select(
        "row",
        "n_words",
        word_chars(F.col("text")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("grams")).cast("long").alias("n_repeat_words"),
        F.concat_ws("\n", "clean").alias("text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = ~failed & (2 * word_chars(F.col("text")) >= F.col("word_chars"))
    found = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counted.select("row", F.struct(*found, failed.alias("base_failed"), kept.alias("kept"), "text").alias("quality"))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents kept, same columns, with their clean lines.

    What is measured is written before it is filtered: a filter on top would be pushed
    into the row, where the optimizer would compute each text's words once per word.
    """
    judged = measure(docs, text_col).select(F.struct(*(F.col("quality.text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns)).alias("row"), F.col("quality.kept").alias("kept"))
    return scratch.table(judged, "judged").where("kept").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = measure(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("row.doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def _sql_line_passes(line: str) -> str:
    words = f"len(regexp_extract_all({line}, '[^\\x20\\x09-\\x0D]+'))"
    chars = f"length(regexp_replace({line}, '[\\x20\\x09-\\x0D]', '', 'g'))"
    marks = f"(length({line}) - length(regexp_replace({line}, '[|»›•·]', '', 'g')))"
    symbols = f"(length({line}) - length(regexp_replace({line}, '[#*$%&|<>]', '', 'g')))"
    furniture = " OR ".join(f"contains(lower({line}), '{p}')" for p in BOILERPLATE)
    sentence = "[.!?…。！？][\"''”’»)\\]]*([\\x20\\x09-\\x0D]|$)"
    return f"(regexp_matches({line}, '{sentence}') AND 10 * {symbols} <= {chars} AND NOT ({marks} >= 2 AND 3 * {marks} >= {words}) AND NOT ({furniture}))"


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n
  FROM (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d))
), r AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, (SELECT unnest(range(0, 5)) AS j) WHERE n > 1 GROUP BY doc_id
), c AS (
  SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(array_to_string(list_filter(lines, lambda x: {_sql_line_passes("x")}), ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS clean_chars
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * clean_chars >= word_chars AS kept FROM f
"""
