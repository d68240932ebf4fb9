"""Benchmark decontamination: winnowed fingerprints joined, hits extended to full windows.

Seeds are GRAM-word hashes, the least of every run of WINDOW - GRAM + 1 neighbours, so
every window of WINDOW shared words holds a seed chosen in documents and items alike.
Document seeds are joined with item seeds; each hit is extended to every window of
WINDOW words around it, which counts if its words are those of an item's window.
Items under WINDOW words are windows of their own, looked up by all runs of as many
words; those lengths are at most WINDOW - 1 in number.

DataFrame functions only.  The benchmark side is broadcast while it has at most SMALL
rows, as counted, and is shuffled otherwise.  Texts and seeds meet by id and text hash,
so rows repeating an id are judged each by itself.  Null texts have no words; items of
null id go by the name "null".  Nothing is contaminated by an empty benchmark.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.llm import repeats, scratch

WINDOW = 10
GRAM = 5
SMALL = 500_000
#: A seed and its place share a long: the low PLACE bits are the word's number.
PLACE = 30
KEY = repeats.KEY


def _raw_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")


def words_of(text: Column) -> Column:
    """The words of the text, A-Z lower-cased; only words that lower() changes are translated."""
    low = lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, string.ascii_uppercase, string.ascii_lowercase))
    return F.transform(_raw_words(text), low)


def _runs(words: Column, n: int) -> Column:
    """Hashes of all runs of n words."""
    every = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(words[i + j] for j in range(n))))
    return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<long>"))


def seeds(texts: DataFrame, keep: list[str]) -> DataFrame:
    """keep, seed, place: the winnowed seeds of texts with a words column."""
    low = (1 << PLACE) - 1
    hashed = texts.select(*keep, F.transform(_runs(F.col("words"), GRAM), lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))).alias("h"))
    span = WINDOW - GRAM + 1
    least = F.transform(F.sequence(F.lit(0), F.size("h") - span), lambda i: F.least(*(F.col("h")[i + j] for j in range(span))))
    least = F.when(F.size("h") >= span, least).otherwise(F.array().cast("array<long>"))
    one = hashed.select(*keep, F.explode(F.array_distinct(least)).alias("x"))
    return one.select(*keep, F.shiftright("x", PLACE).alias("seed"), F.col("x").bitwiseAND(F.lit(low)).cast("int").alias("place"))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small by count."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _run_text(words: Column, start: Column, n) -> Column:
    return F.concat_ws(" ", F.slice(words, start + 1, n))


def hits(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """doc, tkey, start, n, run: every place where a window of the benchmark stands; and the windows with their items."""
    spark = docs.sparkSession
    items = scratch.table(bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), words_of(F.coalesce(F.col(item_text), F.lit(""))).alias("words")).where(F.size("words") > 0).withColumn("n", F.least(F.lit(WINDOW), F.size("words"))), "items")
    windows = items.select("item", "n", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("n")), lambda i: F.concat_ws(" ", F.slice(F.col("words"), i + 1, F.col("n"))))).alias("run"))
    windows = scratch.table(windows.groupBy("n", "run").agg(F.collect_set("item").alias("items")), "windows")
    item_seeds = small(scratch.table(seeds(items, []).select("seed").distinct(), "item_seeds"))
    texts = repeats.keyed(docs, id_col, text_col)
    words = texts.select(*KEY, words_of(F.col("text")).alias("words"))
    found = seeds(words, KEY).join(item_seeds, "seed", "left_semi")
    places = found.groupBy(*KEY).agg(F.collect_set("place").alias("places"))
    known = small(windows.select("n", "run"))
    held = texts.join(places.hint("shuffle_hash"), KEY).select(*KEY, "places", words_of(F.col("text")).alias("words"))  # texts, not words, are shuffled
    around = held.select(*KEY, "words", F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(F.lit(0), p - (WINDOW - GRAM)), F.least(p, F.size("words") - WINDOW))))).alias("starts"))
    spans = around.select(*KEY, F.explode(F.transform("starts", lambda s: F.struct(s.alias("start"), _run_text(F.col("words"), s, WINDOW).alias("run")))).alias("x")).select(*KEY, "x.start", F.lit(WINDOW).alias("n"), "x.run")
    out = spans.join(known, ["n", "run"], "left_semi").select(*KEY, "start", "n", "run")
    for n in sorted(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect()):  # WINDOW - 1 lengths at most
        short = small(scratch.table(items.where(F.col("n") == n).select(_runs(F.col("words"), n)[0].alias("h")).distinct(), "short"))
        every = words.select(*KEY, "words", F.posexplode(_runs(F.col("words"), n)).alias("start", "h")).join(short, "h", "left_semi")
        out = out.union(every.select(*KEY, "start", F.lit(n).alias("n"), _run_text(F.col("words"), F.col("start"), n).alias("run")).join(known, ["n", "run"], "left_semi").select(*KEY, "start", "n", "run"))
    return out, windows


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per contaminated text: doc, tkey, n_hit (words within windows), items (sorted names), spans (word ranges)."""
    found, windows = hits(docs, bench, id_col, text_col, item_col, item_text)
    found = scratch.table(found.distinct(), "hits")
    ranges = found.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    add = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).cast("long").alias("n"))
    covered = ranges.select(*KEY, "spans", F.aggregate("spans", zero, add)["n"].alias("n_hit"))
    named = found.select(*KEY, "n", "run").distinct().join(small(windows), ["n", "run"]).select(*KEY, F.explode("items").alias("item")).groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return covered.join(named, KEY)


def judge(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items, contaminated."""
    found = scratch.table(contamination(docs, bench, id_col, text_col), "contaminated")
    counted = repeats.keyed(docs, id_col, text_col).select(*KEY, F.size(_raw_words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(found, KEY, "left")
    return joined.select(repeats.id_of().alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, same columns, without those that hold a window of the benchmark."""
    found = scratch.table(contamination(docs, bench, id_col, text_col).select(F.col("doc").alias("__doc"), F.col("tkey").alias("__tkey")), "contaminated")
    same = (repeats.doc_key(id_col) == F.col("__doc")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__tkey"))
    return docs.join(found, same, "left_anti")


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP7_SQL = """
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents, low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark, low),
w AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS run
  FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM (SELECT *, least(10, len(words)) AS n FROM b WHERE len(words) > 0))
), lengths AS (SELECT DISTINCT n FROM w),
h AS (
  SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS run
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lengths WHERE len(words) >= n)
), m AS (SELECT h.doc_id, h.i, h.n, w.item_id FROM h JOIN w ON h.run = w.run AND h.n = w.n),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
