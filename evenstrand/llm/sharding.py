"""Sharding by extendible hashing.

A document's path is 64 hash bits: 32 of its id, then 32 of its text.  A directory
indexed by the first bits of the path maps to shards; a shard over the byte limit is
split on its next bit, and only such shards are, until each fits.

The directory starts at the depth where a shard would hold about a sixteenth of the
limit, by the table's total bytes, and is summed upwards from there: a shard is the
shortest prefix that fits.  Entries that are over the limit even there are split STEP
bits deeper, and so on.  Sums are aggregated before they move, so a hot source or id
costs nothing, and the text's bits part rows that repeat an id.  Rows equal in id and
text share a path to its end: their shard, like that of a single text over the limit,
may exceed it and is marked.

DataFrame functions only.  The directory is broadcast while it has at most SMALL rows,
as counted, and is shuffled otherwise.  A null id counts as the text "null"; null texts
have no bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.llm import scratch

BITS = 64
STEP = 8
LIMIT = 16 << 20
SMALL = 500_000


def path(id_col: str, text_col: str) -> Column:
    """The 64 bits as text."""
    half = lambda c: F.lpad(F.conv(F.substring(F.md5(c), 1, 8), 16, 2), 32, "0")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")
    return F.concat(half(key), half(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def n_bytes(text_col: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")


def directory(paths: DataFrame, limit: int) -> tuple[DataFrame, list[int]]:
    """entry (a prefix at one of the depths given), shard (its bits), shard_bytes, shard_docs. paths: path, n_bytes."""
    total = paths.agg(F.sum("n_bytes")).first()[0] or 0
    top, known = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4), 0
    depths, tables, rest = [], [], paths
    while True:
        sums = scratch.table(rest.groupBy(F.substring("path", 1, top).alias("entry")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c")), "directory")
        levels = sums.select("b", "c", "entry", F.explode(F.sequence(F.lit(known), F.lit(top))).alias("depth")).groupBy("depth", F.expr("substring(entry, 1, depth)").alias("prefix")).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
        fits = levels.where((F.col("b") <= limit) | (F.col("depth") == BITS))
        each = sums.select("entry", F.explode(F.sequence(F.lit(known), F.lit(top))).alias("depth")).withColumn("prefix", F.expr("substring(entry, 1, depth)")).join(fits, ["depth", "prefix"])
        chosen = each.groupBy("entry").agg(F.min(F.struct("depth", "prefix", "b", "c")).alias("x")).select("entry", F.col("x.prefix").alias("shard"), F.col("x.b").alias("shard_bytes"), F.col("x.c").alias("shard_docs"))
        tables.append(scratch.table(chosen, "shards"))
        depths.append(top)
        over = sums.where(F.col("b") > limit).select(F.col("entry").alias("over")) if top < BITS else None
        if over is None or over.isEmpty():
            break
        rest = rest.join(_small(over), F.substring("path", 1, top) == F.col("over"), "left_semi")
        known, top = top + 1, min(BITS, top + STEP)
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out, depths


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs packed in `row`, with shard, n_bytes, shard_bytes, shard_docs, oversized."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), path(id_col, text_col).alias("path"), n_bytes(text_col).alias("n_bytes"))
    entries, depths = directory(scratch.table(packed.select("path", "n_bytes"), "paths"), limit)
    prefixes = F.array(*(F.substring("path", 1, d) for d in depths)) if len(depths) > 1 else F.array(F.substring("path", 1, depths[0]))
    placed = packed.select("row", "n_bytes", F.explode(prefixes).alias("entry")).join(_small(entries), "entry")
    return placed.select("row", "shard", "n_bytes", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, out: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet under out/shard=<bits>, one file a shard."""
    placed = assign(docs, limit, id_col, text_col)
    shard = F.concat(F.lit("b"), "shard")
    placed.select(F.col("row.*"), shard.alias("shard")).repartition(scratch.partitions(docs.sparkSession), "shard").write.partitionBy("shard").parquet(out)


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select("row.doc_id", "shard", F.length("shard").cast("long").alias("depth"), "n_bytes", "shard_bytes", "shard_docs", "oversized")


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
         lpad(bin(('0x' || md5(coalesce(doc_id::VARCHAR, 'null'))[1:8])::BIGINT), 32, '0') || lpad(bin(('0x' || md5(coalesce(text, ''))[1:8])::BIGINT), 32, '0') AS path
  FROM documents
), s AS (
  SELECT depth, path[1:depth] AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM d, (SELECT unnest(range(0, {BITS + 1})) AS depth) GROUP BY ALL
), f AS (SELECT * FROM s WHERE shard_bytes <= {LIMIT} OR depth = {BITS})
SELECT d.doc_id, shard, depth, n_bytes, shard_bytes, shard_docs, shard_bytes > {LIMIT} AS oversized
FROM d JOIN f ON shard = d.path[1:depth]
QUALIFY depth = min(depth) OVER (PARTITION BY d.doc_id, d.path)
"""
