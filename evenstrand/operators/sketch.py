"""Count-min sketches as tables (row, bucket, n), and the two-stage count they allow.

Plain count-min: rows are summed on their own, so partial sketches merge in any order and
estimates never fall short.  Bucket of row r: the first 32 bits of the MD5 of "r:kmer",
modulo the number of cells in a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.config import Config


def bucket(row: Column, kmer: Column, cells: int) -> Column:
    text = F.concat_ws(":", row.cast("string"), kmer.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % cells


def sketch(kmers: DataFrame, hashes: int, cells: int, bits: int = 32) -> DataFrame:
    """row, bucket, n of kmers (kmer, m: how often); cells saturate at 2**bits - 1."""
    per_kmer = kmers.groupBy("kmer").agg(F.sum("m").alias("m"))
    cast = per_kmer.select("kmer", "m", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("row"))
    return cast.groupBy("row", bucket(F.col("row"), F.col("kmer"), cells).alias("bucket")).agg(F.least(F.sum("m"), F.lit(2**bits - 1)).alias("n"))


def estimate(kmers: DataFrame, table: DataFrame, hashes: int, cells: int) -> DataFrame:
    """kmer, depth: the least of a distinct k-mer's cells."""
    asked = kmers.select("kmer").distinct().select("kmer", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("row"))
    asked = asked.withColumn("bucket", bucket(F.col("row"), F.col("kmer"), cells))
    return asked.join(table, ["row", "bucket"]).groupBy("kmer").agg(F.min("n").alias("depth"))


def prefiltered(kmers: DataFrame, c: Config, least: int = 2) -> DataFrame:
    """kmer, depth: exact counts of the k-mers that a small first sketch estimates at `least` or more."""
    hashes = c.prefilter_hashes or ((c.hashes or 3) + 1) // 2
    cells = c.prefilter_cells or default_cells(c)
    bits = c.prefilter_bits or 2
    first = estimate(kmers, sketch(kmers, hashes, cells, bits), hashes, cells).where(F.col("depth") >= least).select("kmer")
    return kmers.join(first, "kmer", "left_semi").groupBy("kmer").agg(F.sum("m").alias("depth"))


def default_cells(c: Config) -> int:
    """Cells of a row: as set, no more than there are k-mers of length k."""
    return min(c.cells or 1 << 24, 4 ** min(c.k, 30))


def unique_estimate(table: DataFrame, cells: int) -> DataFrame:
    """The number of distinct k-mers from the share of cells in use: the mean over rows of -cells * ln(1 - used)."""
    used = table.groupBy("row").agg(F.count("*").alias("used"))
    one = F.when(F.col("used") < cells, -F.lit(float(cells)) * F.log(1 - F.col("used") / cells)).otherwise(F.lit(float(cells) * math.log(cells)))
    return used.agg(F.round(F.avg(one)).cast("long").alias("unique_kmers"))
