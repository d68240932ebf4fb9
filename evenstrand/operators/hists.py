"""Histograms and statistics of reads (bases, quals, and mate where it matters).

Shapes and headers follow the established ones; where only a header is known the formula
is ours and says so.  None aligns reads: match, insert, indel, error and identity tables
have the shape that unaligned reads give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstrand.config import Config
from evenstrand.functions import bases as B
from evenstrand.ship import ship

#: Reads whose entropy is worked out at once.
ENTROPY_READS = 4096


def _places(reads: DataFrame, *keep: str) -> DataFrame:
    """keep, pos (from 0), base, q: a row per base; q null without qualities."""
    each = F.explode(F.sequence(F.lit(1), F.length("bases")))
    rows = reads.where(F.length("bases") > 0).select(*keep, "bases", "quals", each.alias("i"))
    return rows.select(*keep, (F.col("i") - 1).alias("pos"), F.upper(F.substring(F.col("bases"), F.col("i"), F.lit(1))).alias("base"), (F.ascii(F.substring(F.col("quals"), F.col("i"), F.lit(1))) - 33).alias("q"))


def quality(reads: DataFrame) -> DataFrame:
    """quality, bases."""
    return _places(reads).where("q IS NOT NULL").groupBy(F.col("q").alias("quality")).agg(F.count("*").alias("bases"))


def quality_counts(reads: DataFrame) -> DataFrame:
    """quality, count1, fraction1, count2, fraction2: bases of each mate."""
    return _by_mate(_places(reads, "mate").where("q IS NOT NULL").select("mate", F.col("q").alias("quality")))


def average_quality(reads: DataFrame) -> DataFrame:
    """quality, count1, fraction1, count2, fraction2: reads of each mate by the rounded-down mean of their qualities."""
    q = B.numbers("quals")
    rows = reads.where(F.length("quals") > 0).select("mate", q.alias("q"))
    return _by_mate(rows.select("mate", F.floor(F.aggregate("q", F.lit(0), lambda a, x: a + x) / F.size("q")).cast("int").alias("quality")))


def _by_mate(rows: DataFrame) -> DataFrame:
    one, two = F.col("mate") == 1, F.col("mate") == 2
    counts = rows.groupBy("quality").agg(F.count(F.when(one, 1)).alias("count1"), F.count(F.when(two, 1)).alias("count2"))
    total = counts.agg(F.sum("count1").alias("t1"), F.sum("count2").alias("t2"))
    both = counts.crossJoin(F.broadcast(total))  # one row
    part = lambda i: F.when(F.col(f"t{i}") > 0, F.col(f"count{i}") / F.col(f"t{i}")).otherwise(0.0).alias(f"fraction{i}")
    return both.select("quality", "count1", part(1), "count2", part(2))


def overall_quality(reads: DataFrame) -> DataFrame:
    """quality, bases, fraction."""
    counts = quality(reads)
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("bases").alias("t")))).select("quality", "bases", (F.col("bases") / F.col("t")).alias("fraction"))  # one row


def base_quality(reads: DataFrame) -> DataFrame:
    """mate, pos, count, min, max, mean, q1, med, q3, lw, rw: exact, from counts per quality.

    Quartile p is the least quality that at least p of the bases do not exceed; whiskers
    are the 2nd and 98th percentiles by the same rule (our formula).
    """
    from pyspark.sql import Window

    counts = _places(reads, "mate").where("q IS NOT NULL").groupBy("mate", "pos", "q").agg(F.count("*").alias("n"))
    at = Window.partitionBy("mate", "pos")  # at most 94 rows each
    ranked = counts.withColumns({"upto": F.sum("n").over(at.orderBy("q")), "total": F.sum("n").over(at)})
    point = lambda p, name: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("q"))).alias(name)
    return ranked.groupBy("mate", "pos").agg(F.sum("n").alias("count"), F.min("q").alias("min"), F.max("q").alias("max"), (F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("mean"), point(25, "q1"), point(50, "med"), point(75, "q3"), point(2, "lw"), point(98, "rw"))


def lengths(reads: DataFrame, cap: int | None = None) -> DataFrame:
    """length, reads, bases; lengths from cap on share a row."""
    n = F.length("bases") if cap is None else F.least(F.length("bases"), F.lit(cap))
    return reads.groupBy(n.cast("long").alias("length")).agg(F.count("*").alias("reads"), F.sum(F.length("bases")).cast("long").alias("bases"))


def gc(reads: DataFrame, bins: int = 100) -> DataFrame:
    """gc_bin, reads, bases: bin floor(gc * bins), a pure read in the last."""
    b = F.least(F.floor(B.gc_fraction("bases") * bins), F.lit(bins - 1)).cast("long")
    return reads.groupBy(b.alias("gc_bin")).agg(F.count("*").alias("reads"), F.sum(F.length("bases")).cast("long").alias("bases"))


def base_composition(reads: DataFrame) -> DataFrame:
    """mate, pos, a, c, g, t, n: counts; fractions of a row's sum make the table."""
    is_ = lambda x: F.count(F.when(F.col("base") == x, 1))
    rows = _places(reads, "mate").withColumn("base", F.when(F.col("base").isin(*"ACGT"), F.col("base")).when(F.col("base") == "U", "T").otherwise("N"))
    return rows.groupBy("mate", "pos").agg(*(is_(x).alias(x.lower()) for x in "ACGTN"))


def base_fractions(reads: DataFrame) -> DataFrame:
    """pos, a, c, g, t, n as fractions; mate 2 follows mate 1."""
    counts = base_composition(reads)
    first = counts.where("mate = 1").agg((F.max("pos") + 1).alias("shift"))
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t") + F.col("n")
    return counts.crossJoin(F.broadcast(first)).select((F.col("pos") + F.when(F.col("mate") == 2, F.coalesce("shift", F.lit(0))).otherwise(0)).alias("pos"), *((F.col(x) / total).alias(x) for x in "acgtn"))  # one row


def entropy(reads: DataFrame, c: Config) -> DataFrame:
    """value, count: reads by the mean Shannon entropy of their windows.

    A window of entropy_window bases holds its entropy_k-mers; entropy is over their
    counts, divided by the logarithm of the number that fit (or of 4**k if less); reads
    shorter than a window are one window (our formula).  Windows stand side by side.
    """
    ship(reads.sparkSession)
    k, w, bins, with_ns = c.entropy_k, c.entropy_window, c.entropy_bins, c.entropy_ns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ENTROPY_READS):
                yield pa.RecordBatch.from_arrays([pa.array(mean_entropy(batch.column(0).slice(i, ENTROPY_READS).to_pylist(), k, w, with_ns))], ["mean"])

    each = reads.where(F.length("bases") > 0).select("bases").mapInArrow(run, "mean double")
    return each.groupBy(F.least(F.floor(F.col("mean") * bins + 1e-9), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("count")).select((F.col("bin") / bins).alias("value"), "count")


def mean_entropy(texts: list[str], k: int, w: int, with_ns: bool) -> np.ndarray:
    """Of each text, none empty, the mean entropy of its windows; see entropy."""
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t) for t in texts], np.int64)
    pieces = np.maximum(length // w, 1)
    text = np.repeat(np.arange(len(texts)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(length) - length)[text] + number * w
    many = np.maximum(np.minimum(length[text], w) - k + 1, 0)
    piece = np.repeat(np.arange(len(text)), many)
    at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(len(piece))
    if not with_ns:
        bad = np.concatenate([[0], np.cumsum(~np.isin(letters, np.frombuffer("ACGT".encode("utf-32-le"), np.uint32)))])
        good = bad[np.minimum(at + k, len(letters))] == bad[at]
        piece, at = piece[good], at[good]
    known, letter = np.unique(letters, return_inverse=True)
    kmer, kinds = np.zeros(len(at), np.int64), 1
    for i in range(k):
        if kinds * len(known) >= 1 << 31:
            some, kmer = np.unique(kmer, return_inverse=True)
            kinds = len(some)
        kmer = kmer * len(known) + letter[at + i]
        kinds *= len(known)
    if kinds * max(1, len(text)) >= 1 << 62:
        some, kmer = np.unique(kmer, return_inverse=True)
        kinds = len(some)
    both = np.sort(piece * kinds + kmer)
    head = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    of = both[head] // kinds
    total = np.bincount(piece, minlength=len(text))
    share = np.diff(np.append(head, len(both))) / total[of]
    h = np.bincount(of, -share * np.log(share), len(text))
    h = np.where((many > 1) & (total > 1), h / np.log(np.clip(total, 2, 4 ** min(k, 30))), 0.0)
    return np.bincount(text, h, len(texts)) / pieces


def identity(reads: DataFrame) -> DataFrame:
    """identity, reads, bases: without an alignment all reads are at 100."""
    return reads.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.length("bases")), F.lit(0)).cast("long").alias("bases")).select(F.lit(100.0).alias("identity"), "reads", "bases")


def matches(reads: DataFrame) -> DataFrame:
    """mate, pos, match, n: without an alignment a base matches or is N."""
    rows = _places(reads, "mate")
    good = F.col("base").isin(*"ACGTU")
    return rows.groupBy("mate", "pos").agg(F.count(F.when(good, 1)).alias("match"), F.count(F.when(~good, 1)).alias("n"))


def errors(reads: DataFrame) -> DataFrame:
    """errors, reads: without an alignment none."""
    return reads.agg(F.count("*").alias("reads")).select(F.lit(0).cast("long").alias("errors"), "reads")


def quality_accuracy(reads: DataFrame) -> DataFrame:
    """quality, match, sub, ins, del: without an alignment every called base matches."""
    rows = _places(reads).where(F.col("q").isNotNull() & F.col("base").isin(*"ACGTU"))
    return rows.groupBy(F.col("q").alias("quality")).agg(F.count("*").alias("match")).select("quality", "match", *(F.lit(0).cast("long").alias(x) for x in ("sub", "ins", "del")))


def empty_lengths(reads: DataFrame, *columns: str) -> DataFrame:
    """A table of insert or indel sizes: unaligned reads have none."""
    return reads.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in columns))


def barcodes(reads: DataFrame) -> DataFrame:
    """barcode, reads: most first, then by name."""
    return reads.groupBy(B.barcode("id").alias("barcode")).agg(F.count("*").alias("reads")).orderBy(F.desc("reads"), "barcode")


def barcode_text(reads: DataFrame) -> str:
    rows = barcodes(reads).collect()
    return "\n".join([f"#Reads\t{sum(r.reads for r in rows)}", f"#Barcodes\t{len(rows)}", *(f"{r.barcode}\t{r.reads}" for r in rows)]) + "\n"
