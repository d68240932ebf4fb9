"""Quality trimming of reads, applied after counting and before scoring.

optimal (default): the stretch of the greatest sum of (cutoff - error chance), the cutoff
being the bias or the error chance of trimq; window: the right end from the first window
whose mean is under trimq; simple: bases under trimq go from an end until good ones
stand in a row.  Reads without qualities stay whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.config import Config
from evenstrand.functions.bases import numbers


def simple(q: Column, c: Config) -> tuple[Column, Column]:
    """Bases to cut off left and right: up to the first, and after the last, run of good ones."""
    n, need = F.size(q), c.trim_good_interval
    good = lambda i: F.forall(F.slice(q, i, need), lambda x: x >= c.trim_quality)
    starts = F.when(n >= need, F.filter(F.sequence(F.lit(1), n - need + 1), good)).otherwise(F.array().cast("array<int>"))
    none = F.size(starts) == 0
    left = F.when(none, n).otherwise(F.element_at(starts, 1) - 1)
    right = F.when(none, n).otherwise(n - (F.element_at(starts, -1) + need - 1))
    return left, right


def window(q: Column, c: Config) -> tuple[Column, Column]:
    n, w = F.size(q), c.trim_window_length
    low = lambda i: F.aggregate(F.slice(q, i, w), F.lit(0), lambda a, x: a + x) < c.trim_quality * w
    bad = F.when(n >= w, F.filter(F.sequence(F.lit(1), n - w + 1), low)).otherwise(F.array().cast("array<int>"))
    return F.lit(0), F.when(F.size(bad) > 0, n - (F.element_at(bad, 1) - 1)).otherwise(0)


def optimal(q: Column, c: Config) -> tuple[Column, Column]:
    """Kadane's scan with the leftmost, longest best stretch; all is cut if no stretch is worth keeping."""
    cutoff = c.trim_bias if c.trim_bias is not None else 10 ** (-c.trim_quality / 10)
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("from"), F.lit(0.0).alias("best"), F.lit(0).alias("a"), F.lit(0).alias("b"))

    def step(s, x):
        gain = F.lit(cutoff) - F.pow(F.lit(10.0), -x / 10)
        fresh = s["sum"] <= 0
        total = F.when(fresh, gain).otherwise(s["sum"] + gain)
        begin = F.when(fresh, s["i"]).otherwise(s["from"])
        better = total > s["best"]
        return F.struct((s["i"] + 1).alias("i"), total.alias("sum"), begin.alias("from"), F.when(better, total).otherwise(s["best"]).alias("best"), F.when(better, begin).otherwise(s["a"]).alias("a"), F.when(better, s["i"] + 1).otherwise(s["b"]).alias("b"))

    found = F.aggregate(q, zero, step)
    return found["a"], F.size(q) - found["b"]


def trim(reads: DataFrame, c: Config) -> DataFrame:
    """reads with bases and quals cut at the sides that c names."""
    if not (c.trim_left or c.trim_right):
        return reads
    rule = window if c.trim_window else optimal if c.trim_optimal else simple
    with_q = reads.withColumn("__q", F.coalesce(numbers("quals"), F.array().cast("array<int>")))
    left, right = rule(F.col("__q"), c)
    cut = with_q.withColumns({"__l": left if c.trim_left else F.lit(0), "__r": right if c.trim_right else F.lit(0)})
    whole = F.col("quals").isNull()
    keep = F.greatest(F.lit(0), F.length("bases") - F.col("__l") - F.col("__r"))
    piece = lambda x: F.when(whole, F.col(x)).otherwise(F.substring(x, F.col("__l") + 1, keep))
    return cut.withColumns({"bases": piece("bases"), "quals": piece("quals")}).drop("__q", "__l", "__r")
