"""Which reads stay, and which depth bin they fall in.

Rules where the depth formulas are our own, by name:
depth(p): the valid depths in descending order at index min(n - 1, floor(n * p)).
A pair's depth is the lesser (or greater) of its mates'.  A read is bad if its low depth
is at most lt, its high depth at least ht and at least edr times the low one.
The coin of a unit is the first 32 bits of the MD5 of its name: whatever the order or
number of partitions, the same reads stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.config import Config


def depth_at(cov: Column, p: float) -> Column:
    """Of an ascending array of valid depths, the one at percentile p from the top; 0 if there is none."""
    n = F.size(cov)
    return F.when(n > 0, F.element_at(cov, n - F.least(n - 1, F.floor(n * F.lit(p)).cast("int")))).otherwise(F.lit(0).cast("long"))


def score(cov: DataFrame, c: Config) -> DataFrame:
    """cov's reads with depth, true_depth, high, low, good (k-mers of min depth or more), bad."""
    valid = cov.withColumn("sorted", F.sort_array(F.filter("cov", lambda x: x >= 0)))
    s = F.col("sorted")
    scored = valid.withColumns({
        "depth": depth_at(s, c.percentile),
        "high": depth_at(s, 1 - c.high_percentile),
        "low": depth_at(s, 1 - c.low_percentile),
        "good": F.size(F.filter(s, lambda x: x >= c.min_depth)),
        "n_kmers": F.size(s),
    }).drop("sorted")
    return scored.withColumn("bad", (F.col("low") <= c.low_thresh) & (F.col("high") >= c.high_thresh) & (F.col("high") >= F.col("low") * c.error_detect_ratio))


def coin(*name: str) -> Column:
    """A number in 0..2**32-1 fixed by the unit's name."""
    text = F.concat_ws(":", *(F.col(n).cast("string") for n in name))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def keep_by_depth(depth: Column, target: Column | int, most: int, toss: Column) -> Column:
    target = F.lit(target) if isinstance(target, int) else target
    return (depth <= most) | (toss * depth < F.lit(2**32) * target)


def too_short(c: Config) -> Column:
    return (F.col("good") < c.min_kmers) | (F.col("length") < c.min_length)


def decide_single(scored: DataFrame, c: Config, *name: str, first: bool = False) -> DataFrame:
    """scored with keep and bin, each read for itself."""
    most = max(c.max_depth or c.target, c.target)
    keep = ~too_short(c) & keep_by_depth(F.col("depth"), c.target, most, coin(*name))
    return scored.withColumns({"keep": _rules(keep, F.col("bad"), F.col("depth"), c, first), "bin": depth_bin(F.col("depth"), c)})


def _rules(keep: Column, bad: Column, depth: Column, c: Config, first: bool) -> Column:
    """Bad-read tossing, rare-read saving, discarding bad reads only, and keepall, over the depth decision."""
    if c.keep_all:
        return F.lit(True)
    if c.discard_bad_only_first if first else c.discard_bad_only:
        return ~bad
    toss_bad = c.toss_bad_first if first else c.toss_bad
    if toss_bad:
        gone = bad & (depth > c.target) if c.save_rare else bad
        keep = keep & ~gone
    return keep


def depth_bin(depth: Column, c: Config) -> Column:
    return F.when(depth <= c.low_bin, "low").when(depth >= c.high_bin, "high").otherwise("mid")


def decide_pairs(scored: DataFrame, c: Config, *pair: str, first: bool = False, by: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """One row per pair: pair columns, depth, bad, keep, bin, and more aggregates. A mate that is missing has no say. by: what tells pairs apart, if not the pair columns."""
    combine = F.min if c.use_lower_depth else F.max
    most = max(c.max_depth or c.target, c.target)
    both = F.min(F.col("bad")) if c.require_both_bad else F.max(F.col("bad"))
    more = (*more, *(F.first(x).alias(x) for x in pair if by and x not in by))
    pairs = scored.groupBy(*(by or pair)).agg(combine("depth").alias("depth"), both.alias("bad"), F.sum("length").alias("length"), F.max(~too_short(c)).alias("enough"), *more)
    target = F.lit(c.target)
    if first:  # intermediate passes aim higher for bad pairs between the two fractions
        target = F.when(F.col("bad"), F.greatest(F.lit(1), F.floor(F.lit(c.target * c.target_bad_low)))).otherwise(F.floor(F.lit(c.target * c.target_bad_high)))
    keep = F.col("enough") & keep_by_depth(F.col("depth"), target, most, coin(*pair))
    return pairs.withColumns({"keep": _rules(keep, F.col("bad"), F.col("depth"), c, first), "bin": depth_bin(F.col("depth"), c)})
