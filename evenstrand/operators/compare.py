"""How far two histograms are apart, in counts and parts per million of the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most ppm that approximate histograms may drift, by strictness: input raw, input unique, output raw, output unique.
GATES = {"bounded": (5000, 5000, 2000, 2000), "strict": (700, 600, 250, 250)}


def _ppm(delta: Column, first: Column, second: Column) -> Column:
    base = F.when(first > 0, first).otherwise(second)
    return F.when(base > 0, F.ceil(delta * 1_000_000 / base)).when(delta == 0, 0).cast("long")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: identical, first_diff (least depth that differs), and per column both totals, summed and greatest differences and ppm."""
    columns = ["raw_count", "unique_kmers"]
    named = lambda df, side: df.select("depth", *(F.col(c).alias(f"{c}_{side}") for c in columns))
    both = named(left, "left").join(named(right, "right"), "depth", "full").na.fill(0)
    differs = F.lit(False)
    sums = []
    for c in columns:
        a, b = F.col(f"{c}_left"), F.col(f"{c}_right")
        differs = differs | (a != b)
        sums += [F.coalesce(F.sum(a), F.lit(0)).alias(f"{c}_left"), F.coalesce(F.sum(b), F.lit(0)).alias(f"{c}_right"), F.coalesce(F.sum(F.abs(a - b)), F.lit(0)).alias(f"{c}_delta"), F.coalesce(F.max(F.abs(a - b)), F.lit(0)).alias(f"{c}_most")]
    totals = both.agg(F.min(F.when(differs, F.col("depth"))).alias("first_diff"), *sums)
    return totals.select(F.col("first_diff").isNull().alias("identical"), "first_diff", *(F.col(f"{c}_{x}") for c in columns for x in ("left", "right", "delta", "most")), *(_ppm(F.col(f"{c}_delta"), F.col(f"{c}_left"), F.col(f"{c}_right")).alias(f"{c}_ppm") for c in columns))


def within(compared: DataFrame, raw_ppm: int, unique_ppm: int) -> bool:
    """Whether a comparison stays within the gates."""
    row = compared.first()
    return (row.raw_count_ppm or 0) <= raw_ppm and (row.unique_kmers_ppm or 0) <= unique_ppm
