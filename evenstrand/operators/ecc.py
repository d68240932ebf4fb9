"""Correction and marking of errors in reads.

Table correction (our rule).  Between neighbouring windows a, b of a read, b is a drop if
a >= high and b <= low, or a >= ratio * max(b, 1).  Coming from the left the suspect is the
base that b adds, from the right the base that b drops.  Each round corrects at most one
base per read: the substitution whose k-mer is deepest, of high depth or more.  As many
rounds run as ecclimit allows; a read that still has a suspect is uncorrected.

Overlap repair works on each pair by itself, before the table: where the mates overlap
without doubt, a base on which they differ takes the value of better quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.config import Config
from evenstrand.functions import kmers
from evenstrand.operators import counting, rounds, trim
from evenstrand.ship import ship


def _drop(a: Column, b: Column, c: Config) -> Column:
    return (a >= 0) & (b >= 0) & (((a >= c.ecc_high) & (b <= c.ecc_low)) | (a >= c.ecc_ratio * F.greatest(b, F.lit(1))))


def suspects(cov: Column, c: Config) -> Column:
    """Places (from 0) of suspect bases of a read with this coverage, as structs place, window."""
    n = F.size(cov)
    steps = F.sequence(F.lit(1), n - 1)
    left = F.filter(steps, lambda i: _drop(F.get(cov, i - 1), F.get(cov, i), c))
    right = F.filter(steps, lambda i: _drop(F.get(cov, i), F.get(cov, i - 1), c))
    none = F.array().cast("array<struct<place: int, window: int>>")
    one = F.transform(left, lambda i: F.struct((i + c.k - 1).cast("int").alias("place"), i.cast("int").alias("window")))
    two = F.transform(right, lambda i: F.struct((i - 1).cast("int").alias("place"), (i - 1).cast("int").alias("window")))
    both = F.concat(one if c.correct_left else none, two if c.correct_right else none)
    # what any drop needs, without a walk over the steps
    may = (n >= 2) & (F.array_max(cov) >= min(c.ecc_high, c.ecc_ratio))
    if c.ecc_high > c.ecc_low and c.ecc_ratio > 1:
        may &= F.array_max(cov) > F.array_min(cov)
    return F.when(may, F.array_distinct(both)).otherwise(none)


def _covered(reads: DataFrame, key: list[str], counts: DataFrame | counting.Counted, c: Config, keep: tuple[str, ...] | None = None) -> DataFrame:
    others = tuple(x for x in reads.columns if x not in key) if keep is None else keep
    return counting.coverage(counting.Reads(reads, tuple(key), tuple(key)), counts, c.replace(fix_spikes=False), others).select(*key, *others, "cov")


def _deep(tries: DataFrame, counts: DataFrame | counting.Counted, c: Config) -> DataFrame:
    """tries (window, a text of k bases, and other columns) whose k-mer is of high depth or more, with that depth."""
    if isinstance(counts, counting.Counted):
        others = tuple(x for x in tries.columns if x != "window")
        met = counting.coverage(counting.Reads(tries, others, others, bases="window"), counts, c.replace(fix_spikes=False))
        return met.select(*others, F.get("cov", F.lit(0)).alias("depth")).where(F.col("depth") >= c.ecc_high)
    return tries.withColumn("kmer", kmers.key("window", F.lit(1), c.k)).join(counts, "kmer").where(F.col("depth") >= c.ecc_high)


def correct(reads: DataFrame, key: list[str], counts: DataFrame | counting.Counted, c: Config, save: Callable[[DataFrame, str], DataFrame], forget: Callable[[DataFrame], None] = lambda table: None) -> DataFrame:
    """reads with corrected bases, n_errors (bases changed) and uncorrected. save writes a table between rounds, forget deletes one."""
    if rounds.fits(counts, c):
        return rounds.correct(reads, counts, c, save, forget)
    state = reads.withColumn("n_errors", F.lit(0))
    for _ in range(c.ecc_limit):
        covered = _covered(state, key, counts, c).withColumn("sites", suspects(F.col("cov"), c)).drop("cov")
        state = save(covered, "ecc")  # with the sites, for the tries and for what they change
        open_ = state.select(*key, "bases", "quals", "sites").where(F.size("sites") > 0)
        q = F.ascii(F.substring(F.col("quals"), F.col("s.place") + 1, F.lit(1))) - 33
        sites = open_.select(*key, "bases", "quals", F.explode("sites").alias("s")).where(F.coalesce(q, F.lit(0)) <= c.ecc_max_quality)
        tries = sites.select(*key, "s", F.explode(F.array(*(F.lit(x) for x in "ACGT"))).alias("base"), "bases").where(F.upper(F.substring(F.col("bases"), F.col("s.place") + 1, F.lit(1))) != F.col("base"))
        fixed = F.concat(F.expr("substring(bases, 1, s.place)"), "base", F.expr("substring(bases, s.place + 2)"))
        tries = tries.select(*key, "s", "base", F.substring(fixed, F.col("s.window") + 1, F.lit(c.k)).alias("window")).where(F.col("window").rlike("^[ACGT]+$"))
        best = _deep(tries, counts, c).groupBy(*key).agg(F.max(F.struct("depth", F.negative("s.place").alias("p"), "base")).alias("x"))
        best = best.select(*key, F.negative("x.p").alias("place"), F.col("x.base").alias("base"))
        joined = state.drop("sites").join(best, key, "left")
        changed = F.when(F.col("base").isNull(), F.col("bases")).otherwise(F.concat(F.expr("substring(bases, 1, place)"), "base", F.expr("substring(bases, place + 2)")))
        state = save(joined.withColumns({"bases": changed, "n_errors": F.col("n_errors") + F.col("base").isNotNull().cast("int")}).drop("place", "base"), "ecc")
    return _covered(state, key, counts, c).withColumn("uncorrected", F.size(suspects(F.col("cov"), c)) > 0).drop("cov")


def marked(quals: Column, places: Column, with_one: bool) -> Column:
    """Qualities lowered at places: to 1, or to half less 3, at least 2."""
    lower = lambda q: F.lit(1) if with_one else F.greatest(F.lit(2), F.floor(q / 2) - 3)
    one = lambda i: F.when(F.array_contains(places, i - 1), F.char((lower(F.ascii(F.substring(quals, i, F.lit(1))) - 33) + 33).cast("long"))).otherwise(F.substring(quals, i, F.lit(1)))
    return F.when((F.length(quals) > 0) & (F.size(places) > 0), F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(quals)), one))).otherwise(quals)


def mark(reads: DataFrame, key: list[str], counts: DataFrame | counting.Counted, c: Config, keep: tuple[str, ...] | None = None) -> DataFrame:
    """reads (of other columns than the key, those to keep, quals among them) with the qualities of all suspect bases lowered, and n_errors; trimmed afterwards if c says so."""
    found = _covered(reads, key, counts, c, keep).withColumn("__s", F.transform(suspects(F.col("cov"), c), lambda x: x["place"])).drop("cov")
    out = found.withColumns({"quals": marked(F.col("quals"), F.col("__s"), c.mark_with_one), "n_errors": F.size(F.array_distinct("__s"))}).drop("__s")
    return trim.trim(out, c) if c.trim_after_marking else out


# overlap

#: Shortest mate and overlap, greatest share of mismatches, and how much better than any other offset the best must be (our values).
SHORTEST = 35
LEAST_OVERLAP = 14
WORST = 0.2
MARGIN = 3


def best_overlap(a: np.ndarray, b: np.ndarray) -> int | None:
    """Where b begins in a (possibly before it): the offset of least mismatches, or None if none is beyond doubt."""
    n, m = len(a), len(b)
    scored = []
    for shift in range(LEAST_OVERLAP - m, n - LEAST_OVERLAP + 1):
        i, j = max(0, shift), min(n, shift + m)
        wrong = int((a[i:j] != b[i - shift : j - shift]).sum())
        scored.append((wrong - 0.25 * (j - i), wrong, j - i, shift))
    scored.sort()
    if not scored:
        return None
    best = scored[0]
    if best[1] > WORST * best[2] or (len(scored) > 1 and scored[1][0] - best[0] < MARGIN):
        return None
    return best[3]


def _repair(b1: str, q1: str, b2: str, q2: str) -> tuple[str, str, str, str]:
    if min(len(b1), len(b2)) < SHORTEST:
        return b1, q1, b2, q2
    x, y = np.frombuffer(b1.encode(), np.uint8).copy(), np.frombuffer(b2.translate(_COMPLEMENT)[::-1].encode(), np.uint8).copy()
    p, q = np.frombuffer(q1.encode(), np.uint8).copy(), np.frombuffer(q2[::-1].encode(), np.uint8).copy()
    shift = best_overlap(x, y)
    if shift is None:
        return b1, q1, b2, q2
    i, j = max(0, shift), min(len(x), shift + len(y))
    u, v, s, t = x[i:j], y[i - shift : j - shift], p[i:j], q[i - shift : j - shift]
    differ = u != v
    first, second = differ & (s > t), differ & (t > s)
    merged = np.maximum(2 + 33, np.abs(s.astype(int) - t.astype(int)) + 33).astype(np.uint8)
    v[first], u[second] = u[first], v[second]
    t[first], s[second] = merged[first], merged[second]
    return x.tobytes().decode(), p.tobytes().decode(), y.tobytes().decode()[::-1].translate(_COMPLEMENT), q.tobytes().decode()[::-1]


_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def repair_pairs(pairs: DataFrame, bases: tuple[str, str] = ("bases1", "bases2"), quals: tuple[str, str] = ("quals1", "quals2")) -> DataFrame:
    """Wide pairs with the mates' differences in their overlap repaired; pairs without qualities stay."""
    ship(pairs.sparkSession)
    names = [bases[0], quals[0], bases[1], quals[1]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rows = [_repair(*r) if all(isinstance(x, str) for x in r) else r for r in frame[names].itertuples(index=False, name=None)]
                for n, column in zip(names, zip(*rows, strict=True), strict=True):
                    frame[n] = column
            yield frame

    return pairs.mapInPandas(run, pairs.schema)
