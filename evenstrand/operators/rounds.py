"""Table correction (rule: operators/ecc) of reads by the counts of reads, in rounds by runs of windows.

A suspect is the first or last base of a window, so the k-mers to try differ from the
window's in that base alone.  Buckets go by the letters between (runs.buckets_of), where
these meet: the bucket that says a window's depth also names the bases that would make it
deep, and a batch of reads finds its suspects and changes bases as soon as it has its
answers.  Depths never change, so a read without a change is settled; only changed reads go
into another round, against the k-mers and depths that the first one keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenstrand.config import Config
from evenstrand.functions import kmers, runs
from evenstrand.operators import batches, counting

FINAL, N_ERRORS = "uncorrected", "n_errors"
ANSWERS = "bucket int, batch long, check long, n int, pack binary, more binary, others binary, keys binary, depths binary"
#: Letters that a tried window may hold.
PLAIN = np.isin(np.arange(256), np.frombuffer(b"ACGT", np.uint8))


def fits(counts: object, c: Config) -> bool:
    """Whether reads can be corrected by runs: k-mers of whole letters, with some between first and last."""
    return isinstance(counts, counting.Counted) and 3 <= c.k <= kmers.SHORT and counts.c.k == c.k


def correct(reads: DataFrame, counts: counting.Counted, c: Config, save: Callable[[DataFrame, str], DataFrame], forget: Callable[[DataFrame], None]) -> DataFrame:
    """reads with corrected bases, n_errors, uncorrected. Qualities may be left out where none can be above ecc_max_quality."""
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(8 * n, runs.NONE - 1)  # a pack a batch and bucket: fewer, of larger batches, than elsewhere
    schema = T.StructType([*reads.schema, T.StructField(N_ERRORS, T.IntegerType()), T.StructField(FINAL, T.BooleanType())])
    names, whole = reads.columns, [x.name for x in schema]
    if counts.reads.df is reads and counts.reads.bases == "bases":
        cut = counting._runs(counts.reads, counts.c, buckets, names, True, core=True)
    else:
        own = counting._runs(counting.Reads(reads, (), ()), counts.c, buckets, names, False, core=True)
        cut = own.unionByName(counting._runs(counts.reads, counts.c, buckets, None, True, core=True))
    answers = save(_met(cut, None, n, counts.c, c, c.ecc_limit > 0), "answers")
    kept, states = answers.where(F.col("keys").isNotNull()).select("bucket", "keys", "depths"), []
    for number in range(c.ecc_limit + 1):
        states.append(save(_settled(answers.where("batch >= 0").drop("keys", "depths"), n, number == c.ecc_limit, c), "ecc"))
        if number < c.ecc_limit:
            changed = batches.read_packs(states[-1].where("changed"), schema)
            cut = counting._runs(counting.Reads(changed, (), ()), counts.c, buckets, whole, False, core=True)
            met = _met(cut, kept, n, counts.c, c, number + 1 < c.ecc_limit)
            if number:
                forget(answers)
            else:
                first = answers
            answers = save(met, "answers")
    forget(answers)
    if c.ecc_limit:
        forget(first)
    out = None
    for state in states:
        settled = batches.read_packs(state.where("NOT changed"), schema)
        out = settled if out is None else out.unionByName(settled)
    return out


def _met(cut: DataFrame, kept: DataFrame | None, n: int, by: Config, c: Config, tries: bool) -> DataFrame:
    """The packs of cut with depths and, if tries are to follow, deep others of their windows; without k-mers kept from before, these are counted, and rows with them added."""
    none = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    rows = cut.select("*", *none("others", "keys", "depths"))
    if kept is not None:
        of_kept = kept.select("bucket", F.lit(-1).cast("long").alias("batch"), F.lit(0).cast("long").alias("check"), F.lit(0).alias("n"), *none("pack", "more", "others"), "keys", "depths")
        rows = rows.unionByName(of_kept)
    k, high, first = c.k, c.ecc_high if tries else 1 << 62, kept is None
    least = 2 if by.build_passes > 1 else 0  # see counting.rebuild
    # a depth of 1 is like none where neither is high and both are low
    lowest = 2 if least or (c.ecc_low >= 1 and c.ecc_high > 1 and c.ecc_ratio > 1) else 1

    def answer(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in counting.groups(given, "bucket"):
            if rows.column("bucket")[0].as_py() < 0:
                yield rows
                continue
            known = None
            if not first:
                held = rows.filter(rows.column("keys").is_valid())
                rows = rows.filter(rows.column("pack").is_valid())
                if not rows.num_rows:
                    continue
                known = tuple(np.frombuffer(b"".join(held.column(x).to_pylist()), np.int64) for x in ("keys", "depths"))
            packs = list(zip(rows.column("n").to_pylist(), rows.column("pack").to_pylist(), strict=True))
            answers, others, keys, depths = runs.judged(packs, k, least, high, known)
            for name, values in (("pack", answers), ("others", others)):
                rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values, pa.binary()))
            yield rows.filter(pc.greater_equal(rows.column("batch"), 0))
            if first:
                has = depths >= lowest
                one = {"bucket": rows.column("bucket")[0].as_py(), "batch": -1, "check": 0, "n": 0, "keys": keys[has].tobytes(), "depths": depths[has].tobytes()}
                yield pa.RecordBatch.from_pylist([one], rows.schema)

    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, ANSWERS)


def _settled(answers: DataFrame, n: int, last: bool, c: Config) -> DataFrame:
    """changed, pack: of each batch the reads that are settled, and those whose bases this round changed; the last round changes none."""

    def back(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in counting.groups(given, "batch"):  # the head comes first, as its bucket is negative
            if rows.column("bucket")[0].as_py() >= 0 or pc.count_distinct(rows.column("check")).as_py() > 1:
                raise ValueError("packs of a batch of reads do not fit: the reads came in another order when a lost stage was run again")
            many, of = counting.sizes(rows.slice(0, 1))
            packs = rows.column("pack").to_pylist()
            reads = batches._opened(packs[0])
            to = runs.places(many, of)
            found = _others(packs[1:], rows.column("others").to_pylist()[1:], to)
            read = np.repeat(np.arange(reads.num_rows), reads.column("__w").to_numpy())
            reads = reads.drop_columns(["__n", "__w"])
            if N_ERRORS not in reads.schema.names:
                reads = reads.append_column(N_ERRORS, pa.array(np.zeros(reads.num_rows, np.int32))).append_column(FINAL, pa.array(np.zeros(reads.num_rows, bool)))
            reads, changed = judge(reads, read, runs.placed(many, of, packs[1:], to), found, last, c)
            for which in (False, True):
                some = reads.filter(pa.array(changed == which))
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([which]), pa.array([batches._closed(some)], pa.binary())], ["changed", "pack"])

    return answers.repartition(n, "batch").sortWithinPartitions("batch", "bucket").mapInArrow(back, "changed boolean, pack binary")


def _others(answers: list[bytes], others: list[bytes], to: np.ndarray) -> np.ndarray:
    """The OTHERs of a batch, their windows numbered in it, ordered by window and side."""
    sizes = np.array([(len(x) - 1) // x[0] for x in answers], np.int64)
    out = np.frombuffer(b"".join(others), runs.OTHER).astype([("window", "<i8"), *runs.OTHER.descr[1:]])
    many = np.array([len(x) // runs.OTHER.itemsize for x in others], np.int64)
    out["window"] = to[out["window"] + np.repeat(np.cumsum(sizes) - sizes, many)] if len(out) else 0
    return out[np.argsort(2 * out["window"] + out["side"])]


def judge(reads: pa.RecordBatch, read: np.ndarray, cov: np.ndarray, others: np.ndarray, last: bool, c: Config) -> tuple[pa.RecordBatch, np.ndarray]:
    """reads after a round, and which of them it changed. read, cov: of each window its read and depth."""
    none = np.zeros(0, np.int64)
    # a deep window before or after a shallow one; few are deep enough for any drop
    deep = np.flatnonzero(cov >= max(0, min(c.ecc_high, c.ecc_ratio)))

    def drops(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = cov[a], cov[b]
        return b[(read[a] == read[b]) & (y >= 0) & (((x >= c.ecc_high) & (y <= c.ecc_low)) | (x >= c.ecc_ratio * np.maximum(y, 1)))]

    before, after = deep[deep < len(cov) - 1], deep[deep > 0]
    left = drops(before, before + 1) if c.correct_left else none
    right = drops(after, after - 1) if c.correct_right else none
    suspect, changed = np.zeros(reads.num_rows, bool), np.zeros(reads.num_rows, bool)
    suspect[read[left]] = suspect[read[right]] = True
    reads = reads.set_column(reads.schema.get_field_index(FINAL), FINAL, pa.array(suspect))
    if last or not len(left) + len(right):
        return reads, changed
    data, offsets = counting.flat(reads.column("bases"))
    window = np.append(left, right)
    added = np.arange(len(window)) < len(left)  # the suspect is the window's last base
    start = offsets[:-1][read[window]] + window - np.searchsorted(read, read[window])
    at = start + np.where(added, c.k - 1, 0)
    may = np.ones(len(window), bool)
    if "quals" in reads.schema.names:
        may = _quality(reads.column("quals"), read[window], at - offsets[:-1][read[window]]) <= c.ecc_max_quality
    spoilt = np.concatenate([[0], np.cumsum(~PLAIN[data])])
    may &= spoilt[start + c.k] - spoilt[start] == ~PLAIN[data[at]]
    window, added, start, at = window[may], added[may], start[may], at[may]
    forward, back = kmers.packed_strands(kmers.packed(np.minimum(kmers.CODES[data], 3)), start, c.k)
    turned = forward < back
    slot, known = 2 * window + np.where(added ^ turned, runs.LAST, runs.FIRST), 2 * others["window"] + others["side"]
    place = np.minimum(np.searchsorted(known, slot), max(0, len(known) - 1))
    hit = np.flatnonzero(known[place] == slot) if len(known) else none
    bits = others["bases"][place[hit]]
    bits = np.where(turned[hit], TURNED[bits], bits)
    tries = [(at[hit], others["depth"][place[hit]], HIGHEST[bits])]
    # a U is tried as T, which is the same k-mer
    same_kmer = np.flatnonzero(np.isin(data[at], np.frombuffer(b"Uu", np.uint8)) & (cov[window] >= c.ecc_high))
    tries.append((at[same_kmer], cov[window[same_kmer]], np.full(len(same_kmer), 3)))
    at, depth, base = (np.concatenate(x) for x in zip(*tries, strict=True))
    of = np.searchsorted(offsets, at, side="right") - 1
    order = np.lexsort((base, -at, depth, of))
    order = order[np.append(of[order][1:] != of[order][:-1], True)] if len(order) else order
    at, of = at[order], of[order]
    fixed = data.copy()
    fixed[at] = runs.LETTERS[base[order]]
    changed[of] = True
    bases = pa.LargeStringArray.from_buffers(reads.num_rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(fixed)).cast(pa.string())
    if reads.column("bases").null_count:
        bases = pc.if_else(reads.column("bases").is_valid(), bases, pa.scalar(None, pa.string()))
    reads = reads.set_column(reads.schema.get_field_index("bases"), "bases", bases)
    errors = reads.column(N_ERRORS).to_numpy() + changed.astype(np.int32)
    return reads.set_column(reads.schema.get_field_index(N_ERRORS), N_ERRORS, pa.array(errors, pa.int32())), changed


#: Of a set of bases as bits: that of their complements, and the last in the order of letters.
TURNED = np.array([sum(8 >> i for i in range(4) if x >> i & 1) for x in range(16)], np.uint8)
HIGHEST = np.array([max(0, x.bit_length() - 1) for x in range(16)])


def _quality(quals: pa.Array, read: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The quality at a place of a read: 0 if it has none at all, -33 beyond their end."""
    data, offsets = counting.flat(quals)
    valid = quals.is_valid().to_numpy(zero_copy_only=False)[read]
    at = offsets[:-1][read] + place
    inside = at < offsets[1:][read]
    return np.where(valid, np.where(inside, np.append(data, 0)[np.where(inside, at, len(data))], 0).astype(np.int64) - 33, 0)
