"""K-mer counts and the depth of reads.

Reads come as a DataFrame with a unit (read, or pair of reads), a place in it and bases;
`KmerSource` names the columns.  Keys are made by numpy kernels over Arrow batches,
counted by Spark with map-side partial sums.  A k-mer counts once per unit (rdk).

Histograms of valid k-mers need no join: k-mers are counted per unit, then per key.
Scoring reads against the counts of reads (Counted) makes no table of counts and no row a
window: windows travel as runs (functions/runs) to the bucket of their k-mers, are counted
and answered there, and the depths go back to their batch of reads.
Scoring against a table of counts joins it; a key of very many reads is split by Spark's
skew join, since counts are written as a table first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenstrand.config import Config
from evenstrand.functions import kmers, runs
from evenstrand.ship import ship

#: Bytes of bases worked on at once, and of a batch whose windows travel as runs.
CHUNK, BATCH = 1 << 20, 1 << 19


@dataclass(frozen=True)
class Reads:
    """Reads with the columns that identify them: `unit` within which a k-mer counts once, `key` of one read.

    together: the rows of a unit already come one after another, in one partition.
    """

    df: DataFrame
    unit: tuple[str, ...] = ("doc_id", "frag")
    key: tuple[str, ...] = ("doc_id", "frag")
    bases: str = "bases"
    quals: str | None = None
    together: bool = False


@dataclass(frozen=True)
class Counted:
    """The k-mer counts of reads under c, to score reads against; made anew where they are used, never stored."""

    reads: Reads
    c: Config

    def table(self) -> DataFrame:
        return count_kmers(self.reads, self.c)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts end to end, null as empty, and each text's offset."""
    column = column.fill_null("").cast(pa.large_string())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    rows = max(1, int(chunk / max(1, batch.nbytes / max(1, batch.num_rows))))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _passes(q: pa.Array, data: np.ndarray, offsets: np.ndarray, read: np.ndarray, place: np.ndarray, k: int, min_quality: int, min_prob: float) -> np.ndarray:
    """Which windows pass minq and minprob, given their reads' qualities q; a read without any has quality 50."""
    filled = pa.array([x if x is not None else "I" * n for x, n in zip(q.to_pylist(), np.diff(offsets).tolist(), strict=True)], pa.string()) if q.null_count else q
    qual, _ = flat(filled)
    has = q.is_valid().to_numpy(zero_copy_only=False)[read]
    return np.where(has, kmers.quality_filter(qual, data, offsets, read, place, k, min_quality, min_prob), min_quality <= 50)


def windows(reads: Reads, c: Config, filtered: bool, once: bool = False, buckets: bool = False) -> DataFrame:
    """A row per window: the read's key columns, unit, pos, kmer.

    Filtered: only valid windows whose qualities pass minq and minprob.  Otherwise every
    window comes, with kmer null where a base is not ACGTU.  Once: of filtered windows only
    the first of a row of reads with its k-mer.  Buckets: with that of the window's minimizer.
    """
    ship(reads.df.sparkSession)
    names = list(dict.fromkeys([*reads.unit, *reads.key]))
    quals = reads.quals if filtered else None
    source = reads.df.select(*names, F.col(reads.bases).alias("__b"), *([F.col(quals).alias("__q")] if quals else []))
    k, min_quality, min_prob = c.k, c.min_quality, c.min_prob

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, offsets = flat(batch.column("__b"))
                read, place, key = kmers.batch_keys(data, offsets, k)
                keep = np.ones(len(key), bool)
                if filtered:
                    keep = key >= 0
                    if quals:
                        keep &= _passes(batch.column("__q"), data, offsets, read, place, k, min_quality, min_prob)
                    if once:
                        keep[keep] = runs.first_in_unit(read[keep], key[keep])
                read, place, key = read[keep], place[keep], key[keep]
                who = pa.array(read)
                more = [pa.array((runs.buckets_of(data, k, runs.NONE)[offsets[:-1][read] + place] if len(read) else np.zeros(0)).astype(np.int32))] if buckets else []
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(who) for n in names), pa.array(place.astype(np.int32)), pa.array(key, mask=key < 0), *more], [x.name for x in schema.fields])

    fields = [source.schema[n] for n in names]
    schema = T.StructType([*fields, T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.LongType()), *([T.StructField("bucket", T.IntegerType())] if buckets else [])])
    return source.mapInArrow(run, schema)


def unit_counts(reads: Reads, c: Config) -> DataFrame:
    """kmer, m: per unit and k-mer how often it occurs, without naming the unit. For units that are one row of reads."""
    ship(reads.df.sparkSession)
    source = reads.df.select(F.col(reads.bases).alias("__b"))
    k = c.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data, offsets = flat(batch.column("__b"))
                read, _, key = kmers.batch_keys(data, offsets, k)
                read, key = read[key >= 0], key[key >= 0]
                order = np.lexsort((key, read))
                read, key = read[order], key[order]
                new = np.append(True, (key[1:] != key[:-1]) | (read[1:] != read[:-1])) if len(key) else np.zeros(0, bool)
                head = np.flatnonzero(new)
                m = np.diff(np.append(head, len(key)))
                # pre-aggregate the batch: one row per k-mer
                kmer, inverse = np.unique(key[head], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(np.bincount(inverse, minlength=len(kmer)).astype(np.int64)), pa.array(np.bincount(inverse, weights=m, minlength=len(kmer)).astype(np.int64))], ["kmer", "units", "raw"])

    return source.mapInArrow(run, "kmer long, units long, raw long")


def is_row_unit(reads: Reads) -> bool:
    return tuple(reads.unit) == tuple(reads.key)


def count_kmers(reads: Reads, c: Config) -> DataFrame:
    """kmer, depth: the number of units (or, without rdk, of windows) that hold the k-mer with good enough qualities."""
    if not reads.quals and set(reads.key) - set(reads.unit) == {"mate"}:
        # mates side by side, with a letter between that no k-mer holds
        both = reads.df.groupBy(*reads.unit).agg(F.concat_ws("N", F.collect_list(reads.bases)).alias("bases"))
        reads = Reads(both, reads.unit, reads.unit)
    if is_row_unit(reads) and not reads.quals:
        found = unit_counts(reads, c).groupBy("kmer").agg(F.sum("units" if c.rdk else "raw").alias("depth"))
    else:
        all_ = windows(reads, c, True).select(*reads.unit, "kmer")
        found = (all_.distinct() if c.rdk else all_).groupBy("kmer").agg(F.count("*").alias("depth"))
    return rebuild(found, reads, c) if c.build_passes > 1 else found


def rebuild(counts: DataFrame, reads: Reads, c: Config) -> DataFrame:
    """Further build passes: only k-mers already seen twice are trusted and stay in the table (our rule)."""
    return counts.where("depth >= 2")


def depth_hist(reads: Reads, c: Config) -> DataFrame:
    """depth, raw_count, unique_kmers over valid windows; no join, as depth and windows of a k-mer are summed together."""
    both = unit_counts(reads, c).groupBy("kmer").agg(F.sum("units").alias("units"), F.sum("raw").alias("raw"))
    depth = F.col("units") if c.rdk else F.col("raw")
    return hist_columns(both.groupBy(F.least(depth, F.lit(c.hist_len - 1)).alias("depth")).agg(F.sum("raw").alias("raw_count")))


def hist_columns(hist: DataFrame) -> DataFrame:
    """depth, raw_count with the rounded number of distinct k-mers."""
    return hist.select("depth", "raw_count", F.when(F.col("depth") < 1, F.col("raw_count")).otherwise(F.expr("(raw_count + depth div 2) div depth")).cast("long").alias("unique_kmers"))


def zero_rows(hist: DataFrame, length: int) -> DataFrame:
    """hist with a row for every depth below length."""
    return hist.sparkSession.range(length).select(F.col("id").alias("depth")).join(hist, "depth", "left").na.fill(0)


def window_depths(reads: Reads, counts: DataFrame, c: Config) -> DataFrame:
    """Read key, pos, depth of every window: 0 for a valid k-mer never counted, -1 for an invalid window."""
    all_ = windows(reads, c, False).select(*reads.key, "pos", "kmer")
    joined = all_.join(counts, "kmer", "left")
    return joined.select(*reads.key, "pos", F.when(F.col("kmer").isNull(), -1).otherwise(F.coalesce("depth", F.lit(0))).cast("long").alias("depth"))


def coverage(reads: Reads, counts: DataFrame | Counted, c: Config, carry: tuple[str, ...] = ()) -> DataFrame:
    """Read key (of one row each), length, cov (the depths of its windows in order; empty without windows), and the columns to carry."""
    if isinstance(counts, Counted):
        out = _answered(reads, counts, carry)
    else:
        out = _joined(reads, counts, c)
        out = out.join(reads.df.select(*reads.key, *carry), list(reads.key)) if carry else out
    return out.withColumn("cov", fix_spikes(F.col("cov"))) if c.fix_spikes else out


def _answered(reads: Reads, counts: Counted, carry: tuple[str, ...]) -> DataFrame:
    """coverage by runs: reads are cut into runs, buckets of runs are counted and answered, answers are put back by batch of reads."""
    spark, c = reads.df.sparkSession, counts.c
    names = [*reads.key, *carry]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(12 * n, runs.NONE - 1)
    k, least = c.k, 2 if c.build_passes > 1 else 0  # see rebuild
    if counts.reads.df is reads.df and counts.reads.bases == reads.bases:
        cut = _runs(counts.reads, c, buckets, names, True)
    else:
        cut = _runs(reads, c, buckets, names, False).unionByName(_runs(counts.reads, c, buckets, None, True))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "bucket"):
            if rows.column("bucket")[0].as_py() < 0:
                yield rows
                continue
            found = runs.answered(list(zip(rows.column("n").to_pylist(), rows.column("pack").to_pylist(), strict=True)), k, least)
            rows = rows.set_column(rows.schema.get_field_index("pack"), "pack", pa.array(found, pa.binary()))
            yield rows.filter(pc.greater_equal(rows.column("batch"), 0))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, "batch"):  # the head comes first, as its bucket is negative
            if rows.column("bucket")[0].as_py() >= 0 or pc.count_distinct(rows.column("check")).as_py() > 1:
                raise ValueError("packs of a batch of reads do not fit: the reads came in another order when a lost stage was run again")
            head, packs = rows.slice(0, 1), rows.column("pack").to_pylist()
            cov = runs.placed(*sizes(head), packs[1:])
            with pa.ipc.open_stream(packs[0]) as stream:
                (own,) = list(stream)
            offsets = np.concatenate([[0], np.cumsum(own.column("__w").to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(own.column(x) for x in names), own.column("__n"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cov))], [*names, "length", "cov"])

    answers = cut.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, cut.schema)
    schema = T.StructType([*(reads.df.schema[x] for x in names), T.StructField("length", T.IntegerType()), T.StructField("cov", T.ArrayType(T.LongType()))])
    return answers.repartition(n, "batch").sortWithinPartitions("batch", "bucket").mapInArrow(back, schema)


def sizes(head: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Windows and bucket of each run of a batch of reads, from its head."""
    held = zlib.decompress(head.column("more")[0].as_py())
    n = len(held) // 3
    return np.frombuffer(held, np.uint8, n), np.frombuffer(held[n:], np.uint16)


def groups(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a column, as one batch per value."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        value = batch.column(name).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(name)[0].as_py() != value[a]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def whole_units(batches: Iterator[pa.RecordBatch], unit: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole units, of rows sorted by unit, with a number per unit."""

    def numbers(rows: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        for name in unit:
            a, b = rows.column(name).slice(1), rows.column(name).slice(0, rows.num_rows - 1)
            differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            new[1:] |= differ.to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    held = None
    for whole in batches:
        for batch in slices(whole, BATCH):
            rows = batch if held is None else pa.concat_batches([held, batch])
            number = numbers(rows)
            last = int(np.searchsorted(number, number[-1]))
            if last:
                yield rows.slice(0, last), number[:last]
            held = rows.slice(last)
    if held is not None:
        yield held, numbers(held)


def _runs(reads: Reads, c: Config, buckets: int, names: list[str] | None, counts: bool, core: bool = False) -> DataFrame:
    """bucket, batch, check, n, pack, more: the packs of each batch of reads; if named columns are kept, also a head row of negative bucket.

    A head's pack holds the named columns, length and number of windows of its reads, its
    `more` the runs' sizes and buckets.  Packs without a head have batch -1.  check is the
    same in all rows of a batch.  counts: whether these reads' windows count.  core: see buckets_of.
    """
    ship(reads.df.sparkSession)
    k, rdk, min_quality, min_prob = c.k, c.rdk, c.min_quality, c.min_prob
    quals = reads.quals if counts else None
    units = list(reads.unit) if counts and rdk and not is_row_unit(reads) else []
    kept = list(dict.fromkeys([*(names or []), *units]))
    source = reads.df.select(*kept, F.col(reads.bases).alias("__b"), F.length(reads.bases).alias("__n"), *([F.col(quals).alias("__q")] if quals else []))
    if units and not reads.together:
        source = source.repartition(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), *units).sortWithinPartitions(*units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        each = whole_units(batches, units) if units else ((b, np.arange(b.num_rows)) for whole in batches for b in slices(whole, 4 * BATCH if core else BATCH))
        for number, (batch, unit) in enumerate(each):
            data, offsets = flat(batch.column("__b"))
            read, place, key = kmers.batch_keys(data, offsets, k)
            mark = key >= 0
            if not counts:
                mark = np.zeros(len(key), bool)
            elif quals and len(key):
                mark &= _passes(batch.column("__q"), data, offsets, read, place, k, min_quality, min_prob)
            if counts and rdk:
                mark[mark] = runs.first_in_unit(unit[read[mark]], key[mark])
            many, of, packs = runs.split(data, read, place, offsets, key >= 0, mark, k, buckets, core)
            rows = [(bucket, -1, 0, n, pack, None) for bucket, (n, pack) in packs.items()]
            if names is not None:
                head = pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), batch.column("__n"), pa.array(np.bincount(read, minlength=batch.num_rows).astype(np.int32))], [*names, "__n", "__w"])
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(head)
                pack, more = out.getvalue().to_pybytes(), zlib.compress(many.tobytes() + of.tobytes(), 1)
                who, check = task << 32 | number, zlib.crc32(more, zlib.crc32(pack))
                rows = [(-1 - who % buckets, who, check, 0, pack, more), *((bucket, who, check, n, p, None) for bucket, _, _, n, p, _ in rows)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "batch", "check", "n", "pack", "more"])

    return source.mapInArrow(run, "bucket int, batch long, check long, n int, pack binary, more binary")


def _joined(reads: Reads, counts: DataFrame, c: Config) -> DataFrame:
    """coverage by a table of counts.

    Each read sends a head row along with its windows, so that the rows, once they have met
    the counts, are packed in one pass over sorted partitions and not joined to the reads again.
    """
    names, low = list(reads.key), F.lit(0xFFFFFFFF)
    met = _marked_windows(reads, c).join(counts, "kmer", "left")
    above = (-F.col("kmer") - 1).bitwiseAND(low)
    length = F.when(above != low, above)
    depth = F.when(F.col("pos") < 0, length).when(F.col("kmer") < 0, -1).otherwise(F.coalesce("depth", F.lit(0))).cast("long")
    dealt = met.select(*names, "pos", depth.alias("depth")).repartition(*names).sortWithinPartitions(F.xxhash64(*names), *names, "pos")

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if rows.num_rows:
            head = rows.column("pos").to_numpy() < 0
            at = np.flatnonzero(head)
            offsets = np.append(at - np.arange(len(at)), rows.num_rows - len(at))
            cov = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows.column("depth").filter(pa.array(~head)).combine_chunks())
            heads = rows.take(pa.array(at)).combine_chunks()
            columns = [heads.column(n).combine_chunks() for n in names]
            yield pa.RecordBatch.from_arrays([*columns, heads.column("depth").combine_chunks().cast(pa.int32()), cov], [*names, "length", "cov"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            at = np.flatnonzero(batch.column("pos").to_numpy() < 0)
            if not len(at):
                held.append(batch)
                continue
            yield from packed([*held, batch.slice(0, at[-1])])
            held = [batch.slice(at[-1])]
        if held:
            yield from packed(held)

    return dealt.mapInArrow(run, T.StructType([*(dealt.schema[n] for n in names), T.StructField("length", T.IntegerType()), T.StructField("cov", T.ArrayType(T.LongType()))]))


def _marked_windows(reads: Reads, c: Config) -> DataFrame:
    """Read key, pos, kmer of every window, and a row of pos -1 per read; where there is no k-mer, kmer is negative.

    It is -1 - x: the low 32 bits of x are a head row's length (all set: null), the others
    come from the read's key and the place, so that these rows are dealt evenly.
    """
    ship(reads.df.sparkSession)
    names, k = list(reads.key), c.k
    source = reads.df.select(*names, F.col(reads.bases).alias("__b"), F.coalesce(F.length(reads.bases).cast("long"), F.lit(0xFFFFFFFF)).alias("__n"), F.xxhash64(*names).alias("__h"))

    def spread(h: np.ndarray, place: np.ndarray) -> np.ndarray:
        x = h.view(np.uint64) ^ (place.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return ((x >> np.uint64(33)) << np.uint64(32)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                read, place, key = kmers.batch_keys(*flat(batch.column("__b")), k)
                n, h = batch.column("__n").to_numpy(), batch.column("__h").to_numpy()
                key = np.where(key < 0, -1 - spread(h[read], place), key)
                heads = -1 - (spread(h, np.full(len(h), -1)) | n)
                who = pa.array(np.append(np.arange(batch.num_rows), read))
                pos = np.append(np.full(batch.num_rows, -1, np.int32), place.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).take(who) for x in names), pa.array(pos), pa.array(np.append(heads, key))], [*names, "pos", "kmer"])

    return source.mapInArrow(run, T.StructType([*(source.schema[x] for x in names), T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.LongType())]))


def fix_spikes(cov):
    """A window deeper than both neighbours is lowered to the deeper of them (our rule); ends and invalid windows stay."""
    fixed = lambda x, i: F.when((i > 0) & (i < F.size(cov) - 1) & (x > 0), F.least(x, F.greatest(F.get(cov, i - 1), F.get(cov, i + 1), F.lit(0)))).otherwise(x)
    return F.transform(cov, fixed)


def hist_from_depths(depths: DataFrame, c: Config) -> DataFrame:
    """The histogram of window depths, depth 0 included (zero_bin) or not; invalid windows never count."""
    return hist_columns(depths.where(F.col("depth") >= (0 if c.zero_bin else 1)).groupBy(F.least("depth", F.lit(c.hist_len - 1)).alias("depth")).agg(F.count("*").alias("raw_count")))


def read_depth_hist(scored: DataFrame) -> DataFrame:
    """depth, reads, bases of scored reads (depth, length)."""
    return scored.groupBy("depth").agg(F.count("*").alias("reads"), F.sum("length").cast("long").alias("bases"))


def unique_summary(counts: DataFrame, split: int) -> DataFrame:
    """unique_kmers, and how many have depths 1..split-1 and split or more."""
    return counts.agg(F.count("*").alias("unique_kmers"), F.count(F.when(F.col("depth") < split, 1)).alias("low_depth"), F.count(F.when(F.col("depth") >= split, 1)).alias("high_depth"))


def cardinality(reads: Reads, c: Config) -> DataFrame:
    """An estimate of the number of distinct k-mers by a HyperLogLog sketch."""
    k = c.cardinality_k or c.k
    return windows(reads, c.replace(k=k), True).agg(F.hll_sketch_estimate(F.hll_sketch_agg("kmer", F.lit(max(4, min(21, (c.cardinality_buckets - 1).bit_length()))))).alias("estimate"))
