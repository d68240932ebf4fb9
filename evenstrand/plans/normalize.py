"""Depth normalisation of reads from a Config: counting, scoring, decisions, passes, outputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenstrand.config import Config
from evenstrand.operators import batches, counting, countup, decide, ecc, hists, sketch, trim
from evenstrand.plans import peaks
from evenstrand.sources import reads as source
from evenstrand.sources import sinks

#: Spark then removes a query's shuffle files when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
KEY = ["file_idx", "pair_id", "mate"]
PAIR = ["file_idx", "pair_id"]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder of spark.checkpoint.dir and read it back, to cut lineage between passes; its shuffle files go."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evenstrand-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/evenstrand/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete what save wrote, once nothing reads it any more."""
    spark = table.sparkSession
    jvm, files = spark.sparkContext._jvm, table.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@dataclass
class Result:
    """decided: every read with keep, bin, uncorrected, depth; counts: the input's k-mers, made when first asked for; tables by name; summary numbers."""

    decided: DataFrame
    count: Callable[[], DataFrame]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    summary: dict[str, int] = field(default_factory=dict)

    @cached_property
    def counts(self) -> DataFrame:
        return self.count()

    @property
    def kept(self) -> DataFrame:
        return self.decided.where("keep")

    @property
    def tossed(self) -> DataFrame:
        return self.decided.where("NOT keep")


def as_reads(df: DataFrame) -> counting.Reads:
    """K-mers count once per pair."""
    return counting.Reads(df, tuple(PAIR), tuple(KEY), quals="quals")


def count_table(reads: counting.Reads, c: Config, name: str = "counts") -> DataFrame:
    """The k-mer counts of reads, written; with a prefilter, of those that its sketch estimates at two or more."""
    counts = save(counting.count_kmers(reads, c), name)
    return save(sketch.prefiltered(counts.withColumnRenamed("depth", "m"), c), name) if c.prefilter else counts


def one_pass(reads: DataFrame, counts: DataFrame, c: Config, first: bool) -> DataFrame:
    """reads after correction and trimming, with depth, bad, keep, bin, uncorrected, n_errors."""
    work = reads
    if c.ecc_first if first else c.ecc_final:
        if c.overlap:
            work = _repair(work)
        if c.mark_only:
            work = ecc.mark(work, KEY, counts, c).withColumn("uncorrected", F.lit(False))
        else:
            work = ecc.correct(work, KEY, counts, c, save)
            if c.mark_uncorrectable:
                bad = ecc.mark(work.where("uncorrected").drop("n_errors"), KEY, counts, c.replace(trim_after_marking=False))
                work = work.where("NOT uncorrected").unionByName(bad)
    else:
        work = work.withColumns({"n_errors": F.lit(0), "uncorrected": F.lit(False)})
    work = trim.trim(work, c)
    scored = decide.score(counting.coverage(as_reads(work), counts, c), c)
    pairs = decide.decide_pairs(scored, c.replace(target=c.target_first) if first and c.target_first else c, *PAIR, first=first)
    uncorrected = work.groupBy(*PAIR).agg(F.max("uncorrected").alias("uncorrected"))
    own = scored.select(*KEY, F.col("depth").alias("read_depth"))
    return work.drop("uncorrected").join(own, KEY, "left").join(pairs.select(*PAIR, "depth", "bad", "keep", "bin"), PAIR).join(uncorrected, PAIR)


def _repair(reads: DataFrame) -> DataFrame:
    keep = [x for x in reads.columns if x not in (*KEY, "bases", "quals")]
    rest = F.struct(*keep) if keep else F.lit(None)
    side = lambda i: F.max(F.when(F.col("mate") == i, F.struct("bases", "quals", rest.alias("rest"))))
    wide = reads.groupBy(*PAIR).agg(side(1).alias("a"), side(2).alias("b")).select(*PAIR, F.col("a.bases").alias("bases1"), F.col("a.quals").alias("quals1"), F.col("b.bases").alias("bases2"), F.col("b.quals").alias("quals2"), F.col("a.rest").alias("rest1"), F.col("b.rest").alias("rest2"))
    fixed = ecc.repair_pairs(wide)
    long = None
    for i in (1, 2):
        one = fixed.where(F.col(f"bases{i}").isNotNull()).select(*PAIR, F.lit(i).alias("mate"), F.col(f"bases{i}").alias("bases"), F.col(f"quals{i}").alias("quals"), *(F.col(f"rest{i}.{x}").alias(x) for x in keep))
        long = one if long is None else long.unionByName(one)
    return long


def counted_reads(current: DataFrame, c: Config, extra: DataFrame | None, number: int, *more: str) -> DataFrame:
    """The reads whose k-mers pass `number` counts; more: columns that, with an extra's, are -1 there."""
    table = current.where(F.col("pair_id") < c.table_reads) if c.table_reads is not None and number == 1 else current
    if extra is not None and number == 1:
        others = extra.select((-1 - F.col("file_idx")).alias("file_idx"), "pair_id", "mate", "bases", "quals", *(F.lit(-1).cast("long").alias(x) for x in more))
        table = table.select(*KEY, "bases", "quals", *more).unionByName(others)
    return table


def passes_by_batches(reads: DataFrame, c: Config, extra: DataFrame | None, together: bool) -> DataFrame:
    """decided, without a table of counts and without joins of reads: pairs lie as batches, their windows travel as runs, decisions go back to the batches."""
    held = save(batches.pack(reads, PAIR, ["mate"], together), "batches")
    for number in range(1, c.passes + 1):
        last = number == c.passes
        current = batches.opened(held, reads.schema)
        for _ in range(number - 1):
            current = trim.trim(current, c)
        table, work = counted_reads(current, c, extra, number, batches.UNIT), trim.trim(current, c)
        own = extra is None or number > 1
        counted = counting.Counted(counting.Reads(table, (batches.UNIT,) if own else (batches.UNIT, *PAIR), (batches.UNIT, "mate"), quals="quals", together=own), c)
        scored = decide.score(counting.coverage(counting.Reads(work, (batches.UNIT,), (batches.UNIT, "mate")), counted, c, tuple(PAIR)), c)
        judge = c.replace(target=c.target_first) if c.target_first and not last else c
        own_depths = tuple(F.max(F.when(which, F.col("depth"))).alias(name) for name, which in (("__1", F.col("mate") == 1), ("__2", F.col("mate") != 1)))
        pairs = decide.decide_pairs(scored, judge, *PAIR, first=not last, by=(batches.UNIT,), more=own_depths)
        pairs = save(pairs.select(batches.UNIT, "depth", "bad", "keep", "bin", "__1", "__2"), "pairs")
        if not last:
            whole, held = held, save(batches.where(held, pairs, "keep"), "batches")
            forget(whole)
            continue
        decided = batches.with_decisions(held, reads.schema, pairs)
        for _ in range(number):
            decided = trim.trim(decided, c)
        others = [x for x in reads.columns if x not in KEY]
        read_depth = F.when(F.col("mate") == 1, F.col("__1")).otherwise(F.col("__2")).alias("read_depth")
        decided = save(decided.select(*KEY, *others, F.lit(0).alias("n_errors"), read_depth, "depth", "bad", "keep", "bin", F.lit(False).alias("uncorrected")), "decided")
        forget(held)
    return decided


def normalize(reads: DataFrame, c: Config, extra: DataFrame | None = None, together: bool = False) -> Result:
    """Normalise reads (file_idx, pair_id, mate, id, bases, quals, ...). extra: reads that only add k-mers. together: the mates of a pair come one after another, in one partition."""
    if c.overlap_auto:
        c = c.replace(overlap=_overlaps_often(reads), overlap_auto=False)
    current, first_counts, decided = reads, None, None
    if c.count_up:
        counts = count_table(as_reads(reads), c)
        judged = countup.count_up(counting.Reads(reads, tuple(KEY), tuple(KEY), quals="quals"), counts, c, save)
        by_pair = judged.groupBy(*PAIR).agg(F.min("hopeless").alias("hopeless"), F.max("keep").alias("keep"))
        if not c.add_bad_countup:
            by_pair = by_pair.where("NOT hopeless")
        decided = reads.join(by_pair.select(*PAIR, "keep"), PAIR).withColumns({"bin": F.lit("mid"), "uncorrected": F.lit(False), "depth": F.lit(0), "read_depth": F.lit(0), "bad": F.lit(False), "n_errors": F.lit(0)})
        return Result(save(decided, "decided"), lambda: counts)
    by_batches = not (c.prefilter or c.ecc_first or c.ecc_final)  # a prefiltered table, or one asked in many rounds, is made once
    if by_batches:
        decided = passes_by_batches(reads, c, extra, together)
    for number in range(1, 1 if by_batches else c.passes + 1):
        counts = count_table(as_reads(counted_reads(current, c, extra, number)), c)
        first_counts = first_counts if first_counts is not None else counts
        last = number == c.passes
        decided = save(one_pass(current, counts, c, first=not last), "decided")
        if not last:
            current = decided.where("keep").select(*reads.columns)
    if c.rename:
        wide = decided.groupBy(*PAIR).agg(F.max(F.when(F.col("mate") == 1, F.col("read_depth"))).alias("d1"), F.max(F.when(F.col("mate") == 2, F.col("read_depth"))).alias("d2"), F.max(F.when(F.col("mate") == 1, F.col("n_errors"))).alias("e1"), F.max(F.when(F.col("mate") == 2, F.col("n_errors"))).alias("e2"))
        from evenstrand.functions.bases import renamed

        errors = ("e1", "e2") if c.ecc else (None, None)
        decided = decided.join(wide, PAIR).withColumn("id", renamed("pair_id", "d1", "d2", *errors)).drop("d1", "d2", "e1", "e2")
    return Result(decided, lambda: first_counts if first_counts is not None else count_table(as_reads(counted_reads(reads, c, extra, 1)), c))


def _overlaps_often(reads: DataFrame) -> bool:
    """Whether repair changes any of a hundredth of the pairs, chosen by hash: a probe that only switches repair on."""
    some = reads.where(F.pmod(F.xxhash64(*PAIR), F.lit(100)) == 0)
    fixed = _repair(some.select(*KEY, "bases", "quals"))
    return fixed.join(some.select(*KEY, F.col("bases").alias("old")), KEY).where("bases <> old").count() > 0


def side_tables(reads: DataFrame, c: Config) -> dict[str, tuple[DataFrame, str]]:
    """The statistics that c asks for: name -> (table, header)."""
    made = {
        "qhist": lambda: (hists.quality(reads).orderBy("quality"), "#Quality\tBases"),
        "qchist": lambda: (hists.quality_counts(reads).orderBy("quality"), "#Quality\tcount1\tfraction1\tcount2\tfraction2"),
        "aqhist": lambda: (hists.average_quality(reads).orderBy("quality"), "#Quality\tcount1\tfraction1\tcount2\tfraction2"),
        "obqhist": lambda: (hists.overall_quality(reads).orderBy("quality"), "#Quality\tbases\tfraction"),
        "bqhist": lambda: (hists.base_quality(reads).orderBy("mate", "pos"), "#Mate\tBaseNum\tcount\tmin\tmax\tmean\tQ1\tmed\tQ3\tLW\tRW"),
        "lhist": lambda: (hists.lengths(reads, c.side_hist_len).orderBy("length"), "#Length\tReads\tBases"),
        "gchist": lambda: (hists.gc(reads, c.gc_bins or 100).orderBy("gc_bin"), "#GC_Bin\tReads\tBases"),
        "bhist": lambda: (hists.base_fractions(reads).orderBy("pos"), "#Pos\tA\tC\tG\tT\tN"),
        "enthist": lambda: (hists.entropy(reads, c).orderBy("value"), "#Value\tCount"),
        "idhist": lambda: (hists.identity(reads), "#Identity\tReads\tBases"),
        "mhist": lambda: (hists.matches(reads).orderBy("mate", "pos"), "#Mate\tBaseNum\tMatch\tN"),
        "ehist": lambda: (hists.errors(reads), "#Errors\tCount"),
        "qahist": lambda: (hists.quality_accuracy(reads).orderBy("quality"), "#Quality\tMatch\tSub\tIns\tDel"),
        "ihist": lambda: (hists.empty_lengths(reads, "insert_size", "count"), "#InsertSize\tCount"),
        "indelhist": lambda: (hists.empty_lengths(reads, "length", "deletions", "insertions"), "#Length\tDeletions\tInsertions"),
    }
    return {name: make() for name, make in made.items() if name in c.tables}


def hist_table(decided: DataFrame, counts: DataFrame, c: Config) -> DataFrame:
    h = counting.hist_from_depths(counting.window_depths(as_reads(decided), counts, c), c)
    if c.print_zero:
        longest = min(c.hist_len, (h.agg(F.max("depth")).first()[0] or 0) + 1)
        h = counting.zero_rows(h, longest)
    return h.orderBy("depth").select(*["depth", "raw_count", "unique_kmers"][: c.hist_columns])


HIST_HEADER = ["#Depth", "Raw_Count", "Unique_Kmers"]


def run(spark: SparkSession, c: Config) -> Result:
    """Read the inputs of c, normalise, and write everything that c names."""
    sinks.check_lists(c)
    reads = save(source.load(spark, c), "reads")
    extra = None
    for number, path in enumerate(c.extra):
        one = source.single(source.read(spark, path, c)).select(F.lit(number).alias("file_idx"), "*")
        extra = one if extra is None else extra.unionByName(one)
    result = normalize(reads, c, extra)
    header = "\t".join(HIST_HEADER[: c.hist_columns])
    for side, rows, in_counts in (("", reads, result.counts), ("out", None, None)):
        wanted = [n + side for n in ("hist", "rhist", "peaks") if n + side in c.tables]
        if side and wanted:
            rows = result.kept
            in_counts = count_table(as_reads(rows), c, "counts_out")
        if "hist" + side in wanted:
            sinks.write_text(sinks.table_text(hist_table(rows, in_counts, c), header), c.tables["hist" + side], c)
        if "rhist" + side in wanted:
            scored = decide.score(counting.coverage(as_reads(rows), in_counts, c), c)
            sinks.write_text(sinks.table_text(counting.read_depth_hist(scored).orderBy("depth"), "#Depth\tReads\tBases"), c.tables["rhist" + side], c)
        if "peaks" + side in wanted:
            h = hist_table(rows, in_counts, c.replace(hist_columns=2, print_zero=False))
            sinks.write_text(peaks.peaks_text(peaks.dense([tuple(r) for r in h.collect()]), c), c.tables["peaks" + side], c)
    for name, (table, head) in side_tables(reads, c).items():
        sinks.write_text(sinks.table_text(table, head), c.tables[name], c)
    if "barcodestats" in c.tables:
        sinks.write_text(hists.barcode_text(reads), c.tables["barcodestats"], c)
    sinks.write_streams(result.decided, c)
    totals = reads.agg(F.count("*"), F.coalesce(F.sum(F.length("bases")), F.lit(0))).first()
    kept = result.kept.count()
    result.summary = {"reads_in": totals[0], "bases_in": totals[1], "reads_kept": kept, "reads_tossed": result.decided.count() - kept, "unique_kmers_in": result.counts.count()}
    if c.cardinality_in:
        result.summary["cardinality_in"] = counting.cardinality(as_reads(reads), c).first()[0]
    if c.cardinality_out:
        result.summary["cardinality_out"] = counting.cardinality(as_reads(result.kept), c).first()[0]
    return result
