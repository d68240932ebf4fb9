"""Queries over the operators, on reads cut from the documents, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenstrand.config import Config
from evenstrand.functions import bases, kmers
from evenstrand.operators import compare, countup, counting, decide, ecc, hists, sketch, trim
from evenstrand.plans import normalize as plan
from evenstrand.plans import peaks
from evenstrand.sources import reads as source
from evenstrand.sources import sinks

ONE = Config(passes=1, min_quality=0, min_prob=0.0)
KEY = ("doc_id", "frag")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    if len(docs.inputFiles()) >= 2 * spark.sparkContext.defaultParallelism:
        return docs
    return docs.repartition(plan_partitions(spark), "doc_id")  # a file may be one row group, which one task reads


def plan_partitions(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def reads(spark: SparkSession, sf: str) -> DataFrame:
    return source.reads_of_documents(documents(spark, sf))


def one_unit(df: DataFrame) -> counting.Reads:
    return counting.Reads(df)


def mates(spark: SparkSession, sf: str, cut: Callable[[DataFrame], DataFrame] = source.reads_of_documents) -> DataFrame:
    """The reads as pairs of neighbours, one after another as they are cut from a text: file_idx, pair_id, mate, id, bases, quals, and doc_id, frag."""
    r = cut(documents(spark, sf))
    pair = (F.col("doc_id") * 100_000 + F.expr("frag div 2")).alias("pair_id")
    name = F.concat_ws(":", F.concat(F.lit("doc"), "doc_id"), F.substring("bases", 1, 3)).alias("id")
    return r.select(F.lit(0).alias("file_idx"), pair, (F.col("frag") % 2 + 1).cast("int").alias("mate"), name, "bases", "quals", "doc_id", "frag")


def scored(spark: SparkSession, sf: str, c: Config) -> DataFrame:
    r = one_unit(reads(spark, sf))
    return decide.score(counting.coverage(r, counting.Counted(r, c), c), c)


# k-mers and histograms


def kmer_depth_hist(spark, sf):
    return counting.depth_hist(one_unit(reads(spark, sf)), ONE)


def kmer_depth_hist_raw(spark, sf):
    return counting.depth_hist(one_unit(reads(spark, sf)), ONE.replace(rdk=False)).select("depth", "raw_count")


def kmer_hist_zero_cov(spark, sf):
    h = plan.save(kmer_depth_hist(spark, sf), "hist")
    return counting.zero_rows(h, (h.agg(F.max("depth")).first()[0] or 0) + 1)


def kmer_hist_limited(spark, sf):
    return counting.depth_hist(one_unit(reads(spark, sf)), ONE.replace(hist_len=5))


def kmer_hist_table_limit(spark, sf):
    """Only the first 3 reads of each document build the table; all are looked up."""
    r = reads(spark, sf)
    counts = counting.count_kmers(one_unit(r.where("frag < 3")), ONE)
    return counting.hist_from_depths(counting.window_depths(one_unit(r), counts, ONE), ONE.replace(zero_bin=True))


def canonical_kmers(spark, sf):
    r = reads(spark, sf).select("doc_id", "frag", "bases", F.explode(F.sequence(F.lit(1), F.length("bases") - 8)).alias("i"))
    each = r.select("doc_id", "frag", kmers.canonical("bases", F.col("i"), 9).alias("kmer")).distinct()
    return each.groupBy("kmer").agg(F.count("*").alias("depth"))


def kmer_codes(spark, sf):
    found = counting.count_kmers(one_unit(reads(spark, sf)), ONE.replace(k=9))
    return found.select("kmer", "depth")


def invalid_windows(spark, sf):
    """Valid and invalid windows of reads whose Gs of lowest quality are N."""
    r = reads(spark, sf).withColumn("bases", F.translate("bases", "G", "N"))
    w = counting.windows(one_unit(r), ONE.replace(k=5), False)
    return w.groupBy("pos").agg(F.count("kmer").alias("valid"), F.count(F.when(F.col("kmer").isNull(), 1)).alias("invalid"))


def long_kmer_hash(spark, sf):
    w = counting.windows(one_unit(reads(spark, sf)), ONE.replace(k=40), True)
    return w.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("kmer").alias("least"), F.max("kmer").alias("most"))


def long_kmer_hash_expression(spark, sf):
    w = reads(spark, sf).select(*KEY, kmers.windows("bases", 40).alias("w")).where(F.size("w") > 0)
    own = w.select(*KEY, F.size(F.array_compact("w")).alias("n"), F.array_min("w").alias("least"), F.array_max("w").alias("most"))
    return own.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def qual_prob_filter(spark, sf):
    c = Config(passes=1, k=9, min_quality=21, min_prob=0.98)
    r = counting.Reads(reads(spark, sf), quals="quals")
    return counting.windows(r, c, True).groupBy(*KEY).agg(F.count("*").alias("n_kmers"))


def pair_depth_hist(spark, sf):
    r = plan.as_reads(mates(spark, sf))
    counts = plan.save(counting.count_kmers(counting.Reads(r.df, r.unit, r.key), ONE), "counts")
    return counting.hist_from_depths(counting.window_depths(counting.Reads(r.df, r.unit, r.key), counts, ONE), ONE)


def trusted_rebuild(spark, sf):
    return counting.count_kmers(one_unit(reads(spark, sf)), ONE.replace(k=9, build_passes=2)).groupBy("depth").agg(F.count("*").alias("unique_kmers"))


def unique_summary(spark, sf):
    return counting.unique_summary(counting.count_kmers(one_unit(reads(spark, sf)), ONE), 3)


def cardinality_estimate(spark, sf):
    return counting.cardinality(one_unit(reads(spark, sf)), ONE)


# scores and decisions

LOOSE = ONE.replace(target=2, max_depth=2, min_depth=1, min_kmers=10, error_detect_ratio=2, high_thresh=2, low_thresh=1, low_bin=1, high_bin=3)


def read_depth_hist(spark, sf):
    return counting.read_depth_hist(scored(spark, sf, ONE))


def read_depth_percentiles(spark, sf):
    return scored(spark, sf, LOOSE).select(*KEY, "depth", "high", "low", "good", "n_kmers")


def bad_reads(spark, sf):
    return scored(spark, sf, LOOSE).where("bad").select(*KEY, "high", "low")


def keep_toss(spark, sf):
    return decide.decide_single(scored(spark, sf, LOOSE), LOOSE, *KEY).select(*KEY, "depth", "keep")


def keep_all(spark, sf):
    c = LOOSE.replace(keep_all=True)
    return decide.decide_single(scored(spark, sf, c), c, *KEY).groupBy("keep", "bin").agg(F.count("*").alias("reads"))


def toss_bad(spark, sf):
    c = LOOSE.replace(toss_bad=True)
    return decide.decide_single(scored(spark, sf, c), c, *KEY).select(*KEY, "bad", "keep")


def save_rare(spark, sf):
    c = LOOSE.replace(toss_bad=True, save_rare=True)
    return decide.decide_single(scored(spark, sf, c), c, *KEY).select(*KEY, "bad", "keep")


def discard_bad_only(spark, sf):
    c = LOOSE.replace(discard_bad_only=True)
    return decide.decide_single(scored(spark, sf, c), c, *KEY).select(*KEY, "keep")


def depth_bins(spark, sf):
    return decide.decide_single(scored(spark, sf, LOOSE), LOOSE, *KEY).groupBy("bin").agg(F.count("*").alias("reads"), F.sum("length").alias("bases"))


def _pairs(spark, sf, c):
    r = plan.as_reads(mates(spark, sf))
    plain = counting.Reads(r.df, r.unit, r.key)
    return decide.decide_pairs(decide.score(counting.coverage(plain, counting.Counted(plain, c), c), c), c, "pair_id")


def keep_pairs(spark, sf):
    return _pairs(spark, sf, LOOSE).select("pair_id", "depth", "keep")


def keep_pairs_higher_depth(spark, sf):
    return _pairs(spark, sf, LOOSE.replace(use_lower_depth=False)).select("pair_id", "depth", "keep")


def require_both(spark, sf):
    return _pairs(spark, sf, LOOSE.replace(require_both_bad=True, toss_bad=True)).select("pair_id", "bad", "keep")


def require_either(spark, sf):
    return _pairs(spark, sf, LOOSE.replace(toss_bad=True)).select("pair_id", "bad", "keep")


def fix_spikes(spark, sf):
    c = LOOSE.replace(fix_spikes=True)
    r = one_unit(reads(spark, sf))
    cov = counting.coverage(r, counting.Counted(r, c), c)
    return cov.select(*KEY, F.aggregate("cov", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("cov").alias("top"))


def multipass_2(spark, sf):
    """Reads kept by a first pass are counted again and judged by a second."""
    c = LOOSE
    r = reads(spark, sf)
    for last in (False, True):
        unit = one_unit(r)
        cov = counting.coverage(unit, counting.Counted(unit, c), c, () if last else ("bases",))
        kept = decide.decide_single(decide.score(cov, c), c, *KEY).where("keep")
        r = kept.select(*KEY) if last else plan.save(kept.select(*KEY, "bases"), "kept")
    return r


def normalized_pairs(spark, sf):
    """The whole plan: two passes over pairs, quality filter, both decisions."""
    c = Config(target=2, max_depth=3, min_depth=1, min_kmers=10)
    return plan.normalize(mates(spark, sf, source.reads_by_kernel), c, together=True).decided.groupBy("keep", "bin").agg(F.count("*").alias("reads"), F.sum(F.length("bases")).alias("bases"))


def count_up(spark, sf):
    c = LOOSE
    r = one_unit(reads(spark, sf))
    return countup.count_up(r, counting.Counted(r, c), c, plan.save).select(*KEY, "hopeless", "keep")


def peak_table(spark, sf):
    c = ONE.replace(k=9, peak_height=1, peak_volume=1, peak_width=1)
    h = counting.depth_hist(one_unit(reads(spark, sf)), c)
    raw = peaks.dense([(r.depth, r.raw_count) for r in h.collect()])
    found = peaks.call_peaks(peaks.unique_counts(raw), c)
    return spark.createDataFrame([(p.start, p.center, p.stop, p.height, p.volume) for p in found], "start long, center long, stop long, max long, volume long")


# bases, qualities, text


def revcomp(spark, sf):
    return reads(spark, sf).select(*KEY, bases.reverse_complement("bases").alias("rc"))


def base_cleanup(spark, sf):
    docs = documents(spark, sf)
    fix = bases.clean_bases("text", Config(junk="fix", u_to_t=True, to_upper=True, iupac_to_n=True))
    strict = bases.clean_bases("text", Config(junk="ignore", lower_to_n=True, dot_dash_x_to_n=True, iupac_to_n=True))
    return docs.select("doc_id", F.md5(fix.cast("binary")).alias("fixed"), F.md5(strict.cast("binary")).alias("strict"), bases.has_junk("text").alias("junk"))


def quality_cap(spark, sf):
    return reads(spark, sf).select(*KEY, bases.cap_quality("bases", "quals", 25, 40).alias("quals"))


def quality_offset_64(spark, sf):
    r = reads(spark, sf).withColumn("bases", F.translate("bases", "C", "N"))
    return r.select(*KEY, bases.normalize_quality("bases", bases.requality("quals", 64), 64).alias("quals"))


def fake_quality(spark, sf):
    return reads(spark, sf).select(*KEY, bases.fake_quality(F.translate("bases", "T", "N"), F.lit(None).cast("string"), 30).alias("quals"))


def fastq_text(spark, sf):
    return mates(spark, sf).select("pair_id", "mate", sinks.record("x.fq", Config(qout=64)).alias("record"))


def fasta_text(spark, sf):
    return mates(spark, sf).select("pair_id", "mate", sinks.record("x.fa.gz", Config(fasta_wrap=30)).alias("record"))


def qtrim_window(spark, sf):
    return trim.trim(reads(spark, sf), Config(trim_right=True, trim_window=True, trim_window_length=4, trim_quality=24.0)).select(*KEY, F.length("bases").alias("n"))


def qtrim_simple(spark, sf):
    return trim.trim(reads(spark, sf), Config(trim_left=True, trim_right=True, trim_optimal=False, trim_quality=30.0)).select(*KEY, "bases")


def qtrim_optimal(spark, sf):
    return trim.trim(reads(spark, sf), Config(trim_left=True, trim_right=True, trim_quality=24.0)).select(*KEY, "bases", "quals")


def rename_reads(spark, sf):
    s = scored(spark, sf, ONE)
    return s.select(*KEY, bases.renamed(F.col("doc_id") * 100_000 + F.col("frag"), "depth").alias("name"))


# histograms of reads


def len_hist(spark, sf):
    return hists.lengths(reads(spark, sf))


def gc_hist(spark, sf):
    return hists.gc(reads(spark, sf), 50)


def base_hist(spark, sf):
    return hists.base_composition(mates(spark, sf))


def base_fraction_hist(spark, sf):
    return hists.base_fractions(mates(spark, sf)).select("pos", *(F.floor(F.col(x) * 10**6 + 0.5).cast("long").alias(x) for x in "acgtn"))


def qual_hist(spark, sf):
    return hists.quality(reads(spark, sf))


def _ppm(df: DataFrame) -> DataFrame:
    return df.select("quality", "count1", F.floor(F.col("fraction1") * 10**6 + 0.5).cast("long").alias("ppm1"), "count2", F.floor(F.col("fraction2") * 10**6 + 0.5).cast("long").alias("ppm2"))


def qual_count_hist(spark, sf):
    return _ppm(hists.quality_counts(mates(spark, sf)))


def avg_qual_hist(spark, sf):
    return _ppm(hists.average_quality(mates(spark, sf)))


def overall_qual_hist(spark, sf):
    return hists.overall_quality(reads(spark, sf)).select("quality", "bases", F.floor(F.col("fraction") * 10**6 + 0.5).cast("long").alias("ppm"))


def base_quality_hist(spark, sf):
    return hists.base_quality(mates(spark, sf)).select("mate", "pos", "count", "min", "max", F.floor(F.col("mean") * 1000 + 0.5).cast("long").alias("mean_1000"), "q1", "med", "q3", "lw", "rw")


def match_hist(spark, sf):
    return hists.matches(mates(spark, sf))


def identity_hist(spark, sf):
    return hists.identity(reads(spark, sf))


def error_hist(spark, sf):
    return hists.errors(reads(spark, sf))


def quality_accuracy_hist(spark, sf):
    return hists.quality_accuracy(reads(spark, sf))


def insert_hist(spark, sf):
    return hists.empty_lengths(reads(spark, sf), "insert_size", "count")


def indel_hist(spark, sf):
    return hists.empty_lengths(reads(spark, sf), "length", "deletions", "insertions")


def entropy_hist(spark, sf):
    return hists.entropy(reads(spark, sf), Config(entropy_bins=20)).select(F.floor(F.col("value") * 20 + 0.5).cast("long").alias("bin"), "count")


def barcode_stats(spark, sf):
    return hists.barcodes(mates(spark, sf))


# sources


def paired_reads(spark, sf):
    m = mates(spark, sf)
    return m.groupBy("pair_id").agg(F.count("*").alias("mates"), F.sum(F.length("bases")).alias("bases"))


def _numbered(spark, sf):
    return reads(spark, sf).withColumn("numeric_id", F.col("doc_id") * 100_000 + F.col("frag"))


def interleave_split(spark, sf):
    return source.pair_interleaved(_numbered(spark, sf)).select("pair_id", "mate", F.md5(F.col("bases").cast("binary")).alias("bases"))


def two_file_pairs(spark, sf):
    r = _numbered(spark, sf)
    return source.pair_files(r.where("frag % 2 = 0").withColumn("numeric_id", F.expr("numeric_id div 2")), r.where("frag % 2 = 1").withColumn("numeric_id", F.expr("numeric_id div 2"))).groupBy("pair_id").agg(F.count("*").alias("mates"))


def input_union(spark, sf):
    """Documents and conversations as two inputs, counted together."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn"), "text")
    second = source.reads_of_documents(turns.select((-1 - F.col("doc_id") * 1000 - F.col("turn")).alias("doc_id"), "text"))
    return counting.depth_hist(one_unit(reads(spark, sf).unionByName(second)), ONE)


def read_limit(spark, sf):
    r = source.pair_interleaved(_numbered(spark, sf)).where(F.col("pair_id") < 10_000_000)
    return r.groupBy("mate").agg(F.count("*").alias("reads"), F.sum(F.length("bases")).alias("bases"))


# sketches


def _per_kmer(spark, sf, k):
    return counting.unit_counts(one_unit(reads(spark, sf)), ONE.replace(k=k)).select("kmer", F.col("units").alias("m"))


def cms_depth(spark, sf):
    k = plan.save(_per_kmer(spark, sf, 7), "kmers")
    return sketch.estimate(k, sketch.sketch(k, 3, 4096), 3, 4096)


def cms_saturated(spark, sf):
    return sketch.sketch(_per_kmer(spark, sf, 7), 2, 1024, 8)


def prefilter_counts(spark, sf):
    k = plan.save(_per_kmer(spark, sf, 9), "kmers")
    return sketch.prefiltered(k, ONE.replace(k=9, prefilter_cells=1 << 16, prefilter_hashes=2))


def cms_unique_estimate(spark, sf):
    return sketch.unique_estimate(sketch.sketch(_per_kmer(spark, sf, 9), 3, 1 << 20), 1 << 20)


def hist_compare(spark, sf):
    """The histogram of all reads against that of the first 3 of each document."""
    r = reads(spark, sf)
    return compare.compare(counting.depth_hist(one_unit(r), ONE), counting.depth_hist(one_unit(r.where("frag < 3")), ONE))


# correction

ECC = Config(passes=1, k=21, min_quality=0, min_prob=0.0, ecc=True, ecc_first=True, ecc_final=True, ecc_high=3, ecc_low=1, ecc_ratio=3, ecc_limit=2)


def _ecc(spark, sf, *columns, cut=source.reads_of_documents):
    m = mates(spark, sf, cut).select(*plan.KEY, *columns)
    return m, counting.Counted(counting.Reads(m, tuple(plan.KEY), tuple(plan.KEY)), ECC)


def ecc_correct(spark, sf):
    quals = ["quals"] if ECC.ecc_max_quality < 93 else []  # qualities end at 93
    m, counts = _ecc(spark, sf, "bases", *quals, cut=source.reads_by_kernel)
    return ecc.correct(m, plan.KEY, counts, ECC, plan.save, plan.forget).select("pair_id", "mate", "n_errors", "uncorrected", F.md5(F.col("bases").cast("binary")).alias("bases"))


def mark_errors(spark, sf):
    m, counts = _ecc(spark, sf, "bases", "quals")
    return ecc.mark(m, plan.KEY, counts, ECC, ("quals",)).select("pair_id", "mate", "n_errors", F.md5(F.col("quals").cast("binary")).alias("quals"))


def overlap_repair(spark, sf):
    return plan._repair(mates(spark, sf).drop("doc_id", "frag")).select("pair_id", "mate", F.md5(F.col("bases").cast("binary")).alias("bases"))


QUERIES = {
    f.__name__: f
    for f in (
        kmer_depth_hist, kmer_depth_hist_raw, kmer_hist_zero_cov, kmer_hist_limited, kmer_hist_table_limit, canonical_kmers, kmer_codes, invalid_windows, long_kmer_hash, long_kmer_hash_expression, qual_prob_filter, pair_depth_hist, trusted_rebuild, unique_summary, cardinality_estimate,
        read_depth_hist, read_depth_percentiles, bad_reads, keep_toss, keep_all, toss_bad, save_rare, discard_bad_only, depth_bins, keep_pairs, keep_pairs_higher_depth, require_both, require_either, fix_spikes, multipass_2, normalized_pairs, count_up, peak_table,
        revcomp, base_cleanup, quality_cap, quality_offset_64, fake_quality, fastq_text, fasta_text, qtrim_window, qtrim_simple, qtrim_optimal, rename_reads,
        len_hist, gc_hist, base_hist, base_fraction_hist, qual_hist, qual_count_hist, avg_qual_hist, overall_qual_hist, base_quality_hist, match_hist, identity_hist, error_hist, quality_accuracy_hist, insert_hist, indel_hist, entropy_hist, barcode_stats,
        paired_reads, interleave_split, two_file_pairs, input_union, read_limit, cms_depth, cms_saturated, prefilter_counts, cms_unique_estimate, hist_compare, ecc_correct, mark_errors, overlap_repair,
    )
}


# DuckDB forms

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_TEXTS = f"""u AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS u FROM documents),
sq AS (SELECT doc_id, translate(u, {_LETTERS}, 'ACGTACGTACGTACGTACGTACGTAC') AS s, translate(u, {_LETTERS}, '56789:;<=>?@ABCDEFGHIJKLMN') AS q FROM u WHERE length(u) >= 31),
reads AS (SELECT doc_id, frag, substring(s, frag * 100 + 1, 100) AS bases, substring(q, frag * 100 + 1, 100) AS quals FROM (SELECT *, unnest(range(0, (length(s) - 1) // 100 + 1)) AS frag FROM sq) WHERE length(substring(s, frag * 100 + 1, 100)) >= 31)"""


def _windows(k: int, source: str = "reads", keep: str = "doc_id, frag") -> str:
    return f"""w AS (SELECT {keep}, pos, greatest(f, translate(reverse(f), 'ACGT', 'TGCA')) AS kmer FROM (SELECT *, substring(bases, (pos + 1)::BIGINT, {k}) AS f FROM (SELECT *, unnest(range(0, length(bases) - {k - 1})) AS pos FROM {source})))"""


def _counts(unit: str = "(doc_id, frag)", rdk: bool = True) -> str:
    return f"c AS (SELECT kmer, count({'DISTINCT ' + unit if rdk else '*'}) AS depth FROM w GROUP BY kmer)"


_HIST = "SELECT depth::BIGINT AS depth, raw_count, (raw_count + depth // 2) // depth AS unique_kmers FROM (SELECT {depth} AS depth, count(*) AS raw_count FROM w JOIN c USING (kmer) GROUP BY ALL)"
_W31 = f"WITH {_TEXTS}, {_windows(31)}, {_counts()}"


def _scores(fix: str = "list(depth ORDER BY depth)") -> str:
    """cov: ascending depths; then depth, high, low, good, bad per read."""
    at = lambda p: f"cov[(n - least(n - 1, floor(n * {p})))::BIGINT]"
    return f"""v AS (SELECT doc_id, frag, list(depth ORDER BY depth) AS cov, count(*) AS n FROM w JOIN c USING (kmer) GROUP BY ALL),
s AS (SELECT v.doc_id, v.frag, n, {at(0.54)} AS depth, {at(1 - 0.90)} AS high, {at(1 - 0.25)} AS low, len(list_filter(cov, lambda x: x >= 1)) AS good, length(bases) AS length FROM v JOIN reads USING (doc_id, frag)),
t AS (SELECT *, low <= 1 AND high >= 2 AND high >= 2 * low AS bad, ('0x' || md5(doc_id || ':' || frag)[1:8])::BIGINT AS coin FROM s),
k AS (SELECT *, good >= 10 AND length >= 1 AND (depth <= 2 OR coin * depth < 4294967296 * 2) AS keep, CASE WHEN depth <= 1 THEN 'low' WHEN depth >= 3 THEN 'high' ELSE 'mid' END AS bin FROM t)"""


_MATES = "m AS (SELECT doc_id * 100000 + frag // 2 AS pair_id, frag % 2 + 1 AS mate, 'doc' || doc_id || ':' || bases[1:3] AS id, bases, quals, doc_id, frag FROM reads)"
_PLACES = "p AS (SELECT *, upper(substring(bases, (pos + 1)::BIGINT, 1)) AS base, ascii(substring(quals, (pos + 1)::BIGINT, 1)) - 33 AS q FROM (SELECT *, unnest(range(0, length(bases))) AS pos FROM m))"
_READS = f"WITH {_TEXTS}"
_M = f"WITH {_TEXTS}, {_MATES}"
_P = f"{_M}, {_PLACES}"


def _pair_scores(lower: bool = True, both: bool = False) -> str:
    pick = "min" if lower else "max"
    return f"""{_W31.replace(_counts(), _counts('(doc_id * 100000 + frag // 2)'))}, {_scores()},
pp AS (SELECT doc_id * 100000 + frag // 2 AS pair_id, {pick}(depth) AS depth, {'min' if both else 'max'}(bad::INT)::BOOLEAN AS bad, max((good >= 10 AND length >= 1)::INT)::BOOLEAN AS enough FROM t GROUP BY ALL),
pk AS (SELECT *, enough AND (depth <= 2 OR ('0x' || md5(pair_id::VARCHAR)[1:8])::BIGINT * depth < 4294967296 * 2) AS by_depth FROM pp)"""


def _code(word: str, k: int) -> str:
    return f"list_sum(list_transform(range(0, {k}), lambda j: (instr('ACGT', substring({word}, (j + 1)::BIGINT, 1)) - 1)::HUGEINT * (1::HUGEINT << (2 * ({k - 1} - j))::INTEGER)))"


_MD5_BUCKET = "('0x' || md5(r || ':' || kmer)[1:8])::BIGINT % {cells}"


def _coded(k: int) -> str:
    """c: kmer as a number, and how many reads hold it."""
    return f"WITH {_TEXTS}, {_windows(k).replace('w AS', 'ws AS')}, cs AS (SELECT kmer, count(DISTINCT (doc_id, frag)) AS m FROM ws GROUP BY kmer), c AS (SELECT ({_code('kmer', k)})::BIGINT AS kmer, m FROM cs)"


def _cms(hashes: int, cells: int, top: int = 2**32 - 1) -> str:
    return f"h AS (SELECT kmer, m, r, {_MD5_BUCKET.format(cells=cells)} AS bucket FROM c, (SELECT unnest(range(0, {hashes})) AS r)), sk AS (SELECT r, bucket, least(sum(m), {top})::BIGINT AS n FROM h GROUP BY ALL)"


def _hash40() -> str:
    words = lambda s: (_code(f"{s}[1:20]", 20), _code(f"{s}[21:40]", 20))
    a, b = words("kmer")
    return f"WITH {_TEXTS}, {_windows(40)}, x AS (SELECT doc_id, frag, ({a})::UBIGINT AS a, ({b})::UBIGINT AS b FROM w), y AS (SELECT doc_id, frag, (xor(((a & 549755813887) << 25) | (a >> 39), b) & 9223372036854775807)::BIGINT AS kmer FROM x) SELECT doc_id, frag, count(*) AS n, min(kmer) AS least, max(kmer) AS most FROM y GROUP BY ALL"


_PPM = "floor({0} * 1e6 + 0.5)::BIGINT"


def _by_mate(rows: str) -> str:
    return f"SELECT quality, count(*) FILTER (mate = 1) AS count1, floor(count(*) FILTER (mate = 1) / (SELECT count(*) FROM {rows} WHERE mate = 1) * 1e6 + 0.5)::BIGINT AS ppm1, count(*) FILTER (mate = 2) AS count2, floor(count(*) FILTER (mate = 2) / (SELECT count(*) FROM {rows} WHERE mate = 2) * 1e6 + 0.5)::BIGINT AS ppm2 FROM {rows} GROUP BY quality"


def _multipass() -> str:
    """The second pass as the first, over the reads it kept."""
    first = f"{_W31}, {_scores()}"
    rename = lambda sql: sql
    second = f"reads2 AS (SELECT reads.* FROM reads JOIN k USING (doc_id, frag) WHERE keep), {_windows(31, 'reads2').replace('w AS', 'w2 AS', 1)}, c2 AS (SELECT kmer, count(DISTINCT (doc_id, frag)) AS depth FROM w2 GROUP BY kmer), "
    scores = _scores()
    for a, b in (("v AS", "v2 AS"), ("s AS", "s2 AS"), ("t AS", "t2 AS"), ("k AS", "k2 AS"), ("FROM w JOIN c", "FROM w2 JOIN c2"), ("FROM v JOIN reads", "FROM v2 JOIN reads2"), ("v.doc_id, v.frag", "v2.doc_id, v2.frag"), ("FROM s)", "FROM s2)"), ("FROM t)", "FROM t2)")):
        scores = scores.replace(a, b)
    return f"{first}, {second}{rename(scores)} SELECT doc_id, frag FROM k2 WHERE keep"


ORACLE_SQL: dict[str, str] = {
    "kmer_depth_hist": f"{_W31} {_HIST.format(depth='depth')}",
    "kmer_depth_hist_raw": f"WITH {_TEXTS}, {_windows(31)}, {_counts(rdk=False)} SELECT depth, count(*) AS raw_count FROM w JOIN c USING (kmer) GROUP BY depth",
    "kmer_hist_zero_cov": f"{_W31}, h AS ({_HIST.format(depth='depth')}) SELECT d AS depth, coalesce(raw_count, 0) AS raw_count, coalesce(unique_kmers, 0) AS unique_kmers FROM (SELECT unnest(range(0, (SELECT max(depth) FROM h) + 1)) AS d) LEFT JOIN h ON d = depth",
    "kmer_hist_limited": f"{_W31} {_HIST.format(depth='least(depth, 4)')}",
    "kmer_hist_table_limit": f"WITH {_TEXTS}, {_windows(31)}, c AS (SELECT kmer, count(DISTINCT (doc_id, frag)) AS depth FROM w WHERE frag < 3 GROUP BY kmer) SELECT depth, raw_count, CASE WHEN depth < 1 THEN raw_count ELSE (raw_count + depth // 2) // greatest(depth, 1) END AS unique_kmers FROM (SELECT coalesce(depth, 0) AS depth, count(*) AS raw_count FROM w LEFT JOIN c USING (kmer) GROUP BY ALL)",
    "canonical_kmers": f"WITH {_TEXTS}, {_windows(9)}, {_counts()} SELECT kmer, depth FROM c",
    "kmer_codes": f"{_coded(9)} SELECT kmer, m AS depth FROM c",
    "invalid_windows": f"WITH {_TEXTS}, r2 AS (SELECT translate(bases, 'G', 'N') AS bases FROM reads) SELECT pos::INT AS pos, count(*) FILTER (f NOT LIKE '%N%') AS valid, count(*) FILTER (f LIKE '%N%') AS invalid FROM (SELECT pos, substring(bases, (pos + 1)::BIGINT, 5) AS f FROM (SELECT bases, unnest(range(0, length(bases) - 4)) AS pos FROM r2)) GROUP BY pos",
    "long_kmer_hash": _hash40(),
    "long_kmer_hash_expression": _hash40(),
    "qual_prob_filter": f"WITH {_TEXTS}, qs AS (SELECT doc_id, frag, list_transform(string_split(quals, ''), lambda x: ascii(x) - 33) AS q FROM reads), wq AS (SELECT doc_id, frag, q[pos + 1 : pos + 9] AS q FROM (SELECT *, unnest(range(0, len(q) - 8)) AS pos FROM qs)) SELECT doc_id, frag, count(*) AS n_kmers FROM wq WHERE list_min(q) >= 21 AND list_product(list_transform(q, lambda x: 1 - pow(10.0, -x / 10.0))) >= 0.98 GROUP BY ALL",
    "pair_depth_hist": f"WITH {_TEXTS}, {_windows(31)}, {_counts('(doc_id * 100000 + frag // 2)')} {_HIST.format(depth='depth')}",
    "trusted_rebuild": f"WITH {_TEXTS}, {_windows(9)}, {_counts()} SELECT depth, count(*) AS unique_kmers FROM c WHERE depth >= 2 GROUP BY depth",
    "unique_summary": f"{_W31} SELECT count(*) AS unique_kmers, count(*) FILTER (depth < 3) AS low_depth, count(*) FILTER (depth >= 3) AS high_depth FROM c",
    "read_depth_hist": f"{_W31}, {_scores()} SELECT depth, count(*) AS reads, sum(length)::BIGINT AS bases FROM s GROUP BY depth",
    "read_depth_percentiles": f"{_W31}, {_scores()} SELECT doc_id, frag, depth, high, low, good::INT AS good, n::INT AS n_kmers FROM s",
    "bad_reads": f"{_W31}, {_scores()} SELECT doc_id, frag, high, low FROM t WHERE bad",
    "keep_toss": f"{_W31}, {_scores()} SELECT doc_id, frag, depth, keep FROM k",
    "keep_all": f"{_W31}, {_scores()} SELECT true AS keep, bin, count(*) AS reads FROM k GROUP BY bin",
    "toss_bad": f"{_W31}, {_scores()} SELECT doc_id, frag, bad, keep AND NOT bad AS keep FROM k",
    "save_rare": f"{_W31}, {_scores()} SELECT doc_id, frag, bad, keep AND NOT (bad AND depth > 2) AS keep FROM k",
    "discard_bad_only": f"{_W31}, {_scores()} SELECT doc_id, frag, NOT bad AS keep FROM k",
    "depth_bins": f"{_W31}, {_scores()} SELECT bin, count(*) AS reads, sum(length)::BIGINT AS bases FROM k GROUP BY bin",
    "keep_pairs": f"{_pair_scores()} SELECT pair_id, depth, by_depth AS keep FROM pk",
    "keep_pairs_higher_depth": f"{_pair_scores(lower=False)} SELECT pair_id, depth, by_depth AS keep FROM pk",
    "require_both": f"{_pair_scores(both=True)} SELECT pair_id, bad, by_depth AND NOT bad AS keep FROM pk",
    "require_either": f"{_pair_scores()} SELECT pair_id, bad, by_depth AND NOT bad AS keep FROM pk",
    "fix_spikes": f"{_W31}, d AS (SELECT doc_id, frag, pos, depth, lag(depth) OVER o AS a, lead(depth) OVER o AS b FROM w JOIN c USING (kmer) WINDOW o AS (PARTITION BY doc_id, frag ORDER BY pos)) SELECT doc_id, frag, sum(CASE WHEN a IS NULL OR b IS NULL THEN depth ELSE least(depth, greatest(a, b)) END)::BIGINT AS total, max(CASE WHEN a IS NULL OR b IS NULL THEN depth ELSE least(depth, greatest(a, b)) END) AS top FROM d GROUP BY ALL",
    "multipass_2": _multipass(),
    "revcomp": f"{_READS} SELECT doc_id, frag, translate(reverse(bases), 'ACGT', 'TGCA') AS rc FROM reads",
    "base_cleanup": "WITH d AS (SELECT doc_id, text, translate(translate(text, 'Uu', 'Tt'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, regexp_replace(text, '[a-z]', 'N', 'g') AS low FROM documents) SELECT doc_id, md5(regexp_replace(regexp_replace(up, '[RYSWKMBDHV]', 'N', 'g'), '[^ACGTUNX.-]', 'N', 'g')) AS fixed, md5(regexp_replace(translate(low, 'U', 'T'), '[^ACGTN]', 'N', 'g')) AS strict, regexp_matches(text, '[^ACGTUacgtuRYSWKMBDHVryswkmbdhvNn.Xx-]') AS junk FROM d",
    "quality_cap": f"{_READS} SELECT doc_id, frag, array_to_string(list_transform(string_split(quals, ''), lambda x: chr((33 + least(greatest(ascii(x) - 33, 25), 40))::INT)), '') AS quals FROM reads",
    "quality_offset_64": f"{_READS} SELECT doc_id, frag, array_to_string(list_transform(range(1, length(bases) + 1), lambda i: CASE WHEN substring(bases, i, 1) = 'C' THEN '!' ELSE chr(ascii(substring(quals, i, 1))) END), '') AS quals FROM reads",
    "fake_quality": f"{_READS} SELECT doc_id, frag, translate(bases, 'ACGT', '???!') AS quals FROM reads",
    "fastq_text": f"{_M} SELECT pair_id, mate::INT AS mate, '@' || id || chr(10) || bases || chr(10) || '+' || chr(10) || array_to_string(list_transform(string_split(quals, ''), lambda x: chr((ascii(x) + 31)::INT)), '') AS record FROM m",
    "fasta_text": f"{_M} SELECT pair_id, mate::INT AS mate, '>' || id || chr(10) || array_to_string(list_transform(range(0, (length(bases) - 1) // 30 + 1), lambda i: substring(bases, i * 30 + 1, 30)), chr(10)) AS record FROM m",
    "qtrim_window": f"{_READS}, qs AS (SELECT doc_id, frag, list_transform(string_split(quals, ''), lambda x: ascii(x) - 33) AS q FROM reads), b AS (SELECT doc_id, frag, len(q) AS n, list_filter(range(1, len(q) - 2), lambda i: list_sum(q[i : i + 3]) < 96) AS bad FROM qs) SELECT doc_id, frag, (CASE WHEN len(bad) > 0 THEN bad[1] - 1 ELSE n END)::INT AS n FROM b",
    "qtrim_simple": f"{_READS}, qs AS (SELECT doc_id, frag, bases, list_transform(string_split(quals, ''), lambda x: ascii(x) - 33) AS q FROM reads), b AS (SELECT *, list_filter(range(1, len(q)), lambda i: q[i] >= 30 AND q[i + 1] >= 30) AS good FROM qs) SELECT doc_id, frag, CASE WHEN len(good) = 0 THEN '' ELSE substring(bases, good[1], good[-1] + 2 - good[1]) END AS bases FROM b",
    "rename_reads": f"{_W31}, {_scores()} SELECT doc_id, frag, 'id=' || (doc_id * 100000 + frag) || ',d1=' || depth AS name FROM s",
    "len_hist": f"{_READS} SELECT length(bases)::BIGINT AS length, count(*) AS reads, sum(length(bases))::BIGINT AS bases FROM reads GROUP BY 1",
    "gc_hist": f"{_READS} SELECT least(floor((length(bases) - length(regexp_replace(bases, '[GC]', '', 'g'))) / length(bases) * 50), 49)::BIGINT AS gc_bin, count(*) AS reads, sum(length(bases))::BIGINT AS bases FROM reads GROUP BY 1",
    "base_hist": f"{_P} SELECT mate::INT AS mate, pos::INT AS pos, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t, count(*) FILTER (base NOT IN ('A', 'C', 'G', 'T')) AS n FROM p GROUP BY ALL",
    "base_fraction_hist": f"{_P} SELECT (pos + CASE WHEN mate = 2 THEN (SELECT max(pos) + 1 FROM p WHERE mate = 1) ELSE 0 END)::INT AS pos, floor(count(*) FILTER (base = 'A') / count(*) * 1e6 + 0.5)::BIGINT AS a, floor(count(*) FILTER (base = 'C') / count(*) * 1e6 + 0.5)::BIGINT AS c, floor(count(*) FILTER (base = 'G') / count(*) * 1e6 + 0.5)::BIGINT AS g, floor(count(*) FILTER (base = 'T') / count(*) * 1e6 + 0.5)::BIGINT AS t, 0::BIGINT AS n FROM p GROUP BY mate, p.pos",
    "qual_hist": f"{_P} SELECT q AS quality, count(*) AS bases FROM p GROUP BY q",
    "qual_count_hist": f"{_P}, r AS (SELECT mate, q AS quality FROM p) {_by_mate('r')}",
    "avg_qual_hist": f"{_P}, r AS (SELECT mate, floor(avg(q))::INT AS quality FROM p GROUP BY pair_id, mate) {_by_mate('r')}",
    "overall_qual_hist": f"{_P} SELECT q AS quality, count(*) AS bases, floor(count(*) / (SELECT count(*) FROM p) * 1e6 + 0.5)::BIGINT AS ppm FROM p GROUP BY q",
    "base_quality_hist": f"{_P}, n AS (SELECT mate, pos, q, count(*) AS n FROM p GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY mate, pos ORDER BY q) AS upto, sum(n) OVER (PARTITION BY mate, pos) AS total FROM n) SELECT mate::INT AS mate, pos::INT AS pos, sum(n)::BIGINT AS count, min(q) AS min, max(q) AS max, floor(sum(q * n) / sum(n) * 1000 + 0.5)::BIGINT AS mean_1000, "
    + ", ".join(f"min(q) FILTER (upto * 100 >= total * {p}) AS {name}" for p, name in ((25, "q1"), (50, "med"), (75, "q3"), (2, "lw"), (98, "rw")))
    + " FROM x GROUP BY x.mate, x.pos",
    "match_hist": f"{_P} SELECT mate::INT AS mate, pos::INT AS pos, count(*) AS match, 0::BIGINT AS n FROM p GROUP BY ALL",
    "identity_hist": f"{_READS} SELECT 100.0::DOUBLE AS identity, count(*) AS reads, sum(length(bases))::BIGINT AS bases FROM reads",
    "error_hist": f"{_READS} SELECT 0::BIGINT AS errors, count(*) AS reads FROM reads",
    "quality_accuracy_hist": f"{_P} SELECT q AS quality, count(*) AS match, 0::BIGINT AS sub, 0::BIGINT AS ins, 0::BIGINT AS del FROM p GROUP BY q",
    "insert_hist": "SELECT 0::BIGINT AS insert_size, 0::BIGINT AS count WHERE false",
    "indel_hist": "SELECT 0::BIGINT AS length, 0::BIGINT AS deletions, 0::BIGINT AS insertions WHERE false",
    "barcode_stats": f"{_M} SELECT bases[1:3] AS barcode, count(*) AS reads FROM m GROUP BY 1",
    "paired_reads": f"{_M} SELECT pair_id, count(*) AS mates, sum(length(bases))::BIGINT AS bases FROM m GROUP BY pair_id",
    "interleave_split": f"{_M} SELECT (doc_id * 100000 + frag) // 2 AS pair_id, mate::INT AS mate, md5(bases) AS bases FROM m",
    "two_file_pairs": f"{_M} SELECT (doc_id * 100000 + frag) // 2 AS pair_id, count(*) AS mates FROM m GROUP BY 1",
    "input_union": f"WITH {_TEXTS.replace('FROM documents)', 'FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations))')}, {_windows(31)}, {_counts()} {_HIST.format(depth='depth')}",
    "read_limit": f"{_M} SELECT mate::INT AS mate, count(*) AS reads, sum(length(bases))::BIGINT AS bases FROM m WHERE (doc_id * 100000 + frag) // 2 < 10000000 GROUP BY mate",
    "cms_depth": f"{_coded(7)}, {_cms(3, 4096)} SELECT kmer, min(n) AS depth FROM h JOIN sk USING (r, bucket) GROUP BY kmer",
    "cms_saturated": f"{_coded(7)}, {_cms(2, 1024, 255)} SELECT r::INT AS row, bucket, n FROM sk",
    "hist_compare": f"{_W31}, a AS ({_HIST.format(depth='depth')}), c3 AS (SELECT kmer, count(DISTINCT (doc_id, frag)) AS depth FROM w WHERE frag < 3 GROUP BY kmer), b AS ({_HIST.format(depth='depth').replace('FROM w JOIN c USING', 'FROM (SELECT * FROM w WHERE frag < 3) JOIN c3 USING')}), j AS (SELECT depth, coalesce(a.raw_count, 0) AS r1, coalesce(b.raw_count, 0) AS r2, coalesce(a.unique_kmers, 0) AS u1, coalesce(b.unique_kmers, 0) AS u2 FROM a FULL JOIN b USING (depth)) SELECT min(depth) FILTER (r1 <> r2 OR u1 <> u2) IS NULL AS identical, min(depth) FILTER (r1 <> r2 OR u1 <> u2) AS first_diff, sum(r1)::BIGINT AS raw_count_left, sum(r2)::BIGINT AS raw_count_right, sum(abs(r1 - r2))::BIGINT AS raw_count_delta, max(abs(r1 - r2)) AS raw_count_most, sum(u1)::BIGINT AS unique_kmers_left, sum(u2)::BIGINT AS unique_kmers_right, sum(abs(u1 - u2))::BIGINT AS unique_kmers_delta, max(abs(u1 - u2)) AS unique_kmers_most, ((sum(abs(r1 - r2)) * 1000000 + sum(r1) - 1) // sum(r1))::BIGINT AS raw_count_ppm, ((sum(abs(u1 - u2)) * 1000000 + sum(u1) - 1) // sum(u1))::BIGINT AS unique_kmers_ppm FROM j",
    "prefilter_counts": f"{_coded(9)}, {_cms(2, 65536, 3)}, e AS (SELECT kmer, min(n) AS e FROM h JOIN sk USING (r, bucket) GROUP BY kmer) SELECT kmer, m::BIGINT AS depth FROM c JOIN e USING (kmer) WHERE e >= 2",
}
