import numpy as np
import pytest

from evenstrand.config import Config, parse_args
from evenstrand.operators import counting, decide, ecc, hists, trim
from evenstrand.plans import normalize as plan
from evenstrand.plans import peaks
from evenstrand.sources import reads as source


def write_fastq(path, records):
    path.write_text("".join(f"@{i}\n{b}\n+\n{q}\n" for i, b, q in records))


def lines(folder):
    return [x for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_histograms_of_the_basic_reads(spark, tmp_path):
    write_fastq(tmp_path / "r.fq", [(f"r{i}", b, "IIIIII") for i, b in enumerate(("AAAAAA", "AAAAAA", "CCCCCC"))])
    args = f"in={tmp_path}/r.fq out={tmp_path}/keep hist={tmp_path}/h histout={tmp_path}/ho rhist={tmp_path}/rh peaks={tmp_path}/p k=3 minq=0 minprob=0 minkmers=1 min=1 target=1 max=1 keepall=t histlen=10 passes=1"
    result = plan.run(spark, parse_args(args.split()))
    assert (tmp_path / "h").read_text() == "#Depth\tRaw_Count\tUnique_Kmers\n1\t4\t4\n2\t8\t4\n" == (tmp_path / "ho").read_text()
    assert (tmp_path / "rh").read_text() == "#Depth\tReads\tBases\n1\t1\t6\n2\t2\t12\n"
    assert result.summary == {"reads_in": 3, "bases_in": 18, "reads_kept": 3, "reads_tossed": 0, "unique_kmers_in": 2}
    assert lines(tmp_path / "keep") == [x for i, b in enumerate(("AAAAAA", "AAAAAA", "CCCCCC")) for x in (f"@r{i}", b, "+", "IIIIII")]


def test_a_prefilter_drops_kmers_seen_once(spark, tmp_path):
    write_fastq(tmp_path / "r.fq", [(f"r{i}", b, "IIIIII") for i, b in enumerate(("AAAAAA", "AAAAAA", "CCCCCC"))])
    args = f"in={tmp_path}/r.fq hist={tmp_path}/h k=3 minq=0 minprob=0 minkmers=1 min=1 target=1 max=1 keepall=t histlen=10 passes=1 prefilter=t"
    assert plan.run(spark, parse_args(args.split())).summary["unique_kmers_in"] == 1
    assert "\n1\t" not in (tmp_path / "h").read_text() and "\n2\t8\t4\n" in (tmp_path / "h").read_text()


def test_bits_of_the_first_pass_are_noted():
    assert any("bits1" in n for n in parse_args(["in=x.fq", "bits1=8"]).notes)


def test_two_passes_lose_no_read_to_both_sides(spark, tmp_path):
    write_fastq(tmp_path / "r.fq", [(f"r{i}", "ACGTACGTACGTACGTACGT", "I" * 20) for i in range(20)])
    args = f"in={tmp_path}/r.fq out={tmp_path}/keep outt={tmp_path}/toss passes=2 k=7 minq=0 minprob=0 min=0 minkmers=1 target=1 max=1"
    r = plan.run(spark, parse_args(args.split()))
    assert 0 <= r.summary["reads_kept"] + r.summary["reads_tossed"] <= 20


def test_fasta_fastq_and_pairs(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1\nAC\nGT\n\n>r2\nTT\n")
    assert [(r.id, r.bases, r.quals) for r in source.read(spark, str(tmp_path / "a.fa")).orderBy("numeric_id").collect()] == [("r1", "ACGT", None), ("r2", "TT", None)]
    (tmp_path / "bad.fq").write_text("@r\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="differ in length"):
        source.read(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "x").write_text("ACGT\n")
    with pytest.raises(ValueError, match="neither"):
        source.sniff(spark, str(tmp_path / "x"))
    assert source.look_paired("read/1", "read/2") and source.look_paired("a 1:N", "a 2:N") and not source.look_paired("read/1", "other/2")
    assert not source.look_paired("same", "same") and source.look_paired("same", "same", True)
    write_fastq(tmp_path / "i.fq", [("p/1", "ACGT", "IIII"), ("p/2", "TTTT", "IIII"), ("q/1", "CCCC", "IIII"), ("q/2", "GGGG", "IIII")])
    rows = source.load(spark, parse_args([f"in={tmp_path}/i.fq"])).orderBy("numeric_id").collect()
    assert [(r.pair_id, r.mate) for r in rows] == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_peaks():
    raw = np.zeros(128, np.int64)
    raw[20] = 720
    c = Config(k=5, peak_height=1, peak_volume=1, peak_width=1, peak_min=1, peak_max=100)
    (p,) = peaks.call_peaks(peaks.unique_counts(raw), c)
    assert (p.start, p.center, p.stop, p.height, p.volume) == (17, 20, 23, 36, 36)
    assert peaks.peaks_text(raw, c).splitlines()[-1] == "17\t20\t23\t36\t36"
    assert peaks.call_peaks(np.zeros(40, np.int64), c) == []


def test_two_peaks_give_ploidy_and_genome_size():
    x = np.arange(200)
    unique = (10_000 * np.exp(-((x - 25) ** 2) / 30) + 40_000 * np.exp(-((x - 50) ** 2) / 60)).astype(np.int64)
    unique[1] = 500_000
    found = peaks.call_peaks(unique, Config())
    assert len(found) == 2 and abs(found[0].center - 25) <= 1 and abs(found[1].center - 50) <= 1
    stats = dict(peaks.statistics(found, unique, Config()))
    assert (stats["ploidy"], stats["main_peak"], stats["fold_coverage"]) == (2, found[1].center, found[1].center // 2)


def test_each_extra_input_counts_for_itself(spark, tmp_path):
    for name in "abcd":
        write_fastq(tmp_path / f"{name}.fq", [("r", "ACGTTGCA", "IIIIIIII")])
    c = parse_args([f"in={tmp_path}/a.fq", f"extra={tmp_path}/b.fq,{tmp_path}/c.fq,{tmp_path}/d.fq", "k=8", "passes=1", "minq=0", "minprob=0", "keepall=t"])
    assert [r.depth for r in plan.run(spark, c).counts.collect()] == [4]


def test_output_lists_follow_input_lists(spark, tmp_path):
    for name in "ab":
        write_fastq(tmp_path / f"{name}.fq", [("r", "ACGTTGCA", "IIIIIIII")] * 2)
    two = [f"in={tmp_path}/a.fq,{tmp_path}/b.fq", "k=8", "passes=1", "minq=0", "minprob=0", "minkmers=1", "min=1", "keepall=t", "int=f"]
    plan.run(spark, parse_args([*two, f"out={tmp_path}/x,{tmp_path}/y"]))
    assert len(spark.read.text(f"{tmp_path}/x").collect()) == len(spark.read.text(f"{tmp_path}/y").collect()) == 8
    with pytest.raises(ValueError, match="outputs"):
        plan.run(spark, parse_args([*two, f"out={tmp_path}/x1,{tmp_path}/y1,{tmp_path}/z1"]))


CLEAN, MUTANT = "ACGTTGCATGTCAGTACCGTAACGTTGCA", "ACGTTGCATGTCAGAACCGTAACGTTGCA"


def ecc_reads(spark, mutant=MUTANT):
    rows = [(0, i, 1, f"clean{i}", CLEAN, "I" * 29) for i in range(30)] + [(0, 30, 1, "mutant", mutant, "I" * 29)]
    return spark.createDataFrame(rows, "file_idx int, pair_id long, mate int, id string, bases string, quals string")


ECC = dict(passes=1, k=7, min_quality=0, min_prob=0.0, min_depth=0, min_kmers=1, target=10**9, max_depth=10**9, keep_all=True, ecc=True, ecc_first=True, ecc_final=True)


def test_one_substitution_is_corrected_or_marked(spark):
    rows = {r.id: r for r in plan.normalize(ecc_reads(spark), Config(**ECC)).decided.collect()}
    assert rows["mutant"].bases == CLEAN and rows["clean3"].bases == CLEAN and not rows["mutant"].uncorrected
    rows = {r.id: r for r in plan.normalize(ecc_reads(spark), Config(**ECC, ecc_max_quality=0, mark_uncorrectable=True)).decided.collect()}
    assert rows["mutant"].bases == MUTANT and rows["mutant"].uncorrected and "2" in rows["mutant"].quals and not rows["clean3"].uncorrected
    tail = CLEAN[:-1] + "C"
    rows = {r.id: r for r in plan.normalize(ecc_reads(spark, tail), Config(**ECC, mark_only=True, trim_after_marking=True, trim_right=True, trim_quality=20.0, trim_optimal=False)).decided.collect()}
    assert rows["mutant"].bases == tail[:-1] and rows["clean1"].bases == CLEAN


def test_overlap_repair(spark):
    one, two = "TTAGTTGTGCCGCAGCGAAGTAGTGCTTGAAATATGCGAC", "GTCGCATATTTCAAGCACTAATTCGCTGCGGCACAACTAA"
    q2 = "I" * 20 + "!" + "I" * 19
    df = spark.createDataFrame([(0, 0, 1, "p/1", one, "I" * 40), (0, 0, 2, "p/2", two, q2)], "file_idx int, pair_id long, mate int, id string, bases string, quals string")
    got = {r.mate: r.bases for r in plan._repair(df).collect()}
    assert got == {1: one, 2: "GTCGCATATTTCAAGCACTACTTCGCTGCGGCACAACTAA"}
    assert ecc.best_overlap(np.frombuffer(b"AC" * 20, np.uint8), np.frombuffer(b"AC" * 20, np.uint8)) is None


def test_barcodes(spark):
    df = spark.createDataFrame([("a:ACGT",), ("b:1:TGCA",), ("none",), ("c:ACGT",)], "id string")
    assert hists.barcode_text(df) == "#Reads\t4\n#Barcodes\t3\nACGT\t2\nNONE\t1\nTGCA\t1\n"


def test_trimming_keeps_the_good_part(spark):
    df = spark.createDataFrame([("ACGTACGTAC", "##IIIIII##"), ("ACGT", None), ("ACGT", "####")], "bases string, quals string")
    both = dict(trim_left=True, trim_right=True, trim_quality=10.0)
    for c in (Config(**both), Config(**both, trim_optimal=False)):
        assert [r.bases for r in trim.trim(df, c).collect()] == ["GTACGT", "ACGT", ""]


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, "".join(rng.choice(list("ACGT"), 60))) for i in range(40)] * 2
    rows = [(i, n % 2, b) for n, (i, _, b) in enumerate(rows)]
    out = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, frag long, bases string").repartition(parts)
        c = Config(k=11, target=1, max_depth=1, min_depth=1, min_kmers=1)
        r = counting.Reads(df)
        scored = decide.score(counting.coverage(r, plan.save(counting.count_kmers(r, c), "counts"), c), c)
        out.append(sorted(tuple(x) for x in decide.decide_single(scored, c, "doc_id", "frag").select("doc_id", "frag", "depth", "keep").collect()))
    assert out[0] == out[1] and len({k for *_, k in out[0]}) == 2
