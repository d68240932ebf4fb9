import pytest

from evenstrand.config import OptionError, count, parse_args, percent


def test_defaults_and_derived_rules():
    c = parse_args(["in=r.fq"])
    assert (c.k, c.min_quality, c.min_prob, c.passes, c.target, c.max_depth) == (31, 5, 0.5, 2, 100, 100)
    one = parse_args(["in=r.fq", "passes=1", "max=3", "target=7", "histlen=10", "minkmers=0"])
    assert (one.target_bad_low, one.target_bad_high, one.max_depth, one.hist_len, one.min_kmers) == (1.0, 1.0, 7, 11, 1)


def test_order_bare_words_and_bare_booleans():
    c = parse_args(["r.fq", "kept.fq", "k=21", "k=25", "keepall", "-Overwrite=T"])
    assert (c.in1, c.outs["keep"], c.k, c.keep_all, c.overwrite) == ("r.fq", "kept.fq", 25, True, True)
    with pytest.raises(OptionError):
        parse_args(["a", "b", "c"])


def test_errors_and_notes():
    for bad in ("nosuch=1", "passes=5", "breaklen=10", "amino=t", "recal=t", "keepall=maybe", "junk=odd", "extra=/no/such.fq"):
        with pytest.raises(OptionError):
            parse_args([bad])
    assert any("threads" in n for n in parse_args(["threads=4"]).notes)
    assert parse_args(["canonical=f"]).notes


def test_values():
    assert (count("2k"), count("3c"), count("5d"), count("1g")) == (2000, 300, 50, 10**9)
    assert percent("54") == percent("0.54") == 0.54


def test_presets_and_stage_options():
    a = parse_args(["aec"])
    assert (a.ecc_high, a.ecc_low, a.ecc_ratio, a.ecc_limit, a.prefix_len) == (16, 3, 100, 7, 2)
    cons = parse_args(["cec=t"])
    assert (cons.ecc_high, cons.ecc_low, cons.ecc_ratio, cons.ecc_limit, cons.ecc_max_quality, cons.suffix_len) == (30, 1, 170, 2, 25, 4)
    assert not parse_args(["aec=f"]).ecc
    assert parse_args(["meo"]).ecc_first and parse_args(["ecco=auto"]).overlap_auto
    d = parse_args(["dbo2=t", "tbr", "rieb=t"])
    assert d.discard_bad_only and d.discard_bad_only_first and d.toss_bad_first and not d.require_both_bad
    assert parse_args(["qtrim=w,6"]).trim_window_length == 6
    assert parse_args(["qtrim=15,20"]).trim_quality == 15.0


def test_config_files_hash_names_and_interleaving(tmp_path):
    f = tmp_path / "args"
    f.write_text("# options\nk=19\n\nmin=2\n")
    c = parse_args([f"config={f}", "min=3", "in=/none/reads#.fq", "out=kept#.fq", "int=t"])
    assert (c.k, c.min_depth, c.in1, c.in2, c.outs["keep2"]) == (19, 3, "/none/reads1.fq", "/none/reads2.fq", "kept2.fq")
    assert not c.interleaved and c.notes
    with pytest.raises(OptionError):
        parse_args(["in=stdin.fq", "in2=-"])
