"""Depths by runs of windows, against a count in plain Python."""

from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from evenstrand import queries
from evenstrand.config import Config
from evenstrand.functions import kmers, runs
from evenstrand.operators import countup, counting, decide, ecc, hists, trim
from evenstrand.plans import normalize as plan
from evenstrand.sources import reads as source

SF = "/root/testdata/sf0.001"
SCHEMA = "p long, mate int, bases string, quals string"


def keys(bases, k):
    data = (bases or "").encode()
    return kmers.batch_keys(np.frombuffer(data, np.uint8), np.array([0, len(data)]), k)[2].tolist()


def expected(rows, c, unit, quals):
    """Depths of each read's windows; -1 where there is no k-mer."""
    seen = Counter()
    for name in {unit(r) for r in rows}:
        held = []
        for r in rows:
            if unit(r) == name:
                q = r[3] if quals and r[3] is not None else None
                held += [x for i, x in enumerate(keys(r[2], c.k)) if x >= 0 and (q is None or all(ord(y) - 33 >= c.min_quality for y in q[i : i + c.k]))]
        seen.update(set(held) if c.rdk else held)
    least = 2 if c.build_passes > 1 else 0
    return {r[:2]: [-1 if x < 0 else seen[x] if seen[x] >= least else 0 for x in keys(r[2], c.k)] for r in rows}


def odd_reads():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in (300, 90, 45, 31, 30, 1)]
    texts += [texts[1][10:70], "A" * 400, "AC" * 40, texts[0][:100] + "N" + texts[0][50:150], texts[2][::-1].translate(str.maketrans("ACGT", "TGCA")), "acgtu" * 12, "é" + texts[2], "", None, "N" * 50]
    texts += [texts[0][i : i + 60] for i in range(0, 240, 7)]
    return [(i // 2, i % 2 + 1, t, None if t is None or i % 5 == 0 or "é" in t else "".join(chr(33 + x) for x in rng.choice([2, 30, 40], len(t), p=[0.02, 0.49, 0.49]))) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k,pairs,quals,more", [(31, False, False, {}), (31, True, False, {}), (21, True, True, {"min_quality": 5}), (5, True, False, {}), (40, False, False, {}), (70, True, False, {}), (31, True, False, {"rdk": False}), (17, False, False, {"build_passes": 2})])
def test_depths_by_runs(spark, k, pairs, quals, more):
    rows = odd_reads()
    c = Config(**{"k": k, "min_quality": 0, "min_prob": 0.0} | more)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    r = counting.Reads(df, ("p",) if pairs else ("p", "mate"), ("p", "mate"), quals="quals" if quals else None)
    got = counting.coverage(r, counting.Counted(r, c), c, carry=("bases",)).collect()
    want = expected(rows, c, lambda x: x[0] if pairs else x[:2], quals)
    assert {(x.p, x.mate): x.cov for x in got} == want
    assert {(x.p, x.mate, x.bases, x.length) for x in got} == {(*x[:3], None if x[2] is None else len(x[2])) for x in rows}


def test_reads_scored_against_other_reads(spark):
    rows = odd_reads()
    c = Config(k=21, min_quality=0, min_prob=0.0)
    one, two = (spark.createDataFrame(x, SCHEMA) for x in (rows[::2], rows[1::2]))
    r = counting.Reads(two, ("p", "mate"), ("p", "mate"))
    got = counting.coverage(r, counting.Counted(counting.Reads(one, ("p", "mate"), ("p", "mate")), c), c).collect()
    seen = Counter(x for row in rows[::2] for x in set(keys(row[2], 21)))
    assert {(x.p, x.mate): x.cov for x in got} == {x[:2]: [-1 if y < 0 else seen[y] for y in keys(x[2], 21)] for x in rows[1::2]}


def test_large_buckets_go_in_portions(monkeypatch):
    data = np.frombuffer("".join(t for _, _, t, _ in odd_reads() if t and "é" not in t).encode(), np.uint8)
    read, place, key = kmers.batch_keys(data, np.array([0, len(data)]), 15)
    _, _, packs = runs.split(data, read, place, np.array([0, len(data)]), key >= 0, key >= 0, 15, 2)
    whole = [list(runs.answered([p] * 5, 15)) for p in packs.values()]
    monkeypatch.setattr(runs, "AT_ONCE", 1)
    assert [list(runs.answered([p] * 5, 15)) for p in packs.values()] == whole


@pytest.mark.parametrize("name", ["read_depth_hist", "keep_pairs", "fix_spikes", "multipass_2", "mark_errors"])
def test_scores_join_no_windows(spark, name):
    """A row a window, joined with a table of all counts, took more disk than 4 times the input."""
    plan = entry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_correction_is_the_same_by_runs_and_by_table(spark):
    rng = np.random.default_rng(8)
    good = "".join(rng.choice(list("ACGT"), 70))
    bad = [good[:i] + ("A" if good[i] != "A" else "C") + good[i + 1 :] for i in (5, 30, 64)]
    rows = [(0, i, 1, b, "I" * len(b)) for i, b in enumerate([good] * 6 + bad + [bad[0].lower(), good[:20] + "N" + good[21:], ""])]
    df = spark.createDataFrame(rows, "file_idx int, pair_id long, mate int, bases string, quals string")
    counted = counting.Counted(counting.Reads(df, tuple(plan.KEY), tuple(plan.KEY)), queries.ECC)
    saved = []
    for counts in (counted, plan.save(counted.table(), "counts")):
        saved.append(sorted(tuple(x) for x in ecc.correct(df, plan.KEY, counts, queries.ECC, plan.save).select("pair_id", "bases", "n_errors", "uncorrected").collect()))
        saved.append(sorted(tuple(x) for x in ecc.mark(df, plan.KEY, counts, queries.ECC).select("pair_id", "bases", "n_errors", "quals").collect()))
    assert saved[:2] == saved[2:]
    assert [x[1] for x in saved[0][6:9]] == [good] * 3


def noisy_reads():
    """Reads of a text with errors, U, N, small letters, qualities of all kinds."""
    rng = np.random.default_rng(21)
    good, out = "".join(rng.choice(list("ACGT"), 150)), []
    for i in range(60):
        a = int(rng.integers(0, 90))
        t = list(good[a : a + int(rng.integers(30, 60))])
        for j in np.flatnonzero(rng.random(len(t)) < 0.04):
            t[j] = str(rng.choice(list("ACGTACGTUNau")))
        t = "".join(t)
        out.append(t if i % 3 else t[::-1].translate(str.maketrans("ACGTU", "TGCAA")))
    out += [good[:60]] * 4 + [good[:60].lower(), "ACGT" * 12, "ACGT" * 6 + "ACGA" + "ACGT" * 6, "", None, good[:5]]
    return [(0, i, 1, t, None if t is None or i % 7 == 0 else "".join(chr(33 + x) for x in rng.choice([2, 30, 40], len(t) // 2 if i % 11 == 0 else len(t)))) for i, t in enumerate(out)]


@pytest.mark.parametrize("more", [{}, {"ecc_limit": 4}, {"ecc_limit": 0}, {"k": 12, "ecc_limit": 3}, {"k": 8, "correct_left": False}, {"k": 31, "correct_right": False}, {"ecc_max_quality": 30}, {"ecc_high": 2, "ecc_low": 0, "ecc_ratio": 2}, {"k": 6, "ecc_high": 1, "ecc_ratio": 1, "ecc_low": 0}, {"rdk": False, "build_passes": 2}])
def test_correction_in_rounds(spark, more):
    """All reads were scored anew in every round, and joined with what to change, which took more time and disk than the limits."""
    c = queries.ECC.replace(**({"k": 11, "ecc_limit": 2} | more))
    df = spark.createDataFrame(noisy_reads(), "file_idx int, pair_id long, mate int, bases string, quals string").repartition(3)
    counted, plans = counting.Counted(counting.Reads(df, tuple(plan.KEY), tuple(plan.KEY)), c), []

    def save(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plan.save(df, name)

    got = ecc.correct(df, plan.KEY, counted, c, save, plan.forget)
    assert not any("Join" in x for x in plans) and len(plans) == 2 * c.ecc_limit + 2
    want = ecc.correct(df, plan.KEY, plan.save(counted.table(), "counts"), c, plan.save)
    assert got.columns == [*plan.KEY, "bases", "quals", "n_errors", "uncorrected"]
    key = lambda r: r["pair_id"]
    got, want = sorted(got.collect(), key=key), sorted(want.select(*got.columns).collect(), key=key)
    assert got == want and len(got) == df.count()
    if not more:
        assert {0, 1, 2} <= {r.n_errors for r in got} and {True, False} == {r.uncorrected for r in got}


def test_deep_others_of_windows(monkeypatch):
    """The depths of all k-mers that differ in the first or last base, by trying them all."""
    texts = [t.upper().replace("U", "T") for *_, t, _ in noisy_reads() if t]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    for k in (8, 11):
        read, place, key = kmers.batch_keys(data, offsets, k)
        many, of, packs = runs.split(data, read, place, offsets, key >= 0, key >= 0, k, 3, True)
        to, found, deep = runs.places(many, of), {}, Counter(key[key >= 0].tolist())
        for bucket in sorted(packs):
            whole = runs.judged([packs[bucket]] * 2, k, 0, 6)
            with monkeypatch.context() as m:
                m.setattr(runs, "AT_ONCE", 1)
                for x, y in zip(whole, runs.judged([packs[bucket]] * 2, k, 0, 6), strict=True):
                    assert np.array_equal(x, y) if isinstance(x, np.ndarray) else x == y
            assert runs.judged([packs[bucket]], k, 0, 6, whole[2:])[:2] == ([whole[0][0]], [whole[1][0]])
            for w, side, bits, depth in np.frombuffer(whole[1][0], runs.OTHER).tolist():
                found[int(to[w]), side] = bits, depth
            to = to[len(whole[0][0]) - 1 :]
        want = {}
        for w in np.flatnonzero(key >= 0).tolist():
            text = data[offsets[read[w]] + place[w] :][:k].tobytes().decode()
            back = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
            text = max(text, back)  # letters are in the order of their codes
            for side, at in ((runs.LAST, k - 1), (runs.FIRST, 0)):
                depths = {b: 2 * deep[keys(text[:at] + b + text[at + 1 :], k)[0]] for b in "ACGT" if b != text[at]}
                if max(depths.values()) >= 6:
                    want[w, side] = sum(1 << "ACGT".index(b) for b, d in depths.items() if d == max(depths.values())), max(depths.values())
        assert found == want and len(want) > 50


@pytest.mark.parametrize("k,w,with_ns", [(5, 50, False), (5, 50, True), (3, 20, False), (40, 60, True), (1, 4, False), (9, 5, False)])
def test_entropy_of_odd_reads(k, w, with_ns):
    """Every window's k-mers were compared with each other, which took too long."""

    def value(t):
        found = [t[i : i + k] for i in range(len(t) - k + 1)]
        good = Counter(x for x in found if with_ns or set(x) <= set("ACGT"))
        n = sum(good.values())
        return -sum(c / n * np.log(c / n) for c in good.values()) / np.log(min(n, 4**k)) if len(found) > 1 and n > 1 else 0.0

    texts = [t for _, _, t, _ in odd_reads() if t]
    want = [np.mean([value(t[i * w : i * w + w]) for i in range(max(1, len(t) // w))]) for t in texts]
    assert np.allclose(hists.mean_entropy(texts, k, w, with_ns), want, atol=1e-12)


def test_window_expression_of_odd_reads(spark):
    texts = [t for _, _, t, _ in odd_reads() if t and "é" not in t]
    df = spark.createDataFrame([(t,) for t in texts], "bases string")
    for k in (5, 31, 40):
        got = [r[0] for r in df.select(kmers.windows("bases", k)).collect()]
        assert got == [[None if x < 0 else x for x in keys(t, k)] for t in texts]
    plan = entry.QUERIES["long_kmer_hash_expression"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1  # cutting texts to reads; windows are not rows


@pytest.mark.parametrize("target,percentile,quals,tabled", [(2, 0.5, False, False), (1, 0.9, False, False), (2, 0.5, True, True), (3, 0.0, False, True)])
def test_count_up_in_order(spark, target, percentile, quals, tabled):
    """One read after another, in plain Python; copies, overlaps, repeats within a read, N, qualities, no text."""
    rows = [(i, 1, t, q) for i, (_, _, t, q) in enumerate(odd_reads() * 3)]
    c = Config(k=21, target=target, percentile=percentile, min_quality=5 if quals else 0, min_prob=0.0, min_kmers=0, min_depth=1, min_length=0, high_thresh=10**6, low_thresh=4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    r = counting.Reads(df, ("p", "mate"), ("p", "mate"), quals="quals" if quals else None)
    counts = plan.save(counting.count_kmers(r, c), "counts") if tabled else counting.Counted(r, c)
    got = {x.p: x.keep for x in countup.count_up(r, counts, c, plan.save).where("NOT hopeless").collect()}
    cov = expected(rows, c, lambda x: x[:2], quals)
    rare = {k[0]: sum(0 <= x <= c.low_thresh for x in v) for k, v in cov.items()}
    seen, want = Counter(), {}
    for p, _, t, q in sorted((r for r in rows if r[0] in got), key=lambda r: (rare[r[0]], -len(r[2] or ""), r[0])):
        q = q if quals else None
        held = {x for i, x in enumerate(keys(t, 21)) if x >= 0 and (q is None or all(ord(y) - 33 >= c.min_quality for y in q[i : i + 21]))}
        depths = sorted((seen[x] for x in held), reverse=True)
        want[p] = bool(held) and depths[min(len(held) - 1, int(len(held) * percentile))] < target
        seen.update(held if want[p] else ())
    assert len(got) >= 100 and got == want and {True, False} == set(want.values())


def test_count_up_deals_windows_once(spark):
    """A row a window went into every round, which took too long: rounds read classes of k-mers instead."""
    df = spark.createDataFrame([(i, 1, t, q) for i, (_, _, t, q) in enumerate(odd_reads()[:1] * 8)], SCHEMA)
    r, sizes = counting.Reads(df, ("p", "mate"), ("p", "mate")), {}

    def save(df, name):
        out = plan.save(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    c = Config(k=21, target=2, min_quality=0, min_prob=0.0, min_kmers=0, high_thresh=10**6)
    kept = countup.count_up(r, counting.Counted(r, c), c, save).where("keep").count()
    assert kept == 2 and sizes["seen"][0] == 8 and sizes["texts"] == [1]


@pytest.mark.parametrize("together,more", [(False, {}), (True, {}), (False, {"trim_right": True, "trim_quality": 10.0}), (True, {"target_first": 1, "passes": 3, "rdk": False})])
def test_passes_over_pairs(spark, monkeypatch, together, more):
    """Reads were joined with a table of counts and with decisions in each pass, which took more disk than 4 times the input."""
    c = Config(**{"k": 21, "target": 2, "max_depth": 3, "min_depth": 1, "min_kmers": 5, "min_quality": 5, "min_prob": 0.0} | more)
    rows = [(0, p + 100 * n, m, f"r{p}", t, q) for n in range(4) for p, m, t, q in odd_reads() if t is not None]
    schema = "file_idx int, pair_id long, mate int, id string, bases string, quals string"
    df = spark.createDataFrame(rows, schema)
    names, plans, save = [], [], plan.save

    def noted(df, name):
        names.append(name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    monkeypatch.setattr(plan, "save", noted)
    given = df.coalesce(1).sortWithinPartitions("pair_id", "mate") if together else df.repartition(5, "mate")
    got = plan.normalize(given, c, together=together).decided
    assert got.columns == [*plan.KEY, "id", "bases", "quals", "n_errors", "read_depth", "depth", "bad", "keep", "bin", "uncorrected"]
    got = {tuple(r[x] for x in ("pair_id", "mate", "id", "bases", "quals", "read_depth", "depth", "keep", "bin")) for r in got.collect()}
    assert "counts" not in names and not any("Join" in x for x in plans)
    for number in range(1, c.passes + 1):
        first = number < c.passes
        cut = [tuple(r) for r in trim.trim(spark.createDataFrame(rows, schema), c).collect()]
        seen = expected([(r[1], r[2], r[4], r[5]) for r in rows], c, lambda x: x[0], True)
        deep = {x: d for (p, m, t, _), ds in zip([(r[1], r[2], r[4], r[5]) for r in rows], seen.values(), strict=True) for x, d in zip(keys(t, c.k), ds, strict=True)}
        cov = [(*r[:3], len(r[4]), [-1 if x < 0 else deep[x] for x in keys(r[4], c.k)]) for r in cut]
        scored = decide.score(spark.createDataFrame(cov, "file_idx int, pair_id long, mate int, length int, cov array<long>"), c)
        judge = c.replace(target=c.target_first) if first and c.target_first else c
        pairs = {r.pair_id: r for r in decide.decide_pairs(scored, judge, *plan.PAIR, first=first).collect()}
        own = {(r.pair_id, r.mate): r.depth for r in scored.collect()}
        if first:
            rows = [r for r in cut if pairs[r[1]].keep]
    assert got == {(*r[1:6], own[r[1:3]], pairs[r[1]].depth, pairs[r[1]].keep, pairs[r[1]].bin) for r in cut}
    assert 0 < len(got) < given.count()


def test_counts_of_a_normalisation_are_made_when_asked(spark):
    df = spark.createDataFrame([(0, i, 1, "r", "ACGTTGCA", "IIIIIIII") for i in range(3)], "file_idx int, pair_id long, mate int, id string, bases string, quals string")
    extra = df.where("pair_id < 2")
    result = plan.normalize(df, Config(k=8, passes=1, min_quality=0, min_prob=0.0, keep_all=True), extra)
    assert [(r.read_depth, r.keep) for r in result.decided.collect()] == [(5, True)] * 3
    assert "counts" not in vars(result) and [r.depth for r in result.counts.collect()] == [5]


def test_reads_cut_by_kernel(spark):
    """Letters were looked up one by one, four times a text, which took a fifth of the time of normalized_pairs."""
    rng = np.random.default_rng(3)
    texts = [None, "", "é" * 50, "x" * 30, "aZ" * 65 + "é1", "Q" * 131, "a\n" * 100, "ß" + "z" * 100, "\x00A-" * 40]
    texts += ["".join(rng.choice(list("abcXYZ éñ\t,.漢"), n)) for n in (50, 150, 1000, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got, want = source.reads_by_kernel(df), source.reads_of_documents(df)
    assert [(x.name, x.dataType) for x in got.schema] == [(x.name, x.dataType) for x in want.schema]
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 20


@pytest.mark.parametrize("least,k,min_quality,min_prob", [(20, 31, 5, 0.5), (0, 31, 5, 0.5), (20, 31, 20, 0.75), (20, 5, 21, 0.9), (0, 3, 0, 0.0), (1, 2, 0, 0.01)])
def test_quality_filter_of_odd_qualities(least, k, min_quality, min_prob):
    q = np.random.default_rng(4).integers(least, 46, 400)
    q[:200] = 20 if least else 0
    place = np.arange(400 - k + 1)
    got = kmers.quality_filter((q + 33).astype(np.uint8), None, np.array([0, 400]), np.zeros(len(place), int), place, k, min_quality, min_prob)
    right = np.where(q > 0, 1 - 10 ** (-q / 10), 0.0)
    assert got.tolist() == [bool(q[i : i + k].min() >= min_quality and (min_prob <= 0 or right[i : i + k].prod() >= min_prob - 1e-9)) for i in place]
