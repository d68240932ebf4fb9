import numpy as np
import pytest
from pyspark.sql import functions as F

from evenstrand.config import Config
from evenstrand.functions import bases, kmers
from evenstrand.operators import counting


def one(spark, column, **values):
    row = ", ".join(f"{'NULL' if v is None else repr(v)} AS {k}" for k, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.sql(f"SELECT {row}")
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("offset", "quals"), [(33, "!#I~I"), (64, "@Bh|h")])
def test_quality_is_normalised_and_capped(spark, offset, quals):
    b, q = bases.prepare("b", "q", Config(qin=offset))
    assert one(spark, q, b="ACGTN", q=quals) == "##IS!"
    assert one(spark, b, b="ACGTN", q=quals) == "ACGTN"


def test_quality_without_caps_and_missing(spark):
    assert one(spark, bases.prepare("b", "q", Config(change_quality=False))[1], b="ACGTN", q="!#I~I") == "##I~!"
    assert one(spark, bases.prepare("b", "q", Config())[1], b="ACGTN", q=None) is None
    assert one(spark, bases.fake_quality("b", "q"), b="ACNU", q=None) == "??!?"


def test_junk_modes(spark):
    assert one(spark, bases.clean_bases("b", Config(junk="fix")), b="ACGT?ZN") == "ACGTNNN"
    assert one(spark, bases.clean_bases("b", Config(junk="flag")), b="ACGT?ZN") == "ACGT?ZN"
    with pytest.raises(Exception, match="no bases"):
        one(spark, bases.clean_bases("b", Config()), b="ACGT?ZN")


@pytest.mark.parametrize(
    ("flags", "expected"),
    [({"u_to_t": True}, "acgttTRYn.-x"), ({"to_upper": True}, "ACGTUURYN.-X".replace("T", "T", 1)), ({"lower_to_n": True}, "NNNNNURYN.-N"), ({"dot_dash_x_to_n": True, "iupac_to_n": True}, "ACGTTTNNNNNN")],
)
def test_base_cleanup(spark, flags, expected):
    text = "acgtuURYn.-x"
    assert one(spark, bases.clean_bases("b", Config(junk="ignore", **flags)), b=text) == expected


def slow_key(window: str, k: int) -> int:
    size, words = kmers.layout(k)
    window = window[k - size * words :]
    back = window[::-1].translate(str.maketrans("ACGT", "TGCA"))
    parts = lambda s: [int("".join(str("ACGT".index(c)) for c in s[i * size : (i + 1) * size]), 4) for i in range(words)]
    best = max(parts(window), parts(back))
    x = best[0]
    for w in best[1:]:
        x = (((x << 25) | (x >> 39)) & (2**64 - 1)) ^ w
    return x & (2**63 - 1)


@pytest.mark.parametrize("k", [1, 2, 4, 9, 21, 31, 32, 40, 41, 62, 63, 124])
def test_kernels_and_expressions_agree_with_a_slow_form(spark, k):
    rng = np.random.default_rng(k)
    reads = ["".join(rng.choice(list("ACGTN"), p=[0.24, 0.24, 0.24, 0.24, 0.04], size=n)) for n in (k, k + 30, 200, 3)] + ["ACGTTGCA" * 25]
    expected = [[None if "N" in r[i : i + k] else slow_key(r[i : i + k], k) for i in range(max(0, len(r) - k + 1))] for r in reads]
    data = np.frombuffer("".join(reads).encode(), np.uint8)
    read, _, key = kmers.batch_keys(data, np.concatenate([[0], np.cumsum([len(r) for r in reads])]), k)
    assert [[None if x < 0 else int(x) for x in key[read == i]] for i in range(len(reads))] == expected
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reads)], "i int, b string").select("i", kmers.windows("b", k).alias("w"))
    assert [r.w for r in df.orderBy("i").collect()] == expected


def test_layout():
    assert [kmers.layout(k) for k in (31, 32, 40, 41, 62, 63)] == [(31, 1), (16, 2), (20, 2), (20, 2), (31, 2), (21, 3)]


def test_reverse_complement_is_the_same_kmer(spark):
    a, b = "ACGTACGTACGTAGGTACGTACCTACGTTTGA", "TCAAACGTAGGTACGTACCTACGTACGTACGT"
    for x, y, k in (("ACGA", "TCGT", 4), (a, b, 32)):
        assert one(spark, kmers.key("b", F.lit(1), k), b=x) == one(spark, kmers.key("b", F.lit(1), k), b=y)


def test_quality_filter(spark):
    df = spark.createDataFrame([(1, 0, "ACGT", "I!II"), (2, 0, "ACGT", None), (3, 0, "ACGTA", "!!!!!"), (4, 0, "ACNTA", "IIIII")], "doc_id long, frag long, bases string, quals string")
    reads = counting.Reads(df, quals="quals")
    filtered = lambda **o: {r.doc_id: r.n for r in counting.windows(reads, Config(**o), True).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert filtered(k=3, min_quality=30, min_prob=0.0) == {2: 2}
    assert filtered(k=3, min_quality=0, min_prob=0.5) == {2: 2}
    assert counting.windows(reads, Config(k=3), False).count() == 10
