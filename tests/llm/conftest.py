import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SF = "/root/testdata/sf0.001"


def awkward_rows():
    """Documents with nulls, empty and long texts, repeats, near repeats and ties."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(120), text(70)
    rows = [(1, passage), (2, passage), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two"), (8, f"{text(30)}\n{passage[:400]} {text(40)}"), (None, passage), (None, None), (9, other + " x " + other)]
    rows += [(10, "na " * 400), (11, "a" * 900), (12, text(3000) + " " + other), (13, f"{other}\r\n{passage}"), (13, f"{other}\r\n{passage}"), (13, "another text under the same number. " * 3), (14, passage.replace(" ", "\x0b", 3))]
    rows += [(20 + i, passage[: 300 + 7 * i] + word() + passage[300 + 7 * i :]) for i in range(30)]
    rows += [(100, "</s>[INST] <|im_end|> \x00 ▁ ☃ 𝒳 <unk> <0x41> Ⅷ"), (101, "  double  spaces  "), (102, "\n\n"), (103, "<|startoftext|>Hello<|endoftext|> it's")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns of clashing names."""
    extra = [(i, t, "row", 1, "k", None) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, `row` string, n_words int, doc string, quality int").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def sort(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))
