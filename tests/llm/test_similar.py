import random

import brute
import pytest
from conftest import SF, sort

import corpus_pipeline
from evenstrand.llm import similar

def edited(seed):
    """Groups of near copies around the limit, chains of them, and a passage that many texts hold."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(40)]
    texts = []
    for _ in range(6):
        text = [word() for _ in range(r.randint(5, 120))]
        for _ in range(25):
            if r.random() < 0.5:
                text = list(text)
            copy = text if r.random() < 0.5 else list(text)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([*(word() for _ in range(r.randint(1, 60))), *shared]) for _ in range(60)]
    return list(enumerate(texts))


@pytest.mark.parametrize("often", [8, 1])
def test_all_similar_pairs_are_linked(spark, docs, rows, none, monkeypatch, often):
    monkeypatch.setattr(similar, "OFTEN", often)
    made = edited(often)
    for given, df in ((made, spark.createDataFrame(made, "doc_id long, text string")), (rows, docs)):
        got = similar.near_groups(df).select("doc", "component").collect()
        assert sort(got) == sort((brute.FAR if d is None else d, c) for (d, _), c in zip(given, brute.groups(given), strict=True))
    assert similar.near_groups(none).collect() == []


def test_pipeline_stage_drops_near_copies_beyond_two_bits(spark):
    """Documents 1 and 177, 6 and 145 are more than two bits apart and of similarity 0.8 or more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {d for (d, _), c in zip(given, brute.groups(given), strict=True) if d == c}
    assert not ids & {145, 177}


def test_one_row_of_each_group_stays(spark, docs, rows):
    """Also where rows repeat the kept id, or no row has one."""
    text = "some words that are the same in all of these rows"
    given = [(5, text, "a"), (5, text, "b"), (5, text, "b"), (5, text.upper(), "c"), (6, text, "d"), (None, "no id here", "e"), (None, "no id here", "f"), (7, "alone", "g")]
    kept = similar.drop_near_copies(spark.createDataFrame(given, "doc_id long, text string, `row` string"))
    assert sort((r.doc_id, r.text.lower()) for r in kept.collect()) == sort([(5, text), (None, "no id here"), (7, "alone")])
    kept = similar.drop_near_copies(docs)
    assert kept.columns == docs.columns and sort((r.doc_id,) for r in kept.collect()) == sort((None if c == brute.FAR else c,) for c in set(brute.groups(rows)))


def test_parities_of_different_lengths(spark):
    """Sets of up to and over 512 shingles are compared by parities of different lengths."""
    words = [f"w{i}" for i in range(560)]
    given = [(1, " ".join(words[:500])), (2, " ".join(words[:540])), (3, " ".join(words[60:] + words[:30]))]
    got = similar.near_groups(spark.createDataFrame(given, "doc_id long, text string")).select("doc", "component").collect()
    assert sort(got) == sort(zip((1, 2, 3), brute.groups(given), strict=True))


def test_a_group_of_near_copies_is_not_paired_off(spark, monkeypatch):
    """Texts edited in up to ten words, one text in the middle; the pairs compared grew with the square of the group."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    middle, given = [word() for _ in range(150)], []
    for i in range(300):
        copy = list(middle)
        for _ in range(r.randint(0, 10) if i else 0):
            copy[r.randrange(len(copy))] = word()
        given.append((i, " ".join(copy)))
    possible, made = similar.possible, []

    def counted(pairs, about, similarity):
        made.append(pairs.count())
        return possible(pairs, about, similarity)

    monkeypatch.setattr(similar, "possible", counted)
    monkeypatch.setattr(similar, "OFTEN", 4)
    got = similar.near_groups(spark.createDataFrame(given, "doc_id long, text string")).select("doc", "component").collect()
    assert sort(got) == sort((d, c) for (d, _), c in zip(given, brute.groups(given), strict=True))
    assert sum(made) < 12 * len(given), made
