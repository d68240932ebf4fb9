import brute
from conftest import SF, sort

import corpus_pipeline
from evenstrand.llm import pieces


def slow(docs, items):
    """The pipeline's rows, stage by stage."""
    docs = [(x[0], t) for x, t in brute.op2(docs) if x[-1]]
    docs = [d for d, c in zip(docs, brute.groups(docs), strict=True) if d[0] == c]
    docs = [(i, brute.cut(t, g)) for (i, t), (_, g) in zip(docs, brute.substring_cover(docs, 50), strict=True)]
    docs = [d for d, w in zip(docs, brute.op7(docs, items), strict=True) if not w[-1]]
    return brute.op4(docs, pieces.default_model())


def test_pipeline(spark):
    read = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{n}.parquet").select(*c).collect()]
    want = slow(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sort((r.doc_id, r.n_tokens, brute.sha(bytes(r.ids)), brute.sha(r.text.encode())) for r in got) == sort(want)
    assert 0 < len(want) < 200


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "tkey").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "tkey", "source", "n_chars"]
    assert docs.where("n_chars <> length(text)").count() == 0
