import brute
import duckdb
import numpy as np
import pytest
from conftest import SF, sort

from evenstrand.llm import decontaminate, flat, pieces, quality, sharding, simhash, substring, suffix, tokenfile
from pyspark.sql import functions as F


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def real(spark):
    return [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]


def digest1(found):
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()


def digest9(found):
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256)).collect()


def test_substring(spark, docs, rows, none):
    assert sort(digest1(substring.find_repeats(docs))) == sort(brute.op1(rows))
    assert substring.find_repeats(none).collect() == []
    cut = substring.remove_repeats(docs)
    assert cut.columns == docs.columns
    want = [(i, None if t is None else brute.cut(t, g)) for (i, t), (_, g) in zip(rows, brute.substring_cover(rows, 50), strict=True)]
    assert sort(cut.select("doc_id", "text").collect()) == sort(want)


def test_substring_short_spans_and_pieces(spark, docs, rows, monkeypatch):
    assert sort(digest1(substring.find_repeats(docs, span=12, gram=3))) == sort(brute.op1(rows, 12))


def test_suffix(spark, docs, rows, none):
    assert sort(digest9(suffix.find_repeats(docs))) == sort(brute.op9(rows))
    assert sort(digest9(suffix.find_repeats(docs, span=61, gram=20))) == sort(brute.op9(rows, 61))
    assert suffix.find_repeats(none).collect() == []


def test_repeats_on_the_table(spark, real):
    assert sort(substring.op1_substring_dedup(spark, SF).collect()) == sort(brute.op1(real))
    assert sort(suffix.op9_suffix_array_dedup(spark, SF).collect()) == sort(brute.op9(real))


def test_hot_anchors_are_dealt_by_block(spark, docs, rows, monkeypatch):
    from evenstrand.llm import repeats

    monkeypatch.setattr(repeats, "FEW", 1)
    assert sort(digest1(substring.find_repeats(docs, span=12, gram=3))) == sort(brute.op1(rows, 12))
    assert sort(digest9(suffix.find_repeats(docs, span=61, gram=20))) == sort(brute.op9(rows, 61))


@pytest.mark.parametrize("span", [5, 16, 37, 64])
def test_deep_shallow_sort_is_a_sort(span):
    rng = np.random.default_rng(span)
    data = np.concatenate([rng.choice(np.array([0, 97, 98], np.uint8), 300), np.full(120, 97, np.uint8), np.tile(rng.integers(0, 256, 70, np.uint8), 4)])
    suffixes = rng.permutation(len(data) - span + 1)
    order, run = suffix.deep_shallow_sort(data, suffixes, span)
    texts = [data[s : s + span].tobytes() for s in suffixes[order]]
    assert texts == sorted(texts)
    assert [a == b for a, b in zip(texts, texts[1:], strict=False)] == (run[1:] == run[:-1]).tolist()


def test_anchors_in_pieces(monkeypatch):
    """Cutting a long input into pieces loses no span and keeps each under its anchor."""
    rng = np.random.default_rng(2)
    values, offsets = rng.integers(0, 3, 5000).astype(np.uint64) + np.uint64(7), np.array([0, 10, 10, 2600, 5000])
    spans = lambda a: {(int(t), s, int(h)) for t, f, l, h in zip(a["text"], a["first"], a["last"], a["anchor"], strict=True) for s in range(f, l + 1)}  # noqa: E731, E741
    whole = spans(flat.anchors(values, offsets, 5, 40))
    assert len(whole) == 2590 - 39 + 2400 - 39
    monkeypatch.setattr(flat, "PIECE", 333)
    assert spans(flat.anchors(values, offsets, 5, 40)) == whole


def test_words_in_pieces(monkeypatch):
    texts = ["a bb  ccc".encode(), b"", ("x" * 100 + "\x0bé y").encode(), b"bb"]
    whole = flat.words(texts)
    assert whole[1].tolist() == [0, 3, 3, 6, 7] and whole[0][1] == whole[0][6]
    monkeypatch.setattr(flat, "PIECE", 4)
    assert flat.words(texts)[0].tolist() == whole[0].tolist()


def near(found):
    return sort(found.select(F.when(F.col("doc") < 2**63 - 1, F.col("doc")), simhash.hex16(), F.when(F.col("component") < 2**63 - 1, F.col("component"))).collect())


def test_simhash(spark, docs, rows, none, real):
    assert near(simhash.near_groups(docs)) == sort(brute.op8(rows))
    assert near(simhash.near_groups(none)) == []
    assert sort(simhash.op8_simhash_near_dedup(spark, SF).collect()) == sort(brute.op8(real))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sort(kept.select("doc_id", "text").collect()) == sort((i, t) for (i, t), (_, _, c) in zip(rows, brute.op8(rows), strict=True) if i == c)


def test_simhash_hot_buckets(spark, monkeypatch):
    """Dense groups go by two-bit variants and give the same components."""
    import random

    r = random.Random(3)
    centers = [r.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in centers for _ in range(60)}
    signed = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = []
    for cold, few in ((64, 1 << 20), (3, 0)):
        monkeypatch.setattr(simhash, "COLD", cold)
        monkeypatch.setattr(simhash, "FEW_EDGES", few)
        got.append(sort(simhash.components(simhash.links(df)).collect()))
    assert got[0] == got[1] and len(got[0]) > 50
    unsigned = {f: f % 2**64 for f in signed}
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if bin(unsigned[a] ^ unsigned[b]).count("1") <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    linked = {f: find(f) for f in signed}
    assert dict(got[0]) == {f: g for f, g in linked.items() if f != g}


def test_quality(spark, docs, rows, none):
    want = brute.op2(rows)
    found = quality.measure(docs).select("row.doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))
    assert sort(found.collect()) == sort(x for x, _ in want)
    kept = quality.clean(docs)
    assert kept.columns == docs.columns
    assert sort(kept.select("doc_id", "text").collect()) == sort((x[0], t) for x, t in want if x[-1])
    assert quality.clean(none).collect() == []


def test_quality_rules_on_lines(spark):
    lines = ["A sentence stands here.", "no end at all", "Home | About | Contact.", "See our Privacy Policy.", "**bold** %% ## one.", "Er sagte: «Nein.» Dann ging er", "(So?)"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    assert [r[0] for r in df.select(quality.line_passes(F.col("x"))).collect()] == [True, False, False, False, False, True, True] == [brute.op2_line(x) for x in lines]


def test_decontamination(spark, docs, rows, none):
    first = rows[0][1].split()
    items = [(1, " ".join(first[5:30])), (2, "ONE two"), (None, " ".join(first[40:52])), (4, None), (5, "!?"), (6, "na na na"), (7, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    digest = lambda f: f.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256), "contaminated")
    want = brute.op7(rows, items)
    assert sort(digest(decontaminate.judge(docs, bench)).collect()) == sort(want)
    assert digest(decontaminate.judge(none, bench)).collect() == []
    assert digest(decontaminate.judge(docs, bench.limit(0))).where("contaminated").collect() == []
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sort(kept.select("doc_id", "text").collect()) == sort(r for r, w in zip(rows, want, strict=True) if not w[-1])


def test_decontamination_without_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "SMALL", 0)
    items = [(1, rows[0][1])]
    got = decontaminate.judge(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sort(got.select("doc_id", "n_hit").collect()) == sort((w[0], w[2]) for w in brute.op7(rows, items))


@pytest.mark.parametrize("name", ["op2_quality_rules", "op5_warc", "op6_sharding", "op7_benchmark_decontamination"])
def test_query_equals_sql(spark, name):
    from evenstrand.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert got.columns == columns
    assert sort(got.collect()) == sort(want.fetchall())


def test_sharding(spark, docs, none, rows, monkeypatch):
    """Shards fit, only what is too large is split, and deeper directories give the same."""
    out = sharding.assign(docs, 3000).collect()
    assert len(out) == len(rows)
    sums = {}
    for r in out:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
    assert all(sums[r.shard] == r.shard_bytes and (r.shard_bytes <= 3000) == (not r.oversized) for r in out)
    assert all(len({r.row.doc_id for r in out if r.shard == s}) == 1 for s, b in sums.items() if b > 3000)
    parents = {s[:-1] for s in sums if s}
    assert all(sum(b for s, b in sums.items() if s.startswith(p)) > 3000 for p in parents)
    monkeypatch.setattr(sharding, "STEP", 3)
    monkeypatch.setattr(sharding, "SMALL", 0)
    monkeypatch.setattr(sharding.math, "ceil", lambda x: -3)
    assert sort((r.row.doc_id, r.shard, r.shard_bytes) for r in sharding.assign(docs, 3000).collect()) == sort((r.row.doc_id, r.shard, r.shard_bytes) for r in out)
    assert sharding.assign(none, 3000).collect() == []


def test_sentencepiece(spark, docs, rows, none):
    path = pieces.default_model()
    digest = lambda f: f.select("doc_id", F.expr("octet_length(ids) div 4"), F.sha2("ids", 256), F.sha2(F.col("decoded").cast("binary"), 256))
    out = pieces.round_trip(docs, path)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    assert sort(digest(out).collect()) == sort(brute.op4(rows, path))
    assert pieces.round_trip(none, path).collect() == []


def test_sentencepiece_model_on_random_text():
    import random

    import sentencepiece

    path, r = pieces.default_model(), random.Random(9)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Model(path)
    alphabet = [*"abcdefghiklmnorstuvwzAEST  .,'-\n\t▁", "é", "ß", "漢", "☃", "𝒳", "\x00", "́", "ing", "the ", "    ", "aaaa"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000, " " * 700, "\n" * 90]
    ids, offsets = own.encode(texts)
    for i, t in enumerate(texts):
        mine = ids[offsets[i] : offsets[i + 1]].tolist()
        assert mine == lib.encode(t, add_bos=True, add_eos=True), t
    assert own.decode(ids, offsets) == [lib.decode(lib.encode(t, add_bos=True, add_eos=True)) for t in texts]
    odd = [[1, 3 + 0xE2, 3 + 0x98, 2], [3 + 0xFF, 300, 3 + 0xC3], [], [1, 2], [259, 3 + 0x41]]
    assert own.decode(np.array([i for x in odd for i in x]), np.concatenate([[0], np.cumsum([len(x) for x in odd])])) == [lib.decode(x) for x in odd]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31])
def test_bit_packing(bits, tmp_path):
    rng = np.random.default_rng(bits)
    lists = [rng.integers(0, 1 << bits, n).astype(np.uint32) for n in (0, 5, 300, 1, 77)]
    with open(tmp_path / "x", "wb") as sink:
        w = tokenfile.Writer(sink, bits, block=64)
        for i, x in enumerate(lists):
            w.add(None if i == 3 else i, x)
        w.close()
    with open(tmp_path / "x", "rb") as source:
        r = tokenfile.Reader(source)
        whole = np.concatenate(lists)
        assert r.tokens(0, len(whole)).tolist() == whole.tolist() and r.nulls.tolist() == [False, False, False, True, False]
        for a, b in ((0, 1), (63, 65), (100, 380), (382, 383), (7, 7)):
            assert r.tokens(a, b).tolist() == whole[a:b].tolist()
    with pytest.raises(ValueError, match="bits"):
        tokenfile.Writer(open(tmp_path / "y", "wb"), bits).add(1, np.array([1 << bits], np.uint64))


def test_token_shards(spark, docs, rows, none, tmp_path):
    path = tokenfile.default_vocabulary()

    def back(df, name):
        shards = tokenfile.write_shards(df, f"file://{tmp_path}/{name}", path, end=1)
        return tokenfile.read_shards(spark, shards).select("doc_id", "start", F.expr("octet_length(ids) div 4"), F.crc32("ids")).collect()

    assert sort(back(docs, "a")) == sort(brute.op10(rows, path))
    assert back(none, "b") == []


def test_words_have_the_library_s_ids():
    """Words cut and merged here, words left to the library, and added tokens within words."""
    import random

    from tokenizers import Tokenizer

    path = tokenfile.default_vocabulary()
    lib, words, r = Tokenizer.from_file(path), tokenfile.WordEncoder(path), random.Random(4)
    assert words.parts is not None
    near = [chr(c) for c in range(0x250)] + ["'s", "'ll", "'t", "<|endoftext|>", "ing", "the", "漢", "\u0301", "Σ", "İ", "ß"]
    made = ["".join(r.choice(near if r.random() < 0.5 else near[32:127]) for _ in range(r.randint(1, 14))) for _ in range(20_000)]
    ids, offsets = words.encode([w.encode() for w in made], 1)
    assert [ids[a : b - 1].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [e.ids for e in lib.encode_batch(made, add_special_tokens=False)]


def test_other_vocabularies_go_to_the_library():
    import public_tokenizers

    words = tokenfile.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert words.parts is None and not words.by_word


def test_id_queries_on_the_table(spark, real):
    assert sort(pieces.op4_sentencepiece(spark, SF).collect()) == sort(brute.op4(real, pieces.default_model()))
    assert sort(tokenfile.op10_token_file(spark, SF).collect()) == sort(brute.op10(real, tokenfile.default_vocabulary()))
