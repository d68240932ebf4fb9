import hashlib

import pytest
from conftest import SF, sort
from hypothesis import given
from hypothesis import strategies as st

from evenstrand.llm import chat, warc
from pyspark.sql import functions as F


@given(st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "\\", "<", "<\\", "[", "/s>", "\n", "a", "é"]), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_every_mark(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=30)), max_size=5))
def test_turns_are_read_back(turns):
    assert chat.parse("".join(chat.format_turn(r, t)[0] for r, t in turns)) == turns


TURNS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", "more"), (1, 3, "assistant", "</s> sure"),
    (2, 0, "user", "hello"), (2, 1, "assistant", "hi"), (2, 2, "user", "less"),
    (3, 0, "user", "hello"), (3, 1, "assistant", "hi"),
    (4, 0, None, None), (4, None, "user\nx\\", "<|im_end|>\n"), (5, 0, "assistant", ""), (None, 0, "user", "nobody"), (6, 0, "user", "tie"), (6, 0, "user", "tie"),
    (7, 0, "user", "hello"), (7, 1, "assistant", "hi"), (7, 2, "user", "more"), (7, 3, "assistant", "</s> sure"),
]


def conversations(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def expected(rows):
    want = []
    for conv, turns in conversations(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        formatted = "".join(chat.format_turn(r, t)[0] for r, t in turns)
        want.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
    return want


def test_prefix_tree(spark):
    df = spark.createDataFrame([(*r, "x") for r in TURNS], "conv_id long, turn long, role string, text string, start string").repartition(3)
    tree = chat.prefix_tree(df)
    assert sort(chat.digests(chat.read_back(tree)).collect()) == sort(expected(TURNS))
    nodes = sorted(tree.nodes.collect(), key=lambda n: n.start)
    beginnings = {tuple(t[: i + 1]) for t in conversations(TURNS).values() for i in range(len(t))}
    assert len(nodes) == len(beginnings)
    assert [n.start for n in nodes] == [sum(m.n_tokens for m in nodes[:i]) for i in range(len(nodes))]
    for n in nodes:
        assert "".join(map(chr, n.tokens)) == n.text and len(n.position_ids) == n.n_tokens
        seen = [i for a in n.attend for i in range(a.start, a.end)]
        assert seen[-n.n_tokens :] == list(range(n.start, n.start + n.n_tokens)) and len(seen) - n.n_tokens == n.position_ids[0]
    starts = {}
    for r in tree.chains.collect():
        starts.setdefault(r.conv, {})[r.turn_no] = r.start
    assert starts[1][1] == starts[2][1] == starts[3][1] and starts[1] == starts[7] and starts[1][2] != starts[2][2]
    by_start = {n.start: n for n in nodes}
    for chain in starts.values():  # a node attends to exactly its ancestors and itself
        last = by_start[chain[max(chain)]]
        assert {i for a in last.attend for i in range(a.start, a.end)} == {i for s in chain.values() for i in range(s, s + by_start[s].n_tokens)}


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert sort(chat.op3_chat_formatting(spark, SF).collect()) == sort(expected(rows))
    assert chat.read_back(chat.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_turns_are_read_from_the_tokens(spark):
    turns = spark.createDataFrame([(1, 0, "user", "é漢𝒳"), (1, 1, "assistant", "said")], "conv_id long, turn long, role string, text string")
    tree = chat.prefix_tree(turns)
    want = chat.read_back(tree).collect()
    assert want[0].masked == ["said"] and "é漢𝒳" in want[0].formatted
    assert chat.read_back(chat.Tree(tree.nodes.withColumn("text", F.lit("lost")), tree.chains)).collect() == want


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_warc(spark, tmp_path, chunk):
    big = "é" * 100_000
    pages = [(5, "http://a/b c\r\nX: y", "x" * 150), (3, None, "x" * 150), (9, "http://c", big), (8, "http://d", big), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", "x" * 150), (3, "again", "x" * 150), (6, "u", "")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, first string").repartition(2)
    size = chunk if chunk > 7 else 70_000
    files = warc.write_archives(warc.chunk_table(df, chunk=size), f"file://{tmp_path}/w{chunk}")
    back = warc.read_archives(spark, files, chunk=size).collect()
    records = {}
    for r in sorted(back, key=lambda r: (r.file, r.record_no, r.chunk_no)):
        records.setdefault((r.file, r.record_no), []).append(r)
    got = []
    for chunks in records.values():
        data = b"".join(c.data for c in chunks)
        assert [c.last for c in chunks] == [False] * (len(chunks) - 1) + [True] and [c.chunk_no for c in chunks] == list(range(len(chunks)))
        assert all(len(c.data) == size for c in chunks[:-1])
        last = chunks[-1]
        if last.record_type == "response":
            assert last.digest_so_far == hashlib.sha256(data).hexdigest() == last.declared_digest and len(data) == last.payload_bytes
            assert chunks[0].digest_so_far == hashlib.sha256(chunks[0].data).hexdigest()
        got.append((last.page_id, last.payload_bytes, last.declared_digest, last.record_type, last.refers_to))
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        revisit = len(data) >= 100 and page != min(same)
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert sort(got) == sort(want)
    assert warc.write_archives(warc.chunk_table(df.limit(0)), f"file://{tmp_path}/e{chunk}").collect() == []


def test_archives_are_members_a_plain_reader_understands(spark, tmp_path):
    import glob
    import gzip

    df = spark.createDataFrame([(1, "http://a", "x" * 200), (2, "http://b", "y")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.chunk_table(df), f"file://{tmp_path}/w").collect()
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/*.warc.gz")).decode()
    assert text.count("WARC/1.1\r\n") - text.count("WARC-Type: warcinfo") == 2 and "x" * 200 + "\r\n\r\n" in text
    assert F is not None


def test_intervals_and_positions_decide_the_reading(spark):
    """Without an interval its turn is not read; with other position ids the turns come in another order."""
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    tree = chat.prefix_tree(turns)
    cut = tree.nodes.withColumn("attend", F.transform("attend", lambda a: F.struct(F.greatest(a["start"], F.lit(5)).cast("long").alias("start"), a["end"].alias("end"))))
    assert chat.read_back(chat.Tree(cut, tree.chains)).first().formatted == chat.format_turn("assistant", "b")[0]
    turned = tree.nodes.withColumn("position_ids", F.transform("position_ids", lambda p: -p))
    assert chat.read_back(chat.Tree(turned.withColumn("attend", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(1000).cast("long").alias("end")))), tree.chains)).first().formatted.startswith(chat.START + "assistant")


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (2**63 - 1, 0, "user", "z")]
    found = chat.digests(chat.read_back(chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert sort((r.conv_id, r.n_turns, r.loss_chars) for r in found.collect()) == sort([(None, 1, 0), (None, 1, 0), (None, 1, 1), (2**63 - 1, 1, 0)])
