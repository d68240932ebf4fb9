"""Chat formatting into a prefix tree.

Conversations that begin with the same turns share them: every distinct beginning is a
node, whose text is one formatted turn.  Nodes are emitted once, depth first, into one
stream of tokens.  Each node carries its tokens, their position ids (the place on its
own path, not in the stream) and the stream intervals its tokens may attend to: those of
its ancestors and its own, from where causal attention holds.

Tokens are the code points of the formatted text.  A conversation is read back from the
stream: its last node's intervals say which nodes belong to it, their position ids say
in which order.

Depth-first order is the order of conversations by their chain of node keys: whatever a
conversation shares with the one before has been emitted.  Conversations are dealt by
ranges of that order; only the last chain and the sum of each range go to the driver.

Control strings in roles and texts are broken by a backslash after their first
character; runs of backslashes there grow by one, so that this is reversible.  Null
roles and texts count as empty, turns are ordered by turn (null first), role and text,
and repeated rows are turns of their own.  Conversation ids are whole numbers; each row
of null conv_id is a conversation of its own, so they are no group.  A conversation is
held in memory as a whole, with its texts.  An empty table gives no rows.  Other columns,
also of the names used here, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstrand.llm import scratch
from evenstrand.ship import ship

#: Strings that chat templates use as marks.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, STOP = "<|im_start|>", "<|im_end|>\n"


def _marks() -> str:
    by_first: dict[str, list[str]] = {}
    for c in CONTROL:
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    return "|".join(rf"(?<={re.escape(a)}){{}}(?={'|'.join(rest)})" for a, rest in by_first.items())


_ESCAPE = re.compile(_marks().replace("{}", r"\\*"))
_UNESCAPE = re.compile(_marks().replace("{}", r"\\+"))
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][1:], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + STOP, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    back = {"\\\\": "\\", "\\n": "\n"}
    return [(re.sub(r"\\\\|\\n", lambda m: back[m[0]], unescape(r)), unescape(t)) for r, t in _TURN.findall(formatted)]


def _chain(turns: list[dict]) -> list[bytes]:
    """The key of each beginning of a conversation."""
    keys, key = [], b""
    for t in turns:
        role, text = (t["role"] or "").encode(), (t["text"] or "").encode()
        key = hashlib.sha256(key + len(role).to_bytes(8, "little") + role + text).digest()[:16]
        keys.append(key)
    return keys


def _shared(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Tree:
    """The stream's nodes and each conversation's chain of them."""

    def __init__(self, nodes: DataFrame, chains: DataFrame):
        #: start, n_tokens, depth, role, text (formatted), loss (intervals within the node), tokens, position_ids, attend (stream intervals)
        self.nodes = nodes
        #: key (of the conversation), conv (its id), turn_no, start, n_tokens
        self.chains = chains


def prefix_tree(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Tree:
    spark = turns.sparkSession
    ship(spark)
    conv = F.coalesce(F.col(conv_col).cast("long").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))).alias("conv")
    ordered = turns.select(conv, F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns").to_pylist()
            sizes = [[len(format_turn(t["role"], t["text"])[0]) for t in x] for x in turns]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turns"), pa.array([_chain(x) for x in turns], pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))], ["conv", "turns", "chain", "sizes"])

    turn_type = "array<struct<turn: bigint, role: string, text: string>>"
    keyed = scratch.table(ordered.select("conv", F.col("turns").cast(turn_type)).mapInArrow(chains, f"conv string, turns {turn_type}, chain array<binary>, sizes array<long>"), "chains")
    dealt = keyed.select("conv", "chain", "sizes").repartitionByRange(scratch.partitions(spark), "chain", "conv").sortWithinPartitions("chain", "conv")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, total, before = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            rows = []
            for conv, chain, sizes in zip(batch.column("conv").to_pylist(), batch.column("chain").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                shared = _shared(before, chain)
                rows.append({"conv": conv, "part": part, "at": at, "shared": shared, "offset": total})
                total += sum(sizes[shared:])
                at, before = at + 1, chain
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("shared", pa.int32()), ("offset", pa.int64())]))

    ranks = scratch.table(dealt.mapInArrow(order, "conv string, part int, at long, shared int, offset long"), "order")
    # the first and last conversation of each range: two rows a partition
    ends = ranks.groupBy("part").agg(F.min_by("conv", "at").alias("first"), F.max_by("conv", "at").alias("last"), F.max("at").alias("n"))
    named = ends.select("part", "n", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("first").alias("conv")), F.struct(F.lit(1).alias("e"), F.col("last").alias("conv")))).alias("x")).select("part", "x.*")
    found = {(r.part, r.e): r for r in named.join(keyed, "conv").join(ranks.select("conv", "shared", "offset"), "conv").select("part", "e", "chain", "sizes", "shared", "offset").collect()}
    base, total, before = [], 0, []
    for part in sorted({p for p, _ in found}):
        first, last = found[part, 0], found[part, 1]
        shared = _shared(before, first.chain)
        less = sum(first.sizes[:shared])
        base.append((part, shared, total, less))
        total += last.offset + sum(last.sizes[last.shared :]) - less
        before = last.chain
    bases = spark.createDataFrame(base or [(-1, 0, 0, 0)], "part int, first_shared int, base long, less long")  # one row a partition
    placed = ranks.join(F.broadcast(bases), "part").select("conv", F.when(F.col("at") == 0, F.col("first_shared")).otherwise(F.col("shared")).alias("shared"), (F.col("base") + F.col("offset") - F.when(F.col("at") > 0, F.col("less")).otherwise(0)).alias("offset"))
    placed = scratch.table(placed.join(keyed.select("conv", "chain", "sizes"), "conv"), "placed")
    each = placed.select("conv", "shared", "offset", F.posexplode(F.arrays_zip("chain", "sizes")).alias("turn_no", "x"), "sizes").select("conv", "turn_no", F.col("x.chain").alias("node"), F.col("x.sizes").alias("n_tokens"), "shared", (F.col("offset") + F.expr("aggregate(slice(sizes, shared + 1, greatest(turn_no - shared, 0)), 0L, (a, b) -> a + b)")).alias("start"))
    own = scratch.table(each.where("turn_no >= shared").select("node", "start"), "starts")
    chain_rows = scratch.table(each.select("conv", "turn_no", "node", "n_tokens").join(own, "node").select("conv", "turn_no", "start", "n_tokens"), "chain_rows")
    paths = chain_rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn_no", "start", "n_tokens"))).alias("path"))
    emit = keyed.select("conv", "turns").join(placed.select("conv", "shared"), "conv").join(paths, "conv").where("shared < size(path)")

    list_of = lambda kind: pa.list_(kind)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("start", pa.int64()), ("n_tokens", pa.int64()), ("depth", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("loss", list_of(span)), ("tokens", list_of(pa.int32())), ("position_ids", list_of(pa.int32())), ("attend", list_of(span))])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for turns, shared, path in zip(batch.column("turns").to_pylist(), batch.column("shared").to_pylist(), batch.column("path").to_pylist(), strict=True):
                seen, depth = [], 0
                for no, (turn, at) in enumerate(zip(turns, path, strict=True)):
                    end = at["start"] + at["n_tokens"]
                    if seen and seen[-1]["end"] == at["start"]:
                        seen[-1] = {"start": seen[-1]["start"], "end": end}
                    else:
                        seen.append({"start": at["start"], "end": end})
                    if no >= shared:
                        text, a, b = format_turn(turn["role"], turn["text"])
                        rows.append({"start": at["start"], "n_tokens": len(text), "depth": no, "role": turn["role"], "text": text, "loss": [{"start": a, "end": b}] if turn["role"] == "assistant" else [], "tokens": np.frombuffer(text.encode("utf-32-le"), np.int32), "position_ids": np.arange(depth, depth + len(text), dtype=np.int32), "attend": list(seen)})
                    depth += at["n_tokens"]
                if len(rows) > 500:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    tree = emit.select("turns", "shared", "path").mapInArrow(nodes, "start long, n_tokens long, depth int, role string, text string, loss array<struct<start: long, end: long>>, tokens array<int>, position_ids array<int>, attend array<struct<start: long, end: long>>")
    return Tree(scratch.table(tree, "tree"), chain_rows.select(F.col("conv").alias("key"), F.expr("try_cast(conv AS long)").alias("conv"), "turn_no", "start", "n_tokens"))


def read_back(tree: Tree) -> DataFrame:
    """Per conversation, from the stream's tokens, position ids and intervals: conv_id, formatted, and the texts under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t.values.to_numpy().astype("<i4", copy=False).tobytes().decode("utf-32-le") for t in batch.column("tokens")]
                masked = [[t[x["start"] : x["end"]] for x in spans] for t, spans in zip(texts, batch.column("loss").to_pylist(), strict=True)]
                first = [p[0].as_py() for p in batch.column("position_ids")]
                yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(first, pa.int32()), batch.column("attend"), pa.array(texts, pa.string()), pa.array(masked, pa.list_(pa.string()))], ["start", "position", "attend", "text", "masked"])

    read = tree.nodes.select("start", "position_ids", "attend", "tokens", "loss").mapInArrow(run, "start long, position int, attend array<struct<start: long, end: long>>, text string, masked array<string>")
    rows = tree.chains.select("key", "conv", "start").join(read, "start")
    nodes = F.sort_array(F.collect_list(F.struct("position", "start", "text", "masked")))
    found = rows.groupBy("key").agg(F.first("conv").alias("conv_id"), nodes.alias("nodes"), F.max_by("attend", "position").alias("attend"))
    within = lambda x: F.exists("attend", lambda a: (a["start"] <= x["start"]) & (x["start"] + F.length(x["text"]) <= a["end"]))
    turns = found.select("conv_id", F.filter("nodes", within).alias("x"))
    return turns.select("conv_id", F.concat_ws("", F.col("x.text")).alias("formatted"), F.flatten("x.masked").alias("masked"))


def digests(back: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, masked in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), batch.column("masked").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(map(unescape, masked))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": hashlib.sha256(said.encode()).hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return back.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, x.turn, x.role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(turn, role)")
    return digests(read_back(prefix_tree(turns.unionByName(extra))))
