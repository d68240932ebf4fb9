"""Repeats across a corpus: winnowed anchors, their join, and the extension of shared anchors.

Shared by substring dedup (words, an earlier document counts) and suffix-array dedup
(bytes, any other place counts).

1. Seed.  Every span of `window` tokens has one winnowed anchor (flat.anchors); a row
   per anchor holds the spans that chose it, as first and last start.
2. Join.  Anchors found once in the corpus are dropped; what follows works on the rest.
3. Classes.  Rows of one anchor whose whole stretch is equal (a 64-bit hash of it under
   a 64-bit anchor) are one class; one row of it stands for all.
4. Extend.  The stretch of each such row is extended by every amount to the left and
   right of the anchor that makes a full span, and `settle` decides these spans among
   those of the same anchor.  Anchors of up to FEW classes are dealt out whole; larger
   ones by block of BLOCK neighbouring starts and the tokens all spans of the block
   share, so a hot anchor spreads over many tasks.
5. What is decided goes back to all rows of the class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.llm import flat, scratch
from evenstrand.ship import ship

#: Neighbouring span starts dealt out together in step 4, for anchors of more than FEW classes.
BLOCK, FEW = 16, 64
#: Bytes of text worked on at once.
CHUNK = 1 << 20

KEY = ["doc", "tkey"]
NO_ID = 2**63 - 1


def tokens(texts: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Token values of the texts end to end, and each text's offset."""
    if unit == "word":
        return flat.words(texts)
    return flat.BYTE_VALUES[np.frombuffer(b"".join(texts), np.uint8)], np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of about CHUNK bytes of text."""
    sizes = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column(column).cast(pa.large_string())).to_pylist()]) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + CHUNK, "right")))
        yield batch.slice(at, end - at)
        at = end


def encoded(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [(t or "").encode() for t in batch.column(column).to_pylist()]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text and a hash of the text: rows that repeat an id with another text stay apart.  A null id counts as the largest."""
    return docs.select(doc_key(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))


def doc_key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def id_of(doc: str = "doc") -> Column:
    return F.nullif(F.col(doc), F.lit(NO_ID))


def occurrences(base: DataFrame, unit: str, k: int, window: int) -> DataFrame:
    """A row per anchor of each text: anchor, stretch, doc, tkey, place (first, last and at in one long: see unpacked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                values, offsets = tokens(encoded(batch), unit)
                found = flat.anchors(values, offsets, k, window)
                text = pa.array(found["text"])
                yield pa.RecordBatch.from_arrays([pa.array(found["anchor"]), pa.array(found["stretch"]), batch.column("doc").take(text), batch.column("tkey").take(text), pa.array(found["first"] << 32 | (found["last"] - found["first"]) << 16 | (found["at"] - found["first"]))], ["anchor", "stretch", "doc", "tkey", "place"])

    if window >= 1 << 16:
        raise ValueError("spans of 65,536 tokens or more are not supported")
    ship(base.sparkSession)
    return base.mapInArrow(run, "anchor long, stretch long, doc long, tkey long, place long")


def unpacked(rows: DataFrame) -> DataFrame:
    """rows with place as first, last, at; packed, rows take less room in the shuffles before."""
    first = F.shiftright("place", 32)
    part = lambda n: F.shiftright("place", n).bitwiseAND(F.lit(0xFFFF)) if n else F.col("place").bitwiseAND(F.lit(0xFFFF))
    return rows.withColumns({"first": first.cast("int"), "last": (first + part(16)).cast("int"), "at": (first + part(0)).cast("int")}).drop("place")


def shared(found: DataFrame) -> DataFrame:
    """Rows whose anchor has at least two rows."""
    often = scratch.table(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")  # a table: Spark can then split a hot anchor's partition
    return found.join(often, "anchor", "left_semi")


def classes(rows: DataFrame) -> DataFrame:
    """A table of the classes of rows: anchor, stretch, the least (doc, tkey, place), n (rows) and m (classes of the anchor)."""
    found = scratch.table(rows.groupBy("anchor", "stretch").agg(F.min(F.struct(*KEY, "place")).alias("c"), F.count("*").alias("n")).select("anchor", "stretch", "c.*", "n"), "classes")
    many = scratch.table(found.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "several")
    return found.join(many, "anchor", "left").withColumn("m", F.coalesce("m", F.lit(1)))


def spans_of(texts: DataFrame, chosen: DataFrame, unit: str, window: int, with_bytes: bool) -> DataFrame:
    """Step 4's spans: a row per class and block, with the hashes (or, for bytes, the text) of its spans.

    texts: doc, tkey, text, dealt by doc and tkey.  chosen: rows of classes.  begin counts from the stretch's first token.
    """
    bundled = unpacked(chosen).groupBy(*KEY).agg(F.collect_set(F.struct("first", "last", "at", "anchor", "stretch", "n", "m")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                yield from deal(batch)

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = encoded(batch)
        values, offsets = tokens(texts, unit)
        spans = flat.Spans(values)
        bundles = batch.column("rows")
        flat_rows = bundles.flatten()
        text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(bundles).to_numpy(zero_copy_only=False))
        first, last, at = (flat_rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        anchor, stretch, n, m = (flat_rows.field(i).to_numpy(zero_copy_only=False) for i in range(3, 7))
        # blocks of starts, counted back from the anchor
        hot, size = m > FEW, min(BLOCK, window)
        low, high = np.where(hot, (at - last) // size, 0), np.where(hot, (at - first) // size, 0)
        count = high - low + 1
        row = np.repeat(np.arange(len(text)), count)
        block = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.where(hot[row], np.maximum(first[row], at[row] - (block + 1) * size + 1), first[row])
        end = np.where(hot[row], np.minimum(last[row], at[row] - block * size), last[row])
        base = offsets[text[row]]
        inner = np.where(hot[row], at[row] - block * size, 0)  # of a block's spans, the part that all share
        core = np.where(hot[row], spans.hash(base + inner, base + np.where(hot[row], inner - size + 1 + window, 0)), np.uint64(0))
        key = flat.mix(anchor[row].view(np.uint64) + flat.mix(core) * np.uint64(flat.BASE) + block.astype(np.uint64)).view(np.int64)
        columns = [pa.array(key), batch.column("doc").take(pa.array(text[row])), pa.array(anchor[row]), pa.array(stretch[row]), pa.array((begin - first[row]).astype(np.int32)), pa.array(n[row])]
        if with_bytes:
            cut = pa.array([texts[t][b : e + window] for t, b, e in zip(text[row].tolist(), begin.tolist(), (end).tolist(), strict=True)], pa.binary())
        else:
            many = end - begin + 1
            owner = np.repeat(np.arange(len(row)), many)
            start = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + base[owner]
            cut = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(spans.hash(start, start + window).view(np.int64)))
        most = 20_000
        out = pa.RecordBatch.from_arrays([*columns, cut], ["key", "doc", "anchor", "stretch", "begin", "n", "spans"])
        for i in range(0, out.num_rows, most):
            yield out.slice(i, most)

    kind = "binary" if with_bytes else "array<long>"
    return texts.join(bundled.hint("shuffle_hash"), KEY).select(*KEY, "text", "rows").mapInArrow(run, f"key long, doc long, anchor long, stretch long, begin int, n long, spans {kind}")


def settle(spans: DataFrame, decide: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """Per class (anchor, stretch) the set `marks` of ranges (start, end) of the spans that `decide` marks, counted from the stretch's first token.

    decide: gets the rows of whole keys; gives row numbers, span starts and span ends of ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:  # rows come sorted by key; a group of keys is worked on once the next one begins
            keys = batch.column("key").to_numpy()
            if size > 8 * CHUNK and kept and keys[0] != kept[-1].column("key")[-1].as_py():
                yield from ranges(kept)
                kept, size = [], 0
            elif size > 8 * CHUNK:
                cut = int(np.searchsorted(keys, keys[0], "right"))
                if cut < len(keys):
                    yield from ranges([*kept, batch.slice(0, cut)])
                    kept, size, batch = [], 0, batch.slice(cut)
            kept.append(batch)
            size += batch.nbytes
        if kept:
            yield from ranges(kept)

    def ranges(kept: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(kept).combine_chunks()
        row, start, end = decide(rows)
        who = pa.array(row)
        yield from pa.table({"anchor": rows["anchor"].take(who), "stretch": rows["stretch"].take(who), "start": pa.array(start.astype(np.int32)), "end": pa.array(end.astype(np.int32))}).to_batches()

    dealt = spans.repartition(scratch.partitions(spans.sparkSession), "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(run, "anchor long, stretch long, start int, end int")
    return scratch.table(found.groupBy("anchor", "stretch").agg(F.collect_set(F.struct("start", "end")).alias("marks")), "marks")


def runs(row: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marked span starts, sorted by row and start, as ranges of tokens."""
    if not len(row):
        return row, start, start
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1))
    head = np.flatnonzero(new)
    return row[head], start[head], start[np.append(head[1:], len(row)) - 1] + window


def per_text(placed: DataFrame) -> DataFrame:
    """One row per text: the set of its ranges. placed: doc, tkey, place and the marks of the row's class."""
    first = F.shiftright("place", 32).cast("int")
    ranges = placed.select(*KEY, F.explode(F.transform("marks", lambda x: F.struct((first + x["start"]).alias("start"), (first + x["end"]).alias("end")))).alias("x")).select(*KEY, "x.*")
    return ranges.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def as_ranges(rows: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The joined ranges of each text of a batch; a text without any has none."""
    flat_rows, out, at = rows.flatten(), [], 0
    start, end = (flat_rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    for n in pc.list_value_length(rows).to_pylist():
        n = n or 0
        out.append(flat.join_ranges(start[at : at + n], end[at : at + n]))
        at += n
    return out
