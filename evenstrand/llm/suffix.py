"""Suffix-array dedup: bytes of repeated strings removed, found by deep-shallow suffix sorting.

Every byte covered by a `span`-byte string that also starts anywhere else, in the same
document or another, is removed; matches never cross documents.  Winnowed byte anchors
(see repeats) leave the suffixes that can repeat.  Equal stretches under one anchor go
in once, with their number of copies; all suffixes of all of them are sorted:

- shallow: a multikey sort on 8-byte characters orders all groups at once to DEPTH bytes;
- deep: groups that still agree go into blind tries.  Each group's first suffix is the
  trie's leading path; the others hang off it at the first bit where they differ, and
  those that leave at the same bit form the next level's group.

Suffixes are compared over their first `span` bytes; neighbours that agree so far, and
suffixes of more than one copy, are repeats.

Ids are whole numbers (2**63 - 1 stands for null).  Null and empty texts have no bytes.
Rows repeating an id are separate documents, and equal rows repeat each other.  Texts
under `span` bytes never lose any; long texts are worked on in pieces.  An empty table
gives no rows.  Other columns, also of the names used here, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstrand.llm import repeats, scratch

SPAN = 200
GRAM = 64
#: Bytes that the multikey sort looks at before the blind tries take over.
DEPTH = 32


def characters(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(8):
        out |= padded[i : i + len(data)] << np.uint64(56 - 8 * i)
    return out


def _bit_length(x: np.ndarray) -> np.ndarray:
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int64)


def _heads(group: np.ndarray) -> np.ndarray:
    return np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)


def deep_shallow_sort(data: np.ndarray, suffixes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by their first `span` bytes, and for each in that order the number of its run of equals."""
    n = len(suffixes)
    chars, words = characters(data), -(-span // 8)
    tail = np.uint64((~((1 << (8 * (8 * words - span))) - 1)) & 0xFFFFFFFFFFFFFFFF)

    def char(at: np.ndarray, depth: int) -> np.ndarray:
        where = suffixes[at] + 8 * depth
        got = np.where(where < len(chars), chars[np.minimum(where, len(chars) - 1)], np.uint64(0)) if len(chars) else np.zeros(len(at), np.uint64)
        return got & tail if depth == words - 1 else got

    order, group = np.arange(n), np.zeros(n, np.int64)
    shallow = min(DEPTH // 8, words)
    for depth in range(shallow):  # multikey: only members of groups over one are compared on
        head = _heads(group)
        size = np.diff(np.append(np.flatnonzero(head), n))
        live = np.flatnonzero(np.repeat(size > 1, size))
        if not len(live):
            break
        key = char(order[live], depth)
        by = np.lexsort((key, group[live]))
        order[live] = order[live][by]
        split = np.zeros(n, bool)
        key = key[by]
        split[live[1:]] = key[1:] != key[:-1]
        group = np.cumsum(_heads(group) | split) - 1
    leaf = np.zeros(n, bool)  # starts of runs of equal suffixes
    leaf[np.flatnonzero(_heads(group))] = True
    # slots lo..hi of `order` hold a group; depth: 8-byte characters known to agree
    head = np.flatnonzero(_heads(group))
    size = np.diff(np.append(head, n))
    slots = np.flatnonzero(np.repeat(size > 1, size))
    gid = np.repeat(np.arange(len(head)), size)[slots] if len(slots) else slots
    known = np.full(len(slots), shallow, np.int64)
    while len(slots):  # one level of all blind tries
        members = order[slots]
        first = _heads(gid)
        leader = members[np.flatnonzero(first)][np.cumsum(first) - 1]
        lcp = np.full(len(slots), 64 * words, np.int64)  # in bits
        below = np.zeros(len(slots), bool)
        live = np.flatnonzero(~first)
        for depth in range(int(known.min()), words):
            if not len(live):
                break
            now = live[known[live] <= depth]
            if not len(now):
                continue
            mine, its = char(members[now], depth), char(leader[now], depth)
            differ = mine != its
            gone = now[differ]
            lcp[gone] = 64 * depth + 64 - _bit_length(mine[differ] ^ its[differ])
            below[gone] = mine[differ] < its[differ]
            keep = np.ones(len(live), bool)
            keep[np.searchsorted(live, gone)] = False
            live = live[keep]
        same = lcp == 64 * words
        side = np.where(same, 1, np.where(below, 0, 2))
        rank = np.where(side == 0, lcp, np.where(side == 2, -lcp, 0))
        by = np.lexsort((rank, side, gid))
        order[slots] = members[by]
        gid, lcp, same, rank, side = gid[by], lcp[by], same[by], rank[by], side[by]
        new = np.append(True, (gid[1:] != gid[:-1]) | (side[1:] != side[:-1]) | (rank[1:] != rank[:-1]))
        leaf[slots[new]] = True
        sub = np.cumsum(new) - 1
        size = np.bincount(sub)
        on = ~same & (size[sub] > 1)
        slots, gid, known = slots[on], sub[on], lcp[on] // 64
    return order, np.cumsum(leaf) - 1


def _repeated(rows: pa.Table, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans of rows that more than one suffix begins with, counting a row's n copies."""
    cut = rows["spans"].combine_chunks()
    lengths = pc.binary_length(cut).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(cut.to_pylist()), np.uint8)
    many = lengths - span + 1
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    suffixes = np.repeat(np.cumsum(lengths) - lengths, many) + place
    copies = rows["n"].to_numpy()
    order, run = deep_shallow_sort(data, suffixes, span)
    total = np.zeros(int(run[-1]) + 1 if len(run) else 0, np.int64)
    np.add.at(total, run, copies[row[order]])
    marked = np.sort(order[total[run] > 1]) if len(order) else order
    return row[marked], rows["begin"].to_numpy().astype(np.int64)[row[marked]] + place[marked]


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed byte ranges, maximal), kept (the bytes left, which may split a character)."""
    texts = repeats.keyed(docs, id_col, text_col).repartition(scratch.partitions(docs.sparkSession), *repeats.KEY)
    found = scratch.table(repeats.occurrences(repeats.keyed(docs, id_col, text_col), "byte", gram, span), "anchors")
    rows = scratch.table(repeats.shared(found), "shared")
    scratch.drop(found)
    marks = repeats.settle(repeats.spans_of(texts, repeats.classes(rows), "byte", span, True), lambda t: repeats.runs(*_repeated(t, span), span))
    ranges = repeats.per_text(rows.join(marks, ["anchor", "stretch"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in repeats.chunks(big):
                n_bytes, n_removed, cuts, kept = [], [], [], []
                for text, (start, end) in zip(repeats.encoded(batch), repeats.as_ranges(batch.column("ranges")), strict=True):
                    n_bytes.append(len(text))
                    n_removed.append(int((end - start).sum()))
                    edges = [0, *np.ravel(np.stack([start, end], 1)).tolist(), len(text)]
                    cuts.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                    ["doc", "n_bytes", "n_removed", "spans", "kept"],
                )

    joined = texts.join(ranges.hint("shuffle_hash"), repeats.KEY, "left").select("doc", "text", "ranges")
    out = joined.mapInArrow(run, "doc long, n_bytes long, n_removed long, spans array<struct<start: int, end: int>>, kept binary")
    return out.select(repeats.id_of().alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    found = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
