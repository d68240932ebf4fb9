"""Substring dedup: seed and extend over winnowed word anchors.

A run of `span` words or more that also occurs in a document with a smaller id is
removed from the later document; what counts is the input, not what is left of it.
Shared anchors are extended by every amount to the left and right that makes a span of
`span` words, spans are compared by 64-bit hashes under a 64-bit anchor, and spans that
touch are joined to maximal runs: see repeats for the seeds, their join and the extension.

Ids are whole numbers (2**63 - 1 stands for null).  Null texts have no words.  Rows with
a null id come after all others and are never an earlier document for each other.  Rows
repeating an id are judged each by itself.  Texts under `span` words never lose any; long
texts are worked on in pieces.  An empty table gives no rows.  Other columns, also of the
names used here, pass through unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenstrand.llm import repeats, scratch

SPAN = 50
GRAM = 10
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _earlier(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The spans that also stand in a row of a smaller doc under the same key."""
    spans = rows["spans"].combine_chunks()
    many = pc.list_value_length(spans).to_numpy()
    row = np.repeat(np.arange(len(many)), many)
    start = rows["begin"].to_numpy().astype(np.int64)[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    key, doc, span = rows["key"].to_numpy()[row], rows["doc"].to_numpy()[row], spans.flatten().to_numpy()
    order = np.lexsort((doc, span, key))
    key, span = key[order], span[order]
    new = np.append(True, (key[1:] != key[:-1]) | (span[1:] != span[:-1])) if len(order) else np.zeros(0, bool)
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc
    marked = np.sort(order[doc[order] > least])
    return row[marked], start[marked]


def repeat_ranges(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """doc, tkey and the word ranges that stand in an earlier document."""
    found = scratch.table(repeats.occurrences(repeats.keyed(docs, id_col, text_col), "word", gram, span), "anchors")
    rows = scratch.table(repeats.shared(found), "shared")
    scratch.drop(found)
    chosen = repeats.classes(rows)
    marks = repeats.settle(repeats.spans_of(texts, chosen.where("m > 1"), "word", span, False), lambda t: repeats.runs(*_earlier(t), span))
    info = scratch.table(chosen.where("n > 1 or m > 1").select("anchor", "stretch", F.col("doc").alias("lead")).join(marks, ["anchor", "stretch"], "left"), "info")
    # rows of the class's first document keep to its marks; in later ones the whole stretch is a repeat
    length = F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF)).cast("int") + span
    whole = F.array(F.struct(F.lit(0).alias("start"), length.alias("end")))
    placed = rows.join(info, ["anchor", "stretch"]).withColumn("marks", F.when(F.col("doc") > F.col("lead"), whole).otherwise(F.col("marks"))).where("marks IS NOT NULL")
    return repeats.per_text(placed)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (removed word ranges), kept (the kept words, joined by a space)."""
    texts = repeats.keyed(docs, id_col, text_col).repartition(scratch.partitions(docs.sparkSession), *repeats.KEY)
    ranges = repeat_ranges(docs, texts, id_col, text_col, span, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in repeats.chunks(whole):
                n_words, n_removed, spans, kept = [], [], [], []
                for text, (start, end) in zip(repeats.encoded(batch), repeats.as_ranges(batch.column("ranges")), strict=True):
                    words = text.split()  # bytes: splits at exactly the six separators
                    n_words.append(len(words))
                    n_removed.append(int((end - start).sum()))
                    spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                    for a, b in zip(start.tolist()[::-1], end.tolist()[::-1], strict=True):
                        del words[a:b]
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
                    ["doc", "n_words", "n_removed", "spans", "kept"],
                )

    joined = texts.join(ranges.hint("shuffle_hash"), repeats.KEY, "left").select("doc", "text", "ranges")
    out = joined.mapInArrow(run, "doc long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept string")
    return out.select(repeats.id_of().alias("doc_id"), "n_words", "n_removed", "spans", "kept")


def cut_words(text: str, start: np.ndarray, end: np.ndarray) -> str:
    """The text without the given word ranges; what stands between kept words stays as it is."""
    if not len(start):
        return text
    data = text.encode()
    at = [m.start() for m in WORD.finditer(data)] + [len(data)]
    out, done = [], 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        out.append(data[done : at[a]])
        done = at[b]
    return b"".join([*out, data[done:]]).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """docs, same columns, with repeated words cut from the text; a text that is all repeats becomes empty, a null stays null."""
    n = scratch.partitions(docs.sparkSession)
    ranges = repeat_ranges(docs, repeats.keyed(docs, id_col, text_col).repartition(n, *repeats.KEY), id_col, text_col, span, gram)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*others).alias("others"), repeats.doc_key(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tkey"), F.col(text_col).alias("text"))
    joined = packed.join(ranges.hint("shuffle_hash"), repeats.KEY, "left").select("others", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in repeats.chunks(whole):
                cut = [None if t is None else cut_words(t, *r) for t, r in zip(batch.column("text").to_pylist(), repeats.as_ranges(batch.column("ranges")), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("others"), pa.array(cut, pa.string())], ["others", "text"])

    out = joined.mapInArrow(run, T.StructType([joined.schema["others"], T.StructField("text", T.StringType())]))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"others.`{c}`") for c in docs.columns))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
