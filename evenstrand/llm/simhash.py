"""SimHash near-dedup: 64-bit fingerprints linked at two or fewer differing bits.

A fingerprint is cut into two 32-bit segments; of two fingerprints that differ in at
most two bits, one segment differs in at most one.  Each distinct fingerprint is
indexed under the 64 variants of its segments with one bit left out, variants are
equality-joined, and the distance is verified.  Components come from star
contraction over the links, a table per round.

Buckets of up to COLD fingerprints are joined as they stand.  Fingerprints of a larger
bucket (a large group of near copies) are indexed under their 2016 variants with two
bits left out: such a bucket holds at most four fingerprints and every link is found,
so no group is ever paired off in full.

Texts without words have fingerprint zero and are linked like any other; null texts
have no words.  Rows repeating an id are separate documents; a null id counts as the
largest and stays null.  Other columns pass through unread.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.llm import repeats, scratch
from evenstrand.ship import ship

SHINGLE = 3
DISTANCE = 2
COLD = 64
#: Links up to which a round of components() is one job, and the files it writes then; the result is the same.
FEW_EDGES, FILES = 1 << 20, 8
#: Shingle hashes counted at once.
SLICE = 1 << 15


def words_of(text: Column) -> Column:
    """The words of the text, A-Z lower-cased."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc (id, null as the largest), tkey (a hash of the text) and fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    words = docs.select(repeats.doc_key(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc", F.xxhash64("text").alias("tkey"), words_of(F.col("text")).alias("words"))
    each = F.transform(F.sequence(F.lit(0), F.size("words") - shingle), lambda i: F.xxhash64(F.concat_ws(" ", *(F.col("words")[i + j] for j in range(shingle)))))
    hashes = F.when(F.size("words") >= shingle, each).when(F.size("words") > 0, F.array(F.xxhash64(F.concat_ws(" ", "words")))).otherwise(F.array().cast("array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tkey"), pa.array(majority(batch.column("hashes")))], ["doc", "tkey", "fp"])

    return words.select("doc", "tkey", hashes.alias("hashes")).mapInArrow(run, "doc long, tkey long, fp long")


def majority(lists: pa.ListArray) -> np.ndarray:
    """For each list of hashes the number whose bits are those set in over half of them."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    out = np.zeros(len(lists), np.uint64)
    at = 0
    for i, n in enumerate(pc.list_value_length(lists).to_pylist()):
        if n:
            total = np.zeros(64, np.int64)
            for begin in range(at, at + n, SLICE):
                some = np.ascontiguousarray(flat[begin : min(begin + SLICE, at + n)]).view(np.uint8).reshape(-1, 8)
                total += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]
            at += n
    return out.view(np.int64)


def links(fps: DataFrame) -> DataFrame:
    """Links a < b that connect whatever lies within DISTANCE of each other. fps: distinct fp."""
    low = F.lit(0xFFFFFFFF)
    segment = F.when(F.col("j") < 32, F.col("fp").bitwiseAND(low)).otherwise(F.shiftrightunsigned("fp", 32))
    clear = F.bitwise_not(F.expr("shiftleft(1L, cast(j % 32 AS int))"))
    spark = fps.sparkSession
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j")).select("fp", F.expr("shiftleft(cast(j AS long), 32)").bitwiseOR(segment.bitwiseAND(clear)).alias("key"))
    dealt = variants.repartition(scratch.partitions(spark), "key")  # one exchange serves the count and the join
    often = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.table(dealt.join(often.hint("shuffle_hash"), "key"), "members")
    cold = members.where(F.col("n") <= COLD).select("key", "fp")
    near = cold.alias("x").join(cold.alias("y"), F.expr("x.key = y.key AND x.fp < y.fp")).where(F.expr(f"bit_count(x.fp ^ y.fp) <= {DISTANCE}")).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    hot = members.where(F.col("n") > COLD).select("fp").distinct()
    pairs = F.expr("explode(flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> i * 64 + j)))) AS ij")
    masked = F.expr("fp & ~(shiftleft(1L, cast(ij div 64 AS int)) | shiftleft(1L, cast(ij % 64 AS int)))")
    four = hot.select("fp", pairs).groupBy("ij", masked.alias("rest")).agg(F.collect_list("fp").alias("some")).where(F.size("some") > 1)  # four at most
    dense = four.select(F.array_min("some").alias("a"), F.explode("some").alias("b")).where("a < b")
    return near.union(dense).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b) but the roots: root is the component's least node. Alternating star contraction."""
    edges = scratch.table(edges, "edges")
    n, before = edges.count(), None
    while True:
        few, done = n <= FEW_EDGES, [edges]

        def step(df: DataFrame, name: str) -> DataFrame:  # tables let Spark split a hot node's partition
            if not few:
                done.append(df := scratch.table(df, name))
            return df

        both = edges.union(edges.select("b", "a"))
        least = step(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")), "large")
        large = both.join(least, both.a == least.node).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = step(large, "large_edges")
        least = step(large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("node"), "m"), "small")
        small = large.join(least, large.b == least.node)
        less = small.select(F.col("m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        edges = scratch.table(less.coalesce(FILES) if few else less, "small_edges")
        for df in done:
            scratch.drop(df)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        n, before = now.n, now


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc, tkey, fp, component (the smallest doc that links reach)."""
    marked = scratch.table(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = scratch.table(marked.groupBy("fp").agg(F.min("doc").alias("lead")), "distinct")
    roots = scratch.table(components(links(fps.select("fp"))), "roots")
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("lead").alias("component"))
    of_fp = scratch.table(rooted.join(first, "root").select("fp", "component"), "components")
    return marked.join(of_fp, "fp").select("doc", "tkey", "fp", "component")


def hex16(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, same columns, with one document of each group: its smallest id.

    Of rows that repeat the kept id, all stay: they are one document to this operator.
    """
    gone = near_groups(docs, id_col, text_col).where("doc <> component").select(F.col("doc").alias("__doc"), F.col("tkey").alias("__tkey")).distinct()
    same = (repeats.doc_key(id_col) == F.col("__doc")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__tkey"))
    return docs.join(gone, same, "left_anti")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(repeats.id_of().alias("doc_id"), hex16().alias("fingerprint"), repeats.id_of("component").alias("component_id"))
