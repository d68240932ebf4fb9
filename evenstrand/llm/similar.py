"""SimHash near-dedup by similarity: all documents of Jaccard similarity SIMILARITY or more are linked.

A text is the set of its runs of SHINGLE words, A-Z lower-cased (shorter texts are one
run); texts of one set are one node.

First the SimHash fingerprints of the sets are joined by deletion variants (see simhash);
nodes of one fingerprint, or of two that differ in few bits, are compared by their sets.
A fingerprint of 64 bits can't go further: at similarity 0.8 about ten bits differ.  The
rest is found exactly.  Sets are put in one order for all, shingles that a sample finds
in many texts last.  Of two sets of similarity p/q or more, with n shingles in the one,
the first n - ceil(n p/q) + 1 of each share one (prefix filter), so nodes that share none
are never compared.  Buckets are of one shingle and two neighbouring classes of size, and
nodes meet only where the shingle can be the first they share: i + j shingles before it
are in one set only, of at most (q - p)/(q + p) of both sets' shingles in similar sets.

Only components are asked for, so groups are not paired off: for some rounds each node
is compared with one chosen of its buckets, and what is left at the end are pairs of a
bucket's nodes that are still in different components.  All of those are compared: no
pair is left out that could join two components.

Whole sets are made again from the texts of the few nodes that sizes and parities leave;
only the first shingles of all are stored.

Null texts and texts without words are one node of no shingles.  A null id counts as the
largest.  Other columns, also of the names used here, pass through unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.llm import flat, repeats, scratch, simhash
from evenstrand.ship import ship

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
#: A text in SAMPLE is looked at for shingles of many texts, those in OFTEN of them; the HOT most frequent go last. For speed alone.
SAMPLE, OFTEN, HOT = 16, 8, 100_000
#: Bits of a set's parity, at least.
BITS = 512
KEY = repeats.KEY
#: Rounds of comparing with one node of a bucket, at most, and the pairs a bucket's row may cost before another is made. One after which half the pairs or more are left is the last but one: rounds save pairs, and these saved too few.
ROUNDS, FEW = 6, 16


def sets(texts: list[bytes], shingle: int, hot: np.ndarray, hot_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle hashes of the texts, each text's distinct and in order; their offsets by text; a key of each set."""
    values, at = flat.words([t.lower() for t in texts])
    n = np.diff(at)
    spans = flat.Spans(values)
    owner = np.repeat(np.arange(len(texts)), n)
    start = np.arange(len(values))
    whole = start + shingle <= at[1:][owner]
    short = np.flatnonzero((n > 0) & (n < shingle))
    start, owner = np.append(start[whole], at[:-1][short]), np.append(owner[whole], short)
    found = spans.hash(start, np.minimum(start + shingle, at[1:][owner]))
    rank = np.zeros(len(found), np.int64)
    if len(hot):
        i = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        rank = np.where(hot[i] == found, hot_rank[i], 0)
    order = np.lexsort((found, rank, owner))
    found, owner = found[order], owner[order]
    new = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])) if len(found) else np.zeros(0, bool)
    found, owner = found[new], owner[new]
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.mix(found), dtype=np.uint64)])
    return found, offsets, flat.mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def parities(found: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """Per set BITS bits, or the next power of two from its size on: each set where an odd number of its shingles falls on it."""
    n = np.diff(offsets)
    bits = BITS << np.ceil(np.log2(np.maximum(n, BITS) / BITS)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(bits)])
    at, times = np.unique(np.repeat(first[:-1], n) + (found & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64), return_counts=True)
    at = at[times % 2 == 1]
    out = np.zeros(first[-1] // 8, np.uint8)
    np.bitwise_or.at(out, at // 8, (1 << (at % 8)).astype(np.uint8))
    return pa.ListArray.from_arrays(pa.array((first // 64).astype(np.int32)), pa.array(out.view(np.int64)))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(repeats.doc_key(id_col).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).select("doc", F.xxhash64("text").alias("tkey"), "text")


def prefixes(found: np.ndarray, offsets: np.ndarray, similarity: Fraction) -> pa.ListArray:
    """The first shingles of each set, by the prefix filter."""
    n = np.diff(offsets)
    many = np.where(n > 0, n + 1 + (-n * similarity.numerator) // similarity.denominator, 0)
    start = np.cumsum(many) - many
    at = np.repeat(offsets[:-1] - start, many) + np.arange(int(many.sum()))
    return pa.ListArray.from_arrays(pa.array(np.append(start, many.sum()).astype(np.int32)), pa.array(found[at].view(np.int64)))


def _lists(found: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.view(np.int64)))


def shingled(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: Fraction, hot: list[int]) -> DataFrame:
    """doc, tkey, node (a key of the text's set), fp (its fingerprint), n (its size), first (its first shingles), parity (of the number of shingles per bit)."""
    ship(docs.sparkSession)
    by_hash = sorted((h % 2**64, i + 1) for i, h in enumerate(hot))
    hot_hash, hot_rank = np.array([h for h, _ in by_hash], np.uint64), np.array([i for _, i in by_hash], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in repeats.chunks(batch):
                found, offsets, node = sets(repeats.encoded(some), shingle, hot_hash, hot_rank)
                columns = [some.column("doc"), some.column("tkey"), pa.array(node.view(np.int64)), pa.array(simhash.majority(_lists(found, offsets))), pa.array(np.diff(offsets)), prefixes(found, offsets, similarity), parities(found, offsets)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "tkey", "node", "fp", "n", "first", "parity"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc long, tkey long, node long, fp long, n long, first array<long>, parity array<long>")


def whole_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of texts (node, text)."""
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in repeats.chunks(batch):
                found, offsets, _ = sets(repeats.encoded(some), shingle, none, none.view(np.int64))
                yield pa.RecordBatch.from_arrays([some.column("node"), _lists(found, offsets)], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def frequent(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> list[int]:
    """Shingles of many texts, the most frequent last; HOT at most. Which they are changes speed alone."""
    ship(docs.sparkSession)
    some = texts_of(docs, id_col, text_col).where(F.pmod("tkey", F.lit(SAMPLE)) == 0).groupBy("tkey").agg(F.first("text").alias("text"))
    each = whole_sets(some.withColumnRenamed("tkey", "node"), shingle).select(F.explode("shingles").alias("h"))
    most = each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(HOT)
    return [r.h for r in reversed(most.collect())]


def possible(pairs: DataFrame, about: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) that sizes and parities allow: sets differ in as many shingles as their parities in bits, or more."""
    p, q = similarity.numerator, similarity.denominator
    side = lambda c: about.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    # the longer of two is folded in half: sizes that similarities over 1/2 allow are at most one power of two apart
    folded = lambda x, y: f"IF(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (v, w) -> v ^ w), {x})"
    differ = F.expr(f"aggregate(zip_with({folded('pa', 'pb')}, {folded('pb', 'pa')}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * q >= F.greatest("na", "nb") * p)
    return both.where(differ * (p + q) <= (F.col("na") + F.col("nb")) * (q - p)).select("a", "b")


def verified(pairs: DataFrame, about: DataFrame, texts: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Of the pairs (a, b) those whose sets are similar, as a table."""
    p, q = similarity.numerator, similarity.denominator
    pairs = scratch.table(pairs, "pairs")
    asked = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
    named = about.select("node", *KEY).join(asked, "node", "left_semi")
    whole = scratch.table(whole_sets(texts.join(named, KEY), shingle).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    side = lambda c: whole.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    found = scratch.table(both.where((p + q) * F.size(F.array_intersect("sa", "sb")) >= p * (F.size("sa") + F.size("sb"))).select("a", "b"), "links")
    scratch.drop(pairs)
    scratch.drop(whole)
    return found


def fits(similarity: Fraction) -> Column:
    """Whether sets x and y may be similar with a shingle at these places as the first they share: all before it, in both, is not shared, nor what one has more of behind it."""
    p, q = similarity.numerator, similarity.denominator
    sizes = F.least("x.n", "y.n") * q >= F.greatest("x.n", "y.n") * p
    rest = F.abs((F.col("x.n") - F.col("x.place")) - (F.col("y.n") - F.col("y.place")))
    return sizes & ((F.col("x.place") + F.col("y.place") + rest) * (p + q) <= (F.col("x.n") + F.col("y.n")) * (q - p))


def simhash_pairs(about: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with one fingerprint, or with two that differ in few bits: one node stands for a fingerprint."""
    fps = scratch.table(about.groupBy("fp").agg(F.min("node").alias("lead")), "fingerprints")
    same = about.join(fps, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    near = simhash.links(fps.select("fp"))
    side = lambda c: fps.select(F.col("fp").alias(f"f{c}"), F.col("lead").alias(c))
    return same.union(near.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(side("a"), "fa").join(side("b"), "fb").select("a", "b"))


def links(marked: DataFrame, texts: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """Links (a, b) that connect all nodes of similar sets. marked: as of shingled."""
    spark = marked.sparkSession
    nodes = marked.where("n > 0").groupBy("node").agg(F.min(F.struct("doc", "tkey", "fp", "n")).alias("x"), F.first("parity").alias("parity"))
    about = scratch.table(nodes.select("node", "x.*", "parity"), "about")
    found = verified(possible(simhash_pairs(about), about, similarity), about, texts, shingle, similarity)
    each = marked.join(about.select("node", *KEY), [*KEY, "node"], "left_semi").select("node", "n", F.posexplode("first").alias("place", "key"))
    dealt = each.repartition(scratch.partitions(spark), "key")  # one exchange serves the count and the join
    often = dealt.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("key")
    # of similar sets the classes of size are equal or neighbours; each set stands in its own and the one below
    size = F.floor(F.log("n") / F.lit(math.log(similarity.denominator / similarity.numerator) * (1 + 1e-9)))
    known = dealt.join(often.hint("shuffle_hash"), "key").distinct().withColumn("size", size)
    members = scratch.table(known.select("*", F.explode(F.array("size", F.col("size") - 1)).alias("slot")), "members")
    before = float("inf")
    for number in range(1, ROUNDS + 1):
        roots = simhash.components(found).withColumnRenamed("node", "__node")
        at = members.join(roots, members.node == roots.__node, "left").select(*members.columns, F.coalesce("root", "node").alias("root"))
        mixed = at.groupBy("key", "slot").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key", "slot")
        at = scratch.table(at.join(mixed, ["key", "slot"]), "open")
        per = at.groupBy("key", "slot", "root").agg(F.count("*").cast("double").alias("n")).groupBy("key", "slot").agg(((F.sum("n") ** 2 - F.sum(F.col("n") ** 2)) / 2).alias("pairs"), F.sum("n").alias("n"))
        cost, rows = per.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
        if not rows:
            return found
        last = number == ROUNDS or cost <= FEW * rows or 2 * cost >= before
        before = cost
        if last:
            other = at
        else:
            # first the node with the fewest rare shingles, which is in the middle of a group of near copies; then by a number per node and round, the same in all buckets
            by = F.col("place") if number == 1 else F.lit(0)
            chosen = F.struct(by.alias("first"), F.xxhash64("node", F.lit(number)).alias("by"), "node", "n", "place", "size", "root")
            other = at.groupBy("key", "slot").agg(F.min(chosen).alias("c")).select("key", "slot", "c.*")
        meet = F.expr("x.key = y.key AND x.slot = y.slot AND x.root <> y.root AND x.slot = least(x.size, y.size)" + (" AND x.node < y.node" if last else ""))
        pairs = at.alias("x").join(other.alias("y"), meet & fits(similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
        pairs = possible(pairs, about, similarity)
        if not last:  # one a node: the others come in later rounds where they still join anything
            pairs = pairs.groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(number))).alias("b"))
        more = verified(pairs, about, texts, shingle, similarity)
        scratch.drop(at)
        found = found.union(more)
        if last:
            return found
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """One row per document: doc, tkey, component (the smallest doc that links reach)."""
    marked = scratch.table(shingled(docs, id_col, text_col, shingle, similarity, frequent(docs, id_col, text_col, shingle)), "shingles")
    found = links(marked, texts_of(docs, id_col, text_col), shingle, similarity)
    roots = scratch.table(simhash.components(found), "roots").withColumnRenamed("node", "__node")
    nodes = marked.groupBy("node").agg(F.min("doc").alias("lead"))
    rooted = nodes.join(roots, nodes.node == roots.__node, "left").select("node", "lead", F.coalesce("root", "node").alias("root"))
    component = rooted.groupBy("root").agg(F.min("lead").alias("component"))
    of_node = scratch.table(rooted.join(component, "root").select("node", "component"), "components")
    return marked.select("doc", "tkey", "node").join(of_node, "node").select("doc", "tkey", "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """docs, same columns, with one row of each group: its smallest id, then the least hash of the text, then of the whole row."""
    groups = scratch.table(near_groups(docs, id_col, text_col, shingle, similarity), "groups")
    least = groups.groupBy("component").agg(F.min(F.struct("doc", "tkey")).alias("kept"))
    each = groups.groupBy("component", "doc", "tkey").agg(F.count("*").alias("n"))
    named = each.join(least, "component").select("doc", "tkey", "n", (F.struct("doc", "tkey") == F.col("kept")).alias("stays"))
    named = scratch.table(named.where("n > 1 OR NOT stays").select(F.col("doc").alias("__doc"), F.col("tkey").alias("__tkey"), "stays"), "named")
    same = (repeats.doc_key(id_col) == F.col("__doc")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__tkey"))
    alone = docs.join(named, same, "left_anti")
    repeated = docs.join(named.where("stays").drop("stays"), same).groupBy("__doc", "__tkey").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("__row"))
    return alone.unionByName(repeated.select("__row.*"))
