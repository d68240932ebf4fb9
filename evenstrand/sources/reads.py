"""Reads as DataFrames: (numeric_id, id, bases, quals), and pairs of them.

A FASTQ or FASTA source is read by Spark's text reader (gzip by extension, one task per
compressed file); records are formed within bounded groups of lines, so no task holds a
whole file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenstrand.config import Config
from evenstrand.functions import bases
from evenstrand.operators import counting
from evenstrand.ship import ship

SCHEMA = T.StructType([T.StructField("numeric_id", T.LongType()), T.StructField("id", T.StringType()), T.StructField("bases", T.StringType()), T.StructField("quals", T.StringType())])
FASTA = ("fa", "fasta", "fas", "fna", "ffn", "frn", "fsa", "seq")


def is_fasta(path: str) -> bool:
    """Whether a path's extension means FASTA; anything else means FASTQ."""
    name = path.lower().removesuffix(".gz")
    return name.rpartition(".")[2] in FASTA


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line: numbered from 0 without gaps, blank lines left out."""
    text = spark.read.text(path)
    kept = text.where(F.trim(F.col("value")) != "").rdd.zipWithIndex()  # contiguous numbers need one counting pass; rows stay in the JVM's text form
    return spark.createDataFrame(kept.map(lambda x: (x[1], x[0][0])), "line_no long, line string")


def sniff(spark: SparkSession, path: str) -> str:
    """fastq or fasta, by the first character; an empty source is an error."""
    first = spark.read.text(path).where(F.trim(F.col("value")) != "").head(1)
    if not first:
        raise ValueError(f"{path} holds no reads")
    mark = first[0][0].lstrip()[0]
    if mark not in "@>":
        raise ValueError(f"{path} is neither FASTQ nor FASTA: it begins with {mark!r}")
    return "fastq" if mark == "@" else "fasta"


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    lines = _lines(spark, path).select((F.col("line_no") / 4).cast("long").alias("numeric_id"), (F.col("line_no") % 4).alias("part"), "line")
    pick = lambda i: F.max(F.when(F.col("part") == i, F.col("line")))
    rows = lines.groupBy("numeric_id").agg(pick(0).alias("head"), pick(1).alias("bases"), pick(2).alias("plus"), pick(3).alias("quals"))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why} in record "), F.col("numeric_id").cast("string"))).cast("string")
    head = F.when(F.col("quals").isNull(), fail("truncated record")).when(~F.col("head").startswith("@"), fail("no @")).when(~F.col("plus").startswith("+"), fail("no +")).when(F.length("bases") != F.length("quals"), fail("bases and qualities differ in length")).otherwise(F.expr("substring(head, 2)"))
    return rows.select("numeric_id", head.alias("id"), "bases", "quals")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line sequences are joined: a running count of headers numbers the records within ranges of lines."""
    from pyspark.sql import Window

    lines = _lines(spark, path).withColumn("block", (F.col("line_no") / 100_000).cast("long")).withColumn("head", F.col("line").startswith(">").cast("long"))
    per_block = lines.groupBy("block").agg(F.sum("head").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per 100,000 lines
    starts = per_block.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("line_no")
    numbered = lines.join(starts, "block").withColumn("numeric_id", F.col("base") + F.sum("head").over(within) - 1)
    rows = numbered.groupBy("numeric_id").agg(F.max(F.when(F.col("head") == 1, F.expr("substring(line, 2)"))).alias("id"), F.sort_array(F.collect_list(F.when(F.col("head") == 0, F.struct("line_no", F.trim("line").alias("line"))))).alias("x"))
    return rows.where("numeric_id >= 0").select("numeric_id", "id", F.concat_ws("", F.col("x.line")).alias("bases"), F.lit(None).cast("string").alias("quals"))


def read(spark: SparkSession, path: str, c: Config | None = None) -> DataFrame:
    """The reads of a FASTQ or FASTA file, cleaned as c says."""
    c = c or Config()
    raw = read_fastq(spark, path) if sniff(spark, path) == "fastq" else read_fasta(spark, path)
    b, q = bases.prepare("bases", "quals", c)
    return raw.select("numeric_id", "id", b.alias("bases"), q.alias("quals"))


def look_paired(a: str, b: str, allow_identical: bool = False) -> bool:
    """Whether two names are mates: name 1:... and name 2:..., or name/1 and name/2."""
    if len(a) != len(b):
        return False
    i = a.find(" ")
    if i > 0 and b.find(" ") == i and a[:i] == b[:i] and a[i + 1 : i + 3] == "1:" and b[i + 1 : i + 3] == "2:":
        return True
    i = a.rfind("/")
    if i > 0 and b.rfind("/") == i and (a[:i], a[i + 2 :]) == (b[:i], b[i + 2 :]) and a[i + 1 : i + 2] == "1" and b[i + 1 : i + 2] == "2":
        return True
    return allow_identical and a == b


def looks_interleaved(path: str, reads: DataFrame) -> bool:
    if "_interleaved." in path:
        return True
    first = [r.id for r in reads.where("numeric_id < 2").orderBy("numeric_id").select("id").collect()]
    return len(first) == 2 and look_paired(*first)


def pair_files(one: DataFrame, two: DataFrame) -> DataFrame:
    """pair_id, mate, ...: two sources side by side, by record number; the shorter one's missing mates stay missing."""
    return one.select(F.col("numeric_id").alias("pair_id"), F.lit(1).alias("mate"), "*").unionByName(two.select(F.col("numeric_id").alias("pair_id"), F.lit(2).alias("mate"), "*"))


def pair_interleaved(reads: DataFrame) -> DataFrame:
    return reads.select((F.col("numeric_id") / 2).cast("long").alias("pair_id"), (F.col("numeric_id") % 2 + 1).cast("int").alias("mate"), "*")


def single(reads: DataFrame) -> DataFrame:
    return reads.select(F.col("numeric_id").alias("pair_id"), F.lit(1).alias("mate"), "*")


def split_list(path: str | None) -> list[str]:
    """A comma list of inputs; an existing path with a comma is one input."""
    return [] if not path else [path] if os.path.exists(path) or "," not in path else [p for p in path.split(",") if p]


def load(spark: SparkSession, c: Config) -> DataFrame:
    """All inputs of c as (file_idx, pair_id, mate, numeric_id, id, bases, quals); `reads` limits each file's records."""
    ones, twos = split_list(c.in1), split_list(c.in2)
    out = None
    for i, path in enumerate(ones):
        reads = read(spark, path, c)
        if i < len(twos):
            paired = pair_files(reads, read(spark, twos[i], c))
        elif c.interleaved or (c.test_interleaved and looks_interleaved(path, reads)):
            paired = pair_interleaved(reads)
        else:
            paired = single(reads)
        if c.reads is not None:
            paired = paired.where(F.col("pair_id") < c.reads)
        paired = paired.select(F.lit(i).alias("file_idx"), "*")
        out = paired if out is None else out.unionByName(paired)
    if out is None:
        raise ValueError("no input is given")
    return out


def spool_stdin(stream, path: str) -> str:
    """Standard input as a file, since passes read it again."""
    with open(path, "wb") as out:
        while block := stream.read(1 << 20):
            out.write(block)
    return path


# reads cut from texts

AS_BASES, AS_QUALS = "ACGTACGTACGTACGTACGTACGTAC", "56789:;<=>?@ABCDEFGHIJKLMN"


def reads_of_documents(docs: DataFrame, size: int = 100, least: int = 31) -> DataFrame:
    """Texts as reads: letters A-Z become ACGT by turns, cut every `size`; doc_id, frag, bases, quals."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    up = F.upper(letters)
    seq = F.translate(up, bases.UPPER, AS_BASES)
    q = F.translate(up, bases.UPPER, AS_QUALS)
    one = docs.select("doc_id", seq.alias("s"), q.alias("q")).where(F.length("s") >= least)
    cut = lambda c: F.regexp_extract_all(c, F.lit(f".{{1,{size}}}"), F.lit(0))  # noqa: E731  # one walk over the text
    pieces = one.select("doc_id", F.posexplode(F.arrays_zip(cut("s").alias("bases"), cut("q").alias("quals"))).alias("frag", "x"))
    return pieces.select("doc_id", F.col("frag").cast("long").alias("frag"), "x.bases", "x.quals").where(F.length("bases") >= least)


def reads_by_kernel(docs: DataFrame, size: int = 100, least: int = 31) -> DataFrame:
    """reads_of_documents, cut from the bytes of many texts at once. A text's reads come one after another."""
    ship(docs.sparkSession)
    tables = np.zeros((2, 256), np.uint8)
    for table, letters in zip(tables, (AS_BASES, AS_QUALS), strict=True):
        for one in (bases.UPPER, bases.LOWER):
            table[np.frombuffer(one.encode(), np.uint8)] = np.frombuffer(letters.encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in counting.slices(whole):
                data, offsets = counting.flat(batch.column("text"))
                is_letter = tables[0][data] > 0
                letters, ends = data[is_letter], np.concatenate([[0], np.cumsum(is_letter)])[offsets]
                n = np.diff(ends)
                pieces = -(-n // size)
                text = np.repeat(np.arange(len(n)), pieces)
                frag = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                cuts = pa.py_buffer(np.append(ends[:-1][text] + size * frag, len(letters)).astype(np.int32))
                long = pa.array(np.minimum(size, n[text] - size * frag) >= least)
                made = [pa.StringArray.from_buffers(len(text), cuts, pa.py_buffer(table[letters])) for table in tables]
                yield pa.RecordBatch.from_arrays([x.filter(long) for x in (batch.column("doc_id").take(pa.array(text)), pa.array(frag), *made)], ["doc_id", "frag", "bases", "quals"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(x, t()) for x, t in (("frag", T.LongType), ("bases", T.StringType), ("quals", T.StringType)))]))
