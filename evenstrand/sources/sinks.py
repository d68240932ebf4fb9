"""Writers: reads as FASTQ or FASTA, tables as tab-separated text with their headers."""

from __future__ import annotations

import os
import shutil
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenstrand.config import Config
from evenstrand.functions import bases
from evenstrand.sources.reads import is_fasta, split_list


def record(path: str, c: Config) -> Column:
    """The text of a read (id, bases, quals) in the format of path."""
    if is_fasta(path):
        body = F.col("bases") if not c.fasta_wrap else F.rtrim(F.regexp_replace("bases", f"(.{{{c.fasta_wrap}}})", "$1\n"), F.lit("\n"))
        return F.concat(F.lit(">"), "id", F.lit("\n"), body)
    quals = bases.requality(bases.fake_quality("bases", "quals", c.fake_quality), c.qout)
    return F.concat(F.lit("@"), "id", F.lit("\n"), "bases", F.lit("\n+\n"), quals)


def is_null(path: str | None) -> bool:
    return path is None or path.lower() == "null"


def is_stdout(path: str) -> bool:
    low = path.lower()
    return low in ("-", "stdout") or low.startswith("stdout.")


def write_reads(reads: DataFrame, path: str | None, c: Config) -> None:
    """Write reads in input order as text files under path: a folder, as Spark writes them; standard output takes rows as they come."""
    if is_null(path):
        return
    lines = reads.orderBy("file_idx", "pair_id", "mate").select(record(path, c).alias("value"))
    if is_stdout(path):
        for row in lines.toLocalIterator():
            sys.stdout.write(row.value + "\n")
        return
    writer = lines.write.mode("overwrite" if c.overwrite else "append" if c.append else "error")
    (writer.option("compression", "gzip") if path.endswith(".gz") else writer).text(path)


def check_lists(c: Config) -> None:
    """A list of outputs must name one for each input."""
    inputs = len(split_list(c.in1))
    for name, path in c.outs.items():
        if path and "," in path and len(path.split(",")) != inputs:
            raise ValueError(f"{len(path.split(','))} outputs are listed for {name}, but {inputs} inputs")


def write_streams(decided: DataFrame, c: Config) -> None:
    """Route reads to their outputs by the columns keep, bin and uncorrected of decided; mate 2 goes to its own path if there is one."""
    streams = {"keep": F.col("keep"), "toss": ~F.col("keep"), "low": F.col("bin") == "low", "mid": F.col("bin") == "mid", "high": F.col("bin") == "high", "uncorrected": F.col("uncorrected")}
    for name, wanted in streams.items():
        one, two = c.outs.get(name), c.outs.get(name + "2")
        rows = decided.where(wanted)
        sides = [(one, rows)] if not two else [(two, rows.where("mate = 2")), (one, rows.where("mate = 1"))]
        for side, some in sides:
            parts = side.split(",") if side and "," in side else [side]
            for i, path in enumerate(parts):  # a list of outputs follows the list of inputs
                write_reads(some.where(F.col("file_idx") == i) if len(parts) > 1 else some, path, c)


def table_text(df: DataFrame, header: str, comments: list[str] = ()) -> str:
    """A small table as text: comments, a header line, tab-separated rows. For histograms, whose rows are bounded."""
    rows = ["\t".join("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect()]
    return "\n".join([*comments, header, *rows]) + "\n"


def write_text(text: str, path: str, c: Config) -> None:
    if is_null(path):
        return
    if is_stdout(path):
        sys.stdout.write(text)
        return
    if os.path.exists(path) and not (c.overwrite or c.append):
        raise FileExistsError(f"{path} exists; use overwrite=t")
    if os.path.isdir(path):
        shutil.rmtree(path)
    with open(path, "w") as out:
        out.write(text)
