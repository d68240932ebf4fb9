"""K-mer counts over reads that keep arriving, with Structured Streaming.

The reference workload is a batch; this lets the same count run over a folder of Parquet
reads that grows.  A read's k-mers are distinct within the read, so no state but the
counts is needed; in complete or update mode each trigger gives the counts so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenstrand.config import Config
from evenstrand.operators import counting


def counts(stream: DataFrame, c: Config, bases: str = "bases") -> DataFrame:
    """kmer, depth of a streaming DataFrame of reads, each row a unit of its own."""
    reads = counting.Reads(stream, (), (), bases)
    return counting.unit_counts(reads, c).groupBy("kmer").agg(F.sum("units" if c.rdk else "raw").alias("depth"))
