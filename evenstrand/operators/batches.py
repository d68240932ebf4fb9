"""Reads held as batches of whole units: a row of some thousand reads, compressed, instead of a row a read.

Reads that are judged more than once travel and lie as batches; what was decided goes back
to a batch by the number of the unit, so rows of reads are never shuffled for a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenstrand.operators import counting
from evenstrand.ship import ship

#: The number of a read's unit: its batch (task, batch of the task), then its place in the batch.
UNIT = "__unit"
IN_BATCH, IN_TASK = 20, 23


def _closed(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def _opened(pack: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pack) as stream:
        (rows,) = list(stream)
    return rows


def pack(reads: DataFrame, unit: list[str], order: list[str], together: bool = False) -> DataFrame:
    """batch, pack: reads as batches. together: the rows of a unit already come one after another, in one partition."""
    ship(reads.sparkSession)
    if not together:
        reads = reads.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), *unit).sortWithinPartitions(*unit, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (rows, of) in enumerate(counting.whole_units(batches, unit)):
            batch = task << IN_TASK | number
            held = _closed(rows.append_column(UNIT, pa.array((of - of[0]).astype(np.int64) | batch << IN_BATCH)))
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([held], pa.binary())], ["batch", "pack"])

    return reads.mapInArrow(run, "batch long, pack binary")


def opened(held: DataFrame, schema: T.StructType) -> DataFrame:
    """The reads of batches, with the number of their unit; units stay together."""
    return read_packs(held, T.StructType([*schema, T.StructField(UNIT, T.LongType())]))


def read_packs(held: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of packs."""
    ship(held.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("pack"):
                yield _opened(x.as_py())

    return held.select("pack").mapInArrow(run, schema)


def _met(held: DataFrame, decided: DataFrame) -> DataFrame:
    """Batches and the decisions on their units side by side: a batch's row, then those of its units in order."""
    names = [x for x in decided.columns if x != UNIT]
    none = [F.lit(None).cast(decided.schema[x].dataType).alias(x) for x in names]
    rows = held.select("batch", F.lit(-1).cast("long").alias(UNIT), "pack", *none)
    rows = rows.unionByName(decided.select(F.shiftright(UNIT, IN_BATCH).alias("batch"), UNIT, F.lit(None).cast("binary").alias("pack"), *names))
    return rows.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch").sortWithinPartitions("batch", UNIT)


def _each(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.Scalar, pa.RecordBatch]]:
    """Number and reads of each batch, with the named decisions on their units."""
    for rows in counting.groups(batches, "batch"):
        reads, known = _opened(rows.column("pack")[0].as_py()), rows.slice(1)
        unit, of = known.column(UNIT).to_numpy(), reads.column(UNIT).to_numpy()
        at = np.searchsorted(unit, of)
        if not np.array_equal(unit[np.minimum(at, len(unit) - 1)] if len(unit) else -1 - of, of):
            raise ValueError("a unit of a batch of reads has no decision")
        for x in names:
            reads = reads.append_column(x, known.column(x).take(pa.array(at)))
        yield rows.column("batch")[0], reads


def with_decisions(held: DataFrame, schema: T.StructType, decided: DataFrame) -> DataFrame:
    """The reads of batches, each with the columns of decided (a row per unit) and the number of its unit."""
    names = [x for x in decided.columns if x != UNIT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, reads in _each(batches, names):
            yield reads

    return _met(held, decided).mapInArrow(run, T.StructType([*schema, T.StructField(UNIT, T.LongType()), *(decided.schema[x] for x in names)]))


def where(held: DataFrame, decided: DataFrame, keep: str) -> DataFrame:
    """Batches of the units that decided says to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, reads in _each(batches, [keep]):
            kept = reads.filter(pc.fill_null(reads.column(keep), False)).drop_columns([keep])
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([batch.as_py()], pa.int64()), pa.array([_closed(kept)], pa.binary())], ["batch", "pack"])

    return _met(held, decided.select(UNIT, keep)).mapInArrow(run, "batch long, pack binary")
