"""Numbers of rows in an order, and sums of arrays, without a task that sees all rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where that setting is missing a temporary folder takes its place, on a single machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get(SETTING, None) or context.getConf().get(SETTING)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lociq-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """df as it is now, written in the cluster's checkpoint folder: later steps read the same rows in the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _numbered(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(df as written, with _part and _at, the place of a row in its partition's order; of each partition and value of ``by`` the rows there,
    the first _at, and the rows in partitions before)."""
    written = keep(df.withColumn("_at", F.monotonically_increasing_id()))
    written = written.withColumn("_part", F.shiftright("_at", 33))
    counts = written.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # one row for each part
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return written, counts.select("_part", *by, "_n", "_first", F.coalesce(before, F.lit(0)).alias("_before"))


def with_position(df: DataFrame, order: Sequence[str], by: Sequence[str], place: str, size: str) -> DataFrame:
    """Adds the place of each row (from 0) among those of equal values of ``by``, in order of other columns, and how many these are.

    Rows are dealt by range, sorted and written, the only time they move; the rows of the parts before are added to the place within the
    part. df should be a written table, as the ranges are told from a sample of it."""
    dealt, counts = _numbered(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order), by)
    starts = counts.select("_part", *by, "_first", "_before", F.sum("_n").over(Window.partitionBy(*by)).alias(size))
    return dealt.join(F.broadcast(starts), ["_part", *by]).withColumn(place, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def with_row_number(df: DataFrame, name: str) -> DataFrame:
    """Adds the number of each row, from 1, in the order in which df has them."""
    dealt, starts = _numbered(df, [])
    numbered = dealt.join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_n", "_first", "_before")


def dealt_in_order(numbered: DataFrame, name: str, least: int, most: int) -> DataFrame:
    """Rows in order of their numbers, from with_row_number(), in partitions of ``most`` rows at most, and of ``least`` or more unless there
    are fewer cores than that makes. What is done to each partition in its order leaves the whole in order: nothing need be sorted after."""
    n = numbered.count()
    cores = numbered.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // most), min(cores, n // least))
    return numbered.repartitionByRange(parts, name).sortWithinPartitions(name)


def sum_arrays(parts: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Sums, place by place, of arrays of doubles of equal length; groups stream through, one array is held."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = total + batch.column(column).flatten().to_numpy().reshape(len(batch), -1).sum(axis=0)
        columns = [pa.array([k.as_py()], k.type) for k in key]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([total], pa.list_(pa.float64()))], names=[*by, column])

    kinds = dict(parts.dtypes)
    return parts.groupBy(*by).applyInArrow(add, ", ".join([*(f"{c} {kinds[c]}" for c in by), f"{column} array<double>"]))
