"""Two-pass external shuffle: scatter into memory-sized buckets, Fisher-Yates within each, cut into shards.

Pass one deals every record to a bucket by a seeded hash, as many buckets as keep one in memory. Pass two
permutes each bucket and writes it. Buckets in a row are one uniformly shuffled sequence; it is cut
into shards of equal counts (the law ``rows``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lociq.llm.storage import fresh, named, new_path

LEAST_BUCKET, LARGEST_BUCKET = 32 << 20, 512 << 20
MAX_BUCKETS = 10_000


def bucket_size(spark: SparkSession) -> int:
    """Bytes of text for each bucket: a 32nd of an executor core's memory, within bounds."""
    conf = spark.sparkContext.getConf()
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get("spark.executor.memory", "1g").lower()).groups()
    memory = int(number) << {"k": 10, "": 20, "m": 20, "g": 30, "t": 40}[unit]
    return min(LARGEST_BUCKET, max(LEAST_BUCKET, memory // int(conf.get("spark.executor.cores", "1")) // 32))


def permutation(n: int, seed: int, bucket: int) -> np.ndarray:
    """Fisher-Yates: from the last place down, swap with a uniformly drawn place not beyond it."""
    order = np.arange(n)
    rng = np.random.default_rng([seed, bucket])
    draws = rng.integers(0, np.arange(n, 0, -1)) if n else order
    for i, j in zip(range(n - 1, 0, -1), draws.tolist(), strict=False):
        order[i], order[j] = order[j], order[i]
    return order


def shuffle_records(docs: DataFrame, seed: int = 17, bucket_bytes: int | None = None, path: str | None = None) -> DataFrame:
    """Shuffle all records and write them; returns the written rows: the columns of docs, then ``_bucket``
    and ``_place`` (the order after the shuffle; with an underscore more where docs has such columns).

    The bucket is a hash of the seed, the id, the text and the place in the input, so that repeated rows
    spread as well; within a bucket rows are put in order of (id, text hash, input place) before they are
    permuted, so the same files give the same result whatever the order in which they arrive. Nulls
    hash like values; a record larger than a bucket makes that bucket larger, no other. An empty table gives no rows.
    Beyond MAX_BUCKETS, records are scattered to groups of buckets first, which are then dealt to their buckets one by one.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "shuffled")
    weight = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 64
    total = docs.agg(F.sum(weight)).first()[0] or 0
    buckets = max(1, math.ceil(total / (bucket_bytes or bucket_size(spark))))
    hashed = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie", "input"), F.lit(buckets)).cast("int")
    keyed = docs.select(F.struct(*named(docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("input"))
    keyed = keyed.withColumn("bucket", hashed)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:  # the partition is one bucket
            rows = pa.Table.from_batches(parts)
            rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("tie", "ascending"), ("input", "ascending")]))
            rows = rows.take(pa.array(permutation(len(rows), seed, rows.column("bucket")[0].as_py())))
            rows = rows.select(["row", "bucket"]).append_column("place", pa.array(np.arange(len(rows))))
            yield from rows.to_batches(max_chunksize=2_000)

    schema = StructType([keyed.schema["row"], StructField("bucket", IntegerType()), StructField("place", LongType())])
    if buckets <= MAX_BUCKETS:
        keyed.repartitionById(buckets, "bucket").mapInArrow(shuffle, schema).write.parquet(path)
    else:
        groups = math.ceil(buckets / MAX_BUCKETS)
        scattered = f"{path}-scattered"
        keyed.withColumn("group", F.col("bucket") % groups).repartitionById(groups, "group").write.partitionBy("group").parquet(scattered)
        for group in range(groups):
            some = spark.read.schema(keyed.schema).parquet(f"{scattered}/group={group}") if group < buckets else keyed.limit(0)
            dealt = some.repartitionById(math.ceil(buckets / groups), (F.col("bucket") / groups).cast("int"))
            dealt.mapInArrow(shuffle, schema).write.mode("append").parquet(path)
    bucket, place = fresh(docs, "_bucket"), fresh(docs, "_place")
    return spark.read.schema(schema).parquet(path).select("row.*", F.col("bucket").alias(bucket), F.col("place").alias(place))


def cut_shards(shuffled: DataFrame, shards: int) -> DataFrame:
    """Adds ``_shard`` and ``_slot`` to the rows of shuffle_records: the sequence cut into runs whose lengths differ by one at most.
    Slots run from 0 without gaps. With fewer records than shards some shards stay empty; an empty table gives no rows.
    Where such names are taken, the new ones have an underscore more."""
    *_, bucket, place = shuffled.columns
    rows = shuffled.select(F.struct(*named(shuffled.columns)).alias("row"), F.col(bucket).alias("bucket"), F.col(place).alias("place"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))  # one row for each bucket
    ends = sizes.select("bucket", F.sum("n").over(Window.orderBy("bucket")).alias("end"), F.sum("n").over(Window.partitionBy()).alias("total"), "n")
    placed = rows.join(ends, "bucket").withColumn("at", F.col("end") - F.col("n") + F.col("place"))
    placed = placed.withColumn("shard", F.expr(f"((at + 1) * {shards} - 1) div total").cast("int"))
    slot = F.col("at") - F.expr(f"(shard * total) div {shards}")
    return placed.select("row.*", F.col("shard").alias(fresh(shuffled, "_shard")), slot.alias(fresh(shuffled, "_slot")))
