import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociq.llm import storage
from lociq.llm.storage import discard, filter_bits, fresh, in_filter, matching, may_hold, new_path, numbered, once, repeated_nodes, settle, settle_by, shared_folder, summed, without


def test_written_tables(spark):
    a = settle(spark.range(5), "some")
    assert a.count() == 5 and a.dtypes == spark.range(1).dtypes
    assert new_path(spark, "x") != new_path(spark, "x") and new_path(spark, "x").startswith(shared_folder(spark))
    folder = a.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert os.path.isdir(folder)
    discard(a)
    assert not os.path.exists(folder)


def test_buckets_move_one_side_alone(spark):
    a = settle_by(spark.range(1000).withColumnRenamed("id", "k"), "k", "bucketed")
    b = spark.range(1000).select((F.col("id") % 100).alias("k"), F.lit(1).alias("x")).distinct()
    joined = a.join(b.hint("merge"), "k")
    assert joined.count() == 100
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


@pytest.mark.parametrize("words", [1 << 18, 2])
def test_filters_lose_nothing(spark, monkeypatch, words):
    """Also with so small a filter that nearly everything passes it."""
    monkeypatch.setattr(storage, "FILTER_WORDS", words)
    rows = settle(spark.range(5000).select(F.xxhash64("id").alias("node"), "id"), "rows")
    keys = settle(rows.where("id % 7 = 0").select("node", F.lit("x").alias("y")), "keys")
    held = rows.where(may_hold(keys)(F.col("node")))
    assert held.where("id % 7 = 0").count() == keys.count() and (words == 2 or held.count() < 800)
    assert matching(rows, keys, ["node"]).count() == keys.count()
    told = settle(rows.select("node", (F.col("id") % 7 == 0).alias("out")), "told")
    assert {r.id for r in without(rows, told).collect()} == {i for i in range(5000) if i % 7}
    bits, nodes = filter_bits(keys), np.array([r.node for r in rows.orderBy("id").collect()], np.int64).view(np.uint64)
    assert in_filter(bits, nodes)[::7].all() and int(in_filter(bits, nodes).sum()) == held.count()
    none = settle(keys.limit(0), "none")
    assert rows.where(may_hold(none)(F.col("node"))).count() == 0 and matching(rows, none, ["node"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, 3000])
def test_filters_of_few_keys_are_small(spark, n):
    """A filter goes into every task that asks it, and through the driver: that of a few keys doesn't take the room of millions."""
    rows = settle(spark.range(20000).select(F.xxhash64("id").alias("node"), "id"), "rows")
    keys = settle(rows.where(F.col("id") < n), "keys")
    bits, nodes = filter_bits(keys), np.array([r.node for r in rows.orderBy("id").collect()], np.int64).view(np.uint64)
    assert len(bits) * 64 <= max(128, 512 * n) < storage.FILTER_WORDS * 64
    held = in_filter(bits, nodes)
    assert held[:n].all() and held[n:].mean() < 0.01
    assert rows.where(may_hold(keys)(F.col("node"))).count() == held.sum()


def test_rows_of_one_id_are_told_apart(spark):
    """Two texts whose 32-bit hashes are equal, both without an id."""
    texts = ["alpha beta gamma delta 186041 epsilon 1473258679 zeta eta theta 5767276", "alpha beta gamma delta 239968 epsilon 1900306592 zeta eta theta 7439013"]
    docs = spark.createDataFrame([(None, t) for t in (*texts, texts[0])] + [(-(1 << 63), texts[0])], "doc_id long, text string")
    assert docs.select(F.hash("text")).distinct().count() == 1
    rows = settle(numbered(docs), "numbered")
    assert rows.select("node").distinct().count() == 3
    repeated = repeated_nodes(rows)
    assert repeated.count() == 1 and once(rows, repeated).count() == 3
    clash = settle(rows.withColumn("node", F.lit(1).cast("long")), "clash")
    assert repeated_nodes(clash) is None


def test_sums_meet_in_steps(spark, monkeypatch):
    monkeypatch.setattr(storage, "FAN_IN", 4)

    def raw(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids % 2), pa.array([np.array([i, 1]).tobytes() for i in ids], pa.binary())], names=["k", "v"])

    parts = spark.range(0, 64, 1, 64).mapInArrow(raw, "k long, v binary")
    got = {r.k: np.frombuffer(r.v, "<i8").tolist() for r in summed(parts, "k", "v", "<i8").collect()}
    assert got == {0: [sum(range(0, 64, 2)), 32], 1: [sum(range(1, 64, 2)), 32]}
    assert summed(parts.limit(0), "k", "v", "<i8").count() == 0


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "_Shard int, b int")
    assert fresh(df, "_shard") == "_shard_" and fresh(df, "c") == "c"
