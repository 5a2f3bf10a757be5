"""Connected components of a graph given as a frame of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.storage import settle

CHUNK = 1 << 16


def forest(us: list[int], vs: list[int]) -> dict[int, int]:
    """node -> the least node that some links reach, of all their nodes but these."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for u, v in zip(us, vs, strict=True):
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: r for x in root if (r := find(x)) != x}


def stars(links: DataFrame) -> DataFrame:
    """Links (u, v) of the same components as those given, at most as many: each CHUNK of them, where they lie, as links of nodes to the least
    node that the chunk reaches from them."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []

        def told() -> pa.RecordBatch:
            found = forest(us, vs)
            us.clear(), vs.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["u", "v"])

        for batch in batches:
            us += batch.column(0).to_pylist()
            vs += batch.column(1).to_pylist()
            if len(us) >= CHUNK:
                yield told()
        yield told()

    return links.select("u", "v").mapInArrow(contract, "u long, v long")


def are_stars(now: DataFrame) -> bool:
    """Whether each node of written links (u, v) points at one node at most, and no other node at one that points."""
    ends = now.select(F.col("u").alias("node"), "v", F.lit(False).alias("met")).union(now.select("v", F.lit(None).cast("long"), F.lit(True)))
    node = ends.groupBy("node").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("met").alias("met"))
    return node.where("least < most or (least is not null and met)").agg(F.count("*")).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links reach) for each node of links (u, v), in either direction.

    First the links of each chunk become stars where they lie. Then alternating star contraction: each node points its larger
    neighbours, then its smaller ones, at the least of them. Rounds, few even for long chains, go on until all links are stars;
    each is written, which ends its lineage. Minima are taken by partial aggregation, written, and joined back by a plain shuffle of both
    sides, which Spark splits where very many nodes point at one. Loops and repeated links change nothing.
    """
    now = settle(stars(links), "links")
    while not are_stars(now):
        both = now.union(now.select("v", "u"))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        now = settle(small.where("u != v").distinct(), "links")
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(now.select("v", "v").distinct())
