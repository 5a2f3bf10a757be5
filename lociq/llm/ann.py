"""Approximate nearest neighbours: inverted file of coarse centroids over product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample of the vectors. Every vector then gets its
list and the code of its residual. A query probes its nearest lists; within a list, distances come from
asymmetric tables (the query's residual against the codebooks), and the best by code are ranked anew
by the exact cosine of the original vectors; so are all others whose distance by code, less the error of their
code, doesn't exceed that of the k-th of these, so within the probed lists the result is exact. Lists are cut into cells of bounded size, on the side of the
vectors as well as of the queries, so a list that holds a third of all rows is shared out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.storage import settle

SAMPLE = 16_384
MAX_LISTS = 512
SUBSPACES = 16
CODES = 64
TARGET = 0.97
TRIALS = 64
CELL_ROWS = 4_096
CELL_QUERIES = 2_048
REFINE = 48
SLACK = 1e-6
BLOCK = 64


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from distinct rows; an empty cluster keeps its centroid. Fewer rows give fewer centroids."""
    x = np.ascontiguousarray(x)
    some = np.unique(x, axis=0)
    centroids = some[rng.permutation(len(some))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centroids)
        n = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


class Quantizer:
    """Coarse centroids and codebooks for unit vectors; of fixed size whatever the input."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dims = sample.shape[1]
        self.coarse = kmeans(sample, lists, 8, rng)
        self.bounds = np.linspace(0, self.dims, min(SUBSPACES, self.dims) + 1).astype(int)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.books = [kmeans(rest[:, a:b], CODES, 6, rng) for a, b in self._parts()]

    def _parts(self) -> list[tuple[int, int]]:
        return list(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list of each vector, code of its residual, distance between the two)."""
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self._parts(), self.books, strict=True)], axis=1).astype(np.uint8)
        lost = sum(((rest[:, a:b] - book[codes[:, j]]) ** 2).sum(1) for j, ((a, b), book) in enumerate(zip(self._parts(), self.books, strict=True)))
        return at, codes, np.sqrt(lost)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        return np.argsort(distances(x, self.coarse), axis=1, kind="stable")[:, :n]

    def code_distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries (rows) to the coded residuals of one list (columns)."""
        rest = x - self.coarse[cell]
        total = np.zeros((len(x), len(codes)))
        for j, ((a, b), book) in enumerate(zip(self._parts(), self.books, strict=True)):
            table = ((rest[:, None, a:b] - book[None]) ** 2).sum(2)
            total += table[:, codes[:, j]]
        return total


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else np.concatenate(column.to_list())
    return flat.astype(float).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact cosines of one vector against rows, summed pairwise in double precision."""
    return (q * x).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1)))


def probes_needed(index: DataFrame, asked: DataFrame, shared, k: int, target: float) -> int:
    """How many lists hold ``target`` of the true neighbours of TRIALS queries, found by brute force over the
    whole index: one linear pass that keeps k rows for each query and batch."""
    some = asked.orderBy(F.xxhash64("query_id", "q"), "query_id").limit(TRIALS).toArrow()
    if not len(some):
        return 1
    names, q = some.column(0).to_numpy(), unit(_matrix(some.column(1).combine_chunks()))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                near = q @ unit(_matrix(batch.column(1))).T
                near[names[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-near, axis=1, kind="stable")[:, :k]
                which = np.repeat(np.arange(len(q), dtype=np.int32), top.shape[1])
                flat = top.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(ids[flat]), pa.array(near[which, flat]), pa.array(lists[flat])], names=["q", "vec_id", "score", "list"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = index.select("vec_id", "v", "list").mapInArrow(best, "q int, vec_id long, score double, list int").where("score >= -1")
    true = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "list").collect()  # TRIALS * k rows
    if not true:
        return 1
    places = np.argsort(shared.value.probes(q, len(shared.value.coarse)), axis=1)
    return int(np.quantile([places[r["q"], r["list"]] for r in true], target, method="higher")) + 1


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, target: float = TARGET, refine: int = REFINE, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest rows of vectors by cosine, itself
    (the same vec_id) left out.

    Both frames have ``vec_id`` and ``embedding`` of one length; other columns are ignored. Vectors that are
    null, zero or hold null or non-finite components take no part on either side. Ties go to the smaller
    vec_id, among equal codes too. Equal ids are separate candidates. An empty side gives no rows. Only
    fitting uses a sample (``sample`` rows by hash of the id); the index holds every row. Each query probes
    as many lists as ``target`` of true neighbours ask for in a trial, and on until they hold 2 k rows.
    Vectors of another length than most take no part (of two lengths as common the smaller counts).
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v")))
    rows = pick(vectors)
    n, dims = rows.agg(F.count("*"), F.mode(F.size("v"), True)).first()
    rows = rows.where(F.size("v") == dims) if n else rows
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, 1.5 * sample / n)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample).select("v").toArrow()  # bounded by ``sample``
    if not len(drawn):
        drawn = rows.limit(sample).select("v").toArrow()
    model = Quantizer(unit(_matrix(drawn.column("v").combine_chunks())), min(MAX_LISTS, max(1, int(2 * np.sqrt(n)))), seed)
    shared = spark.sparkContext.broadcast(model)  # MAX_LISTS and CODES bound its size

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, codes, error = shared.value.encode(unit(_matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["vec_id", "v", "list", "code", "error"])

    index = settle(rows.mapInArrow(encode, "vec_id long, v array<double>, list int, code binary, error double"), "ann-index")
    asked = pick(queries).where(F.size("v") == dims).toDF("query_id", "q").distinct()
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MAX_LISTS rows
    probes = probes_needed(index, asked, shared, k, target)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.array([sizes.get(c, 0) for c in range(len(shared.value.coarse))])
        for batch in batches:
            if batch.num_rows:
                lists = shared.value.probes(unit(_matrix(batch.column(1))), len(held)).astype(np.int32)
                enough = (np.cumsum(held[lists], axis=1) < 2 * k + 1).sum(axis=1) + 1
                picked = [row[: max(probes, m)] for row, m in zip(lists, enough, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(picked, pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    probed = settle(asked.mapInArrow(probe, "query_id long, q array<double>, lists array<int>"), "ann-queries")
    wanted = probed.select("query_id", "q", F.explode("lists").alias("list"))
    asking = {r["list"]: r["n"] for r in wanted.groupBy("list").agg(F.count("*").alias("n")).collect()}
    cuts = [(c, -(-sizes[c] // CELL_ROWS), -(-asking.get(c, 1) // CELL_QUERIES)) for c in sizes]
    grid = F.broadcast(spark.createDataFrame(cuts, "list int, v_cuts long, q_cuts long"))  # MAX_LISTS rows
    key = ["list", "v_cut", "q_cut"]
    left = index.join(grid, "list").withColumn("v_cut", F.pmod(F.xxhash64("vec_id", "v"), F.col("v_cuts")))
    left = left.withColumn("q_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_cuts") - 1))).select(*key, "vec_id", "v", "code", "error")
    right = wanted.join(grid, "list").withColumn("q_cut", F.pmod(F.xxhash64("query_id", "q"), F.col("q_cuts")))
    right = right.withColumn("v_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v_cuts") - 1))).select(*key, "query_id", "q")

    def scan(cell: tuple, have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(have) and len(want):
            have = have.sort_values("vec_id", kind="stable")
            ids, x = have["vec_id"].to_numpy(), _matrix(have["v"])
            codes = np.frombuffer(b"".join(have["code"]), np.uint8).reshape(len(ids), -1)
            error = have["error"].to_numpy()
            names, qs = want["query_id"].to_numpy(), _matrix(want["q"])
            for i in range(0, len(names), BLOCK):
                near = shared.value.code_distances(unit(qs[i : i + BLOCK]), int(cell[0]), codes)
                for name, q, d in zip(names[i : i + BLOCK], qs[i : i + BLOCK], near, strict=True):
                    d[ids == name] = np.inf
                    best = np.argsort(d, kind="stable")[:refine]
                    best = best[np.isfinite(d[best])]
                    exact = cosine(q, x[best])
                    far = np.sqrt(np.maximum(2 - 2 * np.sort(exact)[-k], 0)) if len(best) >= k else np.inf
                    more = (np.sqrt(d) - error <= far + SLACK) & np.isfinite(d)
                    more[best] = False
                    rest = np.flatnonzero(more)
                    best, exact = np.append(best, rest), np.append(exact, cosine(q, x[rest]))
                    top = np.lexsort((ids[best], -exact))[:k]
                    found += zip([name] * len(top), ids[best[top]].tolist(), exact[top].tolist(), strict=True)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    hits = left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows for each cell that a query probed
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
