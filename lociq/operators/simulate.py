"""Simulated summary statistics: Z of all traits at each SNP from S, LD scores and overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simulate(scores: DataFrame, S: np.ndarray, n: np.ndarray, m: float, overlap: float | np.ndarray = 0.99, rho: np.ndarray | None = None, intercepts: np.ndarray | None = None, replicates: int = 1, seed: int = 1234) -> DataFrame:
    """iter, trait, SNP, N, Z, A1 for each replicate and row of scores (SNP, L2).

    Var Z_i = N_i S_ii / m L2 + a_i; Cov = sqrt(N_i N_j) S_ij / m L2 + rho_ij N_ij / sqrt(N_i N_j). Each SNP's draws are
    seeded by the seed, the replicate and its name, whatever the partition.
    """
    k = len(S)
    n = np.asarray(n, float)
    size = np.sqrt(np.outer(n, n))
    shared = np.minimum.outer(n, n) * overlap if np.isscalar(overlap) else np.asarray(overlap, float)
    d = np.sqrt(np.diag(S))
    rho = S / np.outer(d, d) if rho is None else rho
    noise = rho * shared / size
    np.fill_diagonal(noise, 1.0 if intercepts is None else intercepts)
    slope = size * S / m

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cov = slope[None] * batch["L2"].to_numpy(float)[:, None, None] + noise[None]
            values, vectors = np.linalg.eigh(cov)
            root = vectors * np.sqrt(np.maximum(values, 0))[:, None, :]
            z = np.stack([np.random.default_rng([seed, int(i), int(h) & 0xFFFFFFFF, int(h) >> 32 & 0xFFFFFFFF]).standard_normal(k) for i, h in zip(batch["iter"], batch["hash"], strict=True)]) if len(batch) else np.zeros((0, k))
            out = np.einsum("bij,bj->bi", root, z)
            yield pd.concat([pd.DataFrame({"iter": batch["iter"], "trait": t, "SNP": batch["SNP"], "N": n[t], "Z": out[:, t], "A1": "A"}) for t in range(k)])

    # draws take far longer than the bytes of a row tell, so each task gets its share of the SNPs
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    snps = scores.select("SNP", F.col("L2").cast("double").alias("L2"), F.xxhash64("SNP").alias("hash")).repartition(parts, "hash")
    rows = snps.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return rows.mapInPandas(draw, "iter int, trait int, SNP string, N double, Z double, A1 string")
