"""Stratified LD-score regression: p annotations at once, normal equations as packed sums by block.

With dozens of annotations the cross-products number thousands; each partition adds up one matrix for each
block (numpy), and Spark adds the matrices up. The driver gets one matrix for each cell and block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.functions.rows import keep, sum_arrays, with_position
from lociq.operators.ldsc import CELL, Prevalence, finite, jackknife, liability, rescale, vech_index
from lociq.sources.tables import StratifiedCovariance


def with_features(scores: DataFrame, annotations: Sequence[str]) -> DataFrame:
    """SNP, CHR, BP, features (LD scores of the annotations in order)."""
    return scores.select("SNP", "CHR", "BP", F.array(*(F.col(f"`{a}`").cast("double") for a in annotations)).alias("features"))


def continuous(annot: DataFrame, annotations: Sequence[str]) -> list[str]:
    """Annotations with any value but 0 and 1."""
    told = annot.agg(*(F.max(F.coalesce(~F.col(f"`{a}`").isin(0.0, 1.0), F.lit(False))).alias(f"c{i}") for i, a in enumerate(annotations))).first()
    return [a for i, a in enumerate(annotations) if told[i]]


def flanking(name: str) -> int:
    """2 for a flanking annotation, else 1."""
    return 2 if "flanking" in name else 1


def overlap(annot: DataFrame, annotations: Sequence[str]) -> np.ndarray:
    """Cross-products of the annotations over SNPs."""
    k = len(annotations)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for batch in batches:
            x = batch.to_numpy(float)
            total += x.T @ x
        i, j = np.indices((k, k))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    sums = annot.select(*(F.col(f"`{a}`").cast("double").alias(f"c{i}") for i, a in enumerate(annotations))).mapInPandas(part, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    out = np.zeros((k, k))
    for r in sums.collect():  # annotations squared
        out[r["i"], r["j"]] = r["x"]
    return out


def common_snps(annot: DataFrame, frequencies: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows of annot whose SNP has a frequency strictly between the bounds."""
    return annot.join(frequencies.where((F.col("MAF") > low) & (F.col("MAF") < high)).select("SNP").distinct(), "SNP", "left_semi")


def _weight(share: str, n: str, m: float) -> Column:
    spread = 1 + F.col(share) * F.col(n) / m * F.greatest("total", F.lit(1.0))
    return F.sqrt(1 / (2 * spread * spread) / F.greatest("wLD", F.lit(1.0)))


def block_matrices(rows: DataFrame, p: int, n_blocks: int) -> dict[tuple[int, int, int], np.ndarray]:
    """(i, j, block) -> (p + 1) x (p + 2) sums of [x, w]' [x, w, y], over rows of (i, j, CHR, BP, SNP, x array, w, y): the places of each
    cell's rows in order of CHR, BP, SNP are cut into blocks of equal length."""
    placed = rows if "rn" in rows.columns else with_position(rows, ("CHR", "BP", "SNP"), CELL, "rn", "n_cell")
    told = placed.withColumn("block", F.expr(f"cast(rn * {n_blocks} div n_cell as int)"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, some in batch.groupby([*CELL, "block"]):
                x = np.column_stack([np.stack(some["x"].to_list()), some["w"]])
                total[key] = total.get(key, 0) + x.T @ np.column_stack([x, some["y"]])
        yield pd.DataFrame([(*map(int, key), t.ravel()) for key, t in total.items()], columns=[*CELL, "block", "sums"])

    parts = told.select(*CELL, "block", "x", "w", "y").mapInPandas(part, "i int, j int, block int, sums array<double>")
    return {(r["i"], r["j"], r["block"]): np.array(r["sums"]).reshape(p + 1, p + 2) for r in sum_arrays(parts, [*CELL, "block"], "sums").collect()}


def cells(traits: Sequence[DataFrame], base: DataFrame) -> DataFrame:
    """i, j, CHR, BP, SNP, features, total, wLD, n1, n2, c1, c2, y: every trait with itself and with each later one, as in ldsc.cells;
    chi-square up to the larger of 80 and a thousandth of the trait's largest N."""
    long = reduce(DataFrame.union, (t.select(F.lit(i).alias("trait"), "SNP", "N", "Z", "A1").dropna() for i, t in enumerate(traits)))
    rows = keep(long.join(base, "SNP"))  # read by all that follows
    highest = dict(rows.where(~F.isnan("N")).groupBy("trait").agg(F.max("N")).collect())  # one row for each trait
    caps = F.create_map(*(F.lit(x) for i in range(len(traits)) for x in (i, max(0.001 * highest.get(i, 0.0), 80.0))))
    rows = rows.where((F.col("Z") * F.col("Z") <= F.element_at(caps, F.col("trait"))) & finite("N", "Z", "wLD", "total"))
    kept = ["CHR", "BP", "SNP", "features", "total", "wLD"]
    square = F.col("Z") * F.col("Z")
    own = rows.select(F.col("trait").alias("i"), F.col("trait").alias("j"), *kept, F.col("N").alias("n1"), F.col("N").alias("n2"), *(square.alias(c) for c in ("c1", "c2", "y")))
    other = rows.select(F.col("trait").alias("j"), "SNP", F.col("N").alias("n2"), F.col("Z").alias("z2"), F.col("A1").alias("a2"))
    z = F.when(F.col("A1") != F.col("a2"), -F.col("Z")).otherwise(F.col("Z"))
    pair = rows.withColumnRenamed("trait", "i").join(other, "SNP").where(F.col("i") < F.col("j"))
    return own.union(pair.select("i", "j", *kept, F.col("N").alias("n1"), "n2", square.alias("c1"), (F.col("z2") * F.col("z2")).alias("c2"), (z * F.col("z2")).alias("y")))


def s_ldsc(traits: Sequence[DataFrame], scores: DataFrame, annotations: Sequence[str], weights: DataFrame, m: Sequence[float], overlaps: np.ndarray, names: Sequence[str], prevalences: Sequence[Prevalence] | None = None, n_blocks: int = 200) -> StratifiedCovariance:
    """A covariance of the traits for each annotation. scores: SNP, CHR, BP and the annotations' LD scores;
    m: SNPs by annotation; overlaps: cross-products of the annotations. All cells go through the same few aggregates."""
    p, k, m = len(annotations), len(traits), np.array(m, float)
    if p < 2:
        raise ValueError("stratified regression asks for two annotations or more")
    m_total = m[0]
    base = with_features(scores, annotations).join(weights.select("SNP", "wLD"), "SNP")
    base = base.withColumn("total", F.aggregate("features", F.lit(0.0), lambda a, x: a + x))
    rows = with_position(cells(traits, base), ("CHR", "BP", "SNP"), CELL, "rn", "n_cell")
    of_n = [F.avg(F.col("total") * F.col(n)).alias(l) for n, l in (("n1", "l1"), ("n2", "l2"))]
    means = rows.groupBy(CELL).agg(*(F.avg(c).alias(f"m_{c}") for c in ("c1", "c2", "n1", "n2")), *of_n)
    share = lambda c, l: F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(m_total * (F.col(c) - 1), F.col(l)))), F.lit(0.0))  # noqa: E731, E741
    told = means.select(*CELL, share("m_c1", "l1").alias("g1"), share("m_c2", "l2").alias("g2"), F.sqrt(F.col("m_n1") * F.col("m_n2")).alias("n_bar"))
    rows = rows.join(F.broadcast(told), CELL).withColumn("w", _weight("g1", "n1", m_total) + _weight("g2", "n2", m_total))  # one row for each cell
    rows = rows.join(F.broadcast(rows.groupBy(CELL).agg(F.sum("w").alias("total_w"))), CELL).withColumn("w", F.col("w") / F.col("total_w"))
    scale = F.when(F.col("i") == F.col("j"), F.col("n1") / F.col("n_bar")).otherwise(1.0)
    weighed = rows.select(*CELL, "rn", "n_cell", F.transform("features", lambda x: x * scale * F.col("w")).alias("x"), "w", (F.col("y") * F.col("w")).alias("y"))
    blocks = block_matrices(weighed, p, n_blocks)
    n_bars = {(r["i"], r["j"]): r["n_bar"] for r in told.collect()}
    by = np.divide(overlaps, m[None, :], out=np.zeros_like(overlaps, dtype=float), where=m[None, :] != 0)
    index = vech_index(k)
    pseudo, S, S_tau, I, sizes = [], np.zeros((p, k, k)), np.zeros((p, k, k)), np.zeros((k, k)), []  # noqa: E741
    for j, i in index:
        sums = np.stack([blocks.get((i, j, b), np.zeros((p + 1, p + 2))) for b in range(n_blocks)])
        n_bar = n_bars[i, j]
        beta, each = jackknife(sums[:, :, :-1], sums[:, :, -1])
        cats = beta[:p] / n_bar * m
        pseudo.append(each[:, :p] / n_bar * m)
        S[:, i, j] = S[:, j, i] = by @ cats
        S_tau[:, i, j] = S_tau[:, j, i] = cats
        I[i, j] = I[j, i] = beta[p]
        sizes.append(n_bar)
    stacked = np.stack(pseudo)  # cells, blocks, annotations
    centred = stacked - stacked.mean(axis=1, keepdims=True)
    cov = np.einsum("ubf,vbg->uvfg", centred, centred) / (n_blocks - 1) / n_blocks
    V = np.einsum("af,uvfg,ag->auv", by, cov, by)
    V_tau = np.einsum("uvaa->auv", cov)
    root = np.sqrt([liability(x) for x in prevalences or [Prevalence()] * k])
    both = [[rescale(s, v, root) for s, v in zip(*x, strict=True)] for x in ((S, V), (S_tau, V_tau))]
    lists = [[x[c] for x in part] for part in both for c in (0, 1)]
    return StratifiedCovariance(list(names), list(annotations), *lists, I, np.array(sizes), m.tolist(), (m / m[0]).tolist(), [float(flanking(a)) for a in annotations])
