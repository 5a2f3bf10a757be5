"""Multivariate LD-score regression with a block jackknife.

All cells (a trait's heritability, a pair's covariance) go through the same few grouped aggregates at once:
means for the weights, sums of weights, then block sums of the 2 x 2 normal equations. What reaches the driver
is one row for each cell and block. The rows of all cells are dealt by range of cell and place, written once, and numbered
by counts of the ranges; no task orders a whole cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.functions.rows import keep, with_position, with_row_number
from lociq.sources.tables import Covariance

CELL = ["i", "j"]


@dataclass(frozen=True)
class Prevalence:
    """Share of cases in the sample and in the population; None for a quantitative trait."""

    sample: float | None = None
    population: float | None = None


def blocks_for(n_traits: int, n_blocks: int) -> int:
    return (n_traits + 1) * (n_traits + 2) // 2 + 1 if n_traits > 18 else n_blocks


def liability(p: Prevalence) -> float:
    """Factor from the observed to the liability scale."""
    if p.sample is None or p.population is None:
        return 1.0
    k = p.population
    density = NormalDist().pdf(NormalDist().inv_cdf(1 - k))
    return k**2 * (1 - k) ** 2 / (p.sample * (1 - p.sample) * density**2)


def finite(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in columns))


def joined_traits(traits: Sequence[DataFrame], scores: DataFrame, weights: DataFrame, chisq_max: float | None = None, cap: str = "first") -> DataFrame:
    """trait, SNP, CHR, BP, N, Z, A1, L2, wLD of all traits with chi-square up to the cap: chisq_max, or the larger of
    80 and a thousandth of the largest N of the first trait (cap="first") or of each (cap="each"). A column ``_row`` comes along."""
    numbered = ["_row"] if all("_row" in t.columns for t in traits) else []
    long = reduce(DataFrame.union, (t.select(F.lit(i).alias("trait"), "SNP", "N", "Z", "A1", *numbered).dropna() for i, t in enumerate(traits)))
    rows = keep(long.join(weights.select("SNP", "wLD"), "SNP").join(scores.select("SNP", "CHR", "BP", "L2"), "SNP"))  # read by all that follows
    if chisq_max is None:
        highest = dict(rows.where(~F.isnan("N")).groupBy("trait").agg(F.max("N")).collect())  # one row for each trait
        caps = {i: max(0.001 * highest.get(0 if cap == "first" else i, 0.0), 80.0) for i in range(len(traits))}
        limit = F.element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("trait"))
    else:
        limit = F.lit(float(chisq_max))
    return rows.where((F.col("Z") * F.col("Z") <= limit) & finite("L2", "wLD", "N", "Z"))


def cells(rows: DataFrame) -> DataFrame:
    """i, j, SNP, CHR, BP, L2, wLD, n1, n2, c1, c2, y: every trait with itself (y = chi-square) and with each later
    one (y = product of Z, aligned on A1); LD scores, and ``_row`` where there is one, as the first of a pair has them."""
    kept = ["SNP", "CHR", "BP", *(c for c in rows.columns if c == "_row"), "L2", "wLD"]
    own = rows.select(F.col("trait").alias("i"), F.col("trait").alias("j"), *kept, F.col("N").alias("n1"), F.col("N").alias("n2"), *((F.col("Z") * F.col("Z")).alias(c) for c in ("c1", "c2", "y")))
    b = rows.select(F.col("trait").alias("j"), "SNP", F.col("N").alias("n2"), F.col("Z").alias("z2"), F.col("A1").alias("a2"))
    pair = rows.withColumnRenamed("trait", "i").join(b, "SNP").where(F.col("i") < F.col("j"))
    aligned = F.when(F.col("A1") != F.col("a2"), -F.col("Z")).otherwise(F.col("Z"))
    pair = pair.select("i", "j", *kept, F.col("N").alias("n1"), "n2", (F.col("Z") * F.col("Z")).alias("c1"), (F.col("z2") * F.col("z2")).alias("c2"), (aligned * F.col("z2")).alias("y"))
    return own.union(pair)


def _weight(agg: str, n: str, m: float) -> Column:
    one = F.lit(1.0)
    spread = 1 + F.col(agg) * F.col(n) / m * F.greatest("L2", one)
    return F.sqrt(1 / (2 * spread * spread) / F.greatest("wLD", one))


def weighted(cell_rows: DataFrame, m: float) -> DataFrame:
    """Adds wx, wy: normalised regression weights of predictor and response."""
    mean = cell_rows.groupBy(CELL).agg(F.avg("c1").alias("m1"), F.avg("c2").alias("m2"), F.avg(F.col("L2") * F.col("n1")).alias("l1"), F.avg(F.col("L2") * F.col("n2")).alias("l2n"))
    share = lambda c, l: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(m * (F.col(c) - 1), F.col(l)))), F.lit(0.0))  # noqa: E731, E741
    shares = mean.select(*CELL, share("m1", "l1").alias("g1"), share("m2", "l2n").alias("g2"))
    w = cell_rows.join(F.broadcast(shares), CELL).withColumns({"w1": _weight("g1", "n1", m), "w2": _weight("g2", "n2", m)})  # one row for each cell
    least = F.when(F.col("i") == F.col("j"), 0.0).otherwise(1.0)
    sums = w.groupBy(CELL).agg(F.sum("w1").alias("s1"), F.sum(F.col("w1") + F.col("w2")).alias("s12"))
    return w.join(F.broadcast(sums), CELL).withColumns({"wx": F.try_divide(F.col("w1"), F.greatest("s1", least)), "wy": F.try_divide(F.col("w1") + F.col("w2"), F.greatest("s12", least))})


def in_blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Adds rn, n_cell and block, in order of CHR, BP, SNP, or of ``_row`` where there is one, within each cell: block b begins at
    floor(1 + b (n - 1) / B) - 1."""
    numbered = with_position(rows, ("_row",) if "_row" in rows.columns else ("CHR", "BP", "SNP"), CELL, "rn", "n_cell")
    return numbered.withColumn("block", F.expr(f"cast(least({n_blocks - 1}, ((rn + 1) * {n_blocks} - 1) div greatest(n_cell - 1, 1)) as int)"))


def block_sums(rows: DataFrame, n_blocks: int) -> DataFrame:
    """xx, x1, oo, xy, y1 of the normal equations for each cell and block."""
    x, one, y = F.col("L2") * F.col("wx"), F.col("wx"), F.col("y") * F.col("wy")
    sums = {"xx": x * x, "x1": x * one, "oo": one * one, "xy": x * y, "y1": one * y}
    placed = rows if "block" in rows.columns else in_blocks(rows, n_blocks)
    return placed.groupBy(*CELL, "block").agg(*(F.sum(v).alias(k) for k, v in sums.items()))


def jackknife(xtx: np.ndarray, xty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, pseudo-values by block) of normal equations summed by block: (B, p, p) and (B, p)."""
    n = len(xtx)
    full = np.linalg.solve(xtx.sum(axis=0), xty.sum(axis=0))
    without = np.linalg.solve(xtx.sum(axis=0) - xtx, (xty.sum(axis=0) - xty)[..., None])[..., 0]
    return full, n * full - (n - 1) * without


def vech_index(k: int) -> list[tuple[int, int]]:
    """(row, column) of the lower triangle, column by column."""
    return [(i, j) for j in range(k) for i in range(j, k)]


def vech(m: np.ndarray) -> np.ndarray:
    return np.array([m[i, j] for i, j in vech_index(len(m))])


def ldsc(traits: Sequence[DataFrame], scores: DataFrame, weights: DataFrame, m: float, names: Sequence[str], prevalences: Sequence[Prevalence] | None = None, n_blocks: int = 200, chisq_max: float | None = None, cap: str = "first", stand: bool = False, order: str = "place") -> tuple[Covariance, list[dict]]:
    """The covariance structure of traits, and a report of each cell: h2 or covariance, intercept, their standard
    errors, Z and mean chi-square. Blocks of the jackknife follow CHR, BP, SNP (order="place"), or the rows of the cell's first trait as its
    table has them (order="input"; a table read from files has them in the order of the files and their lines)."""
    k = len(traits)
    if order not in ("place", "input"):
        raise ValueError(f"order is place or input, not {order}")
    traits = [with_row_number(t.drop("_row"), "_row") if order == "input" else t.drop("_row") for t in traits]
    n_blocks = blocks_for(k, n_blocks)
    all_cells = weighted(in_blocks(cells(joined_traits(traits, scores, weights, chisq_max, cap)), n_blocks), m)
    means = {(r["i"], r["j"]): r for r in all_cells.groupBy(CELL).agg(F.avg("n1").alias("n1"), F.avg("n2").alias("n2"), F.avg("y").alias("y"), F.count("*").alias("n")).collect()}
    sums = {(r["i"], r["j"], r["block"]): r for r in block_sums(all_cells, n_blocks).collect()}  # cells times blocks
    S, I = np.full((k, k), np.nan), np.full((k, k), np.nan)  # noqa: E741
    slopes, sizes, report = [], [], []
    for j, i in vech_index(k):
        rows = [sums.get((i, j, b)) for b in range(n_blocks)]
        get = lambda c, rows=rows: np.array([r[c] if r else 0.0 for r in rows])
        xtx = np.stack([np.stack([get("xx"), get("x1")], -1), np.stack([get("x1"), get("oo")], -1)], -2)
        beta, pseudo = jackknife(xtx, np.stack([get("xy"), get("y1")], -1))
        mean = means[i, j]
        n_bar = np.sqrt(mean["n1"] * mean["n2"])
        se = np.sqrt(pseudo.var(axis=0, ddof=1) / n_blocks)
        S[i, j] = S[j, i] = beta[0] / n_bar * m
        I[i, j] = I[j, i] = beta[1]
        slopes.append(pseudo[:, 0])
        sizes.append(n_bar)
        report.append({"i": names[i], "j": names[j], "estimate": S[i, j], "se": se[0] / n_bar * m, "intercept": beta[1], "intercept_se": se[1], "mean": mean["y"], "snps": mean["n"]})
    sizes = np.array(sizes)
    scale = sizes * np.sqrt(n_blocks) / m
    V = np.atleast_2d(np.cov(np.array(slopes))) / np.outer(scale, scale)
    root = np.sqrt([liability(p) for p in prevalences or [Prevalence()] * k])
    S, V = rescale(S, V, root)
    S_stand = V_stand = None
    if stand and (np.diag(S) > 0).all():
        S_stand, V_stand = rescale(S, V, 1 / np.sqrt(np.diag(S)))
    return Covariance(list(names), S, V, I, sizes, m, S_stand, V_stand), report


def rescale(S: np.ndarray, V: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S and V with each trait multiplied by a factor."""
    by = np.outer(factor, factor)
    return S * by, V * np.outer(vech(by), vech(by))


def genomic_control(rows: DataFrame) -> DataFrame:
    """trait, lambda_gc: median chi-square over the median of its distribution."""
    middle = NormalDist().inv_cdf(0.75) ** 2
    return rows.groupBy("trait").agg((F.median(F.col("Z") * F.col("Z")) / middle).alias("lambda_gc"))
