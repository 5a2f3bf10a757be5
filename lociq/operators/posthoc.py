"""Work on estimated covariance structures: indices, generalised least squares, parallel analysis, local SRMD."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions.normal import two_sided_p
from lociq.operators.ldsc import vech_index
from lociq.sources.tables import Covariance


def index_s(spark: SparkSession, names: Sequence[str], diagonal: bool = True) -> DataFrame:
    """pos, row, col: places in vech(S), column by column, of each pair of traits."""
    rows = [(u, names[i], names[j]) for u, (i, j) in enumerate(vech_index(len(names))) if diagonal or i != j]
    return spark.createDataFrame(rows, "pos int, row string, col string")


def sub_sv(c: Covariance, places: Sequence[int], kind: str = "S") -> tuple[np.ndarray, np.ndarray]:
    """(values, sampling covariance) at places of vech: of S, of S_stand, or of correlations R (standardised)."""
    S, V = (c.S, c.V) if kind == "S" else (c.S_stand, c.V_stand)
    if S is None or V is None:
        raise ValueError(f"the structure holds nothing for {kind}")
    flat = np.array([S[i, j] for i, j in vech_index(len(S))])
    return flat[list(places)], V[np.ix_(places, places)]


def summary_gls(y: np.ndarray, V: np.ndarray, X: np.ndarray, intercept: bool = True) -> pd.DataFrame:
    """betas, pvals, SE, Z of generalised least squares."""
    X = np.column_stack([np.ones(len(y)), X]) if intercept else np.atleast_2d(X.T).T
    W = np.linalg.inv(V)
    cov = np.linalg.inv(X.T @ W @ X)
    beta = cov @ X.T @ W @ y
    se = np.sqrt(np.abs(np.diag(cov)))
    return pd.DataFrame({"betas": beta, "pvals": two_sided_p(beta / se), "SE": se, "Z": beta / se})


def gls_bands(y: np.ndarray, V: np.ndarray, x: np.ndarray, controls: np.ndarray | None = None, intervals: int = 20, band_size: float = 1.0, quad: bool = False, x_range: tuple[float, float] | None = None) -> pd.DataFrame:
    """Predictors, Fit, Upper, Lower over a grid (right end left out): at each point the predictor is shifted there, so
    the first coefficient and its standard error are the fit and its band."""
    low, high = x_range or (float(x.min()), float(x.max()))
    rows = []
    for at in low + np.arange(intervals) * (high - low) / intervals:
        X = [x - at, (x - at) ** 2] if quad else [x - at]
        if controls is not None:
            X += list(np.atleast_2d(controls.T))
        got = summary_gls(y, V, np.column_stack(X))
        fit, se = got["betas"][0], got["SE"][0]
        rows.append((at, fit, fit + band_size * se, fit - band_size * se))
    return pd.DataFrame(rows, columns=["Predictors", "Fit", "Upper", "Lower"])


def draw(mean: np.ndarray, V: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One draw of a multivariate normal: by Cholesky, by eigenvectors where V isn't positive definite."""
    z = rng.standard_normal(len(mean))
    try:
        return mean + np.linalg.cholesky(V) @ z
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(V)
        return mean + vectors @ (np.sqrt(np.maximum(values, 0)) * z)


def near_correlation(m: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The nearest correlation matrix with positive eigenvalues, by alternating projections."""
    x, fix = m.copy(), np.zeros_like(m)
    for _ in range(rounds):
        r = x - fix
        values, vectors = np.linalg.eigh(r)
        y = (vectors * np.maximum(values, 1e-8 * values[-1])) @ vectors.T
        fix = y - r
        new = y.copy()
        np.fill_diagonal(new, 1.0)
        if np.linalg.norm(new - x) <= 1e-7 * np.linalg.norm(x):
            return new
        x = new
    return x


def minres(R: np.ndarray, factors: int = 1) -> np.ndarray:
    """Communalities of minimum-residual factor analysis: projected gradient steps on the uniquenesses."""
    smc = 1 - 1 / np.diag(np.linalg.inv(R))
    top = np.maximum(1.0, smc)
    psi = np.clip(1 - smc, 0.005, top)

    def loss(psi: np.ndarray) -> tuple[float, np.ndarray]:
        values, vectors = np.linalg.eigh(R - np.diag(psi))
        v, e = vectors[:, -factors:], np.maximum(values[-factors:], 0)
        rest = R - (v * e) @ v.T
        d = np.diag(rest) - psi
        np.fill_diagonal(rest, 0)
        return float((rest**2).sum() / 2 + (d**2).sum() / 2), -d

    f, g = loss(psi)
    for _ in range(1000):
        size = 1.0
        while size > 1e-12:
            new = np.clip(psi - size * g, 0.005, top)
            f_new, g_new = loss(new)
            if f_new <= f - 1e-4 * (g * (psi - new)).sum():
                break
            size /= 2
        moved, psi, f, g = np.abs(new - psi).max(), new, f_new, g_new
        if moved < 1e-9:
            break
    values, vectors = np.linalg.eigh(R - np.diag(psi))
    return ((vectors[:, -factors:] ** 2) * np.maximum(values[-factors:], 0)).sum(axis=1)


def spectrum(S: np.ndarray, factor_analysis: bool, factors: int) -> np.ndarray:
    if not factor_analysis:
        return np.linalg.eigvalsh(S)[::-1]
    d = np.sqrt(np.abs(np.diag(S)))
    R = near_correlation(S / np.outer(d, d))
    np.fill_diagonal(R, minres(R, factors))
    return np.linalg.eigvalsh(R)[::-1]


def quantiles(df: DataFrame, by: str, value: str, p: float, name: str) -> DataFrame:
    """The p-quantile of a column in each group, linear between the two nearest values (type 7)."""
    return df.groupBy(by).agg(F.percentile(value, p).alias(name))


def parallel_analysis(spark: SparkSession, S: np.ndarray, V: np.ndarray, r: int = 500, p: float = 0.95, seed: int = 1, diagonal: bool = False, factor_analysis: bool = False, factors: int = 1) -> tuple[DataFrame, int | None]:
    """(rank, observed, parallel; number of factors): eigenvalues against the p-quantile of those of ``r`` draws around a
    covariance without correlations. Draws are dealt out by number, each with a seed of its own, so the result doesn't
    depend on the partitions. With ``diagonal`` only the sampling variances count. The number is None if every rank exceeds its parallel."""
    k = len(S)
    index = vech_index(k)
    mean = np.array([S[i, j] if i == j else 0.0 for i, j in index])
    W = np.diag(np.diag(V)) if diagonal else V

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                flat = draw(mean, W, np.random.default_rng([seed, int(i)]))
                m = np.zeros((k, k))
                for (a, b), x in zip(index, flat, strict=True):
                    m[a, b] = m[b, a] = x
                rows += [(int(i), u, float(e)) for u, e in enumerate(spectrum(m, factor_analysis, factors))]
            yield pd.DataFrame(rows, columns=["id", "rank", "value"])

    drawn = spark.range(r).mapInPandas(simulate, "id long, rank int, value double")
    limits = quantiles(drawn, "rank", "value", p, "parallel")
    seen = spark.createDataFrame([(u, float(x)) for u, x in enumerate(spectrum(S, factor_analysis, factors))], "rank int, observed double")
    out = seen.join(limits, "rank").orderBy("rank")
    below = [x["rank"] for x in out.collect() if x["observed"] < x["parallel"]]
    return out, min(below, default=None)


def local_srmd(df: DataFrame) -> DataFrame:
    """local_srmd of rows (unconstrained, constrained, sd_left, sd_right): root mean square of their differences in
    units of the pooled standard deviations."""
    d = F.try_divide(F.col("unconstrained") - F.col("constrained"), F.col("sd_left") * F.col("sd_right"))
    return df.agg(F.sqrt(F.avg(d * d)).alias("local_srmd"))


def scree(observed: DataFrame) -> DataFrame:
    """What a scree plot draws: series, rank (from 1), value."""
    return observed.select(F.expr("stack(2, 'observed', observed, 'parallel', parallel) as (series, value)"), (F.col("rank") + 1).alias("rank"))
