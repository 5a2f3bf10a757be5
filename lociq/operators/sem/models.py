"""Models of one covariance structure: common factor, any model text, genetic correlations."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.operators.ldsc import rescale, vech_index
from lociq.operators.sem.fit import Fit, fit, fit_dwls
from lociq.operators.sem.model import compile_model, subset
from lociq.operators.sem.text import parse
from lociq.sources.tables import Covariance

RESULT = "lhs string, op string, rhs string, est double, se double, std_est double, std_se double, std_all double, z double, p double"
FIT = "chisq double, df int, p_chisq double, aic double, cfi double, srmr double, converged boolean"


def narrowed(c: Covariance, names: Sequence[str]) -> Covariance:
    """The structure of some of the traits, in their order in c."""
    at = [i for i, n in enumerate(c.names) if n in set(names)]
    index = vech_index(len(c.names))
    where = {ij: u for u, ij in enumerate(index)}
    keep = [where[max(at[i], at[j]), min(at[i], at[j])] for i, j in vech_index(len(at))]
    return Covariance([c.names[i] for i in at], c.S[np.ix_(at, at)], c.V[np.ix_(keep, keep)], c.I[np.ix_(at, at)], np.asarray(c.N)[keep] if np.size(c.N) == len(index) else c.N, c.m)


def fit_text(text: str, c: Covariance, estimation: str = "DWLS", std_lv: bool = False, toler: float | None = None) -> Fit:
    """Fit a model text to the traits it names. A fit that doesn't converge is tried again with
    residual variances of the observed variables bounded above .0001."""
    c = narrowed(c, subset(text, c.names))
    model = compile_model(text, c.names, c.S, std_lv)
    first = fit(model, c.S, c.V, estimation, toler=toler)
    if first.converged:
        return first
    bounded = compile_model(text + "".join(f"\n{n} ~~ rv_{n}*{n}\nrv_{n} > .0001" for n in c.names if not re.search(rf"(?<![\w.]){re.escape(n)}\s*~~[^\n]*\b{re.escape(n)}(?![\w.])", text)), c.names, c.S, std_lv)
    second = fit(bounded, c.S, c.V, estimation, toler=toler)
    return second if second.converged else first


def standardised(got: Fit, estimation: str = "DWLS") -> Fit | None:
    """The model of a fit, fitted anew to the covariance scaled to variances of 1 and its sampling covariance, so that its estimates on
    that scale have standard errors of their own. None where a variance isn't positive."""
    d = np.diag(got.S)
    if not (np.isfinite(d) & (d > 0)).all():
        return None
    S, V = rescale(got.S, got.V, 1 / np.sqrt(d))
    model = replace(got.model, start=got.model.start.copy())
    return fit(model, S, V, estimation)


def common_factor_text(names: Sequence[str]) -> str:
    return f"F1 =~ NA*{' + '.join(names)}\nF1 ~~ 1*F1"


def common_factor(c: Covariance, estimation: str = "DWLS", toler: float | None = None) -> Fit:
    """One factor behind all traits, its variance 1."""
    return fit_text(common_factor_text(c.names), c, estimation, toler=toler)


def user_model(c: Covariance, text: str, estimation: str = "DWLS", std_lv: bool = False, toler: float | None = None) -> Fit:
    parse(text)
    return fit_text(text, c, estimation, std_lv, toler)


def fit_many(structures: DataFrame, text: str, names: Sequence[str], std_lv: bool = False) -> DataFrame:
    """One model for many covariance structures, such as those of regions: the columns of ``structures`` but S and weights, then lhs, op, rhs,
    est and converged of each parameter. S holds a structure's lower triangle column by column, weights one for each of its elements. A row with
    a null in either, or with too few elements, has no estimates; nor has a fit that ends at no minimum. A batch of rows is fitted as a stack."""
    kept = [c for c in structures.columns if c not in ("S", "weights")]
    kinds, k = dict(structures.dtypes), len(names)
    index = vech_index(k)
    model = compile_model(text, names, np.eye(k), std_lv)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers = [[np.asarray(x if x is not None else [], float) for x in batch[c]] for c in ("S", "weights")]
            fine = np.array([len(a) == len(b) == len(index) and np.isfinite(a).all() and np.isfinite(b).all() for a, b in zip(*numbers, strict=True)], bool)
            s, w = (np.array([x if ok else np.ones(len(index)) for x, ok in zip(c, fine, strict=True)]).reshape(-1, len(index)) for c in numbers)
            S = np.zeros((len(batch), k, k))
            for u, (i, j) in enumerate(index):
                S[:, i, j] = S[:, j, i] = s[:, u]
            theta, ok = fit_dwls(model, S, w)
            for p in model.parameters:
                est = theta[:, p.free] if p.free >= 0 else np.full(len(batch), p.value)
                yield batch[kept].assign(lhs=p.lhs, op=p.op, rhs=p.rhs, est=np.where(fine & ok, est, np.nan), converged=fine & ok)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "lhs string, op string, rhs string, est double, converged boolean"])
    picked = structures.select(*(F.col(f"`{c}`") for c in kept), F.col("S").cast("array<double>").alias("S"), F.col("weights").cast("array<double>").alias("weights"))
    return picked.mapInPandas(run, schema).withColumn("est", F.when(~F.isnan("est"), F.col("est")))


def genetic_correlations(c: Covariance, estimation: str = "DWLS") -> tuple[np.ndarray, np.ndarray]:
    """(R, V_R): correlations of unit-variance latents, one behind each trait, and their sampling covariance (of
    the pairs in vech order without the diagonal)."""
    k = len(c.names)
    lines = [f"L{i} =~ NA*{n}\nL{i} ~~ 1*L{i}\n{n} ~~ 0*{n}" for i, n in enumerate(c.names)]
    lines += [f"L{j} ~~ L{i}" for i, j in vech_index(k) if i != j]
    model = compile_model("\n".join(lines), c.names, c.S)
    for p in model.parameters:  # start where the solution lies
        if p.free >= 0 and p.op == "=~":
            model.start[p.free] = np.sqrt(max(c.S[model.observed.index(p.rhs), model.observed.index(p.rhs)], 1e-8))
    got = fit(model, c.S, c.V, estimation)
    R, free = np.eye(k), []
    for j, i in vech_index(k):
        if i != j:
            p = next(p for p in model.parameters if p.op == "~~" and {p.lhs, p.rhs} == {f"L{i}", f"L{j}"})
            R[i, j] = R[j, i] = got.theta[p.free]
            free.append(p.free)
    return R, got.cov[np.ix_(free, free)]


def result_frames(spark: SparkSession, got: Fit, estimation: str = "DWLS", cfi: bool = True) -> tuple[DataFrame, DataFrame]:
    """(parameters, fit) as frames; NaN as null. std_est and std_se are those of the standardised refit; CFI, if asked for, comes from a fit
    of the model of variances alone."""
    null = lambda x: None if isinstance(x, float) and not np.isfinite(x) else x
    again = standardised(got, estimation)
    scaled = again.estimates() if again else [{"est": np.nan, "se": np.nan}] * len(got.estimates())
    each = [x | {"std_est": y["est"], "std_se": y["se"]} for x, y in zip(got.estimates(), scaled, strict=True)]
    names = [c.split()[0] for c in RESULT.split(", ")]
    rows = [tuple(null(float(x[c])) if c not in ("lhs", "op", "rhs") else x[c] for c in names) for x in each]
    stats = (float(got.chisq), got.df, got.p, float(got.aic), float(got.cfi(estimation)) if cfi and got.df > 0 else np.nan, got.srmr, got.converged)
    return spark.createDataFrame(rows, RESULT), spark.createDataFrame([tuple(null(x) for x in stats)], FIT)
