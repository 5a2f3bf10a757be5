"""Heterogeneity of an external trait's relation to a factor: does it act through the factor, or on single indicators?"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lociq.functions.normal import chi2_sf, two_sided_p
from lociq.operators.sem.fit import Fit, fit
from lociq.operators.sem.model import compile_model
from lociq.operators.sem.models import narrowed
from lociq.sources.tables import Covariance

RESULT = (
    "trait string, beta_cpm double, se_cpm double, p_cpm double, Q double, Q_df int, Q_p double, lsrmr_cpm double, heterogeneity_cpm string, "
    "beta_fum double, se_fum double, p_fum double, Q_fum double, Q_df_fum int, Q_p_fum double, lsrmr_fum double, heterogeneity_fum string, unconstrained string"
)


@dataclass(frozen=True)
class Limits:
    mresid: float = 0.25
    mresid_threshold: float = 0.10
    lsrmr: float = 0.25
    lsrmr_threshold: float = 0.10


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x))))


def _residuals(loadings: Sequence[tuple[str, str]]) -> str:
    return f"F1 =~ {' + '.join(f'{m}{n}' for m, n in loadings)}\n" + "\n".join(f"{n} ~~ rv{i}*{n}\nrv{i} > 0.001" for i, (_, n) in enumerate(loadings))


def _model(measured: str, trait: str, indicators: Sequence[str], paths: Sequence[str], through: bool) -> str:
    """The factor with its measurement fixed, the trait behind a latent of variance 1, and what the latent acts on."""
    lines = [measured, f"XF =~ NA*{trait}", f"{trait} ~~ 0*{trait}", "XF ~~ 1*XF"]
    lines += ["F1 ~ XF"] if through else ["F1 ~~ 0*XF"]
    lines += [f"{' + '.join(paths)} ~ XF"] if paths else []
    return "\n".join([*lines, *(["F1 ~~ rvl*F1", "rvl > 0.001"] if paths else [])])


def one_trait(c: Covariance, measured: str, trait: str, indicators: Sequence[str], n_traits: int, limits: Limits) -> dict:
    c = narrowed(c, [*indicators, trait])
    alpha = 0.05 / n_traits
    at, t = [c.names.index(i) for i in indicators], c.names.index(trait)
    d = np.sqrt(np.diag(c.S))
    observed = (c.S / np.outer(d, d))[t, at]

    def run(paths: Sequence[str], through: bool) -> Fit:
        return fit(compile_model(_model(measured, trait, indicators, paths, through), c.names, c.S), c.S, c.V)

    def beta(got: Fit) -> tuple[float, float]:
        p = next(p for p in got.model.parameters if p.key == "F1~XF")
        return float(got.theta[p.free]), float(got.se[p.free])

    def rest(got: Fit) -> np.ndarray:
        e = np.sqrt(np.diag(got.sigma))
        return observed - (got.sigma / np.outer(e, e))[t, at]

    def judge(got: Fit) -> dict:
        b, se = beta(got)
        q, df = (got.chisq - base, got.df - free.df) if got.df else (0.0, 0)
        r = rms(rest(got))
        p, q_p = float(two_sided_p(b / se)) if se > 0 else np.nan, float(chi2_sf(q, df)) if df > 0 else np.nan
        het = p < alpha and q_p < alpha and r > limits.lsrmr_threshold and r > limits.lsrmr * rms(observed)
        return {"beta": b, "se": se, "p": p, "Q": q, "df": df, "Q_p": q_p, "lsrmr": r, "het": het}

    free = run(indicators, False)
    base = free.chisq if np.isfinite(free.chisq) else 0.0
    common = run((), True)
    first = judge(common)
    out = {"trait": trait, "beta_cpm": first["beta"], "se_cpm": first["se"], "p_cpm": first["p"], "Q": first["Q"], "Q_df": first["df"], "Q_p": first["Q_p"], "lsrmr_cpm": first["lsrmr"], "heterogeneity_cpm": "Yes" if first["het"] else "No"}
    outside = lambda r: (np.abs(r) >= limits.mresid_threshold) & (np.abs(r) >= limits.mresid * rms(observed))
    if first["het"]:
        r = rest(common)
        if not outside(r).any():
            return {"trait": trait}
        order = [indicators[i] for i in np.argsort(-np.abs(r), kind="stable")]
        for n in range(1, len(order) + 1):
            got = run(order[:n], True)
            told = judge(got)
            if not (told["het"] and told["df"] and outside(rest(got)).any()):
                break
        out |= {"beta_fum": told["beta"], "se_fum": told["se"], "p_fum": told["p"], "Q_fum": told["Q"], "Q_df_fum": told["df"], "Q_p_fum": told["Q_p"], "lsrmr_fum": told["lsrmr"], "heterogeneity_fum": "Yes" if told["het"] else "No", "unconstrained": ",".join(order[:n])}
    return out


def qtrait(spark: SparkSession, c: Covariance, indicators: Sequence[str], traits: Sequence[str], limits: Limits | None = None) -> DataFrame:
    """A row for each external trait. The common pathway (through the factor alone) is compared with independent
    pathways (to every indicator). If the trait acts, the two differ and residual correlations are large, paths to the
    indicators of largest residual are freed one after the other until they no longer are. Heterogeneous traits
    without an outlying indicator have an empty row. Traits are dealt out as rows."""
    limits = limits or Limits()
    own = narrowed(c, indicators)
    names = list(own.names)
    cfm = fit(compile_model(_residuals([("NA*" if i == 0 else "", n) for i, n in enumerate(names)]) + "\nF1 ~~ 1*F1", names, own.S), own.S, own.V)
    loading = {p.rhs: cfm.theta[p.free] for p in cfm.model.parameters if p.op == "=~"}
    measured = _residuals([(f"{loading[n]:.15f}*", n) for n in names])
    columns = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one_trait(c, measured, t, names, len(traits), limits) for t in batch["trait"]]
            yield pd.DataFrame([[r.get(x) for x in columns] for r in rows], columns=columns, dtype=object)

    dealt = spark.createDataFrame([(t,) for t in traits], "trait string").repartition(min(len(traits), spark.sparkContext.defaultParallelism))
    return dealt.mapInPandas(run, RESULT)
