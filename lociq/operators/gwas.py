"""Per-SNP structural equation models: one compiled model, batches of SNPs as stacked arrays.

The covariance of a SNP with the traits is all that changes from row to row, so a batch is fitted at once in
numpy while Spark deals out the rows. The model and the covariance structure, of fixed size, travel with the
function. Rows are dealt out in order before they are fitted, by their number and not by their size, so results come in order and every
SNP is fitted once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions.normal import chi2_sf, norm_sf
from lociq.functions.qc import by_prefix
from lociq.functions.rows import dealt_in_order, with_row_number
from lociq.operators.sem.fit import fit, fit_dwls, fit_ml, ml_weight, q_statistic, sandwich, smooth, vech_rows, weights_of
from lociq.operators.sem.model import Model, compile_model
from lociq.sources.tables import Covariance

BATCH = 2_000
#: SNPs of a task: as few as that to use all cores, as many at most.
LEAST, MOST = 500, 20_000
RESULT = "lhs string, op string, rhs string, est double, se_c double, Q double, Q_df int, Q_SNP double, Q_SNP_df int, fail string, warning string, Z_smooth double"


#: Columns of the common factor's results, behind those of the SNP.
COMMON = ("lhs", "op", "rhs", "est", "se_c", "Z_Estimate", "Pval_Estimate", "Q", "Q_df", "Q_pval", "Q_SNP", "Q_SNP_df", "fail", "warning", "Z_smooth")


@dataclass(frozen=True)
class Options:
    estimation: str = "DWLS"
    gc: str = "standard"
    snp_se: float = 0.0005
    std_lv: bool = False
    fix_measurement: bool = True
    q_snp: bool = False
    sub: tuple[str, ...] = ()
    predictor: str = "SNP"
    toler: float | None = None


def intercepts(I: np.ndarray) -> np.ndarray:  # noqa: E741
    """Diagonal raised to 1."""
    out = I.copy()
    np.fill_diagonal(out, np.maximum(np.diag(out), 1.0))
    return out


def snp_covariances(beta: np.ndarray, se: np.ndarray, var: np.ndarray, c: Covariance, options: Options) -> tuple[np.ndarray, np.ndarray]:
    """(S, V) with the SNP as variable 0, for each row of beta and se. Genomic control multiplies standard errors by
    the root of the intercept (standard), by the intercept (conserv), or not at all (none)."""
    n, k = beta.shape
    I = intercepts(c.I)  # noqa: E741
    d = np.diag(I)
    g = {"standard": np.sqrt(d), "conserv": d, "none": np.ones(k)}[options.gc]
    s = se * g * var[:, None]
    off = s[:, :, None] * s[:, None, :] * I
    i = np.arange(k)
    off[:, i, i] = s**2
    S = np.zeros((n, k + 1, k + 1))
    S[:, 0, 0] = var
    S[:, 0, 1:] = S[:, 1:, 0] = beta * var[:, None]
    S[:, 1:, 1:] = c.S
    size = (k + 1) * (k + 2) // 2
    V = np.zeros((n, size, size))
    V[:, 0, 0] = options.snp_se**2
    V[:, 1 : k + 1, 1 : k + 1] = off
    V[:, k + 1 :, k + 1 :] = c.V
    return S, V


def measurement_fixed(text: str, c: Covariance, options: Options) -> str:
    """The model text with every parameter that doesn't touch the predictor fixed at its estimate without it."""
    lines = [x for part in text.replace(";", "\n").splitlines() if (x := part.strip())]
    touches = lambda x: options.predictor in x.replace("~", " ").replace("=", " ").replace("+", " ").replace("*", " ").split()
    inner, outer = [x for x in lines if not touches(x)], [x for x in lines if touches(x)]
    got = fit(compile_model("\n".join(inner), c.names, c.S, options.std_lv), c.S, c.V, options.estimation)
    fixed = [f"{p['lhs']} {p['op']} {p['est']:.12g}*{p['rhs']}" for p in got.estimates() if p["op"] != ":="]
    return "\n".join([*fixed, *outer])


def fit_batch(model: Model, S: np.ndarray, V: np.ndarray, options: Options) -> dict[str, np.ndarray]:
    """Estimates, sandwich standard errors, Q and the change of the largest |Z| by smoothing, for a stack."""
    z = lambda s, v: np.abs(s[:, 0, 1:]) / np.sqrt(np.diagonal(v, axis1=1, axis2=2)[:, 1 : s.shape[1]])
    before = z(S, V)
    S, s_bad = smooth(S)
    V, v_bad = smooth(V)
    w = weights_of(V)
    if options.estimation == "DWLS":
        theta, ok = fit_dwls(model, S, w)
        W = w[:, :, None] * np.eye(w.shape[1])
    else:
        theta, ok = fit_ml(model, S)
        W = ml_weight(S)
    sigma, T, full = model.implied(theta)
    cov = sandwich(model.jacobian(T, full), W, V, options.toler)
    rest = vech_rows(S) - vech_rows(sigma)
    change = np.where(s_bad | v_bad, np.abs(z(S, V) - before).max(axis=1), 0.0)
    return {"theta": theta, "ok": ok, "se": np.sqrt(np.abs(np.einsum("bii->bi", cov))), "rest": rest, "V": V, "Q": q_statistic(rest, V), "smooth": change, "changed": s_bad | v_bad}


def q_of_snp(model: Model, got: dict[str, np.ndarray], latent: str, k: int) -> tuple[np.ndarray, int]:
    """Heterogeneity of the SNP's effects over a latent's indicators."""
    at = [model.observed.index(p.rhs) for p in model.parameters if p.op == "=~" and p.lhs == latent and p.rhs in model.observed]
    rest, V = got["rest"][:, at], got["V"][:, at][:, :, at]
    return q_statistic(rest, V), len(at) - 1


def per_snp(snps: DataFrame, c: Covariance, text: str, options: Options) -> DataFrame:
    """The first six columns of snps (or HSQ, Panel, Gene) and a row for each free or requested parameter of each row, in the
    order of snps and of the parameters.

    snps: beta.<t> and se.<t> of the traits in the order of c, and MAF (or HSQ). A row that cannot be fitted, or whose fit ends at no
    minimum, has its reason in ``fail`` and no estimate; the others go on.
    """
    k = len(c.names)
    betas, ses = by_prefix(snps.columns, "beta."), by_prefix(snps.columns, "se.")
    if len(betas) != k or len(ses) != k:
        raise ValueError(f"{k} traits, but {len(betas)} beta and {len(ses)} se columns")
    genes = "HSQ" in snps.columns
    kept = ["HSQ", "Panel", "Gene"] if genes else [x for x in snps.columns if x not in {*betas, *ses}][:6]
    variance = F.col("HSQ") if genes else 2 * F.col("MAF") * (1 - F.col("MAF"))
    source = measurement_fixed(text, c, options) if options.fix_measurement else text
    names = [options.predictor, *c.names]
    S0 = np.zeros((k + 1, k + 1))
    S0[0, 0], S0[1:, 1:] = 0.25, c.S
    model = compile_model(source, names, S0, options.std_lv)
    shown = [p for p in model.parameters if (p.key in options.sub if options.sub else p.free >= 0)]
    latents = sorted({p.lhs for p in model.parameters if p.op == "~" and p.rhs == options.predictor and p.lhs in model.latent}) if options.q_snp else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                rows = batch.iloc[at : at + BATCH]
                beta, se, var = np.stack(rows["_beta"].to_list()), np.stack(rows["_se"].to_list()), rows["_var"].to_numpy(float)
                fine = np.isfinite(beta).all(axis=1) & np.isfinite(se).all(axis=1) & (se > 0).all(axis=1) & (var > 0)
                S, V = snp_covariances(np.where(fine[:, None], beta, 0.01), np.where(fine[:, None], se, 0.01), np.where(fine, var, 0.25), c, options)
                got = fit_batch(model, S, V, options)
                good = fine & got["ok"]
                q_df = S.shape[1] * (S.shape[1] + 1) // 2 - model.n_free
                parts = []
                for i, p in enumerate(shown):
                    part = rows[[*kept, "_id"]].copy()
                    part["_i"] = i
                    part["lhs"], part["op"], part["rhs"] = p.lhs, p.op, p.rhs
                    part["est"] = np.where(good, got["theta"][:, p.free] if p.free >= 0 else p.value, np.nan)
                    part["se_c"] = np.where(good, got["se"][:, p.free] if p.free >= 0 else np.nan, np.nan)
                    part["Q"], part["Q_df"] = np.where(good, got["Q"], np.nan), q_df
                    latent = p.lhs if p.lhs in latents and p.rhs == options.predictor else None
                    q, df = q_of_snp(model, got, latent, k) if latent else (np.full(len(rows), np.nan), 0)
                    part["Q_SNP"], part["Q_SNP_df"] = np.where(good, q, np.nan), df
                    part["fail"] = np.where(fine, np.where(got["ok"], "0", "not converged"), "input missing or not positive")
                    part["warning"] = np.where(got["changed"] & fine, "smoothed", "0")
                    part["Z_smooth"] = np.where(good, got["smooth"], np.nan)
                    parts.append(part)
                yield pd.concat(parts).sort_values("_id", kind="stable") if parts else pd.DataFrame(columns=[*kept, "_id", "_i", *(x.split()[0] for x in RESULT.split(", "))])

    picked = snps.select(*(F.col(f"`{x}`") for x in kept), F.array(*(F.col(f"`{x}`").cast("double") for x in betas)).alias("_beta"), F.array(*(F.col(f"`{x}`").cast("double") for x in ses)).alias("_se"), variance.cast("double").alias("_var"))
    picked = dealt_in_order(with_row_number(picked, "_id"), "_id", LEAST, MOST)
    kinds = dict(picked.dtypes)
    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in kept), "_id long", "_i int", RESULT])
    return with_p_values(picked.mapInPandas(run, schema))


def with_p_values(df: DataFrame) -> DataFrame:
    """Z = est / se_c, two-sided p and the p-value of Q; NaN as null."""
    null = {c: F.when(~F.isnan(c), F.col(c)) for c in ("est", "se_c", "Q", "Q_SNP", "Z_smooth")}

    @F.pandas_udf("double")
    def tail(q: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(chi2_sf(q.to_numpy(float), df.to_numpy(float)))

    out = df.withColumns(null).withColumn("Z_Estimate", F.try_divide("est", "se_c")).withColumn("_a", F.abs("Z_Estimate"))
    out = out.withColumn("Pval_Estimate", F.when(F.col("_a").isNotNull(), F.greatest(2 * norm_sf("_a"), F.lit(5e-300)))).drop("_a")
    return out.withColumn("Q_pval", tail("Q", "Q_df")).withColumn("Q_pval", F.when(~F.isnan("Q_pval"), F.col("Q_pval")))


def common_factor_gwas(snps: DataFrame, c: Covariance, options: Options | None = None) -> DataFrame:
    """The SNP's effect on one factor behind all traits, with Q for its heterogeneity; a row for each SNP, in the order of snps."""
    options = options or Options(sub=("F1~SNP",), q_snp=True, fix_measurement=False)
    text = f"F1 =~ {' + '.join(c.names)}\nF1 ~ SNP\n" + "\n".join(f"{n} ~ 0*SNP" for n in c.names)
    out = per_snp(snps, c, text, options).drop("_id", "_i")
    out = out.withColumn("rhs", F.lit("Gene")) if "HSQ" in snps.columns else out
    return out.select(*(f"`{x}`" for x in out.columns if x not in COMMON), *COMMON)


def user_gwas(snps: DataFrame, c: Covariance, text: str, options: Options | None = None) -> DataFrame:
    """Any model with SNP among its variables; a row for each parameter asked for and each SNP, in the order of snps: i is the SNP's
    number among them, from 1."""
    return per_snp(snps, c, text, options or Options()).withColumnRenamed("_id", "i").withColumnRenamed("_i", "param_index")


def by_parameter(results: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """A frame for each parameter key (lhs + op + rhs)."""
    return {key: results.where(F.concat("lhs", "op", "rhs") == key) for key in keys}
