"""Column rules of summary-statistic cleaning; each takes a frame and returns one."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
LOGISTIC_VARIANCE = math.pi**2 / 3


def upper_alleles(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.upper(c) for c in ("A1", "A2") if c in df.columns})


def keep_acgt(df: DataFrame) -> DataFrame:
    """Rows whose alleles are single bases; null alleles go; without allele columns nothing does."""
    return df.where(F.col("A1").isin(*BASES) & F.col("A2").isin(*BASES)) if {"A1", "A2"} <= {*df.columns} else df


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def flip_effect(df: DataFrame, column: str = "EFFECT") -> DataFrame:
    """Change the sign where A1 is the reference's other allele; null where any allele is null."""
    swapped = (F.col("A1") != F.col("A1_REF")) & (F.col("A1") == F.col("A2_REF"))
    known = F.col("A1").isNotNull() & F.col("A1_REF").isNotNull() & F.col("A2_REF").isNotNull()
    return df.withColumn(column, F.when(known & swapped, -F.col(column)).when(known, F.col(column)))


def keep_matching_alleles(df: DataFrame) -> DataFrame:
    """Rows both of whose alleles are among the reference's two; nulls go."""
    pair = [F.col("A1_REF"), F.col("A2_REF")]
    return df.where(F.col("A1").isin(*pair) & F.col("A2").isin(*pair))


def drop_strand_ambiguous(df: DataFrame, a1: str = "A1", a2: str = "A2") -> DataFrame:
    """Without A/T and C/G pairs; null alleles stay."""
    return df.where(~F.coalesce(F.concat(a1, a2).isin("AT", "TA", "CG", "GC"), F.lit(False)))


def keep_directions(df: DataFrame) -> DataFrame:
    """Rows with less than half of DIRECTION missing (``?``); null goes; without the column nothing does."""
    if "DIRECTION" not in df.columns:
        return df
    share = F.regexp_count("DIRECTION", F.lit(r"\?")) / F.greatest(F.length("DIRECTION"), F.lit(1))
    return df.where(share < 0.5)


def fold_maf(c: str = "MAF") -> Column:
    return F.when(F.col(c) > 0.5, 1 - F.col(c)).otherwise(F.col(c))


def with_snp_variance(df: DataFrame) -> DataFrame:
    """Folded MAF (the reference's where the study has none) strictly between 0 and 1, and VAR_SNP = 2 MAF (1 - MAF)."""
    maf = "MAF" if "MAF" in df.columns else "MAF_REF"
    folded = df.withColumn("_MAF", fold_maf(maf)).where((F.col("_MAF") > 0) & (F.col("_MAF") < 1))
    return folded.withColumn("VAR_SNP", 2 * F.col("_MAF") * (1 - F.col("_MAF"))).drop("_MAF")


def at_least(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows that reach a threshold; null goes; without the column nothing does."""
    return df.where(F.col(column) >= threshold) if column in df.columns else df


def median_reaches(column: str, bound: float) -> Column:
    """Whether the exact median of a column is at or above a bound, as an aggregate of counts and of the values next to the bound: no task
    sees all values, and nothing is sorted."""
    x = F.col(column)
    n, below = F.count(x), F.count_if(x < bound)
    middle = (F.max(F.when(x < bound, x)) + F.min(F.when(x >= bound, x))) / 2
    return F.when(2 * below < n, True).when(2 * below == n, middle >= bound).otherwise(False)


def log_of_odds_ratios(df: DataFrame) -> DataFrame:
    """ln(EFFECT) if the exact median of EFFECT rounds to 1, which odds ratios do; ln of no positive number is null. The median is
    part of the plan, so nothing runs before the result is asked for."""
    ratios = F.coalesce(df.agg(median_reaches("EFFECT", 0.5) & ~median_reaches("EFFECT", 1.5)).scalar(), F.lit(False))
    return df.withColumn("EFFECT", F.when(~ratios, F.col("EFFECT")).when(F.col("EFFECT") > 0, F.ln("EFFECT")))


def drop_all_duplicates(df: DataFrame, key: str = "SNP") -> DataFrame:
    """Rows whose key occurs once; null keys go. df is read once: of each key the number of rows and one of them meet, map-side first, so a
    key that very many rows share gathers nowhere."""
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c != key]
    one = [F.first(F.struct(*rest)).alias("_one")] if rest else []
    met = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), *one).where("_n = 1")
    return met.select(key, *(["_one.*"] if rest else []))


def drop_all_duplicates_by_window(df: DataFrame, key: str = "SNP") -> DataFrame:
    """The same with one shuffle, for keys that few rows share."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def outside_mhc(df: DataFrame) -> DataFrame:
    """Without chromosome 6, 25 to 34 Mb inclusive; rows of unknown place stay."""
    inside = (F.col("CHR") == 6) & F.col("BP").between(25_000_000, 34_000_000)
    return df.where(~F.coalesce(inside, F.lit(False)))


def implausible_p(df: DataFrame) -> int:
    """How many p-values lie outside [0, 1]."""
    return df.agg(F.count_if((F.col("P") < 0) | (F.col("P") > 1))).first()[0]


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def standard_effects(df: DataFrame, kind: str, beta_given: bool = False) -> DataFrame:
    """BETA_STD and SE_STD per standard deviation of the SNP.

    kind: ``ols`` (from Z, N and VAR_SNP, or EFFECT itself if it is a beta), ``linprob`` (linear model of a binary
    trait), ``se_logit`` (log odds with their own standard errors), ``or`` (standard errors on the scale of
    odds ratios). Divisions by zero are null.
    """
    z, n, v, effect = (F.col(c) for c in ("Z", "N", "VAR_SNP", "EFFECT"))
    if kind == "ols":
        b = effect if beta_given else over(z, F.sqrt(n * v))
        s = F.when(z != 0, F.abs(over(b, z)))
    else:
        if kind == "linprob":
            size = F.sqrt(n / 4 * v)
            b, s = over(z, size), over(F.lit(1.0), size)
        elif kind in ("se_logit", "or"):
            b, s = effect, F.col("SE") if kind == "se_logit" else F.col("SE") / F.exp(effect)
        else:
            raise ValueError(f"unknown kind of effects: {kind}")
        spread = F.sqrt(b * b * v + LOGISTIC_VARIANCE)
        b, s = over(b, spread), over(s, spread)
    return df.withColumn("BETA_STD", b).withColumn("SE_STD", s)


def keep_finite_effects(df: DataFrame, nonzero: bool = False) -> DataFrame:
    df = drop_missing(df, "BETA_STD", "SE_STD")
    return df.where((F.col("BETA_STD") != 0) & (F.col("SE_STD") != 0)) if nonzero else df


def by_prefix(columns: Sequence[str], prefix: str) -> list[str]:
    return [c for c in columns if c.startswith(prefix)]
