"""Cleaning of GWAS summary statistics: one trait against a reference, and several merged into one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions import qc
from lociq.functions.rows import keep
from lociq.functions.normal import z_from_p


@dataclass(frozen=True)
class Trait:
    """One trait of a merged table. kind as in qc.standard_effects; n, if given, replaces the table's N."""

    name: str
    table: DataFrame
    kind: str = "se_logit"
    n: float | None = None
    beta_given: bool = False


def as_reference(ref: DataFrame, maf: float | None = None, ambiguous: bool = True) -> DataFrame:
    """SNP, A1_REF, A2_REF and MAF_REF of a panel, at or above a MAF, on demand without strand-ambiguous pairs."""
    ref = qc.upper_alleles(ref)
    if not ambiguous:
        ref = qc.drop_strand_ambiguous(ref)
    if maf is not None and "MAF" in ref.columns:
        ref = qc.at_least(ref, "MAF", maf)
    return ref.select("SNP", *(F.col(c).alias(f"{c}_REF") for c in ("A1", "A2", "MAF") if c in ref.columns))


def with_n(df: DataFrame, n: float | None) -> DataFrame:
    if n is not None:
        return df.withColumn("N", F.lit(float(n)))
    return df if "N" in df.columns else df.withColumn("N", F.lit(None).cast("double"))


def munge_steps(table: DataFrame, ref: DataFrame, n: float | None = None, info: float = 0.9, maf: float = 0.01) -> list[tuple[str, DataFrame]]:
    """The frames behind munge(), each with what it leaves: read, single_base_alleles, in_reference, p_and_effect, matching_alleles,
    info, maf; the last is the result."""
    steps = [("read", table), ("single_base_alleles", qc.keep_acgt(qc.upper_alleles(table)))]
    add = lambda name, df: steps.append((name, df)) or df
    df = add("in_reference", steps[-1][1].join(as_reference(ref).drop("MAF_REF"), "SNP"))
    df = add("p_and_effect", qc.drop_missing(df, "P", "EFFECT"))
    if "MAF" in df.columns:
        df = df.withColumn("MAF", qc.fold_maf())
    df = add("matching_alleles", qc.keep_matching_alleles(qc.flip_effect(qc.log_of_odds_ratios(df))))
    df = add("info", qc.at_least(df, "INFO", info))
    add("maf", with_n(qc.at_least(df, "MAF", maf), n).withColumn("Z", z_from_p()).select("SNP", "N", "Z", "A1", "A2"))
    return steps


def munge(table: DataFrame, ref: DataFrame, n: float | None = None, info: float = 0.9, maf: float = 0.01) -> DataFrame:
    """SNP, N, Z, A1, A2 of a canonical table (see sources.tables.canonical) matched to a reference.

    Single-base alleles; P and EFFECT present; odds ratios logged; effects flipped to the reference's A1;
    mismatching alleles, low INFO and low folded MAF dropped; Z from P with the effect's sign.
    """
    return munge_steps(table, ref, n, info, maf)[-1][1]


def harmonise(trait: Trait, ref: DataFrame, info: float = 0.6, keep_indel: bool = False, directions: bool = False) -> DataFrame:
    """SNP, beta.<name>, se.<name> of one trait against ``as_reference`` rows. SNPs that occur more than once go altogether."""
    df = qc.drop_all_duplicates(trait.table)
    df = qc.upper_alleles(qc.keep_directions(df) if directions else df)
    df = df if keep_indel else qc.keep_acgt(df)
    df = qc.drop_missing(df.join(ref, "SNP"), "P", "EFFECT")
    df = qc.with_snp_variance(df)
    df = qc.log_of_odds_ratios(keep(df)).where(F.col("EFFECT") != 0)  # read for the median and for the rest
    df = qc.keep_matching_alleles(qc.flip_effect(df)).withColumn("Z", z_from_p())
    df = with_n(qc.at_least(df, "INFO", info), trait.n)
    df = qc.keep_finite_effects(qc.standard_effects(df, trait.kind, trait.beta_given), nonzero=trait.kind == "linprob")
    return df.select("SNP", F.col("BETA_STD").alias(f"beta.{trait.name}"), F.col("SE_STD").alias(f"se.{trait.name}"))


def merge_traits(traits: Sequence[Trait], panel: DataFrame, maf: float = 0.01, info: float = 0.6, keep_indel: bool = False, ambiguous: bool = True, directions: bool = False) -> DataFrame:
    """The panel's columns and beta.<t>, se.<t> of every trait, for SNPs that all of them have."""
    ref = as_reference(panel, maf, ambiguous)
    rows = qc.at_least(qc.upper_alleles(panel), "MAF", maf)
    rows = rows if ambiguous else qc.drop_strand_ambiguous(rows)
    return reduce(lambda out, t: out.join(harmonise(t, ref, info, keep_indel, directions), "SNP"), traits, rows)


def effects_report(merged: DataFrame, names: Sequence[str], limit: float = 5.0) -> DataFrame:
    """trait, mean_abs_z, large of a merged table: whether the mean |Z| of a trait's standardised effects exceeds a limit, which hints at
    wrong units. One aggregate for all traits."""
    z = lambda t: F.abs(F.try_divide(F.col(f"`beta.{t}`"), F.col(f"`se.{t}`")))
    means = merged.agg(F.array(*(F.struct(F.lit(t).alias("trait"), F.avg(z(t)).alias("mean_abs_z")) for t in names)).alias("each"))
    return means.select(F.inline("each")).withColumn("large", F.coalesce(F.col("mean_abs_z") > limit, F.lit(False)))


def large_effects(merged: DataFrame, name: str, limit: float = 5.0) -> bool:
    """Whether effects_report calls a trait's effects large."""
    return effects_report(merged, [name], limit).first()["large"]


def removal_report(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """step, rows, removed for frames in the order of a pipeline; one small aggregate each."""
    counts = reduce(DataFrame.union, (df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("i"), F.lit(name).alias("step"), "rows") for i, (name, df) in enumerate(steps)))
    rows = counts.collect()  # one row for each step
    rows.sort(key=lambda r: r["i"])
    out = [(r["step"], r["rows"], (rows[k - 1]["rows"] - r["rows"]) if k else 0) for k, r in enumerate(rows)]
    return steps[0][1].sparkSession.createDataFrame(out, "step string, rows long, removed long")
