"""Transcriptome-wide statistics: effects by gene and panel, merged over traits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.functions.normal import probit
from lociq.functions.qc import LOGISTIC_VARIANCE, over


def panel_name(path: str = "FILE") -> Column:
    """The last two parts of a path that aren't empty, or the one there is."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def permutation_z() -> Column:
    """|Z| of the permutation p-value; a p of exactly 1 or 0 moves one permutation inwards."""
    n = F.col("`PERM.N`")
    p = F.when((F.col("`PERM.PV`") == 1) & (n > 0), (n - 1) / n).when((F.col("`PERM.PV`") == 0) & (n > 0), 1 / n).otherwise(F.col("`PERM.PV`"))
    return p


def gene_effects(table: DataFrame, name: str, n: float, binary: bool, perm: bool = False) -> DataFrame:
    """HSQ, Panel, Gene, beta.<name>, se.<name> of one trait's table (FILE, ID, TWAS.Z, HSQ, and PERM.PV, PERM.N)."""
    df = table.withColumn("_z", F.col("`TWAS.Z`"))
    if perm:
        half = df.withColumn("_half", permutation_z() / 2)
        sign = F.when(F.col("_z") < 0, -1.0).otherwise(1.0)
        df = half.withColumn("_z", sign * F.when(F.col("_half") == 0.5, 0.0).otherwise(-probit("_half")))
    h, z = F.col("HSQ"), F.col("_z")
    size = F.sqrt((n / 4 if binary else float(n)) * h)
    effect = over(z, size)
    se = F.abs(over(effect, z)) if perm or not binary else over(F.lit(1.0), size)
    if binary:
        spread = F.sqrt(effect * effect * h + LOGISTIC_VARIANCE)
        effect, se = over(effect, spread), over(se, spread)
    return df.select(h.alias("HSQ"), panel_name().alias("Panel"), F.col("ID").alias("Gene"), effect.alias(f"beta.{name}"), se.alias(f"se.{name}"))


def read_fusion(tables: Sequence[DataFrame], names: Sequence[str], n: Sequence[float], binary: Sequence[bool], perm: bool = False) -> DataFrame:
    """All traits' effects by Gene and Panel, HSQ as the first has it; rows with nulls and repeated rows go."""
    each = [gene_effects(t, *x, perm) for t, *x in zip(tables, names, n, binary, strict=True)]
    merged = reduce(lambda a, b: a.join(b.drop("HSQ"), ["Gene", "Panel"]), each)
    columns = ["HSQ", "Panel", "Gene", *(f"{c}.{x}" for x in names for c in ("beta", "se"))]
    known = reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in columns))
    return merged.where(known).select(*(f"`{c}`" for c in columns)).distinct()
