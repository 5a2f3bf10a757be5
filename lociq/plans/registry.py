"""Registered queries of the statistical operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.functions import qc
from lociq.functions.normal import norm_sf_sql, probit_sql, z_from_p, z_from_p_sql
from lociq.operators import clean, gwas, ldsc, posthoc, stratified, twas
from lociq.operators.sem import models
from lociq.plans import views
from lociq.plans.views import trait, variants, with_views
from lociq.sources.tables import Covariance, StratifiedCovariance

BLOCKS = 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def r6(c: str | F.Column) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def q6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def joined(spark: SparkSession, sf_dir: str, t: int = 0) -> DataFrame:
    """A trait against the panel as its reference."""
    return qc.upper_alleles(trait(spark, sf_dir, t)).join(clean.as_reference(variants(spark, sf_dir)), "SNP")


UP = "SELECT * REPLACE (upper(A1) AS A1, upper(A2) AS A2) FROM"
JOINED = f"SELECT t.*, v.A1 AS A1_REF, v.A2 AS A2_REF, v.MAF AS MAF_REF FROM ({UP} trait0) t JOIN variants v USING (SNP)"
FLIP = "CASE WHEN A1 <> A1_REF AND A1 = A2_REF THEN -EFFECT ELSE EFFECT END"
VAR = "2 * (CASE WHEN MAF_REF > 0.5 THEN 1 - MAF_REF ELSE MAF_REF END) * (1 - (CASE WHEN MAF_REF > 0.5 THEN 1 - MAF_REF ELSE MAF_REF END))"
LOGISTIC = f"CAST('{qc.LOGISTIC_VARIANCE!r}' AS DOUBLE)"


@query(f"SELECT SNP, A1, A2 FROM ({UP} trait0) WHERE A1 IN ('A','C','G','T') AND A2 IN ('A','C','G','T')")
def q_uppercase_acgt(spark, sf_dir):
    return qc.keep_acgt(qc.upper_alleles(trait(spark, sf_dir, 0))).select("SNP", "A1", "A2")


@query(f"SELECT SNP, {q6(FLIP)} AS EFFECT FROM ({JOINED})")
def q_allele_flip(spark, sf_dir):
    return qc.flip_effect(joined(spark, sf_dir)).select("SNP", r6("EFFECT").alias("EFFECT"))


@query(f"SELECT SNP, A1, A2 FROM ({JOINED}) WHERE A1 IN (A1_REF, A2_REF) AND A2 IN (A1_REF, A2_REF)")
def q_allele_mismatch(spark, sf_dir):
    return qc.keep_matching_alleles(joined(spark, sf_dir)).select("SNP", "A1", "A2")


@query("SELECT SNP, A1, A2 FROM variants WHERE concat(A1, A2) NOT IN ('AT','TA','CG','GC')")
def q_strand_ambiguous(spark, sf_dir):
    return qc.drop_strand_ambiguous(variants(spark, sf_dir)).select("SNP", "A1", "A2")


@query("SELECT SNP, DIRECTION FROM trait0 WHERE CAST(len(DIRECTION) - len(replace(DIRECTION, '?', '')) AS DOUBLE) / greatest(len(DIRECTION), 1) < 0.5")
def q_direction_missing(spark, sf_dir):
    return qc.keep_directions(trait(spark, sf_dir, 0)).select("SNP", "DIRECTION")


@query(f"SELECT SNP, {q6(VAR)} AS VAR_SNP FROM ({JOINED}) WHERE MAF_REF > 0 AND MAF_REF < 1")
def q_maf_fold_var(spark, sf_dir):
    return qc.with_snp_variance(joined(spark, sf_dir)).select("SNP", r6("VAR_SNP").alias("VAR_SNP"))


@query(f"SELECT SNP, {q6('CASE WHEN round(m) = 1 THEN ln(e) ELSE e END')} AS EFFECT FROM (SELECT SNP, exp(EFFECT) AS e, median(exp(EFFECT)) OVER () AS m FROM trait0)")
def q_or_detect_log(spark, sf_dir):
    ratios = trait(spark, sf_dir, 0).withColumn("EFFECT", F.exp("EFFECT"))
    return qc.log_of_odds_ratios(ratios).select("SNP", r6("EFFECT").alias("EFFECT"))


@query(f"SELECT SNP, {q6('INFO')} AS INFO, {q6('MAF_REF')} AS MAF_REF FROM ({JOINED}) WHERE INFO >= CAST('0.9' AS DOUBLE) AND MAF_REF >= CAST('0.1' AS DOUBLE)")
def q_info_maf_filter(spark, sf_dir):
    return qc.at_least(qc.at_least(joined(spark, sf_dir), "INFO", 0.9), "MAF_REF", 0.1).select("SNP", r6("INFO").alias("INFO"), r6("MAF_REF").alias("MAF_REF"))


@query("SELECT count(*) FILTER (WHERE P < 0 OR P > 1)::BIGINT AS implausible FROM (SELECT P * 1.2::DOUBLE - 0.1::DOUBLE AS P FROM trait0)")
def q_p_sanity(spark, sf_dir):
    shifted = trait(spark, sf_dir, 0).withColumn("P", F.col("P") * 1.2 - 0.1)
    return spark.createDataFrame([(qc.implausible_p(shifted),)], "implausible long")


@query(f"SELECT SNP, {q6(z_from_p_sql('P', 'EFFECT'))} AS Z FROM trait0")
def q_z_from_p(spark, sf_dir):
    return trait(spark, sf_dir, 0).select("SNP", r6(z_from_p()).alias("Z"))


STD_IN = f"SELECT SNP, EFFECT, SE, N, {VAR} AS v, {z_from_p_sql('P', 'EFFECT')} AS z FROM ({JOINED}) WHERE MAF_REF > 0 AND MAF_REF < 1"


def standardised(spark, sf_dir, kind):
    df = qc.with_snp_variance(joined(spark, sf_dir)).withColumn("Z", z_from_p())
    out = qc.keep_finite_effects(qc.standard_effects(df, kind))
    return out.select("SNP", r6("BETA_STD").alias("beta"), r6("SE_STD").alias("se"))


def std_sql(b: str, s: str, spread: bool) -> str:
    inner = f"SELECT SNP, v, {b} AS b, {s} AS s FROM ({STD_IN})"
    root = f"nullif(sqrt(b * b * v + {LOGISTIC}), 0)" if spread else "1"
    return f"SELECT SNP, {q6(f'b / {root}')} AS beta, {q6(f's / {root}')} AS se FROM ({inner}) WHERE b IS NOT NULL AND s IS NOT NULL"


@query(std_sql("z / nullif(sqrt(N * v), 0)", "CASE WHEN z <> 0 THEN abs(z / nullif(sqrt(N * v), 0) / z) END", False))
def q_std_ols(spark, sf_dir):
    return standardised(spark, sf_dir, "ols")


@query(std_sql("z / nullif(sqrt(N / 4 * v), 0)", "1 / nullif(sqrt(N / 4 * v), 0)", True))
def q_std_linprob(spark, sf_dir):
    return standardised(spark, sf_dir, "linprob")


@query(std_sql("EFFECT", "SE", True))
def q_std_logit(spark, sf_dir):
    return standardised(spark, sf_dir, "se_logit")


@query(std_sql("EFFECT", "SE / exp(EFFECT)", True))
def q_std_or(spark, sf_dir):
    return standardised(spark, sf_dir, "or")


DUP = "SELECT SNP, P FROM trait0 UNION ALL SELECT SNP, P FROM trait0 WHERE CAST(substr(SNP, 3) AS BIGINT) % 13 = 0"


@query(f"SELECT SNP, {q6('P')} AS P FROM ({DUP}) QUALIFY count(*) OVER (PARTITION BY SNP) = 1")
def q_dedupe_all(spark, sf_dir):
    df = trait(spark, sf_dir, 0).select("SNP", "P")
    twice = df.union(df.where(F.substr("SNP", F.lit(3)).cast("long") % 13 == 0))
    return qc.drop_all_duplicates(twice).select("SNP", r6("P").alias("P"))


MUNGED = f"""SELECT SNP, N, {z_from_p_sql('P', f'({FLIP})')} AS Z, A1, A2 FROM ({JOINED})
 WHERE A1 IN ('A','C','G','T') AND A2 IN ('A','C','G','T') AND A1 IN (A1_REF, A2_REF) AND A2 IN (A1_REF, A2_REF) AND INFO >= CAST('0.6' AS DOUBLE)"""


@query(f"SELECT SNP, N, {q6('Z')} AS Z, A1, A2 FROM ({MUNGED})")
def q_munge(spark, sf_dir):
    out = clean.munge(trait(spark, sf_dir, 0).drop("Z"), variants(spark, sf_dir), info=0.6)
    return out.select("SNP", "N", r6("Z").alias("Z"), "A1", "A2")


def harmonised_sql(t: int, kind: str) -> str:
    b, s, spread = {"ols": ("z / nullif(sqrt(N * v), 0)", "CASE WHEN z <> 0 THEN abs(z / nullif(sqrt(N * v), 0) / z) END", False), "linprob": ("z / nullif(sqrt(N / 4 * v), 0)", "1 / nullif(sqrt(N / 4 * v), 0)", True), "se_logit": ("e", "SE", True)}[kind]
    root = f"nullif(sqrt(b * b * v + {LOGISTIC}), 0)" if spread else "1"
    flipped = "CASE WHEN A1 <> A1_REF AND A1 = A2_REF THEN -EFFECT ELSE EFFECT END"
    source = JOINED.replace("trait0", f"trait{t}").replace("JOIN variants v USING (SNP)", "JOIN variants v USING (SNP) WHERE v.MAF >= CAST('0.01' AS DOUBLE)")
    rows = f"SELECT SNP, {flipped} AS e, SE, N, {VAR} AS v, P FROM ({source}) WHERE A1 IN ('A','C','G','T') AND A2 IN ('A','C','G','T') AND A1 IN (A1_REF, A2_REF) AND A2 IN (A1_REF, A2_REF) AND INFO >= CAST('0.6' AS DOUBLE) AND MAF_REF > 0 AND MAF_REF < 1 AND EFFECT <> 0"
    inner = f"SELECT SNP, v, {b} AS b, {s} AS s FROM (SELECT *, {z_from_p_sql('P', 'e')} AS z FROM ({rows}))"
    keep = "b IS NOT NULL AND s IS NOT NULL" + (" AND b <> 0 AND s <> 0" if kind == "linprob" else "")
    return f"SELECT SNP, b / {root} AS beta, s / {root} AS se FROM ({inner}) WHERE {keep}"


def merged_sql(kinds: list[str]) -> str:
    parts = [f"({harmonised_sql(t, k)}) h{t}" for t, k in enumerate(kinds)]
    joins = " JOIN ".join([parts[0], *(f"{p} USING (SNP)" for p in parts[1:])])
    columns = ", ".join(f"{q6(f'h{t}.{c}')} AS {c}_{t}" for t in range(len(kinds)) for c in ("beta", "se"))
    return f"SELECT SNP, {columns} FROM {joins}"


def merged(spark, sf_dir, kinds):
    traits = [clean.Trait(f"t{t}", trait(spark, sf_dir, t).drop("Z"), k) for t, k in enumerate(kinds)]
    return clean.merge_traits(traits, variants(spark, sf_dir))


def merged_query(spark, sf_dir, kinds):
    columns = [r6(f"`{c}.t{t}`").alias(f"{c}_{t}") for t in range(len(kinds)) for c in ("beta", "se")]
    return merged(spark, sf_dir, kinds).select("SNP", *columns)


@query(merged_sql(["ols", "linprob"]))
def q_sumstats_2trait(spark, sf_dir):
    return merged_query(spark, sf_dir, ["ols", "linprob"])


@query(merged_sql(["ols", "linprob", "se_logit"]))
def q_sumstats_3trait(spark, sf_dir):
    return merged_query(spark, sf_dir, ["ols", "linprob", "se_logit"])


@query("SELECT CHR, count(*) AS snps, round(sum(L2), 6) AS total FROM variants WHERE CHR % 2 = 1 GROUP BY CHR")
def q_ld_union(spark, sf_dir):
    from lociq.sources.tables import chromosomes

    v = variants(spark, sf_dir)
    each = reduce(DataFrame.unionByName, (v.where(F.col("CHR") == c).select("CHR", "L2") for c in chromosomes("ODD")))
    return each.groupBy("CHR").agg(F.count("*").alias("snps"), F.round(F.sum("L2"), 6).alias("total"))


@query("SELECT sum(n)::DOUBLE AS m FROM (SELECT CHR, count(*) AS n FROM variants WHERE MAF > CAST('0.05' AS DOUBLE) GROUP BY CHR)")
def q_m_sum(spark, sf_dir):
    from lociq.functions.rows import shared_folder
    from lociq.sources.tables import total_count

    folder = f"{shared_folder(spark)}/m_5_50-{uuid.uuid4().hex}"  # a file of counts for each chromosome, as they are published
    counts = variants(spark, sf_dir).where("MAF > 0.05D").groupBy("CHR").agg(F.count("*").cast("string").alias("value"))
    counts.write.partitionBy("CHR").text(folder)
    return spark.createDataFrame([(total_count(spark, [f"{folder}/CHR=*"]),)], "m double")


@query("SELECT SNP, round(Z * Z, 6) AS chisq FROM trait0 JOIN variants USING (SNP) WHERE Z * Z <= 2")
def q_chisq_cap(spark, sf_dir):
    v = variants(spark, sf_dir)
    return ldsc.joined_traits([trait(spark, sf_dir, 0)], v, v.select("SNP", "wLD"), chisq_max=2.0).select("SNP", F.round(F.col("Z") * F.col("Z"), 6).alias("chisq"))


def h2_rows(spark, sf_dir, traits=(0,)):
    v = variants(spark, sf_dir)
    rows = ldsc.joined_traits([trait(spark, sf_dir, t) for t in traits], v, v.select("SNP", "wLD"))
    return ldsc.cells(rows)


ROWS_SQL = """
j AS (SELECT t.SNP, t.N, t.Z, v.L2, v.wLD, v.CHR, v.BP FROM trait0 t JOIN variants v ON t.SNP = v.SNP),
f AS (SELECT j.*, row_number() OVER (ORDER BY CHR, BP, SNP) - 1 AS rn, count(*) OVER () AS cnt FROM j WHERE Z * Z <= (SELECT greatest(CAST('0.001' AS DOUBLE) * max(N), 80) FROM j))"""
BLOCK_SQL = f"CAST(least({BLOCKS - 1}, ((rn + 1) * {BLOCKS} - 1) // greatest(cnt - 1, 1)) AS INT)"


@query(f"WITH {ROWS_SQL} SELECT {BLOCK_SQL} AS block, count(*) AS snps, min(rn)::BIGINT AS first_row FROM f GROUP BY 1")
def q_block_bounds(spark, sf_dir):
    return ldsc.in_blocks(h2_rows(spark, sf_dir), BLOCKS).groupBy("block").agg(F.count("*").alias("snps"), F.min("rn").cast("long").alias("first_row"))


SUMS_SQL = f"""{ROWS_SQL},
s AS (SELECT avg(Z * Z) AS chi, avg(L2 * N) AS l2n, avg(N) AS nbar, CAST(max(cnt) AS BIGINT) AS cnt, (SELECT CAST(count(*) AS DOUBLE) FROM variants) AS M FROM f),
a AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), M * (chi - 1) / l2n)) AS agg FROM s),
w AS (SELECT f.*, sqrt(1 / (2 * power(1 + agg * f.N / M * greatest(L2, 1), 2)) / greatest(wLD, 1)) AS w0 FROM f CROSS JOIN a),
u AS (SELECT *, w0 / sum(w0) OVER () AS u FROM w),
bs AS (SELECT {BLOCK_SQL} AS b, sum(u*u*L2*L2) AS xx, sum(u*u*L2) AS x1, sum(u*u) AS o, sum(u*u*L2*Z*Z) AS xy, sum(u*u*Z*Z) AS y FROM u GROUP BY 1)"""


@query(f"WITH {SUMS_SQL} SELECT b AS block, round(xx * 1e6, 6) AS xx, round(x1 * 1e6, 6) AS x1, round(o * 1e6, 6) AS oo, round(xy * 1e6, 6) AS xy, round(y * 1e6, 6) AS y1 FROM bs")
def q_block_sums(spark, sf_dir):
    m = float(variants(spark, sf_dir).count())
    sums = ldsc.block_sums(ldsc.weighted(h2_rows(spark, sf_dir), m), BLOCKS)
    return sums.select("block", *(F.round(F.col(c) * 1e6, 6).alias(c) for c in ("xx", "x1", "oo", "xy", "y1")))


JACK_SQL = f"""
t AS (SELECT b, xx, x1, o, xy, y, sum(xx) OVER () AS txx, sum(x1) OVER () AS tx1, sum(o) OVER () AS tn1, sum(xy) OVER () AS txy, sum(y) OVER () AS ty FROM bs),
r AS (SELECT b, (tn1*txy - tx1*ty) / (txx*tn1 - tx1*tx1) AS b0, (txx*ty - tx1*txy) / (txx*tn1 - tx1*tx1) AS b1,
 ((tn1-o)*(txy-xy) - (tx1-x1)*(ty-y)) / ((txx-xx)*(tn1-o) - (tx1-x1)*(tx1-x1)) AS d0,
 ((txx-xx)*(ty-y) - (tx1-x1)*(txy-xy)) / ((txx-xx)*(tn1-o) - (tx1-x1)*(tx1-x1)) AS d1 FROM t),
pv AS (SELECT b, b0, b1, {BLOCKS}*b0 - ({BLOCKS}-1)*d0 AS p0, {BLOCKS}*b1 - ({BLOCKS}-1)*d1 AS p1 FROM r),
z AS (SELECT max(b0) AS b0, max(b1) AS b1, sqrt(var_samp(p0)/count(*)) AS s0, sqrt(var_samp(p1)/count(*)) AS s1 FROM pv)"""


def cell_report(spark, sf_dir, traits):
    v = variants(spark, sf_dir)
    m = float(v.count())
    _, report = ldsc.ldsc([trait(spark, sf_dir, t) for t in traits], v, v.select("SNP", "wLD"), m, [f"trait{t}" for t in traits], n_blocks=BLOCKS)
    return report


def report_frame(spark, report):
    rows = [(r["i"], r["j"], *(round(float(r[c] * f), 4) for c, f in (("estimate", 1000), ("se", 1000), ("intercept", 1), ("intercept_se", 1), ("mean", 1))), int(r["snps"])) for r in report]
    return spark.createDataFrame(rows, "i string, j string, estimate_k double, se_k double, intercept double, intercept_se double, mean double, snps long")


@query(f"WITH {SUMS_SQL}, {JACK_SQL} SELECT 'trait0' AS i, 'trait0' AS j, round(b0 / nbar * M * 1000, 4) AS estimate_k, round(s0 / nbar * M * 1000, 4) AS se_k, round(b1, 4) AS intercept, round(s1, 4) AS intercept_se, round(chi, 4) AS mean, cnt AS snps FROM z CROSS JOIN a")
def q_ldsc_h2(spark, sf_dir):
    return report_frame(spark, cell_report(spark, sf_dir, (0,)))


PAIR_SUMS = f"""
j0 AS (SELECT t.SNP, t.N, t.Z, t.A1, v.L2, v.wLD, v.CHR, v.BP FROM trait0 t JOIN variants v ON t.SNP = v.SNP),
j1 AS (SELECT t.SNP, t.N, t.Z, t.A1 FROM trait1 t JOIN variants v ON t.SNP = v.SNP),
cap AS (SELECT greatest(CAST('0.001' AS DOUBLE) * max(N), 80) AS c FROM j0),
p AS (SELECT x.SNP, x.L2, x.wLD, x.CHR, x.BP, x.N AS n1, y.N AS n2, x.Z * x.Z AS c1, y.Z * y.Z AS c2, CASE WHEN x.A1 <> y.A1 THEN -x.Z ELSE x.Z END * y.Z AS zz
 FROM j0 x JOIN j1 y USING (SNP) WHERE x.Z * x.Z <= (SELECT c FROM cap) AND y.Z * y.Z <= (SELECT c FROM cap)),
f AS (SELECT *, row_number() OVER (ORDER BY CHR, BP, SNP) - 1 AS rn, count(*) OVER () AS cnt FROM p),
s AS (SELECT avg(zz) AS chi, avg(c1) AS m1, avg(c2) AS m2, avg(L2 * n1) AS l1, avg(L2 * n2) AS l2, sqrt(avg(n1) * avg(n2)) AS nbar, CAST(max(cnt) AS BIGINT) AS cnt, (SELECT CAST(count(*) AS DOUBLE) FROM variants) AS M FROM f),
a AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), M * (m1 - 1) / l1)) AS g1, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), M * (m2 - 1) / l2)) AS g2 FROM s),
w AS (SELECT f.*, sqrt(1 / (2 * power(1 + g1 * n1 / M * greatest(f.L2, 1), 2)) / greatest(wLD, 1)) AS w1, sqrt(1 / (2 * power(1 + g2 * n2 / M * greatest(f.L2, 1), 2)) / greatest(wLD, 1)) AS w2 FROM f CROSS JOIN a),
u AS (SELECT *, w1 / greatest(sum(w1) OVER (), 1) AS ux, (w1 + w2) / greatest(sum(w1 + w2) OVER (), 1) AS uy FROM w),
bs AS (SELECT {BLOCK_SQL} AS b, sum(ux*ux*L2*L2) AS xx, sum(ux*ux*L2) AS x1, sum(ux*ux) AS o, sum(ux*L2*uy*zz) AS xy, sum(ux*uy*zz) AS y FROM u GROUP BY 1)"""


@query(f"WITH {PAIR_SUMS}, {JACK_SQL} SELECT 'trait0' AS i, 'trait1' AS j, round(b0 / nbar * M * 1000, 4) AS estimate_k, round(s0 / nbar * M * 1000, 4) AS se_k, round(b1, 4) AS intercept, round(s1, 4) AS intercept_se, round(chi, 4) AS mean, cnt AS snps FROM z CROSS JOIN a")
def q_ldsc_gcov(spark, sf_dir):
    return report_frame(spark, [r for r in cell_report(spark, sf_dir, (0, 1)) if r["i"] != r["j"]])


@query(f"WITH {SUMS_SQL}, {JACK_SQL} SELECT round(s0 * 1e6, 4) AS slope_se, round(s1, 6) AS intercept_se FROM z")
def q_jackknife_se(spark, sf_dir):
    m = float(variants(spark, sf_dir).count())
    sums = ldsc.block_sums(ldsc.weighted(h2_rows(spark, sf_dir), m), BLOCKS).toPandas()  # one row for each block
    xtx = np.stack([sums[["xx", "x1"]].to_numpy(), sums[["x1", "oo"]].to_numpy()], 1)
    _, pseudo = ldsc.jackknife(xtx, sums[["xy", "y1"]].to_numpy())
    se = np.sqrt(pseudo.var(axis=0, ddof=1) / len(pseudo))
    return spark.createDataFrame([(round(float(se[0] * 1e6), 4), round(float(se[1]), 6))], "slope_se double, intercept_se double")


@query(f"SELECT trait, round(median(Z * Z) / (power({probit_sql(chr(39).join(['CAST(', '0.75', ' AS DOUBLE)']))}, 2)), 6) AS lambda_gc FROM (SELECT 0 AS trait, Z FROM trait0 UNION ALL SELECT 1, Z FROM trait1) GROUP BY trait")
def q_lambda_gc(spark, sf_dir):
    rows = reduce(DataFrame.union, (trait(spark, sf_dir, t).select(F.lit(t).alias("trait"), "Z") for t in (0, 1)))
    return ldsc.genomic_control(rows).select("trait", F.round("lambda_gc", 6).alias("lambda_gc"))


@query("""SELECT i, j, round(sum(x), 6) AS x FROM (SELECT unnest([0,0,0,1,1,1,2,2,2]) AS i, unnest([0,1,2,0,1,2,0,1,2]) AS j,
 unnest([b*b, b*annot1, b*annot2, annot1*b, annot1*annot1, annot1*annot2, annot2*b, annot2*annot1, annot2*annot2]) AS x FROM (SELECT CAST(1 AS DOUBLE) AS b, annot1, annot2 FROM variants)) GROUP BY i, j""")
def q_annot_overlap(spark, sf_dir):
    annot = variants(spark, sf_dir).select(F.lit(1.0).alias("base"), "annot1", "annot2")
    m = stratified.overlap(annot, ["base", "annot1", "annot2"])
    return spark.createDataFrame([(i, j, round(float(x), 6)) for (i, j), x in np.ndenumerate(m)], "i int, j int, x double")


@query(f"""WITH f AS (SELECT v.CHR, v.BP, v.SNP, v.annot1 * L2 AS x1, v.annot2 * L2 AS x2, L2 AS x0, Z * Z AS y, row_number() OVER (ORDER BY v.CHR, v.BP, v.SNP) - 1 AS rn, count(*) OVER () AS cnt FROM trait0 JOIN variants v USING (SNP))
SELECT CAST(rn * {BLOCKS} // cnt AS INT) AS block, round(sum(x0*x0), 4) AS s00, round(sum(x0*x1), 4) AS s01, round(sum(x1*x1), 4) AS s11, round(sum(x2*x2), 4) AS s22, round(sum(x0*y), 4) AS s0y FROM f GROUP BY 1""")
def q_sldsc_block_sums(spark, sf_dir):
    rows = trait(spark, sf_dir, 0).select("SNP", "Z").join(variants(spark, sf_dir), "SNP")
    told = rows.select("CHR", "BP", "SNP", F.array("L2", F.col("annot1") * F.col("L2"), F.col("annot2") * F.col("L2")).alias("x"), F.lit(1.0).alias("w"), (F.col("Z") * F.col("Z")).alias("y"))
    sums = stratified.block_matrices(told.select(F.lit(0).alias("i"), F.lit(0).alias("j"), "*"), 3, BLOCKS)
    out = [(b, *(round(float(x), 4) for x in (s[0, 0], s[0, 1], s[1, 1], s[2, 2], s[0, 4]))) for (_, _, b), s in sums.items()]
    return spark.createDataFrame(out, "block int, s00 double, s01 double, s11 double, s22 double, s0y double")


@query("SELECT SNP, CHR, BP FROM (SELECT SNP, CHR, BP * 1000 AS BP FROM variants) WHERE NOT (CHR = 6 AND BP BETWEEN 25000000 AND 34000000)")
def q_mhc_filter(spark, sf_dir):
    return qc.outside_mhc(variants(spark, sf_dir).select("SNP", "CHR", (F.col("BP") * 1000).alias("BP")))


PANEL = "concat(replace(p_brand, '#', '_'), '/', p_type)"


def twas_effects_sql(t: int, n: float, binary: bool, perm: bool) -> str:
    p = "CASE WHEN pv = 1 AND pn > 0 THEN (pn - 1) / pn WHEN pv = 0 AND pn > 0 THEN 1 / pn ELSE pv END"
    z = f"(CASE WHEN z0 < 0 THEN -1 ELSE 1 END) * (CASE WHEN half = CAST('0.5' AS DOUBLE) THEN 0 ELSE -{probit_sql('half')} END)" if perm else "z0"
    size = f"sqrt(CAST('{n / 4 if binary else n}' AS DOUBLE) * HSQ)"
    se = "abs(e / nullif(z, 0))" if perm or not binary else f"1 / nullif({size}, 0)"
    source = f'SELECT HSQ, FILE, ID, "TWAS.Z" AS z0, "PERM.PV" AS pv, "PERM.N" AS pn FROM twas{t}'
    inner = f"SELECT HSQ, FILE, ID, {z} AS z FROM (SELECT *, ({p}) / 2 AS half FROM ({source}))"
    effects = f"SELECT HSQ, FILE, ID, e, {se} AS s FROM (SELECT *, z / nullif({size}, 0) AS e FROM ({inner}))"
    root = f"nullif(sqrt(e * e * HSQ + {LOGISTIC}), 0)" if binary else "1"
    return f"SELECT HSQ, replace(FILE, '/panels//', '') AS Panel, ID AS Gene, e / {root} AS beta, s / {root} AS se FROM ({effects})"


def rounded_genes(df):
    return df.select(*(r6(F.col(f"`{c}`")).alias(c.replace(".", "_")) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"SELECT {q6('HSQ')} AS HSQ, Panel, Gene, {q6('beta')} AS beta_a, {q6('se')} AS se_a FROM ({twas_effects_sql(0, 50000.0, True, False)}) WHERE beta IS NOT NULL AND se IS NOT NULL")
def q_twas_binary(spark, sf_dir):
    return rounded_genes(twas.read_fusion([views.twas(spark, sf_dir, 0)], ["a"], [50000.0], [True]))


@query(f"SELECT {q6('HSQ')} AS HSQ, Panel, Gene, {q6('beta')} AS beta_a, {q6('se')} AS se_a FROM ({twas_effects_sql(0, 50000.0, True, True)}) WHERE beta IS NOT NULL AND se IS NOT NULL")
def q_twas_perm(spark, sf_dir):
    return rounded_genes(twas.read_fusion([views.twas(spark, sf_dir, 0)], ["a"], [50000.0], [True], perm=True))


@query(f"SELECT {q6('x.HSQ')} AS HSQ, Panel, Gene, {q6('x.beta')} AS beta_a, {q6('x.se')} AS se_a, {q6('y.beta')} AS beta_b, {q6('y.se')} AS se_b FROM ({twas_effects_sql(0, 50000.0, True, False)}) x JOIN ({twas_effects_sql(1, 80000.0, False, False)}) y USING (Gene, Panel) WHERE x.beta IS NOT NULL AND x.se IS NOT NULL AND y.beta IS NOT NULL AND y.se IS NOT NULL")
def q_twas_merge(spark, sf_dir):
    return rounded_genes(twas.read_fusion([views.twas(spark, sf_dir, t) for t in (0, 1)], ["a", "b"], [50000.0, 80000.0], [True, False]))


@query("SELECT ID, replace(FILE, '/panels//', '') AS panel FROM twas0")
def q_panel_path(spark, sf_dir):
    return views.twas(spark, sf_dir, 0).select("ID", twas.panel_name().alias("panel"))


@query("SELECT SNP, round(SE * sqrt(CAST('1.21' AS DOUBLE)) * 2 * MAF * (1 - MAF) * (SE * sqrt(CAST('1.21' AS DOUBLE)) * 2 * MAF * (1 - MAF)) * 1e6, 6) AS v11, round(SE * SE * CAST('1.21' AS DOUBLE) * CAST('0.1' AS DOUBLE) * power(2 * MAF * (1 - MAF), 2) * 1e6, 6) AS v12 FROM trait0 JOIN (SELECT SNP, MAF FROM variants) USING (SNP)")
def q_vsnp_gc(spark, sf_dir):
    structure = Covariance(["a", "b"], np.eye(2), np.eye(3), np.array([[1.21, 0.1], [0.1, 1.21]]), np.ones(3), 1.0)
    options = gwas.Options()

    def run(batches):
        for b in batches:
            se = np.column_stack([b["SE"], b["SE"]])
            _, V = gwas.snp_covariances(np.zeros_like(se), se, 2 * b["MAF"].to_numpy() * (1 - b["MAF"].to_numpy()), structure, options)
            yield b[["SNP"]].assign(v11=V[:, 1, 1] * 1e6, v12=V[:, 1, 2] * 1e6)

    rows = trait(spark, sf_dir, 0).select("SNP", "SE").join(variants(spark, sf_dir).select("SNP", "MAF"), "SNP")
    return rows.mapInPandas(run, "SNP string, v11 double, v12 double").select("SNP", F.round("v11", 6).alias("v11"), F.round("v12", 6).alias("v12"))


@query(f"SELECT SNP, {q6('e / s')} AS z, {q6(f'greatest(2 * {norm_sf_sql(chr(97))}, CAST(0 AS DOUBLE))')} AS p FROM (SELECT SNP, EFFECT AS e, SE AS s, abs(EFFECT / SE) AS a FROM trait0)")
def q_gwas_pvals(spark, sf_dir):
    none = {c: F.lit(None).cast("double") for c in ("Q", "Q_SNP", "Z_smooth")}
    df = trait(spark, sf_dir, 0).select("SNP", F.col("EFFECT").alias("est"), F.col("SE").alias("se_c"), F.lit(1).alias("Q_df")).withColumns(none)
    return gwas.with_p_values(df).select("SNP", r6("Z_Estimate").alias("z"), r6("Pval_Estimate").alias("p"))


@query("SELECT round(sqrt(avg(power((EFFECT - P) / (SE * N), 2))) * 1e4, 6) AS local_srmd FROM trait0")
def q_local_srmd(spark, sf_dir):
    rows = trait(spark, sf_dir, 0).select(F.col("EFFECT").alias("unconstrained"), F.col("P").alias("constrained"), F.col("SE").alias("sd_left"), F.col("N").alias("sd_right"))
    return posthoc.local_srmd(rows).select(F.round(F.col("local_srmd") * 1e4, 6).alias("local_srmd"))


@query("SELECT CHR, round(quantile_cont(L2, 0.95), 6) AS q FROM variants GROUP BY CHR")
def q_quantile_type7(spark, sf_dir):
    return posthoc.quantiles(variants(spark, sf_dir), "CHR", "L2", 0.95, "q").select("CHR", F.round("q", 6).alias("q"))


@query("SELECT round(covar_pop(x.Z, CASE WHEN x.A2 = y.A2 THEN y.Z ELSE -y.Z END) / var_pop(x.Z), 6) AS rho FROM trait0 x JOIN trait1 y USING (SNP)")
def q_rho_slope(spark, sf_dir):
    from lociq.operators.hdl import z_slope

    return spark.createDataFrame([(round(z_slope(trait(spark, sf_dir, 0), trait(spark, sf_dir, 1)), 6),)], "rho double")


def piece_regressions(spark, sf_dir, steps):
    """piece, h2: the likelihood's starting value in pieces of 40 SNPs."""
    from lociq.operators.hdl import start_h2

    def run(key, rows):
        return pd.DataFrame({"piece": [key[0]], "h2": [start_h2(rows["c"].to_numpy(), rows["L2"].to_numpy(), 0.5, steps)]})

    rows = trait(spark, sf_dir, 0).select("SNP", (F.col("Z") * F.col("Z")).alias("c")).join(variants(spark, sf_dir), "SNP")
    pieces = rows.select(F.floor(F.col("pk") / 40).alias("piece"), "c", "L2").groupBy("piece").applyInPandas(run, "piece long, h2 double")
    return pieces.select("piece", F.round("h2", 4).alias("h2"))


PIECES_SQL = "WITH r AS (SELECT CAST(floor(pk / 40) AS BIGINT) AS piece, Z * Z AS c, L2 AS x FROM trait0 JOIN variants USING (SNP)), h AS (SELECT piece, CAST(count(*) AS DOUBLE) AS m, regr_slope(c, x) * count(*) AS h2 FROM r GROUP BY piece)"


@query(f"{PIECES_SQL} SELECT piece, round(coalesce(h2, 0), 4) AS h2 FROM h")
def q_ols(spark, sf_dir):
    return piece_regressions(spark, sf_dir, 1)


@query(f"""{PIECES_SQL}, w AS (SELECT piece, m, c, x, 1 / power(coalesce(h2, 0) * x / m + 2, 2) AS w FROM r JOIN h USING (piece)),
s AS (SELECT *, sum(w * x) OVER (PARTITION BY piece) / sum(w) OVER (PARTITION BY piece) AS middle FROM w)
SELECT piece, round(coalesce(sum(w * (x - middle) * c) / nullif(sum(w * (x - middle) * (x - middle)), 0) * max(m), 0), 4) AS h2 FROM s GROUP BY piece""")
def q_wls(spark, sf_dir):
    return piece_regressions(spark, sf_dir, 2)


@query("""WITH n AS (SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) AS i FROM (SELECT DISTINCT p_brand FROM part))
SELECT CAST(row_number() OVER (ORDER BY c.i, r.i) - 1 AS INT) AS pos, r.name AS "row", c.name AS col FROM n r JOIN n c ON r.i >= c.i""")
def q_index_s(spark, sf_dir):
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand").distinct().orderBy("p_brand")
    return posthoc.index_s(spark, [r.p_brand for r in brands.collect()])  # one row for each trait


def measures(lineitem: DataFrame) -> DataFrame:
    """part of the table, and there the correlations of three sums of the quantity with something else."""
    shared = "double(l_quantity) / 14"
    x, y, z = (F.expr(f"{shared} + {e}") for e in ("double(l_discount) * 30", "double(l_tax) * 40", "double(l_partkey % 7) / 2"))
    one = F.lit(1.0)
    return lineitem.groupBy((F.col("l_suppkey") % 50).alias("part")).agg(F.array(one, F.corr(x, y), F.corr(x, z), one, F.corr(y, z), one).alias("S"))


@query("""WITH c AS (SELECT l_suppkey % 50 AS part, corr(x, y) AS a, corr(x, z) AS b, corr(y, z) AS c FROM (SELECT l_suppkey, l_quantity::DOUBLE / 14 + l_discount::DOUBLE * 30 AS x,
 l_quantity::DOUBLE / 14 + l_tax::DOUBLE * 40 AS y, l_quantity::DOUBLE / 14 + (l_partkey % 7)::DOUBLE / 2 AS z FROM lineitem) GROUP BY 1),
e AS (SELECT part, unnest(['F=~y', 'F=~z', 'F~~F', 'x~~x', 'y~~y', 'z~~z']) AS parameter, unnest([c / b, c / a, a * b / c, 1 - a * b / c, 1 - a * c / b, 1 - b * c / a]) AS est FROM c)
SELECT part, parameter, round(est, 5) + 0.0 AS est FROM e""")
def q_factor_by_part(spark, sf_dir):
    structures = measures(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).withColumn("weights", F.array_repeat(F.lit(1.0), 6))
    out = models.fit_many(structures, "F =~ x + y + z", ["x", "y", "z"])
    return out.where("not (op = '=~' and rhs = 'x')").select("part", F.concat("lhs", "op", "rhs").alias("parameter"), (F.round("est", 5) + 0.0).alias("est"))


MEANS_SQL = "g AS (SELECT CHR::DOUBLE AS x, avg(EFFECT) AS y, count(*) / var_samp(EFFECT) AS w FROM trait0 JOIN (SELECT SNP, CHR FROM variants) USING (SNP) GROUP BY CHR), d AS (SELECT sum(w) AS s, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy, min(x) AS low, max(x) AS high FROM g), b AS (SELECT *, s * sxx - sx * sx AS det, (sxx * sy - sx * sxy) / (s * sxx - sx * sx) AS b0, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b1 FROM d)"


def chromosome_means(spark, sf_dir):
    """(mean effect, its sampling variance as a diagonal matrix, chromosome)"""
    rows = trait(spark, sf_dir, 0).join(variants(spark, sf_dir).select("SNP", "CHR"), "SNP")
    got = rows.groupBy("CHR").agg(F.avg("EFFECT").alias("y"), (F.var_samp("EFFECT") / F.count("*")).alias("v")).orderBy("CHR").toPandas()  # one row for each chromosome
    return got["y"].to_numpy(), np.diag(got["v"].to_numpy()), got["CHR"].to_numpy(float)


@query(f"WITH {MEANS_SQL} SELECT unnest(['intercept', 'CHR']) AS term, round(unnest([b0, b1]) * 1e6, 4) AS beta, round(unnest([sqrt(sxx / det), sqrt(s / det)]) * 1e6, 4) AS se, round(unnest([b0 / sqrt(sxx / det), b1 / sqrt(s / det)]), 6) AS z FROM b")
def q_gls_chromosomes(spark, sf_dir):
    got = posthoc.summary_gls(*chromosome_means(spark, sf_dir))
    rows = [(term, round(r.betas * 1e6, 4), round(r.SE * 1e6, 4), round(r.Z, 6)) for term, r in zip(("intercept", "CHR"), got.itertuples(), strict=True)]
    return spark.createDataFrame(rows, "term string, beta double, se double, z double")


@query(f"WITH {MEANS_SQL}, p AS (SELECT *, low + unnest(generate_series(0, 19)) * (high - low) / 20 AS x FROM b), f AS (SELECT x, b0 + b1 * x AS fit, sqrt((sxx - 2 * x * sx + x * x * s) / det) AS se FROM p) SELECT round(x, 6) AS predictor, round(fit * 1e6, 4) AS fit, round((fit + se) * 1e6, 4) AS upper, round((fit - se) * 1e6, 4) AS lower FROM f")
def q_gls_bands_chromosomes(spark, sf_dir):
    got = posthoc.gls_bands(*chromosome_means(spark, sf_dir))
    rows = [(round(r.Predictors, 6), *(round(x * 1e6, 4) for x in (r.Fit, r.Upper, r.Lower))) for r in got.itertuples()]
    return spark.createDataFrame(rows, "predictor double, fit double, upper double, lower double")


def pseudo_sql(t: int | None) -> str:
    """block, scaled pseudo-value of the slope of one trait, or of both together."""
    return f"(WITH {PAIR_SUMS if t is None else SUMS_SQL.replace('trait0', f'trait{t}')}, {JACK_SQL} SELECT b, p0 / nbar * M AS p FROM pv CROSS JOIN a)"


@query(f"""SELECT u, v, round(covar_samp(p, q) / {BLOCKS} * 1e6, 4) AS v_k FROM
(SELECT b, unnest([0, 0, 0, 1, 1, 2]) AS u, unnest([0, 1, 2, 1, 2, 2]) AS v, unnest([x.p, x.p, x.p, y.p, y.p, z.p]) AS p, unnest([x.p, y.p, z.p, y.p, z.p, z.p]) AS q
 FROM {pseudo_sql(0)} x JOIN {pseudo_sql(None)} y USING (b) JOIN {pseudo_sql(1)} z USING (b)) GROUP BY u, v""")
def q_ldsc_v(spark, sf_dir):
    v = variants(spark, sf_dir)
    c, _ = ldsc.ldsc([trait(spark, sf_dir, t) for t in (0, 1)], v, v.select("SNP", "wLD"), float(v.count()), ["a", "b"], n_blocks=BLOCKS, cap="first")
    return spark.createDataFrame([(i, j, round(float(c.V[i, j] * 1e6), 4)) for i in range(3) for j in range(i, 3)], "u int, v int, v_k double")


@query(f"WITH {SUMS_SQL.replace('ORDER BY CHR, BP, SNP', 'ORDER BY P, SNP').replace('t.Z, v.L2', 't.Z, t.P, v.L2')}, {JACK_SQL} SELECT round(b0 / nbar * M * 1000, 4) AS estimate_k, round(s0 / nbar * M * 1000, 4) AS se_k, round(s1, 4) AS intercept_se FROM z CROSS JOIN a")
def q_ldsc_input_order(spark, sf_dir):
    v = variants(spark, sf_dir)
    ordered = trait(spark, sf_dir, 0).orderBy("P", "SNP")
    _, report = ldsc.ldsc([ordered], v, v.select("SNP", "wLD"), float(v.count()), ["trait0"], n_blocks=BLOCKS, order="input")
    r = report[0]
    return spark.createDataFrame([tuple(round(float(x), 4) for x in (r["estimate"] * 1000, r["se"] * 1000, r["intercept_se"]))], "estimate_k double, se_k double, intercept_se double")


def own_folder(spark, label):
    from lociq.functions.rows import shared_folder

    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query(f"SELECT SNP, CHR, BP, {q6('L2')} AS L2, {q6('wLD')} AS wLD FROM variants WHERE CHR % 2 = 1 AND CHR <= 9")
def q_ld_score_files(spark, sf_dir):
    from lociq.sources import tables as T

    folder = own_folder(spark, "ld")  # a file for each chromosome, as they are published
    for c in T.chromosomes("ODD", 9):
        v = variants(spark, sf_dir).where(F.col("CHR") == c)
        v.select("CHR", "SNP", "BP", "L2", "wLD").write.csv(f"{folder}/{c}.l2.ldscore.gz", sep="\t", header=True, compression="gzip")
    scores = T.read_ld_scores(spark, folder, "ODD", 9)
    return scores.drop("wLD").join(T.as_weights(scores), "SNP").select("SNP", "CHR", "BP", r6("L2").alias("L2"), r6("wLD").alias("wLD"))


@query(f"SELECT SNP, N, {q6('Z')} AS Z, A1, A2 FROM ({MUNGED})")
def q_munged_file(spark, sf_dir):
    from lociq.sources import tables as T

    path = own_folder(spark, "munged")
    T.write_munged(clean.munge(trait(spark, sf_dir, 0).drop("Z"), variants(spark, sf_dir), info=0.6), path)
    read = T.canonical(T.read_table(spark, path), ["SNP", "N", "Z", "A1", "A2"])
    return read.select("SNP", "N", r6("Z").alias("Z"), "A1", "A2")


@query(f"SELECT SNP, A1, {q6('EFFECT')} AS EFFECT, CASE WHEN CAST(substr(SNP, 3) AS BIGINT) % 7 <> 0 THEN {q6('P')} END AS P, N FROM trait0")
def q_white_space_file(spark, sf_dir):
    """Fields between runs of blanks, some in quotes, missing ones as NA, under other names for the columns; every part begins with these, as the
    first line of a table may stand in any."""
    from lociq.sources import tables as T

    path, names = own_folder(spark, "lines"), "rsid  A1 beta pval   N"
    p = F.when(F.substr("SNP", F.lit(3)).cast("long") % 7 != 0, F.col("P").cast("string")).otherwise("NA")
    blanks = lambda n: F.lit(" " * n)
    line = F.concat(F.col("SNP"), blanks(3), F.lit('"'), "A1", F.lit('"'), blanks(2), F.col("EFFECT").cast("string"), blanks(1), p, blanks(2), F.col("N").cast("string"))
    trait(spark, sf_dir, 0).select(line.alias(names)).write.csv(path, sep="\x01", header=True, quote="", escapeQuotes=False)
    read = T.canonical(T.read_table(spark, path), ["SNP", "A1", "EFFECT", "P", "N"])
    return read.select("SNP", "A1", r6("EFFECT").alias("EFFECT"), r6("P").alias("P"), "N")


# Models: not to be told in SQL; tests hold them against closed forms and independent computations.


def structure(spark, sf_dir, k: int = 3) -> Covariance:
    """The covariance structure of k traits with planted heritability, by LD-score regression over the tables."""
    v = variants(spark, sf_dir)
    traits = [views.planted(spark, sf_dir, t) for t in range(k)]
    return ldsc.ldsc(traits, v, v.select("SNP", "wLD"), 1e5, [f"t{t}" for t in range(k)], n_blocks=100, stand=True)[0]


def snp_table(spark, sf_dir):
    df = merged(spark, sf_dir, ["ols", "linprob", "se_logit"])
    return df.select("SNP", "CHR", "BP", "MAF", "A1", "A2", *(f"`{c}.t{t}`" for t in range(3) for c in ("beta", "se")))


@query()
def q_commonfactor(spark, sf_dir):
    return models.result_frames(spark, models.common_factor(structure(spark, sf_dir, 4)))[0]


@query()
def q_usermodel(spark, sf_dir):
    return models.result_frames(spark, models.user_model(structure(spark, sf_dir, 4), "F =~ NA*t0 + t1 + t2 + t3\nF ~~ 1*F\nt0 ~~ t1"))[1]


@query()
def q_rgmodel(spark, sf_dir):
    from lociq.sources.tables import matrix_frame

    return matrix_frame(spark, models.genetic_correlations(structure(spark, sf_dir, 3))[0])


@query()
def q_commonfactor_gwas(spark, sf_dir):
    return gwas.common_factor_gwas(snp_table(spark, sf_dir), structure(spark, sf_dir, 3))


@query()
def q_user_gwas(spark, sf_dir):
    text = "F1 =~ NA*t0 + t1 + t2\nF1 ~~ 1*F1\nF1 ~ SNP"
    return gwas.user_gwas(snp_table(spark, sf_dir), structure(spark, sf_dir, 3), text, gwas.Options(sub=("F1~SNP",), q_snp=True))


@query()
def q_summary_gls(spark, sf_dir):
    c = structure(spark, sf_dir, 3)
    y = np.array([c.S[i, j] for i, j in ldsc.vech_index(3)])
    return spark.createDataFrame(posthoc.summary_gls(y, c.V, np.arange(6.0)))


@query()
def q_gls_bands(spark, sf_dir):
    c = structure(spark, sf_dir, 3)
    y = np.array([c.S[i, j] for i, j in ldsc.vech_index(3)])
    return spark.createDataFrame(posthoc.gls_bands(y, c.V, np.arange(6.0), quad=True))


@query()
def q_pa(spark, sf_dir):
    c = structure(spark, sf_dir, 4)
    return posthoc.parallel_analysis(spark, c.S, c.V)[0]


@query()
def q_sim(spark, sf_dir):
    from lociq.operators.simulate import simulate

    v = variants(spark, sf_dir)
    return simulate(v, structure(spark, sf_dir, 3).S, np.array([5e4, 6e4, 7e4]), float(v.count()), replicates=2)


@query()
def q_sldsc(spark, sf_dir):
    v = variants(spark, sf_dir)
    annot = v.select("SNP", "CHR", "BP", F.col("L2").alias("base"), (F.col("annot1") * F.col("L2")).alias("a1"), (F.col("annot2") * F.col("L2")).alias("a2"))
    names = ["base", "a1", "a2"]
    zero_one = v.select(F.lit(1.0).alias("base"), F.col("annot1").alias("a1"), F.col("annot2").alias("a2"))
    overlaps = stratified.overlap(zero_one, names)
    out = stratified.s_ldsc([trait(spark, sf_dir, t) for t in (0, 1)], annot, names, v.select("SNP", "wLD"), np.diag(overlaps), overlaps, ["t0", "t1"], n_blocks=BLOCKS)
    rows = [(a, i, j, float(out.S[n][i, j]), float(out.S_tau[n][i, j])) for n, a in enumerate(names) for i in range(2) for j in range(2)]
    return spark.createDataFrame(rows, "annotation string, i int, j int, total double, tau double")


def stratified_structure(spark, sf_dir) -> StratifiedCovariance:
    v = variants(spark, sf_dir)
    names = ["base", "coding", "enhancer_flanking"]
    scores = v.select("SNP", "CHR", "BP", *(x.alias(n) for n, x in zip(names, (F.col("L2"), F.col("annot1") * F.col("L2"), F.col("annot2") * F.col("L2")), strict=True)))
    annot = v.select(*(x.alias(n) for n, x in zip(names, (F.lit(1.0), F.col("annot1"), F.col("annot2")), strict=True)))
    overlaps = stratified.overlap(annot, names)
    scale = 1e5 / overlaps[0, 0]
    traits = [views.planted(spark, sf_dir, t) for t in range(4)]
    return stratified.s_ldsc(traits, scores, names, v.select("SNP", "wLD"), np.diag(overlaps) * scale, overlaps * scale, [f"t{t}" for t in range(4)], n_blocks=100)


@query()
def q_enrich(spark, sf_dir):
    from lociq.operators.enrich import enrich

    return enrich(spark, stratified_structure(spark, sf_dir), "F =~ NA*t0 + t1 + t2 + t3\nF ~~ 1*F", ["F~~F"], rm_flank=False)


@query()
def q_enrich_base(spark, sf_dir):
    from lociq.operators.enrich import base_results

    return base_results(spark, stratified_structure(spark, sf_dir), "F =~ NA*t0 + t1 + t2 + t3\nF ~~ 1*F", ["F~~F"])


@query()
def q_qtrait(spark, sf_dir):
    from lociq.operators.qtrait import qtrait

    return qtrait(spark, structure(spark, sf_dir, 5), ["t0", "t1", "t2", "t3"], ["t4"])


def ld_pieces(spark, sf_dir):
    """Pieces of 40 SNPs with eigenvalues from their LD scores."""
    v = variants(spark, sf_dir).withColumn("piece", F.concat(F.lit("p"), F.floor(F.col("pk") / 40)))
    at = F.array_sort(F.collect_list(F.struct("pk", "SNP", "A2", "L2")))
    return v.groupBy("piece").agg(at.alias("s")).select("piece", F.col("s.SNP").alias("snps"), F.col("s.A2").alias("a2"), F.col("s.L2").alias("ldsc"), F.transform("s", lambda x: 1 + x["L2"] / 10).alias("lam"), F.transform("s", lambda x, i: F.transform("s", lambda y, j: F.when(i == j, 1.0).otherwise(0.0))).alias("v"))


def hdl_frame(spark, sf_dir, **options):
    from lociq.operators.hdl import hdl, load_gwas

    return hdl(ld_pieces(spark, sf_dir), [load_gwas(trait(spark, sf_dir, t)) for t in (0, 1)], ["t0", "t1"], **options).frame(spark)


@query()
def q_hdl(spark, sf_dir):
    return hdl_frame(spark, sf_dir)


@query()
def q_hdl_jackknife(spark, sf_dir):
    return hdl_frame(spark, sf_dir, method="jackknife")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heritability of three traits by LD-score regression, from raw tables on."""
    return report_frame(spark, [r for r in cell_report(spark, sf_dir, (0, 1, 2)) if r["i"] == r["j"]])
