import math
import statistics
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.functions import qc
from lociq.functions.normal import chi2_sf, norm_sf, probit, two_sided_p, z_from_p
from lociq.operators.clean import Trait, as_reference, effects_report, large_effects, merge_traits, munge, removal_report
from lociq.operators.twas import panel_name, read_fusion

GWAS = "SNP string, A1 string, A2 string, EFFECT double, SE double, P double, N double, INFO double, DIRECTION string"


def gwas(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (9 - len(r))) for r in rows], GWAS)


def test_probit_and_tail(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.02425, 0.074, 0.076, 0.3, 0.5, 0.9, 0.999999]
    got = [r.z for r in spark.createDataFrame([(x,) for x in p], "p double").select(probit("p").alias("z")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-9)
    z = [-9.0, -1.0, 0.0, 0.5, 1.959964, 6.9, 7.2, 20.0, 36.0, 38.0]
    tails = [r.t for r in spark.createDataFrame([(x,) for x in z], "z double").select(norm_sf("z").alias("t")).collect()]
    assert tails == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in z], rel=1e-7, abs=1e-290)
    outside = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (None,)], "p double").select(probit("p").alias("z")).collect()
    assert all(r.z is None for r in outside)


def test_z_from_p(spark):
    rows = [(1.0, 0.2), (0.05, -0.2), (0.0, 0.2), (-1.0, 0.2), (2.0, 0.2), (0.05, 0.0), (0.05, None)]
    got = [r.z for r in spark.createDataFrame(rows, "P double, EFFECT double").select(z_from_p().alias("z")).collect()]
    assert got == [0.0, pytest.approx(-1.959964, abs=1e-6), None, None, None, pytest.approx(1.959964, abs=1e-6), None]


def test_chi_square_tail():
    assert chi2_sf(3.841458821, 1) == pytest.approx(0.05)
    assert chi2_sf([2.0, 50.0, 0.0], [2, 10, 3]) == pytest.approx([math.exp(-1), 2.669083e-7, 1.0], rel=1e-6)
    assert np.isnan(chi2_sf(1.0, 0)) and two_sided_p(100.0) == 5e-300


def test_alleles(spark):
    df = spark.createDataFrame([("a", "G", "A", 0.2, "A", "G"), ("b", "A", "C", 0.2, "A", "G"), ("c", "A", "G", 0.2, "A", "G"), ("d", None, "G", 0.2, "A", "G")], "SNP string, A1 string, A2 string, EFFECT double, A1_REF string, A2_REF string")
    flipped = {r.SNP: r.EFFECT for r in qc.flip_effect(df).collect()}
    assert flipped == {"a": -0.2, "b": 0.2, "c": 0.2, "d": None}
    twice = qc.flip_effect(qc.flip_effect(df))
    assert {r.SNP: r.EFFECT for r in twice.where("SNP <> 'd'").collect()} == {"a": 0.2, "b": 0.2, "c": 0.2}
    assert sorted(r.SNP for r in qc.keep_matching_alleles(df).collect()) == ["a", "c"]
    pairs = spark.createDataFrame([("A", "T"), ("C", "G"), ("A", "G"), (None, "T")], "A1 string, A2 string")
    assert qc.drop_strand_ambiguous(pairs).count() == 2
    assert qc.keep_acgt(qc.upper_alleles(gwas(spark, [("x", "a", "g"), ("y", "I", "D"), ("z", None, "A")]))).count() == 1


def test_directions_and_maf(spark):
    df = spark.createDataFrame([(d,) for d in ("++-", "+?-", "???", "?+?", None, "")], "DIRECTION string")
    assert [r.DIRECTION for r in qc.keep_directions(df).collect()] == ["++-", "+?-", ""]
    m = spark.createDataFrame([(0.0,), (0.3,), (0.8,), (1.0,), (None,)], "MAF double")
    assert [r.VAR_SNP for r in qc.with_snp_variance(m).collect()] == pytest.approx([0.42, 0.32])


@pytest.mark.parametrize("values", [[0.2, 0.8], [0.2, 0.79], [0.5], [0.4], [0.1, 0.5, 0.9], [0.1, 0.4, 0.9], [1.0, 2.0], [1.0, 1.9], [-5.0, 0.5, 0.5, 7.0], [0.3, 0.3, None, 0.9, 0.9], [], [None]])
def test_median_reaches(spark, values):
    df = spark.createDataFrame([(x,) for x in values], "x double")
    known = sorted(x for x in values if x is not None)
    for bound in (0.5, 1.5):
        got = df.agg(qc.median_reaches("x", bound)).first()[0]
        assert bool(got) == (bool(known) and statistics.median(known) >= bound)


def test_odds_ratios(spark):
    ratios = gwas(spark, [(f"r{i}", "A", "G", x) for i, x in enumerate((0.9, 1.02, 1.3))])
    assert sorted(r.EFFECT for r in qc.log_of_odds_ratios(ratios).collect()) == pytest.approx([math.log(0.9), math.log(1.02), math.log(1.3)])
    betas = gwas(spark, [("a", "A", "G", 0.49), ("b", "A", "G", 0.4), ("c", "A", "G", 0.5)])
    assert sorted(r.EFFECT for r in qc.log_of_odds_ratios(betas).collect()) == [0.4, 0.49, 0.5]


def test_duplicates_go_altogether(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "SNP string")
    for f in (qc.drop_all_duplicates, qc.drop_all_duplicates_by_window):
        assert "b" not in {r.SNP for r in f(df).collect()} and "a" in {r.SNP for r in f(df).collect()}


def test_duplicates_are_found_in_one_reading(spark):
    df = spark.range(6).selectExpr("concat('s', id % 4) AS SNP", "id AS `a.b`", "nullif(id, 3) AS c")
    got = qc.drop_all_duplicates(df)
    assert got.columns == ["SNP", "a.b", "c"] and sorted(map(tuple, got.collect())) == [("s2", 2, 2), ("s3", 3, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_mhc(spark):
    df = spark.createDataFrame([(6, 25_000_000), (6, 34_000_000), (6, 34_000_001), (5, 30_000_000), (None, 1)], "CHR int, BP long")
    assert qc.outside_mhc(df).count() == 3


def test_standard_effects(spark):
    df = spark.createDataFrame([(4.0, 1000.0, 0.5, 0.1, 0.02), (0.0, 1000.0, 0.5, 0.1, 0.02), (4.0, 0.0, 0.5, 0.1, 0.02)], "Z double, N double, VAR_SNP double, EFFECT double, SE double")
    ols = qc.standard_effects(df, "ols").collect()
    assert ols[0].BETA_STD == pytest.approx(4 / math.sqrt(500)) and ols[0].SE_STD == pytest.approx(1 / math.sqrt(500))
    assert ols[1].SE_STD is None and ols[2].BETA_STD is None
    d = math.sqrt(0.01 * 0.5 + math.pi**2 / 3)
    logit = qc.standard_effects(df, "se_logit").first()
    assert (logit.BETA_STD, logit.SE_STD) == pytest.approx((0.1 / d, 0.02 / d))
    assert qc.standard_effects(df, "or").first().SE_STD == pytest.approx(0.02 / math.exp(0.1) / d)
    with pytest.raises(ValueError, match="unknown kind"):
        qc.standard_effects(df, "no such")


REF = "SNP string, A1 string, A2 string, MAF double, CHR int, BP long"


def panel(spark):
    return spark.createDataFrame([("a", "A", "G", 0.2, 1, 1), ("b", "A", "T", 0.3, 1, 2), ("c", "C", "T", 0.001, 1, 3), ("d", "g", "a", 0.4, 2, 1)], REF)


def test_munge(spark):
    rows = [("a", "G", "A", 0.2, 0.1, 0.05, 100.0, 0.95), ("b", "A", "T", 0.2, 0.1, 0.05, 100.0, 0.5), ("c", "C", "A", 0.2, 0.1, 0.05, 100.0, 0.95), ("d", "g", "a", -0.2, 0.1, 0.01, 100.0, 0.95), ("e", "A", "G", 0.2, 0.1, 0.05, 100.0, 0.95), ("a", "A", "G", None, 0.1, 0.05, 100.0, 0.95)]
    got = {r.SNP: r for r in munge(gwas(spark, rows), panel(spark)).collect()}
    assert set(got) == {"a", "d"} and got["a"].Z == pytest.approx(-1.959964, abs=1e-6) and got["d"].Z < 0
    assert {r.N for r in munge(gwas(spark, rows), panel(spark), n=5.0).collect()} == {5.0}


def test_merge_traits(spark):
    rows = [("a", "G", "A", 0.2, 0.1, 0.05, 100.0, 0.95), ("d", "G", "A", 0.1, 0.1, 0.5, 100.0, 0.95), ("b", "A", "T", 0.2, 0.1, 0.05, 100.0, 0.95)]
    t = gwas(spark, rows)
    out = merge_traits([Trait("x", t, "ols"), Trait("y", t, "se_logit")], panel(spark), ambiguous=False)
    got = {r.SNP: r for r in out.collect()}
    assert set(got) == {"a", "d"} and {"beta.x", "se.x", "beta.y", "se.y", "CHR", "BP"} <= set(out.columns)
    assert got["a"]["beta.x"] < 0 < got["d"]["beta.x"] and not large_effects(out, "x") and effects_report(out, ["x"]).first().mean_abs_z > 0
    assert as_reference(panel(spark), maf=0.01).count() == 3
    assert [r.removed for r in removal_report([("all", t), ("a", t.where("SNP = 'a'"))]).collect()] == [0, 2]


def test_panel_and_fusion(spark):
    paths = spark.createDataFrame([("/a//b/c.dat",), ("x",), ("p/q",), (None,)], "FILE string").select(panel_name().alias("p"))
    assert [r.p for r in paths.collect()] == ["b/c.dat", "x", "p/q", ""]
    rows = [("/p/q", "g1", 2.0, 0.1, 1.0, 10.0), ("/p/q", "g2", -3.0, 0.2, 0.0, 10.0), ("/p/q", "g3", None, 0.2, 0.5, 10.0)]
    t = spark.createDataFrame(rows, "FILE string, ID string, `TWAS.Z` double, HSQ double, `PERM.PV` double, `PERM.N` double")
    got = {r.Gene: r for r in read_fusion([t, t], ["x", "y"], [1000.0, 1000.0], [False, True]).collect()}
    assert set(got) == {"g1", "g2"} and got["g1"]["beta.x"] == pytest.approx(2 / math.sqrt(100)) and got["g1"]["se.x"] == pytest.approx(0.1)
    perm = {r.Gene: r for r in read_fusion([t], ["x"], [1000.0], [False], perm=True).collect()}
    assert perm["g2"]["beta.x"] == pytest.approx(NormalDist().inv_cdf(0.05) / math.sqrt(200)) and perm["g1"]["beta.x"] > 0
    assert qc.implausible_p(gwas(spark, [("a", "A", "G", 0.1, 0.1, 1.5), ("b", "A", "G", 0.1, 0.1, 0.5)])) == 1
    assert t.select(F.count("*")).first()[0] == 3
