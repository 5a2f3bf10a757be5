import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.operators import gwas, ldsc, posthoc, stratified
from lociq.functions.rows import sum_arrays, with_position, with_row_number
from lociq.operators.enrich import NOT_ANALYSED, base_results, enrich
from lociq.operators.qtrait import qtrait
from lociq.operators.sem.fit import _descend, fit, fit_dwls, smooth, vech_rows
from lociq.operators.sem.model import compile_model, model_from_table, subset
from lociq.operators.sem.models import common_factor, fit_many, genetic_correlations, result_frames, standardised, user_model
from lociq.operators.sem.text import ModelError, evaluate, parse
from lociq.operators.simulate import simulate
from lociq.sources.tables import Covariance, StratifiedCovariance

LOADINGS = np.array([0.8, 0.7, 0.6, 0.5])


def one_factor(k=4, noise=0.0):
    S = np.outer(LOADINGS[:k], LOADINGS[:k])
    np.fill_diagonal(S, 1.0)
    E = np.random.default_rng(0).normal(0, noise, (k, k)) if noise else np.zeros((k, k))
    size = k * (k + 1) // 2
    return Covariance([f"t{i}" for i in range(k)], S + E + E.T, np.eye(size) * 1e-4, np.eye(k), np.ones(size), 1e6)


def test_parser():
    spec = parse("f1 =~ y1 + 0.5*y2 # note\n y2 ~ f1; y1 ~~ y2\n\nA + B ~ XF // two\nb ~ start(.3)*c + lab*d\nx := lab*2\nlab > .0001")
    assert [x.key for x in spec.lines] == ["f1=~y1", "f1=~y2", "y2~f1", "y1~~y2", "A~XF", "B~XF", "b~c", "b~d"]
    assert spec.lines[1].value == 0.5 and spec.lines[6].start == 0.3 and spec.lines[7].label == "lab"
    assert spec.constraints == [("lab", ">", 0.0001)] and spec.defines == [("x", "lab*2")]
    for bad in ("a b ~ c", "a ~ 1.5.2*b", "nothing here", "a > b"):
        with pytest.raises(ModelError):
            parse(bad)
    with pytest.raises(ModelError, match="neither"):
        compile_model("F =~ t0 + typo", ["t0", "t1"])


def test_expressions():
    assert evaluate("-x^2 + pow(2, 3) * exp(0)", {"x": 3}) == -1
    assert evaluate("(a + .5) / 2", {"a": 1.5}) == 1 and math.isnan(evaluate("nope", {})) and math.isnan(evaluate("1 / 0", {}))


def test_vech_and_blocks(spark):
    assert ldsc.vech(np.array([[1, 2], [3, 4]])).tolist() == [1, 3, 4]
    assert ldsc.vech_index(3) == [(0, 0), (1, 0), (2, 0), (1, 1), (2, 1), (2, 2)]
    for n, blocks in ((10, 3), (57, 20), (5, 9), (1, 4)):
        rows = spark.createDataFrame([(0, 0, f"{i:03d}", 1, i) for i in range(n)], "i int, j int, SNP string, CHR int, BP int")
        got = [r.block for r in ldsc.in_blocks(rows, blocks).orderBy("BP").collect()]
        starts = [max(0, math.floor(1 + b * (n - 1) / blocks) - 1) for b in range(blocks)] + [n]
        starts[-1] = n
        want = [max(b for b in range(blocks) if starts[b] <= i) for i in range(n)]
        assert got == want


def test_one_factor_recovered():
    got = common_factor(one_factor())
    assert got.theta[:4] == pytest.approx(LOADINGS, abs=1e-6) and got.chisq == pytest.approx(0, abs=1e-9) and got.df == 2 and got.cfi() == 1.0
    exact = common_factor(one_factor(3, 0.02))
    assert exact.df == 0 and math.isnan(exact.chisq) and math.isnan(exact.aic)
    S = exact.S
    assert exact.theta[0] == pytest.approx(math.sqrt(S[0, 1] * S[0, 2] / S[1, 2]), rel=1e-6)


def test_ml_close_to_dwls():
    c = one_factor(4, 0.01)
    a, b = common_factor(c), common_factor(c, "ML")
    assert b.converged and a.theta[:4] == pytest.approx(b.theta[:4], abs=0.02)


def test_jacobian_and_default_variance():
    m = compile_model("f =~ t0 + t1\ng =~ t2 + t3\ng ~ f\nt0 ~~ t3", [f"t{i}" for i in range(4)])
    theta = np.random.default_rng(1).uniform(0.2, 0.9, m.n_free)[None]
    _, T, full = m.implied(theta)
    J = m.jacobian(T, full)[0]
    num = np.stack([(vech_rows(m.implied(theta + h)[0]) - vech_rows(m.implied(theta - h)[0]))[0] / 2e-6 for h in np.eye(m.n_free)[:, None] * 1e-6], 1)
    assert J == pytest.approx(num, abs=1e-7)
    empty = compile_model("", ["y1"], np.array([[2.0]]))
    assert empty.implied(empty.start[None])[0][0] == pytest.approx(np.array([[2.0]]))
    assert subset("F =~ t1 + t10", ["t1", "t10", "t0"]) == ["t1", "t10"]


def test_smoothing_and_bounds():
    m, bad = smooth(np.array([[[1.0, 2.0], [2.0, 1.0]], [[1.0, 0.5], [0.5, 1.0]]]))
    assert bad.tolist() == [True, False] and np.linalg.eigvalsh(m[0])[0] > 0
    got = fit(compile_model("F =~ NA*t0 + t1 + t2\nF ~~ 1*F\nt0 ~~ r*t0\nr > 0.5", ["t0", "t1", "t2"]), one_factor(3).S, np.eye(6) * 1e-4)
    assert next(x["est"] for x in got.estimates() if x["label"] == "r") >= 0.5


def test_defined_parameter_and_frames(spark):
    got = user_model(one_factor(), "F =~ NA*t0 + a*t1 + t2 + t3\nF ~~ 1*F\ntwice := 2*a")
    d = {x["lhs"]: x for x in got.estimates() if x["op"] == ":="}["twice"]
    a = next(x for x in got.estimates() if x["label"] == "a" and x["op"] == "=~")
    assert d["est"] == pytest.approx(2 * a["est"]) and d["se"] == pytest.approx(2 * a["se"], rel=1e-5)
    parameters, stats = result_frames(spark, got)
    assert parameters.count() == len(got.estimates()) and stats.first().df == 2


def test_correlations():
    R, V = genetic_correlations(one_factor(3))
    assert np.allclose(R, one_factor(3).S, atol=1e-6) and V.shape == (3, 3)
    assert V[0, 0] > 1e-4


def snps(spark, n=40):
    rng = np.random.default_rng(2)
    rows = [(f"rs{i}", 1, i, 0.1 + 0.3 * rng.random(), "A", "G", *(float(x) for t in range(3) for x in (rng.normal(0, 0.02), 0.01))) for i in range(n)]
    rows.append(("bad", 1, n, 0.2, "A", "G", None, 0.01, 0.0, 0.01, 0.0, 0.01))
    return spark.createDataFrame(rows, "SNP string, CHR int, BP int, MAF double, A1 string, A2 string, `beta.t0` double, `se.t0` double, `beta.t1` double, `se.t1` double, `beta.t2` double, `se.t2` double")


def test_gwas_as_single_fits(spark):
    c, df = one_factor(3), snps(spark)
    got = {r.SNP: r for r in gwas.common_factor_gwas(df, c).collect()}
    assert len(got) == 41 and got["bad"].est is None and got["bad"].fail != "0"
    spread = {r.SNP: r for r in gwas.common_factor_gwas(df.repartition(7), c).collect()}
    row = df.where("SNP = 'rs3'").first()
    beta, se, var = np.array([[row[f"{x}.t{t}"] for t in range(3)] for x in ("beta", "se")]).reshape(2, 1, 3).tolist() + [2 * row.MAF * (1 - row.MAF)]
    S, V = gwas.snp_covariances(np.array(beta), np.array(se), np.array([var]), c, gwas.Options())
    one = fit(compile_model("F1 =~ t0 + t1 + t2\nF1 ~ SNP\nt0 ~ 0*SNP\nt1 ~ 0*SNP\nt2 ~ 0*SNP", ["SNP", *c.names], S[0]), S[0], V[0])
    p = next(x for x in one.estimates() if x["lhs"] == "F1" and x["op"] == "~")
    assert got["rs3"].est == pytest.approx(p["est"], rel=1e-5) and got["rs3"].se_c == pytest.approx(p["se"], rel=1e-5)
    for k, r in got.items():
        if k != "bad":
            assert spread[k].est == pytest.approx(r.est, rel=1e-9) and 0 <= r.Pval_Estimate <= 1 and r.Q >= 0


MARKER = np.array([[0.321, 0.183, 0.173], [0.183, 0.298, 0.193], [0.173, 0.193, 0.298]])


@pytest.mark.parametrize("v", [1e-2, 1e-3, 1e-4])
def test_marker_scaled_factor(v):
    """Three indicators: the loadings are ratios of covariances, by least squares as by maximum likelihood."""
    (a, b, c) = MARKER[0, 1], MARKER[0, 2], MARKER[1, 2]
    model = compile_model("F1 =~ x + y + z", ["x", "y", "z"], MARKER)
    got, ml = fit(model, MARKER, np.eye(6) * v), fit(model, MARKER, np.eye(6) * v, "ML")
    assert got.converged and np.allclose(got.theta, ml.theta, atol=1e-6)
    assert {p.key: got.theta[p.free] for p in model.parameters if p.free >= 0 and p.op == "=~"} == pytest.approx({"F1=~y": c / b, "F1=~z": c / a})
    assert got.full[3, 3] == pytest.approx(a * b / c)


@pytest.mark.parametrize("text", ["F =~ a + c + e\nG =~ b + d + f", "F =~ a + c + e\nG =~ b + d + f\nF ~ G", "F =~ NA*a + c + e\nG =~ NA*b + d + f\nF ~~ 1*F\nG ~~ 1*G", "F =~ a + c + e\nG =~ b + d + f\nH =~ 1*F + 1*G"])
def test_two_factors_from_any_loadings(text):
    """Matrices that a model implies are fitted without rest; those with noise end where ten other starts end at best."""
    rng = np.random.default_rng(4)
    load = np.zeros((60, 6, 2))
    for j in range(6):
        load[:, j, j % 2] = rng.uniform(0.3, 1, 60) * rng.choice([-1, 1, 1], 60)
    S = load @ np.array([[1, 0.4], [0.4, 1]]) @ load.transpose(0, 2, 1) + np.eye(6) * rng.uniform(0.2, 0.6, (60, 6))[:, None, :]
    noise = rng.normal(0, 0.02, (60, 6, 6))
    w = rng.uniform(50, 200, (1, 21)) * np.ones((60, 1))
    model = compile_model(text, list("abcdef"), S[0])
    cost = lambda theta, S: (w * (vech_rows(S) - vech_rows(model.implied(theta)[0])) ** 2).sum(axis=1)
    theta, ok = fit_dwls(model, S, w)
    assert ok.all() and cost(theta, S).max() < 1e-8
    S = S + (noise + noise.transpose(0, 2, 1)) / 2
    theta, ok = fit_dwls(model, S, w)
    assert ok.all()
    for _ in range(10):
        other, fine, value = _descend(model, S, w, theta * rng.normal(1, 0.4, theta.shape), model.lower)
        assert (cost(theta, S) <= value * (1 + 1e-6) + 1e-9)[fine].all()


def test_fits_are_made_once_and_spread(spark):
    """A fit each, whatever the partitions of the input, in as many tasks as asked for, in the order of the input."""
    c, df = one_factor(3), snps(spark, 1200).coalesce(1)
    counted = spark.sparkContext.accumulator(0)
    real = gwas.fit_batch

    def counting(model, S, V, options):
        counted.add(len(S))
        return real(model, S, V, options)

    gwas.fit_batch = counting
    try:
        made = gwas.common_factor_gwas(df, c)
        rows = made.collect()
    finally:
        gwas.fit_batch = real
    assert counted.value == 1201 and [r.SNP for r in rows] == [r.SNP for r in df.collect()]
    assert made.rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, 2)


def test_failed_fits_have_no_estimates(spark, monkeypatch):
    real = gwas.fit_batch

    def failing(model, S, V, options):
        return real(model, S, V, options) | {"ok": np.arange(len(S)) % 2 == 0}

    monkeypatch.setattr(gwas, "fit_batch", failing)
    rows = gwas.common_factor_gwas(snps(spark, 9).coalesce(1), one_factor(3)).collect()
    assert [r.fail for r in rows] == ["0", "not converged"] * 4 + ["0", "input missing or not positive"]
    for r in rows:
        values = (r.est, r.se_c, r.Q, r.Q_SNP, r.Z_smooth, r.Z_Estimate, r.Pval_Estimate, r.Q_pval)
        assert all(x is None for x in values) if r.fail != "0" else None not in values


def test_user_gwas_and_control(spark):
    c, df = one_factor(3), snps(spark, 10)
    text = "F1 =~ NA*t0 + t1 + t2\nF1 ~~ 1*F1\nF1 ~ SNP"
    out = gwas.user_gwas(df, c, text, gwas.Options(sub=("F1~SNP", "F1=~t1"), q_snp=True))
    assert out.count() == 22 and out.where("lhs = 'F1' and op = '~' and SNP <> 'bad'").agg(F.min("Q_SNP_df")).first()[0] == 2
    assert set(gwas.by_parameter(out, ["F1~SNP"])) == {"F1~SNP"}
    I = np.array([[1.44, 0.2, 0], [0.2, 0.9, 0], [0, 0, 1.0]])  # noqa: E741
    wide = Covariance(c.names, c.S, c.V, I, c.N, c.m)
    v = {k: gwas.snp_covariances(np.ones((1, 3)), np.full((1, 3), 0.1), np.array([0.5]), wide, gwas.Options(gc=k))[1][0, 1, 1] for k in ("none", "standard", "conserv")}
    assert v["standard"] == pytest.approx(v["none"] * 1.44) and v["conserv"] == pytest.approx(v["none"] * 1.44**2)
    with pytest.raises(ValueError, match="traits"):
        gwas.user_gwas(df.drop("beta.t2"), c, text)


def test_gls_limits():
    rng = np.random.default_rng(3)
    x, y = np.arange(10.0), rng.normal(size=10)
    got = posthoc.summary_gls(y, np.eye(10), x)
    assert got["betas"].tolist()[::-1] == pytest.approx(np.polyfit(x, y, 1).tolist())
    bands = posthoc.gls_bands(y, np.eye(10), x, intervals=5)
    assert (bands["Upper"] >= bands["Lower"]).all() and bands["Fit"][0] == pytest.approx(got["betas"][0])


def test_parallel_analysis_is_seeded(spark):
    c = one_factor()
    a, n = posthoc.parallel_analysis(spark, c.S, c.V, r=40, seed=3)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    b, _ = posthoc.parallel_analysis(spark, c.S, c.V, r=40, seed=3)
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert [r.parallel for r in a.collect()] == [r.parallel for r in b.collect()] and n == 1
    fa, _ = posthoc.parallel_analysis(spark, c.S, c.V, r=10, factor_analysis=True)
    assert fa.count() == 4 and posthoc.scree(fa).count() == 8
    assert posthoc.minres(c.S) == pytest.approx(LOADINGS**2, abs=1e-3)
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]])
    assert np.linalg.eigvalsh(posthoc.near_correlation(bad))[0] > -1e-6
    values, V = posthoc.sub_sv(c, [1, 2])
    assert values == pytest.approx([c.S[1, 0], c.S[2, 0]]) and V.shape == (2, 2)
    assert posthoc.index_s(spark, c.names, diagonal=False).count() == 6


def simulated(spark, S, n, snps=3000, replicates=1):
    rng = np.random.default_rng(5)
    scores = spark.createDataFrame([(f"rs{i}", 1 + i % 22, i, float(x), float(x)) for i, x in enumerate(rng.gamma(2, 25, snps))], "SNP string, CHR int, BP int, L2 double, wLD double")
    z = simulate(scores, S, n, 3000.0, replicates=replicates)
    return scores, [z.where(F.col("trait") == t).select("SNP", "N", "Z", "A1") for t in range(len(S))]


def test_simulated_heritability_recovered(spark):
    S = np.array([[0.4, 0.2], [0.2, 0.3]])
    scores, traits = simulated(spark, S, np.array([4000.0, 5000.0]))
    c, report = ldsc.ldsc(traits, scores, scores.select("SNP", "wLD"), 3000.0, ["a", "b"], n_blocks=50, chisq_max=1e6, stand=True)
    se = np.sqrt(np.diag(c.V))
    for u, (i, j) in enumerate(ldsc.vech_index(2)):
        assert abs(c.S[i, j] - S[i, j]) < 4 * se[u]
    assert np.diag(c.S_stand) == pytest.approx([1, 1]) and len(report) == 3
    assert report[0]["se"] == pytest.approx(se[0], rel=1e-6)
    liable, _ = ldsc.ldsc(traits, scores, scores.select("SNP", "wLD"), 3000.0, ["a", "b"], [ldsc.Prevalence(0.5, 0.01), ldsc.Prevalence()], n_blocks=50, chisq_max=1e6)
    assert liable.S[0, 0] / c.S[0, 0] == pytest.approx(ldsc.liability(ldsc.Prevalence(0.5, 0.01))) and ldsc.blocks_for(19, 200) == 211
    assert ldsc.genomic_control(ldsc.joined_traits(traits, scores, scores.select("SNP", "wLD"))).count() == 2


def test_blocks_in_order_of_the_input(spark):
    """Block sums of numpy regressions over rows in the order of the first trait's table, which isn't that of their places."""
    rng = np.random.default_rng(6)
    n, blocks = 90, 7
    snps = [f"rs{i}" for i in range(n)]
    l2, w = rng.gamma(2, 10, n), rng.gamma(2, 10, n)
    scores = spark.createDataFrame([(s, 1 + i % 3, i, float(l2[i]), float(w[i])) for i, s in enumerate(snps)], "SNP string, CHR int, BP int, L2 double, wLD double")
    orders = [rng.permutation(n), rng.permutation(n)[:80]]
    z = rng.normal(0, 1.5, (2, n))
    traits = [spark.createDataFrame([(snps[i], 1000.0, float(z[t, i]), "A") for i in order], "SNP string, N double, Z double, A1 string").coalesce(1) for t, order in enumerate(orders)]
    args = (traits, scores, scores.select("SNP", "wLD"), 1e4, ["a", "b"])
    got, report = ldsc.ldsc(*args, n_blocks=blocks, chisq_max=1e6, order="input")
    other, _ = ldsc.ldsc(*args, n_blocks=blocks, chisq_max=1e6)
    assert np.allclose(got.S, other.S) and not np.allclose(got.V, other.V)
    slopes = []
    for i, j in ((0, 0), (1, 0), (1, 1)):
        at = np.array([k for k in orders[min(i, j)] if k in set(orders[max(i, j)].tolist())])
        x, y = l2[at], z[i, at] * z[j, at]
        weight = np.zeros(len(at))
        for t in {i, j} if i != j else (i, i):
            h = min(1, max(0, 1e4 * ((z[t, at] ** 2).mean() - 1) / (x * 1000).mean()))
            weight += np.sqrt(1 / (2 * (1 + h * 1000 / 1e4 * np.maximum(x, 1)) ** 2) / np.maximum(w[at], 1))
        first = np.sqrt(1 / (2 * (1 + min(1, max(0, 1e4 * ((z[min(i, j), at] ** 2).mean() - 1) / (x * 1000).mean())) * 1000 / 1e4 * np.maximum(x, 1)) ** 2) / np.maximum(w[at], 1))
        wx, wy = (first / first.sum() if i == j else first / max(first.sum(), 1)), (weight / weight.sum() if i == j else weight / max(weight.sum(), 1))
        starts = [max(0, math.floor(1 + b * (len(at) - 1) / blocks) - 1) for b in range(blocks)] + [len(at)]
        A = np.column_stack([x, np.ones(len(at))]) * wx[:, None]
        parts = [slice(a, b) for a, b in zip(starts, starts[1:])]
        pseudo = ldsc.jackknife(np.stack([A[p].T @ A[p] for p in parts]), np.stack([A[p].T @ (y * wy)[p] for p in parts]))[1]
        slopes.append(pseudo[:, 0])
    V = np.cov(np.array(slopes)) / (1000 * np.sqrt(blocks) / 1e4) ** 2
    assert np.allclose(got.V, V, rtol=1e-8)
    with pytest.raises(ValueError, match="order"):
        ldsc.ldsc(*args, order="size")


def test_models_from_tables():
    """A table of all parameters of a model gives its fit; bounds, labels, equal numbers and definitions count, and nothing is added."""
    c = one_factor(noise=0.02)
    whole = fit(compile_model("F =~ NA*t0 + t1 + t2 + t3\nF ~~ 1*F", c.names, c.S), c.S, c.V)
    table = [{"lhs": e["lhs"], "op": e["op"], "rhs": e["rhs"], "free": e["free"], "est": 0.5 if e["free"] else e["est"]} for e in whole.estimates()]
    again = fit(model_from_table(table, c.names, c.S), c.S, c.V)
    assert np.allclose(again.theta, whole.theta, atol=1e-6) and again.df == whole.df == 2
    tied = [r | {"free": 1, "label": "same"} if r["op"] == "=~" else r for r in table] + [{"lhs": "twice", "op": ":=", "rhs": "2*same"}, {"lhs": "same", "op": "<", "rhs": "0.5"}]
    got = fit(model_from_table(tied, c.names, c.S), c.S, c.V)
    assert got.df == 5 and got.theta[0] == 0.5 and {e["lhs"]: e["est"] for e in got.estimates()}["twice"] == 1.0
    bounded = model_from_table([r | {"lower": 0.7, "upper": float("inf")} if r["rhs"] == "t3" and r["op"] == "=~" else r for r in table], c.names, c.S)
    assert fit(bounded, c.S, c.V).theta[3] == 0.7
    bare = model_from_table([{"lhs": "a", "op": "~~", "rhs": "a", "free": 1, "est": None}], ["a", "b"])
    assert bare.n_free == 1 and len(bare.parameters) == 1
    with pytest.raises(ModelError, match="operator"):
        model_from_table([{"lhs": "a", "op": "?", "rhs": "b"}], ["a", "b"])


def test_many_structures_as_single_fits(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(30):
        load = rng.uniform(0.3, 0.9, 4)
        E = rng.normal(0, 0.02, (4, 4))
        S = np.outer(load, load) + np.diag(rng.uniform(0.2, 0.5, 4)) + E + E.T
        rows.append((i, ldsc.vech(S).tolist(), rng.uniform(10, 90, 10).tolist()))
    bad = [(30, None, [1.0] * 10), (31, [1.0] * 9, [1.0] * 10), (32, [math.nan] * 10, [1.0] * 10)]
    text = "F =~ a + b + c + d"
    df = spark.createDataFrame(rows + bad, "region int, S array<double>, weights array<double>")
    got = {(r.region, r.lhs + r.op + r.rhs): r for r in fit_many(df, text, list("abcd")).collect()}
    assert len(got) == 33 * 9 and all((r.est is None) == (i >= 30) and r.converged == (i < 30) for (i, _), r in got.items())
    for i, s, w in rows:
        S = np.zeros((4, 4))
        for (a, b), x in zip(ldsc.vech_index(4), s, strict=True):
            S[a, b] = S[b, a] = x
        one = fit(compile_model(text, list("abcd"), S), S, np.diag(1 / np.array(w)))
        assert all(got[i, e["lhs"] + e["op"] + e["rhs"]].est == pytest.approx(e["est"], abs=1e-6) for e in one.estimates())
    assert fit_many(df.limit(0), text, list("abcd")).count() == 0


def test_order_of_parameters():
    model = compile_model("t2 ~ G\nt1 ~~ F\nt1 ~~ t0\nG =~ t3 + t0\nF =~ t1 + t0\nF ~~ G", ["t0", "t1", "t2", "t3"])
    want = ["G=~t0", "G=~t3", "F=~t0", "F=~t1", "G~~G", "F~~G", "F~~F", "t0~~t0", "t1~~t0", "t1~~t1", "t2~~t2", "t3~~t3", "t1~~F", "t2~G"]
    assert [p.key for p in model.parameters] == want


def test_cfi_by_refit(spark):
    c = one_factor(noise=0.03)
    got = common_factor(c)
    rest = vech_rows((c.S - np.diag(np.diag(c.S)))[None])[0]
    null = rest @ np.linalg.inv(c.V) @ rest
    assert got.cfi() == pytest.approx(1 - (got.chisq - 2) / (null - 6)) and got.cfi("ML") == pytest.approx(got.cfi(), abs=1e-6)
    assert result_frames(spark, got, cfi=False)[1].first().cfi is None and result_frames(spark, got)[1].first().cfi == pytest.approx(got.cfi())


def test_columns_of_common_factor(spark):
    out = gwas.common_factor_gwas(snps(spark, 3), one_factor(3))
    assert out.columns == ["SNP", "CHR", "BP", "MAF", "A1", "A2", *gwas.COMMON] and {r.rhs for r in out.collect()} == {"SNP"}
    genes = snps(spark, 3).withColumns({"HSQ": F.lit(0.3), "Panel": F.lit("p"), "Gene": F.col("SNP")})
    out = gwas.common_factor_gwas(genes, one_factor(3))
    assert out.columns[:3] == ["HSQ", "Panel", "Gene"] and {r.rhs for r in out.collect()} == {"Gene"}


def test_jackknife_by_refits():
    rng = np.random.default_rng(6)
    X, y = rng.normal(size=(60, 2)), rng.normal(size=60)
    blocks = np.arange(60) // 6
    xtx = np.stack([X[blocks == b].T @ X[blocks == b] for b in range(10)])
    xty = np.stack([X[blocks == b].T @ y[blocks == b] for b in range(10)])
    full, pseudo = ldsc.jackknife(xtx, xty)
    for b in range(10):
        without = np.linalg.lstsq(X[blocks != b], y[blocks != b], rcond=None)[0]
        assert pseudo[b] == pytest.approx(10 * full - 9 * without)


def test_complementary_annotations(spark):
    S = np.array([[0.4]])
    scores, traits = simulated(spark, S, np.array([4000.0]), 2000)
    halves = scores.select("SNP", "CHR", "BP", F.when(F.col("BP") % 2 == 0, F.col("L2")).otherwise(0.0).alias("even"), F.when(F.col("BP") % 2 == 1, F.col("L2")).otherwise(0.0).alias("odd"))
    zero_one = scores.select((F.col("BP") % 2 == 0).cast("double").alias("even"), (F.col("BP") % 2).cast("double").alias("odd"))
    overlaps = stratified.overlap(zero_one, ["even", "odd"])
    assert np.allclose(overlaps, np.eye(2) * 1000)
    out = stratified.s_ldsc(traits, halves, ["even", "odd"], scores.select("SNP", "wLD"), [1000.0, 1000.0], overlaps, ["a"], n_blocks=20)
    for total, tau in zip(out.S, out.S_tau, strict=True):
        assert total == pytest.approx(tau)
    assert stratified.continuous(zero_one.withColumn("c", F.lit(0.5)), ["even", "c"]) == ["c"] and stratified.flanking("x_flanking") == 2
    freq = spark.createDataFrame([("rs1", 0.2), ("rs2", 0.01)], "SNP string, MAF double")
    assert stratified.common_snps(scores, freq).count() == 1
    with pytest.raises(ValueError, match="two annotations"):
        stratified.s_ldsc(traits, halves, ["even"], scores.select("SNP", "wLD"), [1.0], overlaps, ["a"])


def test_stratified_as_plain_regression(spark):
    """Two traits and their covariance, three overlapping annotations: the sums of all cells against one weighted least squares each."""
    rng = np.random.default_rng(4)
    n, p = 600, 3
    x = rng.gamma(2, 10, (n, p))
    w = rng.gamma(2, 5, n)
    z = rng.normal(size=(n, 2)) * 1.2
    size = rng.integers(900, 1100, (n, 2)).astype(float)
    scores = spark.createDataFrame([(f"rs{i:04d}", 1 + i % 3, i, *map(float, x[i])) for i in range(n)], "SNP string, CHR int, BP int, a double, b double, c double")
    weights = spark.createDataFrame([(f"rs{i:04d}", float(w[i])) for i in range(n)], "SNP string, wLD double")
    traits = [spark.createDataFrame([(f"rs{i:04d}", float(size[i, t]), float(z[i, t]), "A" if t == 0 or i % 4 else "G") for i in range(n)], "SNP string, N double, Z double, A1 string") for t in (0, 1)]
    m, overlaps = np.array([600.0, 200.0, 100.0]), rng.uniform(50, 200, (p, p))
    out = stratified.s_ldsc(traits, scores, list("abc"), weights, m, overlaps, ["s", "t"], n_blocks=15)
    total = x.sum(axis=1)
    sign = np.where(np.arange(n) % 4, 1, -1)
    for i, j in ((0, 0), (0, 1), (1, 1)):
        y = z[:, i] ** 2 if i == j else z[:, i] * z[:, j] * sign
        n_bar = np.sqrt(size[:, i].mean() * size[:, j].mean())
        root = np.zeros(n)
        for t in (i, j):
            share = np.clip(m[0] * ((z[:, t] ** 2).mean() - 1) / (total * size[:, t]).mean(), 0, 1)
            root += np.sqrt(1 / (2 * (1 + share * size[:, t] / m[0] * np.maximum(total, 1)) ** 2) / np.maximum(w, 1))
        root /= root.sum()
        scale = size[:, i] / n_bar if i == j else np.ones(n)
        beta = np.linalg.lstsq(np.column_stack([x * (scale * root)[:, None], root]), y * root, rcond=None)[0]
        assert [out.S_tau[a][i, j] for a in range(p)] == pytest.approx(beta[:p] / n_bar * m)
        assert [out.S[a][i, j] for a in range(p)] == pytest.approx((overlaps / m[None]) @ (beta[:p] / n_bar * m)) and out.I[i, j] == pytest.approx(beta[p])


def test_places_and_numbers_of_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(int(c), int(x), i) for i, (c, x) in enumerate(zip(rng.integers(0, 3, 500), rng.permutation(500), strict=True))]
    df = spark.createDataFrame(rows, "c int, x int, i int").repartition(7)
    got = {r.i: (r.place, r.size) for r in with_position(df, ("x",), ("c",), "place", "size").collect()}
    for c in range(3):
        of = sorted((x, i) for d, x, i in rows if d == c)
        assert [got[i] for _, i in of] == [(k, len(of)) for k in range(len(of))]
    kept = spark.range(0, 300, 1, 5).select("id")
    assert [(r.id, r.i) for r in with_row_number(kept, "i").orderBy("id").collect()] == [(k, k + 1) for k in range(300)]
    sums = sum_arrays(spark.range(10).select((F.col("id") % 2).alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")), ["k"], "v")
    assert {r.k: r.v for r in sums.collect()} == {0: [20.0, 5.0], 1: [25.0, 5.0]}


def test_standardised_refit():
    """A fit to the scaled covariance: for an exactly fitting model its estimates are std_all, with standard errors of their own."""
    c = one_factor()
    wide = Covariance(c.names, *ldsc.rescale(c.S, c.V, np.array([2.0, 1.0, 3.0, 0.5])), c.I, c.N, c.m)
    got = common_factor(wide)
    again = standardised(got)
    assert [p["est"] for p in again.estimates()] == pytest.approx([p["std_all"] for p in got.estimates()], abs=1e-5)
    assert again.se[:4] == pytest.approx(common_factor(c).se[:4], rel=1e-4) and (again.se > 0).all()


def test_baseline_results(spark):
    c = one_factor()
    s = StratifiedCovariance(c.names, ["base", "coding"], [c.S] * 2, [c.V] * 2, [c.S] * 2, [c.V] * 2, c.I, c.N, [1.0, 0.3], [1.0, 0.3], [1.0, 1.0])
    rows = base_results(spark, s, "F =~ NA*t0 + t1 + t2 + t3\nF ~~ 1*F", ["F~~F"]).collect()
    assert [r.Fixed_Enrich for r in rows] == sorted(r.Fixed_Enrich for r in rows) and {r.lhs + r.op + r.rhs for r in rows if r.Fixed_Enrich == "Yes"} == {f"F=~t{i}" for i in range(4)}
    assert {r.rhs: r.est for r in rows if r.op == "=~"} == pytest.approx(dict(zip(c.names, LOADINGS, strict=True)), abs=1e-5) and all(r.SE > 0 for r in rows if r.op == "=~")


def test_enrichment(spark):
    c = one_factor()
    S, V = [c.S, c.S * 0.6, c.S * 0.2], [c.V] * 3
    s = StratifiedCovariance(c.names, ["base", "coding", "x_flanking"], S, V, S, V, c.I, c.N, [1.0, 0.3, 0.1], [1.0, 0.3, 0.1], [1.0, 1.0, 2.0])
    text = "F =~ NA*t0 + t1 + t2 + t3\nF ~~ 1*F"
    got = {r.annotation: r for r in enrich(spark, s, text, ["F~~F"]).collect()}
    assert got["base"].Enrichment == pytest.approx(1, abs=1e-4) and got["coding"].Enrichment == pytest.approx(2, abs=1e-3) and "x_flanking" not in got
    assert got["coding"].Enrichment_p < 0.05 and enrich(spark, s, text, ["F~~F"], rm_flank=False).where(F.col("Warning") == NOT_ANALYSED).count() == 1


def test_trait_heterogeneity(spark):
    def with_trait(r):
        S = np.eye(5)
        S[:4, :4] = np.outer(LOADINGS, LOADINGS)
        S[4, :4] = S[:4, 4] = r
        np.fill_diagonal(S, 1.0)
        return Covariance([f"t{i}" for i in range(4)] + ["x"], S, np.eye(15) * 1e-4, np.eye(5), np.ones(15), 1e6)

    names = [f"t{i}" for i in range(4)]
    through = qtrait(spark, with_trait(0.5 * LOADINGS), names, ["x"]).first()
    assert through.heterogeneity_cpm == "No" and through.beta_cpm == pytest.approx(0.5, abs=0.05) and through.unconstrained is None
    single = qtrait(spark, with_trait(0.3 * LOADINGS + np.array([0, 0, 0, 0.5])), names, ["x"]).first()
    assert single.heterogeneity_cpm == "Yes" and single.unconstrained.split(",")[0] == "t3" and single.heterogeneity_fum == "No"
