import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.operators.hdl import PIECE, bhat, fit_own, fit_piece, hdl, load_gwas, z_slope
from lociq.streaming.incremental import munge_stream


def test_piece_recovers_heritability():
    rng = np.random.default_rng(0)
    m, n, h2 = 600, 20000.0, 0.3
    lam = rng.gamma(2, 1, m)
    b = rng.normal(0, np.sqrt(h2 / m * lam**2 + lam / n))
    got = fit_piece(lam**2, lam, np.eye(m), b, n, 1e12)
    assert abs(got[0] - h2) < 0.1 and 0.3 < got[1] < 2


def test_pieces(spark):
    rng = np.random.default_rng(1)
    n, m, pieces = 20000.0, 60, 8
    S = np.array([[0.3, 0.15], [0.15, 0.3]]) / pieces
    rows, z = [], []
    for p in range(pieces):
        lam = rng.gamma(2, 1, m)
        root = np.linalg.cholesky(S)
        effects = (root @ rng.normal(size=(2, m))) * lam / np.sqrt(m)
        b = effects + rng.normal(size=(2, m)) * np.sqrt(lam / n)
        names = [f"p{p}s{i}" for i in range(m)]
        rows.append((f"p{p}", names, ["G"] * m, (lam**2).tolist(), lam.tolist(), np.eye(m).tolist()))
        z += [(s, n, "G" if i % 3 else "A", float(b[0, i] * np.sqrt(n) * (1 if i % 3 else -1)), float(b[1, i] * np.sqrt(n))) for i, s in enumerate(names)]
    df = spark.createDataFrame(z, "SNP string, N double, A2 string, Z double, y double")
    t0 = load_gwas(df.select("SNP", "N", "A2", "Z"))
    t1 = load_gwas(df.select("SNP", "N", F.lit("G").alias("A2"), F.col("y").alias("b"), F.lit(1.0).alias("se")))
    c = hdl(spark.createDataFrame(rows, PIECE), [t0, t1], ["a", "b"], n_ref=1e12)
    assert abs(c.S[0, 0] - 0.3) < 0.15 and abs(c.S[0, 1] - 0.15) < 0.15 and c.V.shape == (3, 3) and c.m == m * pieces
    assert 0 < z_slope(t0, t1) < 1.5
    together = hdl(spark.createDataFrame(rows, PIECE), [t0, t1], ["a", "b"], n_ref=1e12, method="jackknife")
    lam = np.array([r[4] for r in rows])
    of = {r.piece: np.array(r.bhat) for r in bhat(spark.createDataFrame(rows, PIECE), t0, 0).collect()}
    star = np.stack([of[f"p{p}"] for p in range(pieces)])  # eigenvectors are those of the identity
    at = lambda keep, start: fit_own(lam[keep].ravel(), star[keep].ravel(), float(m * pieces), n, 1e12, start)
    first = sum(fit_piece(lam[p] ** 2, lam[p], np.eye(m), star[p], n, 1e12)[0] for p in range(pieces))
    full = at(np.ones(pieces, bool), np.array([first, 1.0]))
    left = np.array([at(np.arange(pieces) != p, full)[0] for p in range(pieces)])
    assert together.S[0, 0] == pytest.approx(full[0], rel=1e-6) and together.I[0, 0] == pytest.approx(full[1], rel=1e-6)
    assert together.V[0, 0] == pytest.approx(left.var(ddof=1) * (pieces - 1), rel=1e-4) and abs(together.S[0, 1] - 0.15) < 0.15 and together.m == m * pieces
    with pytest.raises(ValueError, match="method"):
        hdl(spark.createDataFrame(rows, PIECE), [t0, t1], ["a", "b"], method="other")
    some = bhat(spark.createDataFrame([("x", ["p0s0", "none"], ["G", "G"], [1.0], [1.0], [[1.0]])], PIECE), t0, 0).first()
    assert some.bhat[1] == 0.0 and abs(some.bhat[0] - z[0][3] * -1 / np.sqrt(n)) < 1e-12


def test_query_takes_every_variant(spark, tmp_path, monkeypatch):
    """Pieces of 40 SNPs, as many as the table asks for; S, V and m are those of all pieces, told here piece by piece."""
    from lociq.operators import hdl as module
    from lociq.plans import registry, views

    n = 250
    spark.range(1, n + 1).selectExpr("id AS p_partkey", "'b' AS p_brand", "'t' AS p_type", "CAST(id % 7 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    lines = spark.range(n * 12).selectExpr("1 + id % 250 AS l_partkey", "(id DIV 250) % 3 AS l_suppkey", "1.0D + pmod(xxhash64(id), 50) AS l_quantity", "0.05D AS l_discount", "0.02D AS l_tax")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = {}
    monkeypatch.setattr(module, "hdl", lambda *a, f=module.hdl, **k: seen.setdefault("c", seen.update(pieces=a[0], traits=a[1]) or f(*a, **k)))
    assert registry.q_hdl(spark, str(tmp_path)).count() == 13
    c, pieces = seen["c"], seen["pieces"].collect()
    assert c.m == n and sorted(s for p in pieces for s in p.snps) == sorted(f"rs{i}" for i in range(1, n + 1))
    size = module.sample_sizes(seen["traits"][0])[0]
    effects = {r.piece: r.bhat for r in bhat(seen["pieces"], load_gwas(views.trait(spark, str(tmp_path), 0)), 0).collect()}
    own = np.array([fit_piece(np.array(p.ldsc), np.array(p.lam), np.array(p.v), np.array(effects[p.piece]), size, 335_265) for p in pieces])
    left = len(own) / (len(own) - 1) * (own[:, 0].sum() - own[:, 0])
    assert np.isclose(c.S[0, 0], own[:, 0].sum()) and np.isclose(c.I[0, 0], own[:, 1].mean()) and np.isclose(c.V[0, 0], left.var(ddof=1) * (len(own) - 1))


def test_last_duplicate_stays(spark):
    df = spark.createDataFrame([("a", 1.0, "G", 1.0), ("a", 1.0, "G", 2.0)], "SNP string, N double, A2 string, Z double").coalesce(1)
    assert load_gwas(df).first().Z == 2.0


def test_stream_as_batch(spark, tmp_path):
    from lociq.operators.clean import munge

    kind = "SNP string, A1 string, A2 string, EFFECT double, P double, N double"
    ref = spark.createDataFrame([(f"rs{i}", "A", "G", 0.3) for i in range(20)], "SNP string, A1 string, A2 string, MAF double")
    parts = [spark.createDataFrame([(f"rs{i}", "A", "G", 0.1 * (i - 5), 0.01 * (i + 1), 10.0) for i in range(a, a + 10)], kind) for a in (0, 10)]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = munge_stream(spark, str(tmp_path / "in"), kind, ref, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = sorted(tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(tuple(r)[:3] for p in parts for r in munge(p, ref).collect())


def test_eigenvalues_that_pieces_share_travel_once(spark, monkeypatch):
    """Refits without a piece take its sums from those of all; what travels grows with distinct eigenvalues, not with SNPs."""
    from lociq.operators import hdl as module

    rng, n, m, pieces = np.random.default_rng(2), 5000.0, 20, 12
    lam = np.tile(rng.gamma(4, 1, m), (pieces, 1))
    b = rng.normal(size=(pieces, 2, m)) * np.sqrt(0.3 * lam**2 / (m * pieces) + lam / n)[:, None]
    rows = [(f"p{p}", [f"p{p}s{i}" for i in range(m)], ["G"] * m, (lam[p] ** 2).tolist(), lam[p].tolist(), np.eye(m).tolist()) for p in range(pieces)]
    traits = [spark.createDataFrame([(f"p{p}s{i}", n, "G", float(b[p, t, i] * np.sqrt(n))) for p in range(pieces) for i in range(m)], "SNP string, N double, A2 string, Z double") for t in (0, 1)]
    monkeypatch.setattr(module, "MOST_VALUES", 5 * m)
    c = hdl(spark.createDataFrame(rows, PIECE), traits, ["a", "b"], n_ref=1e12, method="jackknife")
    at = lambda keep, start: fit_own(lam[keep].ravel(), b[keep][:, 0].ravel(), float(m * pieces), n, 1e12, start)
    full = at(np.ones(pieces, bool), np.array([0.1, 1.0]))
    left = np.array([at(np.arange(pieces) != p, full)[0] for p in range(pieces)])
    assert 0 < full[0] < 1 and np.isclose(c.S[0, 0], full[0], rtol=1e-8) and np.isclose(c.V[0, 0], left.var(ddof=1) * (pieces - 1), rtol=1e-6)
    monkeypatch.setattr(module, "MOST_VALUES", 5 * m - 1)
    with pytest.raises(ValueError, match="distinct eigenvalues"):
        hdl(spark.createDataFrame(rows, PIECE), traits, ["a", "b"], n_ref=1e12, method="jackknife")


def test_pieces_fitted_at_once_reach_their_minima():
    """Pieces of unequal sizes, stacked, have the estimates of each alone, where nothing near is less."""
    from lociq.operators.hdl import fit_pieces, own_variance

    rng, n = np.random.default_rng(3), 11000.0
    pieces = []
    for m in (40, 7, 33, 40, 1):
        lam = rng.gamma(3, 1, m) + 0.5
        b = rng.normal(size=(2, m)) * np.sqrt(0.4 * lam**2 / m + lam / n)
        pieces.append((lam**2, lam, b, b))
    sizes, rho = [(n, n), (n, n)], {(0, 1): 0.0, (1, 0): 0.0}
    together = fit_pieces(pieces, 2, sizes, rho, 335_265)
    for at, piece in enumerate(pieces):
        assert all(np.allclose(x[at], y[0], rtol=1e-6, atol=1e-9) for x, y in zip(together, fit_pieces([piece], 2, sizes, rho, 335_265), strict=True))
        lam, star = piece[1], piece[2][0]
        loss = lambda p: float((np.log(v := own_variance(p, lam, len(lam), n, 335_265)) + star**2 / v).sum())  # noqa: B023, E731
        best = together[0][at]
        near = [np.clip(best + np.array([i, j]), [0, 0], [1, 10]) for i in (-1e-4, 0, 1e-4) for j in (-1e-3, 0, 1e-3)]
        assert all(loss(x) >= loss(best) - 1e-9 for x in near)
