"""High-definition likelihood: genetic covariance from eigenvalues and eigenvectors of LD pieces.

A piece is one row (its SNPs, LD scores, eigenvalues and eigenvectors); effects of the traits are joined to its
SNPs and brought in order. Each piece is fitted where it lies, and every pair of traits adds the pieces up; or (method
"jackknife") all pieces are fitted together from these fits on. Either way the jackknife leaves one out at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.functions.rows import keep
from lociq.operators.ldsc import Prevalence, liability, rescale, vech_index
from lociq.sources.tables import Covariance

PIECE = "piece string, snps array<string>, a2 array<string>, ldsc array<double>, lam array<double>, v array<array<double>>"
LEAST = float(np.exp(-18))
MOST_VALUES = 20_000_000
#: Eigenvalues of the pieces, or of the refits, that are fitted at once.
STACK = 1 << 16


def load_gwas(table: DataFrame) -> DataFrame:
    """SNP, N, A2, Z: Z, or b / se where there is none. Of repeated SNPs the last in the input stays."""
    z = F.col("Z") if "Z" in table.columns else F.lit(None).cast("double")
    z = F.coalesce(z, F.try_divide(F.col("b"), F.col("se"))) if {"b", "se"} <= {*table.columns} else z
    last = F.row_number().over(Window.partitionBy("SNP").orderBy(F.desc("_at")))
    rows = table.select("SNP", "N", "A2", z.alias("Z"), F.monotonically_increasing_id().alias("_at"))
    return rows.withColumn("_k", last).where("_k = 1").drop("_k", "_at")


def bhat(pieces: DataFrame, gwas: DataFrame, trait: int) -> DataFrame:
    """piece, trait, bhat: Z / sqrt(N) of the piece's SNPs in its order, turned to its A2; 0 where the trait has none."""
    snps = pieces.select("piece", F.posexplode(F.arrays_zip("snps", "a2")).alias("at", "s")).select("piece", "at", F.col("s.snps").alias("SNP"), F.col("s.a2").alias("a2_ref"))
    found = snps.join(gwas, "SNP", "left")
    b = F.try_divide(F.col("Z"), F.sqrt("N"))
    b = F.coalesce(F.when(F.col("A2") == F.col("a2_ref"), b).otherwise(-b), F.lit(0.0))
    return found.groupBy("piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", b.alias("b")))), lambda x: x["b"]).alias("bhat")).withColumn("trait", F.lit(trait))


def sample_sizes(gwas: DataFrame) -> tuple[float, float]:
    """(median, least) N."""
    return tuple(gwas.agg(F.median("N"), F.min(F.when(~F.isnan("N"), F.col("N")))).first())


def z_slope(a: DataFrame, b: DataFrame) -> float:
    """Covariance over the first one's variance of the Z of common SNPs, aligned on A2."""
    both = a.select("SNP", F.col("Z").alias("x"), "A2").join(b.select("SNP", F.col("Z").alias("y"), F.col("A2").alias("o")), "SNP")
    y = F.when(F.col("A2") == F.col("o"), F.col("y")).otherwise(-F.col("y"))
    return both.agg(F.try_divide(F.covar_pop("x", y), F.var_pop("x"))).first()[0] or 0.0


def start_h2(a: np.ndarray, ldsc: np.ndarray, n: float, steps: int = 2, held: np.ndarray | None = None) -> float | np.ndarray:
    """Regression of a on LD scores, by ordinary least squares (one step) and then weighted by the variances that these give (two); for
    each row of a stack, whose SNPs ``held`` tells from what fills up shorter rows."""
    held = np.ones(np.shape(ldsc)) if held is None else held
    m, w = held.sum(axis=-1), held
    h2 = np.zeros(m.shape)
    for _ in range(steps):
        x = ldsc - ((w * ldsc).sum(axis=-1) / w.sum(axis=-1))[..., None]
        ss = (w * x * x).sum(axis=-1)
        h2 = np.where(ss > 0, (w * x * a).sum(axis=-1) / np.where(ss > 0, ss, 1) * m, 0.0)
        var = ((h2 / m)[..., None] * ldsc + 1 / n) ** 2
        w = np.where(var > 0, held / np.where(var > 0, var, 1), 0.0)
        total = w.sum(axis=-1)[..., None]
        w = np.where(total > 0, w / np.where(total > 0, total, 1), held)
    return h2 if np.ndim(h2) else float(h2)


def minimise(f, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(where each of a stack of functions of two bounded parameters is least, its value there): projected Newton steps, halved till they
    lead down; where curvature isn't positive, by its size. f(x, at) gives values, gradients and Hessians of the functions ``at``.

    Steps too small to be told by the value are taken whole, until one is within 1e-7 standard errors."""
    x = np.clip(start, low, high)
    every = np.arange(len(x))
    fx, g, H = f(x, every)
    live = every
    for _ in range(rounds):
        y, gy, Hy = x[live], g[live], H[live]
        free = ~(((y <= low) & (gy > 0)) | ((y >= high) & (gy < 0)))
        gy = gy * free
        Hy = np.where(free[:, :, None] & free[:, None, :], Hy, np.eye(2))
        d = np.sqrt(np.maximum(np.abs(np.einsum("nii->ni", Hy)), 1e-12))
        values, vectors = np.linalg.eigh(Hy / d[:, :, None] / d[:, None, :])
        along = np.einsum("nji,nj->ni", vectors, gy / d) / np.maximum(np.abs(values), 1e-10)
        newton = -np.einsum("nij,nj->ni", vectors, along) / d * free
        fall = -(gy * newton).sum(axis=1)
        going = fall > 1e-14
        live, y, gy, d, newton, fall = live[going], y[going], gy[going], d[going], newton[going], fall[going]
        if not len(live):
            break
        new, moved = y.copy(), np.zeros(len(live), bool)
        whole = (fall <= 1e-9 * (1 + np.abs(fx[live]))) & (values[going] > 0).all(axis=1)
        new[whole], moved[whole] = np.clip(y + newton, low, high)[whole], True
        for step in (newton, -gy / d**2):
            size = 1.0
            while size > 1e-12 and not moved.all():
                at = np.flatnonzero(~moved)
                tried = np.clip(y[at] + size * step[at], low, high)
                got = f(tried, live[at])[0]
                slope = (gy[at] * (tried - y[at])).sum(axis=1)
                ok = np.isfinite(got) & (slope < 0) & (got <= fx[live[at]] + 1e-4 * slope)
                new[at[ok]], moved[at[ok]] = tried[ok], True
                size /= 2
        live, new, y = live[moved], new[moved], y[moved]
        x[live] = new
        fx[live], g[live], H[live] = f(new, live)
        live = live[(new != y).any(axis=1)]
    return x, fx


def by_two(first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) in (p, q) of sums over the last axis, whose terms have these derivatives in p a + q b."""
    g = np.stack([(first * a).sum(axis=1), (first * b).sum(axis=1)], axis=1)
    cross = (second * a * b).sum(axis=1)
    return g, np.stack([(second * a * a).sum(axis=1), cross, cross, (second * b * b).sum(axis=1)], axis=1).reshape(-1, 2, 2)


def own_variance(p: np.ndarray, lam: np.ndarray, m: float | np.ndarray, n: float, n_ref: float) -> np.ndarray:
    h, c = (p[0], p[1]) if np.ndim(p) == 1 else (p[:, :1], p[:, 1:])
    return np.maximum(h / m * lam**2 - h * lam / n_ref + c * lam / n, LEAST)


def fit_own_stack(lam: np.ndarray, held: np.ndarray, squares: np.ndarray, m: np.ndarray, n1: float, n_ref: float, start: np.ndarray) -> np.ndarray:
    """(h2, intercept) of one trait for each row: eigenvalues (one row for all, or one each), how many eigenvectors each stands for (0:
    none), the sums of squared effects on these, and the number of SNPs."""
    lam, m = np.broadcast_to(lam, held.shape), np.asarray(m, float)[:, None]

    def loss(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        l, c, q = lam[at], held[at], squares[at]  # noqa: E741
        v = own_variance(p, l, m[at], n1, n_ref)
        inside = v > LEAST
        first, second = np.where(inside, (c - q / v) / v, 0.0), np.where(inside, (2 * q / v - c) / v**2, 0.0)
        return (c * np.log(v) + q / v).sum(axis=1), *by_two(first, second, l**2 / m[at] - l / n_ref, l / n1)

    return minimise(loss, start, np.array([0.0, 0.0]), np.array([1.0, 10.0]))[0]


def fit_common_stack(lam: np.ndarray, held: np.ndarray, squares1: np.ndarray, products: np.ndarray, squares2: np.ndarray, m: np.ndarray, n1: float, n2: float, n0: float, n_ref: float, h11: np.ndarray, h22: np.ndarray, starts: Sequence[np.ndarray]) -> np.ndarray:
    """(covariance, intercept) of two traits for each row, given each one's own fit: the second conditional on the first; the best of some
    starts. Rows as in fit_own_stack, with sums of squared effects of both and of their products."""
    lam, m = np.broadcast_to(lam, held.shape), np.asarray(m, float)[:, None]
    v1, v2 = own_variance(h11, lam, m, n1, n_ref), own_variance(h22, lam, m, n2, n_ref)
    overlap = n0 / n1 * n0 / n2 / n0 if n0 > 0 else 0.0

    def loss(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        l, k, s, t, u, a, b = (x[at] for x in (lam, held, squares1, products, squares2, v1, v2))  # noqa: E741
        c = p[:, :1] / m[at] * l**2 + p[:, 1:] * overlap * l
        r = c / a
        rest = u - 2 * r * t + r**2 * s
        w = np.maximum(b - c * r, LEAST)
        inside = w > LEAST
        rest_1, rest_2 = 2 * (r * s - t) / a, 2 * s / a**2
        w_1, w_2 = np.where(inside, -2 * r, 0.0), np.where(inside, -2 / a, 0.0)
        first = (k * w_1 + rest_1 - rest * w_1 / w) / w
        second = (k * (w_2 - w_1**2 / w) + rest_2 - (2 * rest_1 * w_1 + rest * w_2 - 2 * rest * w_1**2 / w) / w) / w
        return (k * np.log(w) + rest / w).sum(axis=1), *by_two(first, second, l**2 / m[at], overlap * l)

    ends = [minimise(loss, x, np.array([-1.0, -10.0]), np.array([1.0, 10.0])) for x in starts]
    best = np.argmin(np.stack([e[1] for e in ends]), axis=0)
    return np.stack([e[0] for e in ends])[best, np.arange(len(held))]


def fit_own(lam: np.ndarray, star: np.ndarray, m: float, n1: float, n_ref: float, start: np.ndarray) -> np.ndarray:
    """(h2, intercept) of one trait by its effects on the eigenvectors of m SNPs."""
    return fit_own_stack(lam, np.ones((1, len(lam))), star[None] ** 2, np.array([m]), n1, n_ref, start[None])[0]


def fit_piece(ldsc: np.ndarray, lam: np.ndarray, v: np.ndarray, b1: np.ndarray, n1: float, n_ref: float) -> np.ndarray:
    """(h2, intercept) of one trait in one piece."""
    return fit_own(lam, v.T @ b1, float(len(ldsc)), n1, n_ref, np.array([start_h2(b1**2, ldsc, n1), 1.0]))


def stacked(rows: Sequence[np.ndarray]) -> np.ndarray:
    """Rows of unequal lengths along the last axis as one array, the shorter ones filled up with zeros."""
    out = np.zeros((len(rows), *rows[0].shape[:-1], max(r.shape[-1] for r in rows)))
    for i, r in enumerate(rows):
        out[i, ..., : r.shape[-1]] = r
    return out


def pair_starts(own: Sequence[np.ndarray], other: Sequence[np.ndarray], slope: np.ndarray, rho: float) -> list[np.ndarray]:
    """Where fits of two traits start: from a regression, from none, and from half of the most that their own fits allow, either way."""
    half = 0.5 * np.sqrt(np.maximum(own[:, 0] * other[:, 0], 0))
    return [np.stack([h, np.full(len(h), rho)], axis=1) for h in (slope, np.zeros(len(half)), half, -half)]


def fit_pieces(pieces: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, sizes: Sequence[tuple[float, float]], rho: dict, n_ref: float) -> list[np.ndarray]:
    """The fits of each cell to each of some pieces (LD scores, eigenvalues, effects of the traits on SNPs and on eigenvectors), at once."""
    m = np.array([float(len(p[0])) for p in pieces])
    ldsc, lam, b, star = (stacked([p[i] for p in pieces]) for i in range(4))
    snps, held = stacked([np.ones(len(p[0])) for p in pieces]), stacked([np.ones(len(p[1])) for p in pieces])
    own = []
    for t in range(k):
        start = start_h2(b[:, t] ** 2, ldsc, sizes[t][0], held=snps)
        own.append(fit_own_stack(lam, held, star[:, t] ** 2, m, sizes[t][0], n_ref, np.stack([start, np.ones(len(m))], axis=1)))
    cells = []
    for i, j in vech_index(k):
        if i == j:
            cells.append(own[i])
            continue
        n1, n2, n0 = sizes[j][0], sizes[i][0], min(sizes[i][1], sizes[j][1])
        slope = start_h2(b[:, j] * b[:, i], ldsc, np.sqrt(n1 * n2), held=snps)
        cells.append(fit_common_stack(lam, held, star[:, j] ** 2, star[:, j] * star[:, i], star[:, i] ** 2, m, n1, n2, n0, n_ref, own[j], own[i], pair_starts(own[j], own[i], slope, rho[j, i])))
    return cells


def joint(fitted: DataFrame, k: int, sizes: Sequence[tuple[float, float]], rho: dict, n_ref: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(S, I, V, m) of all pieces fitted together, V from refits without each piece, made where the pieces lie.

    fitted: m, h, lam and stars (effects on the eigenvectors, by trait) of each piece. A likelihood depends on the eigenvectors of equal
    eigenvalue by their number and the sums of squares and products of effects alone. One row of these for each distinct eigenvalue
    travels, however many SNPs share it; beyond MOST_VALUES numbers it is an error. A refit takes a piece's own sums from them."""
    index = vech_index(k)
    total = fitted.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.array(*(F.sum(F.col("h")[u]) for u in range(len(index)))).alias("start")).first()
    vectors = fitted.select(F.posexplode("lam").alias("at", "lam"), "stars").select("lam", *(F.col("stars")[t][F.col("at")].alias(f"s{t}") for t in range(k)))
    sums = keep(vectors.groupBy("lam").agg(F.count("*").cast("double").alias("held"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{u}") for u, (i, j) in enumerate(index))))
    if (distinct := sums.count()) * (len(index) + 2) > MOST_VALUES:
        raise ValueError(f"a panel of {distinct} distinct eigenvalues is too large to be fitted together; use the piecewise method")
    rows = sums.orderBy("lam").toArrow()
    lam, *whole = (rows.column(c).to_numpy() for c in rows.column_names)
    whole, m, cell = np.stack(whole), float(total["m"]), {x: u for u, x in enumerate(index)}

    def fits(sums: np.ndarray, starts: Sequence[Sequence[np.ndarray]] | None) -> list[np.ndarray]:
        """The fits of all cells to each (held, q0, ...) of a stack, from those of all pieces (starts) or, if there are none, from pieces' sums."""
        n, own, out = len(sums), {}, {}
        repeated = lambda x: np.repeat(np.asarray(x, float)[None], n, axis=0)
        for i in range(k):
            u = cell[i, i]
            start = repeated([total["start"][u], 1.0] if starts is None else starts[u])
            own[i] = out[u] = fit_own_stack(lam, sums[:, 0], sums[:, 1 + u], np.full(n, m), sizes[i][0], n_ref, start)
        for u, (i, j) in enumerate(index):
            if i != j:
                of = (own[j], own[i]) if starts is None else (repeated(starts[cell[j, j]]), repeated(starts[cell[i, i]]))
                begin = pair_starts(*of, np.full(n, total["start"][u]), rho[j, i]) if starts is None else [repeated(starts[u])]
                squares = (sums[:, 1 + cell[j, j]], sums[:, 1 + u], sums[:, 1 + cell[i, i]])
                out[u] = fit_common_stack(lam, sums[:, 0], *squares, np.full(n, m), sizes[j][0], sizes[i][0], min(sizes[i][1], sizes[j][1]), n_ref, *of, begin)
        return [out[u] for u in range(len(index))]

    full = [x[0] for x in fits(whole[None], None)]
    many = max(1, STACK // len(lam))

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), many):
                some = batch.iloc[first : first + many]
                left = np.repeat(whole[None], len(some), axis=0)
                for r, own, stars in zip(left, some["lam"], some["stars"], strict=True):
                    at, s = np.searchsorted(lam, own), np.stack(stars)
                    np.subtract.at(r, (slice(None), at), np.stack([np.ones(len(at)), *(s[i] * s[j] for i, j in index)]))
                apart = np.stack(fits(left, full), axis=1)[:, :, 0] - np.array([x[0] for x in full])
                yield pd.DataFrame({"apart": list(apart)})

    left = fitted.select("lam", "stars").mapInPandas(refit, "apart array<double>")
    n, spread = left.agg(F.count("*"), F.array(*(F.covar_samp(F.col("apart")[u], F.col("apart")[w]) for u in range(len(index)) for w in range(len(index))))).first()  # one row, whatever the pieces
    V = np.array(spread, float).reshape(len(index), -1) * (n - 1)
    return np.array([x[0] for x in full]), np.array([x[1] for x in full]), V, m


def hdl(pieces: DataFrame, traits: Sequence[DataFrame], names: Sequence[str], n_ref: float = 335_265, prevalences: Sequence[Prevalence] | None = None, method: str = "piecewise") -> Covariance:
    """The covariance structure of traits (see load_gwas) over LD pieces (rows as PIECE), summed piece by piece, or fitted to all pieces
    together (method="jackknife"); V from the jackknife over pieces."""
    if method not in ("piecewise", "jackknife"):
        raise ValueError(f"unknown method: {method}")
    k = len(traits)
    traits = [keep(t.select("SNP", "N", "A2", "Z")) for t in traits]  # sizes, slopes and effects read them
    sizes = [sample_sizes(t) for t in traits]
    rho = {(i, j): z_slope(traits[i], traits[j]) for j, i in vech_index(k) if i != j}
    effects = None
    for t, gwas in enumerate(traits):
        one = bhat(pieces, gwas, t)
        effects = one if effects is None else effects.union(one)
    by_piece = effects.groupBy("piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("trait", "bhat"))), lambda x: x["bhat"]).alias("bhats"))

    def fit_some(some: list[tuple]) -> pd.DataFrame:
        fits = fit_pieces([p[1:] for p in some], k, sizes, rho, n_ref)
        out = {"m": [len(p[1]) for p in some], "h": list(np.stack([x[:, 0] for x in fits], axis=1)), "intercept": list(np.stack([x[:, 1] for x in fits], axis=1))}
        if method == "jackknife":
            out |= {"piece": [p[0] for p in some], "lam": [p[2] for p in some], "stars": [p[4].tolist() for p in some]}
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some, longest = [], 0
            for name, ldsc, lam, v, bhats in zip(*(batch[c] for c in ("piece", "ldsc", "lam", "v", "bhats")), strict=True):
                longest = max(longest, len(ldsc), len(lam))
                if some and (len(some) + 1) * longest > STACK:
                    yield fit_some(some)
                    some, longest = [], max(len(ldsc), len(lam))
                b = np.stack(bhats).astype(float)
                some.append((name, np.asarray(ldsc, float), np.asarray(lam, float), b, b @ np.stack(v).astype(float)))
            if some:
                yield fit_some(some)

    schema = "m long, h array<double>, intercept array<double>" + (", piece string, lam array<double>, stars array<array<double>>" if method == "jackknife" else "")
    cells = range(k * (k + 1) // 2)
    pairs = [(u, w) for u in cells for w in cells if u <= w]
    # fits take far longer than their bytes tell, so each task gets its share of the pieces; by a hash, as a second shuffle by piece would be left out
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitted = pieces.join(by_piece, "piece").repartition(parts, F.xxhash64("piece")).mapInPandas(run, schema)
    if method == "jackknife":
        total, mean, V, m = joint(keep(fitted), k, sizes, rho, n_ref)
        return _structure(names, total, mean, V, m, sizes, prevalences)
    h, intercept = (lambda u: F.col("h")[u]), (lambda u: F.col("intercept")[u])
    sums = fitted.agg(
        F.count("*").alias("n"),
        F.sum("m").alias("m"),
        F.array(*(F.sum(h(u)) for u in cells)).alias("total"),
        F.array(*(F.avg(intercept(u)) for u in cells)).alias("mean"),
        F.array(*(F.covar_samp(h(u), h(w)) for u, w in pairs)).alias("spread"),
    ).first()  # one row, whatever the pieces
    # a piece left out gives n / (n - 1) * (total - h), so the covariance of these is that of h times (n / (n - 1))^2
    n = sums["n"]
    V = np.zeros((len(cells), len(cells)))
    for (u, w), c in zip(pairs, sums["spread"], strict=True):
        V[u, w] = V[w, u] = c * n**2 / (n - 1)
    return _structure(names, sums["total"], sums["mean"], V, float(sums["m"]), sizes, prevalences)


def _structure(names: Sequence[str], total: Sequence[float], mean: Sequence[float], V: np.ndarray, m: float, sizes: Sequence[tuple[float, float]], prevalences: Sequence[Prevalence] | None) -> Covariance:
    k = len(names)
    S, I = np.zeros((k, k)), np.zeros((k, k))  # noqa: E741
    for u, (i, j) in enumerate(vech_index(k)):
        S[i, j] = S[j, i] = total[u]
        I[i, j] = I[j, i] = mean[u]
    S, V = rescale(S, V, np.sqrt([liability(p) for p in prevalences or [Prevalence()] * k]))
    n_cells = np.array([np.sqrt(sizes[i][0] * sizes[j][0]) for i, j in vech_index(k)])
    return Covariance(list(names), S, V, I, n_cells, m)
