"""Fits of many covariance matrices to one model at once, sandwich standard errors, and fit statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from lociq.functions.normal import chi2_sf, two_sided_p
from lociq.operators.ldsc import vech_index
from lociq.operators.sem.model import Model, compile_model
from lociq.operators.sem.text import evaluate

ROUNDS = 500
RESTARTS = 2


def smooth(m: np.ndarray, least: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """(positive definite matrices, whether each was changed): eigenvalues below ``least`` are raised to it where the
    smallest is not positive. m: (B, k, k)."""
    values, vectors = np.linalg.eigh((m + m.transpose(0, 2, 1)) / 2)
    bad = values[:, 0] <= 0
    clipped = np.where(bad[:, None], np.maximum(values, least), values)
    return np.where(bad[:, None, None], (vectors * clipped[:, None, :]) @ vectors.transpose(0, 2, 1), m), bad


def vech_rows(S: np.ndarray) -> np.ndarray:
    index = vech_index(S.shape[-1])
    return S[..., [i for i, _ in index], [j for _, j in index]]


def weights_of(V: np.ndarray) -> np.ndarray:
    """1 / diag(V), 0 where that isn't positive and finite."""
    d = np.diagonal(V, axis1=-2, axis2=-1)
    return np.where(np.isfinite(d) & (d > 0), 1 / np.where(d > 0, d, 1), 0.0)


def moment_start(model: Model, S: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rough estimates of the free parameters for each S (B, k, k), in closed form.

    A loading is the slope of its indicator's covariances on those of the latent's first (or fixed) indicator, over all other variables; the
    latent's covariances follow from that indicator, regressions from the covariances of what they join, and variances and
    covariances, in which Sigma is linear, by weighted least squares."""
    b, k = len(S), len(model.observed)
    theta = np.tile(model.start, (b, 1))
    C, known = np.zeros((b, model.size, model.size)), list(range(k))
    C[:, :k, :k] = S
    loadings = [p for p in model.parameters if p.op == "=~"]
    waiting = [n for n in range(k, model.size)]
    while waiting:
        ready = [n for n in waiting if (own := [p for p in loadings if p.col == n]) and all(p.row in known for p in own)]
        if not ready:
            break
        for n in ready:
            _measure(model, C, theta, [p for p in loadings if p.col == n], n, known)
        known += ready
        waiting = [n for n in waiting if n not in ready]
    for y in {p.row for p in model.parameters if p.op == "~" and p.free >= 0}:
        own = [p for p in model.parameters if p.op == "~" and p.row == y]
        free, fixed = [p for p in own if p.free >= 0], [p for p in own if p.free < 0 and p.value]
        if y in known and all(p.col in known for p in own):
            x = [p.col for p in free]
            right = C[:, x, y] - sum((C[:, x, p.col] * p.value for p in fixed), np.zeros((b, len(x))))
            theta[:, [p.free for p in free]] = (np.linalg.pinv(C[:, x][:, :, x]) @ right[:, :, None])[:, :, 0]
    return np.clip(with_variances(model, theta, S, w), model.lower, model.upper)


def _measure(model: Model, C: np.ndarray, theta: np.ndarray, own: list, n: int, known: list[int]) -> None:
    """Fills in the loadings of a latent and its row of C."""
    ratio = lambda a, b: np.where(np.abs(b) > 1e-12, a / np.where(np.abs(b) > 1e-12, b, 1), 0.0)
    marker = next((p for p in own if p.free < 0 and p.value), own[0])
    m, rest = marker.row, [p for p in own if p is not marker]
    slopes = {}
    for p in rest:
        others = [i for i in known if i not in (m, p.row)]
        slopes[p.row] = ratio((C[:, p.row, others] * C[:, m, others]).sum(axis=1), (C[:, m, others] ** 2).sum(axis=1))
    shared = ratio(sum((C[:, m, j] * r for j, r in slopes.items()), np.zeros(len(C))), sum((r**2 for r in slopes.values()), np.zeros(len(C))))
    shared = np.where((shared > 0) & (shared < C[:, m, m]), shared, C[:, m, m] / 2)
    variance = next((p.value for p in model.parameters if p.op == "~~" and p.row == p.col == n and p.free < 0 and p.value > 0), 1.0)
    scale = np.full(len(C), marker.value) if marker.free < 0 and marker.value else np.sqrt(np.abs(shared) / variance)
    scale = np.where(scale == 0, 1.0, scale)
    if marker.free >= 0:
        theta[:, marker.free] = scale
    for p in rest:
        if p.free >= 0:
            theta[:, p.free] = slopes[p.row] * scale
    C[:, n, :] = C[:, :, n] = ratio(C[:, m, :], scale[:, None])
    C[:, n, n] = shared / scale**2
    for j, r in slopes.items():
        C[:, n, j] = C[:, j, n] = r * scale * C[:, n, n]


def with_variances(model: Model, theta: np.ndarray, S: np.ndarray, w: np.ndarray) -> np.ndarray:
    """theta with the free variances and covariances that fit best beside its loadings and regressions; variances stay positive."""
    symmetric = [p for p in model.parameters if p.matrix == "P" and p.free >= 0]
    at = sorted({p.free for p in symmetric})
    if not at:
        return theta
    theta = theta.copy()
    theta[:, at] = 0
    sigma, T, full = model.implied(theta)
    J = model.jacobian(T, full)[:, :, at]
    JW = J * w[:, :, None]
    H, g = JW.transpose(0, 2, 1) @ J, (JW.transpose(0, 2, 1) @ (vech_rows(S) - vech_rows(sigma))[:, :, None])[:, :, 0]
    ridge = 1e-9 * np.maximum(np.einsum("bii->bi", H), 1e-300)
    theta[:, at] = np.linalg.solve(H + ridge[:, :, None] * np.eye(len(at)), g[:, :, None])[:, :, 0]
    least = 1e-3 * np.abs(np.einsum("bii->b", S))[:, None] / S.shape[1]
    own = sorted({p.free for p in symmetric if p.row == p.col})
    theta[:, own] = np.maximum(theta[:, own], least)
    return theta


def fit_dwls(model: Model, S: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(theta, converged) minimising sum w (s - sigma)^2 for each S (B, k, k): from moment estimates, and where that doesn't get to a
    minimum, from them with variances held positive first, from the model's starting values, and from seeded changes of the moment estimates. Of
    ends that are none the best is given."""
    start = moment_start(model, S, w)
    theta, ok, cost = _descend(model, S, w, start, model.lower)
    own = sorted({p.free for p in model.parameters if p.matrix == "P" and p.row == p.col and p.free >= 0})
    for attempt in range(2 + RESTARTS):
        bad = np.flatnonzero(~ok)
        if not len(bad):
            break
        again = start[bad] if attempt == 0 else np.tile(model.start, (len(bad), 1)) if attempt == 1 else start[bad] * np.random.default_rng(attempt).normal(1, 0.7, start.shape[1])
        lower = model.lower.copy()
        lower[own] = np.maximum(lower[own], 0.0)
        held, _, _ = _descend(model, S[bad], w[bad], np.clip(again, lower, model.upper), lower)
        new, fine, value = _descend(model, S[bad], w[bad], held, model.lower)
        better = fine | (value < cost[bad])
        take = bad[better]
        theta[take], ok[take], cost[take] = new[better], fine[better], value[better]
    return theta, ok


def _descend(model: Model, S: np.ndarray, w: np.ndarray, start: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(theta, converged, cost) by Levenberg-Marquardt with bounds by projection; every matrix keeps its own damping, those that are done
    stay out."""
    b, q = len(S), model.n_free
    theta, s = start.copy(), vech_rows(S)
    if q == 0:
        return theta, np.ones(b, bool), (w * (s - vech_rows(model.implied(theta)[0])) ** 2).sum(axis=1)
    damp, done = np.full(b, 1e-3), np.zeros(b, bool)
    sigma, T, full = model.implied(theta)
    rest = s - vech_rows(sigma)
    cost = (w * rest**2).sum(axis=1)
    for _ in range(ROUNDS):
        on = np.flatnonzero(~done)
        if not len(on):
            break
        J = model.jacobian(T[on], full[on])
        JW = J * w[on][:, :, None]
        H = JW.transpose(0, 2, 1) @ J
        g = (JW.transpose(0, 2, 1) @ rest[on][:, :, None])[:, :, 0]
        stuck = ((theta[on] <= lower) & (g < 0)) | ((theta[on] >= model.upper) & (g > 0))
        g = np.where(stuck, 0.0, g)
        scale = np.einsum("bii->bi", H)
        H[stuck, :] = 0
        H.transpose(0, 2, 1)[stuck, :] = 0
        D = np.where(stuck, 1.0, damp[on][:, None] * np.maximum(scale, 1e-12) + 1e-14)
        step = np.linalg.solve(H + D[:, :, None] * np.eye(q), g[:, :, None])[:, :, 0]
        new = np.clip(theta[on] + step, lower, model.upper)
        sigma, T_new, full_new = model.implied(new)
        rest_new = s[on] - vech_rows(sigma)
        cost_new = (w[on] * rest_new**2).sum(axis=1)
        better = cost_new <= cost[on]
        moved = np.abs(new - theta[on]).max(axis=1) <= 1e-11 * (1 + np.abs(theta[on]).max(axis=1))
        flat = np.abs(g).max(axis=1) <= 1e-10 * (1 + np.abs(scale).max(axis=1) ** 0.5)
        gain = cost[on] - cost_new <= 1e-15 * (cost[on] + 1e-300)
        take = on[better]
        theta[take], T[take], full[take], rest[take], cost[take] = new[better], T_new[better], full_new[better], rest_new[better], cost_new[better]
        damp[on] = np.where(better, np.maximum(damp[on] * 0.2, 1e-12), damp[on] * 10)
        done[on] = (better & (moved | (flat & gain))) | (damp[on] > 1e12)
    g = np.abs((model.jacobian(T, full).transpose(0, 2, 1) @ (w * rest)[:, :, None])[:, :, 0])
    free = (theta > lower) & (theta < model.upper)
    top = (w * s**2).sum(axis=1)[:, None]
    return theta, (np.where(free, g, 0) <= 1e-4 * (1 + np.sqrt(top) + top)).all(axis=1) & np.isfinite(cost), cost


def ml_objective(model: Model, theta: np.ndarray, S: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(discrepancy, its gradient) for stacks of parameters and covariances; infinite where Sigma isn't positive definite."""
    sigma, T, full = model.implied(theta)
    sign, logdet = np.linalg.slogdet(sigma)
    fine = sign > 0
    inverse = np.linalg.inv(np.where(fine[:, None, None], sigma, np.eye(S.shape[1])))
    f = logdet + np.einsum("bij,bji->b", S, inverse) - np.linalg.slogdet(S)[1] - S.shape[1]
    G = inverse - inverse @ S @ inverse
    double = np.array([1.0 if i == j else 2.0 for i, j in vech_index(S.shape[1])])
    g = (model.jacobian(T, full).transpose(0, 2, 1) @ (vech_rows(G) * double)[:, :, None])[:, :, 0]
    return np.where(fine, f, math.inf), np.where(fine[:, None], g, 0.0)


def fit_ml(model: Model, S: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(theta, converged) of a stack of covariances, all at once: Fisher scoring with step halving and bounds by projection."""
    theta = np.tile(model.start, (len(S), 1))
    f, g = ml_objective(model, theta, S)
    if (lost := ~np.isfinite(f)).any():
        size = S.shape[1] * (S.shape[1] + 1) // 2
        theta[lost] = np.clip(fit_dwls(model, S[lost], np.ones((int(lost.sum()), size)))[0], model.lower, model.upper)
        f[lost], g[lost] = ml_objective(model, theta[lost], S[lost])
    going = np.isfinite(f)
    for _ in range(ROUNDS):
        on = np.flatnonzero(going)
        if not len(on):
            break
        sigma, T, full = model.implied(theta[on])
        J = model.jacobian(T, full)
        H = J.transpose(0, 2, 1) @ ml_weight(sigma) @ J * 2
        stuck = ((theta[on] <= model.lower) & (g[on] > 0)) | ((theta[on] >= model.upper) & (g[on] < 0))
        slope = np.where(stuck, 0, g[on])
        ridge = 1e-10 * np.einsum("bii->b", H)[:, None, None] * np.eye(model.n_free)
        step = -(np.linalg.pinv(H + ridge, hermitian=True) @ slope[:, :, None])[:, :, 0]
        size, open_ = np.ones(len(on)), np.ones(len(on), bool)
        new, f_new, g_new = theta[on].copy(), f[on].copy(), g[on].copy()
        while open_.any() and size[open_].max() > 1e-10:
            at = np.flatnonzero(open_)
            tried = np.clip(theta[on[at]] + size[at, None] * step[at], model.lower, model.upper)
            f_tried, g_tried = ml_objective(model, tried, S[on[at]])
            good = f_tried <= f[on[at]] + 1e-4 * size[at] * (slope[at] * step[at]).sum(axis=1)
            new[at[good]], f_new[at[good]], g_new[at[good]] = tried[good], f_tried[good], g_tried[good]
            open_[at[good]] = False
            size[at[~good]] /= 2
        ended = open_ | ((np.abs(new - theta[on]).max(axis=1, initial=0) < 1e-10) & (np.abs(f[on] - f_new) < 1e-13))
        theta[on], f[on], g[on] = new, f_new, g_new
        going[on[ended]] = False
    free = (theta > model.lower) & (theta < model.upper)
    return theta, np.isfinite(f) & (np.where(free, np.abs(g), 0) < 1e-4).all(axis=1)


def duplication(k: int) -> np.ndarray:
    """vec of a symmetric matrix from its vech."""
    D = np.zeros((k * k, k * (k + 1) // 2))
    for c, (i, j) in enumerate(vech_index(k)):
        D[i * k + j, c] = D[j * k + i, c] = 1
    return D


def ml_weight(S: np.ndarray) -> np.ndarray:
    """Half of D' (S^-1 x S^-1) D for a stack of covariances."""
    inverse, D, k = np.linalg.inv(S), duplication(S.shape[1]), S.shape[1]
    both = np.einsum("bij,bkl->bikjl", inverse, inverse).reshape(len(S), k * k, k * k)
    return 0.5 * D.T @ both @ D


def sandwich(J: np.ndarray, W: np.ndarray, V: np.ndarray, toler: float | None = None) -> np.ndarray:
    """(J'WJ)^-1 J'W V W J (J'WJ)^-1 for stacks of matrices. Directions whose singular value is no more than toler of the largest count as
    not identified."""
    JW = J.transpose(0, 2, 1) @ W
    bread = np.linalg.pinv(JW @ J, rcond=toler)
    return bread @ (JW @ V @ JW.transpose(0, 2, 1)) @ bread


def q_statistic(rest: np.ndarray, V: np.ndarray) -> np.ndarray:
    """rest' V^-1 rest by eigenvalues, for stacks."""
    values, vectors = np.linalg.eigh(V)
    turned = (vectors.transpose(0, 2, 1) @ rest[:, :, None])[:, :, 0]
    return (turned**2 / values).sum(axis=1)


@dataclass
class Fit:
    model: Model
    theta: np.ndarray
    se: np.ndarray
    cov: np.ndarray
    sigma: np.ndarray
    full: np.ndarray
    S: np.ndarray
    V: np.ndarray
    converged: bool
    chisq: float
    df: int

    @property
    def p(self) -> float:
        return float(chi2_sf(self.chisq, self.df)) if self.df > 0 else math.nan

    @property
    def aic(self) -> float:
        return self.chisq + 2 * self.model.n_free if self.df > 0 else math.nan

    @property
    def srmr(self) -> float:
        d, e = np.sqrt(np.diag(self.S)), np.sqrt(np.diag(self.sigma))
        rest = vech_rows((self.S / np.outer(d, d) - self.sigma / np.outer(e, e))[None])
        return float(np.sqrt((rest**2).mean()))

    def cfi(self, estimation: str = "DWLS") -> float:
        """Against the model of variances alone, fitted to the same matrices."""
        names = self.model.observed
        null = fit(compile_model("\n".join(f"{n} ~~ {n}" for n in names), names, self.S), self.S, self.V, estimation)
        if not null.converged or not null.df or null.chisq == null.df:
            return math.nan
        return min(1.0, ((null.chisq - null.df) - (self.chisq - self.df)) / (null.chisq - null.df))

    def estimates(self) -> list[dict]:
        """lhs, op, rhs, free, label, est, se, std_all, z, p of each parameter, then of the defined ones."""
        spread = np.sqrt(np.abs(np.diag(self.full)))
        out, values = [], {}
        for p in self.model.parameters:
            est = self.theta[p.free] if p.free >= 0 else p.value
            se = self.se[p.free] if p.free >= 0 else math.nan
            by = spread[p.col] / spread[p.row] if p.matrix == "A" else 1 / (spread[p.row] * spread[p.col])
            out.append({"lhs": p.lhs, "op": p.op, "rhs": p.rhs, "free": p.free + 1, "label": p.label, "est": est, "se": se, "std_all": est * by, "z": est / se if se > 0 else math.nan})
            values |= {p.label: est} if p.label else {}
        for name, expression in self.model.defines:
            est = evaluate(expression, values)
            grad = np.zeros(self.model.n_free)
            for p in self.model.parameters:
                if p.label and p.free >= 0:
                    h = 1e-6 * max(1, abs(values[p.label]))
                    grad[p.free] = (evaluate(expression, values | {p.label: values[p.label] + h}) - evaluate(expression, values | {p.label: values[p.label] - h})) / (2 * h)
            se = float(np.sqrt(grad @ self.cov @ grad))
            values[name] = est
            out.append({"lhs": name, "op": ":=", "rhs": expression, "free": 0, "label": name, "est": est, "se": se, "std_all": math.nan, "z": est / se if se > 0 else math.nan})
        return [x | {"p": float(two_sided_p(x["z"]))} for x in out]

    def latent_correlations(self) -> np.ndarray:
        k = len(self.model.observed)
        c = self.full[k:, k:]
        d = np.sqrt(np.diag(c))
        return c / np.outer(d, d)


def fit(model: Model, S: np.ndarray, V: np.ndarray, estimation: str = "DWLS", w: np.ndarray | None = None, toler: float | None = None) -> Fit:
    """One covariance matrix; S and V are smoothed where they aren't positive definite."""
    (S,), _ = smooth(S[None])
    (V,), _ = smooth(V[None])
    if estimation == "DWLS":
        w = weights_of(V[None])[0] if w is None else w
        theta, ok = (x[0] for x in fit_dwls(model, S[None], w[None]))
        W = np.diag(w)
    else:
        theta, ok = (x[0] for x in fit_ml(model, S[None]))
        W = ml_weight(S[None])[0]
    sigma, T, full = model.implied(theta[None])
    cov = sandwich(model.jacobian(T, full), W[None], V[None], toler)[0]
    rest = vech_rows(S[None]) - vech_rows(sigma)
    df = rest.shape[1] - model.n_free
    q = float(q_statistic(rest, V[None])[0])
    return Fit(model, theta, np.sqrt(np.abs(np.diag(cov))), cov, sigma[0], full[0], S, V, bool(ok), q if df > 0 else math.nan, df)
