"""A model compiled to index arrays of two matrices: A (directed) and P (symmetric).

The implied covariance is that of the observed variables under (I - A)^-1 P (I - A)^-T.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np

from lociq.operators.ldsc import vech_index
from lociq.operators.sem.text import Line, ModelError, Spec, parse


@dataclass
class Parameter:
    lhs: str
    op: str
    rhs: str
    matrix: str
    row: int
    col: int
    value: float
    free: int = -1
    label: str | None = None

    @property
    def key(self) -> str:
        return self.lhs + self.op + self.rhs


@dataclass
class Model:
    observed: list[str]
    latent: list[str]
    parameters: list[Parameter]
    start: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    defines: list[tuple[str, str]] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.observed) + len(self.latent)

    @property
    def n_free(self) -> int:
        return len(self.start)

    def matrices(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A and P for each row of theta (B, n_free)."""
        b = len(theta)
        A, P = np.zeros((b, self.size, self.size)), np.zeros((b, self.size, self.size))
        for p in self.parameters:
            x = theta[:, p.free] if p.free >= 0 else p.value
            if p.matrix == "A":
                A[:, p.row, p.col] = x
            else:
                P[:, p.row, p.col] = P[:, p.col, p.row] = x
        return A, P

    def implied(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(Sigma of the observed, (I - A)^-1, full covariance) for each row of theta."""
        A, P = self.matrices(theta)
        T = np.linalg.inv(np.eye(self.size) - A)
        full = T @ P @ T.transpose(0, 2, 1)
        k = len(self.observed)
        return full[:, :k, :k], T, full

    def jacobian(self, T: np.ndarray, full: np.ndarray) -> np.ndarray:
        """d vech(Sigma) / d theta, (B, k*, n_free), in closed form."""
        k = len(self.observed)
        index = vech_index(k)
        r, c = np.array([i for i, _ in index]), np.array([j for _, j in index])
        out = np.zeros((len(T), len(index), self.n_free))
        for p in self.parameters:
            if p.free < 0:
                continue
            left, i, j = T[:, :k, :], p.row, p.col
            if p.matrix == "A":  # d Sigma = T E F + (T E F)'
                a, b = left[:, :, i], full[:, j, :k]
                d = a[:, r] * b[:, c] + a[:, c] * b[:, r]
            else:
                a, b = left[:, :, i], left[:, :, j]
                d = a[:, r] * b[:, c] if i == j else a[:, r] * b[:, c] + a[:, c] * b[:, r]
            out[:, :, p.free] += d
        return out


def subset(text: str, names: Sequence[str]) -> list[str]:
    """The names that stand as whole words in a model text."""
    return [n for n in names if re.search(rf"(?<![\w.]){re.escape(n)}(?![\w.])", text)]


def _rank(op: str, lhs: int, rhs: int, observed: int) -> tuple[int, int, int, int]:
    """Where a parameter stands among a model's: by operator, by what it joins, by the variables."""
    if op == "~~":
        low, high = min(lhs, rhs), max(lhs, rhs)
        return 1, 0 if low >= observed else 1 if high < observed else 2, low, high
    return 0 if op == "=~" else 2, 0, lhs, rhs


def spec_of_table(rows: Iterable[Mapping]) -> Spec:
    """A model from a table of its parameters: lhs, op, rhs, free (0: fixed; equal numbers are one parameter), est (the value of a fixed
    one, where a free one starts; may be missing), and if given label, lower and upper. Rows with := define, those with <, > and == bound."""
    spec, by_number = Spec(), {}
    for row in rows:
        lhs, op, rhs = (str(row[c]).strip() for c in ("lhs", "op", "rhs"))
        known = lambda c, row=row: row[c] if c in row and row[c] is not None and row[c] == row[c] and row[c] != "" else None
        if op == ":=":
            spec.defines.append((lhs, rhs))
        elif op in ("<", ">", "=="):
            spec.constraints.append((lhs, op, float(rhs)))
        elif op in ("=~", "~~", "~"):
            free, est = int(known("free") or 0), known("est")
            if not free:
                spec.lines.append(Line(lhs, op, rhs, value=float(est if est is not None else 0.0)))
                continue
            label = by_number.setdefault(free, known("label") or f"p{free}")
            spec.lines.append(Line(lhs, op, rhs, start=None if est is None else float(est), label=label, free=True))
            for side, column in ((">", "lower"), ("<", "upper")):
                if (bound := known(column)) is not None and abs(float(bound)) != float("inf"):
                    spec.constraints.append((label, side, float(bound)))
        else:
            raise ModelError(f"not an operator: {op}")
    return spec


def model_from_table(rows: Iterable[Mapping], names: Sequence[str], S: np.ndarray | None = None) -> Model:
    """The model of a parameter table, as it stands: nothing is added to it. See spec_of_table."""
    return compile_model(spec_of_table(rows), names, S, complete=False)


def compile_model(text: str | Spec, names: Sequence[str], S: np.ndarray | None = None, std_lv: bool = False, strict: bool = True, complete: bool = True) -> Model:
    """names: the observed variables, in the order of S. Latents are the left sides of =~. Unless std_lv, the
    first loading of a latent is 1 (if it isn't given); with it, latent variances are 1. Missing variances are
    free, and so are covariances among exogenous latents; with complete=False nothing is added. A name that is neither is an error. Parameters
    come as loadings, covariances among latents, among observed variables and between both, then regressions, each in order of the variables."""
    spec = parse(text) if isinstance(text, str) else text
    observed = list(names)
    latent = list(dict.fromkeys(x.lhs for x in spec.lines if x.op == "=~" and x.lhs not in observed))
    at = {n: i for i, n in enumerate([*observed, *latent])}
    if unknown := sorted({n for x in spec.lines for n in (x.lhs, x.rhs)} - at.keys()):
        if strict:
            raise ModelError(f"neither observed nor latent: {', '.join(unknown)}")
        latent += unknown
        at |= {n: len(observed) + latent.index(n) for n in unknown}
    lines, first = [], set()
    for x in spec.lines:
        if x.op == "=~" and x.lhs not in first:
            first.add(x.lhs)
            if complete and not std_lv and x.value is None and not x.free and x.label is None and x.start is None:
                x = Line(x.lhs, x.op, x.rhs, 1.0)
        lines.append(x)
    given = {frozenset((x.lhs, x.rhs)) for x in lines if x.op == "~~"}
    caused = {x.lhs for x in lines if x.op == "~"} | {x.rhs for x in lines if x.op == "=~"}
    for n in [*observed, *latent] if complete else []:
        if frozenset((n,)) not in given:
            lines.append(Line(n, "~~", n, 1.0 if std_lv and n in latent else None))
    free_latents = [n for n in latent if n not in caused] if complete else []
    for i, a in enumerate(free_latents):
        for b in free_latents[i + 1 :]:
            if frozenset((a, b)) not in given:
                lines.append(Line(a, "~~", b))
    lines.sort(key=lambda x: _rank(x.op, at[x.lhs], at[x.rhs], len(observed)))
    parameters, starts, by_label = [], [], {}
    for x in lines:
        a, b = at[x.lhs], at[x.rhs]
        matrix, row, col = ("A", b, a) if x.op == "=~" else ("A", a, b) if x.op == "~" else ("P", max(a, b), min(a, b))
        p = Parameter(x.lhs, x.op, x.rhs, matrix, row, col, x.value if x.value is not None else 0.0, label=x.label)
        if x.value is None:
            if x.label and x.label in by_label:
                p.free = by_label[x.label]
            else:
                p.free = len(starts)
                if x.label:
                    by_label[x.label] = p.free
                own = x.op == "~~" and a == b
                default = (float(S[a, a]) if S is not None and a < len(observed) else 1.0) if own else 0.0 if x.op == "~~" else 0.1
                starts.append(x.start if x.start is not None else default)
        parameters.append(p)
    lower, upper = np.full(len(starts), -np.inf), np.full(len(starts), np.inf)
    for name, op, x in spec.constraints:
        i = by_label.get(name)
        if i is None:
            raise ModelError(f"no parameter is labelled {name}")
        if op in (">", "=="):
            lower[i] = max(lower[i], x)
        if op in ("<", "=="):
            upper[i] = min(upper[i], x)
    return Model(observed, latent, parameters, np.clip(np.array(starts, float), lower, upper), lower, upper, spec.defines)
