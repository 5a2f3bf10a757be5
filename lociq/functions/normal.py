"""Normal distribution as column expressions and as SQL text that Spark and DuckDB read alike; chi-square in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Wichura's algorithm AS 241 (PPND16), Applied Statistics 37 (1988).
A = ("3.3871328727963666080e0", "1.3314166789178437745e2", "1.9715909503065514427e3", "1.3731693765509461125e4", "4.5921953931549871457e4", "6.7265770927008700853e4", "3.3430575583588128105e4", "2.5090809287301226727e3")
B = ("1.0", "4.2313330701600911252e1", "6.8718700749205790830e2", "5.3941960214247511077e3", "2.1213794301586595867e4", "3.9307895800092710610e4", "2.8729085735721942674e4", "5.2264952788528545610e3")
C = ("1.42343711074968357734e0", "4.63033784615654529590e0", "5.76949722146069140550e0", "3.64784832476320460504e0", "1.27045825245236838258e0", "2.41780725177450611770e-1", "2.27238449892691845833e-2", "7.74545014278341407640e-4")
D = ("1.0", "2.05319162663775882187e0", "1.67638483018380384940e0", "6.89767334985100004550e-1", "1.48103976427480074590e-1", "1.51986665636164571966e-2", "5.47593808499534494600e-4", "1.05075007164441684324e-9")
E = ("6.65790464350110377720e0", "5.46378491116411436990e0", "1.78482653991729133580e0", "2.96560571828504891230e-1", "2.65321895265761230930e-2", "1.24266094738807843860e-3", "2.71155556874348757815e-5", "2.01033439929228813265e-7")
G = ("1.0", "5.99832206555887937690e-1", "1.36929880922735805310e-1", "1.48753612908506148525e-2", "7.86869131145613259100e-4", "1.84631831751005468180e-5", "1.42151175831644588870e-7", "2.04426310338993978564e-15")

# Coefficients of Hart's rational approximation as given by West, Wilmott Magazine (2005).
NUMERATOR = ("220.206867912376", "221.213596169931", "112.079291497871", "33.912866078383", "6.37396220353165", "0.700383064443688", "0.0352624965998911")
DENOMINATOR = ("440.413735824752", "793.826512519948", "637.333633378831", "296.564248779674", "86.7807322029461", "16.064177579207", "1.75566716318264", "0.0883883476483184")


def _number(x: str) -> str:
    return f"CAST('{x}' AS DOUBLE)"


def _horner(coefficients: tuple[str, ...], x: str) -> str:
    out = _number(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def probit_sql(p: str) -> str:
    """SQL for the standard normal quantile of an expression; null outside (0, 1)."""
    q = f"({p} - {_number('0.5')})"
    tail = f"(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END)"
    r = f"sqrt(-ln({tail}))"
    centre = f"{_number('0.180625')} - {q} * {q}"
    near, far = f"({r} - {_number('1.6')})", f"({r} - {_number('5')})"
    size = f"(CASE WHEN {r} <= 5 THEN {_horner(C, near)} / {_horner(D, near)} ELSE {_horner(E, far)} / {_horner(G, far)} END)"
    middle = f"{q} * {_horner(A, f'({centre})')} / {_horner(B, f'({centre})')}"
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({q}) <= {_number('0.425')} THEN {middle} WHEN {q} < 0 THEN -{size} ELSE {size} END END)"


def norm_sf_sql(x: str) -> str:
    """SQL for the upper tail of the standard normal distribution."""
    a = f"abs({x})"
    bell = f"exp(-{a} * {a} / 2)"
    inner = f"{bell} * {_horner(NUMERATOR, a)} / {_horner(DENOMINATOR, a)}"
    outer = f"{bell} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + {_number('0.65')}))))) / {_number('2.506628274631')}"
    tail = f"(CASE WHEN {a} > 37 THEN {_number('0')} WHEN {a} < {_number('7.07106781186547')} THEN {inner} ELSE {outer} END)"
    return f"(CASE WHEN {x} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def z_from_p_sql(p: str, effect: str) -> str:
    """SQL for the signed Z of a two-sided p-value; zero for p = 1, null for p outside (0, 1]."""
    return f"(CASE WHEN {p} = 1 THEN {_number('0')} WHEN {p} > 0 AND {p} < 1 AND {effect} IS NOT NULL THEN (CASE WHEN {effect} < 0 THEN -1 ELSE 1 END) * -{probit_sql(f'({p} / 2)')} END)"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once: the optimiser copies an expression wherever its alias is used, and these
    polynomials, copied into filters, would outgrow what the JVM compiles as one method."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _polynomial(coefficients: tuple[str, ...], x: Column) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in coefficients[-2::-1]:
        out = out * x + float(c)
    return out


def probit(p: str | Column) -> Column:
    """The standard normal quantile; null outside (0, 1)."""
    p = F.col(p) if isinstance(p, str) else p

    def tail(r: Column) -> Column:
        near = let(r - 1.6, lambda t: _polynomial(C, t) / _polynomial(D, t))
        return F.when(r <= 5, near).otherwise(let(r - 5, lambda t: _polynomial(E, t) / _polynomial(G, t)))

    def inside(q: Column) -> Column:
        middle = let(0.180625 - q * q, lambda t: q * _polynomial(A, t) / _polynomial(B, t))
        size = let(F.sqrt(-F.ln(F.when(q < 0, q + 0.5).otherwise(0.5 - q))), tail)
        return F.when(F.abs(q) <= 0.425, middle).otherwise(F.when(q < 0, -size).otherwise(size))

    def small(x: Column) -> Column:  # q + 0.5 loses what lies below 1e-16
        return -let(F.sqrt(-F.ln(x)), tail)

    return let(p, lambda x: F.when((x > 0) & (x < 0.075), small(x)).when((x > 0) & (x < 1), let(x - 0.5, inside)))


def norm_sf(x: str | Column) -> Column:
    """The upper tail of the standard normal distribution."""
    x = F.col(x) if isinstance(x, str) else x

    def tail(a: Column) -> Column:
        bell = F.exp(-a * a / 2)
        outer = bell / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
        return F.when(a > 37, 0.0).when(a < 7.07106781186547, bell * _polynomial(NUMERATOR, a) / _polynomial(DENOMINATOR, a)).otherwise(outer)

    return let(x, lambda v: F.when(v >= 0, let(F.abs(v), tail)).otherwise(1 - let(F.abs(v), tail)))


def z_from_p(p: str = "P", effect: str = "EFFECT") -> Column:
    """The signed Z of a two-sided p-value; zero for p = 1, null for p outside (0, 1]."""
    sign = F.when(F.col(effect) < 0, -1.0).when(F.col(effect).isNotNull(), 1.0)
    return F.when(F.col(p) == 1, 0.0).when((F.col(p) > 0) & (F.col(p) < 1), sign * -probit(F.col(p) / 2))


def chi2_sf(x: np.ndarray | float, df: np.ndarray | float) -> np.ndarray:
    """Upper tail of chi-square: the regularised incomplete gamma function by series below a + 1, by
    Lentz's continued fraction above. NaN for df <= 0 or x not a number; 1 for x <= 0."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    out = np.empty(x.shape)
    for i in np.ndindex(x.shape):
        out[i] = _upper_gamma(df[i] / 2, x[i] / 2)
    return out


def _upper_gamma(a: float, x: float) -> float:
    if not a > 0 or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return math.exp(scale) * h


def two_sided_p(z: np.ndarray | float) -> np.ndarray:
    """2 (1 - Phi(|z|)), floored at 5e-300."""
    z = np.abs(np.asarray(z, float))
    return np.where(np.isnan(z), np.nan, np.maximum(np.vectorize(math.erfc, otypes=[float])(np.nan_to_num(z) / math.sqrt(2)), 5e-300))
