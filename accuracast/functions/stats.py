"""Distribution tails as SQL expressions.

Every function takes and returns SQL text that runs unchanged as ``F.expr`` inside whole-stage
code generation, so no p-value needs a Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximations of erf / erfc (Cody 1969, Math. Comp. 23).
ERF_NUM = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
ERF_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
ERFC_MID_NUM = [
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
]
ERFC_MID_DEN = [
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
]
ERFC_TAIL_NUM = [
    1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
    1.60837851487422766e-2, 6.58749161529837803e-4,
]
ERFC_TAIL_DEN = [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]

# Response surface for the unit-root test with constant (MacKinnon 1994).
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_SMALL = [2.1659, 1.4412, 0.038269]
ADF_LARGE = [1.7339, 0.93202, -0.12745, -0.010368]

# Level-stationarity test table (Kwiatkowski et al. 1992).
KPSS_CRIT = [0.347, 0.463, 0.574, 0.739]
KPSS_P = [0.10, 0.05, 0.025, 0.01]


def _lit(v: float) -> str:
    return f"({v:.17e})" if v < 0 else f"{v:.17e}"


def _poly(coefs: list[float], x: str) -> str:
    """Horner form, highest power first."""
    out = _lit(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {_lit(c)})"
    return out


def erfc_sql(x: str) -> str:
    """Complementary error function of a non-negative expression."""
    sq = f"({x} * {x})"
    near = f"(1e0 - {x} * {_poly(ERF_NUM, sq)} / {_poly(ERF_DEN, sq)})"
    mid = f"(exp(-{sq}) * {_poly(ERFC_MID_NUM, x)} / {_poly(ERFC_MID_DEN, x)})"
    inv = f"(1e0 / {sq})"
    far = f"(exp(-{sq}) / {x} * ({_lit(1 / math.sqrt(math.pi))} - {inv} * {_poly(ERFC_TAIL_NUM, inv)} / {_poly(ERFC_TAIL_DEN, inv)}))"
    return f"(CASE WHEN {x} <= 0.46875e0 THEN {near} WHEN {x} <= 4e0 THEN {mid} WHEN {x} <= 26e0 THEN {far} ELSE 0e0 END)"


def normal_two_sided_sql(z: str) -> str:
    """P(|Z| > |z|) for a standard normal Z; ``z`` should be a plain column name."""
    return erfc_sql(f"(abs({z}) / {_lit(math.sqrt(2.0))})")


def normal_cdf_sql(z: str) -> str:
    half = normal_two_sided_sql(z)
    return f"(CASE WHEN {z} > 0e0 THEN 1e0 - 0.5e0 * {half} ELSE 0.5e0 * {half} END)"


def chi2_tail_sql(q: str, dof: str, max_dof: int = 20) -> str:
    """P(X > q) for a chi-square with an integer number of degrees of freedom up to ``max_dof``.

    Whole and half orders of the incomplete gamma function have finite series, one term per order.
    """
    x = f"({q} / 2e0)"
    terms = []
    for k in range(1, max_dof):
        a = k / 2.0
        term = f"exp({_lit(a)} * ln({x}) - {x} - {_lit(math.lgamma(a + 1.0))})"
        terms.append(f"CASE WHEN {dof} > {k} AND ({dof} - {k}) % 2 = 0 THEN {term} ELSE 0e0 END")
    start = f"(CASE WHEN {dof} % 2 = 0 THEN exp(-{x}) ELSE {erfc_sql(f'sqrt({x})')} END)"
    return f"(CASE WHEN {q} <= 0e0 THEN 1e0 ELSE {start} + " + " + ".join(f"({t})" for t in terms) + " END)"


def adf_p_sql(stat: str) -> str:
    small = _poly(ADF_SMALL[::-1], stat)
    large = _poly(ADF_LARGE[::-1], stat)
    z = f"(CASE WHEN {stat} <= {_lit(ADF_STAR)} THEN {small} ELSE {large} END)"
    return (
        f"(CASE WHEN {stat} IS NULL THEN NULL WHEN {stat} > {_lit(ADF_MAX)} THEN 1e0 "
        f"WHEN {stat} < {_lit(ADF_MIN)} THEN 0e0 ELSE {normal_cdf_sql(z)} END)"
    )


def kpss_p_sql(stat: str) -> str:
    parts = [f"WHEN {stat} <= {KPSS_CRIT[0]}e0 THEN {KPSS_P[0]}e0"]
    for i in range(3):
        slope = (KPSS_P[i + 1] - KPSS_P[i]) / (KPSS_CRIT[i + 1] - KPSS_CRIT[i])
        parts.append(f"WHEN {stat} <= {KPSS_CRIT[i + 1]}e0 THEN {KPSS_P[i]}e0 + {_lit(slope)} * ({stat} - {KPSS_CRIT[i]}e0)")
    return f"(CASE WHEN {stat} IS NULL THEN NULL {' '.join(parts)} ELSE {KPSS_P[3]}e0 END)"


def normal_two_sided(col: str) -> Column:
    return F.expr(normal_two_sided_sql(col))


def chi2_tail(q: str, dof: str) -> Column:
    return F.expr(chi2_tail_sql(q, dof))


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) for an integer number of degrees of freedom: the finite trigonometric series."""
    theta = F.atan(F.abs(t) / F.sqrt(dof))
    sin, cos = F.sin(theta), F.cos(theta)

    def series(first: Column, ratio, count: Column) -> Column:
        step = F.aggregate(
            F.when(count > 1, F.sequence(F.lit(1), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
            F.struct(first.alias("term"), first.alias("sum")),
            lambda acc, k: F.struct(
                (acc["term"] * ratio(k) * cos * cos).alias("term"),
                (acc["sum"] + acc["term"] * ratio(k) * cos * cos).alias("sum"),
            ),
        )
        return F.when(count >= 1, step["sum"]).otherwise(0.0)

    even = sin * series(F.lit(1.0), lambda k: (2 * k - 1) / (2.0 * k), F.floor(dof / 2))
    odd = (F.lit(2.0) / math.pi) * (theta + sin * series(cos, lambda k: (2.0 * k) / (2 * k + 1), F.floor((dof - 1) / 2)))
    return F.greatest(F.lit(0.0), 1 - F.when(dof % 2 == 0, even).otherwise(odd))
