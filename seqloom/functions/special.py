"""The complementary error function as a SQL expression that Spark and DuckDB share."""

from __future__ import annotations

# Rational approximations of W. J. Cody, Math. Comp. 23 (1969).
A = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
B = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
C = (5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
D = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
Q = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _poly(x: str, coefficients: tuple[float, ...]) -> str:
    """Horner's scheme, the highest power first."""
    out = f"{coefficients[0]!r}e0" if "e" not in repr(coefficients[0]) else repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"(({out}) * {x} + {c!r}{'' if 'e' in repr(c) else 'e0'})"
    return out


def erfc_sql(x: str) -> str:
    """erfc of the double expression x, which is repeated and so should be a column."""
    a, s = f"abs({x})", f"({x} * {x})"
    small = f"(1e0 - {x} * {_poly(s, (A[4], *A[:4]))} / {_poly(s, (1.0, *B))})"
    middle = f"exp(-{s}) * {_poly(a, (C[8], *C[:8]))} / {_poly(a, (1.0, *D))}"
    inverse = f"(1e0 / {s})"
    tail = f"exp(-{s}) * (0.56418958354775628695e0 - {inverse} * {_poly(inverse, (P[5], *P[:5]))} / {_poly(inverse, (1.0, *Q))}) / {a}"
    upper = f"(CASE WHEN {a} <= 4e0 THEN {middle} WHEN {a} < 26e0 THEN {tail} ELSE 0e0 END)"
    return f"(CASE WHEN {a} <= 0.46875e0 THEN {small} WHEN {x} < 0 THEN 2e0 - {upper} ELSE {upper} END)"
