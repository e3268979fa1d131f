"""Expressions as text in the part of SQL that Spark and other engines share, unrolled over a fixed number of groups."""
from __future__ import annotations

from collections.abc import Sequence

#: Logs of what isn't positive are logs of this.
TOL = 1e-50


def cols(name: str, q: int) -> list[str]:
    return [f"{name}{i}" for i in range(q)]


def add(xs: Sequence[str]) -> str:
    return "(" + " + ".join(xs) + ")"


def dot(xs: Sequence[str], ys: Sequence[str]) -> str:
    return add([f"{x} * {y}" for x, y in zip(xs, ys)])


def safe_ln(x: str, tol: float = TOL) -> str:
    return f"ln(CASE WHEN {x} > 0 THEN {x} ELSE CAST({tol!r} AS DOUBLE) END)"


def ln_or_zero(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ln({x}) ELSE CAST(0 AS DOUBLE) END"


def ratio(a: str, b: str) -> str:
    """a / b; 0 where b isn't positive."""
    return f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE CAST(0 AS DOUBLE) END"


def xlogx(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ({x}) * ln(CASE WHEN {x} > 0 THEN CAST({x} AS DOUBLE) ELSE 1 END) ELSE CAST(0 AS DOUBLE) END"


def softmax(xs: Sequence[str]) -> list[str]:
    top = f"greatest({', '.join(xs)})"
    e = [f"exp({x} - {top})" for x in xs]
    return [f"{x} / {add(e)}" for x in e]


def shares(xs: Sequence[str]) -> list[str]:
    return [ratio(x, add(xs)) for x in xs]


def argmax(xs: Sequence[str]) -> str:
    """The number of the first largest one."""
    top = f"greatest({', '.join(xs)})"
    return "CASE " + " ".join(f"WHEN {x} = {top} THEN {i}" for i, x in enumerate(xs)) + " END"


# Lanczos coefficients for g = 7 with nine terms.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma1p(x: str) -> str:
    """ln of the gamma function at x + 1, for x of 0 or more."""
    d = lambda v: f"CAST({v!r} AS DOUBLE)"
    series = " + ".join([d(LANCZOS[0]), *(f"{d(c)} / ({x} + {i})" for i, c in enumerate(LANCZOS[1:], 1))])
    return f"({d(0.9189385332046727)} + ({x} + {d(0.5)}) * ln({x} + {d(7.5)}) - ({x} + {d(7.5)}) + ln({series}))"


def poisson_logpmf(k: str, rate: str, tol: float = TOL) -> str:
    return f"({k} * {safe_ln(rate, tol)} - {rate} - {lgamma1p(k)})"


def noise(node: str, t: str, q: int, mod: int = 97) -> str:
    """A reproducible number from 0 to 1 that any engine computes alike."""
    return f"((({node}) * 31 + ({t}) * 17 + {q * 7}) % {mod}) / CAST({mod} AS DOUBLE)"


def planted(label: str, node: str, t: str, q: int, weight: float = 0.8) -> list[str]:
    """Shares near a label: ``weight`` for it, and the rest by noise."""
    n = [noise(node, t, i) for i in range(q)]
    return [f"(CASE WHEN {label} = {i} THEN CAST({weight} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST({1 - weight:.10g} AS DOUBLE) * {n[i]} / {add(n)})" for i in range(q)]


def label_of(node: str, t: str, q: int = 4) -> str:
    """Fixture labels that change in time for two thirds of the nodes."""
    return f"CAST((({node}) + ({t}) * (({node}) % 3)) % {q} AS INT)"
