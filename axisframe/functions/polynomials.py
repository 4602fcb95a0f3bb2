"""Series of orthogonal polynomials of a column, by their recurrences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How the next polynomial follows from the last two: P[k+1] = (a(k) + b(k) x) P[k] + c(k) P[k-1].
_STEPS = {
    "chebyshev": lambda k: (0.0, 1.0 if k == 0 else 2.0, -1.0),
    "hermite": lambda k: (0.0, 2.0, -2.0 * k),
    "laguerre": lambda k: ((2 * k + 1) / (k + 1), -1.0 / (k + 1), -k / (k + 1)),
    "legendre": lambda k: (0.0, (2 * k + 1) / (k + 1), -k / (k + 1)),
}


def evaluate(x: Column, coefficients: Sequence[float], kind: str = "chebyshev") -> Column:
    """The sum of coefficients[k] * P[k](x), by Clenshaw's rule from the highest term down."""
    x, step = x.cast("double"), _STEPS[kind]
    one = two = F.lit(0.0)
    for k in range(len(coefficients) - 1, -1, -1):
        a, b, _ = step(k)
        c = step(k + 1)[2]
        one, two = coefficients[k] + (a + b * x) * one + c * two, one
    return one


def power_series(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x.cast("double") + c
    return out


def roots(coefficients: Sequence[float], kind: str = "chebyshev") -> np.ndarray:
    """Roots of one series, from its companion matrix on the driver."""
    module = getattr(np.polynomial, kind)
    return getattr(module, {"chebyshev": "chebroots", "hermite": "hermroots", "laguerre": "lagroots", "legendre": "legroots"}[kind])(list(coefficients))


def degree(coefficients: Sequence[float]) -> int:
    return max(0, len(coefficients) - 1)


class Polynomial:
    """A series of one kind; ``power`` is that of plain powers."""

    def __init__(self, coefficients: Sequence[float], kind: str = "power"):
        if kind != "power" and kind not in _STEPS:
            raise ValueError(f"there is no series of the kind {kind!r}")
        self.coefficients, self.kind = [float(c) for c in coefficients], kind

    def __call__(self, x: Column) -> Column:
        return power_series(x, self.coefficients) if self.kind == "power" else evaluate(x, self.coefficients, self.kind)

    def evaluate_array(self, x):
        """The series at every element of an array."""
        return x.map(self, "float64")

    def degree(self) -> int:
        return degree(self.coefficients)

    def roots(self) -> np.ndarray:
        return np.polynomial.polynomial.polyroots(self.coefficients) if self.kind == "power" else roots(self.coefficients, self.kind)
