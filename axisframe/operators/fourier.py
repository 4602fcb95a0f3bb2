"""Discrete Fourier transforms along an axis of any length.

An axis of up to CELL places is one cell, and numpy transforms all cells of an
Arrow batch at once.  A longer axis of n = n1 * n2 places is read as n1 rows of
n2: transforms along the rows' places, a factor for each element, transforms
along the other axis, and a transposition, which is arithmetic on the index.
Each of both is an axis itself and may be cut again, so no task ever holds more
than cells.  Where n has no fitting factors, the transform becomes a convolution
with a chirp, whose length is a power of two.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dtypes import cast
from ..frame import NDFrame, idx, normal_axis, unravel
from ..functions import complexes as C
from .cells import per_cell

#: Places of an axis that are transformed within one cell.
CELL = 4096


def _turn(place: Column, n: int, inverse: bool) -> Column:
    """exp(-2 pi i place / n), or its conjugate."""
    angle = place.cast("double") * (2 * math.pi / n)
    return C.make(F.cos(angle), F.sin(angle) if inverse else -F.sin(angle))


def resized(x: NDFrame, n: int) -> NDFrame:
    """The last axis cut off, or filled up with zeros, to ``n`` places."""
    *lead, m = x.shape
    last = f"i{x.ndim - 1}"
    if n == m:
        return x
    if n < m:
        return NDFrame(x.df.filter(F.col(last) < n), [*lead, n], x.dtype)
    zero = C.literal(0) if x.dtype.kind == "c" else cast(F.lit(0), "int64", x.dtype)
    places = unravel(F.col("id"), [*lead, n - m])
    more = x.spark.range(math.prod(lead) * (n - m)).select(*(c.alias(f"i{k}") for k, c in enumerate(places)), zero.alias("v"))
    return NDFrame(x.df.unionByName(more.withColumn(last, F.col(last) + m)), [*lead, n], x.dtype)


def factors(n: int) -> tuple[int, int] | None:
    """The two factors of ``n`` nearest to each other, if the larger isn't over eight times the root."""
    root = math.isqrt(n)
    return next(((a, n // a) for a in range(root, max(1, root // 8), -1) if n % a == 0), None)


def _dft(x: NDFrame, inverse: bool) -> NDFrame:
    """The transform along the last axis, without a scale."""
    *lead, n = x.shape
    k = len(lead)
    if n <= CELL:
        return per_cell((lambda a: np.fft.ifft(a, norm="forward")) if inverse else np.fft.fft, x, 1, (n,), "complex128")
    split = factors(n)
    if split is None:
        return _chirped(x, inverse)
    a, b = split
    rows = _dft(x.reshape([*lead, a, b]).swapaxes(k, k + 1), inverse)  # lead, place in a row, frequency
    turn = _turn(F.col(f"i{k}") * F.col(f"i{k + 1}"), n, inverse)
    turned = NDFrame(rows.df.withColumn("v", C.multiply(F.col("v"), turn)), rows.shape, "complex128")
    both = _dft(turned.swapaxes(k, k + 1), inverse)  # lead, frequency in a row, frequency of rows
    return both.swapaxes(k, k + 1).reshape([*lead, n])


def _chirp(place: Column, n: int, inverse: bool) -> Column:
    """exp(-pi i place**2 / n); the square is reduced before it becomes a float."""
    wide = place.cast("decimal(19,0)")
    return _turn((wide * wide) % F.lit(2 * n).cast("decimal(19,0)"), 2 * n, inverse)


def _chirped(x: NDFrame, inverse: bool) -> NDFrame:
    *lead, n = x.shape
    k = len(lead)
    m = 1 << (2 * n - 2).bit_length()
    here = _chirp(F.col(f"i{k}"), n, inverse)
    complex_ = x.astype("complex128")
    a = NDFrame(complex_.df.withColumn("v", C.multiply(F.col("v"), here)), x.shape, "complex128")
    place = F.least(F.col("id"), m - F.col("id"))
    kernel = x.spark.range(m).select(F.col("id").alias("i0"), F.when(place < n, _chirp(place, n, not inverse)).otherwise(C.literal(0)).alias("v"))
    both = _dft(resized(a, m), False).combine(_dft(NDFrame(kernel, [m], "complex128"), False), C.multiply, "complex128")
    back = resized(_dft(both, True), n)
    scaled = C.multiply(C.multiply(F.col("v"), here), C.literal(1 / m))
    return NDFrame(back.df.withColumn("v", scaled), [*lead, n], "complex128")


def _scaled(x: NDFrame, n: int, norm: str, inverse: bool) -> NDFrame:
    power = {"backward": 1.0 if inverse else 0.0, "forward": 0.0 if inverse else 1.0, "ortho": 0.5}[norm]
    if not power:
        return x
    by = float(n) ** -power
    return x.map(lambda v: C.make(v["re"] * by, v["im"] * by) if x.dtype.kind == "c" else v * by)


def _along(x: NDFrame, axis: int, n: int, f) -> NDFrame:
    if n < 1:
        raise ValueError("a transform needs one place at least")
    axis = normal_axis(axis, x.ndim)
    out = f(resized(x.moveaxis(axis, x.ndim - 1), n))
    return out.moveaxis(out.ndim - 1, axis)


def fft(x: NDFrame, n: int | None = None, axis: int = -1, norm: str = "backward") -> NDFrame:
    n = n or x.shape[axis]
    return _along(x, axis, n, lambda a: _scaled(_dft(a, False), n, norm, False))


def ifft(x: NDFrame, n: int | None = None, axis: int = -1, norm: str = "backward") -> NDFrame:
    n = n or x.shape[axis]
    return _along(x, axis, n, lambda a: _scaled(_dft(a, True), n, norm, True))


def _real_dft(x: NDFrame) -> NDFrame:
    """Half of the transform of real values: of an even number by a transform of half as many complex ones."""
    *lead, n = x.shape
    k = len(lead)
    half = n // 2
    if n <= CELL:
        return per_cell(np.fft.rfft, x, 1, (half + 1,), "complex128")
    if n % 2:
        return resized(_dft(x, False), half + 1)
    i, names = F.col(f"i{k}"), idx(k)
    pairs = x.df.groupBy(*names, F.floor(i / 2).alias(f"i{k}")).agg(F.struct(F.sum(F.when(i % 2 == 0, F.col("v").cast("double"))).alias("re"), F.sum(F.when(i % 2 == 1, F.col("v").cast("double"))).alias("im")).alias("v"))
    z = _dft(NDFrame(pairs, [*lead, half], "complex128"), False).df
    # Each value stands at its own frequency and at its mirror's; the first stands at the last, too.
    own = F.when(i == 0, F.array(F.lit(0), F.lit(half))).otherwise(F.array(i))
    mirror = F.when(i == 0, F.array(F.lit(0), F.lit(half))).otherwise(F.array(F.lit(half) - i))
    a = z.select(*names, F.explode(own.cast("array<long>")).alias(f"i{k}"), F.col("v").alias("a"))
    b = z.select(*names, F.explode(mirror.cast("array<long>")).alias(f"i{k}"), C.conjugate(F.col("v")).alias("b"))
    even = C.add(F.col("a"), F.col("b"))
    odd = C.multiply(C.multiply(C.subtract(F.col("a"), F.col("b")), _turn(i, n, False)), C.literal(-1j))
    total = C.multiply(C.add(even, odd), C.literal(0.5))
    return NDFrame(a.join(b, [*names, f"i{k}"]).withColumn("v", total), [*lead, half + 1], "complex128")


def _hermitian(x: NDFrame, n: int) -> NDFrame:
    """All n frequencies from the first n // 2 + 1 ones: the others are their mirrors' conjugates."""
    *lead, m = x.shape
    last = f"i{len(lead)}"
    i = F.col(last)
    df = x.astype("complex128").df
    rest = df.filter((i > 0) & (i < n - n // 2)).withColumns({last: F.lit(n) - i, "v": C.conjugate(F.col("v"))})
    edge = (i == 0) | ((i == n // 2) & F.lit(n % 2 == 0))
    own = df.withColumn("v", F.when(edge, C.make(F.col("v")["re"], F.lit(0.0))).otherwise(F.col("v")))
    return NDFrame(own.unionByName(rest), [*lead, n], "complex128")


def _real_idft(x: NDFrame, n: int) -> NDFrame:
    """n real values from n // 2 + 1 frequencies, without a scale."""
    if n <= CELL:
        return per_cell(lambda a: np.fft.irfft(a, n, norm="forward"), x, 1, (n,), "float64")
    return _dft(_hermitian(x, n), True).map(lambda v: v["re"], "float64")


def rfft(x: NDFrame, n: int | None = None, axis: int = -1, norm: str = "backward") -> NDFrame:
    if x.dtype.kind == "c":
        raise TypeError("rfft is for real arrays")
    n = n or x.shape[axis]
    return _along(x, axis, n, lambda a: _scaled(_real_dft(a), n, norm, False))


def irfft(x: NDFrame, n: int | None = None, axis: int = -1, norm: str = "backward") -> NDFrame:
    n = n or 2 * (x.shape[axis] - 1)
    return _along(x, axis, n // 2 + 1, lambda a: _scaled(_real_idft(a, n), n, norm, True))


_OPPOSITE = {"backward": "forward", "forward": "backward", "ortho": "ortho"}


def hfft(x: NDFrame, n: int | None = None, axis: int = -1, norm: str = "backward") -> NDFrame:
    """The real spectrum of a signal that is Hermitian: the inverse of real values, of the conjugates."""
    return irfft(x.astype("complex128").map(C.conjugate), n, axis, _OPPOSITE[norm])


def ihfft(x: NDFrame, n: int | None = None, axis: int = -1, norm: str = "backward") -> NDFrame:
    return rfft(x, n, axis, _OPPOSITE[norm]).map(C.conjugate)


def _axes(x: NDFrame, s, axes) -> tuple[tuple[int, ...], tuple]:
    axes = tuple(range(x.ndim))[-len(s) if s is not None else None :] if axes is None else tuple(axes)
    return axes, tuple(s) if s is not None else (None,) * len(axes)


def fftn(x: NDFrame, axes=None, norm: str = "backward", s=None) -> NDFrame:
    """One axis after the other, the last one first."""
    axes, s = _axes(x, s, axes)
    for axis, n in reversed(list(zip(axes, s))):
        x = fft(x, n, axis, norm)
    return x


def ifftn(x: NDFrame, axes=None, norm: str = "backward", s=None) -> NDFrame:
    axes, s = _axes(x, s, axes)
    for axis, n in reversed(list(zip(axes, s))):
        x = ifft(x, n, axis, norm)
    return x


def rfftn(x: NDFrame, axes=None, norm: str = "backward", s=None) -> NDFrame:
    axes, s = _axes(x, s, axes)
    x = rfft(x, s[-1], axes[-1], norm)
    return fftn(x, axes[:-1], norm, s[:-1]) if axes[:-1] else x


def irfftn(x: NDFrame, axes=None, norm: str = "backward", s=None) -> NDFrame:
    axes, s = _axes(x, s, axes)
    x = ifftn(x, axes[:-1], norm, s[:-1]) if axes[:-1] else x
    return irfft(x, s[-1], axes[-1], norm)


def fft2(x: NDFrame, s=None, axes=(-2, -1), norm: str = "backward") -> NDFrame:
    return fftn(x, axes, norm, s)


def ifft2(x: NDFrame, s=None, axes=(-2, -1), norm: str = "backward") -> NDFrame:
    return ifftn(x, axes, norm, s)


def rfft2(x: NDFrame, s=None, axes=(-2, -1), norm: str = "backward") -> NDFrame:
    return rfftn(x, axes, norm, s)


def irfft2(x: NDFrame, s=None, axes=(-2, -1), norm: str = "backward") -> NDFrame:
    return irfftn(x, axes, norm, s)
