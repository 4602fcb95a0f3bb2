"""Transforms against numpy, with cells so small that every axis is cut."""

import numpy as np
import pytest

from axisframe.operators import creation, fourier, lanes


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(fourier, "CELL", 8)


@pytest.mark.parametrize("n", [1, 12, 48, 37])  # a cell, two factors, factors that are cut again, primes
def test_long_axes(spark, small, n):
    r = np.random.default_rng(n)
    x = r.normal(size=n)
    z = x + 1j * r.normal(size=n)
    own, wide = creation.array(spark, x), creation.array(spark, z)
    np.testing.assert_allclose(fourier.fft(wide).to_numpy(), np.fft.fft(z), atol=1e-9)
    np.testing.assert_allclose(fourier.ifft(wide, norm="ortho").to_numpy(), np.fft.ifft(z, norm="ortho"), atol=1e-9)
    np.testing.assert_allclose(fourier.rfft(own).to_numpy(), np.fft.rfft(x), atol=1e-9)
    if n > 1:
        half = np.fft.rfft(x)
        np.testing.assert_allclose(fourier.irfft(creation.array(spark, half), n).to_numpy(), np.fft.irfft(half, n), atol=1e-9)


def test_stacks_axes_and_sizes(spark, small):
    r = np.random.default_rng(1)
    a = r.normal(size=(3, 12)) + 1j * r.normal(size=(3, 12))
    x = creation.array(spark, a)
    for got, want in (
        (fourier.fft(x, axis=0), np.fft.fft(a, axis=0)),
        (fourier.fft(x, 20), np.fft.fft(a, 20)),
        (fourier.fft(x, 7, norm="forward"), np.fft.fft(a, 7, norm="forward")),
        (fourier.hfft(x, 16), np.fft.hfft(a, 16)),
        (fourier.ihfft(creation.array(spark, a.real)), np.fft.ihfft(a.real)),
        (fourier.fft2(x), np.fft.fft2(a)),
        (fourier.ifft2(x, (2, 8)), np.fft.ifft2(a, (2, 8))),
        (fourier.rfft2(creation.array(spark, a.real)), np.fft.rfft2(a.real)),
        (fourier.irfft2(x), np.fft.irfft2(a)),
    ):
        np.testing.assert_allclose(got.to_numpy(), want, atol=1e-9)
    with pytest.raises(TypeError):
        fourier.rfft(x)


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
@pytest.mark.parametrize(("n", "m"), [(40, 11), (11, 40), (33, 33), (7, 1)])
def test_kernels_that_are_tables(spark, monkeypatch, mode, n, m):
    monkeypatch.setattr(lanes, "CONVOLVED", 8)
    r = np.random.default_rng(n)
    x, k = r.normal(size=n), r.normal(size=m)
    a, b = creation.array(spark, x), creation.array(spark, k)
    np.testing.assert_allclose(lanes.convolve1d(a, b, mode).to_numpy(), np.convolve(x, k, mode), atol=1e-9)
    np.testing.assert_allclose(lanes.correlate(a, b, mode).to_numpy(), np.correlate(x, k, mode), atol=1e-9)


def test_two_long_vectors_meet_as_spectra(spark, monkeypatch):
    monkeypatch.setattr(lanes, "CONVOLVED", 8)
    monkeypatch.setattr(lanes, "BROADCAST_ELEMENTS", 10)
    r = np.random.default_rng(9)
    x, k = r.normal(size=50), r.normal(size=30)
    np.testing.assert_allclose(lanes.convolve1d(creation.array(spark, x), creation.array(spark, k)).to_numpy(), np.convolve(x, k), atol=1e-9)
