"""Functions of cells: a signature tells which axes a function takes whole, and all others are broadcast.

``(m,n),(n)->(m)`` takes a matrix and a vector and gives a vector.  Operands
are grouped by the axes that are left, joined on those that they share, and the
function runs once for each Arrow batch, on stacks of cells.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dtypes import cast, dtype
from ..frame import BROADCAST_ELEMENTS, NDFrame, broadcast_shapes, idx, normal_axis, unravel
from ..storage import ready, saved
from .cells import stacked

_ARGUMENT = r"\(\s*(?:\w+(?:\s*,\s*\w+)*)?\s*\)"


def parse(signature: str) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]]]:
    """The core axes of every operand and of every result, as names or sizes."""
    if not re.fullmatch(rf"\s*{_ARGUMENT}(\s*,\s*{_ARGUMENT})*\s*->\s*{_ARGUMENT}(\s*,\s*{_ARGUMENT})*\s*", signature):
        raise ValueError(f"{signature!r} isn't a signature such as '(m,n),(n)->(m)'")
    sides = [[tuple(re.findall(r"\w+", a)) for a in re.findall(_ARGUMENT, side)] for side in signature.split("->")]
    return sides[0], sides[1]


def core_sizes(operands: list[tuple[str, ...]], shapes: list[tuple[int, ...]]) -> tuple[dict[str, int], tuple[int, ...]]:
    """Sizes of the core axes, and the shape that the other axes are broadcast to."""
    size: dict[str, int] = {}
    for core, shape in zip(operands, shapes):
        if len(shape) < len(core):
            raise ValueError(f"an operand of shape {shape} has no axes {core}")
        for name, n in zip(core, shape[len(shape) - len(core) :]):
            if size.setdefault(name, int(name) if name.isdigit() else n) != n:
                raise ValueError(f"axis {name} has sizes {size[name]} and {n}")
    return size, broadcast_shapes(*(s[: len(s) - len(c)] for c, s in zip(operands, shapes)))


def _grouped(x: NDFrame, core: int, k: int, lead: tuple[int, ...]) -> tuple[DataFrame, set[int]]:
    """Operand k as one row for each place of its own axes, under the names of the axes they are broadcast to."""
    own = x.ndim - core
    cell = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.struct(F.col("v")["re"].cast("double").alias("re"), F.col("v")["im"].cast("double").alias("im")).alias("v") if x.dtype.kind == "c" else F.col("v").cast("double").alias("v")))
    df = stacked(x, core) if core else x.df.select(*idx(own), cell.alias("cell"))
    axes = {len(lead) - own + j: j for j in range(own) if x.shape[j] == lead[len(lead) - own + j]}
    return df.select(*(F.col(f"i{j}").alias(f"_l{a}") for a, j in axes.items()), F.transform("cell", lambda c: c["v"]).alias(f"_c{k}")), set(axes)


def _read(column: pa.Array, is_complex: bool) -> np.ndarray:
    values = column.flatten()
    if is_complex:
        return values.field(0).to_numpy(zero_copy_only=False) + 1j * values.field(1).to_numpy(zero_copy_only=False)
    return values.to_numpy(zero_copy_only=False)


class gufunc:
    """``f`` of stacks of cells: it gets an array for each operand, the first axis of which runs over places, and gives the results' stacks.

    A cell must fit in a task; the number of places is free.  Core axes that
    only results have need a number as their name.
    """

    def __init__(self, f: Callable, signature: str, kinds: str | list[str] = "float64"):
        self.f, self.signature = f, signature
        self.operands, self.results = parse(signature)
        self.kinds = [kinds] * len(self.results) if isinstance(kinds, str) else list(kinds)
        if len(self.kinds) != len(self.results):
            raise ValueError("every result needs a type")

    def __call__(self, *arrays: NDFrame):
        if len(arrays) != len(self.operands):
            raise ValueError(f"{self.signature} takes {len(self.operands)} operands")
        size, lead = core_sizes(self.operands, [x.shape for x in arrays])
        unknown = [n for r in self.results for n in r if n not in size and not n.isdigit()]
        if unknown:
            raise ValueError(f"axes {unknown} of a result have no size")
        outs = [tuple(size.get(n) or int(n) for n in r) for r in self.results]
        cores = [tuple(size[n] for n in c) for c in self.operands]
        df, have, rows = None, set(), 1
        for k, (x, core) in enumerate(zip(arrays, self.operands)):
            own, axes = _grouped(x, len(core), k, lead)
            n = math.prod(lead[a] for a in axes)
            if df is None:
                df = own
            elif have & axes:
                df = df.join(own, [f"_l{a}" for a in sorted(have & axes)])
            elif min(x.size, rows * math.prod(cores[0])) <= BROADCAST_ELEMENTS:  # one side's size is known and bounded
                df = df.crossJoin(F.broadcast(own)) if x.size <= BROADCAST_ELEMENTS else F.broadcast(df).crossJoin(own)
            else:
                raise ValueError("an outer product of two large stacks isn't materialised")
            have, rows = have | axes, max(rows, n)
        df = df.select(*(F.col(f"_l{a}") if a in have else F.lit(0).cast("long").alias(f"_l{a}") for a in range(len(lead))), *(f"_c{k}" for k in range(len(arrays))))
        return self._made(df, arrays, cores, outs, lead)

    def _made(self, df: DataFrame, arrays, cores, outs, lead):
        f, n_lead, complexes, kinds = self.f, len(lead), [x.dtype.kind == "c" for x in arrays], [dtype(k) for k in self.kinds]
        ready(df.sparkSession)

        def made(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                cells = [_read(batch.column(n_lead + k), c).reshape(batch.num_rows, *core) for k, (c, core) in enumerate(zip(complexes, cores))]
                got = f(*cells)
                columns = [batch.column(a) for a in range(n_lead)]
                for out, shape, kind in zip(got if len(outs) > 1 else [got], outs, kinds):
                    flat = np.ascontiguousarray(np.broadcast_to(np.asarray(out), (batch.num_rows, *shape))).reshape(-1)
                    v = pa.StructArray.from_arrays([pa.array(flat.real.astype(float)), pa.array(np.imag(flat).astype(float))], ["re", "im"]) if kind.kind == "c" else pa.array(flat.real.astype(float))
                    step = math.prod(shape)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * step, pa.int32()), v))
                yield pa.RecordBatch.from_arrays(columns, [*(f"_l{a}" for a in range(n_lead)), *(f"_o{k}" for k in range(len(outs)))])

        schema = ", ".join([*(f"_l{a} long" for a in range(n_lead)), *(f"_o{k} array<{'struct<re:double,im:double>' if kind.kind == 'c' else 'double'}>" for k, kind in enumerate(kinds))])
        df = df.mapInArrow(made, schema)
        df = saved(df, "cells") if len(outs) > 1 else df
        results = []
        for k, (shape, kind) in enumerate(zip(outs, kinds)):
            rows = df.select(*(F.col(f"_l{a}").alias(f"i{a}") for a in range(n_lead)), F.posexplode(f"_o{k}").alias("_at", "v"))
            places = unravel(F.col("_at").cast("long"), shape)
            v = F.col("v") if kind.kind == "c" else cast(F.col("v"), "float64", kind)
            results.append(NDFrame(rows.select(*idx(n_lead), *(p.alias(f"i{n_lead + j}") for j, p in enumerate(places)), v.alias("v")), [*lead, *shape], kind))
        return results[0] if len(results) == 1 else tuple(results)


def vectorize(f: Callable, otypes: str | list[str] = "float64", signature: str | None = None) -> Callable:
    """A function of scalars, or of single cells by ``signature``, for arrays that are broadcast together.

    It runs as Python for each place; what column functions or stacks can do
    is faster that way.
    """
    kinds = [otypes] if isinstance(otypes, str) else list(otypes)

    def called(*arrays: NDFrame):
        form = signature or f"{','.join(['()'] * len(arrays))}->{','.join(['()'] * len(kinds))}"

        def each(*cells):
            got = [f(*(c.item() if c.ndim == 0 else c for c in map(np.asarray, places))) for places in zip(*cells)]
            return [np.array([g[k] for g in got]) for k in range(len(kinds))] if len(kinds) > 1 else np.array(got)

        return gufunc(each, form, kinds)(*arrays)

    return called


def frompyfunc(f: Callable, nin: int, nout: int, kind: str = "float64") -> Callable:
    """``f`` of ``nin`` scalars with ``nout`` results, as a function of arrays."""
    own = vectorize(f, [kind] * nout)

    def called(*arrays: NDFrame):
        if len(arrays) != nin:
            raise ValueError(f"{nin} operands are needed")
        return own(*arrays)

    return called


def apply_along_axis(f: Callable[[np.ndarray], object], axis: int, x: NDFrame, kind: str = "float64") -> NDFrame:
    """``f`` of each lane along an axis, in whose place the result's axes stand; the first lane's result tells their shape."""
    axis = normal_axis(axis, x.ndim)
    n = x.shape[axis]
    first = x.df
    for k in range(x.ndim):
        if k != axis:
            first = first.filter(F.col(f"i{k}") == 0)
    lane = NDFrame(first.select(F.col(f"i{axis}").alias("i0"), "v"), [n], x.dtype).to_numpy()
    shape = np.asarray(f(lane)).shape
    form = f"(n)->({','.join(map(str, shape))})"
    out = gufunc(lambda a: np.array([f(row) for row in a]), form, kind)(x.moveaxis(axis, x.ndim - 1))
    lead = x.ndim - 1
    return out.moveaxis(list(range(lead, out.ndim)), list(range(axis, axis + len(shape)))) if shape else out
