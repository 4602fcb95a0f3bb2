"""Cells: the last axes of an array brought together, one row for each place of the leading axes, for numpy in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dtypes import dtype
from ..frame import NDFrame, idx
from ..storage import ready


def stacked(x: NDFrame, core: int) -> DataFrame:
    """Leading indices and the core axes' values as one flat array."""
    lead, shape = x.ndim - core, x.shape[x.ndim - core :]
    at = F.lit(0).cast("long")
    for k, n in enumerate(shape):
        at = at * n + F.col(f"i{lead + k}")
    value = F.struct(F.col("v")["re"].cast("double"), F.col("v")["im"].cast("double")) if x.dtype.kind == "c" else F.col("v").cast("double")
    return x.df.groupBy(*idx(lead)).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), value.alias("v")))).alias("cell"))


def per_cell(f: Callable[[np.ndarray], np.ndarray], x: NDFrame, core: int, out_core: tuple[int, ...], kind: str = "float64") -> NDFrame:
    """``f`` of stacks of cells (their last ``core`` axes); the results' last axes have the shape ``out_core``."""
    ready(x.spark)
    lead, shape, size = x.ndim - core, x.shape[x.ndim - core :], math.prod(out_core)
    is_complex, wide = x.dtype.kind == "c", dtype(kind).kind == "c"
    names = idx(lead)

    def made(batches):
        for batch in batches:
            cells = batch.column(lead)
            values = cells.flatten().field("v")
            raw = values.field(0).to_numpy(zero_copy_only=False) + 1j * values.field(1).to_numpy(zero_copy_only=False) if is_complex else values.to_numpy(zero_copy_only=False)
            flat = np.asarray(f(raw.reshape(-1, *shape))).reshape(-1) if batch.num_rows else np.zeros(0)
            index = [pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), size), pa.int64()) for k in range(lead)]
            at = np.tile(np.arange(size), batch.num_rows)
            core_index = [pa.array(a, pa.int64()) for a in np.unravel_index(at, out_core)] if out_core else []
            if wide:
                v = pa.StructArray.from_arrays([pa.array(flat.real.astype(float)), pa.array(np.imag(flat).astype(float))], ["re", "im"])
            else:
                v = pa.array(flat.real.astype(float))
            yield pa.RecordBatch.from_arrays([*index, *core_index, v], [*idx(lead + len(out_core)), "v"])

    schema = ", ".join([*(f"{i} long" for i in idx(lead + len(out_core))), "v " + ("struct<re:double,im:double>" if wide else "double")])
    return NDFrame(stacked(x, core).select(*names, "cell").mapInArrow(made, schema), [*x.shape[:lead], *out_core], kind)
