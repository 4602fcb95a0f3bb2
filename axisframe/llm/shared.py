"""Joins that spread hot keys, sums of arrays over all tasks, and Bloom filters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_path, ready, saved, small_side

__all__ = ["CHUNK", "bloom", "fraction_filter", "may_contain", "new_path", "ready", "saved", "small_side", "spread_join", "summed_arrays"]

#: A key is hot if it has this many rows, or more than one in SPREAD_SHARE of all rows: so there are never more than SPREAD_SHARE hot keys.
HOT_ROWS, SPREAD_SHARE, SPREAD_OVER = 1_000, 100_000, 32


def spread_join(rows: DataFrame, firsts: DataFrame, keys: tuple, count: str, by: str) -> DataFrame:
    """``rows`` joined with ``firsts``, which has one row for each key and the number of its rows in ``count``.

    Hot keys are broadcast, which their bound allows, to salt their rows by
    ``by``; ``firsts`` has them once for each salt.  So no task gets all rows
    of a key, whatever their number.
    """
    total = firsts.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) >= max(HOT_ROWS, total // SPREAD_SHARE)
    marks = F.broadcast(firsts.filter(hot).select(*keys, F.lit(True).alias("_hot")))
    salted = rows.join(marks, list(keys), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SPREAD_OVER))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(SPREAD_OVER - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(firsts.withColumn("_salt", F.explode(copies)).drop(count), [*keys, "_salt"]).drop("_salt")


CHUNK = 1 << 16


def summed_arrays(df: DataFrame, made: Callable, sizes: dict[str, tuple[int, type]], ored: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """Adds up (or, those in ``ored``, ors) arrays of fixed sizes that tasks make from their rows.

    ``made(batches)`` gives {name: array} for one partition.  Each array
    travels as compressed chunks that are combined on executors, so the driver
    receives each chunk once: it sees the sizes named here and nothing that
    grows with the rows.
    """
    import zlib

    def pack(batches):
        out = {"name": [], "chunk": [], "data": []}
        for name, a in made(batches).items():
            for k in range(0, len(a), CHUNK):
                part = a[k : k + CHUNK]
                if part.any():
                    out["name"].append(name)
                    out["chunk"].append(k // CHUNK)
                    out["data"].append(zlib.compress(np.ascontiguousarray(part).tobytes(), 1))
        yield pa.RecordBatch.from_pydict(out, pa.schema([("name", pa.string()), ("chunk", pa.int32()), ("data", pa.binary())]))

    kinds = {k: np.dtype(v[1]) for k, v in sizes.items()}

    schema = "name string, chunk int, part int, data binary"
    left = max(1, df.rdd.getNumPartitions())
    rows = df.mapInArrow(pack, "name string, chunk int, data binary").select("name", "chunk", F.spark_partition_id().alias("part"), "data")
    while left:  # each level combines the chunks of 32 tasks
        left = 0 if left <= 32 else -(-left // 32)
        rows = rows.withColumn("part", F.floor(F.col("part") / 32).cast("int") if left else F.lit(0))
        rows = rows.groupBy("name", "chunk", "part").applyInArrow(lambda key, t: _fold(t, kinds, ored), schema)
    rows = rows.collect()
    out = {k: np.zeros(n, kind) for k, (n, kind) in sizes.items()}
    for r in rows:
        part = np.frombuffer(zlib.decompress(bytes(r["data"])), kinds[r["name"]])
        out[r["name"]][r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] = part
    return out


def _fold(table: pa.Table, kinds: dict, ored: tuple) -> pa.Table:
    import zlib

    name, total = table["name"][0].as_py(), None
    for x in table["data"]:
        part = np.frombuffer(zlib.decompress(x.as_py()), kinds[name])
        total = part.copy() if total is None else (total | part if name in ored else total + part)
    return pa.table({"name": [name], "chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "part": pa.array([table["part"][0].as_py()], pa.int32()), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def fraction_filter(column: str, share: float):
    """Keeps about ``share`` of the values of a column, the same ones in every run."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) if share < 1 else 1 << 20)


def may_contain(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Bloom test of 64-bit keys: false only for keys that were never put in."""
    from .textbytes import mix

    mask = np.uint64(len(bits) * 64 - 1)
    a, b = mix(keys.view(np.uint64)), mix(keys.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    found = np.ones(len(keys), bool)
    for k in range(4):
        at = (a + np.uint64(k) * b) & mask
        found &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def bloom(df: DataFrame, column: str, count: int, most_bits: int = 1 << 28) -> np.ndarray:
    """A Bloom filter of a long column, built on executors: 16 bits a key, 32 MB at most.

    Past that bound it lets more keys through; it never loses one, so that
    whoever filters by it stays exact and only moves more rows.
    """
    from .textbytes import mix

    bits = 1 << max(16, min(most_bits.bit_length() - 1, (16 * max(1, count) - 1).bit_length()))

    def made(batches):
        out = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            a, b = mix(keys), mix(keys ^ np.uint64(0x5851F42D4C957F2D))
            for k in range(4):
                at = (a + np.uint64(k) * b) & np.uint64(bits - 1)
                np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return {"bits": out}

    return summed_arrays(df.select(F.col(column).cast("long")).dropna(), made, {"bits": (bits // 64, np.uint64)}, ("bits",))["bits"]
