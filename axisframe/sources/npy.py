"""Binary array files (.npy, .npz and raw ones) read by tasks and written by tasks, block by block."""

from __future__ import annotations

import ast
import io
import math
import struct
import zipfile
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dtypes import DTYPES, dtype
from ..frame import NDFrame, idx
from ..storage import numbered, ready, saved
from . import ranges
from .text import fromstring

#: Elements of one block when an array is written.
WRITE_BLOCK = 1 << 18


def header(data: bytes) -> tuple[np.dtype, bool, tuple[int, ...], int]:
    """(type, Fortran order, shape, first byte of the values)."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    size, at = (struct.unpack_from("<H", data, 8)[0], 10) if data[6] == 1 else (struct.unpack_from("<I", data, 8)[0], 12)
    own = ast.literal_eval(data[at : at + size].decode("latin-1"))
    kind = np.dtype(own["descr"])
    if kind.newbyteorder("=").name not in DTYPES:
        raise TypeError(f"values of type {own['descr']} aren't numbers")
    return kind, own["fortran_order"], tuple(own["shape"]), at + size


def _head(spark: SparkSession, path: str, member: str | None) -> tuple:
    content = spark.read.format("binaryFile").load(path).select("content")
    if member is None:
        return header(bytes(content.select(F.substring("content", 1, 65536).alias("h")).first()["h"]))

    def made(batches):
        for batch in batches:
            for x in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(x.as_py())) as z:
                    yield pa.RecordBatch.from_pydict({"h": [z.read(f"{member}.npy")[:65536]]})

    return header(bytes(content.mapInArrow(made, "h binary").first()["h"]))


def members(spark: SparkSession, path: str) -> list[str]:
    """The names of the arrays of an .npz file."""

    def made(batches):
        for batch in batches:
            for x in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(x.as_py())) as z:
                    yield pa.RecordBatch.from_pydict({"n": [n.removesuffix(".npy") for n in z.namelist()]})

    return [r["n"] for r in spark.read.format("binaryFile").load(path).select("content").mapInArrow(made, "n string").collect()]


def load(spark: SparkSession, path: str, member: str | None = None) -> NDFrame:
    """One array of an .npy file, or of a member of an .npz file, by any path that Spark reads.

    The file is read whole by one task (a file of this kind can't be split
    without its header) and leaves it in batches.
    """
    kind, fortran, shape, at = _head(spark, path, member)
    native = kind.newbyteorder("=")
    ours = DTYPES[native.name]
    n = len(shape)

    def made(batches):
        for batch in batches:
            for x in batch.column(0):
                data = x.as_py()
                if member is not None:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        data = z.read(f"{member}.npy")
                flat = np.frombuffer(data, kind, math.prod(shape), at)
                for lo in range(0, len(flat), 1 << 18):
                    part = flat[lo : lo + (1 << 18)].astype(native)
                    places = np.unravel_index(np.arange(lo, lo + len(part)), shape, order="F" if fortran else "C") if n else []
                    if ours.kind == "c":
                        v = pa.StructArray.from_arrays([pa.array(part.real), pa.array(part.imag)], ["re", "im"])
                    elif native.name == "uint64":
                        v = pa.array([int(p) for p in part], pa.decimal128(20, 0))
                    else:
                        v = pa.array(part.astype({"uint8": "int16", "uint16": "int32", "uint32": "int64", "float16": "float32"}.get(native.name, native)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.int64()) for p in places), v], [*idx(n), "v"])

    df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(made, ", ".join([*(f"{i} long" for i in idx(n)), f"v {ours.spark}"]))
    return NDFrame(df, shape, ours)


def _file_bytes(kind: np.dtype, shape: tuple[int, ...]) -> bytes:
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": shape})
    return head.getvalue()


def _blocks(x: NDFrame, member: int, made) -> DataFrame:
    """The array's blocks in C order: member, block, and the bytes that ``made(values, block)`` gives, with the size and checksum of those before compression."""
    kind = np.dtype(x.dtype.name)
    rows = x.df.select(x.flat_index().alias("at"), F.col("v")).withColumn("block", F.floor(F.col("at") / WRITE_BLOCK))

    def pack(key, t):
        block = key[0].as_py()
        order = np.argsort(t["at"].to_numpy())
        v = t["v"].combine_chunks()
        if kind.kind == "c":
            own = (v.field(0).to_numpy(zero_copy_only=False) + 1j * v.field(1).to_numpy(zero_copy_only=False)).astype(kind)
        elif kind.name == "uint64":
            own = np.array(v.to_pylist(), dtype=object).astype(kind)
        else:
            own = v.to_numpy(zero_copy_only=False).astype(kind)
        raw, data = made(own[order], block)
        return pa.table({"member": pa.array([member], pa.int32()), "block": [block], "data": pa.array([data], pa.binary()), "raw": [len(raw)], "crc": [zlib.crc32(raw)]})

    return rows.groupBy("block").applyInArrow(pack, "member int, block long, data binary, raw long, crc long")


def _plain(values: np.ndarray, block: int) -> tuple[bytes, bytes]:
    raw = values.tobytes()
    return raw, raw


def _whole_numbers(x: NDFrame) -> tuple[int, int]:
    """How many blocks the array has, and how many bytes its elements."""
    return -(-x.size // WRITE_BLOCK), x.size * np.dtype(x.dtype.name).itemsize


def _at_fixed_places(x: NDFrame, member: int, begin: int) -> DataFrame:
    step = WRITE_BLOCK * np.dtype(x.dtype.name).itemsize
    return _blocks(x, member, _plain).withColumn("at", F.lit(begin).cast("long") + F.col("block") * step)


def _at_running_places(blocks: DataFrame, n: int, begin: int) -> DataFrame:
    """Saved blocks of any sizes, one behind the other: a running sum of sizes tells where."""
    sizes = NDFrame(blocks.select(F.col("block").alias("i0"), F.octet_length("data").cast("long").alias("v")), [n], "int64")
    ends = sizes.scan(F.sum, lambda a, b: a + b, 0).df.select(F.col("i0").alias("block"), F.col("v").alias("end"))
    return blocks.join(ends, "block").withColumn("at", F.lit(begin).cast("long") + F.col("end") - F.octet_length("data"))


def save(x: NDFrame, path: str) -> None:
    """One .npy file: tasks write their blocks at their places in it, and the commit gives it its head and name.

    The path must be on a file system that the driver and all executors mount.
    On another store a file can't be written at many places; there the driver
    passes one block at a time on.
    """
    head = _file_bytes(np.dtype(x.dtype.name), x.shape)
    if ranges.mounted(path) is None:
        return _streamed(x, path, head)
    blocks, size = _whole_numbers(x)
    members = [ranges.Member(path, head, blocks, size, size)]
    (begin,) = ranges.placed(members, False)
    return ranges.write(x.spark, _at_fixed_places(x, 0, begin), members, path, False)


def _streamed(x: NDFrame, path: str, head: bytes) -> None:
    spark = x.spark
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(head))
        for r in _blocks(x, 0, _plain).repartitionByRange("block").sortWithinPartitions("block").toLocalIterator():
            out.write(bytearray(r["data"]))
    finally:
        out.close()


def savez(path: str, **arrays: NDFrame) -> None:
    """An archive of arrays by name, not compressed: every byte's place is known before any is written."""
    spark, members = next(iter(arrays.values())).spark, []
    for name, x in arrays.items():
        blocks, size = _whole_numbers(x)
        members.append(ranges.Member(f"{name}.npy", _file_bytes(np.dtype(x.dtype.name), x.shape), blocks, size, size))
    parts = None
    for k, (x, begin) in enumerate(zip(arrays.values(), ranges.placed(members, True))):
        own = _at_fixed_places(x, k, begin)
        parts = own if parts is None else parts.unionByName(own)
    ranges.write(spark, parts, members, _mounted(path), True)


def savez_compressed(path: str, **arrays: NDFrame) -> None:
    """An archive of compressed arrays by name.

    Each block is compressed on its own and ends on a whole byte, so that
    blocks joined are one stream.  They are saved once, which gives the sizes
    that their places follow from.
    """
    spark, members, saves = next(iter(arrays.values())).spark, [], []
    for k, (name, x) in enumerate(arrays.items()):
        n, size = _whole_numbers(x)

        def squeezed(values, block, n=n):
            c, raw = zlib.compressobj(6, zlib.DEFLATED, -15), values.tobytes()
            return raw, c.compress(raw) + c.flush(zlib.Z_FINISH if block == n - 1 else zlib.Z_FULL_FLUSH)

        saves.append(saved(_blocks(x, k, squeezed), "squeezed"))
        stored = saves[-1].agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
        members.append(ranges.Member(f"{name}.npy", _file_bytes(np.dtype(x.dtype.name), x.shape), n, size, stored, True))
    parts = None
    for own, m, begin in zip(saves, members, ranges.placed(members, True)):
        own = _at_running_places(own, m.blocks, begin)
        parts = own if parts is None else parts.unionByName(own)
    ranges.write(spark, parts, members, _mounted(path), True)


def tofile(x: NDFrame, path: str, sep: str = "") -> None:
    """A file of raw values, or of their text with ``sep`` between them."""
    n, size = _whole_numbers(x)
    if not sep:
        members, blocks = [ranges.Member(path, b"", n, size, size)], _at_fixed_places(x, 0, 0)
    else:

        def written(values, block):
            text = (("" if block == 0 else sep) + sep.join(map(str, values.tolist()))).encode()
            return text, text

        own = saved(_blocks(x, 0, written), "text")
        size = own.agg(F.sum("raw")).first()[0] or 0
        members, blocks = [ranges.Member(path, b"", n, size, size)], _at_running_places(own, n, 0)
    ranges.write(x.spark, blocks, members, _mounted(path), False)


def _mounted(path: str) -> str:
    if ranges.mounted(path) is None:
        raise ValueError(f"{path}: tasks write at many places of a file, which needs a file system that all machines mount")
    return path


class NpzFile(Mapping):
    """The arrays of an .npz file by their names, each read when it is asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, members(spark, path)

    def __getitem__(self, name: str) -> NDFrame:
        if name.removesuffix(".npy") not in self.files:
            raise KeyError(name)
        return load(self.spark, self.path, name.removesuffix(".npy"))

    def __iter__(self):
        return iter(self.files)

    def __len__(self) -> int:
        return len(self.files)


def fromfile(spark: SparkSession, path: str, kind="float64", count: int = -1, sep: str = "", offset: int = 0) -> NDFrame:
    """A vector of the raw values of a binary file, or of the numbers of a text file that ``sep`` parts.

    A binary file is read whole by one task and leaves it in batches; a text
    file is read in lines.
    """
    ours = dtype(kind)
    if sep:
        if not ours.kind == "f":
            return fromfile(spark, path, "float64", count, sep).astype(ours)
        lines = spark.read.text(path).select(fromstring(F.col("value"), sep).alias("x"), F.monotonically_increasing_id().alias("k"))
        cells = numbered(lines.select("k", F.posexplode("x").alias("j", "v")).filter("v is not null"), ["k", "j"], "i0")
        own = cells if count < 0 else cells.filter(F.col("i0") < count)
        return NDFrame(own.select("i0", F.col("v").cast(ours.spark).alias("v")), [own.count()], ours)
    native = np.dtype(ours.name)
    stored = {"uint8": "int16", "uint16": "int32", "uint32": "int64", "float16": "float32"}.get(native.name, native)

    def made(batches):
        for batch in batches:
            for x in batch.column(0):
                flat = np.frombuffer(x.as_py(), native, count, offset)
                for lo in range(0, len(flat), 1 << 18):
                    part = flat[lo : lo + (1 << 18)]
                    v = pa.StructArray.from_arrays([pa.array(part.real), pa.array(part.imag)], ["re", "im"]) if ours.kind == "c" else pa.array([int(p) for p in part], pa.decimal128(20, 0)) if native.name == "uint64" else pa.array(part.astype(stored))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), v], ["i0", "v"])

    content = ready(spark).read.format("binaryFile").load(path)
    size = content.select("length").first()["length"]
    n = max(0, size - offset) // native.itemsize
    return NDFrame(content.select("content").mapInArrow(made, f"i0 long, v {ours.spark}"), [n if count < 0 else min(n, count)], ours)
