"""ISO base media containers in binary columns: written, walked and read back.

Boxes nest as (size, four-character type, payload).  Reading walks the boxes
without touching the media payload, decodes the sample tables (``stts``
durations, ``stsz`` sizes, ``stsc`` and ``stco``/``co64`` chunk layout,
``stss`` keyframes) and gives codec, duration and the byte range of every
keyframe.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, ready

#: Bytes of one sample, samples of one chunk, and samples a second, of the containers written here.
UNIT, CHUNK_SAMPLES, RATE = 192, 64, 50
#: Boxes that hold only further boxes.
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I", size), kind, *parts))
    return b"".join((struct.pack(">I", 1), kind, struct.pack(">Q", size + 8), *parts))


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def padded(text: bytes) -> bytes:
    """``text`` and blanks up to the next positive multiple of a sample."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def write(payload: bytes, codec: bytes = b"raw ") -> bytes:
    """A file with one track: samples of 8-bit values, the first of each chunk a keyframe."""
    n = len(payload) // UNIT
    chunks = -(-n // CHUNK_SAMPLES)
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")
    entry = _box(codec, b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", UNIT, 8, 0, 0, (RATE << 16) & 0xFFFFFFFF))
    layout = struct.pack(">III", 1, CHUNK_SAMPLES, 1)
    runs = [layout] if n % CHUNK_SAMPLES == 0 else [layout, struct.pack(">III", chunks, n % CHUNK_SAMPLES, 1)] if chunks > 1 else [struct.pack(">III", 1, n, 1)]
    wide = len(payload) > (1 << 32) - (1 << 24)

    def moov(base: int) -> bytes:
        at = base + np.arange(chunks, dtype=np.int64) * (UNIT * CHUNK_SAMPLES)
        table = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes())
        keys = (np.arange(chunks) * CHUNK_SAMPLES + 1).astype(">u4").tobytes()
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", chunks), keys),
            _full(b"stsc", struct.pack(">I", len(runs)), *runs),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            table,
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"smhd", b"\0" * 4), dinf, stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 13), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, b"\0" * 8, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if 8 + len(payload) >= 1 << 32 else 8
    return kind + moov(len(kind) + len(moov(0)) + head) + _box(b"mdat", payload)


def boxes(data: bytes, lo: int = 0, hi: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of types, first byte, last byte + 1) of every box's content, parents first.

    A box that claims more than its parent has ends the walk of that parent.
    """
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1 and lo + 16 <= hi:
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            return
        yield (*path, kind), lo + head, lo + size
        if kind in _NESTED:
            yield from boxes(data, lo + head, lo + size, (*path, kind))
        lo += size


def tracks(data: bytes) -> list[dict]:
    """For each track: codec, timescale, duration, keyframes, sizes and offsets of its samples."""
    found: list[dict] = []
    for path, lo, hi in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({"codec": None, "timescale": 0, "duration": 0, "boxes": {}})
        elif found and b"trak" in path:
            found[-1]["boxes"][kind] = (lo, hi)
    out = []
    for t in found:
        b = t.pop("boxes")

        def table(kind: bytes, kinds: str, skip: int = 4, width: int = 1, b=b) -> np.ndarray:
            if kind not in b:
                return np.zeros((0, width), np.int64)
            n = struct.unpack_from(">I", data, b[kind][0] + skip)[0]
            return np.frombuffer(data, kinds, n * width, b[kind][0] + skip + 4).astype(np.int64).reshape(-1, width)

        if b"mdhd" in b:
            lo = b[b"mdhd"][0]
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if data[lo] else ">II", data, lo + (20 if data[lo] else 12))
        if b"stsd" in b:
            t["codec"] = data[b[b"stsd"][0] + 12 : b[b"stsd"][0] + 16].decode("latin-1")
        size, n = struct.unpack_from(">II", data, b[b"stsz"][0] + 4) if b"stsz" in b else (0, 0)
        sizes = np.full(n, size, np.int64) if size else table(b"stsz", ">u4", 8)[:, 0]
        at = (table(b"co64", ">u8") if b"co64" in b else table(b"stco", ">u4"))[:, 0]
        layout = table(b"stsc", ">u4", width=3)
        per = np.repeat(layout[:, 1], np.diff(np.append(layout[:, 0], len(at) + 1))) if len(layout) else np.zeros(0, np.int64)
        chunk = np.repeat(np.arange(len(per)), per)[:n]
        before = np.concatenate(([0], np.cumsum(sizes)))
        first = np.concatenate(([0], np.cumsum(per)))[:-1]
        t["sizes"] = sizes[: len(chunk)]
        t["offsets"] = at[chunk] + before[: len(chunk)] - before[np.minimum(first, len(before) - 1)][chunk]
        keys = table(b"stss", ">u4")[:, 0] - 1 if b"stss" in b else np.arange(len(chunk))
        t["keyframes"] = keys[(keys >= 0) & (keys < len(chunk))]
        out.append(t)
    return out


def _payload(data: bytes, track: dict) -> bytes:
    """The samples of a track in order: neighbouring ones are copied together."""
    at, sizes = track["offsets"], track["sizes"]
    if not len(at):
        return b""
    breaks = np.flatnonzero(at[1:] != (at + sizes)[:-1]) + 1
    lo, hi = at[np.concatenate(([0], breaks))], (at + sizes)[np.concatenate((breaks - 1, [len(at) - 1]))]
    return b"".join(data[i:j] for i, j in zip(lo.tolist(), hi.tolist()))


def containers(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8 bytes in a container. A null text is empty."""

    def made(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raw = [(x or "").encode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([write(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, n_bytes long, media binary")


_INFO = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<first: long, last: long>>"


def media_info(media: DataFrame, column: str = "media") -> DataFrame:
    """The columns of ``media`` but ``column``, and what its first track says: codec, timescale, duration, n_samples and keyframes (byte ranges, last included).

    Payloads aren't decoded.  A null, empty or broken container gives nulls.
    A column of one of the new names is replaced.
    """
    new = ("codec", "timescale", "duration", "n_samples", "keyframes")
    kept = [c for c in media.columns if c != column and c not in new]
    schema = media.select(*kept).schema
    ready(media.sparkSession)

    def made(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: dict = {k: [] for k in new}
                for x in part.column(len(kept)).to_pylist():
                    try:
                        t = (tracks(x) if x else [None])[0]
                    except (struct.error, ValueError, IndexError):
                        t = None
                    if t is None:
                        values: tuple = (None,) * 5
                    else:
                        at = t["offsets"][t["keyframes"]]
                        values = (t["codec"], t["timescale"], t["duration"], len(t["sizes"]), [{"first": a, "last": b} for a, b in zip(at.tolist(), (at + t["sizes"][t["keyframes"]] - 1).tolist())])
                    for k, v in zip(new, values):
                        out[k].append(v)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *(pa.array(out[k], kind) for k, kind in zip(new, kinds))], [*kept, *new])

    full = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), _INFO])
    return media.select(*kept, column).mapInArrow(made, full)


def stored(docs: DataFrame) -> DataFrame:
    """``containers`` written as a Parquet table of the shared folder and read back."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "media")
    made = containers(docs)
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def read_back(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and digests of the payload and of the stored bytes, with the features of the first track.

    ``feature`` names codec, duration in seconds, samples, keyframes, and the
    byte ranges of the first and the last keyframe.
    """

    def made(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: dict = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
                for data in part.column(2).to_pylist():
                    t = tracks(data)[0]
                    payload = _payload(data, t)
                    keys, at = t["keyframes"], t["offsets"]
                    ends = [f"{at[k]}-{at[k] + t['sizes'][k] - 1}" for k in (keys[0], keys[-1])]
                    feature = f"codec={t['codec'].strip()} seconds={t['duration'] / t['timescale']:.2f} samples={len(at)} keyframes={len(keys)} first={ends[0]} last={ends[1]}"
                    for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature)):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(v, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in out.items())], ["doc_id", "n_bytes", *out])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(made, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
