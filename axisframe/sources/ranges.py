"""One file written by many tasks: each writes its blocks at their places, and the commit adds what stands around them.

The file lies under another name until the commit; blocks that a repeated task
writes again are the same bytes.  A zip archive's checksums are put together
from those of the blocks, so nobody reads the data again.
"""

from __future__ import annotations

import contextlib
import json
import os
import struct
import zlib
from dataclasses import dataclass, field
from functools import cache
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..storage import ready

_WIDE = 0xFFFFFFFF


def mounted(path: str) -> str | None:
    """The path on the file system that the driver and all executors mount, or None for another store's path."""
    parts = urlparse(path)
    return (unquote(parts.path) if parts.scheme else path) if parts.scheme in ("", "file") else None


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


@cache
def _zeros(power: int) -> tuple[int, ...]:
    """What 2**power zero bytes do to a CRC-32 register, bit by bit."""
    if power:
        half = list(_zeros(power - 1))
        return tuple(_times(half, row) for row in half)
    out = [1 << k for k in range(32)]
    for _ in range(8):  # one bit at a time: shift, and the polynomial for a bit that falls out
        out = [(row >> 1) ^ (0xEDB88320 if row & 1 else 0) for row in out]
    return tuple(out)


def joined_crc(a: int, b: int, length: int) -> int:
    """The CRC-32 of two runs of bytes from theirs and the length of the second."""
    power = 0
    while length:
        if length & 1:
            a = _times(list(_zeros(power)), a)
        length >>= 1
        power += 1
    return a ^ b


@dataclass
class Member:
    """An array in the file: its name in an archive, what stands before its blocks, and their number and sizes."""

    name: str
    head: bytes
    blocks: int
    raw: int  # bytes of the blocks before they are compressed
    stored: int  # and as they are written
    packed: bool = False
    at: int = 0  # where its local header, or its head, begins

    def head_stored(self) -> bytes:
        if not self.packed:
            return self.head
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        return c.compress(self.head) + c.flush(zlib.Z_FULL_FLUSH if self.blocks else zlib.Z_FINISH)

    def sizes(self) -> tuple[int, int]:
        return self.stored + len(self.head_stored()), self.raw + len(self.head)

    def local(self, crc: int) -> bytes:
        """The local header of an archive's member; sizes that don't fit stand in an extra field."""
        name = self.name.encode()
        stored, raw = self.sizes()
        wide = max(stored, raw) >= _WIDE
        extra = struct.pack("<HHQQ", 1, 16, raw, stored) if wide else b""
        return struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 8 if self.packed else 0, 0, 0x21, crc, _WIDE if wide else stored, _WIDE if wide else raw, len(name), len(extra)) + name + extra

    def central(self, crc: int) -> bytes:
        name = self.name.encode()
        stored, raw = self.sizes()
        wide = max(stored, raw, self.at) >= _WIDE
        extra = struct.pack("<HHQQQ", 1, 24, raw, stored, self.at) if wide else b""
        low = lambda x: _WIDE if wide else x
        return struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 8 if self.packed else 0, 0, 0x21, crc, low(stored), low(raw), len(name), len(extra), 0, 0, 0, 0, low(self.at)) + name + extra


def _tail(directory: bytes, at: int, n: int) -> bytes:
    """The end of an archive."""
    out = b""
    if at + len(directory) >= _WIDE or n >= 0xFFFF:
        out = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(directory), at) + struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(len(directory), _WIDE), min(at, _WIDE), 0)


@dataclass
class Written(WriterCommitMessage):
    """Runs of blocks: member, first block, blocks, bytes before compression, checksum of these."""

    runs: list = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, plan = options["path"], json.loads(options["plan"])
        self.temporary, self.archive = plan["temporary"], plan["archive"]
        self.members = [Member(**{**m, "head": bytes.fromhex(m["head"])}) for m in plan["members"]]

    def write(self, iterator):
        runs = []
        out = os.open(self.temporary, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            for batch in iterator:
                for member, block, at, data, raw, crc in zip(*(batch.column(k) for k in ("member", "block", "at", "data", "raw", "crc"))):
                    member, block, at, raw, crc = (x.as_py() for x in (member, block, at, raw, crc))
                    view = memoryview(data.as_buffer())
                    while len(view):
                        n = os.pwrite(out, view, at)
                        view, at = view[n:], at + n
                    last = runs[-1] if runs else None
                    if last and last[0] == member and last[1] + last[2] == block:
                        runs[-1] = [member, last[1], last[2] + 1, last[3] + raw, joined_crc(last[4], crc, raw)]
                    else:
                        runs.append([member, block, 1, raw, crc])
            os.fsync(out)
        finally:
            os.close(out)
        return Written(runs)

    def commit(self, messages):
        runs = sorted(r for m in messages if m is not None for r in m.runs)
        crcs, seen = [zlib.crc32(m.head) for m in self.members], [[0, 0] for _ in self.members]
        for member, first, n, raw, crc in runs:
            if first != seen[member][0]:
                raise RuntimeError(f"blocks of {self.members[member].name} are missing or come twice")
            crcs[member], seen[member] = joined_crc(crcs[member], crc, raw), [first + n, seen[member][1] + raw]
        if seen != [[m.blocks, m.raw] for m in self.members]:
            raise RuntimeError("the array has places without a value")
        out = os.open(self.temporary, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            end = 0
            for m, crc in zip(self.members, crcs):
                begin = (m.local(crc) if self.archive else b"") + m.head_stored()
                os.pwrite(out, begin, m.at)
                end = m.at + len(begin) + m.stored
            if self.archive:
                directory = b"".join(m.central(crc) for m, crc in zip(self.members, crcs))
                os.pwrite(out, directory + _tail(directory, end, len(self.members)), end)
            os.fsync(out)
        finally:
            os.close(out)
        os.replace(self.temporary, self.path)

    def abort(self, messages):
        with contextlib.suppress(OSError):
            os.unlink(self.temporary)


class RangeFile(DataSource):
    """The format ``axisframe_ranges``: rows of member, block, at, data, raw and crc, in one file."""

    @classmethod
    def name(cls):
        return "axisframe_ranges"

    def schema(self):
        return "member int, block long, at long, data binary, raw long, crc long"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def placed(members: list[Member], archive: bool) -> list[int]:
    """Sets where each member begins, one behind the other; returns where its blocks begin."""
    out, at = [], 0
    for m in members:
        m.at = at
        begin = at + (len(m.local(0)) if archive else 0) + len(m.head_stored())
        out.append(begin)
        at = begin + m.stored
    return out


def write(spark: SparkSession, blocks: DataFrame, members: list[Member], path: str, archive: bool) -> None:
    """Writes blocks (member, block, at, data, raw, crc) to one file; a task gets a range of them and holds one at a time."""
    target = mounted(path)
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    ready(spark).dataSource.register(RangeFile)
    plan = {"temporary": f"{target}.{os.urandom(8).hex()}.part", "archive": archive, "members": [{**vars(m), "head": m.head.hex()} for m in members]}
    rows = blocks.select("member", "block", "at", "data", "raw", "crc").repartitionByRange("member", "block").sortWithinPartitions("member", "block")
    rows.write.format("axisframe_ranges").option("path", target).option("plan", json.dumps(plan)).mode("append").save()
