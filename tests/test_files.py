"""Files that many tasks write, read back by numpy byte for byte."""

import io
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisframe.operators import creation
from axisframe.sources import npy, ranges


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(npy, "WRITE_BLOCK", 7)


KINDS = ("float64", "float32", "int16", "uint8", "uint64", "bool", "complex128")


@pytest.mark.parametrize("kind", KINDS)
def test_save_is_what_numpy_saves(spark, small, tmp_path, kind):
    a = (np.arange(60) * 37 % 101).reshape(5, 12).astype(kind)
    x = creation.array(spark, a.astype("int64")).astype(kind) if kind == "uint64" else creation.array(spark, a)
    npy.save(x, str(tmp_path / "a.npy"))
    want = io.BytesIO()
    np.save(want, a)
    assert (tmp_path / "a.npy").read_bytes() == want.getvalue()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.npy"]
    npy.tofile(x, f"file://{tmp_path}/raw")
    assert (tmp_path / "raw").read_bytes() == a.tobytes()


@pytest.mark.parametrize("save", [npy.savez, npy.savez_compressed])
def test_archives_are_whole(spark, small, tmp_path, save):
    arrays = {"one": np.arange(50.0).reshape(5, 10), "ünïque": np.arange(9, dtype="int32"), "none": np.zeros((0, 3)), "lone": np.array(3.5)}
    path = str(tmp_path / "z.npz")
    save(path, **{k: creation.array(spark, v) for k, v in arrays.items()})
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == [f"{k}.npy" for k in arrays]
    got = np.load(path)
    for k, v in arrays.items():
        np.testing.assert_array_equal(got[k], v)
        assert got[k].dtype == v.dtype
    np.testing.assert_array_equal(npy.load(spark, path, "one").to_numpy(), arrays["one"])


def test_text_values(spark, small, tmp_path):
    a = np.arange(30) / 8
    npy.tofile(creation.array(spark, a), str(tmp_path / "t"), sep=",")
    np.testing.assert_array_equal(np.fromfile(tmp_path / "t", sep=","), a)


def test_a_hole_leaves_no_file(spark, small, tmp_path):
    x = creation.array(spark, np.arange(40.0))
    x.df = x.df.filter(F.col("i0") != 20)
    with pytest.raises(Exception, match="without a value"):
        npy.save(x, str(tmp_path / "a.npy"))
    assert not (tmp_path / "a.npy").exists()


def test_checksums_join():
    a, b = bytes(range(256)) * 3, b"abc" * 1001
    assert ranges.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert ranges.joined_crc(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_wide_archives_have_their_sizes():
    """Headers of members beyond 4 GB, as zipfile reads them."""
    m = ranges.Member("big.npy", b"head", 5, 5 << 30, 5 << 30)
    (begin,) = ranges.placed([m], True)
    directory = m.central(7)
    info = zipfile.ZipInfo("big.npy")
    tail = ranges._tail(directory, begin + m.stored, 1)
    end = zipfile._EndRecData(io.BytesIO(tail[-22:]))
    assert end[zipfile._ECD_ENTRIES_TOTAL] == 1 and tail[:4] == b"PK\x06\x06"
    info.extra, info.file_size, info.compress_size, info.header_offset = directory[46 + 7 :], 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF
    info._decodeExtra(zlib.crc32(b"big.npy"))
    assert (info.file_size, info.compress_size, info.header_offset) == ((5 << 30) + 4, (5 << 30) + 4, 0)
