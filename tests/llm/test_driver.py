"""What the driver holds while operators run."""

import gc
from unittest import mock

import numpy as np
import pyarrow as pa
from axisframe import storage
from axisframe.llm import language_id
from axisframe.llm.textbytes import slices


def test_garbage_goes_between_tables(spark):
    dropped = spark._jvm.java.lang.ref.WeakReference(spark._jvm.java.lang.Object())
    gc.collect()
    with mock.patch.object(storage, "HEAP_SHARE", 0), mock.patch.dict(storage._collected, clear=True):
        assert storage.saved(spark.range(10), "ten").count() == 10
    assert dropped.get() is None


def test_sample_is_held_in_few_bytes(spark, docs):
    picked = docs.select("doc_id", "text", "lang").filter("text is not null")
    rows, by_hand = language_id._sampled(picked), []
    for r in picked.collect():
        piece, found = next(iter(slices(pa.array([r["text"]])))), []
        for _, code, some in language_id._subwords(piece):
            found.append(code[some])
        key, n = np.unique(np.concatenate(found), return_counts=True)
        by_hand.append((r["lang"], key.astype(np.int32).tobytes(), n.tolist()))
    by_hand.sort()
    assert [(lang, codes.astype(np.int32).tobytes(), n.tolist()) for lang, codes, n in rows] == [tuple(x) for x in by_hand]
    assert all(codes.dtype == np.uint16 and n.itemsize <= 2 for _, codes, n in rows)
