"""Packing documents into training sequences by Karmarkar-Karp multiway differencing.

A document's ids (and the closing id) are cut into full windows, which need no
partner, and a rest.  The rests of a run of neighbouring documents are divided
into k windows by multiway differencing: every rest starts as a partial
partition (rest, 0, ..., 0); the two partial partitions with the largest
spreads are merged again and again, the largest sum of one with the smallest
of the other, so that their imbalances oppose each other.  k starts at the
least number that the capacity allows and rises whenever a window would exceed
it.  Runs are closed at ``run_tokens`` ids, so memory doesn't depend on the
input, no row is shuffled, and a lost task is redone from its own input alone.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready

#: The share of a run's ids that is cut into pieces of FILLER_IDS ids.
FILLER_SHARE, FILLER_IDS = 0.03, 64
#: How a text is cut before byte pairs are merged; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """Ids of a byte-level BPE file of the tokenizers library, as its ``encode`` with ``add_special_tokens=False`` gives them.

    The file's vocabulary is merged by tiktoken, which gives the same ids in a
    tenth of the time if the file cuts texts by PATTERN and merges in the order
    of its ids.  Other files, texts that hold the string of an added token, and
    texts that tiktoken's expression engine gives up on, are encoded by
    tokenizers itself.  With ``special_as_text`` the string of an added token
    is ordinary text, else it is that token.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        self.path, self.special_as_text, self.fast, self.slow = path, special_as_text, None, None
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        self.added = [x["content"] for x in vocabulary.get("added_tokens", [])]
        if self.is_plain(vocabulary):
            import tiktoken

            kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
            of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(kept))}
            ranks = {bytes(of[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in set(self.added)}
            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def is_plain(vocabulary: dict) -> bool:
        """Whether the file's texts are cut by PATTERN and its pairs merged in the order of their ids, and nothing else is done to them."""
        model, cut = vocabulary["model"], vocabulary.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or vocabulary.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return False
        if any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        merged = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
        return all(a < b for a, b in zip(merged, merged[1:]))

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if self.fast and (self.special_as_text or not any(x in text for x in self.added)):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()
            except (ValueError, RuntimeError):  # the expression engine's bounds
                pass
        if self.slow is None:
            import tokenizers

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.slow = tokenizers.Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = self.special_as_text
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str, special_as_text: bool = False) -> Tokenizer:
    """The tokenizer of a file, read once by each Python worker whatever the number of its tasks."""
    return Tokenizer(path, special_as_text)


def divide(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window of each size, when all are divided among ``k`` by multiway differencing."""
    m = len(sizes)
    if k == 1 or m <= 1:
        return np.zeros(m, np.int64)
    sums: list = []
    for s in sizes.tolist():
        row = np.zeros(k, np.int64)
        row[k - 1] = s
        sums.append(row)  # in rising order throughout
    heap = [(-int(s), i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    merged = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        by = np.argsort(both, kind="stable")
        merged.append((a, b, by))
        sums[a] = sums[b] = None
        both = both[by]
        sums.append(both)
        heapq.heappush(heap, (-int(both[-1] - both[0]), len(sums) - 1))
    place: dict = {len(sums) - 1: np.arange(k)}
    for i in range(len(merged) - 1, -1, -1):
        a, b, by = merged[i]
        own = np.empty(k, np.int64)
        own[by] = place.pop(m + i)
        place[a], place[b] = own, own[::-1]
    return np.array([place[i][k - 1] for i in range(m)], np.int64)


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Near-equal windows of at most ``capacity``: their number rises until none exceeds it."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        own = divide(sizes, k)
        if len(sizes) == 0 or np.bincount(own, sizes, k).max() <= capacity:
            return own
        k += 1


def _pack_run(run: list, capacity: int, first: int) -> tuple[dict, int]:
    """Pieces of a run of (id, ids as bytes), placed in sequences from ``first`` on."""
    out: dict = {x: [] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

    def put(doc, raw, start, length, seq, offset):
        for x, v in zip(out, (doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4, seq, offset)):
            out[x].append(v)

    rests = []
    for doc, raw in run:
        n = len(raw) // 4
        for start in range(0, n - capacity + 1, capacity):
            put(doc, raw, start, capacity, first, 0)
            first += 1
        if n % capacity:
            rests.append((doc, raw, n - n % capacity, n % capacity))
    # The longest rests, up to a small share of the ids, are cut small: differencing evens the windows out with them.
    rests.sort(key=lambda x: -x[3])
    share, cut = FILLER_SHARE * sum(x[3] for x in rests), []
    while rests and share >= rests[0][3]:
        doc, raw, start, length = rests.pop(0)
        cut += [(doc, raw, start + k, min(FILLER_IDS, length - k)) for k in range(0, length, FILLER_IDS)]
        share -= length
    rests += cut
    sizes = np.array([x[3] for x in rests], np.int64)
    own = windows(sizes, capacity)
    used: dict = {}
    for (doc, raw, start, length), w in zip(rests, own.tolist()):
        put(doc, raw, start, length, first + w, used.get(w, 0))
        used[w] = used.get(w, 0) + length
    return out, first + (int(own.max()) + 1 if len(own) else 0)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, closing_id: int = 1, run_tokens: int = 1 << 20, run_documents: int = 1 << 14, special_as_text: bool = False) -> DataFrame:
    """A row for every piece of every document, with its sequence and place there.

    ``vocabulary`` is the path of a byte-level BPE file, which must be there on
    every executor.  Each id lies in exactly one piece; a document is cut
    at multiples of ``capacity``, and a few long rests into small pieces; a sequence's pieces fill it gapless from 0.
    Documents are packed in runs of at most ``run_tokens`` ids (and one text)
    and ``run_documents`` rows, which bounds what a task remembers of the
    merges: their number times the number of windows.
    ``special_as_text`` is as in Tokenizer.
    A null or empty text is the closing id alone.  Null and repeated doc_ids
    are packed as any other row.  An empty table gives no rows.
    """
    ready(docs.sparkSession)

    def made(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        first, run, held = (context.partitionId() if context else 0) << 40, [], 0
        model, closing = tokenizer(vocabulary, special_as_text), np.array([closing_id], "<u4").tobytes()
        names = ["doc_id", "text"]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 256)
                at += 256
                ids, texts = (part.column(x).to_pylist() for x in names)
                for doc, text in zip(ids, texts):
                    raw = model.encode(text or "")
                    run.append((doc, raw + closing))
                    held += len(raw) // 4 + 1
                    if held >= run_tokens or len(run) >= run_documents:
                        out, first = _pack_run(run, capacity, first)
                        yield pa.RecordBatch.from_pydict(out, _ARROW)
                        run, held = [], 0
        if run:
            yield pa.RecordBatch.from_pydict(_pack_run(run, capacity, first)[0], _ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, SCHEMA)


_ARROW = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
