"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics are taken from the bytes of whole texts, vectorised over slices of
documents.  Trees are grown level by level on binned statistics in numpy, from
a sample of labelled rows whose size is a parameter, and flattened into arrays
of features, thresholds and leaves; scoring walks all documents of a batch
through a tree at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fraction_filter, ready
from .textbytes import slices

STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "mark_share", "symbol_share", "shout_share", "line_share",
    "wide_share", "distinct_share", "common_share", "short_share", "long_share", "marked_words", "capital_words", "repeated_lines", "sentence_length",
)

_KINDS = np.zeros((8, 256), bool)
_KINDS[0, 65:91] = True
_KINDS[1, 48:58] = True
_KINDS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_KINDS[3, list(b"#$%&*@^~|<>{}[]\\/_=+")] = True
_KINDS[4, list(b"!?")] = True
_KINDS[5, [10]] = True
_KINDS[6, 128:] = True
_KINDS[7, list(b".!?")] = True


def statistics(piece) -> np.ndarray:
    """A row of STATISTICS for each document of the slice; an empty one has zeros."""
    piece.find_words()
    n, words = np.diff(piece.bounds), np.diff(piece.of)
    size, many = np.maximum(n, 1), np.maximum(words, 1)
    share = []
    for kind in _KINDS:
        total = np.concatenate(([0], np.cumsum(kind[piece.data])))
        share.append(total[piece.bounds[1:]] - total[piece.bounds[:-1]])
    upper, digit, mark, symbol, shout, line, wide, stop = share

    def per_word(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(x)))
        return (total[piece.of[1:]] - total[piece.of[:-1]]) / many

    length = piece.ends - piece.starts
    last, first = (piece.data[piece.ends - 1], piece.data[piece.starts]) if len(length) else (piece.data[:0], piece.data[:0])
    distinct, common = _repeats(piece.doc_of_word(), piece.word_hashes(lower=True), len(piece))
    stops = piece.data == 10
    stops[piece.bounds[1:][n > 0] - 1] = True
    ends = np.flatnonzero(stops)
    total = np.concatenate(([np.uint64(0)], np.cumsum((piece.data.astype(np.uint64) + np.uint64(1)) * _weights(len(piece.data)))))
    begin = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    of_line = np.searchsorted(piece.bounds, begin, "right") - 1
    code = (total[ends + (piece.data[ends] != 10)] - total[begin]) * _unweights(len(piece.data))[begin]
    lines = np.bincount(of_line, minlength=len(piece)) if len(ends) else np.zeros(len(piece), np.int64)
    alone, _ = _repeats(of_line, code, len(piece))
    out = [
        np.log1p(n), np.log1p(words), per_word(length), upper / size, digit / size, mark / size, symbol / size, shout / size, line / size,
        wide / size, distinct / many, common / many, per_word(length <= 3), per_word(length > 12), per_word(_KINDS[3][last] | _KINDS[4][last]), per_word(_KINDS[0][first]),
        1 - alone / np.maximum(lines, 1), np.minimum(words / np.maximum(stop, 1), 200),
    ]
    table = np.stack(out, axis=1).astype(np.float32)
    table[n == 0] = 0
    return table


def _weights(n: int) -> np.ndarray:
    from .textbytes import _byte_powers

    return _byte_powers.upto(n + 1)[0][:n]


def _unweights(n: int) -> np.ndarray:
    from .textbytes import _byte_powers

    return _byte_powers.upto(n + 1)[1]


def _repeats(doc: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document, how many codes are distinct and how often the commonest is there."""
    by = np.lexsort((code, doc))
    doc, code = doc[by], code[by]
    new = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))) if len(doc) else np.zeros(0, np.int64)
    runs, of = np.diff(np.append(new, len(doc))), doc[new]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, runs)
    return np.bincount(of, minlength=n), most


class Trees:
    """Flattened trees: node i's children are 2i + 1 and 2i + 2; leaves follow the inner nodes."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        depth = int(inner + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1: second-order gains of the logistic loss on histograms."""
    prior = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base, inner, features = float(np.log(prior / (1 - prior))), (1 << depth) - 1, x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(features)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(features)], axis=1)
    score = np.full(len(y), base)
    out_f, out_t, out_l = [], [], []
    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            gains = np.full((width, features), 0.0)
            where = np.zeros((width, features), np.int64)
            for f in range(features):
                key = (node - first) * (bins + 1) + binned[:, f]
                sums = [np.cumsum(np.bincount(key, v, width * (bins + 1)).reshape(width, bins + 1), axis=1) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain[:, len(cuts[f]) :] = 0
                where[:, f] = gain.argmax(axis=1)
                gains[:, f] = gain.max(axis=1)
            for k in range(width):
                f = int(gains[k].argmax())
                if gains[k, f] > 1e-6:
                    feature[first + k], threshold[first + k] = f, cuts[f][where[k, f]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        own = node - inner
        leaf = -rate * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + l2)
        score += leaf[own]
        out_f.append(feature)
        out_t.append(threshold)
        out_l.append(leaf)
    shape = (-1, inner)
    return Trees(base, np.array(out_f, np.int64).reshape(shape), np.array(out_t).reshape(shape), np.array(out_l).reshape(-1, inner + 1))


def table(docs: DataFrame, *more: str) -> DataFrame:
    """The columns ``more`` and ``x``, the statistics of ``text`` as packed 32-bit floats."""

    def made(batches):
        for batch in batches:
            for piece in slices(batch.column(0)):
                raw, width = statistics(piece).tobytes(), 4 * len(STATISTICS)
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + k).slice(piece.first, len(piece)) for k in range(len(more))), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())], [*more, "x"])

    ready(docs.sparkSession)
    rows = docs.select("text", *more)
    return rows.mapInArrow(made, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]) + ", x binary")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, most: int) -> DataFrame:
    """doc_id, text and label of about ``most`` labelled documents that ``keep`` allows, those with the least hashes of doc_id."""
    known = labels.filter(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    n = known.count()
    return docs.select("doc_id", "text").join(F.broadcast(known.filter(fraction_filter("doc_id", most / max(n, 1)))), "doc_id")


def train(docs: DataFrame, labels: DataFrame, keep, most: int = 20_000) -> Trees:
    """Trees from at most about ``most`` rows of ``labels`` (doc_id, quality) that ``keep`` allows.

    The driver receives their statistics, no texts.  Null labels and doc_ids
    teach nothing; without both labels every document scores the share of ones
    (0.5 without any).
    """
    rows = table(labelled_sample(docs, labels, "quality", keep, most), "doc_id", "label").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r["label"] > 0 for r in rows], float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score (of label 1) and predicted for every row of ``docs`` (doc_id, text).

    Null and empty texts score by their statistics, which are zeros.  Other
    columns are ignored; an empty table gives no rows.
    """

    def made(batches):
        for batch in batches:
            for piece in slices(batch.column(1)):
                p = trees.scores(statistics(piece))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, score double, predicted int")
