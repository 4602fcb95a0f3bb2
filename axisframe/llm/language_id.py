"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are runs of 2, 3 and 4 bytes of the lower-cased text with everything
but letters as a blank.  Each hashes to one of 2**BITS embeddings; a document
is their average, and a linear softmax over it gives the languages.  Both
layers are trained together by stochastic gradient descent in numpy, on a
sample of labelled rows whose size per language is a parameter.  A part of the
sample is held back to set the softmax's temperature and what is rejected: a
text that is less sure, or whose subwords are less likely, for its length than
all but FALSE_REJECTIONS of the held-back rows.
"""

from __future__ import annotations

import zlib
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ready, saved, small_side
from .textbytes import LETTERS, LOWER, slices

BITS, DIM, SIZES = 15, 16, (2, 3, 4)
#: The share of held-back rows that each of the two cut-offs may reject.
FALSE_REJECTIONS = 0.0001


def _subwords(piece):
    """For each size: the hash of the subword at each byte, whether it holds a letter, and its document's end."""
    letter = LETTERS[piece.data]
    data = np.where(letter, LOWER[piece.data], 32).astype(np.uint64)
    # The second byte of capital Latin-1 letters, as of their small forms.
    data[1:][(piece.data[:-1] == 0xC3) & (piece.data[1:] >= 0x80) & (piece.data[1:] <= 0x9E)] += np.uint64(32)
    for size in SIZES:
        n = max(0, len(data) - size + 1)
        code = np.full(n, size, np.uint64)
        for k in range(size):
            code = code * np.uint64(257) + data[k : k + n]
        some = letter[:n] | letter[1 : n + 1] if n else letter[:0]
        yield size, ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64), some


def _ranges(piece, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    lo = np.minimum(piece.bounds[:-1], n)
    return lo, np.maximum(lo, np.minimum(piece.bounds[1:] - size + 1, n))


class Model:
    """Score tables of a trained classifier: ``table`` has each subword's share of each language's logit, and in its last row its log-likelihood."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, sureness: tuple[float, float, float, float], usual: tuple[float, float, float, float]):
        self.langs, self.table, self.bias, self.sureness, self.usual = langs, table, bias, sureness, usual

    def judged(self, piece) -> tuple[np.ndarray, np.ndarray]:
        """The languages' probabilities, and which documents aren't in any of them."""
        total, count = np.zeros((len(piece), len(self.table))), np.zeros(len(piece))
        for size, code, some in _subwords(piece):
            lo, hi = _ranges(piece, size, len(code))
            sums = np.concatenate(([0], np.cumsum(some)))
            count += sums[hi] - sums[lo]
            for k in range(len(self.table)):
                own = np.concatenate(([0.0], np.cumsum(np.where(some, self.table[k][code], 0.0))))
                total[:, k] += own[hi] - own[lo]
        mean = total / np.maximum(count, 1)[:, None]
        p = softmax(mean[:, :-1] + self.bias)
        return p, (strangeness(_logit(p.max(axis=1)), count, *self.sureness[:3]) > self.sureness[3]) | (strangeness(mean[:, -1], count, *self.usual[:3]) > self.usual[3])


def strangeness(mean: np.ndarray, n: np.ndarray, middle: float, between: float, within: float) -> np.ndarray:
    """How many deviations a text's confidence or mean log-likelihood of ``n`` subwords is below the middle; short texts vary more."""
    return (middle - mean) / np.sqrt(between + within / np.maximum(n, 1))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sampled(rows: DataFrame) -> list:
    """(language, subword codes, their counts) of each row, collected.

    They travel compressed, and the driver holds codes and counts in as few bytes as they need.
    """

    def made(batches):
        for batch in batches:
            for piece in slices(batch.column(0)):
                doc, codes = [], []
                for size, code, some in _subwords(piece):
                    lo, hi = _ranges(piece, size, len(code))
                    for d, (i, j) in enumerate(zip(lo.tolist(), hi.tolist())):
                        own = code[i:j][some[i:j]]
                        doc.append(np.full(len(own), d))
                        codes.append(own)
                key, n = np.unique(np.concatenate(doc) << BITS | np.concatenate(codes), return_counts=True)
                at = np.searchsorted(key, np.arange(len(piece) + 1) << BITS)
                code = (key & ((1 << BITS) - 1)).astype(np.int32)
                raw = [[zlib.compress(x[i:j].tobytes(), 1) for i, j in zip(at[:-1], at[1:])] for x in (code, n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(piece.first, len(piece)), pa.array(raw[0], pa.binary()), pa.array(raw[1], pa.binary())], ["lang", "codes", "counts"])

    rows = rows.select("text", "lang").mapInArrow(made, "lang string, codes binary, counts binary").collect()
    rows.sort(key=lambda r: (r["lang"], zlib.decompress(r["codes"])))
    small = lambda raw: np.frombuffer(zlib.decompress(raw), np.int32)
    out = []
    for k, (lang, codes, counts) in enumerate(rows):
        n = small(counts)
        out.append((lang, small(codes).astype(np.uint16), n.astype(np.min_scalar_type(n.max(initial=0)))))
        rows[k] = None
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log((p + 1e-9) / (1 - p + 1e-9))


def _cut(x: np.ndarray) -> float:
    """What all but FALSE_REJECTIONS of ``x`` stay below; so small a share of few rows comes from a normal tail."""
    return float(max(np.quantile(x, 1 - FALSE_REJECTIONS, method="higher"), x.mean() + NormalDist().inv_cdf(1 - FALSE_REJECTIONS) * x.std()))


def train(labelled: DataFrame, per_language: int = 600, epochs: int = 6, rate: float = 0.5, seed: int = 7, most_rows: int = 1 << 16) -> Model | None:
    """A model of ``labelled`` (doc_id, text, lang), from about ``per_language`` rows of each language, and about ``most_rows`` in all.

    The rows are those with the least hashes of doc_id and text, so rows with
    a null doc_id and rows that repeat one are drawn like others; rows alike
    in all three columns teach once.  The driver receives their subword
    counts, no texts.  Rows without a language or a letter teach nothing;
    without any others there is no model.  Of equally likely languages the
    first by name is predicted.
    """
    ready(labelled.sparkSession)
    labelled = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = saved(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = min(per_language, max(1, most_rows // max(1, counts.count())))
    least = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) * F.col("n") < F.lit(each << 20)
    picked = labelled.join(small_side(counts), "lang").filter(least).select("doc_id", "text", "lang").distinct()
    rows = [r for r in _sampled(picked) if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist()) if len(rows) >= 20 else set()
    y = np.array([langs.index(r[0]) for r in rows])
    share = [(r[2] / r[2].sum()).astype(np.float32) for r in rows]
    embed = (random.standard_normal((1 << BITS, DIM)) * 0.1).astype(np.float32)
    weight, bias = (random.standard_normal((DIM, len(langs))) * 0.1).astype(np.float32), np.zeros(len(langs), np.float32)
    learn = np.array([i for i in range(len(rows)) if i not in held])
    for epoch in range(epochs):
        for i in random.permutation(learn):
            step = np.float32(rate * (1 - epoch / epochs))
            own = embed[rows[i][1]]
            x = share[i] @ own
            g = x @ weight + bias
            g = np.exp(g - g.max())
            g /= g.sum()
            g[y[i]] -= 1
            # The average spreads a row's gradient thinly: its subwords get it scaled up.
            embed[rows[i][1]] -= step * np.minimum(share[i] * 50, 1)[:, None] * (weight @ g)
            weight -= step * np.outer(x, g)
            bias -= step * g
    logits = np.stack([share[i] @ embed[rows[i][1]] @ weight + bias for i in range(len(rows))])
    test = np.array(sorted(held)) if held else np.arange(len(rows))
    grid = np.geomspace(0.5, 20, 40)
    warm = grid[np.argmin([-np.log(softmax(logits[test] / t)[np.arange(len(test)), y[test]] + 1e-12).mean() for t in grid])]
    sure = softmax(logits[test] / warm).max(axis=1)
    seen = np.bincount(np.concatenate([rows[i][1] for i in learn]), np.concatenate([rows[i][2] for i in learn]), 1 << BITS) + 0.1
    likely = np.log(seen / seen.sum())
    n = np.array([rows[i][2].sum() for i in test], float)
    logit = _logit(sure)
    off = (logit - logit.mean()) ** 2
    sureness = (float(logit.mean()), float(max(off.mean() / 2, 0.05**2)), float((off * n).mean() / 2))
    sureness += (_cut(strangeness(logit, n, *sureness)),)
    mean = np.array([share[i] @ likely[rows[i][1]] for i in test])
    squares = np.array([share[i] @ (likely[rows[i][1]] - m) ** 2 for i, m in zip(test, mean)])
    middle, within = float(np.average(mean, weights=n)), float(squares.mean())
    between = float(max(np.mean((mean - middle) ** 2 - within / n), 0.05**2))
    far = _cut(strangeness(mean, n, middle, between, within))
    table = np.vstack([(embed @ weight / warm).T, likely])
    return Model(langs, table.astype(np.float32), bias / warm, sureness, (middle, between, within, far))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of ``docs`` (doc_id, text).

    A null text and one without any letter are ``und`` with score 0 and
    rejected.  Any other text gets its likeliest language and the calibrated
    probability of it, and is rejected if that or its subwords are too strange
    for its length.
    Without a model all are ``und`` and rejected.  Whole texts count, however
    long; other columns are ignored; an empty table gives no rows.
    """
    ready(docs.sparkSession)

    def made(batches):
        for batch in batches:
            for piece in slices(batch.column(1)):
                if model is None:
                    name, sure, out = ["und"] * len(piece), np.zeros(len(piece)), np.ones(len(piece), bool)
                else:
                    p, out = model.judged(piece)
                    best = p.argmax(axis=1)
                    name, sure = [model.langs[i] for i in best], np.clip(p[np.arange(len(p)), best], 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), batch.column(2).slice(piece.first, len(piece)), pa.array(name, pa.string()), pa.array(sure, pa.float64()), pa.array(out)], ["doc_id", "some", "lang_pred", "score", "strange"])

    some = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("some")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", some).mapInArrow(made, "doc_id long, some boolean, lang_pred string, score double, strange boolean")
    known = F.col("some") & (F.col("lang_pred") != "und")
    return rows.select("doc_id", F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"), (~known | F.col("strange")).alias("rejected"))


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is ``fold``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def accept(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that language identification rejects; columns unchanged.

    It learns from the non-null ``lang`` of ``docs`` itself.  Rows with a null
    doc_id are judged by their text as all others.  A null text, or one without
    any letter, goes.
    """
    model = train(docs.select("doc_id", "text", "lang"))
    ready(docs.sparkSession)

    def made(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep = [np.zeros(0, bool)]
            for piece in slices(batch.column(at)):
                keep.append(~model.judged(piece)[1] if model else np.zeros(len(piece), bool))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(made, docs.schema)
