"""Scoring texts by a unigram model over the lattice of their subwords.

Pieces and their scores come from an existing vocabulary.  Its scores are ranks,
so Zipf's law makes them probabilities: those of pieces that begin a word, and
those of pieces that go on in it or end it.  A word's marginal probability is
the sum over all ways to cut it into pieces, by a forward recursion in log
space; single bytes are pieces too, so every word has one.  Expectation
maximisation fits the pieces to the corpus' words, with the existing scores as
the prior; each word counts once, as in continuation counts.

Words that the corpus has are arcs over their whole length: such an arc has the
word's discounted share of all tokens, and the mass that discounting frees goes
to the pieces.  So a text's score is the log10 of a probability, and what the
model holds grows with the corpus.

Texts are read twice.  The first reading counts words.  The second sums up the
frequent ones (at most HOT, as only words with one in HOT of all tokens are) and
leaves the others to a join with the table of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ready, saved, summed_arrays
from .textbytes import _BYTE_CODE, LOWER, Slice, _byte_powers, mix, slices, texts

#: Words that may be frequent, and their longest.
HOT, HOT_BYTES = 1 << 17, 64
#: Bytes of words that are cut at a time; longer words are cut in runs of this length.
RUN = 1 << 14
#: Passes of expectation maximisation, the prior's weight in words, and the prior of a word's end.
PASSES, PRIOR, PRIOR_END = 2, 2000.0, 0.4
NONE = -np.inf


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _byte_powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


class Pieces:
    """Subwords as byte strings, a blank before those that begin a word, and their log probabilities."""

    def __init__(self, ranks: dict[bytes, int]):
        names = sorted(ranks)
        data = np.frombuffer(b"".join(names), np.uint8)
        end = np.cumsum([len(n) for n in names])
        keys = _hashes(data, end - [len(n) for n in names], end)
        order = np.argsort(keys)
        self.keys, self.longest = keys[order], max(map(len, names))
        self.first = np.array([names[k][0] == 32 for k in order])
        zipf = 1 / (np.array([ranks[names[k]] for k in order]) + 1.5)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.prior = np.append(zipf, 0.0)
        for own in (np.append(self.first, False), np.append(~self.first, False)):
            self.prior[own] /= self.prior[own].sum()
        self.prior[:-1][~self.first] *= 1 - PRIOR_END
        self.prior[-1] = PRIOR_END
        self.fit(np.zeros(len(self.prior)))

    @staticmethod
    def read(path: str) -> Pieces:
        """The pieces of a sentencepiece file; where scores aren't negative they're no ranks, and the piece comes last."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n, ranks = model.vocab_size(), {bytes([b]): model.vocab_size() for b in range(256)}
        for k in range(n):
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
                name = model.id_to_piece(k).replace("▁", " ").encode()
                if name and b" " not in name[1:] and -n <= (score := model.get_score(k)) < 0:
                    ranks[name] = int(-score)
        for b in range(0x09, 0x0E):
            ranks.pop(bytes([b]), None)
        return Pieces(ranks)

    def fit(self, counts: np.ndarray) -> None:
        """Probabilities from expected counts and the prior; the last count is of word ends."""
        p = counts + PRIOR * self.prior
        rest = np.append(~self.first, True)
        p[rest] /= p[rest].sum()
        p[~rest] /= p[~rest].sum()
        self.log = np.log(np.maximum(p, 1e-300))

    def arcs(self, data: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """For each place ``at`` the piece of each length that ends there, -1 for none; ``reach`` bytes of its word lie before it."""
        up, down = _byte_powers.upto(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
        out = np.full((len(at), self.longest), -1, np.int32)
        for n in range(1, self.longest + 1):
            rows = np.flatnonzero(reach >= n)
            end = at[rows]
            key = mix((total[end] - total[end - n]) * down[end - n])
            some = self.filter[(key >> np.uint64(44)).astype(np.int64)]
            rows, key = rows[some], key[some]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            own = self.keys[k] == key
            out[rows[own], n - 1] = k[own]
        return out

    def weights(self, arcs: np.ndarray) -> np.ndarray:
        return np.append(self.log[:-1], NONE)[arcs]


def _sum(x: np.ndarray) -> np.ndarray:
    """log of sums of exponentials along the last axis."""
    top = np.maximum(x.max(axis=-1), -1e300)
    return top + np.log(np.maximum(np.exp(x - top[..., None]).sum(axis=-1), 1e-300))


def _forward(weights: np.ndarray, before: np.ndarray) -> np.ndarray:
    """(words, places, lengths) and the log probabilities of the ``longest`` places before, to those of all places."""
    n, m, longest = weights.shape
    alpha = np.full((n, longest + m), NONE)
    alpha[:, :longest] = before
    for p in range(m):
        alpha[:, longest + p] = _sum(alpha[:, p : p + longest][:, ::-1] + weights[:, p])
    return alpha


def _with_blanks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with a blank before each, and where each begins, and the end of the last."""
    data, offs = texts(column)
    size = np.diff(offs)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(begin[-1], 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[begin[:-1]] = False
    out[keep] = data[offs[0] : offs[-1]]
    return out, begin


def _buckets(begin: np.ndarray) -> list[np.ndarray]:
    """Words of equal lengths, RUN bytes at most at a time or one word."""
    size, out = np.diff(begin), []
    order = np.argsort(size, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
        step = max(1, RUN // int(size[group[0]]))
        out += [group[k : k + step] for k in range(0, len(group), step)]
    return out


def word_log(pieces: Pieces, column: pa.Array) -> np.ndarray:
    """The natural log of each word's marginal probability, its end included."""
    data, begin = _with_blanks(column)
    out, longest = np.zeros(len(begin) - 1), pieces.longest
    for words in _buckets(begin):
        m = int(begin[words[0] + 1] - begin[words[0]])
        before = np.full((len(words), longest), NONE)
        before[:, -1] = 0.0
        for p in range(0, m, RUN):  # only a word of its own is longer than a run
            n = min(RUN, m - p)
            lo = max(0, p - longest)
            own = data[(begin[words][:, None] + np.arange(lo, p + n)).reshape(-1)]
            at = (np.arange(len(words))[:, None] * (p + n - lo) + (p - lo) + np.arange(1, n + 1)).reshape(-1)
            reach = np.tile(np.arange(p + 1, p + n + 1), len(words))
            weights = pieces.weights(pieces.arcs(own, at, np.minimum(reach, longest))).reshape(len(words), n, longest)
            before = _forward(weights, before)[:, -longest:]
        out[words] = before[:, -1] + pieces.log[-1]
    return out


def expected(pieces: Pieces, column: pa.Array) -> np.ndarray:
    """How often each piece, and a word's end, is expected in the words, by forward and backward recursion.

    Words of more than RUN bytes count in runs of that length.
    """
    data, begin = _with_blanks(column)
    cuts = np.unique(np.concatenate([begin, *(np.arange(a, b, RUN) for a, b in zip(begin[:-1], begin[1:]) if b - a > RUN)]))
    out, longest = np.zeros(len(pieces.prior)), pieces.longest
    out[-1] = len(begin) - 1
    for words in _buckets(cuts):
        m, n = int(cuts[words[0] + 1] - cuts[words[0]]), len(words)
        own = data[(cuts[words][:, None] + np.arange(m)).reshape(-1)]
        at = (np.arange(n)[:, None] * m + np.arange(1, m + 1)).reshape(-1)
        arcs = pieces.arcs(own, at, np.minimum(np.tile(np.arange(1, m + 1), n), longest))
        weights = pieces.weights(arcs).reshape(n, m, longest)
        before = np.full((n, longest), NONE)
        before[:, -1] = 0.0
        alpha = _forward(weights, before)
        beta = np.full((n, m + 1), NONE)
        beta[:, m] = 0.0
        for p in range(m - 1, -1, -1):
            k = np.arange(1, min(longest, m - p) + 1)
            beta[:, p] = _sum(beta[:, p + k] + weights[:, p + k - 1, k - 1])
        for k in range(1, min(longest, m) + 1):
            # an arc of k bytes to the place p comes from the place p - k
            share = alpha[:, longest - 1 : longest + m - k] + weights[:, k - 1 :, k - 1] + beta[:, k:] - alpha[:, -1:]
            ids = arcs.reshape(n, m, longest)[:, k - 1 :, k - 1]
            some = ids >= 0
            out[:-1] += np.bincount(ids[some], np.exp(share[some]), len(out) - 1)
    return out


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offs = np.concatenate(([0], np.cumsum(size)))
    own = data[np.repeat(start - offs[:-1], size) + np.arange(offs[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(own.tobytes())).cast(pa.string())


def word_counts(docs: DataFrame, held: Column) -> DataFrame:
    """word, c (how often documents that aren't held out have it) and n (how often all have it)."""

    def made(batches):
        for batch in batches:
            out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for piece in slices(batch.column(0), 1 << 20):
                piece.find_words()
                _, first, of = np.unique(piece.word_hashes(lower=True), return_index=True, return_inverse=True)
                learnt = ~out[piece.first + piece.doc_of_word()]
                word = _strings(LOWER[piece.data], piece.starts[first], piece.ends[first])
                yield pa.RecordBatch.from_arrays([word, pa.array(np.bincount(of[learnt], minlength=len(first))), pa.array(np.bincount(of, minlength=len(first)))], ["word", "c", "n"])

    rows = docs.select("text", held.alias("held")).mapInArrow(made, "word string, c long, n long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fitted(pieces: Pieces, words: DataFrame) -> Pieces:
    """Fits the pieces to the words that have been learnt from."""

    def made(batches):
        out = np.zeros(len(pieces.prior))
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                out += expected(pieces, batch.column(0).slice(k, 4096))
        return {"counts": out}

    learnt = words.filter("c > 0").select("word")
    for _ in range(PASSES):
        pieces.fit(summed_arrays(learnt, made, {"counts": (len(pieces.prior), float)})["counts"])
    return pieces


def _scored(words: DataFrame, pieces: Pieces, tokens: int, kinds: int, some: int, discount: float) -> DataFrame:
    """word, n, known, base and score (both log10) of each word."""
    whole = max(tokens, 1)
    free = discount * some / whole if tokens else 0.5
    from_base = np.log10(float(tokens + kinds + 1))

    def made(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                c = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                lattice = word_log(pieces, part.column(0)) + (np.log(free) if free > 0 else NONE)
                with np.errstate(divide="ignore"):
                    arc = np.log(np.maximum(c - discount, 0.0) / whole)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(c > 0), pa.array(np.log10(c + 1) - from_base), pa.array(np.logaddexp(lattice, arc) / np.log(10.0))], ["word", "n", "known", "base", "score"])

    return words.select("word", "c", "n").mapInArrow(made, "word string, n long, known boolean, base double, score double")


def score(docs: DataFrame, held: Column, vocabulary: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    A null or empty text, or one without words, is an end alone.  Words may have
    any length, and so may texts.  Rows with a null doc_id aren't held out; rows
    that repeat one are scored each by its own text, equal texts alike but for
    the order of sums.  Other columns are left out.  An empty table has no rows.
    Where nothing is learnt from, words have the prior's probabilities.
    """
    ready(docs.sparkSession)
    pieces = Pieces.read(vocabulary)
    words = saved(word_counts(docs, held), "words")
    known = F.col("c") > 0
    n, c, some, once, twice = (x or 0 for x in words.agg(F.sum("n"), F.sum("c"), F.count_if(known), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first())
    ends = docs.select(held.alias("held")).filter("not held").count()
    tokens, kinds = c + ends, some + (1 if ends else 0)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    scored = saved(_scored(words, fitted(pieces, words), tokens, kinds, some, discount), "scores")

    # Of words with at least one in HOT of all tokens there are no more than HOT.
    frequent = (F.col("n") >= max(2, -(-n // HOT))) & (F.octet_length("word") <= HOT_BYTES)
    hot = scored.filter(frequent).toArrow()
    data, offs = texts(hot["word"].combine_chunks())
    keys = _hashes(data, offs[:-1], offs[1:])
    order = np.argsort(keys)
    keys, table = keys[order], np.stack([hot[k].to_numpy().astype(float)[order] for k in ("known", "base", "score")]) if len(keys) else np.zeros((3, 0))
    end = np.array([float(ends > 0), np.log10((ends + 1) / (tokens + kinds + 1)), np.log10(ends / tokens if ends else 0.5 if not tokens else 1 / (tokens + 1))])

    def summed(batches):
        names = ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"]
        for batch in batches:
            for piece in slices(batch.column(0), 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(piece.first, len(piece)) for k in (1, 2)] + _summed(piece, keys, table, end), names)

    schema = "doc_id long, held_out boolean, n_tokens long, known double, base double, score double, rare array<string>"
    first = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out")).mapInArrow(summed, schema)
    first = saved(first.withColumn("id", F.monotonically_increasing_id()), "sums")
    rest = first.select("id", F.explode("rare").alias("word")).join(scored.filter(~frequent).select("word", F.col("known").cast("double").alias("known"), "base", "score"), "word")
    none = {"doc_id": F.lit(None).cast("long"), "held_out": F.lit(None).cast("boolean"), "n_tokens": F.lit(None).cast("long")}
    # The words' sums meet before they travel; the document's own row joins them.
    parts = rest.groupBy("id").agg(*(F.sum(k).alias(k) for k in ("known", "base", "score"))).withColumns(none)
    both = first.drop("rare").unionByName(parts).groupBy("id").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), *(F.sum(k).alias(k) for k in ("known", "base", "score")))
    return both.select("doc_id", "held_out", "n_tokens", F.round("known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _summed(piece: Slice, keys: np.ndarray, table: np.ndarray, end: np.ndarray) -> list:
    """Each document's tokens, its sums over frequent words and its end, and its other words."""
    piece.find_words()
    own = piece.word_hashes(lower=True)
    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
    found = keys[at] == own if len(keys) else np.zeros(len(own), bool)
    found &= piece.ends - piece.starts <= HOT_BYTES
    doc = piece.doc_of_word()
    sums = [pa.array(np.bincount(doc[found], row[at[found]], len(piece)) + e) for row, e in zip(table, end)]
    rest = np.flatnonzero(~found)
    words = _strings(LOWER[piece.data], piece.starts[rest], piece.ends[rest])
    offsets = np.searchsorted(doc[rest], np.arange(len(piece) + 1)).astype(np.int32)
    return [pa.array(np.diff(piece.of) + 1), *sums, pa.ListArray.from_arrays(pa.array(offsets), words)]
