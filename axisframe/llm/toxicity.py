"""Toxicity by class-conditional Kneser-Ney models of words.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary
documents, give each word of a text two log-likelihoods.  A class's pair counts
back off to the pair counts of both classes, these to the class's continuation
counts (how many different words a word follows in the class), and these to the
continuation counts of both classes, spread as the class has words that begin
alike (by their first STEM_BYTES bytes), so that words that neither class has
seen still tell something.  Without the pair counts of both classes nearly every
pair that only one class has seen would outweigh what the words themselves say.  The differences, normalised by length over the whole text,
its clearly toxic words and its most toxic stretches, are turned into a probability by a logistic
function that is fitted on labelled documents which the counts don't include.

Counts cover every labelled training document but the calibrating sample, are
exact, and grow with the corpus.  As is usual for such models they are pruned:
pairs of fewer than LEAST_DOCS documents, or whose classes are split as all
pairs are, have no entry of their own and back off, in both models, whose
probabilities still sum to 1.  Continuation counts include all pairs.  The
discount is that of Ney's estimate, n1 / (n1 + 2 n2), of the pairs that one and
that two documents have.  The result is a table of log-likelihood ratios: of
words by their continuation counts, or of their beginnings where the words are
new, of contexts by their back-off weights, and of pairs by the rest.  No ratio
is rounded or left out, so that a word's terms add up to the difference of the
two models' log-probabilities.

A table of at most TABLE_ROWS rows is broadcast to the scan of the documents.
From a larger one they ask for the terms of their words and pairs by a join: a
Bloom filter keeps pairs without an entry in the scan, and each part of the documents
asks once for each, so that neither a common word nor a common pair makes a
large group.
Words are runs of letters, A-Z lower-cased.  They are told apart by 64-bit
hashes, whose upper halves tell beginnings of words apart.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bloom, fraction_filter, may_contain, ready, saved, small_side
from .textbytes import mix, slices

#: Kneser-Ney's absolute discount where too few pairs are counted to estimate it, and how many occurrences of each type, of both classes together, the level below a class's own counts weighs.
DISCOUNT, SHARED_COUNT = 0.75, 20
#: Documents that a pair needs for an entry, and the least log ratio between its split into classes and the split of all pairs.
LEAST_DOCS, LEAST_SPLIT = 2, 0.25
#: Bytes of a word's beginning.
STEM_BYTES = 6
#: Lengths in words of the stretches of which the most toxic one counts.
STRETCHES = (1, 3)
#: What a word's log-likelihood ratio must exceed to count by its excess.
EXCESS = 2.0
#: Labels that may be broadcast to the scan of the documents; more are joined by a shuffle.
LABEL_ROWS = 4_000_000
#: Rows of the table of terms, of 17 bytes each, that may be broadcast.
TABLE_ROWS = 4_000_000
#: Bytes of text whose words are counted or ask together, and bytes of text for each bucket of keys.
PART_BYTES, BUCKET_BYTES = 3 << 20, 1 << 23

_PAIR = np.uint64(0xA0761D6478BD642F)
_HALF = np.uint64(32)


@dataclass
class Part:
    """The words of some consecutive documents: rows ``first`` to ``first + len - 1`` of a batch."""

    first: int
    of: np.ndarray  # where each document's words begin, and the end of the last
    before: np.ndarray  # the hash of the word before each word, 0 at a document's start
    word: np.ndarray  # the word's hash

    def __len__(self) -> int:
        return len(self.of) - 1


def _parts(column: pa.Array):
    """Parts of about PART_BYTES of text, whose words are hashed slice by slice."""
    held, size = [], 0

    def whole():
        n, before, word = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
        return Part(held[0][0], np.concatenate(([0], np.cumsum(n))), before, word)

    for piece in slices(column):
        piece.find_words(letters=True)
        h = (piece.word_hashes(lower=True, most=STEM_BYTES) >> _HALF << _HALF) | (piece.word_hashes(lower=True) >> _HALF)
        before = np.zeros_like(h)
        before[1:] = h[:-1]
        before[piece.of[:-1][np.diff(piece.of) > 0]] = 0
        held.append((piece.first, np.diff(piece.of), before, h))
        size += len(piece.data)
        if size >= PART_BYTES:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before ^ _PAIR) + word)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the keys by bucket, and (bucket, start, end) of each bucket's run in it."""
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
    return order, [(int(bucket[order[i]]), int(i), int(j)) for i, j in zip(at[:-1], at[1:])]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, byte by byte of their differences, so that what they have in common takes little room."""
    out = [np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes()]
    for a in arrays:
        a = a.astype(np.uint64)
        rising = len(a) > 1 and bool(np.all(a[1:] >= a[:-1]))
        out.append(bytes([rising]))
        out.append(np.ascontiguousarray((np.diff(a, prepend=np.uint64(0)) if rising else a).view(np.uint8).reshape(-1, 8).T).tobytes())
    return zlib.compress(b"".join(out), 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(data)
    n = np.frombuffer(raw, np.int64, 1)[0]
    at, out = 8 * (1 + int(n)), []
    for size in np.frombuffer(raw, np.int64, n, 8).tolist():
        planes = np.frombuffer(raw, np.uint8, 8 * size, at + 1).reshape(8, size)
        a = np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)
        out.append(np.cumsum(a, dtype=np.uint64) if raw[at] else a)
        at += 1 + 8 * size
    return out


def _added(code: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(code, n, size).astype(np.int64)


def counts(rows: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved counts of all ``rows`` (text, label): of pairs (before, word, ordinary, toxic), words (word, ordinary, toxic, types) and stems (stem, ordinary, toxic).

    A pair counts once a document, so that one document's refrain is no
    evidence; pairs of fewer than LEAST_DOCS documents are left out.  A word's
    counts are those of the different words before it, in all pairs: in
    ordinary, in toxic and in any documents.  A stem counts once for each of a
    document's different pairs whose second word begins with it.
    """

    def made(batches):
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for part in _parts(batch.column(0)):
                key, first, code = np.unique(_pair_keys(part.before, part.word), return_index=True, return_inverse=True)
                once = np.unique(np.repeat(np.arange(len(part)), np.diff(part.of)) << 32 | code)
                toxic = label[part.first + (once >> 32)]
                n = [np.bincount((once & 0xFFFFFFFF)[toxic == bool(c)], minlength=len(key)) for c in (0, 1)]
                before, word = part.before[first], part.word[first]
                order, runs = _dealt(key, buckets)
                sent = []
                for bucket, i, j in runs:
                    own = order[i:j][np.argsort(before[order[i:j]], kind="stable")]
                    befores, a = np.unique(before[own], return_inverse=True)
                    words, b = np.unique(word[own], return_inverse=True)
                    sent.append((bucket, True, _packed(befores, a, words, b, n[0][own], n[1][own])))
                stems, code = np.unique(word >> _HALF, return_inverse=True)
                n = [_added(code, x, len(stems)) for x in n]
                order, runs = _dealt(stems << _HALF, buckets)
                sent += [(bucket, False, _packed(stems[own := order[i:j]], n[0][own], n[1][own])) for bucket, i, j in runs]
                yield pa.RecordBatch.from_pydict({"bucket": [x[0] for x in sent], "paired": [x[1] for x in sent], "data": [x[2] for x in sent]}, pa.schema([("bucket", pa.int32()), ("paired", pa.bool_()), ("data", pa.binary())]))

    def merged(table: pa.Table) -> pa.Table:
        paired, data = table["paired"].to_pylist(), [_unpacked(x.as_py()) for x in table["data"]]
        parts = [p for p, x in zip(data, paired) if x] or [[np.zeros(0, np.uint64)] * 6]
        before, word = (np.concatenate([p[k][p[k + 1].astype(np.int64)] for p in parts]) for k in (0, 2))
        key, first, code = np.unique(_pair_keys(before, word), return_index=True, return_inverse=True)
        n = [_added(code, np.concatenate([p[k] for p in parts]), len(key)) for k in (4, 5)]
        before, word = before[first], word[first]
        words, code = np.unique(word, return_inverse=True)
        types = [_added(code, x, len(words)) for x in (n[0] > 0, n[1] > 0, np.ones(len(key)))]
        order, runs = _dealt(words, buckets)
        keep = n[0] + n[1] >= LEAST_DOCS
        out = pa.table({c: x[keep].astype(np.int64) for c, x in zip(("before", "word", "ordinary", "toxic"), (before, word, *n))})
        stems = _totals([p for p, x in zip(data, paired) if not x], ("stem", "ordinary", "toxic"))
        sent = [(b, _packed(words[own := order[i:j]], *(t[own] for t in types))) for b, i, j in runs]
        sent = pa.table({"bucket": pa.array([x[0] for x in sent], pa.int32()), "data": pa.array([x[1] for x in sent], pa.binary())})
        return pa.concat_tables([out, stems, sent], promote_options="default").select(names)

    names = ["before", "word", "stem", "ordinary", "toxic", "bucket", "data"]
    schema = "before long, word long, stem long, ordinary long, toxic long, bucket int, data binary"
    columns = ("word", "ordinary", "toxic", "types")
    parts = saved(rows.select("text", "label").mapInArrow(made, "bucket int, paired boolean, data binary").groupBy("bucket").applyInArrow(merged, schema), "counts")
    words = parts.filter("data is not null").select("bucket", "data").groupBy("bucket").applyInArrow(lambda t: _totals([_unpacked(x.as_py()) for x in t["data"]], columns), ", ".join(f"{c} long" for c in columns))
    return parts.filter("before is not null").select("before", "word", "ordinary", "toxic"), words, parts.filter("stem is not null").select("stem", "ordinary", "toxic")


def _totals(parts: list, columns: tuple) -> pa.Table:
    """The sums of counts by key."""
    parts = parts or [[np.zeros(0, np.uint64)] * len(columns)]
    key, code = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return pa.table({columns[0]: key.view(np.int64)} | {c: _added(code, np.concatenate([p[k] for p in parts]), len(key)) for k, c in enumerate(columns) if k})


@dataclass
class Totals:
    """Different pairs and words in all; by class: different pairs and words, counts of stems, and the sum of all words' masses; the discount."""

    pairs: int
    words: int
    class_pairs: tuple
    class_words: tuple
    class_stems: tuple
    mass: tuple = (1.0, 1.0)
    discount: float = DISCOUNT

    def less(self, n: np.ndarray) -> np.ndarray:
        return np.maximum(n - self.discount, 0)


def discount(once: int, twice: int) -> float:
    """Ney's estimate from how many pairs are counted once and twice."""
    return once / (once + 2 * twice) if once and twice else DISCOUNT


def _share(n: tuple, c: int) -> float:
    return n[c] / max(sum(n), 1)


def word_masses(totals: Totals, predecessors, stems, all_predecessors) -> list[np.ndarray]:
    """What each class's continuation counts give a word, before they are divided by their sum."""
    shared = (totals.less(all_predecessors) + totals.discount * totals.words / (totals.words + 1)) / max(totals.pairs, 1)
    out = []
    for c in (0, 1):
        of_class, of_stems = _share(totals.class_pairs, c), _share(totals.class_stems, c)
        like = (totals.less(stems[c]) + SHARED_COUNT * of_stems) / ((stems[0] + stems[1] + SHARED_COUNT) * of_stems) if of_stems else np.ones(np.shape(all_predecessors))
        # In proportion to the class's size, so that neither class's rare types stand out.
        out.append(totals.less(predecessors[c]) + (totals.discount * totals.class_words[c] * shared + (SHARED_COUNT * of_class if sum(totals.class_pairs) else 1)) * like)
    return out if all(totals.class_pairs) else [np.ones(np.shape(all_predecessors))] * 2


def log_probabilities(totals: Totals, pair, context, followers, predecessors, stems, all_followers, all_predecessors) -> tuple[np.ndarray, np.ndarray]:
    """log P(word | word before, class) by interpolated Kneser-Ney, ordinary and toxic.

    ``pair``, ``context``, ``followers``, ``predecessors`` and ``stems`` are
    counts by class; those of pairs and contexts come from the pairs that have
    an entry, the others from all.  Over the known words and one for all
    unknown ones each distribution sums to 1.  What a class has never seen it
    leaves to the distribution below.
    """
    out = []
    for c, mass in enumerate(word_masses(totals, predecessors, stems, all_predecessors)):
        alone, all_n = mass / totals.mass[c], context[0] + context[1]
        both = np.where(all_n > 0, (totals.less(pair[0] + pair[1]) + totals.discount * all_followers * alone) / np.maximum(all_n, 1), alone)
        own = SHARED_COUNT * _share(totals.class_pairs, c) * all_followers
        out.append(np.log(np.where(own > 0, (totals.less(pair[c]) + (totals.discount * followers[c] + own) * both) / np.maximum(context[c] + own, 1e-300), both)))
    return out[0], out[1]


_STEM, _WORD, _PAIRED = 0, 1, 2


class Model:
    """A saved table of log-likelihood ratios, a Bloom filter of its pairs, and the ratio of an unknown word.

    The table has key, kind, term and context: words (``_WORD``) by their hash,
    with their term as a context, beginnings of words (``_STEM``) by theirs in
    the upper half, and pairs (``_PAIRED``) by their key.
    """

    def __init__(self, pairs: DataFrame, words: DataFrame, stems: DataFrame, buckets: int):
        self.buckets = buckets
        sides = lambda name: [f"{name}_ordinary", f"{name}_toxic"]
        stems = stems.toDF("stem", *sides("stems"))
        words = saved(words.toDF("word", *sides("predecessors"), "all_predecessors").join(stems.withColumnRenamed("stem", "_stem"), F.shiftrightunsigned("word", 32) == F.col("_stem")).drop("_stem"), "words")
        total = lambda *names: [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
        r = words.agg(F.count(F.lit(1)).alias("n"), *total("all_predecessors", *sides("predecessors")), *(F.count(F.when(F.col(c) > 0, 1)).alias(f"n_{c}") for c in sides("predecessors"))).first()
        totals = Totals(r["all_predecessors"], r["n"], tuple(r[c] for c in sides("predecessors")), tuple(r[f"n_{c}"] for c in sides("predecessors")), tuple(stems.agg(*total(*sides("stems"))).first()))
        n = F.col("ordinary") + F.col("toxic")
        entries, once, twice = pairs.agg(F.count(F.lit(1)), F.count(F.when(n == 1, 1)), F.count(F.when(n == 2, 1))).first()
        # Pairs that have no entry are in one document.
        totals.discount = discount(totals.pairs - entries + once, twice)

        def mass(batches):
            for batch in batches:
                got = word_masses(totals, *_arguments(batch, "predecessors", "stems", "all_predecessors"))
                yield pa.RecordBatch.from_arrays([pa.array([x.sum()]) for x in got], ["ordinary", "toxic"])

        zero = np.zeros((2, 1))
        unknown = word_masses(totals, zero, zero, zero[0])
        known = words.mapInArrow(mass, "ordinary double, toxic double").agg(F.sum("ordinary"), F.sum("toxic")).first()
        totals.mass = tuple(float(u[0] + (k or 0)) for u, k in zip(unknown, known))
        ratio = lambda *counts: np.subtract(*log_probabilities(totals, *counts)[::-1])
        self.base = base = float(ratio(zero, zero, zero, zero, zero, zero[0], zero[0])[0])

        share = _share(totals.class_pairs, 1)
        few = F.lit(SHARED_COUNT * share)
        split = F.log((F.col("toxic") + few) / (n * share + few)) if share else F.lit(0.0)
        pairs = pairs.filter(F.abs(split) >= LEAST_SPLIT)
        by_class = [f.alias(f"{name}_{c}") for c in ("ordinary", "toxic") for name, f in (("context", F.sum(c)), ("followers", F.count(F.when(F.col(c) > 0, 1))))]
        contexts = pairs.groupBy("before").agg(*by_class, F.count(F.lit(1)).alias("all_followers"))
        full = pairs.toDF("before", "word", *sides("pair")).join(contexts, "before").join(words, "word")

        def terms(kind):
            def made(batches):
                for batch in batches:
                    pair, context, followers, predecessors, of_stem, all_followers, all_predecessors = counts = _arguments(batch, "pair", "context", "followers", "predecessors", "stems", "all_followers", "all_predecessors")
                    none = np.zeros_like(pair)
                    term = ratio(none, none, none, predecessors, of_stem, none[0], all_predecessors) - base
                    before = ratio(none, context, followers, none, none, all_followers, none[0]) - base
                    if kind == _STEM:
                        key = _column(batch, "stem") << _HALF
                    elif kind == _WORD:
                        key = _column(batch, "word")
                    else:
                        key, term = _pair_keys(_column(batch, "before"), _column(batch, "word")), ratio(*counts) - base - term - before
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), kind, np.int8)), *(pa.array(x.astype(np.float32)) for x in (term, before))], ["key", "kind", "term", "context"])

            return made

        # The start of a document is a context, but no word.
        contexts = words.join(contexts.withColumnRenamed("before", "word"), "word", "full").na.fill(0)
        parts = [t.mapInArrow(terms(kind), "key long, kind byte, term float, context float") for kind, t in ((_STEM, stems), (_WORD, contexts), (_PAIRED, full))]
        self.table = saved(parts[0].union(parts[1]).union(parts[2]), "terms")
        self.known = self.bits = None
        if self.table.count() <= TABLE_ROWS:
            self.known = _known(self.table.toArrow())
        else:
            paired = self.table.filter(F.col("kind") == _PAIRED)
            self.bits = bloom(paired, "key", paired.count())


def _known(table: pa.Table) -> dict:
    """By kind: keys in rising order and their terms (term, context), both with one more row at the end, of zeros."""
    kind, own = table["kind"].to_numpy(), table["key"].to_numpy().view(np.uint64)
    terms = np.stack([table[c].to_numpy() for c in ("term", "context")], axis=1)
    known = {}
    for k in (_STEM, _WORD, _PAIRED):
        of = np.flatnonzero(kind == k)
        of = of[np.argsort(own[of])]
        known[k] = np.append(own[of], np.uint64((1 << 64) - 1)), np.concatenate((terms[of], np.zeros((1, 2), np.float32)))
    return known


def _found(known: dict, kind: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, known or not) of keys."""
    keys, values = known[kind]
    at = np.searchsorted(keys, key)
    there = (keys[at] == key)[:, None]
    return np.where(there, values[at], np.float32(0)), there


def _of_words(known: dict, words: np.ndarray) -> np.ndarray:
    """(term, context) of words; new ones have the term of their beginning."""
    term, there = _found(known, _WORD, words)
    return np.where(there, term, _found(known, _STEM, words >> _HALF << _HALF)[0] * np.array([1, 0], np.float32))


def _ratios(base: float, of: np.ndarray, term: np.ndarray, code: np.ndarray, pos: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Each word's log-likelihood ratio, from its terms as a word, those of the word before, and the rest of the pairs at ``pos``; the last of ``code`` is the start of a document."""
    start, code = code[-1], code[:-1]
    previous = np.append(start, code[:-1])[: len(code)]
    previous[of[:-1][np.diff(of) > 0]] = start
    ratio = base + term[code, 0].astype(np.float64) + term[previous, 1]
    ratio[pos] += rest
    return ratio


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def _arguments(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns as arrays, those that there are by class as pairs; zeros for what isn't there."""
    get = lambda name: batch.column(name).to_numpy(zero_copy_only=False) if name in batch.schema.names else np.zeros(batch.num_rows, np.int64)
    return [get(name) if name.startswith("all_") else np.stack([get(f"{name}_ordinary"), get(f"{name}_toxic")]) for name in names]


#: Features of a document.
WIDTH = 4 + len(STRETCHES)


def _features(of: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """For each document: its log-likelihood ratio and its words' excess over EXCESS, both divided by its length and by the root of it, and the highest mean ratio over each kind of stretch."""
    n = np.diff(of)
    doc = np.repeat(np.arange(len(n)), n)
    total = np.concatenate(([0.0], np.cumsum(ratio, dtype=np.float64)))
    out = []
    for x in (total[of[1:]] - total[of[:-1]], np.bincount(doc, np.maximum(ratio - EXCESS, 0), len(n))):
        out += [x / np.maximum(n, 1), x / np.sqrt(np.maximum(n, 1))]
    start = np.arange(len(ratio))
    for width in STRETCHES:
        end = np.minimum(start + width, of[1:][doc])
        # A stretch that the text's end cuts short counts as if it were full.
        best = np.full(len(n), -np.inf)
        np.maximum.at(best, doc, (total[end] - total[start]) / width)
        out.append(np.where(n > 0, best, 0))
    return np.stack(out, axis=1)


def features(rows: DataFrame, model: Model, calibration: Calibration | None = None) -> DataFrame:
    """``rows`` with their features ``x`` (doubles as binary) in place of ``text``; with a calibration, with score and predicted.

    Without a broadcast each part of the documents sends its different words,
    and its different pairs that may have an entry, to the buckets of the
    table, and where they stand along with them; a second shuffle by part
    brings both together.  Words are dealt by their beginning, so that a new
    word meets what is known of that.
    """
    buckets, base = model.buckets, model.base
    new = (("x", T.BinaryType()),) if calibration is None else (("score", T.DoubleType()), ("predicted", T.IntegerType()))
    schema = T.StructType([*rows.drop("text").schema.fields, *(T.StructField(*c) for c in new)])

    def made(others, x: np.ndarray):
        if calibration is None:
            return others.append_column("x", pa.array([row.tobytes() for row in x], pa.binary()))
        p = calibration.scores(x)
        return others.append_column("score", pa.array(p)).append_column("predicted", pa.array((p >= 0.5).astype(np.int32)))

    if model.known is not None:
        known = rows.sparkSession.sparkContext.broadcast(model.known)

        def scored(batches):
            for batch in batches:
                others = pa.Table.from_batches([batch]).drop_columns("text")
                for part in _parts(batch.column(batch.schema.get_field_index("text"))):
                    words, code = np.unique(np.append(part.word, np.uint64(0)), return_inverse=True)
                    rest = _found(known.value, _PAIRED, _pair_keys(part.before, part.word))[0][:, 0]
                    x = _features(part.of, _ratios(base, part.of, _of_words(known.value, words), code, slice(None), rest))
                    yield from made(others.slice(part.first, len(part)), x).to_batches()

        return rows.mapInArrow(scored, schema)

    bits = rows.sparkSession.sparkContext.broadcast(model.bits)
    sending = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("place", pa.int32()), ("data", pa.binary())])

    def asked(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = batch.schema.get_field_index("text")
            others = batch.select([k for k in batch.schema.names if k != "text"])
            for part in _parts(batch.column(at)):
                # The last one is the start of a document.
                words, code = np.unique(np.append(part.word, np.uint64(0)), return_inverse=True)
                pair = _pair_keys(part.before, part.word)
                pos = np.flatnonzero(may_contain(bits.value, pair))
                pairs, which = np.unique(pair[pos], return_inverse=True)
                sent, places = [], []
                for k, key in enumerate((words, pairs)):
                    order, runs = _dealt(key, buckets)
                    place = np.empty(len(order), np.int64)
                    place[order] = np.arange(len(order))
                    places.append(place)
                    # In order of keys within a bucket.
                    sent += [(b, k * buckets + b, _packed(key[order[i:j]])) for b, i, j in runs]
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, others.schema) as out:
                    out.write_batch(others.slice(part.first, len(part)))
                layout = _packed(part.of, places[0][code], pos, places[1][which])
                sent.append((number % buckets, -1, len(layout).to_bytes(8, "little") + layout + zlib.compress(sink.getvalue().to_pybytes(), 1)))
                yield pa.RecordBatch.from_pydict({"bucket": [x[0] for x in sent], "part": [number] * len(sent), "place": [x[1] for x in sent], "data": [x[2] for x in sent]}, sending)
                number += 1

    def answered(asks: pa.Table, table: pa.Table) -> pa.Table:
        known, data = _known(table), []
        for place, raw in zip(asks["place"].to_pylist(), asks["data"]):
            raw = raw.as_py()
            if place >= 0:
                (key,) = _unpacked(raw)
                raw = (_found(known, _PAIRED, key)[0][:, 0] if place >= buckets else _of_words(known, key)).tobytes()
            data.append(raw)
        return pa.table({"part": asks["part"], "place": asks["place"], "data": pa.array(data, pa.binary())})

    def together(got: pa.Table) -> pa.Table:
        rows = sorted(zip(got["place"].to_pylist(), got["data"].to_pylist()))
        raw = rows[0][1]
        size = int.from_bytes(raw[:8], "little")
        of, code, pos, which = (a.astype(np.int64) for a in _unpacked(raw[8 : 8 + size]))
        term, rest = (np.frombuffer(b"".join(r[1] for r in rows[1:] if (r[0] >= buckets) == paired), np.float32) for paired in (False, True))
        if rows[0][0] != -1 or len(term) != 2 * (code.max() + 1) or len(rest) != (which.max() + 1 if len(which) else 0):
            raise RuntimeError("a part of the documents lacks answers")
        x = _features(of, _ratios(base, of, term.reshape(-1, 2), code, pos, rest[which]))
        others = pa.ipc.open_stream(zlib.decompress(raw[8 + size :])).read_all()
        return made(others, x)

    asks = rows.mapInArrow(asked, "bucket int, part long, place int, data binary")
    bucket = F.pmod(F.shiftrightunsigned("key", 32), F.lit(buckets)).cast("int").alias("bucket")
    answers = asks.groupBy("bucket").cogroup(model.table.select(bucket, "key", "kind", "term", "context").groupBy("bucket")).applyInArrow(answered, "part long, place int, data binary")
    return answers.groupBy("part").applyInArrow(together, schema)


class Calibration:
    """A logistic function of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1e-2):
        self.middle, self.scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
        self.weights = np.zeros(WIDTH + 1)
        if not 0 < y.sum() < len(y):
            share = (y.sum() + 0.5) / (len(y) + 1)
            self.weights[-1] = np.log(share / (1 - share))
            return
        z = self._design(x)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            grad = z.T @ (p - y) + l2 * self.weights
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + l2 * np.eye(len(grad)), grad)
            self.weights -= step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.middle) / self.scale, np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, counted, calibrating, most: int = 20_000) -> tuple[Model, Calibration]:
    """Counts from all of ``labels`` (doc_id, toxic) that ``counted`` allows, calibrated on about ``most`` of those that ``calibrating`` allows.

    The calibrating rows themselves aren't counted, even if ``counted`` allows
    them.  Null labels and doc_ids teach nothing.  Without labels the score is
    0.5, with one kind of label near its share of the calibrating rows.
    """
    ready(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    text = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    sampled = calibrating & fraction_filter("doc_id", most / max(known.filter(calibrating).count(), 1))
    size = text.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    buckets = max(12, size // BUCKET_BYTES)
    model = Model(*counts(text.join(small_side(known.filter(counted & ~sampled), LABEL_ROWS), "doc_id"), buckets), buckets)
    rows = features(text.join(F.broadcast(known.filter(sampled)), "doc_id"), model).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float64).reshape(-1, WIDTH)
    return model, Calibration(x, np.array([r["label"] > 0 for r in rows], float))


def score(docs: DataFrame, model: Model, calibration: Calibration) -> DataFrame:
    """doc_id, score (of toxicity) and predicted for every row of ``docs`` (doc_id, text).

    Whole texts count.  Null and empty texts have no words and score by the
    calibration at zero features.  Other columns are ignored; an empty table
    gives no rows.
    """
    ready(docs.sparkSession)
    return features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, calibration)
