"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``window`` consecutive words.  Every window names one of its
eight-word grams, the leftmost with the least hash, as its anchor; as this
follows from the window's words alone, equal windows of any two documents have
equal anchors.  Runs of neighbouring windows with one anchor make a block
(about 22 windows).  The reference is made of the first occurrences of all
blocks, and of all windows of blocks that share an anchor without being equal,
in the document with the smallest id; it is indexed by anchor and content.

A document is parsed from left to right into factors (source, place in the
source, length).  At the leftmost window that the reference has from a smaller
document, a factor starts there and greedily goes on as long as the source's
next windows are the document's next ones too, across whole blocks and, at
their edges, window by window.  A factor is thus a window long at least.  Its
first and last words are then compared, as text, with those of its source, and
its words become a duplicate span.

The result is exact: no window is sampled, whatever the number of copies.
Anchors, blocks and windows that very many documents share are spread over
several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bloom, may_contain, ready, saved, spread_join
from .textbytes import WordRuns, mix, slices

GRAM = 8
#: Words of the pieces in which sources are asked for a factor's ends.
PIECE = 64


def _blocks(piece, window: int):
    """(row, lo, n, anchor, block, runs): blocks of windows lo to lo + n - 1, as word numbers in the slice."""
    piece.find_words()
    words = piece.word_hashes()
    runs = WordRuns(words)
    gram = min(GRAM, window)
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, runs
    at = np.arange(len(words) - gram + 1)
    grams = runs.hashes(at, gram)
    bits = np.uint64(max(1, int(len(words)).bit_length()))
    # The least value of a window, and among equal ones the leftmost.
    least = ((grams >> bits) << bits) | at.astype(np.uint64)
    span, width = window - gram + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    start = np.arange(len(words) - window + 1)
    row = piece.doc_of_word()[start]
    whole = start + window <= piece.of[1:][row]
    start, row, anchor = start[whole], row[whole], (least[start[whole]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    lo = start[first]
    return row[first], lo, n, grams[anchor[first]].view(np.int64), runs.hashes(lo, n + window - 1).view(np.int64), runs


def _index(docs: DataFrame, window: int) -> DataFrame:
    def made(batches):
        for batch in batches:
            for piece in slices(batch.column(1)):
                row, lo, n, anchor, block, _ = _blocks(piece, window)
                at = pa.array(piece.first + row)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (0, *range(2, batch.num_columns))), pa.array(anchor), pa.array(block), pa.array((lo - piece.of[row]).astype(np.int32)), pa.array(n.astype(np.int32))], names)

    names = ["doc", *docs.columns[2:], "anchor", "block", "lo", "n"]
    return docs.mapInArrow(made, ", ".join(f"{c} {'int' if c in ('lo', 'n') else 'long'}" for c in names))


def _key(anchor: np.ndarray, block: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The long that stands for a block's first occurrences in the Bloom filter."""
    return mix(anchor.view(np.uint64) ^ mix(block.view(np.uint64) ^ mix(doc.view(np.uint64)))).view(np.int64)


def _longs(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in names]


def _matches(docs: DataFrame, window: int) -> DataFrame:
    """(doc, lo, n, source, at): the n windows of doc from word lo on are those of a smaller document, the source, from word at on.

    Columns of ``docs`` behind doc_id and text tell apart rows of one doc_id, and are carried along.
    """
    own = docs.columns[2:]
    index = saved(_index(docs, window), "blocks")
    of_anchor = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.min("block").alias("least"), F.max("block").alias("most"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    shared = saved(of_anchor.filter("m > 1 and first != last").select("anchor", (F.col("least") != F.col("most")).alias("differ")), "anchors")
    bits = bloom(shared, "anchor", shared.count())

    def passing(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_contain(bits, *_longs(batch, "anchor"))))

    def first(rows, *keys):
        return rows.groupBy(*keys).agg(F.min("doc").alias("source"), F.max("doc").alias("last"), F.min_by("lo", "doc").alias("at"), F.count(F.lit(1)).alias("m"))

    def later(rows, firsts, *keys):
        return spread_join(rows, saved(firsts.filter("source != last").drop("last"), "repeated"), keys, "m", "doc").filter("doc > source")

    near = index.mapInArrow(passing, index.schema)
    firsts = saved(first(near, "anchor", "block"), "firsts")
    copies = later(near, firsts, "anchor", "block").select("doc", *own, "lo", "n", "source", "at")

    edges = firsts.join(shared.filter("differ").select("anchor"), "anchor", "left_semi").select("anchor", "block", "source")

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_key(*_longs(batch, "anchor", "block", "source")))], ["key"])

    keys = saved(edges.mapInArrow(keyed, "key long"), "edges")
    marked = bloom(keys, "key", keys.count())

    def windows(batches):
        for batch in batches:
            ids, *more = _longs(batch, "doc_id", *own)
            for piece in slices(batch.column(1)):
                row, lo, n, anchor, block, runs = _blocks(piece, window)
                doc = ids[piece.first + row]
                pick = may_contain(marked, _key(anchor, block, doc))
                row, lo, n, anchor, doc = row[pick], lo[pick], n[pick], anchor[pick], doc[pick]
                one = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(doc, n)), *(pa.array(np.repeat(x[piece.first + row], n)) for x in more), pa.array(np.repeat(anchor, n)), pa.array(runs.hashes(one, window).view(np.int64)), pa.array((one - np.repeat(piece.of[row], n)).astype(np.int32))], ["doc", *own, "anchor", "w", "lo"])

    looked = docs.mapInArrow(windows, ", ".join(f"{c} long" for c in ("doc", *own, "anchor", "w")) + ", lo int")
    partly = later(looked, first(looked, "anchor", "w"), "anchor", "w").select("doc", *own, "lo", F.lit(1).alias("n"), "source", "at")
    return copies.union(partly)


def parse(row: np.ndarray, lo: np.ndarray, n: np.ndarray, source: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, lo, length, source, at) of the factors of documents ``row``, each of which goes on while the next match continues it in its source."""
    by = np.lexsort((lo, row))
    row, lo, n, source, at = row[by], lo[by], n[by], source[by], at[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (at[1:] - at[:-1] != n[:-1]) | (lo[1:] - lo[:-1] != n[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    return row[first], lo[first], lo[last] + n[last] + (window - 1) - lo[first], source[first], at[first]


def factors(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc, lo, length, source, at): the words of doc from word lo on are those of a smaller document, the source, from word at on.

    Factors are ``window`` words long at least, and cover exactly the windows
    that a smaller document has too.  Null ids and texts have none, rows that
    repeat an id count as one document, an empty table gives no rows.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return _factors(docs, window)


def _factors(docs: DataFrame, window: int) -> DataFrame:
    """``factors``; further columns of ``docs`` tell apart the texts of rows that repeat an id."""
    keys = ["doc", *docs.columns[2:]]
    grouped = _matches(docs, window).groupBy(*keys).agg(F.collect_list(F.struct("lo", "n", "source", "at")).alias("found"))

    def walked(batches):
        for batch in batches:
            found = batch.column("found")
            row = np.repeat(np.arange(batch.num_rows), found.value_lengths())
            own, *rest = parse(row, *(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in found.flatten().flatten()), window)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own)) for c in keys), *map(pa.array, rest)], [*keys, "lo", "length", "source", "at"])

    return grouped.mapInArrow(walked, ", ".join(f"{c} long" for c in keys) + ", lo long, length long, source long, at long")


def _with_ends(found: DataFrame, docs: DataFrame, gram: int) -> DataFrame:
    """Factors as (..., lo, hi, head, tail) with the first and the last ``gram`` words of their sources."""
    found = saved(found, "factors")
    sources = saved(found.select("source").distinct(), "sources")
    bits = bloom(sources, "source", sources.count())

    def cut(batches):
        for batch in batches:
            batch = batch.filter(pa.array(may_contain(bits, *_longs(batch, "doc_id"))))
            for piece in slices(batch.column("text")):
                piece.find_words()
                data, out = piece.data.tobytes(), {"of": [], "piece": [], "words": []}
                words = [data[i:j] for i, j in zip(piece.starts.tolist(), piece.ends.tolist())]
                for k, (a, b) in enumerate(zip(piece.of[:-1].tolist(), piece.of[1:].tolist())):
                    for at in range(a, b, PIECE):
                        out["of"].append(piece.first + k)
                        out["piece"].append((at - a) // PIECE)
                        out["words"].append(b" ".join(words[at : min(at + PIECE + gram - 1, b)]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(out["of"], pa.int64())), pa.array(out["piece"], pa.int64()), pa.array(out["words"], pa.string())], ["source", "piece", "words"])

    pieces = docs.mapInArrow(cut, "source long, piece long, words string")
    for name, at in (("head", F.col("at")), ("tail", F.col("at") + F.col("length") - gram)):
        words = F.array_join(F.slice(F.split("words", " "), (at % PIECE).cast("int") + 1, gram), " ")
        found = found.withColumn("piece", F.floor(at / PIECE)).join(pieces, ["source", "piece"]).select(*found.columns, words.alias(name))
    return found.select(*(c for c in ("doc", "own") if c in found.columns), "lo", (F.col("lo") + F.col("length")).alias("hi"), "head", "tail")


def _cut(batch, gram: int, digest: bool) -> Iterator[pa.RecordBatch]:
    rows, spans = batch.column("row"), batch.column("spans")
    for piece in slices(batch.column("text")):
        piece.find_words()
        gone = np.zeros(len(piece.starts) + 1, np.int64)
        data, out, removed = piece.data.tobytes(), [], []
        starts, ends = piece.starts.tolist(), piece.ends.tolist()
        for k, own in enumerate(spans.slice(piece.first, len(piece)).to_pylist()):
            a, b = int(piece.of[k]), int(piece.of[k + 1])
            for s in own or ():
                lo, hi = a + s["lo"], a + s["hi"]
                # Only what its source's own words confirm at both ends is a factor.
                if hi <= b and all(b" ".join(data[i:j] for i, j in zip(starts[at : at + gram], ends[at : at + gram])) == s[end].encode() for at, end in ((lo, "head"), (hi - gram, "tail"))):
                    gone[lo] += 1
                    gone[hi] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        for k in range(len(piece)):
            a, b = piece.of[k], piece.of[k + 1]
            own = gone[a:b]
            removed.append(int(own.sum()))
            if not digest:
                text = data[piece.bounds[k] : piece.bounds[k + 1]]
                if removed[-1]:
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                    parts, done = [], 0
                    for i, j in zip(edge[::2], edge[1::2]):  # a cut takes the white space after its words along
                        to = piece.starts[a + j] if a + j < b else piece.bounds[k + 1]
                        parts.append(text[done : piece.starts[a + i] - piece.bounds[k]])
                        done = to - piece.bounds[k]
                    text = b"".join([*parts, text[done:]])
                out.append(text.decode("utf-8", "replace"))
            else:
                left = np.flatnonzero(~own) + a
                out.append(hashlib.sha256(b" ".join(data[i:j] for i, j in zip(piece.starts[left].tolist(), piece.ends[left].tolist()))).hexdigest())
        yield pa.RecordBatch.from_arrays([rows.slice(piece.first, len(piece)), pa.array(np.diff(piece.of), pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["row", "n_words", "n_removed", "kept"])


def _removed(docs: DataFrame, row: Column, window: int, digest: bool) -> DataFrame:
    """row, n_words, n_removed and kept for every row of ``docs``, in whose place ``row`` stands."""
    ready(docs.sparkSession)
    gram = min(GRAM, window)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    each = F.collect_list(F.struct("lo", "hi", "head", "tail")).alias("spans")
    spans = _with_ends(factors(texts, window), texts, gram).groupBy("doc").agg(each)
    rows, same = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", row.alias("row")), F.col("_id") == F.col("doc")
    several = saved(docs.select(F.col("doc_id").cast("long").alias("doc")).dropna().groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc"), "several")
    if not several.isEmpty():
        # Rows that repeat an id lose what is found in their own text, not what is found in another of that id.
        keyed = _factors(texts.withColumn("own", F.xxhash64("text")), window).join(several, "doc", "left_semi")
        apart = _with_ends(keyed, texts, gram).groupBy("doc", "own").agg(each)
        spans = spans.join(several, "doc", "left_anti").withColumn("own", F.lit(None).cast("long")).unionByName(apart)
        same = same & (F.col("own").isNull() | (F.xxhash64("text") == F.col("own")))
    rows = rows.join(spans, same, "left").select("row", "text", "spans")

    def cut(batches):
        for batch in batches:
            yield from _cut(batch, gram, digest)

    return rows.mapInArrow(cut, T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), T.StructField("kept", T.StringType())]))


def remove_repeats(docs: DataFrame, window: int = 50, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept for every row of ``docs``.

    A word is removed if a window of ``window`` consecutive words that covers
    it also starts in a document with a smaller doc_id; windows are judged on
    the texts as they come in.  ``kept`` is the text without the removed words
    and the white space after them, all else unchanged; with ``digest`` it is
    the SHA-256 of the kept words joined by one space.

    A null text has no words and an empty ``kept``.  Documents shorter than a
    window, and rows with a null doc_id, keep every word and lend none.  Rows
    that repeat a doc_id are one document here: none removes the other's
    words, and each loses what a smaller document has of its own text.  Other
    columns are ignored; an empty table
    gives no rows.
    """
    out = _removed(docs, F.col("doc_id").cast("long"), window, digest)
    return out.withColumnRenamed("row", "doc_id")


def cut_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` and ``n_chars`` set anew where it is a column.

    Documents that lose every word go; those that lose none are unchanged, a
    null text included.  Rows that repeat a doc_id keep each what is left of
    its own text; rows with a null doc_id are kept as they are.
    """
    cut = _removed(docs, F.struct(*(docs[c] for c in docs.columns)), window, False).filter("n_removed = 0 or n_removed < n_words")
    touched = F.col("n_removed") > 0
    new = {"text": F.when(touched, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(touched, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return cut.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
