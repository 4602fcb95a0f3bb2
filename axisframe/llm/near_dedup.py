"""Near-duplicate documents by bottom-k sketches from one hash function.

Every distinct word shingle of a document has one 64-bit key: its hash, below
a few bits that tell how common its bucket of hashes is in the corpus, so that
common shingles sort last.  A document with n shingles retains the
k = n - ceil(t * n) + 1 smallest keys, t being the least similarity.  Two sets
that reach it share at least one retained key whatever the order of the keys
is, so no link is lost, and the commonness bits only keep the inverted lists
short.

1. Documents with equal sets become one class; its smallest doc_id stands for it.
2. Inverted lists: classes by retained key.  Each list ties its members to its
   smallest one, and the number of lists that tie a pair is its overlap.  A
   class's best tie is tried first.
3. Union-sketch estimation: up to the smaller of both sketches' largest keys
   the two sets are known in full.  The overlap there, and the best case for
   the rest, estimate the similarity from above; a pair goes on only if this
   estimate reaches t.
4. Exact Jaccard on full sets verifies.
5. Lists whose members are still in several components are paired across
   components, where a list's key can be the first that two sets share: from
   its place on, each of them must have as many keys as their overlap needs.
   Common keys come late in a set, so long lists make few pairs.  These are
   filtered and verified in the same way.  Copies are in one component by
   then, so this doesn't grow with the square of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import CHUNK, bloom, may_contain, ready, saved, small_side, spread_join, summed_arrays
from .textbytes import WordRuns, mix, slices

#: Buckets of hashes by which commonness is told, as a power of two: 16 a document within these bounds.
LEAST_ORDER_BITS, MOST_ORDER_BITS = 20, 24


def _shingles(piece, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle of the slice, repeated ones included."""
    piece.find_words()
    runs = WordRuns(piece.word_hashes(lower=True))
    count = np.diff(piece.of)
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(piece)), n)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(piece.of[:-1], n)
    return doc, runs.hashes(start, np.minimum(count, words)[doc])


def _sets(piece, words: int, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, keys): each document's distinct keys in rising order."""
    doc, key = _shingles(piece, words)
    if order is not None:
        bits = np.uint64(64 - (len(order) - 1).bit_length())
        key = (order[(key >> bits).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (key >> np.uint64(7))
    by = np.lexsort((key, doc))
    doc, key = doc[by], key[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    doc, key = doc[new], key[new]
    return np.searchsorted(doc, np.arange(len(piece) + 1)), key


def retained(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + (n > 0)


def overlap_needed(na: Column, nb: Column, percent: int) -> Column:
    """How many keys two sets of these sizes share at least if they reach the similarity."""
    return F.ceil((percent * (na + nb)) / F.lit(100.0 + percent) - F.lit(1e-9))


def _commonness(docs: DataFrame, words: int, bits: int, classes: np.ndarray) -> np.ndarray:
    """For each bucket of hashes how common it is: its count on a scale of quarters of an octave.

    Copies don't count: ``classes`` is a Bloom filter of the documents that do.
    At most 16 MB, whatever the corpus is.
    """

    def made(batches):
        out = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(may_contain(classes, own.astype(np.int64))))
            for piece in slices(batch.column(1)):
                at, n = np.unique((_shingles(piece, words)[1] >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                out[at] += n.astype(np.uint32)
        return {"n": out}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    n = summed_arrays(rows, made, {"n": (1 << bits, np.uint32)})["n"]
    out = np.empty(len(n), np.uint8)
    for k in range(0, len(n), CHUNK):  # the driver holds the logarithms of one chunk at a time
        out[k : k + CHUNK] = np.minimum(4 * np.log2(np.maximum(n[k : k + CHUNK], 1)), 127)
    return out


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), x and y (a 128-bit fingerprint of the set)."""

    def made(batches):
        for batch in batches:
            ids = batch.column(0)
            for piece in slices(batch.column(1)):
                at, key = _sets(piece, words, None)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(key ^ np.uint64(c))))) for c in (0x1234567, 0x7654321ABC)]
                yield pa.RecordBatch.from_arrays([ids.slice(piece.first, len(piece)), pa.array(np.diff(at), pa.int64()), *(pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums)], ["doc_id", "n", "x", "y"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, n long, x long, y long")


def sketches(docs: DataFrame, words: int, percent: int, order: np.ndarray) -> DataFrame:
    """doc_id, n (set size) and sketch (the retained keys in rising order)."""
    order = docs.sparkSession.sparkContext.broadcast(order)

    def made(batches):
        for batch in batches:
            ids = batch.column(0)
            for piece in slices(batch.column(1)):
                at, key = _sets(piece, words, order.value)
                n = np.diff(at)
                k = retained(n, percent)
                raw = key.tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(piece.first, len(piece)), pa.array(n, pa.int64()), pa.array([raw[8 * a : 8 * (a + b)] for a, b in zip(at[:-1].tolist(), k.tolist())], pa.binary())], ["doc_id", "n", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, n long, sketch binary")


def _postings(table: DataFrame) -> DataFrame:
    def made(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = part.column(2).to_pylist()
                k = np.array([len(x) // 8 for x in raw])
                place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), *(pa.array(np.repeat(part.column(i).to_numpy(zero_copy_only=False), k), pa.int64()) for i in (0, 1)), pa.array(place.astype(np.int32))], ["key", "doc", "n", "place"])

    return table.select("doc_id", "n", "sketch").mapInArrow(made, "key long, doc long, n long, place int")


def _bounded(batches, percent: int):
    """Keeps pairs whose similarity, estimated from above by what both sketches know, reaches the least one."""
    for batch in batches:
        cols = {k: batch.column(k) for k in batch.schema.names}
        keep = []
        for na, nb, sa, sb in zip(cols["na"].to_pylist(), cols["nb"].to_pylist(), cols["sa"].to_pylist(), cols["sb"].to_pylist()):
            p, q = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            ends = [s[-1] for s, n in ((p, na), (q, nb)) if len(s) < n]
            if ends:
                p, q = p[: np.searchsorted(p, min(ends), "right")], q[: np.searchsorted(q, min(ends), "right")]
            both = np.intersect1d(p, q, assume_unique=True).size
            most = both + min(na - len(p), nb - len(q))
            keep.append(100 * most >= percent * (na + nb - most))
        yield pa.RecordBatch.from_arrays([cols["a"], cols["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _exact(batches, words: int, percent: int):
    for batch in batches:
        keep = []
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sides = [[x for piece in slices(part.column(c)) for x in _each(*_sets(piece, words, None))] for c in ("ta", "tb")]
            for p, q in zip(*sides):
                both = np.intersect1d(p, q, assume_unique=True).size
                keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _each(at: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    return [key[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def _links(pairs: DataFrame, table: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity.

    Only texts of documents in pairs that pass the estimate are shuffled: a
    Bloom filter keeps the others in the scan.
    """
    own = table.select("doc_id", "n", "sketch")
    withs = pairs.join(own.toDF("b", "nb", "sb"), "b").join(own.toDF("a", "na", "sa"), "a").select("a", "b", "na", "nb", "sa", "sb")
    likely = saved(withs.mapInArrow(lambda it: _bounded(it, percent), "a long, b long"), "likely")
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    bits = bloom(ids, "doc_id", ids.count())

    def passing(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(may_contain(bits, own.astype(np.int64))))

    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(passing, "doc_id long, text string").groupBy("doc_id").agg(F.min("text").alias("text"))
    withs = likely.select("a", "b").join(full.toDF("b", "tb"), "b").join(full.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    return saved(withs.mapInArrow(lambda it: _exact(it, words, percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and n_links for every row of ``docs``.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets
    of distinct ``words``-word shingles (A-Z lower-cased; a shorter document's
    whole word sequence is one shingle).  component_id is the smallest doc_id
    that links reach; kept marks the document of that id.  n_links counts the
    verified links that the search used, not all pairs of a group.

    A null text or one without words has an empty set: n_shingles 0, linked
    with nothing, kept.  Rows with a null doc_id are returned with a null
    component and kept, and link nothing.  Rows that repeat a doc_id are all
    returned; they count as one document, which is near whatever any of its
    texts is near.  Other columns of ``docs`` are ignored; an empty table
    gives no rows.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = saved(fingerprints(docs, words), "sets")
    sets = table.filter("doc_id is not null and n > 0").groupBy("doc_id").agg(*(f(c).alias(f"{k}_{c}") for c in ("n", "x", "y") for k, f in (("least", F.min), ("most", F.max))))
    several = saved(sets.filter(" or ".join(f"least_{c} != most_{c}" for c in ("n", "x", "y"))).select("doc_id"), "several")
    if several.isEmpty():
        return _components(docs, table, words, percent)
    # Each text of a repeated id is looked for under a key of its own; then what shares an id is joined.
    keyed = docs.join(small_side(several).withColumn("_several", F.lit(True)), "doc_id", "left").withColumn("_key", F.when(F.col("_several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
    of_key, docs = saved(keyed.filter("_several").select("_key", "doc_id").distinct(), "keys"), keyed.select(F.col("_key").alias("doc_id"), "text")
    found = _components(docs, saved(fingerprints(docs, words), "sets"), words, percent).drop("kept").toDF("_key", "n_shingles", "_found", "n_links")
    found = saved(found.join(of_key, "_key", "left").withColumn("doc_id", F.coalesce("doc_id", "_key")), "found")
    least = saved(found.filter("_found is not null").groupBy("_found").agg(F.min("doc_id").alias("least")), "least")
    ties = found.join(of_key.select("_key"), "_key", "left_semi").join(least, "_found").filter("doc_id != least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    comps = saved(connected_components(saved(ties, "ties"), "a", "b"), "components")
    final = least.join(comps.toDF("least", "component"), "least", "left").select("_found", F.coalesce("component", "least").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.join(final, "_found", "left").select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "n_links")


def _components(docs: DataFrame, table: DataFrame, words: int, percent: int) -> DataFrame:
    """``near_duplicates`` of ``docs``, in which equal ids have equal sets; ``table`` has their fingerprints."""
    members = table.filter("doc_id is not null and n > 0")
    classes = saved(members.groupBy("n", "x", "y").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "members")
    ids = saved(classes.select(F.col("rep").alias("doc_id")).distinct(), "ids")
    n = ids.count()
    order = _commonness(docs, words, max(LEAST_ORDER_BITS, min(MOST_ORDER_BITS, n.bit_length() + 4)), bloom(ids, "doc_id", n))
    reps = sketches(docs, words, percent, order).join(ids, "doc_id", "left_semi")
    # Rows that repeat a doc_id have one set here.
    reps = saved(reps.groupBy("doc_id").agg(F.min(F.struct("n", "sketch")).alias("s")).select("doc_id", "s.n", "s.sketch"), "classes")

    by_key = Window.partitionBy("key").orderBy("doc")
    listed = _postings(reps).withColumns({"hub": F.first("doc").over(by_key), "hub_n": F.first("n").over(by_key), "next": F.lead("doc").over(by_key)})
    lists = saved(listed.filter("hub != doc or next is not null").select("key", "doc", "n", "place", "hub", "hub_n"), "lists")
    in_reach = lambda m, n: (100 * F.least(m, n) >= percent * F.greatest(m, n))
    tied = lists.filter((F.col("hub") != F.col("doc")) & in_reach(F.col("n"), F.col("hub_n"))).groupBy(F.col("hub").alias("a"), F.col("doc").alias("b")).agg(F.count(F.lit(1)).alias("overlap"))
    tied = saved(tied, "tied")
    # Each class's best tie first: that joins most groups, and leaves few of the other ties to verify.
    best = tied.groupBy("b").agg(F.max(F.struct("overlap", (-F.col("a")).alias("less"))).alias("m")).select((-F.col("m.less")).alias("a"), "b")
    links = _links(best, reps, docs, words, percent)
    comps = saved(connected_components(links, "a", "b"), "components")

    of = lists.join(comps.toDF("doc", "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    split = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("key")
    left = saved(of.join(split, "key").select("key", "doc", "n", "place", "comp"), "split-lists")
    one, two = left.toDF("key", "a", "na", "pa", "ca"), left.toDF("key", "b", "nb", "pb", "cb")
    needed = overlap_needed(F.col("na"), F.col("nb"), percent)
    first = (F.col("na") - F.col("pa") >= needed) & (F.col("nb") - F.col("pb") >= needed)
    apart = one.join(two, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & in_reach(F.col("na"), F.col("nb")) & first)
    apart = saved(apart.select("a", "b").distinct().join(best, ["a", "b"], "left_anti"), "apart")
    if not apart.isEmpty():
        links = links.union(_links(apart, reps, docs, words, percent))
        comps = saved(connected_components(links, "a", "b"), "components")

    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    of_class = classes.join(comps.toDF("rep", "component"), "rep", "left").join(degree, "rep", "left").select("n", "x", "y", "members", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    linked = spread_join(members, of_class, ("n", "x", "y"), "members", "doc_id").select("doc_id", "n", "component_id", "n_links")
    alone = table.filter("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "n_links")


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` doesn't keep; columns unchanged."""
    gone = near_duplicates(docs, words, percent).filter("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
