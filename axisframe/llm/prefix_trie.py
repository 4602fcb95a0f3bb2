"""The trie of conversations' prefixes, from their sorted order alone.

1. A turn is its digest and the length of its text, 20 bytes; a conversation is
   its turns' bytes, one after the other.  Equal conversations are one class,
   whose members are joined in order, in pieces, for their hash.
2. Classes are sorted by their bytes, by ranges; the LCP array has the number
   of first turns that neighbours share.
3. The Cartesian tree of the LCP array: all nearest smaller values, block by
   block, and over the block minima where a block has none.  Places of equal
   LCP between the same smaller values are one node; a class is a leaf.
4. A node that stands more than one turn below its parent stands for all the
   depths between, which are expanded.
5. Every node is an interval of classes, so members, leaves and savings are
   totals of intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import numbered
from .intervals import BLOCK, interval_totals, nearest_smaller
from .shared import ready, saved

UNIT = 20
#: Members of one piece of a class.
PIECE = 4096
NOBODY = hashlib.sha256(b"").hexdigest()


def _units(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each the hex form of 16 bytes of its digest and 4 of its text's length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    unit = F.concat(digest, F.lpad(F.lower(F.hex(F.length(text).cast("long"))), 8, "0"))
    turn = F.col("turn").cast("long")
    one = F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0).cast("long")).alias("turn"), unit.alias("unit"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one"))["unit"].alias("units"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and the bytes of every rebuilt conversation, with the hash of these."""
    own = _units(conversations)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    base = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("units", 1, 5).alias("first"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h).join(base, "base", "left")
    first = F.when(F.col("first").isNotNull() & (F.col("h") > 0), F.slice("first", F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.array().cast("array<string>"))
    units = F.concat(first, F.slice("units", F.col("h") + 1, F.greatest(F.size("units"), F.lit(1))))
    key = F.unhex(F.array_join(units, ""))
    return saved(both.select("conv_id", key.alias("key")).withColumn("k", F.unhex(F.sha2("key", 256))), "rebuilt")


def _pieces(batches):
    """Runs of PIECE members at most of rows that are sorted by class and member."""
    def row(k, ids):
        return {"k": [k], "first": [ids[0]], "n": [len(ids)], "ids": [",".join(map(str, ids))]}

    own, ids = None, []
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (k != own or len(ids) == PIECE):
                yield pa.RecordBatch.from_pydict(row(own, ids))
                ids = []
            own = k
            ids.append(c)
    if ids:
        yield pa.RecordBatch.from_pydict(row(own, ids))


def _joined(batches):
    """One row for each class of pieces that are sorted by class and first member; a piece is forgotten once it is hashed."""
    kind = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])
    own = None
    for batch in batches:
        out = []
        for k, first, n, ids in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if own is not None and own[0] == k:
                own[2] += n
                own[3].update(b"," + ids.encode())
                continue
            if own is not None:
                out.append({"conv_id": own[1], "n": own[2], "ends": own[3].hexdigest()})
            own = [k, first, n, hashlib.sha256(ids.encode())]
        yield pa.RecordBatch.from_pylist(out, kind)
    if own is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": own[1], "n": own[2], "ends": own[3].hexdigest()}], kind)


def _lcp(t: pa.Table, block: int, size: int) -> pa.Table:
    """The LCP array of a block, which comes with the class before it and the one behind it."""
    t = t.sort_by("r")
    r, keys = t["r"].to_pylist(), t["key"].to_pylist()
    shared = []
    for a, b in zip(keys, keys[1:]):
        n = min(len(a), len(b))
        x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
        apart = np.flatnonzero(x != y)
        shared.append((int(apart[0]) if len(apart) else n) // UNIT)
    out = []
    for k, place in enumerate(r):
        if place // size == block:
            x = shared[k - 1] if k else -1
            y = shared[k] if k < len(shared) else -1
            lengths = np.frombuffer(keys[k], np.uint8).reshape(-1, UNIT)[max(x, 0) :, 16:].copy().view(">u4").reshape(-1).astype(np.int64).tolist()
            out.append({"r": place, "x": x, "y": y, "depth": len(keys[k]) // UNIT, "lengths": ([0] if x < 0 else []) + lengths})
    kind = pa.schema([("r", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("depth", pa.int64()), ("lengths", pa.list_(pa.int64()))])
    return pa.Table.from_pylist(out, kind)


def classes(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """The distinct rebuilt conversations by rank r: the first turns x and y that they share with the classes before and behind them, all turns, the lengths of the texts from turn x on, members."""
    rows = rebuilt(conversations)
    pieces = rows.select("k", "conv_id").repartitionByRange("k", "conv_id").sortWithinPartitions("k", "conv_id").mapInArrow(_pieces, "k binary, first long, n long, ids string")
    own = pieces.repartition("k").sortWithinPartitions("k", "first").mapInArrow(_joined, "conv_id long, n long, ends string")
    ranked = saved(numbered(saved(own, "classes").join(rows.select("conv_id", "key"), "conv_id"), [F.col("key")], "r"), "ranked")
    place, block = F.col("r") % size, F.floor(F.col("r") / size).cast("long")
    blocks = F.array_compact(F.array(block, F.when((place == 0) & (block > 0), block - 1), F.when(place == size - 1, block + 1)))
    lcp = ranked.select("r", "key", F.explode(blocks).alias("g")).groupBy("g").applyInArrow(lambda key, t: _lcp(t, key[0].as_py(), size), "r long, x long, y long, depth long, lengths array<long>")
    return saved(lcp.join(ranked.drop("key"), "r"), "classes")


def trie(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations; see the module and the columns' names.

    Turns of equal or null number come in the order of their digests, null ones
    first; a null role or text is empty.  Rows with a null conv_id belong to no
    conversation; repeated rows are turns of their own.  ``conv_id % 100`` has
    the sign of conv_id.  Without conversations there are no rows.  Other
    columns are left out.  A conversation's turns, 20 bytes each, must fit in a
    row; its texts are never brought together.
    """
    ready(conversations.sparkSession)
    own = classes(conversations, size)
    n = own.count()
    values = own.select(F.col("r").alias("i"), "x").union(conversations.sparkSession.createDataFrame([(n, -1)] if n else [], "i long, x long"))
    near = nearest_smaller(values, n + 1, size)
    inner = near.filter((F.col("i") > 0) & (F.col("i") < n)).groupBy(F.col("l").alias("lo"), F.col("x").alias("v")).agg(F.min("h").alias("hi"), F.min("lx").alias("lx"), F.min("hx").alias("hx"))
    leaves = own.select(F.col("r").alias("lo"), F.col("depth").alias("v"), (F.col("r") + 1).alias("hi"), F.col("x").alias("lx"), F.col("y").alias("hx"))
    nodes = inner.unionByName(leaves).withColumn("p", F.greatest("lx", "hx")).filter("p < v")
    nodes = nodes.join(near.select(F.col("i").alias("lo"), "l"), "lo").withColumn("plo", F.when(F.col("p") < 0, None).when(F.col("hx") > F.col("lx"), F.col("lo")).otherwise(F.col("l")))
    nodes = saved(nodes.select("lo", "hi", "v", "p", "plo"), "nodes")
    asked = nodes.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    members = own.select(F.col("r").alias("i"), "conv_id", "n", (F.col("y") < F.col("depth")).cast("long").alias("leaf"))
    totals = interval_totals(members, asked, n, "conv_id", ["n", "leaf"], size).withColumnsRenamed({"a": "lo", "b": "hi"})
    nodes = saved(nodes.join(totals, ["lo", "hi"]), "nodes")
    upper = nodes.select(F.col("lo").alias("plo"), F.col("v").alias("p"), F.col("conv_id").alias("above"))
    nodes = nodes.join(upper, ["plo", "p"], "left")

    # Every depth between a node and its parent, with the last turn's length.
    deep = nodes.withColumn("depth", F.explode(F.sequence(F.col("p") + 1, F.col("v"))))
    last = own.select(F.col("r").alias("lo"), "x", F.col("depth").alias("whole"), "ends", F.posexplode("lengths").alias("at", "length")).withColumn("depth", F.col("x") + 1 + F.col("at"))
    deep = deep.join(last.select("lo", "depth", "length", F.when(F.col("depth") == F.col("whole"), F.col("ends")).alias("ends")), ["lo", "depth"])
    deep = saved(deep.withColumn("saved", (F.col("n") - 1) * F.col("length")), "trie")
    sums = deep.groupBy(F.col("lo").alias("i")).agg(F.sum("saved").alias("saved"))
    below = interval_totals(sums, asked, n, None, ["saved"], size).withColumnsRenamed({"a": "lo", "b": "hi", "saved": "within"})
    upto = Window.partitionBy("lo").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("depth") == F.col("p") + 1
    deep = deep.withColumns({"before": F.coalesce(F.sum("saved").over(upto), F.lit(0)), "up": F.when(first, F.col("plo")).otherwise(F.col("lo"))}).join(below, ["lo", "hi"])
    children = deep.filter("depth > 0").groupBy(F.col("up").alias("lo"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    return deep.join(children, ["lo", "depth"], "left").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.when(first, F.col("above")).otherwise(F.col("conv_id"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaf").alias("n_leaves"),
        (F.col("within") - F.col("before")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"),
    )
