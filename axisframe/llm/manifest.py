"""A Merkle manifest of a dataset, and a proof for each of its rows, by a radix-ranked trie.

1. A row's leaf is the SHA-256 of its values.  Equal rows are counted, not kept
   apart, until they have their ranks.
2. Ranks without a global sort: doc_ids are read as digits of RADIX_BITS bits.
   Rows are counted by all digits but the last, these counts by all digits but
   the last two, and so on.  From the top down, a prefix begins where its
   parent begins plus the counts of the siblings before it; a row's rank is its
   bucket's beginning plus its place in the bucket.  A window never has more
   than 2**RADIX_BITS siblings.  Where one doc_id has more different rows than
   that, the digits of their hashes follow those of the doc_id.
3. The digits of a rank to the base ``fanout`` key the trie: a node is a prefix
   of them.  Nodes are reduced by their longest prefixes first, as many digits
   at a time as make a block of BLOCK nodes, so a group has BLOCK rows at most
   and the number of steps is the logarithm of the rows to the base BLOCK.
4. Paths of siblings come down the same blocks, a block's own path once for all
   of its nodes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import numbered
from .shared import ready, saved, small_side

RADIX_BITS, BLOCK = 10, 1024
#: Copies of one row that get their ranks in one go.
COPIES = 4096

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<at:int,others:binary>>"


def _encoded(value: Column) -> Column:
    own = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))


def leaf(**changed: Column) -> Column:
    """The lowercase hex SHA-256 of a row of ``documents``, with columns of it exchanged for ``changed``."""
    return F.sha2(F.concat(*(_encoded(changed.get(f, F.col(f))) for f in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf, tampered leaf, and the number n of such rows; documents whose crc32 isn't divisible by 7 aren't tampered with."""
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    rows = docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), F.when(picked & F.col("n_chars").isNotNull(), leaf(n_chars=more)).alias("tampered"))
    return rows.groupBy("lang", "doc_id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("n"))


def radix_ranks(rows: DataFrame, bits: int = RADIX_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` (g, doc_id, leaf, n) with ``rank``, the number of rows of g before each in the order of doc_id (null first) and leaf; and (g, size)."""
    rows = rows.withColumns({"_known": F.col("doc_id").isNotNull().cast("int"), "_id": F.coalesce("doc_id", F.lit(0).cast("long"))})
    least, most = rows.agg(F.min("_id"), F.max("_id")).first()
    if least is None:
        least = most = 0
    keys = ["g", "_known", "_hi", "_lo"]

    def counted(df: DataFrame, hi: Column, lo: Column, n: str) -> DataFrame:
        return df.groupBy("g", "_known", hi.alias("_hi"), lo.alias("_lo")).agg(F.sum(n).alias("_c"), F.count(F.lit(1)).alias("_m"))

    # The finest prefixes: all but the last digit of the id, or, where ids repeat, digits of the hash behind it.
    hi, lo, letters = F.shiftright("_id", bits), F.lit(""), 0
    levels = [saved(counted(rows, hi, lo, "n"), "digits")]
    crowd = levels[0].agg(F.max("_m")).first()[0] or 0
    if crowd > 4 << bits:
        while crowd > 1 << bits:
            crowd, letters = crowd >> 8, letters + 2
        hi, lo = F.col("_id"), F.substring("leaf", 1, letters)
        levels = [saved(counted(rows, hi, lo, "n"), "digits")]
    parents = []
    shift = 0 if letters else bits
    while letters or (most >> shift) - (least >> shift) > 1:  # -1 and 0 never meet
        if letters:
            letters -= 2
            parents.append((F.col("_hi"), F.substring("_lo", 1, letters) if letters else F.lit("")))
        else:
            shift += bits
            parents.append((F.shiftright("_hi", bits), F.lit("")))
        levels.append(saved(counted(levels[-1], *parents[-1], "_c"), "digits"))

    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    top = levels[-1]
    begin = top.withColumn("_base", F.coalesce(F.sum("_c").over(before("g").orderBy("_known", "_hi", "_lo")), F.lit(0)))
    for level, (up_hi, up_lo) in zip(reversed(levels[:-1]), reversed(parents)):
        upper = begin.select("g", "_known", F.col("_hi").alias("_uh"), F.col("_lo").alias("_ul"), "_base")
        own = level.withColumns({"_uh": up_hi, "_ul": up_lo})
        smaller = F.coalesce(F.sum("_c").over(before("g", "_known", "_uh", "_ul").orderBy("_hi", "_lo")), F.lit(0))
        begin = saved(own.join(upper, ["g", "_known", "_uh", "_ul"]).withColumn("_base", F.col("_base") + smaller).select(*keys, "_base"), "digits")
    placed = rows.withColumns({"_hi": hi, "_lo": lo}).join(begin.select(*keys, "_base"), keys)
    inside = F.coalesce(F.sum("n").over(before(*keys).orderBy("_id", "leaf", "tampered")), F.lit(0))
    placed = placed.withColumn("rank", F.col("_base") + inside).drop("_known", "_id", "_hi", "_lo", "_base")
    return placed, top.groupBy("g").agg(F.sum("_c").alias("size"))


def _hash(parts: list[bytes]) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def _digits(fanout: int) -> int:
    """Digits to the base ``fanout`` that one step takes."""
    n = 1
    while fanout ** (n + 1) <= BLOCK:
        n += 1
    return n


def _tree(nodes: list[bytes], size: int, fanout: int) -> list[list[bytes]]:
    """The levels over a block's nodes: as many as its whole group of ``size`` nodes still needs, and one step at most."""
    levels = [nodes]
    for _ in range(_digits(fanout)):
        if size <= 1:
            break
        size = -(-size // fanout)
        levels.append([_hash(levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def _path(levels: list[list[bytes]], at: int, fanout: int) -> list[dict]:
    out = []
    for level in levels[:-1]:
        own, at = at % fanout, at // fanout
        run = level[at * fanout : (at + 1) * fanout]
        out.append({"at": own, "others": b"".join(run[:own] + run[own + 1 :])})
    return out


def _folded(node: bytes, path: list[dict]) -> bytes:
    for step in path:
        others = [step["others"][k : k + 32] for k in range(0, len(step["others"]), 32)]
        node = _hash([*others[: step["at"]], node, *others[step["at"] :]])
    return node


def _sorted(t: pa.Table) -> tuple[list, list[bytes]]:
    t = t.sort_by("rank")
    return t, t["hash"].to_pylist()


def _up(key, t: pa.Table, fanout: int) -> pa.Table:
    t, nodes = _sorted(t)
    levels = _tree(nodes, size := t["size"][0].as_py(), fanout)
    for _ in levels[1:]:
        size = -(-size // fanout)
    return pa.table({"g": [key[0].as_py()], "rank": [key[1].as_py()], "size": [size], "hash": pa.array(levels[-1], pa.binary())})


def _down(key, t: pa.Table, upper: pa.Table, fanout: int) -> pa.Table:
    """Each node's path to the root: its siblings in its block, then its block's own path."""
    t, nodes = _sorted(t)
    levels, rest = _tree(nodes, t["size"][0].as_py(), fanout), upper["path"][0].as_py()
    first = {k: [upper[k][0].as_py()] * len(nodes) for k in ("subroot", "root")}
    kind = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.binary())]))
    paths = pa.array([_path(levels, k, fanout) + rest for k in range(len(nodes))], kind)
    return pa.table({"g": t["g"], "block": t["rank"], "path": paths, **{k: pa.array(v, pa.binary()) for k, v in first.items()}})


def _proofs(key, t: pa.Table, upper: pa.Table, fanout: int) -> pa.Table:
    t, nodes = _sorted(t)
    levels, rest = _tree(nodes, t["size"][0].as_py(), fanout), upper["path"][0].as_py()
    root, after, tail = upper["root"][0].as_py().hex(), {}, "".join(s["others"].hex() for s in rest)
    proofs, folded = [], []
    for k, (own, other) in enumerate(zip(nodes, t["tampered"].to_pylist())):
        path = _path(levels, k, fanout)
        proofs.append(hashlib.sha256(("".join(s["others"].hex() for s in path) + tail).encode()).hexdigest())
        top = _folded(own if other is None else other, path)
        if top not in after:
            after[top] = _folded(top, rest).hex()
        folded.append(after[top])
    n = len(nodes)
    return pa.table({"doc_id": t["doc_id"], "leaf": [x.hex() for x in nodes], "subroot": [upper["subroot"][0].as_py().hex()] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded], "lang": t["lang"].cast(pa.string()), "rank": t["rank"]})


def _reduced(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """The nodes of each step, the last of which has one node for each g; ``most`` is the largest size."""
    steps, width = [nodes], fanout ** _digits(fanout)
    while True:
        grouped = steps[-1].select("g", F.floor(F.col("rank") / width).alias("block"), "rank", "size", "hash").groupBy("g", "block")
        steps.append(saved(grouped.applyInArrow(lambda key, t: _up(key, t, fanout), "g long, rank long, size long, hash binary"), "nodes"))
        most = -(-most // width)
        if most <= 1:
            return steps


def _given(f, fanout: int):
    return lambda key, t, upper: f(key, t, upper, fanout)


def _descended(steps: list[DataFrame], upper: DataFrame, fanout: int, bottom, schema: str) -> DataFrame:
    width = fanout ** _digits(fanout)
    for k in range(len(steps) - 2, -1, -1):
        nodes = steps[k].withColumn("block", F.floor(F.col("rank") / width)).groupBy("g", "block")
        last = k == 0 and bottom is not None
        out = nodes.cogroup(upper.groupBy("g", "block")).applyInArrow(_given(bottom if last else _down, fanout), schema if last else f"g long, block long, path {_PATH}, subroot binary, root binary")
        upper = out if last else saved(out, "paths")
    return upper


def manifest(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """doc_id, leaf, subroot of its lang, root, proof_sha256, folded_root and verified of every row of ``docs``, its lang and its rank there.

    Any column may be null and has a leaf of its own then; a null lang is a
    group of its own, the first one, and a null doc_id stands first in its
    group.  Rows that repeat a doc_id stand in the order of their leaves, and
    equal rows one after the other, each with a proof of its own.  Empty and
    very long texts are hashed as they are; an empty table has no rows.  A
    negative doc_id stands before 0.  Other columns are left out.
    """
    if fanout < 2:
        raise ValueError("a node needs two children at least")
    spark = ready(docs.sparkSession)
    rows = saved(leaves(docs), "leaves")
    langs = numbered(rows.select("lang").distinct(), [F.col("lang")], "g").select(F.col("lang").alias("_lang"), "g")
    rows = rows.join(small_side(langs, size=F.octet_length("_lang")), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    ranked, sizes = radix_ranks(rows)
    parts = F.floor((F.col("n") - 1) / COPIES)
    ranked = ranked.join(small_side(sizes), "g").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts)))
    if (rows.agg(F.max("n")).first()[0] or 0) > COPIES:
        ranked = ranked.repartition("g", "leaf", "_part")
    end = F.least(F.col("n"), (F.col("_part") + 1) * COPIES) - 1
    ranked = ranked.withColumn("_copy", F.explode(F.sequence(F.col("_part") * COPIES, end)))
    ranked = saved(ranked.select("g", (F.col("rank") + F.col("_copy")).alias("rank"), "size", F.unhex("leaf").alias("hash"), F.unhex("tampered").alias("tampered"), "doc_id", "lang"), "ranked")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, lang string, rank long"
    most, groups = sizes.agg(F.max("size"), F.count(F.lit(1))).first()
    if not groups:
        return spark.createDataFrame([], schema)
    steps = _reduced(ranked, most, fanout)
    subroots = steps[-1].select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), F.lit(groups).cast("long").alias("size"), "hash")
    over = _reduced(subroots, groups, fanout)
    crown = over[-1].select("g", F.col("rank").alias("block"), F.array().cast(_PATH).alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    paths = _descended(over, crown, fanout, None, "")
    begin = paths.join(steps[-1].select(F.col("g").alias("block"), F.col("hash").alias("_own")), "block").select(F.col("block").alias("g"), F.lit(0).cast("long").alias("block"), "path", F.col("_own").alias("subroot"), "root")
    return _descended(steps, begin, fanout, _proofs, schema)
