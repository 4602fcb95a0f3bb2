"""The Merkle manifest and the prefix trie against brute force; the lattice model against sums over all segmentations."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axisframe.llm import intervals, lattice_lm, manifest, prefix_trie
from axisframe.llm.language_id import held_out

from .conftest import DOCS, words

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    doc_id, source, lang, n, text = row
    return sha("".join(encoded(x) for x in (doc_id, source, lang, None if n is None else n + more, text)))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def path(tree, at, fanout):
    out = []
    for level in tree[:-1]:
        run = level[at // fanout * fanout : (at // fanout + 1) * fanout]
        out.append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
        at //= fanout
    return out


def by_hand(rows, fanout):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]], fanout)
    top = levels([trees[g][-1][0] for g in langs], fanout)
    out = []
    for k, g in enumerate(langs):
        for j, r in enumerate(groups[g]):
            steps = path(trees[g], j, fanout) + path(top, k, fanout)
            node = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for at, others in steps:
                node = sha("".join([*others[:at], node, *others[at:]]))
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(x for _, o in steps for x in o)), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "bits"), [(2, 10), (3, 2)])
def test_manifest(spark, monkeypatch, fanout, bits):
    r = random.Random(fanout)
    rows = [(r.choice([None, -5, 3, 3, 3, 2**62, -(2**63), *range(-20, 3000, 3)]), r.choice(["a", None]), r.choice(["en", None, "é"]), r.choice([1, None, 2**63 - 1]), r.choice(["", "x", None, "ñ" * 5])) for _ in range(1500)]
    rows += [(7, "s", "only", 1, "lone"), (9, "s", "en", 1, "long " * 50_000)] + [(11, "s", "en", 1, "copy")] * 40
    monkeypatch.setattr(manifest.radix_ranks, "__defaults__", (bits,))
    monkeypatch.setattr(manifest, "COPIES", 16)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"g": F.lit("x"), "rank": F.lit(1), "hash": F.lit(None).cast("string")}).repartition(3)
    assert sorted((tuple(x)[:7] for x in manifest.manifest(df, fanout).collect()), key=str) == by_hand(rows, fanout)


def test_manifest_of_nothing(spark, none):
    assert manifest.manifest(none).count() == 0
    with pytest.raises(ValueError):
        manifest.manifest(none, 1)


def conversations(seed, n):
    r = random.Random(seed)
    rows = [(r.choice([c, -c * 7, c * 50]), r.choice([t, t, t, None]), r.choice(["u", "a", None]), r.choice(["x", "yy", "é", None, "x"])) for c in range(n) for t in range(r.randint(1, 9))]
    return [*rows, (None, 1, "u", "nobody's"), *((5000 + k, t, "u", f"same {t}") for k in range(20) for t in range(3)), *((9001, t, "u", "z") for t in range(300))]


def nodes_by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), (role, text)))
    own = {c: [x[-1] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    saved, leaves = collections.Counter(), collections.Counter()
    for k in members:
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not children[k]
    ends = lambda k: ",".join(map(str, sorted(c for c in members[k] if built[c] == k)))
    return sorted(((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], leaves[k], saved[k], sha(ends(k))) for k, cs in members.items()), key=str)


@pytest.mark.parametrize(("n", "size"), [(120, 3), (60, 1024)])
def test_prefix_trie(spark, monkeypatch, n, size):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = conversations(n, n)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit("x"), "depth": F.lit(1), "key": F.lit(2)}).repartition(3)
    assert sorted((tuple(x) for x in prefix_trie.trie(df, size).collect()), key=str) == nodes_by_hand(rows)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_nearest_smaller_and_totals(spark):
    r = random.Random(5)
    x = [-1, *(r.randrange(6) for _ in range(90)), -1]
    values = spark.createDataFrame([(i, v, 7 * v - i) for i, v in enumerate(x)], "i long, x long, y long")
    for row in intervals.nearest_smaller(values.drop("y"), len(x), 3).collect():
        i, v = row["i"], row["x"]
        left = next((j for j in range(i - 1, -1, -1) if x[j] < v), None)
        right = next((j for j in range(i + 1, len(x)) if x[j] < v), None)
        assert (row["l"], row["h"]) == (left, right) and (left is None or row["lx"] == x[left]) and (right is None or row["hx"] == x[right])
    asked = spark.createDataFrame([(a, b) for a, b in itertools.combinations(range(len(x) + 1), 2) if (a + b) % 5 == 0], "a long, b long")
    for row in intervals.interval_totals(values, asked, len(x), "y", ["x"], 3).collect():
        own = range(row["a"], row["b"])
        assert (row["y"], row["x"]) == (min(7 * x[i] - i for i in own), sum(x[i] for i in own))


RANKS = {b" ": 3, b" a": 1, b" ab": 2, b"a": 1, b"b": 2, b"ab": 3, b"ba": 4, b"abab": 5, b"c": 9, b"\xc3": 9, b"\xa9": 9}
WORDS = ["", "a", "ab", "abab", "abcab", "é", "ababababab", "b"]


def marginal(pieces, word):
    logs = {}
    for name in RANKS:
        key = lattice_lm._hashes(np.frombuffer(name, np.uint8), np.array([0]), np.array([len(name)]))[0]
        logs[name] = pieces.log[np.searchsorted(pieces.keys, key)]

    def rest(s):
        return math.exp(pieces.log[-1]) if not s else sum(math.exp(p) * rest(s[len(n) :]) for n, p in logs.items() if s.startswith(n))

    return math.log(rest(b" " + word.encode()))


def test_lattice_sums_over_all_segmentations(monkeypatch):
    pieces = lattice_lm.Pieces(dict(RANKS))
    got = lattice_lm.word_log(pieces, pa.array(WORDS))
    assert np.allclose(got, [marginal(pieces, w) for w in WORDS])
    counts = lattice_lm.expected(pieces, pa.array(WORDS))
    for k in range(len(pieces.log)):  # expected counts are the derivative of the log probability
        pieces.log[k] += 1e-5
        assert abs((lattice_lm.word_log(pieces, pa.array(WORDS)).sum() - got.sum()) / 1e-5 - counts[k]) < 1e-3
        pieces.log[k] -= 1e-5
    monkeypatch.setattr(lattice_lm, "RUN", 3)
    assert np.allclose(lattice_lm.word_log(pieces, pa.array(WORDS)), got)
    pieces.fit(counts)
    assert lattice_lm.word_log(pieces, pa.array(WORDS)).sum() > got.sum()


def test_pieces_are_a_distribution():
    """Over all words of up to 12 letters a and b the probabilities sum to less than 1, and to all of it but for longer ones."""
    pieces = lattice_lm.Pieces({b" a": 1, b" b": 2, b"a": 3, b"b": 2, b"ab": 3})
    total = sum(np.exp(lattice_lm.word_log(pieces, pa.array(["".join(w) for w in itertools.product("ab", repeat=n)]))).sum() for n in range(1, 13))
    assert 0.99 < total < 1


def test_scores(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HOT", 200)
    path = public_tokenizers.path("piece_bpe_32k.model")
    more = [(None, "ONE two"), (None, None), (3, "ünïque " + "y" * 40_000)]
    df = docs.select("doc_id", "text", "key", "n").unionByName(spark.createDataFrame([(d, t, "k", 1) for d, t in more], "doc_id long, text string, key string, n int")).withColumns({"score": F.lit("s"), "rare": F.lit(1)})
    got = lattice_lm.score(df, held_out(7, 2), path).collect()
    every = [*rows, *more]
    assert len(got) == len(every)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts, ends = collections.Counter(), 0
    for d, t in every:
        if not out(d):
            counts.update(words(t, lower=True))
            ends += 1
    n, kinds = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for d, t in every:
        own = words(t, lower=True)
        base = sum(math.log10((counts[w] + 1) / (n + kinds + 1)) for w in own) + math.log10((ends + 1) / (n + kinds + 1))
        want.append((d, out(d), len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n, round(base, 6)))
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == sorted(want, key=str)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lattice_lm.score(none, held_out(7, 2), path).count() == 0
    alone = lattice_lm.score(spark.createDataFrame([(1, "some words", "en", "s", 10)], DOCS), F.lit(True), path).first()
    assert alone["train_tokens"] == alone["n_known"] == 0 and alone["score"] < 0


def test_familiar_texts_are_likelier(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("aeioust") for _ in range(r.randint(3, 9))) for _ in range(200)]
    text = lambda: " ".join(r.choice(vocabulary) for _ in range(80))
    rows = [(k, text()) for k in range(1, 80)] + [(1000 + k, "".join(r.sample("qxzjkvwy" * 40, 300))) for k in range(3)]
    held = F.col("doc_id") >= 70
    got = {x["doc_id"]: x["score"] / x["n_tokens"] for x in lattice_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), held, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert min(got[k] for k in range(70, 80)) > max(got[1000 + k] for k in range(3))
