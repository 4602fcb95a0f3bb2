"""Near duplicates and repeated passages against brute force."""

import hashlib
import itertools
import random
from unittest import mock

import numpy as np
from pyspark.sql import functions as F

from axisframe.llm import components, near_dedup, shared, substring_dedup
from axisframe.llm.components import connected_components

from .conftest import DOCS, corpus, words


def near_by_hand(rows, size):
    sets = {}
    for d, t in rows:
        w = words(t, lower=True)
        sets[d] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def check_near(df, rows, size):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, size, 80).collect()}
    assert got == near_by_hand(rows, size)


def test_near_duplicates_two_words(docs, rows):
    check_near(docs, rows, 2)


def test_near_duplicates_five_words_of_chained_edits(spark):
    base = corpus(3)[6][1].split()[:200]
    rows = []
    for k in range(12):  # each differs a little more from the first
        w = list(base)
        for j in range(k):
            w[j * 13] = f"x{j}"
        rows.append((100 - k, " ".join(w)))
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), rows, 5)


def test_near_duplicates_of_nothing_and_of_null_ids(spark, none):
    assert near_dedup.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=str)
    assert near_dedup.keep_one_of_each(odd).count() == 4


def test_near_duplicates_of_rows_that_repeat_an_id(spark):
    a, z = [" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 60), ("z", 40))]
    rows = [(1, a), (1, z), (2, z + " more"), (3, a + " a60"), (4, "other words of a text that no other row has"), (4, None), (5, "p q r s t u"), (5, "p q r s t u"), (7, "v w x y z"), (6, "v w x y z"), (7, a + " a60 a61")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()
    # 1 is near 2 by its second text and near 3 and 7 by its first; 7 is 6's copy by its other one.
    of = {1: 1, 2: 1, 3: 1, 7: 1, 6: 1, 4: 4, 5: 5}
    assert sorted(map(tuple, got)) == sorted((d, of[d], of[d] == d) for d, _ in rows)


def test_near_duplicates_of_repeated_ids_by_hand(spark, rows):
    rows = [(d % 40, t) for d, t in rows if d is not None][:160]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by_row = [(k, t) for k, (_, t) in enumerate(rows)]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    hand = near_by_hand(by_row, 2)
    for k, (_, comp, _) in hand.items():
        x, y = sorted((find(rows[k][0]), find(rows[comp][0])))
        root[y] = x
    got = near_dedup.near_duplicates(df, 2, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted((d, hand[k][0], find(d), find(d) == d) for k, (d, _) in enumerate(rows))


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 100 for k in range(100, 140)}}


def repeats_by_hand(rows, size):
    first = {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        w = words(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < d:
                gone.update(range(k, k + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


def check_repeats(df, rows, size):
    want = repeats_by_hand(rows, size)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(df, size, digest=True).collect()}
    assert got == {d: v[:3] for d, v in want.items()}
    return want


def test_repeats(docs, rows):
    want = check_repeats(docs, rows, 50)
    assert sum(v[1] for v in want.values()) > 500
    texts = {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(docs).collect()}
    for (d, t), v in zip(rows, (want[d] for d, _ in rows)):
        assert words(texts[d]) == v[3]
        assert v[1] or texts[d] == (t or "")


def test_repeats_of_monotonous_texts(spark):
    rows = [(1, "a " * 60), (2, "a " * 55 + "b"), (3, "b " + "a " * 49), (4, "a b " * 40), (5, "x " + "a b " * 30), (7, "a")]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rows, 50)
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string"), rows, 3)


def test_cut_repeats_keeps_columns_and_clean_rows(spark, docs, none):
    out = substring_dedup.cut_repeats(docs)
    assert out.columns == docs.columns and substring_dedup.cut_repeats(none).count() == 0
    got, was = {r["doc_id"]: r for r in out.collect()}, {r["doc_id"]: r for r in docs.collect()}
    want = repeats_by_hand([(d, r["text"]) for d, r in was.items()], 50)
    assert set(got) == {d for d, v in want.items() if v[1] < v[0] or not v[0]}
    assert all(got[d] == was[d] for d in got if not want[d][1])
    assert all(got[d]["n_chars"] == len(got[d]["text"]) for d in got if want[d][1])
    null = spark.createDataFrame([(None, "w " * 60, "en", "s", 1), (None, "w " * 60, "en", "s", 1)], DOCS)
    assert substring_dedup.cut_repeats(null).count() == 2


def test_factors_are_walked_greedily(spark, docs, rows):
    a, b, c = (" ".join(f"{x}{k}" for k in range(120)) for x in "abc")
    own = [(1, f"{a} {b}"), (2, f"x y {c}"), (3, f"{a} {b} z {c} {a}"), (4, "q " + " ".join(c.split()[10:70]) + " " + " ".join(a.split()[:49]))]
    got = sorted(tuple(r) for r in substring_dedup.factors(spark.createDataFrame(own, "doc_id long, text string")).collect())
    assert got == [(3, 0, 240, 1, 0), (3, 241, 120, 2, 2), (3, 361, 120, 1, 0), (4, 1, 60, 2, 12)]
    # Factors say what they claim, and cover exactly the windows that a smaller document has.
    texts, covered = {d: words(t) for d, t in rows}, {d: set() for d, _ in rows}
    for r in substring_dedup.factors(docs).collect():
        assert r["source"] < r["doc"] and r["length"] >= 50
        assert texts[r["doc"]][r["lo"] : r["lo"] + r["length"]] == texts[r["source"]][r["at"] : r["at"] + r["length"]]
        covered[r["doc"]] |= set(range(r["lo"], r["lo"] + r["length"]))
    want = repeats_by_hand(rows, 50)
    assert all(len(covered[d]) == want[d][1] for d in covered)


def test_parse_breaks_where_the_source_does():
    n = np.array
    got = substring_dedup.parse(n([0, 0, 0, 0, 1]), n([22, 0, 40, 60, 60]), n([18, 22, 5, 2, 1]), n([7, 7, 7, 8, 8]), n([122, 100, 140, 3, 3]), 50)
    assert [tuple(int(v) for v in x) for x in zip(*got)] == [(0, 0, 94, 7, 100), (0, 60, 51, 8, 3), (1, 60, 50, 8, 3)]


def test_ends_that_differ_are_no_factor(spark):
    """A match that its source's words don't confirm, as by a collision of hashes, removes nothing."""
    rows = [(1, " ".join(f"a{k}" for k in range(60))), (2, " ".join(f"a{k}" for k in range(60))), (3, " ".join(f"b{k}" for k in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    false = spark.createDataFrame([(2, 0, 60, 1, 0), (3, 0, 60, 1, 0)], "doc long, lo long, length long, source long, at long")
    with mock.patch.object(substring_dedup, "factors", lambda docs, window: false):
        assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 60, 3: 0}


def test_rows_that_repeat_an_id_keep_their_own_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (2, f"one {a}"), (2, f"two {a}"), (2, b), (2, b)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS)
    assert sorted(r["text"].split()[0] for r in substring_dedup.cut_repeats(df).collect()) == ["a0", "b0", "b0", "one", "two"]


def test_hot_keys_are_spread(spark):
    rows = spark.range(5000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("v"))
    firsts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"))
    got = shared.spread_join(rows, firsts, ("k",), "m", "v")
    assert got.count() == 5000 and got.join(rows, ["k", "v"]).count() == 5000 and got.filter("least > v").count() == 0
    assert got.select("k", "least").distinct().count() == 7


def test_growth_of_shared_passages(spark):
    """Many documents around one passage: every later one loses it, whatever stands around it."""
    passage = " ".join(f"p{k}" for k in range(64))
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("q"), F.col("id"), F.lit(" "), F.lit(passage), F.lit(" r"), F.col("id")).alias("text"))
    got = substring_dedup.remove_repeats(df).groupBy("n_removed").count().collect()
    assert {r["n_removed"]: r["count"] for r in got} == {0: 1, 64: 199}


def test_a_row_doesnt_lose_what_another_row_of_its_id_has(spark):
    """Both rows begin and end alike; only one of them is a copy."""
    s = [f"s{k}" for k in range(60)]
    rows = [(1, " ".join(s)), (2, " ".join(s)), (2, " ".join(s[:8] + [f"x{k}" for k in range(44)] + s[52:]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], len(r["kept"].split())) for r in got) == [(1, 0, 60), (2, 0, 60), (2, 60, 0)]


def test_components_end_when_they_are_stars(spark):
    """One round for edges that are stars after it, as most of near copies are; chains and crossing links are followed to their ends."""
    r = random.Random(12)
    stars = [(k, k - k % 10) for k in range(100)]
    for edges, rounds in ((stars, 1), ([(k, k + 1) for k in range(60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)], None), ([], 1)):
        least = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in range(300):
            for a, b in edges:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        with mock.patch.object(components, "saved", side_effect=components.saved) as saved:
            got = components.connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
        assert {x["node"]: x["component"] for x in got} == least and len(got) == len(least)
        assert rounds is None or saved.call_count == rounds
