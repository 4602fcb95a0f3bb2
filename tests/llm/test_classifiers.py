"""Language, toxicity and quality: accuracy on rows that weren't learnt from, and odd rows."""

import random
from unittest import mock

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from axisframe.llm import language_id, quality, toxicity

SYLLABLES = {"en": "the and ing ion er re on at", "de": "der sch ung ein ich und zu ver", "es": "que ción los ado ar mente ñ", "fr": "eau les tion ou é ment que ai"}


def invented(lang, r, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."


def test_language(spark, none):
    r = random.Random(1)
    rows = [(k, invented(lang, r, r.randint(5, 60)), lang) for k, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 -- 34", "en"), (1003, invented("de", r, 30000), None), (None, invented("es", r, 30), "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)}).repartition(3)
    held = language_id.held_out(4, 2)
    model = language_id.train(df.filter(~held))
    got = {x["doc_id"]: x for x in language_id.identify(df, model).collect()}
    assert len(got) == len(rows)
    real = [(k, lang) for k, _, lang in rows[:240]]
    assert np.mean([got[k]["lang_pred"] == lang for k, lang in real]) > 0.98
    assert not any(got[k]["rejected"] for k, _ in real)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"] for k in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "de" and got[None]["lang_pred"] == "es" and all(0 <= x["score"] <= 1 for x in got.values())
    assert language_id.identify(none, model).count() == 0
    assert language_id.train(none) is None and language_id.identify(df, None).filter("rejected").count() == len(rows)
    kept = language_id.accept(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_sample_draws_rows_without_ids_and_rows_that_repeat_one_like_others(spark):
    rows = [(None, f"alpha{k} beta{k} gamma", lang) for lang in ("en", "de") for k in range(400)] + [(5, f"delta{k}", "fr") for k in range(400)]
    rows += [(6, "the same row again", "nl")] * 400
    df, seen = spark.createDataFrame(rows, "doc_id long, text string, lang string"), []
    with mock.patch.object(language_id, "_sampled", side_effect=lambda picked: seen.append({r["lang"]: r["count"] for r in picked.groupBy("lang").count().collect()}) or []):
        assert language_id.train(df, per_language=40) is None
        assert language_id.train(df, per_language=400, most_rows=160) is None
    for got in seen:
        assert all(15 < got[x] < 80 for x in ("en", "de", "fr")) and got.get("nl", 0) <= 1


def test_languages_that_were_left_out_are_rejected(spark):
    r = random.Random(6)
    rows = [(k, invented(lang, r, r.randint(20, 60)), lang) for k, lang in enumerate(["en", "de"] * 200)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(k, "".join(r.choice("бгджклмнпрст аеиоу") for _ in range(200)), None) for k in range(50)] + [(100 + k, "".join(r.choice("qxzjkvwy ") for _ in range(200)), None) for k in range(50)]
    odd += [(200 + k, invented("es", r, 60), None) for k in range(50)]
    odd += [(300 + k, invented(lang, r, 40), None) for k, lang in enumerate(["en", "de"] * 50)]
    got = language_id.identify(spark.createDataFrame(odd, "doc_id long, text string, lang string"), model).collect()
    assert all(x["rejected"] for x in got if x["doc_id"] < 200)
    assert np.mean([x["rejected"] for x in got if 200 <= x["doc_id"] < 300]) > 0.95
    assert np.mean([x["rejected"] for x in got if x["doc_id"] >= 300]) < 0.05


def test_toxicity(spark, none):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abdeghilnorst") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    rows, labels = [], []
    for k in range(900):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 150))]
        toxic = k % 5 == 0
        for _ in range(2 * toxic):
            w[r.randrange(len(w))] = r.choice(["Nasty!", "vile", "horrid,"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "vile " + " ".join(r.choice(vocabulary) for _ in range(20000)))]
    labels += [(5000, 1), (7777, 1), (3, None), (None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash")).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    fold = language_id.held_out
    model = toxicity.train(df, marks, ~fold(5, 0) & ~fold(5, 4), fold(5, 4))
    got = {x["doc_id"]: x for x in toxicity.score(df, *model).select("*", fold(5, 0).alias("held")).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
    held = [(got[k]["predicted"], t) for k, t in labels[:900] if got[k]["held"]]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    assert toxicity.score(none, *model).count() == 0
    blank = toxicity.train(none, marks.limit(0), F.lit(True), F.lit(True))
    assert {x["score"] for x in toxicity.score(df.limit(5), *blank).collect()} == {0.5}


def test_each_class_is_a_distribution_of_words():
    r = np.random.default_rng(4)
    n = r.poisson(0.7, (2, 12, 12)) * (r.random((12, 12)) < 0.6)
    n[1, 3] = 0
    n[:, 5] = 0
    both, stem = n.sum(axis=0), np.arange(12) // 3
    stems = np.stack([[x[:, stem == s].sum() for s in range(4)] for x in n])
    totals = toxicity.Totals((both > 0).sum(), (both.sum(axis=0) > 0).sum(), tuple((x > 0).sum() for x in n), tuple((x.sum(axis=0) > 0).sum() for x in n), tuple(stems.sum(axis=1)))
    entry = n * (both > 1)  # pairs that are pruned count for the words alone
    kept = entry.sum(axis=0) > 0
    p, words = [], [k for k in range(12) if both[:, k].any()] + [None]
    for v in range(12):
        for w in words:
            of = lambda x: (0, 0) if w is None else x  # noqa: B023, E731
            p.append((of(entry[:, v, w]) if w is not None else (0, 0), entry[:, v].sum(axis=1), (entry[:, v] > 0).sum(axis=1), (n[:, :, w] > 0).sum(axis=1) if w is not None else (0, 0), stems[:, stem[w]] if w is not None else (0, 0), kept[v].sum(), (both[:, w] > 0).sum() if w is not None else 0))
    args = [np.array([x[k] for x in p], float).T for k in range(7)]
    one = slice(0, len(words))
    totals.mass = tuple(m.sum() for m in toxicity.word_masses(totals, args[3][:, one], args[4][:, one], args[6][one]))
    for c in toxicity.log_probabilities(totals, *args):
        np.testing.assert_allclose(np.exp(c).reshape(12, -1).sum(axis=1), 1)


def test_toxicity_counts_are_exact(spark):
    r = random.Random(5)
    names = ["".join(r.choice("abdeghilnorst") for _ in range(9)) for _ in range(1500)]
    rows = [(f"{names[k]} common", k % 2) for k in range(1500)] + [(f"{names[k]} common; {names[k]} common", 1) for k in range(0, 900, 2)]
    pairs, words, stems = toxicity.counts(spark.createDataFrame(rows, "text string, label int").repartition(5), 12)
    # A start and a pair of each name; what leads from one pair of a repeated name to the next is in one document each.
    assert pairs.count() == 2 * 450 and {(x["ordinary"], x["toxic"]) for x in pairs.collect()} == {(1, 1)}
    best = words.orderBy(F.desc("types")).first()
    assert words.count() == 1501 and (best["ordinary"], best["toxic"], best["types"]) == (750, 750 + 450, 1500)
    assert {(x["ordinary"], x["toxic"], x["types"]) for x in words.filter("types < 1500").collect()} == {(1, 0, 1), (0, 1, 1), (1, 2, 2)}
    assert stems.agg(F.max("ordinary"), F.max("toxic")).first() == (750, 750 + 450)


def test_toxicity_scores_by_the_whole_models(spark):
    """A text's log-likelihood ratio is that of the two models word by word, however small a word's part in it."""
    r = random.Random(9)
    names = ["".join(r.choice("abdeghil") for _ in range(r.randint(5, 9))) for _ in range(60)]
    rows = [(k, " ".join(r.choice(names[: 30 + 30 * (k % 3 > 0)]) for _ in range(r.randint(0, 40))), int(k % 3 == 0)) for k in range(120)]
    pairs, words, stems = toxicity.counts(spark.createDataFrame(rows, "doc_id long, text string, label int").select("text", "label"), 12)
    docs = [(k, rows[k][1]) for k in range(60)] + [(100, f"{names[0]} zzz {names[1]} {names[2][:6]}zz"), (101, "zzz yyy"), (102, "")]
    both = []
    for most in (toxicity.TABLE_ROWS, 0):
        with mock.patch.object(toxicity, "TABLE_ROWS", most):
            model = toxicity.Model(pairs, words, stems, 12)
            both.append({x["doc_id"]: np.frombuffer(x["x"]) for x in toxicity.features(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()})
    got = both[0]
    assert all((got[k] == both[1][k]).all() for k in got) and len(got) == len(both[1]) == len(docs)

    part = next(toxicity._parts(pa.array([t for _, t in docs])))
    pair = {(x["before"], x["word"]): (x["ordinary"], x["toxic"]) for x in pairs.collect()}
    word = {x["word"]: (x["ordinary"], x["toxic"], x["types"]) for x in words.collect()}
    stem = {x["stem"]: (x["ordinary"], x["toxic"]) for x in stems.collect()}
    by_class = lambda values: tuple(sum(x[c] for x in values) for c in (0, 1))
    n_pairs = sum(x[2] for x in word.values())
    totals = toxicity.Totals(n_pairs, len(word), by_class(word.values()), tuple(sum(x[c] > 0 for x in word.values()) for c in (0, 1)), by_class(stem.values()))
    once, twice = n_pairs - len(pair), sum(sum(x) == 2 for x in pair.values())
    totals.discount = once / (once + 2 * twice)
    share = totals.class_pairs[1] / sum(totals.class_pairs)
    few = toxicity.SHARED_COUNT * share
    pair = {k: x for k, x in pair.items() if abs(np.log((x[1] + few) / (sum(x) * share + few))) >= toxicity.LEAST_SPLIT}
    none = np.zeros((2, 1))
    known = toxicity.word_masses(totals, np.array([x[:2] for x in word.values()]).T, np.array([stem[w >> 32 & 0xFFFFFFFF] for w in word]).T, np.array([x[2] for x in word.values()]))
    totals.mass = tuple(k.sum() + u[0] for k, u in zip(known, toxicity.word_masses(totals, none, none, none[0])))

    args = []
    for v, w in zip(part.before.view(np.int64).tolist(), part.word.view(np.int64).tolist()):
        of = [x for (before, _), x in pair.items() if before == v]
        args.append((pair.get((v, w), (0, 0)), by_class(of), tuple(sum(x[c] > 0 for x in of) for c in (0, 1)), word.get(w, (0, 0))[:2], stem.get(w >> 32 & 0xFFFFFFFF, (0, 0)), len(of), word.get(w, (0, 0, 0))[2]))
    ordinary, toxic = toxicity.log_probabilities(totals, *(np.array([x[k] for x in args], float).T for k in range(7)))
    assert sum(x[0] != (0, 0) for x in args) > 30
    for k, (doc, _) in enumerate(docs):
        i, j = part.of[k], part.of[k + 1]
        np.testing.assert_allclose(got[doc][0] * max(j - i, 1), (toxic - ordinary)[i:j].sum(), rtol=1e-4, atol=1e-4)


def test_toxicity_counts_what_does_not_calibrate(spark):
    rows = [(k, "all the same words" if k else "zebra") for k in range(2000)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    seen = []

    def counted(rows, buckets, counts=toxicity.counts):
        seen.append(rows.groupBy("label").count().collect())
        return counts(rows, buckets)

    with mock.patch.object(toxicity, "counts", counted):
        toxicity.train(docs, marks, F.lit(True), F.col("doc_id") % 2 == 0, most=100)
    n = {x["label"]: x["count"] for x in seen[0]}
    assert n[1] == 1000 and 850 <= n[0] < 950


def test_words_that_begin_as_toxic_ones_tell(spark):
    r = random.Random(8)
    ends = ["".join(r.choice("abdeghilnorst") for _ in range(3)) for _ in range(800)]
    rows = [(k, " ".join([*(r.choice(ends) + r.choice(ends) for _ in range(40)), *(("malus" + "p" + r.choice(ends)) for _ in range(k % 4 == 0))])) for k in range(1200)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    fold = language_id.held_out
    model = toxicity.train(docs, marks, ~fold(5, 0), fold(5, 4))
    new = spark.createDataFrame([(1, "abdabd maluspzzz ghigho"), (2, "abdabd zzzmalusp ghigho")], "doc_id long, text string")
    assert {x["doc_id"]: x["predicted"] for x in toxicity.score(new, *model).collect()} == {1: 1, 2: 0}


def test_packed_arrays_come_back():
    r = np.random.default_rng(1)
    arrays = [np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64)), r.integers(0, 300, 50), np.zeros(0, np.int64), np.array([7]), np.array([(1 << 64) - 1, 0], np.uint64)]
    for a, b in zip(arrays, toxicity._unpacked(toxicity._packed(*arrays))):
        assert (a.astype(np.uint64) == b).all() and len(a) == len(b)


def test_quality(spark, none):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        text = invented(r.choice(list(SYLLABLES)), r, r.randint(10, 120))
        good = k % 3 > 0
        rows.append((k, text if good else " ".join(w + r.choice(["###", "!!", "%%%"]) for w in text.upper().split())))
        labels.append((k, int(good)))
    rows += [(9000, None), (9001, ""), (9002, "\n\n"), (9003, invented("fr", r, 40000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).repartition(3)
    marks = spark.createDataFrame([*labels, (9000, None), (None, 1)], "doc_id long, quality int")
    held = language_id.held_out(3, 1)
    trees = quality.train(df, marks, ~held)
    got = {x["doc_id"]: x for x in quality.score(df, trees).select("*", held.alias("held")).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got.values())
    own = [(got[k]["predicted"], t) for k, t in labels if got[k]["held"]]
    assert len(own) > 100 and np.mean([a == b for a, b in own]) > 0.97
    assert quality.score(none, trees).count() == 0
    assert {x["score"] for x in quality.score(df.limit(3), quality.train(none, marks.limit(0), F.lit(True))).collect()} == {0.5}


def test_trees_are_walked_as_a_person_would():
    r = np.random.default_rng(0)
    x = r.random((500, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.grow(x, y)

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    np.testing.assert_allclose(trees.scores(x[:50]), [walk(v) for v in x[:50]])
    assert ((trees.scores(x) > 0.5) == y).mean() > 0.97
