"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from axisframe.llm import shared

from .conftest import DOCS, corpus
from .test_duplicates import near_by_hand, repeats_by_hand


def test_stages(spark, tmp_path):
    item = "the small brown fox that never was seen runs over seven green hills every single morning"
    rows = [*corpus(9), (900, "before it all " + item + " and after"), (901, "12345 -- 67")]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.saved(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs)
    assert all(k.columns == ["doc_id", "text", "lang", "source", "n_chars"] for k in kept[:-1])
    texts = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept[:-1]]
    assert set(texts[0]) == {d for d, t in rows if any(c.isalpha() for c in t or "")}
    near = near_by_hand(list(texts[0].items()), 5)
    assert set(texts[1]) == {d for d, v in near.items() if v[2]}
    cut = repeats_by_hand(list(texts[1].items()), 50)
    assert {d: t.split() for d, t in texts[2].items()} == {d: v[3] for d, v in cut.items() if v[3]}
    assert set(texts[3]) == set(texts[2]) - {900}
    assert {r["doc_id"] for r in kept[-1].select("doc_id").distinct().collect()} == set(texts[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[-1].count()


def test_odd_rows(spark, tmp_path):
    """Null ids, texts and columns, rows that repeat an id, equal rows, a very long text, clashing columns, and no rows at all."""
    base, passage = corpus(4)[6][1].split(), " ".join(f"p{k}" for k in range(70))
    text = lambda k, n: " ".join(base[k : k + n])
    rows = [(None, text(0, 90)), (None, text(0, 90)), (None, None), (1, None), (1, ""), (2, text(100, 90)), (2, text(100, 90)), (3, text(200, 80)), (3, text(300, 80)), (4, text(100, 90)), (5, f"{text(400, 60)} {passage}"), (6, f"{text(500, 60)} {passage}"), (7, text(0, 9000) * 3), (8, text(600, 3))]
    schema = DOCS + ", key string, n long, spans string, item_id long"
    df = spark.createDataFrame([(d, t, None if k % 2 else "en", None, None, "k", 1, "s", 9) for k, (d, t) in enumerate(rows)], schema)
    spark.createDataFrame([(1, "nobody ever wrote this item down before it was asked for in here"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs, empty in ((df, False), (df.limit(0), True)):
        kept = {}
        for name, stage in corpus_pipeline.STAGES:
            docs = shared.saved(stage(spark, docs, str(tmp_path)), name)
            kept[name] = docs
        assert all(k.columns == df.columns for name, k in kept.items() if name != "packing")
        if empty:
            assert all(k.count() == 0 for k in kept.values())
            continue
        ids = lambda name: sorted((r["doc_id"] for r in kept[name].collect()), key=str)  # noqa: B023, E731
        assert ids("language_id") == sorted([None, None, 2, 2, 3, 3, 4, 5, 6, 7, 8], key=str)
        assert ids("near_dedup") == sorted([None, None, 2, 2, 3, 3, 5, 6, 7, 8], key=str)
        assert {r["doc_id"]: r["text"] for r in kept["substring_dedup"].collect()}[6].strip() != text(500, 60) + " " + passage
        assert ids("decontamination") == ids("substring_dedup")
        assert set(ids("packing")) == set(ids("decontamination"))
