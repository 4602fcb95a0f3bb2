"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the
columns of ``documents``; the last returns the pieces of packed sequences.
Stages are meant to be written between one another, as ``run`` does.

In every stage: an empty table gives no rows, whole texts count however long
they are, columns other than those of ``documents`` are carried along whatever
their names, and a null ``lang``, ``source`` or ``n_chars`` changes nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from axisframe.llm import decontaminate, language_id, near_dedup, packing, shared, substring_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification doesn't reject: it has letters, and some language is likely enough.

    It learns from the languages of ``docs``; without any, all documents go.
    Null and empty texts, and texts without a letter, go.  Rows with a null
    doc_id and rows that repeat one are judged each by its own text, so equal
    texts fare alike.
    """
    return language_id.accept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest doc_id, of each group of near duplicates (five-word shingles, similarity 0.8).

    Null and empty texts, texts without words, and rows with a null doc_id are
    near nothing and stay.  Rows that repeat a doc_id are one document: all
    stay or all go.
    """
    return near_dedup.keep_one_of_each(docs, words=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a document with a smaller doc_id has too.

    Documents that lose every word go; all others stay, null and empty texts
    and rows with a null doc_id unchanged.  Rows that repeat a doc_id take
    nothing from each other and keep each what is left of its own text.
    """
    return substring_dedup.cut_repeats(docs, window=50)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``.

    Null and empty texts hold none; nor do null and empty items stand in any.
    Rows with a null doc_id stay.  Rows that repeat a doc_id all go if one of
    them holds an item.
    """
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 ids.

    A null or empty text is its closing id alone.  Rows with a null doc_id and
    rows that repeat one are packed as all others; of equally long pieces, the
    one that comes first in its partition is placed first.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL can't express the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.saved(docs, name)
    return docs
