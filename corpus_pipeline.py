"""The corpus pipeline: each stage calls one operator and hands its rows to the next as a table.

Language ID rejects, near-duplicate groups keep one document, documents that
hold a benchmark item go, personal data is replaced, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtag.llm import decontaminate, language_id, minhash_dedup, packing, queries, surrogates
from loomtag.llm.common import written


def _as_before(docs: DataFrame, found: DataFrame) -> DataFrame:
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is near to a language learned from ``docs`` itself, the rows that language ID holds out
    aside. Null texts, texts without a letter and foreign ones go; repeated rows stay or go alike; a table
    without rows, or without a label, leaves none."""
    model = language_id.fit_on(docs.where(~queries.held_out()))
    found = language_id.identify(docs, model)
    return _as_before(docs, found.where(~F.col(f"`{found.columns[-1]}`")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the smallest doc_id; of rows that repeat its doc_id and text, one. Rows
    without doc_id stay, and so do null and empty texts, which are like nothing."""
    found = minhash_dedup.near_duplicates(docs)
    gone = written(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    few = gone.count() <= 500_000
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = written(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    again = F.broadcast(again) if again.count() <= 500_000 else again
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, whole or nearly so. Null and empty texts stay; repeated rows stay
    or go alike."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates for personal data; null and empty texts as they are, repeated rows alike."""
    return _as_before(docs, surrogates.replace_entities(docs, queries.SURROGATE_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's tokens, with its sequence and place there. A null or empty text is its
    end token alone, repeated rows are packed as often as they occur, and no rows give none."""
    path = queries.vocabulary("word_bpe_49k.json")
    # executors hold memory of the stages before
    return packing.pack(docs, lambda: packing.word_encoder(path, 30_000), group_docs=8192, group_tokens=1_000_000, slice_bytes=1 << 20)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Language ID and packing can't be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
