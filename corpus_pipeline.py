"""A cleaning and packing pipeline over the documents, a stage for each operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, packing, quality
from tessera.llm.common import drop_written, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without letters (null and empty ones too) or of no language go.
    Rows that repeat each other or have no id are judged by their texts, each for itself. Without rows to learn from, none stays."""
    return langid.keep(docs, langid.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.7; null texts are scored as empty ones. Rows that repeat each other or have no
    id are judged by their texts, each for itself."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id. Texts without words (null and empty
    ones) are linked with nothing and stay. Where rows repeat an id, they are told apart by their sets too, and rows equal
    in both are one. Rows with a null id have nothing to be told apart by and stay."""
    found = minhash.near_duplicates(docs, with_set=True)
    n, n_ids = found.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == n_ids:
        gone = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        gone = F.broadcast(gone) if gone.count() <= minhash.BROADCAST_IDS else gone
        return docs.join(gone, "doc_id", "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
    own, kept_id, kept_set = (unused(docs, c) for c in ("own_set", "kept_id", "kept_set"))
    stay = found.where("kept").groupBy("doc_id", "part").agg(F.min("k").alias(kept_set)).select(F.col("doc_id").alias(kept_id), kept_set)
    rows = minhash.with_set_keys(docs.where("doc_id is not null"), name=own).dropDuplicates(["doc_id", own])
    left = rows.join(stay, (F.col("doc_id") == F.col(kept_id)) & F.col(own).eqNullSafe(F.col(kept_set)), "left_semi")
    return left.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a null or empty text is its end mark alone, rows that repeat each other are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("quality", good), ("near_dedup", distinct), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages after one another; a stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = written(stage(spark, docs, sf_dir), name)
        drop_written(docs)
        docs = after
    return docs
