"""From raw documents to packed training sequences: five stages, each one operator of `pulsegrid.llm`.

Each stage works on all that the one before kept, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import near_dedup, packing, quality_classifier, source_mixing, suffix_dedup
from pulsegrid.llm.common import stored, table


TEXT, ROW = "_text_md5", "_row"      # columns a stage adds for its own use
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51     # a passage goes from so many bytes and words on; 51 words of three letters have 200 bytes


def _only(docs: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """The rows of `docs` whose `key`, nulls included, is among `wanted`."""
    wanted = wanted.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(key)]).distinct()
    same = [docs[c].eqNullSafe(wanted[f"_w{i}"]) for i, c in enumerate(key)]
    return docs.join(wanted, reduce(Column.__and__, same), "left_semi")


def _with_text(docs: DataFrame) -> DataFrame:
    """With the hash of the text, which tells rows of one doc_id, or without one, apart; null for a null text."""
    return docs.withColumn(TEXT, F.md5(F.col("text").cast("binary")))


def _with_row(docs: DataFrame) -> DataFrame:
    """With an id of the pair of doc_id and text: the doc_id, and a hash of both for further texts under one doc_id."""
    text = F.coalesce(TEXT, F.lit(""))
    docs = _with_text(docs)
    several = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.min(text).alias("_low"), F.max(text).alias("_high")).where("_low < _high")
    several = stored(several.select("_id", "_low"), "several-texts")
    further = F.col("_low").isNotNull() & (text != F.col("_low"))
    row = F.when(further, F.xxhash64("doc_id", text)).otherwise(F.col("doc_id").cast("bigint"))
    return docs.join(several, docs["doc_id"] == several["_id"], "left").withColumn(ROW, row).drop("_id", "_low", TEXT)


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where the table has both."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality classifier rejects, each by its own text."""
    docs = _with_text(docs)
    scores = quality_classifier.quality_scores(docs, table(spark, sf_dir, "labels"), TEXT)
    return _only(docs, stored(scores.where("predicted = 1").select("doc_id", TEXT), "good"), "doc_id", TEXT).drop(TEXT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text of each near-duplicate component, and one row of it; rows without doc_id stay.

    Texts that share a doc_id are told apart: each is dropped only where it is itself a near copy.
    """
    known = _with_row(docs.where("doc_id IS NOT NULL"))
    kept = near_dedup.near_duplicates(known.select(F.col(ROW).alias("doc_id"), "text")).where("kept")
    known = _only(known, kept.select(F.col("doc_id").alias(ROW)), ROW).dropDuplicates([ROW]).drop(ROW)
    return known.unionByName(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words, of 200 bytes at least, that occur elsewhere out of the texts."""
    return _sized(suffix_dedup.without_repeats(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often, and as far, as the mix takes it: a row per round."""
    return _sized(source_mixing.mixed_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; the result has a row per piece."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

# Trained models, hashes and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written once and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
