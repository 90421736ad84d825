"""A training-data pipeline over documents: language, quality, near-duplicates, mixing, packing; each stage feeds the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import langid, mixing, neardup, packing, quality
from waymark.llm.base import scratch
from waymark.llm.queries import BYTE_BPE

#: A document stays if its words are labelled with some language with at least this mean marginal.
LEAST_LANGUAGE = 0.3


def _row_key(docs: DataFrame) -> Column:
    """A key of 128 bits of the whole row, so that decisions join back to rows even where ids repeat or are null."""
    all_ = [docs[f"`{c}`"] for c in docs.columns]
    return F.struct(F.xxhash64(*all_).alias("a"), F.xxhash64(F.lit(1), *all_).alias("b"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words have a language; the model is fitted on a bounded sample of the labelled rows.

    Null, empty and letterless texts go; long ones are judged whole; repeated rows and null ids are judged by their texts; columns of
    any name stay; an empty table gives an empty one.
    """
    columns = docs.columns
    seen = langid.identify(docs, langid.train(docs), keep_text=True)
    return seen.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose host isn't rejected.

    Null and empty texts fail; equal rows share a verdict; null hosts are judged together; an empty table gives an empty one.
    """
    facts = docs.select(_row_key(docs).alias("key"), docs["text"].alias("text"), docs["source"].alias("source"))
    bad = quality.judge(facts).where("NOT kept").select("key").distinct()
    return docs.join(bad, _row_key(docs) == bad["key"], "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Of rows that repeat an id the smallest stays (by all columns in order); rows with a null id, and those without words, are linked
    with nothing and stay; an empty table gives an empty one.
    """
    gone = neardup.link(docs.select("doc_id", "text")).where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = scratch(left.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"))
    first = left.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated sampling keeps, decided by id: rows of an id, null too, stay or go together.

    Texts without words have probability 0 and go; an empty table gives an empty one.
    """
    kept = mixing.mix(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of each document, their places, and their token ids (little-endian 32-bit).

    A null or empty text is its single end id; repeated rows are packed again; an empty table gives no rows.
    """
    return packing.pack(docs, BYTE_BPE, with_ids=True)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("mixing", mixed), ("packing", packed)]

#: No stage but the mixing has an equivalent in SQL (a learned model, hashes of sets, a tokenizer); tests hold plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
