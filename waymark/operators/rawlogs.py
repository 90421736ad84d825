"""Raw logs (seq, address, topics, data, removed): which are transfers, and what they move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import binary


def classified(logs: DataFrame) -> DataFrame:
    """logs with `problem`: the first check that a transfer fails (topics, signature, data), or null."""
    word = r"'^(0x)?[0-9a-fA-F]{64}$'"
    problem = f"""CASE WHEN coalesce(size(topics), 0) < 3 OR exists(topics, t -> NOT coalesce(t RLIKE {word}, false)) THEN 'topics'
      WHEN {binary.bare('topics[0]')} <> '{binary.TRANSFER[2:]}' THEN 'signature'
      WHEN data IS NULL OR NOT {binary.is_hex('data')} OR length({binary.bare('data')}) < 64 THEN 'data' END"""
    return logs.withColumn("problem", F.expr(problem))


def transfers(logs: DataFrame) -> DataFrame:
    """seq, token, from_holder, to_holder, value, word, removed of the logs that are transfers.

    value is the exact amount as DECIMAL(38, 0), null beyond 38 digits; word has it as 64 hexadecimal digits in any case.
    """
    found = classified(logs).where("problem IS NULL").withColumn("word", F.expr(f"left({binary.bare('data')}, 64)"))
    return found.select("seq", F.expr("lower(address)").alias("token"), F.expr(binary.address_of("topics[1]")).alias("from_holder"), F.expr(binary.address_of("topics[2]")).alias("to_holder"), F.expr(binary.word_value("word")).alias("value"), "word", "removed")


def problems(logs: DataFrame) -> DataFrame:
    """problem, logs: how many logs are no transfers, by the check that they fail."""
    return classified(logs).where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("logs"))
