"""URL rules: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.base import prepare, scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is 8 words of 64 bits (a cache line); a key sets one bit in each word.
_ODD = [0x47B6137B44974D91, 0x8824AD5BA2B7289D, 0x705495C72DF1424B, 0x9EFC49475C6BFB31, 0x2D8C2F5B1A3E7A4D, 0x5F4A9C3D1B27E681, 0xA3D95E7F8B1C4625, 0xC1E86B3A97D2F4B7]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or url."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or url."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(lengths: list[int]) -> str:
    """SQL: every domain suffix of `host` with every prefix of `path` that has a listed length and fits."""
    suffixes = "transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 1000000), '.'))"
    prefixes = f"transform(filter(array({', '.join(map(str, lengths))}), n -> n <= length(path)), n -> substring(path, 1, n))"
    return f"flatten(transform({suffixes}, h -> transform({prefixes}, p -> concat(h, p))))"


def bloom(keys: DataFrame, bits_per_key: int = 16, max_bytes: int = 16 << 20) -> np.ndarray:
    """The filter of keys (column `key`) as uint64 [blocks, 8]; words are made where the keys are and or-ed by block.

    The size grows with the number of keys up to max_bytes; beyond it only more false positives pass, which the join removes.
    """
    n = keys.count()
    blocks = 1 << max(0, (n * bits_per_key // 512).bit_length())
    blocks = min(blocks, max_bytes // 64)
    block = F.shiftrightunsigned(F.xxhash64("key"), 32) % blocks
    rows = keys.select(block.alias("block"), *[F.expr(_bit(o)).alias(f"b{i}") for i, o in enumerate(_ODD)])
    rows = rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"b{i}") for i in range(8)])
    out = np.zeros((blocks, 8), np.uint64)
    for r in rows.toLocalIterator():  # at most max_bytes / 64 rows
        out[r["block"]] = np.array(r[1:], np.int64).view(np.uint64)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bit(odd: int) -> str:
    """SQL: the key's bit in a word. A second hash, seeded by the word, avoids products that overflow."""
    return f"shiftleft(1L, CAST(xxhash64(key, {_signed(odd)}L) & 63 AS INT))"


def verdicts(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = 50_000) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    rules: rule (host, then a path prefix) and verdict (allow or block). A rule fits its host and all subdomains where the
    page's path starts with the rule's; the longest that fits wins (of a rule listed twice, block); pages without a rule get
    `default`. Each page offers its domain suffixes with the path prefixes of listed lengths; the Bloom filter drops nearly all
    that aren't listed, the join on the whole key drops the rest. Null urls, or those without `://`, have an empty host and path
    and fit no rule; repeated rows are judged alike; columns of pages other than the two named are ignored.
    """
    spark = pages.sparkSession
    prepare(spark)
    split_at = F.instr("rule", "/")
    listed = rules.where("rule IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    listed = scratch(listed.withColumn("path_length", F.when(split_at > 0, F.length("rule") - split_at + 1).otherwise(0)))
    lengths = sorted(r[0] for r in listed.select("path_length").distinct().collect())  # lengths of url paths
    words = bloom(listed.select(F.col("rule").alias("key")))
    shared = spark.sparkContext.broadcast(words)
    slim = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.monotonically_increasing_id().alias("uid"))
    # For each candidate: its own hash, and the 8 bits' hashes packed 6 bits each into one number.
    packed = " + ".join(f"shiftleft(xxhash64(key, {_signed(o)}L) & 63, {6 * i})" for i, o in enumerate(_ODD))
    offered = slim.withColumn("keys", F.expr(candidates(lengths) if lengths else "CAST(array() AS array<string>)"))
    offered = offered.withColumn("hashes", F.expr("transform(keys, key -> xxhash64(key))")).withColumn("bits", F.expr(f"transform(keys, key -> {packed})"))
    id_type = pages.schema[page_id].dataType.simpleString()
    schema = f"page_id {id_type}, host string, path string, uid long, hits array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            keys = b.column(4)
            h = b.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bits = b.column(6).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            block = (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) % len(table)
            maybe = np.ones(len(h), bool)
            for i in range(8):
                maybe &= (table[block, i] >> ((bits >> (6 * i)) & 63).astype(np.uint64)) & np.uint64(1) == 1
            sizes = np.diff(keys.offsets.to_numpy())
            owner = np.repeat(np.arange(b.num_rows), sizes)
            passed = np.bincount(owner[maybe], minlength=b.num_rows)
            hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(passed)]), pa.int32()), keys.flatten().filter(pa.array(maybe)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), hits], ["page_id", "host", "path", "uid", "hits"])

    seen = scratch(offered.mapInArrow(run, schema))
    hits = seen.select("uid", F.explode("hits").alias("rule"))
    known = listed.select("rule", "verdict")
    exact = hits.join(F.broadcast(known) if known.count() <= broadcast_rules else known, "rule")
    best = exact.groupBy("uid").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best"))
    out = seen.select("uid", "page_id", "host", "path").join(best, "uid", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
