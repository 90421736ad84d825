"""Sequence packing: non-negative least squares over shallow length combinations, then a dense packing of what is left."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.base import cut_batches, prepare, scratch
from waymark.llm.segments import PATTERN, SegmentCache
from waymark.llm.tokencount import byte_symbols

_caches: dict[str, SegmentCache] = {}


def token_cache(path: str) -> SegmentCache:
    """Segments to their ids as little-endian 32-bit integers, as the tokenizers library gives them (special strings as its default).

    Where a byte-level vocabulary numbers its merges in order, the faster tiktoken merges by those numbers, to the same ids.
    """
    if path not in _caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        quick = _by_rank(path)
        if quick:
            _caches[path] = SegmentCache(lambda segments: encode_segments(quick, segments))
        else:
            _caches[path] = SegmentCache(lambda segments: [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(segments, add_special_tokens=False)])
    return _caches[path]


def encode_segments(quick, segments: list[str]) -> list[bytes]:
    """The ids of each segment. Those that begin with white space are encoded as one text, as its tokens end where they do."""
    if not segments or not all(s[0] == " " for s in segments):
        return [np.array(quick.encode(s, allowed_special="all"), "<u4").tobytes() for s in segments]
    ids = np.array(quick.encode("".join(segments), allowed_special="all"), "<u4")
    sizes = np.array([len(s.encode()) for s in segments])
    ends = np.searchsorted(np.cumsum(quick.sizes[ids]), np.cumsum(sizes), "left") + 1
    raw, ends = ids.tobytes(), (4 * ends).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _by_rank(path: str):
    """A tiktoken encoding for a byte-level file whose vocabulary and merges have the same order, else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return None
    vocab, byte = model["vocab"], {c: b for b, c in enumerate(byte_symbols())}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    ids = [vocab[a + b] for a, b in pairs]
    if ids != sorted(set(ids)) or (ids and ids[0] < 256):
        return None
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    out = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    out.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    for t, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
        out.sizes[i] = len(t)
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, doc_id: str, text: str, window: int, all_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids: full windows (ids null unless asked for), then the rest of a document (ids binary)."""
    prepare(docs.sparkSession)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    arrow_types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = token_cache(tokenizer)
        for b in cut_batches(batches, text):
            owner, cols = [], ([], [], [], [], [])
            for i, parts in enumerate(cache.of(b.column(1).to_pylist())):
                ids = b"".join([*parts, b"\0\0\0\0"])
                n = len(ids) // 4
                for at in range(0, n, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    owner.append(i)
                    for c, v in zip(cols, (at, len(piece) // 4, zlib.crc32(piece), n, piece if all_ids or len(piece) < 4 * window else None), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, t in zip(cols, arrow_types, strict=True))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, schema)


def combinations(window: int, step: int) -> list[tuple[int, ...]]:
    """Length combinations of depth 1 to 3 that fill a window: the window, all pairs, and triples with two multiples of `step`."""
    pairs = [(a, window - a) for a in range(1, window // 2 + 1)]
    triples = {tuple(sorted((a, b, window - a - b))) for a in range(step, window, step) for b in range(step, window - a, step)}
    return [(window,), *pairs, *sorted(triples)]


def solve(hist: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 200) -> np.ndarray:
    """argmin over x >= 0 of |A x - hist|, where A counts the lengths of each combination, by cyclic coordinate descent.

    hist[l] is the number of pieces of length l. The residual is kept up to date; a step touches 1 to 3 of its entries.
    """
    uses = [np.unique(np.array(c), return_counts=True) for c in combos]
    norm = [float((m * m).sum()) for _, m in uses]
    x, rest = np.zeros(len(combos)), hist.astype(np.float64).copy()
    for _ in range(sweeps):
        moved = 0.0
        for c, (l, m) in enumerate(uses):
            new = max(0.0, x[c] + float((rest[l] * m).sum()) / norm[c])
            if (d := new - x[c]) != 0:
                rest[l] -= d * m
                x[c] = new
                moved = max(moved, abs(d))
        if moved < 0.05:
            break
    return x


def plan(hist: np.ndarray, window: int, step: int) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, np.ndarray, int]:
    """Where pieces go: intervals (length, first rank, end rank, first sequence, offset); by length the first unassigned rank
    and the position of its leftover pieces in the dense rest; and the first sequence of that rest."""
    combos = combinations(window, step)
    x = np.floor(solve(hist, combos) + 0.5).astype(np.int64)
    left, used, places, sequence = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64), [], 0
    for c in np.argsort(-x, kind="stable"):
        lengths, times = np.unique(np.array(combos[c]), return_counts=True)
        n = int(min(x[c], (left[lengths] // times).min()))
        if n <= 0:
            continue
        offset = 0
        for l in combos[c]:
            places.append((int(l), int(used[l]), int(used[l]) + n, sequence, offset))
            used[l] += n
            left[l] -= n
            offset += l
        sequence += n
    at = np.zeros(len(hist), np.int64)
    at[1:] = np.cumsum(left * np.arange(len(hist)))[:-1]
    return places, used, at, sequence


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = 1024, step: int = 64, salts: int | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of each document's tokens.

    A document's tokens are its text's ids and then id 0. Full windows stand alone; the rest of each document is combined
    with others by the rounded least-squares solution for the histogram of lengths (at most `window` counts reach the driver);
    pieces beyond it are laid end to end and cut at window ends, so only the last sequence is padded. A null or empty text
    is its single id 0; repeated rows are packed again; an empty table gives no rows; columns other than id and text are
    ignored. Pieces are ranked within their length in `salts` parts (64 if not given), so a common length is never one task's.
    with_ids adds the ids themselves (little-endian 32-bit).
    """
    spark = docs.sparkSession
    salts = salts or 64
    pieces = scratch(cut_pieces(docs, tokenizer, doc_id, text, window, with_ids)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = scratch(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")))
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[r["length"]] = r["n"]
    places, used, at, rest = plan(hist, window, step)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")  # window x salts rows at most
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(order)).join(F.broadcast(base), ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("base"))
    lengths = spark.createDataFrame([(i, int(used[i]), int(at[i])) for i in range(1, window + 1)], "length long, used long, at long")
    slots = spark.createDataFrame(places, "length long, lo long, hi long, first long, offset long")  # a few for each combination
    ranked = ranked.join(F.broadcast(lengths), "length")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    fitted = ranked.where("rank < used").alias("p").join(F.broadcast(slots.alias("s")), (F.col("p.length") == F.col("s.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    fitted = fitted.select("doc_id", "start", F.col("p.length").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", "ids")
    dense = ranked.where("rank >= used").withColumn("pos", F.expr("at + (rank - used) * length"))
    dense = dense.withColumn("room", F.expr(f"least(length, {window} - pos % {window})"))
    dense = dense.withColumn("cut", F.expr("explode(filter(array(struct(0L AS a, room AS l), struct(room AS a, length - room AS l)), c -> c.l > 0))"))
    dense = dense.withColumn("ids", F.expr("substring(ids, CAST(1 + 4 * cut.a AS INT), CAST(4 * cut.l AS INT))"))
    dense = dense.selectExpr("doc_id", "start + cut.a AS start", "cut.l AS length", "crc32(ids) AS ids_crc32", "doc_tokens", f"{rest}L + (pos + cut.a) div {window} AS sequence_id", f"(pos + cut.a) % {window} AS offset", "ids")
    return fitted.unionByName(dense).select(*out)
