"""Shared parts of the corpus operators: scratch tables, batch cutting, vectorised words and hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than these (space, tab, newline, vertical tab, form feed, return).
BLANKS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled at a time inside a task; a longer document is handled alone.
CHUNK_BYTES = 2_000_000
_M64 = (1 << 64) - 1
_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_own_root: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Workers find this package where they share the driver's files; Arrow batches stay small, as texts may be long."""
    spark.sparkContext.environment["PYTHONPATH"] = _REPO
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where that is unset on a local master, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = tempfile.mkdtemp(prefix="waymark-")
    return "file://" + _own_root[app]


def scratch(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/waymark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def cut_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text, or one row; nulls in `text` become empty."""
    for b in batches:
        if not b.num_rows:
            continue
        k = b.schema.get_field_index(text)
        b = b.set_column(k, text, pc.fill_null(b.column(k).cast(pa.large_string()), ""))
        ends = np.cumsum(pc.binary_length(b.column(k)).to_numpy(zero_copy_only=False))
        at, base = 0, 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            base, at = int(ends[to - 1]), to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a large_string array as one byte array, and where each begins (one more at the end)."""
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[list(BLANKS)] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, for i in 0..n."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        if len(_powers) > 8:
            _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, v, np.uint64))]) for v in (_BASE, inverse))
    return _powers[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes (after A-Z lower-casing if asked) have equal hashes wherever they stand."""
    up, down = _power_tables(len(data))
    value = _VALUE[_LOWER] if lower else _VALUE
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """The words of a slice of documents: begin and end in `data`, document and hash of each."""

    def __init__(self, col: pa.Array, lower: bool) -> None:
        self.data, self.offs = text_bytes(col)
        n = len(self.data)
        bound = np.zeros(n + 1, bool)
        bound[self.offs] = True
        solid = ~_SPACE[self.data]
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        self.start = np.flatnonzero(solid & (before | bound[:n]))
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        self.end = np.flatnonzero(solid & (after | bound[1:])) + 1
        self.doc = np.searchsorted(self.offs, self.start, "right") - 1
        self.hash = span_hashes(self.data, self.start, self.end, lower)
        self.n_docs = len(col)
        self.count = np.bincount(self.doc, minlength=self.n_docs)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of k words that lies in one document."""
        if len(self.doc) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[: len(self.doc) - k + 1] == self.doc[k - 1 :])
        h = np.zeros(len(first), np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9FB21C651E98DF25) + self.hash[first + j]
        return first, mix(h)


def shingle_sets(col: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), sorted and distinct: runs of k lower-cased words, or all words where there are fewer."""
    w = Words(col, lower=True)
    first, h = w.windows(k)
    doc = w.doc[first]
    few = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(few):
        at = np.concatenate([[0], np.cumsum(w.count)])
        short = []
        for d in few:
            v = int(w.count[d])
            for x in w.hash[at[d] : at[d + 1]].tolist():
                v = (v * 0x9FB21C651E98DF25 + x) & _M64
            short.append(v)
        doc, h = np.concatenate([doc, few]), np.concatenate([h, mix(np.array(short, np.uint64) ^ np.uint64(0x5851F42D4C957F2D))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(doc):
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[keep], h[keep]
    return doc, h
