"""Token counts by byte-pair merging with a heap and a linked list; no token identifiers are made."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from waymark.llm.base import cut_batches, prepare
from waymark.llm.segments import PATTERN, Generations, SegmentCache


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else 256, 257, ... in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without prefix space and normalizer is needed")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        number = {c: i for i, c in enumerate(byte_symbols())}
        for a, b in merges:
            number.setdefault(a + b, len(number))
        # By left << 32 | right: the rank of the pair and the merged symbol.
        self.rank = {number[a] << 32 | number[b]: i for i, (a, b) in enumerate(merges)}
        self.result = [number[a + b] for a, b in merges]
        self.byte = [number[c] for c in byte_symbols()]
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.known = Generations(lambda pieces: [self.merged(p) for p in pieces])
        self.cache = SegmentCache(self.segments)

    def merged(self, piece: str) -> int:
        """Initial symbols minus merges: the lowest-ranked adjacent pair is merged again and again, the leftmost first."""
        byte, rank, result = self.byte, self.rank.get, self.result
        part = [byte[b] for b in piece.encode()]
        count = n = len(part)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        now = [rank(a << 32 | b, -1) for a, b in zip(part, part[1:])]  # the rank of the pair that begins here
        now.append(-1)
        heap = [r << 32 | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if now[i] != r:
                continue  # one of the two has been merged meanwhile
            j = after[i]
            k = after[j]
            part[i] = new = result[r]
            now[j] = -1
            count -= 1
            after[i] = k
            if k < n:
                before[k] = i
                now[i] = r = rank(new << 32 | part[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = r = rank(part[h] << 32 | new, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        return count

    def segments(self, texts: list[str]) -> list[int]:
        found, specials = [], []
        for t in texts:
            n = 0
            if self.special and self.special.search(t):
                n = len(self.special.findall(t))
                found.append([x for part in self.special.split(t) for x in self.pattern.findall(part)])
            else:
                found.append(self.pattern.findall(t))
            specials.append(n)
        known = self.known.learn({x for f in found for x in f})
        return [n + sum([known[x] for x in f]) for n, f in zip(specials, found, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        return [sum(v) for v in self.cache.of(texts)]


_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 512) -> DataFrame:
    """docs without `text`, with n_bytes, n_tokens and over_limit (extra columns of those names are replaced).

    One narrow pass over whole texts. Null texts count as empty (0 tokens); repeated rows get equal counts. `tokenizer` is a
    path that every executor can read.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_bytes long, n_tokens long, over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for b in cut_batches(batches, text):
            col = b.column(b.schema.get_field_index(text))
            n = np.array(counts.count(col.to_pylist()), np.int64)
            arrays = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pc.binary_length(col).cast(pa.int64()), pa.array(n), pa.array(n > limit)], [f.name for f in keep] + ["n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, schema)
