"""Language-model scores by logistic context mixing over the bits of words.

Several hashed-context predictors give a bit's odds; gated weights mix them in the logistic domain, learned online; an adaptive
table refines the mixed probability. A token is its lower-cased bytes and a terminator; the end of a text is a terminator alone,
so the token probabilities sum to one.

The first three symbols of a token are predicted with the class of the last frequent word before it, the others within the token
only. So a token's score is that of its (class, first symbols) plus that of its other symbols: the former are few, the latter
belong to the distinct word, whatever the text. Low orders have hashed tables of fixed size. The whole-prefix predictor has
exact counts that grow with the words: words are dealt by their first bytes, so that the counts of a longer prefix are in one
place; those of prefixes that words in several places share are counted by themselves and joined in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.base import Words, cut_batches, mix, prepare, scratch

#: Hashed tables, of 2**bits slots: 1, 2, 3 and 4 bytes before (with the token's start); class and the symbols before (first three only).
TABLE_BITS = (17, 19, 20, 21, 19)
ORDERS, CLASS = 4, 4
BASES = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
SLOTS = int(BASES[-1])
#: Slots are summed by blocks; all bits of a context lie in one block.
BLOCK_BITS = 16
#: Inputs of the mixer: the five tables, the whole prefix, a constant.
PREFIX, INPUTS = 5, 7
#: Symbols of a token that the class before it helps to predict.
HEAD = 3
#: Words are dealt by so many first bytes; where the distinct words that share them have more than MOST_ALIKE symbols, by the next number, at
#: last by the whole word. The first number is also the least length of a prefix with counts of its own.
LEVELS = (4, 6, 9, 14, 24, 48)
MOST_ALIKE = 400_000
WHOLE_WORD = 1 << 30
#: Frequent words that serve as a context for what follows them.
CLASSES = 96
#: Pseudo-counts of either bit.
PRIOR = 0.1
#: Gates: position (three of the head, later, later without prefix counts) x how often the leading context was seen (8) x order 3 or 4 known well (2).
GATES = 80
_APM = 33
TERMINATOR = 32
_ODD, _SALT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xC2B2AE3D27D4EB4F)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


class Edges:
    """The distinct (class, prefix, next symbol) of tokens, side by side by prefix: contexts, counts, and the edge of each symbol.

    size, symbols: the tokens' symbols one after another; cls, n: class and count of each token; only symbols from position
    `first` on are taken. depth: from which position on no other shard has a token's prefix; above: (prefix, byte, n) of all shards
    for the prefixes before it.
    """

    def __init__(
        self, size: np.ndarray, symbols: np.ndarray, n: np.ndarray, cls: np.ndarray | None = None, first: int = 0, depth: np.ndarray | None = None, above: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    ) -> None:
        token = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        at = np.arange(len(token)) - begin[token]
        byte = symbols.astype(np.uint64)

        def back(k: int) -> np.ndarray:
            out = np.zeros(len(byte), np.uint64)
            out[k:] = np.where(at[k:] >= k, byte[:-k] + np.uint64(1), np.uint64(0))
            return out

        power = np.cumprod(np.full(int(size.max()) + 1 if len(size) else 1, 0x9E3779B97F4A7C15, np.uint64))
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((byte + np.uint64(1)) * power[at])])
        prefix = running[:-1] - running[begin[token]]
        if cls is not None:
            prefix = prefix + (cls[token].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        keys, k = [back(1)], np.uint64(257)
        for j in range(2, ORDERS + 1):
            keys.append(keys[-1] * k + back(j))
        if first:
            some = at >= first
            token, at, byte, prefix, keys = token[some], at[some], byte[some], prefix[some], [v[some] for v in keys]
        order = np.lexsort((byte, prefix))
        p, b = prefix[order], byte[order]
        new = np.ones(len(order), bool)
        new[1:] = (p[1:] != p[:-1]) | (b[1:] != b[:-1])
        edge = np.cumsum(new) - 1
        some = order[new]
        self.of_symbol = np.empty(len(order), np.int64)
        self.of_symbol[order] = edge
        self.token, self.n_tokens = token, len(size)
        self.n = np.bincount(edge, weights=n[token[order]], minlength=len(some)) if len(some) else np.zeros(0)
        self.prefix, self.byte, self.pos = p[new], b[new].astype(np.int64), at[some]
        self.whole = self.pos >= LEVELS[0] if depth is not None else np.zeros(len(some), bool)
        self.shared = self.whole & (self.pos < depth[token[some]]) if depth is not None else self.whole
        self.above = above
        self.contexts = [context(i, v[some]) for i, v in enumerate(keys)]
        self.classed = context(CLASS, self.prefix) if cls is not None else None

    def __len__(self) -> int:
        return len(self.byte)

    def prefix_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones [8, edges] that the tokens show at each bit of an edge, after its prefix and the bits before."""
        if not len(self):
            return np.zeros((8, 0)), np.zeros((8, 0))
        prefix, byte, n, order = self.prefix, self.byte, np.where(self.shared, 0, self.n), None
        if self.above is not None and len(self.above[0]):
            prefix, byte, n = (np.concatenate(v) for v in zip((prefix, byte, n), self.above, strict=True))
            order = np.lexsort((byte, prefix))
            prefix, byte, n = prefix[order], byte[order], n[order]
        zeros, ones = np.zeros((8, len(byte))), np.zeros((8, len(byte)))
        other = np.ones(len(byte), bool)
        other[1:] = prefix[1:] != prefix[:-1]
        for j in range(8):
            above = byte >> (8 - j)
            new = other.copy()
            new[1:] |= above[1:] != above[:-1]
            start, back = np.flatnonzero(new), np.cumsum(new) - 1
            one = np.add.reduceat(np.where(byte >> (7 - j) & 1, n, 0), start)
            ones[j] = one[back]
            zeros[j] = (np.add.reduceat(n, start) - one)[back]
        if order is None:
            return zeros, ones
        own = np.argsort(order)[: len(self)]
        return zeros[:, own], ones[:, own]


def context(i: int, key: np.ndarray) -> np.ndarray:
    """The hash of a context, with its table in the top three bits."""
    return mix(key * np.uint64(0xD1342543DE82EF95) + np.uint64(i + 1)) >> np.uint64(3) | np.uint64(i << 61)


def slots(i: int, ctx: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Slots [8, n] of the bits of `byte` in table i: the block by the context, the place in it by the bits before too."""
    bits = min(BLOCK_BITS, TABLE_BITS[i])
    node = ((byte | 256)[None, :] >> np.arange(8, 0, -1)[:, None]).astype(np.uint64)  # 1 and the bits before
    place = ((ctx[None, :] ^ node * _SALT) * _ODD) >> np.uint64(64 - bits)
    block = (ctx & np.uint64((1 << TABLE_BITS[i] - bits) - 1)) << np.uint64(bits)
    return (place + block[None, :]).astype(np.int64) + BASES[i]


@dataclass
class Model:
    """Counts of zeros and ones by slot, mixing weights by gate, the refinement by gate and stretched probability, frequent words' hashes (sorted)."""

    zeros: np.ndarray
    ones: np.ndarray
    weights: np.ndarray
    refine: np.ndarray
    frequent: np.ndarray

    def inputs(self, e: Edges, part: slice, counts: tuple[np.ndarray, np.ndarray] | None, left_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched predictions [INPUTS, 8, n], gates and bits [8, n] of a part of the edges; one occurrence of a seen edge can be left out of all counts."""
        byte, pos, whole = e.byte[part], e.pos[part], e.whole[part]
        bit = byte[None, :] >> np.arange(7, -1, -1)[:, None] & 1
        own = (e.n[part] > 0)[None, :] if left_out else np.zeros((1, len(byte)), bool)
        x = np.zeros((INPUTS, 8, len(byte)), np.float32)
        x[-1] = 0.3
        mass: dict[int, np.ndarray] = {}

        def put(i: int, zeros: np.ndarray, ones: np.ndarray, on: np.ndarray | None = None) -> None:
            zeros = np.maximum(zeros - (own & (bit == 0)), 0)
            ones = np.maximum(ones - (own & (bit == 1)), 0)
            odds = np.log((ones + PRIOR) / (zeros + PRIOR))
            x[i] = odds if on is None else np.where(on[None, :], odds, 0)
            mass[i] = np.log2(zeros + ones + 1)

        head = pos < HEAD
        for i in range(ORDERS):
            at = slots(i, e.contexts[i][part], byte)
            put(i, self.zeros[at], self.ones[at], ~head if i == ORDERS - 1 else None)
        if counts is not None:
            put(PREFIX, counts[0][:, part], counts[1][:, part], whole)
            lead, known, kind = np.where(whole[None, :], mass[PREFIX], mass[3]), mass[3] > 1.6, np.where(whole, 3, 4)
        else:
            at = slots(CLASS, e.classed[part], byte)
            put(CLASS, self.zeros[at], self.ones[at])
            lead, known, kind = mass[CLASS], mass[2] >= 3, pos
        return x, kind[None, :] * 16 + np.minimum(lead, 7).astype(np.int64) * 2 + known, bit

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * self.weights.T.take(gate, axis=1)).sum(0), -12, 12)

    def refined(self, s: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The mean of the mixed probability and what the refinement table holds between its two nearest entries."""
        pos = (s + 12) * (_APM - 1) / 24
        low = np.minimum(pos.astype(np.int64), _APM - 2)
        part = pos - low
        table = self.refine[gate, low] * (1 - part) + self.refine[gate, low + 1] * part
        return np.clip((squash(s) + table) / 2, 1e-6, 1 - 1e-6)

    def token_scores(self, e: Edges, prefixed: bool, at_once: int = 16_384) -> np.ndarray:
        """log10 probability of each token's symbols (of those that the edges have)."""
        each, counts = np.zeros(len(e)), e.prefix_counts() if prefixed else None
        for a in range(0, len(e), at_once):
            part = slice(a, a + at_once)
            x, gate, bit = self.inputs(e, part, counts, False)
            p = self.refined(self.mixed(x, gate), gate)
            each[part] = np.log10(np.where(bit == 1, p, 1 - p)).sum(0)
        return np.bincount(e.token, weights=each[e.of_symbol], minlength=e.n_tokens).astype(float)  # integers where no token has such symbols


def first_model(frequent: np.ndarray) -> Model:
    weights = np.full((GATES, INPUTS), 0.3, np.float32)
    centres = squash(np.linspace(-12, 12, _APM))
    return Model(np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32), weights, np.tile(centres, (GATES, 1)), frequent)


class Tokens:
    """Words of a slice of documents, lower-cased, with the class before each and before each document's end, and their heads."""

    def __init__(self, col: pa.Array, frequent: np.ndarray) -> None:
        w = Words(col, lower=True)
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        self.data, self.words = low[w.data] if len(w.data) else w.data, w
        if len(frequent) and len(w.hash):
            at = np.minimum(np.searchsorted(frequent, w.hash), len(frequent) - 1)
            hit = frequent[at] == w.hash
        else:
            at, hit = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), bool)
        # The class before each word: that of the last frequent word before it in its document, else 0.
        i = np.arange(len(w.hash))
        mark = np.where(hit, i, -1)
        upto = np.maximum.accumulate(mark) if len(mark) else mark
        begin = np.concatenate([[0], np.cumsum(w.count)])
        prev = np.concatenate([[-1], upto[:-1]]) if len(upto) else upto
        self.cls = np.where(prev >= begin[w.doc], at[np.maximum(prev, 0)] + 1, 0) if len(prev) else np.zeros(0, np.int64)
        final = upto[begin[1:] - 1] if len(upto) else np.full(w.n_docs, -1)
        ok = (w.count > 0) & (final >= begin[:-1])
        self.end_cls = np.where(ok, (at[np.maximum(final, 0)] if len(at) else 0) + 1, 0)

    def heads(self) -> np.ndarray:
        """Class and the first HEAD symbols of each word as one number; 9 bits a symbol, 0 where there is none."""
        w, out = self.words, self.cls.astype(np.int64)
        size = w.end - w.start
        for j in range(HEAD):
            inside = self.data[np.minimum(w.start + j, max(len(self.data) - 1, 0))].astype(np.int64) + 1 if len(self.data) else np.zeros(0, np.int64)
            out = out << 9 | np.where(j < size, inside, np.where(j == size, TERMINATOR + 1, 0))
        return out

    def ends(self) -> np.ndarray:
        return self.end_cls.astype(np.int64) << 9 * HEAD | TERMINATOR + 1 << 9 * (HEAD - 1)


def head_edges(keys: np.ndarray, n: np.ndarray) -> Edges:
    """The edges of Tokens.heads()."""
    each = np.stack([keys >> 9 * (HEAD - 1 - j) & 511 for j in range(HEAD)], 1)
    return Edges((each > 0).sum(1), each[each > 0] - 1, n, keys >> 9 * HEAD)


def word_edges(words: pa.Array, n: np.ndarray, first: int = HEAD, depth: np.ndarray | None = None, above: pa.Table | None = None) -> Edges:
    """The edges of words (binary) from position `first` on; above: prefix, byte, n."""
    raw, ends = words.to_pylist(), np.full(1, TERMINATOR, np.uint8).tobytes()
    size = np.array([len(x) + 1 for x in raw], np.int64)
    known = (above["prefix"].to_numpy().view(np.uint64), above["byte"].to_numpy().astype(np.int64), above["n"].to_numpy().astype(float)) if above is not None else None
    return Edges(size, np.frombuffer(ends.join([*raw, b""]), np.uint8), n, None, first, depth, known)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 60_000, size: int = 2_000_000) -> Iterator[pa.Table]:
    """The batches put together, up to so many rows or bytes."""
    held, n, m = [], 0, 0
    for b in batches:
        held.append(b)
        n, m = n + b.num_rows, m + b.nbytes
        if n >= rows or m >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n, m = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def word_counts(docs: DataFrame) -> DataFrame:
    """h, word, n: the distinct lower-cased words of docs (text, learn), and how often the rows to learn from have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "text", 1_000_000):
            t = Tokens(b.column(0), np.zeros(0, np.uint64))
            w = t.words
            h, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
            n = np.bincount(back, weights=b.column(1).to_numpy(zero_copy_only=False)[w.doc], minlength=len(h))
            raw = t.data.tobytes()
            words = [raw[x:y] for x, y in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(words, pa.binary()), pa.array(n.astype(np.int64))], ["h", "word", "n"])

    found = docs.select("text", "learn").mapInArrow(run, "h long, word binary, n long")
    return found.groupBy("h", "word").agg(F.sum("n").alias("n"))


def placed(docs: DataFrame) -> DataFrame:
    """docs with `_place`, file and row, the same whenever they are read; what isn't a table of files is written first."""
    at = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.withColumn("_place", at)
    except AnalysisException:
        return scratch(docs).withColumn("_place", at)


def place(of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in sorted `of`, and whether it is there."""
    if not len(of):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return at, of[at] == keys


def head_counts_and_asks(docs: DataFrame, frequent: np.ndarray, common: np.ndarray) -> DataFrame:
    """chunk, key, n: by chunk of docs (text, learn, chunk) the hashes of its words but the common (n 0); for chunk -1 heads and their counts."""

    def rows(chunk: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), chunk)), pa.array(key), pa.array(n.astype(np.int64))], ["chunk", "key", "n"])

    def asks(chunk: int, met: list[np.ndarray]) -> pa.RecordBatch:
        h = np.unique(np.concatenate(met))
        h = h[~place(common, h)[1]].view(np.int64)
        return rows(chunk, h, np.zeros(len(h)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, met = -1, []  # the chunk at hand and its words so far; a chunk that two tasks read asks twice
        for b in cut_batches(batches, "text", 1_000_000):
            t = Tokens(b.column(0), frequent)
            w, learn = t.words, b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            each = b.column(2).to_numpy()
            for c in np.unique(each).tolist():
                if c != now and met:
                    yield asks(now, met)
                    met = []
                now = c
                met.append(np.unique(w.hash[each[w.doc] == c]))
            yield rows(-1, *np.unique(np.concatenate([t.heads()[learn[w.doc]], t.ends()[learn]]), return_counts=True))
        if met:
            yield asks(now, met)

    return docs.select("text", "learn", "chunk").mapInArrow(run, "chunk long, key long, n long")


def common_from(words: DataFrame, most: int) -> int:
    """The least power of two such that at most `most` of the words occur so often or more."""
    by = sorted(((r["b"], r["count"]) for r in words.groupBy(F.floor(F.log2("n")).alias("b")).count().collect()), reverse=True)
    cut, held = 1 << 62, 0
    for b, n in by:
        held += n
        if held > most:
            break
        cut = 1 << b
    return cut


def dealt_words(words: DataFrame, per_shard: int = 500_000, most_alike: int = MOST_ALIKE) -> DataFrame:
    """words with depth and shard: words that share their first `depth` bytes are in one shard, and several never have more than most_alike symbols.

    Symbols of distinct words by their first bytes name the crowded beginnings (at most all symbols / most_alike); their words go by more bytes.
    """
    symbols = F.sum(F.length("word") + 1)
    total = words.agg(F.coalesce(symbols, F.lit(0))).first()[0]
    crowded = None  # beginnings of the level before
    depth = F.lit(WHOLE_WORD)
    rest = words.select("word")
    steps = []
    for level in LEVELS:
        if crowded is not None:
            rest = rest.join(near(crowded), F.substring("word", 1, before) == F.col("_head"), "left_semi")
        crowded = scratch(rest.groupBy(F.substring("word", 1, level).alias("_head")).agg(symbols.alias("m"), F.count("*").alias("n")).where((F.col("m") > most_alike) & (F.col("n") > 1)).select("_head"))
        before = level
        steps.append((level, crowded))
        if crowded.isEmpty():
            break
    # A word goes by the first level at which its beginning is not crowded.
    out = words
    for level, heads in steps:
        marked = near(heads).withColumn(f"_c{level}", F.lit(True))
        out = out.join(marked, F.substring("word", 1, level) == F.col("_head"), "left").drop("_head")
    for level, _ in reversed(steps):
        depth = F.when(F.col(f"_c{level}").isNull(), F.lit(level)).otherwise(depth)
    out = out.withColumn("depth", depth).drop(*[f"_c{level}" for level, _ in steps])
    beginning = F.when(F.col("depth") < WHOLE_WORD, F.expr("substring(word, 1, depth)")).otherwise(F.col("word"))
    return out.withColumn("shard", F.pmod(F.xxhash64(beginning), F.lit(max(1, -(-total // per_shard)))))


def shared_counts(words: DataFrame) -> DataFrame:
    """shard, prefix, byte, n: what follows the prefixes that words of several shards may share (from LEVELS[0] up to depth), counted over all
    words, for each shard that has the prefix. Only words with a crowded beginning have such prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            e = word_edges(t.column("word"), t.column("n").to_numpy().astype(float), LEVELS[0], t.column("depth").to_numpy())
            # Words of several shards come together here, so an edge is told for each of its shards.
            some = e.shared[e.of_symbol]
            edge, token = e.of_symbol[some], e.token[some]
            shard, n = t.column("shard").to_numpy()[token], t.column("n").to_numpy()[token]
            order = np.lexsort((edge, shard))
            edge, shard, n = edge[order], shard[order], n[order]
            new = np.ones(len(edge), bool)
            new[1:] = (edge[1:] != edge[:-1]) | (shard[1:] != shard[:-1])
            n = np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n
            yield pa.RecordBatch.from_arrays([pa.array(shard[new]), pa.array(e.prefix[edge[new]].view(np.int64)), pa.array(e.byte[edge[new]].astype(np.int32)), pa.array(n)], ["shard", "prefix", "byte", "n"])

    found = words.where(F.col("depth") > LEVELS[0]).select("word", "n", "depth", "shard").mapInArrow(run, "shard long, prefix long, byte int, n long")
    found = scratch(found.groupBy("shard", "prefix", "byte").agg(F.sum("n").alias("n")))
    counts = found.groupBy("prefix", "byte").agg(F.sum("n").alias("n")).where("n > 0")
    return scratch(found.select("shard", "prefix").distinct().join(counts, "prefix").select("shard", "prefix", "byte", "n"))


def near(small: DataFrame, rows: int = 10_000) -> DataFrame:
    """small, broadcast if it has few rows (they are counted)."""
    return F.broadcast(small) if small.count() <= rows else small


def context_counts(words: DataFrame, heads: DataFrame) -> DataFrame:
    """ctx, byte, n: how often each symbol follows each hashed context; summed by batch, then by Spark."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ctx, byte, n = (np.concatenate(v) for v in zip(*parts, strict=True))
        order = np.lexsort((byte, ctx))
        ctx, byte, n = ctx[order], byte[order], n[order]
        new = np.ones(len(ctx), bool)
        new[1:] = (ctx[1:] != ctx[:-1]) | (byte[1:] != byte[:-1])
        n = np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n
        return pa.RecordBatch.from_arrays([pa.array(ctx[new].view(np.int64)), pa.array(byte[new].astype(np.int32)), pa.array(n.astype(np.int64))], ["ctx", "byte", "n"])

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, 200_000):
            e = word_edges(t.column("word"), t.column("n").to_numpy().astype(float), 0)
            yield summed([(c, e.byte, e.n) for c in e.contexts])

    def of_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches, 200_000):
            e = head_edges(t.column("key").to_numpy(), t.column("n").to_numpy().astype(float))
            ends = (e.pos == 0) & (e.byte == TERMINATOR)  # the end token is in no word
            yield summed([(e.classed, e.byte, e.n), *((c[ends], e.byte[ends], e.n[ends]) for c in e.contexts)])

    schema = "ctx long, byte int, n long"
    found = words.where("n > 0").select("word", "n").mapInArrow(of_words, schema).unionByName(heads.mapInArrow(of_heads, schema))
    return found.groupBy("ctx", "byte").agg(F.sum("n").alias("n"))


def filled_tables(counts: DataFrame, about: int, rows_per_group: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones by slot: blocks of 2**BLOCK_BITS slots are summed in groups of bounded size, the groups' blocks once more.

    about: how many rows counts has, roughly; the number of groups follows it.

    The tables are of fixed size (8 bytes a slot, 35 MB), whatever the input.
    """
    table = F.shiftrightunsigned("ctx", 61)
    blocks = F.array(*[F.lit((1 << max(0, b - BLOCK_BITS)) - 1) for b in TABLE_BITS])
    block = F.col("ctx").bitwiseAND(F.get(blocks, table.cast("int")))
    salts = max(1, -(-about // (rows_per_group * 64)))
    keyed = counts.select(table.cast("int").alias("i"), block.alias("block"), F.pmod(F.xxhash64("ctx", "byte"), F.lit(salts)).alias("salt"), "ctx", "byte", "n")

    def fill(key, t):
        i, block = key[0].as_py(), key[1].as_py()
        low = int(BASES[i]) + (block << min(BLOCK_BITS, TABLE_BITS[i]))
        both = np.zeros((2, 1 << min(BLOCK_BITS, TABLE_BITS[i])))
        ctx, byte, n = t.column("ctx").to_numpy().view(np.uint64), t.column("byte").to_numpy().astype(np.int64), t.column("n").to_numpy().astype(float)
        for a in range(0, len(ctx), 100_000):
            part = slice(a, a + 100_000)
            at = slots(i, ctx[part], byte[part]) - low
            bit = byte[part][None, :] >> np.arange(7, -1, -1)[:, None] & 1
            own = np.broadcast_to(n[part], at.shape)
            for v in (0, 1):
                both[v] += np.bincount(at[bit == v], weights=own[bit == v], minlength=both.shape[1])
        return pa.table({"low": [low], "sums": pa.array([both.astype(np.float32).tobytes()], pa.binary())})

    def add(key, t):
        whole = sum(np.frombuffer(x.as_py(), np.float32).astype(float) for x in t.column("sums"))
        return pa.table({"low": t.column("low")[:1], "sums": pa.array([whole.astype(np.float32).tobytes()], pa.binary())})

    zeros, ones = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)
    parts = keyed.groupBy("i", "block", "salt").applyInArrow(fill, "low long, sums binary")
    if salts > 1:
        parts = parts.groupBy("low").applyInArrow(add, "low long, sums binary")
    for r in parts.collect():  # the tables' size
        both = np.frombuffer(r["sums"], np.float32).reshape(2, -1)
        at = slice(r["low"], r["low"] + both.shape[1])
        zeros[at], ones[at] = both
    return zeros, ones


#: The values that learning sums over tasks: weights times mass, mass, refinement ones and totals.
_SHAPES = [(GATES, INPUTS), (GATES,), (GATES, _APM), (GATES, _APM)]


def learn(m: Model, e: Edges, prefixed: bool, batch: int = 1024, rate: float = 0.02) -> list[np.ndarray]:
    """Online logistic mixing over the seen edges in their order, each occurrence left out of its own counts; then the refinement sums."""
    m = Model(m.zeros, m.ones, m.weights.astype(float), m.refine, m.frequent)
    grown = np.full((GATES, INPUTS), 1e-3)
    out = [np.zeros(s) for s in _SHAPES]
    counts = e.prefix_counts() if prefixed else None
    for a in range(0, len(e), batch):
        part = slice(a, a + batch)
        own = np.broadcast_to(e.n[part], (8, len(e.n[part]))).ravel()
        if not own.any():
            continue
        x, gate, bit = m.inputs(e, part, counts, True)
        x, gate, bit = x.reshape(INPUTS, -1), gate.ravel(), bit.ravel()
        s = m.mixed(x, gate)
        err = (bit - squash(s)) * own
        for j in range(INPUTS):
            g = np.bincount(gate, weights=err * x[j], minlength=GATES)
            grown[:, j] += g * g
            m.weights[:, j] += rate * g / np.sqrt(grown[:, j])
        near_ = np.clip(np.rint((s + 12) * (_APM - 1) / 24), 0, _APM - 1).astype(np.int64) + gate * _APM
        out[1] += np.bincount(gate, weights=own, minlength=GATES)
        out[2] += np.bincount(near_, weights=own * bit, minlength=GATES * _APM).reshape(GATES, _APM)
        out[3] += np.bincount(near_, weights=own, minlength=GATES * _APM).reshape(GATES, _APM)
    out[0] = m.weights * out[1][:, None]
    return out


def joined(model: Model, sums: np.ndarray) -> Model:
    """The model with the tasks' weights averaged by mass and their refinement sums added; sums: the values of learn(), flat."""
    ends = np.cumsum([int(np.prod(s)) for s in _SHAPES])
    weights, mass, right, total = (v.reshape(s) for v, s in zip(np.split(sums, ends[:-1]), _SHAPES, strict=True))
    met = mass > 0
    model.weights[met] = (weights[met] / mass[met][:, None]).astype(np.float32)
    model.refine = (right + 8 * model.refine) / (total + 8)
    return model


def fit(spark: SparkSession, words: DataFrame, above: DataFrame, heads: DataFrame, frequent: np.ndarray) -> Model:
    """The model of all words (word, n, depth, shard), what is known of prefixes above them (shared_counts) and heads (key, n).

    The tables of the low orders come to the driver and go to the tasks (fixed size); weights are learned by shard, and Spark
    sums the shards' values, so that the driver gets one row for each of about 6,000 values.
    """
    model = first_model(frequent)
    model.zeros, model.ones = filled_tables(context_counts(words, heads), 4 * ORDERS * words.count())
    shared = spark.sparkContext.broadcast(model)

    def rows(out: list[np.ndarray]) -> pa.Table:
        flat = np.concatenate([v.ravel() for v in out])
        at = np.flatnonzero(flat)
        return pa.table({"at": pa.array(at.astype(np.int32)), "v": pa.array(flat[at])})

    def of_words(t: pa.Table, known: pa.Table) -> pa.Table:
        t = t.sort_by("word")
        return rows(learn(shared.value, word_edges(t.column("word"), t.column("n").to_numpy().astype(float), HEAD, t.column("depth").to_numpy(), known), True))

    def of_heads(t: pa.Table) -> pa.Table:
        return rows(learn(shared.value, head_edges(t.column("key").to_numpy(), t.column("n").to_numpy().astype(float)), False))

    parts = max(1, -(-heads.count() // 100_000))
    a = words.where("n > 0").select("word", "n", "depth", "shard").groupBy("shard").cogroup(above.groupBy("shard")).applyInArrow(of_words, "at int, v double")
    b = heads.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("shard").applyInArrow(lambda t: of_heads(t.sort_by("key")), "at int, v double")
    sums = np.zeros(sum(int(np.prod(s)) for s in _SHAPES))
    for r in a.unionByName(b).groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[r["at"]] = r["v"]
    shared.destroy()
    return joined(model, sums)


class Remembered:
    """Scores of heads met before by this worker; at most `most`, then it starts again."""

    def __init__(self, most: int = 1_000_000) -> None:
        self.most, self.model, self.keys, self.values = most, None, np.zeros(0, np.int64), np.zeros(0)

    def of(self, model: Model, keys: np.ndarray) -> np.ndarray:
        """keys: sorted and distinct."""
        if self.model is not model:
            self.__init__(self.most)
            self.model = model
        at = np.searchsorted(self.keys, keys)
        met = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        met[inside] = self.keys[at[inside]] == keys[inside]
        out = np.empty(len(keys))
        out[met] = self.values[at[met]]
        new = np.flatnonzero(~met)
        out[new] = model.token_scores(head_edges(keys[new], np.zeros(len(new))), False)
        if len(self.keys) + len(new) > self.most:
            self.keys, self.values = keys, out
        else:
            self.keys, self.values = np.insert(self.keys, at[new], keys[new]), np.insert(self.values, at[new], out[new])
        return out


_remembered = Remembered()


def score(docs: DataFrame, learn_from: Column, text: str = "text", chunk_bytes: int = 32_000_000, most_common: int = 1 << 16, most_alike: int = MOST_ALIKE) -> DataFrame:
    """docs' columns but the text, with n_bytes, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    learn_from: which rows the model and the counts are made of (null: not). Tokens are the lower-cased (A-Z) words and one end;
    base_score sums log10((c+1)/(N+1*(V+1))), with c a token's count, N all and V the distinct training tokens. score is the
    model's log10 probability of the tokens' symbols. Null texts are empty (the end alone); a text of any length is handled
    whole, by symbols, in whatever number of shards its words lie; repeated rows score alike; without training rows N is 0 and the model is the first guess; an empty table
    gives no rows; extra columns of these names are replaced, others are kept, whatever their names. Of words as frequent as the last
    frequent one, those with the smallest hashes serve as contexts.

    Rows that follow each other in a file make chunks of about chunk_bytes. Each chunk asks for each of its distinct words,
    and counts and scores come back by chunk, so no vocabulary is ever in one place, and copies need no special care. Only the
    most common words (at most most_common) are broadcast. Chunks go by file and row, so they are the same in each of the three reads
    whatever executors come and go; docs that isn't a table of files is written once.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = ["n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kept = [f for f in docs.schema.fields if f.name not in (*names, text)]
    row = F.struct(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)]) if kept else F.lit(None).cast("struct<c: int>")
    docs = docs.select(row.alias("kept"), F.col(text).cast("string").alias("text"), F.coalesce(learn_from, F.lit(False)).alias("learn"))
    docs = placed(docs)
    words = scratch(word_counts(docs))
    some = words.where("n > 0")
    n_rows, ends, size = docs.agg(F.count("*"), F.count_if("learn"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rows_each = max(1, min(8192, chunk_bytes * n_rows // max(size, 1)))
    docs = docs.withColumn("chunk", F.xxhash64("_place.file", F.floor(F.col("_place.row") / rows_each)).bitwiseAND(F.lit((1 << 62) - 1))).drop("_place")
    n_words, distinct = some.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = n_words + ends, distinct + (ends > 0)
    frequent = np.sort(np.array([r[0] for r in some.orderBy(F.desc("n"), "h").limit(CLASSES).collect()], np.int64).view(np.uint64))
    cut = common_from(some, most_common)
    common = np.sort(words.where(F.col("n") >= cut).select("h").toArrow()["h"].to_numpy().view(np.uint64))
    both = scratch(head_counts_and_asks(docs, frequent, common))
    heads = scratch(both.where("chunk = -1").groupBy("key").agg(F.sum("n").alias("n")))
    spread = dealt_words(words, most_alike=most_alike)
    above = shared_counts(spread)
    shared = spark.sparkContext.broadcast(fit(spark, spread, above, heads, frequent))

    def tails(t: pa.Table, known: pa.Table) -> pa.Table:
        t = t.sort_by("word")
        e = word_edges(t.column("word"), t.column("n").to_numpy().astype(float), HEAD, t.column("depth").to_numpy(), known)
        return pa.table({"h": t.column("h"), "n": t.column("n"), "tail": pa.array(shared.value.token_scores(e, True))})

    scored = scratch(spread.groupBy("shard").cogroup(above.groupBy("shard")).applyInArrow(tails, "h long, n long, tail double"))
    often = scored.where(F.col("n") >= cut).toArrow()
    h = often["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    held = spark.sparkContext.broadcast([h[order], often["n"].to_numpy()[order], often["tail"].to_numpy()[order]])
    answers = both.where("chunk >= 0").select("chunk", F.col("key").alias("h")).join(scored.where(F.col("n") < cut), "h")
    denominator = np.log10(tokens + distinct + 1)
    outs = [f"c{i}" for i in range(len(kept))]
    schema = f"kept {docs.schema['kept'].dataType.simpleString()}, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def judge(key, left, right):
        h, n, tail = (right.column(c).to_numpy() for c in ("h", "n", "tail"))
        order = np.argsort(h.view(np.uint64))
        tables = [(h.view(np.uint64)[order], n[order], tail[order]), held.value]
        done = []
        for b in cut_batches(iter(left.select(["kept", "text"]).to_batches()), "text", 1_000_000):
            t = Tokens(b.column(1), shared.value.frequent)
            w = t.words
            c, later, found = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash)), np.zeros(len(w.hash), bool)
            for keys, ns, ts in tables:
                at, met = place(keys, w.hash)
                c[met], later[met], found = ns[at[met]], ts[at[met]], found | met
            if not found.all():
                raise ValueError("rows came in another order when they were read again: write the table before it is scored")
            per = lambda x: np.bincount(w.doc, weights=x, minlength=w.n_docs)  # noqa: E731, B023
            base = per(np.log10(c + 1) - denominator) + np.log10(ends + 1) - denominator
            known = per((c > 0).astype(float)).astype(np.int64) + int(ends > 0)
            keys, back = np.unique(np.concatenate([t.heads(), t.ends()]), return_inverse=True)
            head = _remembered.of(shared.value, keys)[back]
            s = per(head[: len(w.hash)] + later) + head[len(w.hash) :]
            size = np.diff(w.offs)
            own = b.column(0)
            own = pa.StructArray.from_arrays(own.flatten(), names=[f.name for f in own.type])  # columns that are never null may be null in the result's type
            cols = [own, pa.array(size.astype(np.int64)), pa.array(w.count + 1), pa.array(known), pa.array(np.full(w.n_docs, tokens, np.int64)), pa.array(base), pa.array(s), pa.array(-s / np.log10(2) / np.maximum(size, 1))]
            done.append(pa.RecordBatch.from_arrays(cols, ["kept", *names]))
        return pa.Table.from_batches(done, None if done else pa.schema([]))

    found = docs.select("kept", "text", "chunk").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, schema)
    return found.select(*[F.col(f"kept.{c}").alias(f.name) for c, f in zip(outs, kept, strict=True)], *names)
