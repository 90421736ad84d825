"""The context-mixing model against a bit-by-bit version, and its results for odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from waymark.llm import mixlm
from waymark.llm.base import Words

SF = "/root/testdata/sf0.001"
END = (mixlm.TERMINATOR,)


class Plain:
    """One bit after another; one learning step, as all edges fit in a batch. Only the hash that names a slot is the model's."""

    def __init__(self, texts):
        self.slot = {}
        every = [self.tokens(t) for t in texts]
        words = Counter(w for ts in every for _, w in ts if w != END)
        heads = Counter((c, w[: mixlm.HEAD]) for ts in every for c, w in ts)
        ends = sum(1 for ts in every for _, w in ts if w == END)
        self.tables = defaultdict(lambda: [0, 0])
        self.words = words
        hashes = Words(pa.array([" ".join(bytes(w[:-1]).decode() for w in words)], pa.large_string()), True).hash
        self.cls = {bytes(w[:-1]).decode(): 1 + int((hashes < h).sum()) for w, h in zip(words, hashes, strict=True)}
        for w, n in [*words.items(), (END, ends)]:
            for p in range(len(w)):
                for k in range(1, mixlm.ORDERS + 1):
                    self.add((k, ((None,) * k + w[:p])[-k:]), w[p], n)
                if p >= mixlm.HEAD:
                    self.add(("prefix", w[:p]), w[p], n)
        for (c, h), n in heads.items():
            for p in range(len(h)):
                self.add(("class", c, h[:p]), h[p], n)
        self.weights = np.full((mixlm.GATES, mixlm.INPUTS), 0.3)
        grid = 1 / (1 + np.exp(-np.linspace(-12, 12, 33)))
        self.refine = np.tile(grid, (mixlm.GATES, 1))
        g, right, total = np.zeros_like(self.weights), np.zeros_like(self.refine), np.zeros_like(self.refine)
        edges = Counter()
        for w, n in words.items():
            for p in range(mixlm.HEAD, len(w)):
                edges[None, w[:p], w[p]] += n
        for (c, h), n in heads.items():
            for p in range(len(h)):
                edges[c, h[:p], h[p]] += n
        for (c, before, byte), n in edges.items():
            for x, gate, bit in self.bits(c, before, byte, True):
                s = max(-12, min(12, float(x @ self.weights[gate])))
                g[gate] += (bit - 1 / (1 + math.exp(-s))) * n * x
                at = int(np.rint((s + 12) * 32 / 24))
                total[gate, at] += n
                right[gate, at] += n * bit
        self.weights = self.weights + 0.02 * g / np.sqrt(1e-3 + g * g)
        self.refine = (right + 8 * self.refine) / (total + 8)

    @staticmethod
    def tokens(text):
        """(last frequent word before, symbols): with so few distinct words all are frequent."""
        out, last = [], None
        for w in brute.WORD.findall(brute.lower(text)):
            out.append((last, (*w.encode(), mixlm.TERMINATOR)))
            last = w
        return [*out, (last, END)]

    def key(self, context, byte, j):
        if context[0] == "prefix":
            return context, byte >> (8 - j), j
        if (context, byte) not in self.slot:
            key, m = 0, 1 << 64
            if context[0] == "class":
                i = mixlm.CLASS
                key = sum((b + 1) * pow(0x9E3779B97F4A7C15, p + 1, m) for p, b in enumerate(context[2])) + (self.cls.get(context[1], 0) + 1) * 0xD1342543DE82EF95
            else:
                i = context[0] - 1
                for b in reversed(context[1]):
                    key = key * 257 + (0 if b is None else b + 1)
            ctx = mixlm.context(i, np.array([key % m], np.uint64))
            self.slot[context, byte] = mixlm.slots(i, ctx, np.array([byte]))[:, 0].tolist()
        return self.slot[context, byte][j]

    def add(self, context, byte, n):
        for j in range(8):
            self.tables[self.key(context, byte, j)][byte >> (7 - j) & 1] += n

    def bits(self, cls, before, byte, left_out):
        """cls: for the head of a token; other symbols have none (and `before` has at least HEAD of them)."""
        p, head = len(before), len(before) < mixlm.HEAD
        for j in range(8):
            bit, x, mass = byte >> (7 - j) & 1, np.zeros(mixlm.INPUTS), {}
            x[-1] = 0.3

            def put(i, context, on=True):
                both = list(self.tables.get(self.key(context, byte, j), (0, 0)))
                both[bit] = max(both[bit] - left_out, 0)
                if on:
                    x[i] = math.log((both[1] + mixlm.PRIOR) / (both[0] + mixlm.PRIOR))
                mass[i] = math.log2(sum(both) + 1)

            for k in range(1, mixlm.ORDERS + 1):
                put(k - 1, (k, ((None,) * k + before)[-k:]), k < mixlm.ORDERS or not head)
            if head:
                put(4, ("class", cls, before))
                lead, known, kind = mass[4], mass[2] >= 3, p
            else:
                whole = p >= mixlm.LEVELS[0]
                put(5, ("prefix", before), whole)
                lead, known, kind = mass[5] if whole else mass[3], mass[3] > 1.6, 3 if whole else 4
            yield x, kind * 16 + min(int(lead), 7) * 2 + known, bit

    def score(self, text):
        out = 0.0
        for cls, w in self.tokens(text):
            for p in range(len(w)):
                # A word of the corpus that no training text has is an edge without counts: nothing is left out.
                for x, gate, bit in self.bits(cls, w[:p], w[p], False):
                    s = max(-12, min(12, float(x @ self.weights[gate])))
                    at = (s + 12) * 32 / 24
                    low = min(int(at), 31)
                    q = self.refine[gate, low] * (1 - at + low) + self.refine[gate, low + 1] * (at - low)
                    one = (1 / (1 + math.exp(-s)) + q) / 2
                    out += math.log10(one if bit else 1 - one)
        return out


def test_equals_a_bit_by_bit_version(spark):
    stems = ["walk", "wander", "talk", "tall", "wall", "é", "x", "to", "the"]
    train = [" ".join(stems[(i * k + k // 3) % 9] + ("ing" if (i + k) % 4 == 0 else "") for k in range(1, 30)) for i in range(12)]
    other = ["walked Talking the wall", "", "zzz to the walking", "the the the", "wandered", "talker", "Éa", "xylophone", "walks", "tell tales"]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(100 + i, t, False) for i, t in enumerate(other)]
    got = {r["doc_id"]: r["score"] for r in mixlm.score(spark.createDataFrame(rows, "doc_id long, text string, learn boolean"), F.col("learn")).collect()}
    plain = Plain(train)
    assert len(plain.words) < mixlm.CLASSES and sum(map(len, plain.words)) < 1024
    off = {t: got[i] / plain.score(t) - 1 for i, t, _ in rows}
    assert max(map(abs, off.values())) < 1e-4, off


def test_counts_base_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
    odd = spark.createDataFrame([(9_000, None, True), (9_001, "", True), (9_002, "Qwx " * 2000, True), (9_003, "the of", True), (9_003, "the of", True), (9_004, "q" * 50_000, None)], "doc_id long, text string, held_out boolean")
    every = docs.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("chunk", F.lit(1)).withColumn("learn", F.lit("clash"))
    made = mixlm.score(every, ~F.col("held_out"), chunk_bytes=100_000)
    assert made.columns[:4] == ["doc_id", "held_out", "chunk", "learn"]
    got = made.collect()
    words = {r["doc_id"]: brute.WORD.findall(brute.lower(r["text"] or "")) + [""] for r in every.collect()}
    counts = Counter(w for i, ws in words.items() if i < 9_000 and zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        ws = words[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert len(got) == len(words) + 1
    assert len({r["score"] for r in got if r["doc_id"] == 9_003}) == 1
    seen = [r for r in got if r["doc_id"] < 9_000 and not r["held_out"]]
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)
    held = [r for r in got if r["doc_id"] < 9_000 and r["held_out"]]
    assert sum(-r["score"] for r in held) / math.log10(2) < 2.5 * sum(r["n_bytes"] for r in held)  # bits a byte
    none = mixlm.score(every.limit(3), F.lit(False)).collect()
    assert len(none) == 3 and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in none)
    assert mixlm.score(every.limit(0), F.lit(True)).count() == 0


def test_first_symbols_sum_to_one():
    rng = np.random.default_rng(5)
    m = mixlm.first_model(np.zeros(0, np.uint64))
    m.zeros, m.ones = (rng.integers(0, 50, mixlm.SLOTS).astype(np.float32) for _ in range(2))
    m.weights, m.refine = rng.normal(0.2, 0.1, m.weights.shape).astype(np.float32), rng.random(m.refine.shape)
    for cls in (0, 7):
        keys = np.array([cls << 27 | (s + 1) << 18 for s in range(256)])
        assert math.isclose((10 ** m.token_scores(mixlm.head_edges(keys, np.zeros(256)), False)).sum(), 1, rel_tol=1e-4)


def test_prefix_counts_are_those_of_the_words():
    words, n = [b"walk", b"walking", b"wall", b"xalk"], np.array([3.0, 2, 1, 4])
    e = mixlm.word_edges(pa.array(words), n, 0)
    zeros, ones = e.prefix_counts()
    at = [i for i in range(len(e)) if e.byte[i] == ord("l") and e.pos[i] == 3]
    assert len(at) == 1 and (zeros + ones)[0, at[0]] == 6  # after wal
    assert (zeros + ones)[7, at[0]] == 1  # of these, l and no k, by the bits before the last (k: 1101011, l: 1101100)
    assert e.n[e.of_symbol[0]] == 6  # w


@pytest.mark.parametrize("most", [40, 10_000])
def test_crowded_beginnings_are_dealt_by_more_bytes(spark, most):
    words = [f"https://a.org/{i:04}".encode() for i in range(40)] + [b"http", b"htt", b"other", b"x" * 60, b"x" * 61, b"x" * 62, b"x" * 63]
    got = mixlm.dealt_words(spark.createDataFrame([(w, 1) for w in words], "word binary, n long"), per_shard=50, most_alike=most).collect()
    assert sorted(bytes(r["word"]) for r in got) == sorted(words)
    depth = {bytes(r["word"]): r["depth"] for r in got}
    if most == 10_000:
        assert set(depth.values()) == {4}
    else:
        assert depth[b"other"] == 4 and depth[b"x" * 60] == mixlm.WHOLE_WORD and depth[words[0]] == 24
        groups = defaultdict(list)
        for r in got:
            groups[r["depth"], bytes(r["word"])[: r["depth"]]].append(len(r["word"]) + 1)
        assert all(sum(g) <= most or len(g) == 1 for g in groups.values())


def texts_of_many_shards():
    stems = ["https://a.org/", "https://b.org/x/", "walk", "wander", "wand", "wands", "wall", "é", "x", "to", "the", "x" * 30]
    return [" ".join(f"{stems[(i * k + k // 3) % 12]}{(i * k) % 17 if k % 3 else ''}" for k in range(1, 40)) for i in range(20)]


def scores(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    return {r["doc_id"]: r["score"] for r in mixlm.score(docs, F.col("learn"), **how).collect()}


def test_scores_do_not_depend_on_how_words_are_dealt(spark):
    rows = [(i, t, i % 5 > 0) for i, t in enumerate(texts_of_many_shards())]
    assert scores(spark, rows, most_alike=30) == scores(spark, rows)


def test_prefix_counts_over_shards_are_those_of_one(spark):
    words = Counter(w.encode() for t in texts_of_many_shards() for w in t.split())
    dealt = mixlm.dealt_words(spark.createDataFrame(list(words.items()), "word binary, n long"), per_shard=100, most_alike=60)
    above = mixlm.shared_counts(dealt).toArrow()
    dealt = dealt.toArrow()
    assert len(set(dealt["shard"].to_pylist())) > 5 and above.num_rows
    whole = mixlm.word_edges(pa.array(list(words)), np.array(list(words.values()), float), mixlm.HEAD, np.full(len(words), 4))
    want = {(p, b): (z, o) for p, b, z, o, w in zip(whole.prefix.tolist(), whole.byte.tolist(), *(x.T.tolist() for x in whole.prefix_counts()), whole.whole) if w}
    met = set()
    for s in set(dealt["shard"].to_pylist()):
        t, known = dealt.filter(pa.compute.equal(dealt["shard"], s)), above.filter(pa.compute.equal(above["shard"], s))
        e = mixlm.word_edges(t["word"], t["n"].to_numpy().astype(float), mixlm.HEAD, t["depth"].to_numpy(), known)
        for p, b, z, o, w in zip(e.prefix.tolist(), e.byte.tolist(), *(x.T.tolist() for x in e.prefix_counts()), e.whole):
            if w:
                assert want[p, b] == (z, o)
                met.add((p, b))
    assert met == set(want)


@pytest.mark.parametrize("learned", [True, False])
def test_words_of_one_and_two_letters(spark, learned):
    for rows in ([(1, "a b c")], [(1, "ab"), (2, "zz yy")], [(1, "")]):
        got = scores(spark, [(*r, learned) for r in rows])
        assert set(got) == {i for i, _ in rows} and all(s < 0 for s in got.values())


def test_a_table_of_files_is_read_in_place(spark, tmp_path):
    rows = [(i, t, i % 5 > 0) for i, t in enumerate(texts_of_many_shards())]
    spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t").withColumn("more", F.col("doc_id") + 1).where("more > 0")
    got = {r["doc_id"]: r["score"] for r in mixlm.score(docs, F.col("learn"), chunk_bytes=1000).collect()}
    assert got == scores(spark, rows)
