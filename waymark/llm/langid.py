"""Language identification of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.base import Words, cut_batches, mix, prepare, scratch

UNKNOWN = "und"
_SEG = 32


@dataclass
class Crf:
    """labels; weights of hashed affix, n-gram and whole-word (lexicon) features; transition and start weights."""

    labels: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    @property
    def bits(self) -> int:
        return int(self.weights.shape[0]).bit_length() - 1


def letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


def feature_ids(w: Words, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in `words`, hashed feature) of the lexicon entry, the affixes of 1 to 4 and the n-grams of 1 to 3 bytes.

    Words are lower-cased (A-Z); ASCII punctuation and digits aren't part of affixes. Features are hashed into 2**bits weights.
    """
    table = np.arange(256, dtype=np.uint64)
    table[65:91] += np.uint64(32)
    low = table[w.data] if len(w.data) else np.zeros(0, np.uint64)
    dull = np.ones(256, bool)
    dull[65:91] = dull[97:123] = dull[128:] = False
    start, end = w.start[words], w.end[words]
    # The letters' span: without leading and trailing marks.
    solid = np.concatenate([[0], np.cumsum(~dull[w.data])])
    total = solid[end] - solid[start]
    at = np.flatnonzero(~dull[w.data])
    some = total > 0
    s, e = start.copy(), end.copy()
    s[some] = at[solid[start[some]]]
    e[some] = at[solid[end[some]] - 1] + 1
    who = np.flatnonzero(some)
    s, e = s[some], e[some]
    shift = np.uint64(64 - bits)
    put = lambda kind, key: (mix(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)) >> shift).astype(np.int64)
    owners, ids = [], []
    size = e - s
    for n in (1, 2, 3, 4):
        has = size >= n
        head, tail = np.zeros(has.sum(), np.uint64), np.zeros(has.sum(), np.uint64)
        for j in range(n):
            head = head * np.uint64(257) + low[s[has] + j] + np.uint64(1)
            tail = tail * np.uint64(257) + low[e[has] - n + j] + np.uint64(1)
        owners += [who[has], who[has]]
        ids += [put(n, head), put(10 + n, tail)]
    for n in (1, 2, 3):
        grams = np.maximum(size - n + 1, 0)
        owner = np.repeat(np.arange(len(who)), grams)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + s[owner]
        key = np.zeros(len(owner), np.uint64)
        for j in range(n):
            key = key * np.uint64(257) + low[pos + j] + np.uint64(1)
        owners.append(who[owner])
        ids.append(put(20 + n, key))
    # Lexicon: the whole letters' span.
    if len(who):
        from waymark.llm.base import span_hashes

        owners.append(who)
        ids.append(put(30, span_hashes(w.data, s, e, lower=True)))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(ids)


def emissions(w: Words, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed feature weights of each of `words` by label; zero for words without letters."""
    bits = int(weights.shape[0]).bit_length() - 1
    owner, ids = feature_ids(w, words, bits)
    out = np.empty((len(words), weights.shape[1]), np.float64)
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(owner, weights=weights[ids, k], minlength=len(words))
    return out


def fit(texts: list[tuple[str, str]], bits: int = 16, epochs: int = 3, rate: float = 0.05, seed: int = 7) -> Crf | None:
    """A CRF from (text, label) pairs; each word of a whole text carries the text's label.

    Half of the training sequences are spliced from runs of differently labelled texts (runs of 4 to 31 words), so that the
    transitions learn how rarely languages switch. The conditional likelihood is followed by AdaGrad steps whose
    gradients come from forward-backward. None without a labelled text that has a letter.
    """
    texts = [(t, y) for t, y in texts if letters(t)]
    if not texts:
        return None
    labels = sorted({y for _, y in texts})
    k, of = len(labels), {y: i for i, y in enumerate(labels)}
    rng = np.random.default_rng(seed)
    w = Words(pa.array([t for t, _ in texts], pa.large_string()), lower=True)
    y = np.array([of[v] for _, v in texts])[w.doc]
    first = np.concatenate([[0], np.cumsum(w.count)])
    runs, spliced = [], []
    for d in range(len(texts)):
        for a in range(int(first[d]), int(first[d + 1]), _SEG):
            (runs if rng.random() < 0.5 else spliced).append(np.arange(a, min(a + _SEG, int(first[d + 1]))))
    cuts = []
    for r in spliced:
        while len(r):
            m = int(rng.integers(4, _SEG))
            cuts.append(r[:m])
            r = r[m:]
    rng.shuffle(cuts)
    line = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
    runs += [line[a : a + _SEG] for a in range(0, len(line), _SEG)]
    rng.shuffle(runs)
    distinct, inverse = np.unique(w.hash, return_inverse=True)
    sample = np.zeros(len(distinct), np.int64)
    sample[inverse] = np.arange(len(w.hash))
    owner, ids = feature_ids(w, sample, bits)
    order = np.argsort(owner, kind="stable")
    owner, ids = owner[order], ids[order]
    begin = np.searchsorted(owner, np.arange(len(distinct) + 1))
    crf = Crf(labels, np.zeros((1 << bits, k)), np.zeros((k, k)), np.zeros(k))
    square = [np.full_like(crf.weights, 1e-6), np.full_like(crf.trans, 1e-6), np.full_like(crf.start, 1e-6)]
    eye = np.eye(k)
    for _ in range(epochs):
        for a in range(0, len(runs), 128):
            group = runs[a : a + 128]
            size = np.array([len(r) for r in group])
            mask = np.arange(_SEG)[None, :] < size[:, None]
            pos = np.zeros(mask.shape, np.int64)
            pos[mask] = np.concatenate(group)
            kind, back = np.unique(inverse[pos[mask]], return_inverse=True)
            counts = begin[kind + 1] - begin[kind]
            flat = np.repeat(np.arange(len(kind)), counts)
            feats = ids[np.repeat(begin[kind], counts) + np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)]
            e = np.stack([np.bincount(flat, weights=crf.weights[feats, j], minlength=len(kind)) for j in range(k)], 1)
            em = np.zeros((*mask.shape, k))
            em[mask] = e[back]
            gamma, pairs = marginals(em, mask, crf, with_pairs=True)
            truth = eye[y[pos]] * mask[..., None]
            diff = (truth - gamma)[mask]
            per_kind = np.stack([np.bincount(back, weights=diff[:, j], minlength=len(kind)) for j in range(k)], 1)
            g_trans = np.einsum("btj,btk->jk", truth[:, :-1], truth[:, 1:]) - pairs
            g_start = (truth[:, 0] - gamma[:, 0]).sum(0)
            where, spot = np.unique(feats, return_inverse=True)
            g_w = np.stack([np.bincount(spot, weights=per_kind[flat, j], minlength=len(where)) for j in range(k)], 1)
            for target, sq, g, at in ((crf.weights, square[0], g_w, where), (crf.trans, square[1], g_trans, slice(None)), (crf.start, square[2], g_start, slice(None))):
                sq[at] += g * g
                target[at] += 4 * rate * g / np.sqrt(sq[at])
    return crf


def marginals(em: np.ndarray, mask: np.ndarray, crf: Crf, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: label marginals [b, t, k], and the expected transition counts."""
    b, t, k = em.shape
    x = np.exp(em - em.max(2, keepdims=True))
    a = np.exp(crf.trans - crf.trans.max())
    alpha, beta = np.empty_like(x), np.ones_like(x)
    alpha[:, 0] = np.exp(crf.start - crf.start.max()) * x[:, 0]
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        step = (alpha[:, i - 1] @ a) * x[:, i]
        step /= step.sum(1, keepdims=True)
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = (x[:, i + 1] * beta[:, i + 1]) @ a.T
        step /= step.sum(1, keepdims=True)
        beta[:, i] = np.where(mask[:, i + 1, None], step, beta[:, i + 1])
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    pairs = np.zeros((k, k))
    if with_pairs:
        joint = alpha[:, :-1, :, None] * a * (x[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        pairs = (joint * mask[:, 1:, None, None]).sum((0, 1))
    return gamma * mask[..., None], pairs


def label_shares(em: np.ndarray, count: np.ndarray, crf: Crf) -> np.ndarray:
    """Summed word marginals [document, label]; em holds the documents' words one after another.

    Long documents are cut into segments of 32 words. The segments' transfer matrices, found side by side, carry the exact
    messages across a document, so that forward-backward is that of the whole chain.
    """
    n_docs, k = len(count), em.shape[1]
    segs = -(-count // _SEG)
    seg_doc = np.repeat(np.arange(n_docs), segs)
    seg_at = np.concatenate([[0], np.cumsum(segs)])
    n = len(seg_doc)
    out = np.zeros((n_docs, k))
    if not n:
        return out
    doc = np.repeat(np.arange(n_docs), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    x = np.ones((_SEG, n, k), np.float32)
    mask = np.zeros((_SEG, n), bool)
    row, col = within % _SEG, seg_at[doc] + within // _SEG
    x[row, col] = np.exp(em - em.max(1, keepdims=True))
    mask[row, col] = True
    a = np.exp(crf.trans - crf.trans.max()).astype(np.float32)
    first = seg_at[:-1][segs > 0]
    opens = np.zeros(n, bool)  # a document's first segment: the start weights stand in place of its first step
    opens[first] = True
    move = np.broadcast_to(np.eye(k, dtype=np.float32), (n, k, k)).copy()
    for t in range(_SEG):
        stepped = (move.reshape(-1, k) @ a).reshape(n, k, k)
        if t == 0:
            stepped = np.where(opens[:, None, None], move, stepped)
        step = stepped * x[t][:, None, :]
        step /= step.sum((1, 2), keepdims=True)
        move = step if mask[t].all() else np.where(mask[t][:, None, None], step, move)
    # Messages into each segment from the left and into its end from the right.
    left, right = np.full((n, k), 1 / k, np.float32), np.ones((n, k), np.float32)
    left[first] = np.exp(crf.start - crf.start.max())
    longest = int(segs.max())
    for j in range(1, longest):
        at = seg_at[:-1][segs > j] + j
        v = (left[at - 1][:, None, :] @ move[at - 1])[:, 0]
        left[at] = v / np.abs(v).sum(1, keepdims=True)
    for j in range(longest - 1, 0, -1):
        at = seg_at[:-1][segs > j] + j
        v = (move[at] @ right[at][:, :, None])[:, :, 0]
        right[at - 1] = v / v.sum(1, keepdims=True)
    alpha = np.empty_like(x)
    now = left
    for t in range(_SEG):
        step = (np.where(opens[:, None], now, now @ a) if t == 0 else now @ a) * x[t]
        step /= step.sum(1, keepdims=True)
        now = np.where(mask[t][:, None], step, now)
        alpha[t] = now
    total, beta = np.zeros((n, k), np.float32), right
    for t in range(_SEG - 1, -1, -1):
        g = alpha[t] * beta
        total += np.where(mask[t][:, None], g / g.sum(1, keepdims=True), 0)
        step = (x[t] * beta) @ a.T
        beta = np.where(mask[t][:, None], step / step.sum(1, keepdims=True), beta)
    for j in range(k):
        out[:, j] = np.bincount(seg_doc, weights=total[:, j], minlength=n_docs)
    return out


class Known:
    """Emissions of words met before in a task, by hash; at most `most` words, then it starts again."""

    def __init__(self, crf: Crf, most: int = 300_000) -> None:
        self.crf, self.most = crf, most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(crf.labels)), np.float32)

    def of(self, w: Words, distinct: np.ndarray, sample: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, distinct)
        met = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        met[inside] = self.keys[at[inside]] == distinct[inside]
        out = np.empty((len(distinct), self.values.shape[1]), np.float32)
        out[met] = self.values[at[met]]
        new = np.flatnonzero(~met)
        out[new] = emissions(w, sample[new], self.crf.weights)
        if len(self.keys) + len(new) > self.most:
            self.keys, self.values = distinct, out
        else:
            at = at[new]
            self.keys, self.values = np.insert(self.keys, at, distinct[new]), np.insert(self.values, at, out[new], axis=0)
        return out


def predict(col: pa.Array, crf: Crf | None, known: Known | None = None) -> tuple[list[str], np.ndarray]:
    """The label with the largest mean word marginal, and that mean; UNKNOWN and 0 for a text without a letter."""
    n = len(col)
    labels, scores = [UNKNOWN] * n, np.zeros(n)
    if crf is None:
        return labels, scores
    w = Words(col, lower=True)
    distinct, sample, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    em = (known or Known(crf)).of(w, distinct, sample)
    spoken = (em != 0).any(1)[inverse]
    count = np.bincount(w.doc[spoken], minlength=n)
    shares = label_shares(em[inverse[spoken]], count, crf)
    best = shares.argmax(1)
    top = shares[np.arange(n), best] / np.maximum(count, 1)
    texts = col.to_pylist()
    for i in range(n):
        if count[i] or letters(texts[i]):
            if letters(texts[i]):
                labels[i], scores[i] = crf.labels[best[i]], (min(1.0, max(0.0, top[i])) if count[i] else 1 / len(crf.labels))
    return labels, scores


def quotas(counts: dict[str, int], most: int) -> dict[str, tuple[int, int]]:
    """For each label how many of its texts to take, at least one, and how many it has; what small labels leave goes to the larger."""
    out: dict[str, tuple[int, int]] = {}
    for i, (y, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        k = min(n, max(1, most // (len(counts) - i)))
        out[y], most = (k, n), most - k
    return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = 2000) -> Crf | None:
    """The CRF of at most about `max_rows` labelled texts (the documented bound).

    Copies of a text under a label count once. Each label gets an equal share of the bound, and what others cannot fill; within
    it the texts with the smallest hashes are taken. The one task that fits gets the sampled texts whole, each once; the driver
    gets the sample's hashes and the model (2**16 weights a label).
    """
    spark = labelled.sparkSession
    prepare(spark)
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("y"), F.xxhash64(F.col(text)).alias("h"))
    pairs = scratch(usable.select("h", "y").distinct())
    room = quotas({r["y"]: r["count"] for r in pairs.groupBy("y").count().collect()}, max_rows)
    if not room:
        return None
    # Hashes are spread evenly, so few more than a label's share lie under `top`; only these are ranked.
    asked = spark.createDataFrame([(y, k, min(1.0, (k + 8 * k**0.5 + 20) / n)) for y, (k, n) in room.items()], "y string, k long, top double")
    low = pairs.join(F.broadcast(asked), "y").where(F.col("h") / 2.0**64 + 0.5 <= F.col("top"))
    chosen = low.withColumn("at", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where("at <= k").select("h", "y")
    sample = usable.join(F.broadcast(chosen), ["h", "y"]).groupBy("h", "y").agg(F.min("t").alias("t")).select("t", "y", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, y, t) for b in batches for t, y, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        crf = fit([(t, y) for _, y, t in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(crf)], pa.binary())], ["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first()[0])


def identify(docs: DataFrame, crf: Crf | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs (without `text` unless asked) with lang_pred and score; extra columns of those names are replaced.

    One narrow pass over whole texts. A null or empty text, or one without a letter, gets `und` and score 0; ties go to the
    label that sorts first; repeated rows get the same answer; an empty table gives an empty table; without a model all are `und`.
    A text of any length is one chain, cut into segments that exact messages join; texts over 2 MB are handled one at a time.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop("lang_pred", "score")
    keep = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "lang_pred string, score double"])
    model = spark.sparkContext.broadcast(crf)  # 2**16 x labels weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.value) if model.value else None
        for whole in batches:
            raw = whole.column(whole.schema.get_field_index(text))
            done = 0
            for b in cut_batches(iter([whole]), text):
                labels, scores = predict(b.column(b.schema.get_field_index(text)), model.value, known)
                arrays = [(raw.slice(done, b.num_rows) if f.name == text else b.column(b.schema.get_field_index(f.name))) for f in keep]
                done += b.num_rows
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(labels, pa.string()), pa.array(scores)], [f.name for f in keep] + ["lang_pred", "score"])

    return docs.mapInArrow(run, schema)
