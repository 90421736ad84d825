"""Source divergence audit: dense source-by-term tiles of counts, all pairs of a language's sources in each tile, and each source's own terms."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.base import cut_batches, prepare, scratch, span_hashes, text_bytes

#: Bytes of terms: A-Z, a-z and all of non-ASCII characters; that is `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` on UTF-8.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SCALE = 1_000_000_000
#: Numbers in one broadcast of all pairs by terms.
_CELLS = 1_000_000
COUNTS = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"


def _spans(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts; begin, end and document of each term."""
    data, offs = text_bytes(col)
    solid, n = _TERM[data], len(data)
    bound = np.zeros(n + 1, bool)
    bound[offs] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = ~solid[:-1], ~solid[1:]
    start = np.flatnonzero(solid & (before | bound[:n]))
    end = np.flatnonzero(solid & (after | bound[1:])) + 1
    return data, start, end, np.searchsorted(offs, start, "right") - 1


def _pick(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte spans as lower-cased strings."""
    size = end - start
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offs[:-1], size) + np.arange(offs[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(_LOWER[data[at]])).cast(pa.string())


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice of (text, lang, source): occurrences and documents of each term by group; a null term stands for the group itself."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    for b in cut_batches(batches, "text"):
        names: dict[tuple[str, str], int] = {}
        group = np.array([names.setdefault(k, len(names)) for k in zip(b["lang"].to_pylist(), b["source"].to_pylist())])
        data, start, end, doc = _spans(b["text"])
        # A stable sort by (group, term) leaves the documents of a term in order.
        g, h = group[doc], span_hashes(data, start, end, lower=True)
        order = np.lexsort((h, g))
        g, h, doc = g[order], h[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        docs = new.copy()
        docs[1:] |= doc[1:] != doc[:-1]
        n = np.diff(np.append(first, len(order)))
        d = np.add.reduceat(docs.astype(np.int64), first) if len(first) else n
        of = np.concatenate([g[first], np.arange(len(names))])
        langs, sources = (pa.array([k[i] for k in names], pa.string()).take(pa.array(of)) for i in (0, 1))
        nothing = np.zeros(len(names), np.int64)
        terms = pa.concat_arrays([_pick(data, start[order[first]], end[order[first]]), pa.nulls(len(names), pa.string())])
        yield pa.RecordBatch.from_arrays([langs, sources, terms, pa.array(np.concatenate([n, nothing])), pa.array(np.concatenate([d, nothing]))], schema=schema)


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact in 64 bits: by three digits a step where the product would be too large."""
    left = count + 1
    if not left.size or int(left.max()) <= (2**63 - 1) // SCALE:
        return 1 + SCALE * left // total
    out = np.zeros_like(left)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return 1 + out


def tile(lang: str, counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """What one block of a language's terms adds to the pairs of its sources, and its best `top` terms for each source.

    counts: source, term, n. groups: all sources of the language with n (their kept occurrences), n_lang, v, and `mine` for those
    that this tile answers for.
    """
    names = groups["source"].to_pylist()
    mine = np.flatnonzero(groups["mine"].to_numpy())
    sums = np.zeros((len(mine), len(names)), np.int64)
    out: list[tuple[str, str, str, int]] = []
    if counts.num_rows:
        coded = counts["term"].combine_chunks().dictionary_encode()
        row = pc.index_in(counts["source"], value_set=groups["source"].combine_chunks()).to_numpy()
        terms = [t.encode() for t in coded.dictionary.to_pylist()]
        dense = np.zeros((len(names), len(terms)), np.int64)
        dense[row, coded.indices.to_numpy()] = counts["n"].to_numpy()
        v = int(groups["v"][0].as_py())
        p = share(dense, groups["n"].to_numpy()[:, None] + v)
        step = max(1, _CELLS // (len(mine) * len(names)))
        for at in range(0, len(terms), step):
            q = p[None, :, at : at + step]
            f = p[mine, None, at : at + step] - q
            f *= f
            f //= q
            sums += f.sum(-1)
        q = share(dense.sum(0), np.int64(int(groups["n_lang"][0].as_py()) + v))
        for i in mine:
            own = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            f = (p[i][own] - q[own]) ** 2 // q[own]
            if len(f) > top:
                own, f = (x[f >= np.partition(f, len(f) - top)[len(f) - top]] for x in (own, f))
            out += [(names[i], "term", t.decode(), -x) for x, t in heapq.nsmallest(top, zip((-f).tolist(), (terms[j] for j in own)))]
    for k, i in enumerate(mine):
        out += [(names[i], "pair", h, s) for j, (h, s) in enumerate(zip(names, sums[k].tolist())) if j != i]
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), **{k: pa.array(c, pa.int64() if k == "value" else pa.string()) for k, c in zip(("source", "part", "item", "value"), cols)}})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200, block_terms: int = 4096, block_sources: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from the others of its language, and by which terms.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps those in at least `least_docs` of its
    documents. Shares are p = 1 + floor(SCALE * (count + 1) / (N + V)), divergences f = floor((p - q)^2 / q). Part `pair`: f summed over
    all kept terms against each other source. Part `term`: a source's terms with p over the language's q, `top` of them.

    Null text, language and source are ''. Ties rank by the item's bytes; repeated rows count again; texts of any length count whole;
    other columns aren't read; an empty table gives no rows; a language without kept terms has pairs of value 0.

    Counts are added up inside tasks before they are shuffled by (language, source, term), so a hot source costs no more than others.
    A tile has about `block_terms` terms and answers for about `block_sources` of a language's sources, so its memory is bounded by
    the number of sources of one language, not by the corpus.
    """
    prepare(docs.sparkSession)
    read = docs.select(F.col(text).cast("string").alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))))
    counts = scratch(read.mapInArrow(count_terms, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_term = Window.partitionBy("lang", "term")
    seen = counts.where("term IS NOT NULL").withColumn("df", F.sum("docs").over(of_term)).withColumn("one", F.row_number().over(of_term.orderBy("source")) == 1)
    kept = scratch(seen.where(F.col("df") >= least_docs).select("lang", "source", "term", "n", "one"))

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("one").cast("long")).alias("v"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").fillna(0, ["n", "v"])
    groups = scratch(groups)
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("v").alias("v"), F.count("*").alias("sources"))
    langs = langs.select("lang", "n_lang", "v", F.greatest(F.lit(1), F.ceil(F.col("v") / block_terms)).alias("blocks"), F.ceil(F.col("sources") / block_sources).alias("parts"))
    langs = scratch(langs)

    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    # A term's hash goes to blocks, a source's to parts.
    left = kept.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).withColumn("at", upto("parts")).select("lang", "block", "at", "source", "term", "n")
    right = groups.drop("v").join(langs, "lang").withColumn("block", upto("blocks")).withColumn("at", upto("parts"))
    right = right.select("lang", "block", "at", "source", "n", "n_lang", "v", (F.pmod(F.xxhash64("source"), F.col("parts")) == F.col("at")).alias("mine"))

    def run(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        return tile(key[0].as_py(), a, b, top)

    keys = ["lang", "block", "at"]
    found = scratch(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
