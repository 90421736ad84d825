"""Host-level quality rules: rule failures by host, empirical-Bayes rates, verdicts joined back to documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.base import Words, cut_batches, prepare, scratch, span_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Rules that only hosts are judged by, over FEATURES and _n_lines. Long words aren't one: scripts without blanks have them.
HOST_RULES = {
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "10 * n_dup_lines > 3 * _n_lines",
    "short_words": "word_chars < 2 * n_words",
}


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    """The counts of FEATURES, and _n_lines (lines with a word), for each text of a large_string array without nulls."""
    w = Words(col, lower=False)
    n, size = w.n_docs, len(w.data)
    doc_of_byte = np.repeat(np.arange(n), np.diff(w.offs))
    per_doc = lambda mask: np.bincount(doc_of_byte[mask], minlength=n)
    inside = np.zeros(size + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    in_word = np.cumsum(inside[:size]) > 0
    chars = per_doc(in_word & ((w.data & 0xC0) != 0x80))

    # Lines: from a document's start or after a newline, up to a newline or the document's end.
    newline = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.offs[:-1], newline + 1]))
    start = start[start < size]
    start = start[w.data[start] != 10]  # empty lines have no word
    stops = np.union1d(newline, w.offs[1:])
    end = stops[np.searchsorted(stops, start, "right")] if len(start) else start
    has_word = np.searchsorted(w.start, end, "left") > np.searchsorted(w.start, start, "left")
    start, end = start[has_word], end[has_word]
    h, d = span_hashes(w.data, start, end, lower=False), np.searchsorted(w.offs, start, "right") - 1
    order = np.lexsort((h, d))
    again = np.zeros(len(order), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
    dup_lines = np.bincount(d[order][again], minlength=n)

    first, wh = w.windows(5)
    wd = w.doc[first]
    order = np.lexsort((wh, wd))
    same = np.zeros(len(order) + 1, bool)
    if len(order):
        same[1:-1] = (wh[order][1:] == wh[order][:-1]) & (wd[order][1:] == wd[order][:-1])
    twice = first[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    repeat = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {"n_words": w.count, "word_chars": chars, "n_symbols": per_doc(_SYMBOL[w.data]), "n_dup_lines": dup_lines, "n_repeat_words": repeat, "_n_lines": np.bincount(d, minlength=n)}


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without `text`, with the FEATURES columns and _n_lines (extra columns of those names are replaced); no shuffle."""
    prepare(docs.sparkSession)
    features = FEATURES + ", _n_lines long"
    named = [f.split(" ")[0] for f in features.split(", ")]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in named])
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), features])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, text):
            found = measure(b.column(b.schema.get_field_index(text)))
            arrays = [b.column(b.schema.get_field_index(f.name)) for f in keep] + [pa.array(v.astype(np.int64)) for v in found.values()]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in keep] + list(found))

    return docs.mapInArrow(run, schema)


def host_verdicts(judged: DataFrame, host: str, failed: str, worst: float = 0.5, sure: float = 2.0, rules: dict[str, str] | None = None, least: float = 0.2) -> DataFrame:
    """host, n, failures, rate, host_ok: failure rates by host, shrunk by a beta prior that is fitted to all hosts by moments.

    A host is rejected if its shrunken rate of `failed`, less `sure` posterior standard deviations, is over `worst`; or if that of
    one of `rules` (conditions by name), or of rows that fail any rule or `failed`, is over twice the prior's mean (over `least` in
    any case, and never asked to be over `worst`). rate and failures are those of `failed`. Counts are summed before the shuffle,
    so that a host with a third of all rows costs one row for each task. A null host is a host too.
    """
    tests = {"failures": F.col(failed)} | {f"_{k}": F.expr(v) for k, v in (rules or {}).items()}
    if rules:
        tests["_any"] = F.greatest(*tests.values())
    counts = scratch(judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *(F.sum(t.cast("long")).alias(k) for k, t in tests.items())))
    found = counts.agg(F.avg(1 / F.col("n")), *(f(F.col(k) / F.col("n")) for k in tests for f in (F.avg, F.var_pop))).first()
    inv, ok, rates = found[0], F.lit(True), {}
    for i, k in enumerate(tests):
        m, v = found[1 + 2 * i], found[2 + 2 * i]
        # Var(rate) = m(1-m) (1/n + (1-1/n) rho) for a beta-binomial with rho = 1/(a+b+1).
        spread = m * (1 - m) if m is not None else 0
        rho = min(0.99, max(1e-4, (v / spread - inv) / (1 - inv + 1e-9))) if spread else 1e-4
        m, strength = F.lit(float(m or 0)), F.lit(1 / rho - 1)
        rate = rates[k] = (F.col(k) + m * strength) / (F.col("n") + strength)
        sd = F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
        bar = F.lit(worst) if k == "failures" else F.least(F.lit(worst), F.greatest(F.lit(least), 2 * m))
        ok = ok & (rate - sure * sd <= bar)
    return counts.select("host", "n", "failures", rates["failures"].alias("rate"), ok.alias("host_ok"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", worst: float = 0.5, small_hosts: int = 10_000) -> DataFrame:
    """docs without the text, with FEATURES, base_failed, host_rate and kept (boolean, never null).

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows. kept: not base_failed, and the host
    isn't rejected, by base_failed or by HOST_RULES. Null or empty texts have no words and fail; texts of any length are judged whole; null
    hosts are judged together; repeated rows are judged alike; an empty table gives no rows; there are no ties. Extra columns named
    as those made here are replaced, others stay, whatever their names.
    Up to `small_hosts` hosts the verdicts are broadcast (their number is counted first), beyond it they are joined by shuffle
    with each host's verdict copied to 32 salts.
    """
    names = [f.split(" ")[0] for f in FEATURES.split(", ")]
    made = [*names, "base_failed", "host_rate", "kept", text]
    held = [c for c in docs.columns if c not in made]
    # All columns of docs go as one struct, so that no name of theirs can meet one of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(held)], F.lit(0).alias("none")).alias("row"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    facts = scratch(with_features(rows, "text").withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    verdicts = scratch(host_verdicts(facts, "host", "base_failed", worst, rules=HOST_RULES))
    v = verdicts.select(F.col("host").alias("of"), F.col("rate").alias("host_rate"), "host_ok")
    if verdicts.count() <= small_hosts:
        out = facts.join(F.broadcast(v), F.col("host").eqNullSafe(F.col("of")), "left")
    else:
        salted = facts.withColumn("salt", F.pmod(F.xxhash64(*facts.columns), F.lit(32)))
        v = v.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
        out = salted.join(v, F.col("host").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")), "left")
    kept = ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(held)], *names, "base_failed", "host_rate", kept.alias("kept"))
