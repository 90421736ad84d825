"""Mixing to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from waymark.llm.base import WORD, scratch

#: Topics by surface form, first match wins; the last takes the rest.
TOPICS = [("legal", r"(?i)licen[sc]e"), ("table", r" \| "), ("contact", r"@|\d{3}"), ("mention", r"(?i)https?://")]
DIMS = ("source", "lang", "topic")
NONE = "(none)"


def surface_topic(text: Column) -> Column:
    """The first of TOPICS whose pattern the text contains, else `prose`; null texts are prose."""
    found = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def unit(col: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of one dimension, in proportion to tokens**power; they sum to 1."""
    by = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("t", F.pow(F.col("t").cast("double"), F.lit(power)))
    total = by.agg(F.sum("t")).first()[0]
    return by.select(dim, (F.col("t") / F.lit(total or 1.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float) -> tuple[DataFrame, float]:
    """cells with w, the raked share of each cell, and the worst gap: the margins of w come to agree with the targets, one dimension after another.

    A value without a target keeps weight 0. Targets are joined once. Each dimension's step sums before its shuffle and ends in a written
    table, so no step's plan holds those before it; the worst margin ratio of a sweep, told while it is written, decides whether another
    is needed. Targets that no weights can meet leave a gap over the tolerance.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    columns = cells.columns
    cells = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for dim, target in targets.items():
        cells = cells.join(target.select(dim, F.col("target").alias(f"_to_{dim}")), dim, "left")
    cells, worst = scratch(cells.withColumn("_off", F.lit(0.0))), None
    for _ in range(sweeps):
        for i, dim in enumerate(targets):
            now = cells.groupBy(dim).agg(F.sum("w").alias("s"), F.first(f"_to_{dim}").alias("t"))
            ratio = now.select(dim, F.when(F.col("s") > 0, F.coalesce("t", F.lit(0.0)) / F.col("s")).otherwise(0.0).alias("_ratio"))
            moved = cells.join(ratio, dim).withColumn("w", F.col("w") * F.col("_ratio"))
            off = F.when(F.col("w") > 0, F.abs(F.col("_ratio") - 1)).otherwise(0.0)
            seen = Observation()
            cells = scratch(moved.withColumn("_off", F.greatest(off, F.col("_off") if i else off)).drop("_ratio").observe(seen, F.max("_off").alias("worst")))
        worst = seen.get["worst"]
        if worst is None or worst < tolerance:
            break
    return cells.select(*columns, "w"), float(worst or 0)


def calibrate(cells: DataFrame, share: float, steps: int = 30) -> float:
    """c such that sampling each cell with min(1, c * w / tokens) is expected to keep `share` of all tokens (of positive cells)."""
    cells = cells.where("tokens > 0 AND w > 0").withColumn("r", F.col("w") / F.col("tokens"))
    total, top = cells.agg(F.sum("tokens"), F.max("r")).first()
    if not total:
        return 0.0
    if share >= 1:
        return float("inf")
    c = share * total
    for _ in range(steps):
        full, part, n = cells.agg(F.sum(F.when(F.col("r") * c >= 1, F.col("tokens"))), F.sum(F.when(F.col("r") * c < 1, F.col("w"))), F.count(F.when(F.col("r") * c >= 1, 1))).first()
        if not part:
            break
        new = (share * total - (full or 0)) / part
        if not n or new <= c * (1 + 1e-12):
            break
        c = new
    return c


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, power: float = 0.7, share: float = 0.5, targets: dict[str, DataFrame] | None = None, sweeps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, probability, margin_gap, kept for each row of docs.

    margin_gap: how far, relatively, the worst margin was off its target before the last adjustment (at most `tolerance` unless the
    targets contradict each other, or zero cells stand against them; then raking ends after `sweeps`).

    tokens are white-space words. weight is the raked weight of a token of the document's cell relative to the unraked one;
    probability is calibrated so that `share` of all tokens is expected; kept is decided by the id's MD5, so repeated rows of an
    id go together. Null sources, languages and ids are values like others; texts that are null or empty have no tokens, and
    a cell without tokens has weight and probability 0. Targets are DataFrames (dimension, target) or tempered shares.
    A text of any length is counted whole; equal cells get equal weights, so there are no ties to break; an empty table gives no
    rows. Columns of docs other than the four named are ignored. Documents are never shuffled by a key with many rows: counts by
    cell are summed first, and verdicts of cells are joined back (broadcast by Spark only where they are small).
    """
    topic = surface_topic(F.col(text)) if topic is None else topic
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    facts = scratch(docs.select(F.col(doc_id).alias("doc_id"), label(source).alias("source"), label(lang).alias("lang"), F.coalesce(topic, F.lit(NONE)).alias("topic"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens")))
    cells = scratch(facts.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    targets = targets or {d: tempered(cells, d, power) for d in DIMS}
    cells, gap = rake(cells, targets, sweeps, tolerance)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    c = calibrate(cells, share)
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    verdict = cells.select(*DIMS, (ratio * total).alias("weight"), F.when(ratio > 0, F.least(F.lit(1.0), ratio * F.lit(c))).otherwise(0.0).alias("probability"))
    out = facts.join(verdict, list(DIMS), "left")
    out = out.withColumn("margin_gap", F.lit(gap)).withColumn("kept", unit(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) < F.col("probability"))
    return out.select("doc_id", *DIMS, "tokens", "weight", "probability", "margin_gap", "kept")
