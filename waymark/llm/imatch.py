"""I-Match fingerprints: terms within an inverse-document-frequency band, hashed by several randomised lexicon subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.base import scratch

#: Families of lexicon subsets: (number of subsets, of how many equal cells). A term is in at most one subset of each.
FAMILIES = [(24, 64), (8, 512)]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, A-Z lower-cased; anything beyond ASCII counts as a letter."""
    low = F.translate(text, _UPPER, _LOWER)
    return F.array_distinct(F.filter(F.split(low, r"[\x00-/:-`{-\x7f]+"), lambda t: t != ""))


def lexicon(docs: DataFrame, text: str, low: float, high: float) -> DataFrame:
    """h, the 64-bit hashes of the terms that between `low` and `high` of all rows contain (idf between log 1/high and log 1/low).

    Document frequencies are over all rows; a term is counted once for each task before the shuffle.
    """
    n = docs.count()
    each = docs.select(F.explode(F.transform(terms(F.col(text)), lambda t: F.xxhash64(t))).alias("h"))
    return each.groupBy("h").agg(F.count("*").alias("df")).where((F.col("df") >= low * n) & (F.col("df") <= high * n))


def used(h: Column) -> Column:
    """Whether any subset holds the term."""
    found, bits = F.lit(False), 0
    for some, cells in FAMILIES:
        found = found | (F.pmod(F.shiftright(h, bits), F.lit(cells)) < some)
        bits += 20
    return found


def _in_cell(bits: int, cells: int, i: int):
    return lambda h: F.pmod(F.shiftright(h, bits), F.lit(cells)) == i


def signature(kept: Column) -> Column:
    """The hashes of the sorted distinct terms of each subset, null for a subset without a term."""
    parts, bits = [], 0
    for some, cells in FAMILIES:
        for i in range(some):
            own = F.filter(kept, _in_cell(bits, cells, i))
            parts.append(F.when(F.size(own) > 0, F.xxhash64(own)))
        bits += 20
    return F.array(*parts)


def likeness(a: str, b: str) -> str:
    """SQL: the largest share, over the families, of equal hashes among the subsets that either side fills (0 if none is filled)."""
    shares, at = [], 1
    for some, _ in FAMILIES:
        x, y = (f"slice({v}, {at}, {some})" for v in (a, b))
        filled = f"size(filter(zip_with({x}, {y}, (p, q) -> coalesce(p, q)), v -> v IS NOT NULL))"
        equal = f"size(filter(zip_with({x}, {y}, (p, q) -> p = q), v -> v))"
        shares.append(f"coalesce(try_divide(CAST({equal} AS DOUBLE), {filled}), 0D)")
        at += some
    return f"greatest({', '.join(shares)})"


def ranged(docs: DataFrame, key: str, ranges: int) -> DataFrame:
    """docs with `range`: a number that grows with the key (of any type that has an order), for about equal parts (nulls are in the first).

    The bounds are quantiles of the keys whose hash falls into a share that gives about 100 of them a range.
    """
    n = docs.count()
    every = max(1, n // (100 * ranges))
    some = docs.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).select(key).distinct().orderBy(key).toArrow()[key] if ranges > 1 else []
    picked = [some[i * len(some) // ranges].as_py() for i in range(1, ranges)] if len(some) else []
    bounds = [b for i, b in enumerate(picked) if not i or b != picked[i - 1]]
    at = F.lit(0)
    if bounds:
        at = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key))), F.lit(0))
    return docs.withColumn("range", at)


def with_next(docs: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """docs (with `range`) and the `value` of the next row in ascending `order`; after the last comes the first.

    Each range is sorted by itself; only the first row of each range, one value a range, is looked up across ranges.
    """
    inside = Window.partitionBy("range").orderBy(*order)
    found = docs.withColumn("_lead", F.lead(F.struct(F.col(value).alias("v"))).over(inside))
    heads = docs.groupBy("range").agg(F.min(F.struct(*order, F.col(value).alias("v"))).alias("head"))
    # A row for each range: the first value of the next range, for the last range that of the first.
    ringed = Window.partitionBy(F.lit(0)).orderBy("range")
    after = heads.select("range", F.struct("head.v").alias("v")).select("range", F.coalesce(F.lead("v").over(ringed), F.first("v").over(ringed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    found = found.join(F.broadcast(after), "range", "left")
    return found.withColumn(out, F.coalesce("_lead", "_after")["v"]).drop("_lead", "_after")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", low: float = 1 / 128, high: float = 1 / 8, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The band keeps terms that 1/128 to 1/8 of all rows contain, so the lexicon has at most 128 times as many terms as a row has on
    average, whatever the number of rows; of it the terms that some subset holds go into the plan as a set of numbers.
    Only built-in functions run. Rows are sorted in ranges of ids, of about 32 MB of text where that makes more of them than twice
    the shuffle partitions; a text of any length is one row. Null texts are empty; an empty text fills no subset (a fingerprint of dashes, likeness 0 to
    anything); equal texts have equal fingerprints; rows that repeat an id follow each other in the order of their texts; a
    single row's next row is itself; an empty table gives no rows. Columns other than the two named are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    band = lexicon(base, "text", low, high).where(used(F.col("h"))).select("h")
    held = sorted(r[0] for r in band.collect())
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = ranges or min(4096, max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, size // 32_000_000))
    cut = ranged(base, "doc_id", ranges)
    rows = with_next(cut, ["doc_id", "t"], "text", "next")
    q = "CAST(floor(char_length(text) / 4) AS INT)"
    rows = rows.withColumn("edited", F.expr(f"concat(substring(text, 1, CAST(char_length(text) AS INT) - {q}), substring(next, 1, {q}))"))
    member = f"h IN ({', '.join(f'{h}L' for h in held)})" if held else "false"
    for c in ("text", "edited"):
        rows = rows.withColumn(f"{c}_h", F.transform(terms(F.col(c)), lambda t: F.xxhash64(t))).withColumn(f"{c}_h", F.sort_array(F.expr(f"filter({c}_h, h -> {member})")))
    rows = scratch(rows.select("doc_id", "range", F.char_length("text").cast("long").alias("n_chars"), "t", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signature(F.col("text_h")).alias("f"), signature(F.col("edited_h")).alias("g")))
    rows = with_next(rows, ["doc_id", "t"], "f", "nf")
    shown = lambda c: F.array_join(F.transform(F.col(c), lambda x: F.lower(F.hex(x))), "-", "_")
    return rows.select("doc_id", "n_chars", "edited_sha256", shown("f").alias("fingerprint"), shown("g").alias("edited_fingerprint"), F.expr(likeness("f", "g")).alias("near_edited"), F.expr(likeness("f", "nf")).alias("near_next"))
