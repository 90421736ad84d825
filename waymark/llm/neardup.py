"""Near-duplicate documents by b-bit MinHash: banded minima find candidates, packed low bits estimate, full sets confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.base import cut_batches, mix, prepare, scratch, shingle_sets

HASHES, ROWS, BITS = 160, 4, 2
BANDS = HASHES // ROWS
LANES = HASHES * BITS // 64
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_ODD = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) | np.uint64(1)
SALTS = 16
#: How far under the threshold an estimate may be: 3.9 standard deviations of 160 two-bit lanes at 0.75.
SLACK = 0.16
#: Minima of the closer signature, and its slack of 4 standard deviations.
FINE, FINE_SLACK = 1024, 0.065
#: Rows of a bucket that are joined in one place; larger buckets are split.
PER_PART = 1000


def sketch(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the documents that have shingles: index, set size, set key [n, 2], band keys [n, BANDS], packed low bits [n, LANES].

    doc and h are sorted and distinct. A band's key hashes ROWS minima; each minimum leaves its BITS low bits in the signature.
    """
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    n = len(start)
    if not n:
        return start, start, np.zeros((0, 2), np.uint64), np.zeros((0, BANDS), np.uint64), np.zeros((0, LANES), np.uint64)
    size = np.diff(np.append(start, len(doc)))
    key = np.stack([np.add.reduceat(mix(h ^ np.uint64(s)), start) for s in (0x1234567, 0x89ABCDEF)], 1)
    bands, packed = np.zeros((n, BANDS), np.uint64), np.zeros((n, LANES), np.uint64)
    for j in range(HASHES):
        low = np.minimum.reduceat((h ^ _SEEDS[j]) * _ODD[j], start)
        low = mix(low)
        bands[:, j // ROWS] = bands[:, j // ROWS] * np.uint64(0x9FB21C651E98DF25) + low
        packed[:, j * BITS // 64] |= (low & np.uint64((1 << BITS) - 1)) << np.uint64(j * BITS % 64)
    return doc[start], size, key, mix(bands ^ np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)), packed


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, k1, k2, bands array<long>, sig array<long>; a narrow pass over whole texts."""
    prepare(docs.sparkSession)
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_shingles long, k1 long, k2 long, bands array<long>, sig array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "text"):
            n = b.num_rows
            at, size, key, bands, packed = sketch(*shingle_sets(b.column(1)))
            n_shingles = np.zeros(n, np.int64)
            n_shingles[at] = size
            keys = np.zeros((n, 2), np.int64)
            keys[at] = key.view(np.int64)
            has = np.zeros(n, np.int64)
            has[at] = 1
            lists = lambda m, width: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * width)]), pa.int32()), pa.array(m.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_shingles), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists(bands, BANDS), lists(packed, LANES)], ["doc_id", "n_shingles", "k1", "k2", "bands", "sig"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def estimate(a: str, b: str, hashes: int = HASHES) -> str:
    """SQL: the resemblance that two signatures show, by the share of equal lanes less what chance makes equal."""
    # A lane of two bits differs if either of its bits does.
    words = range(hashes * BITS // 64)
    lanes = " + ".join(f"bit_count((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & 6148914691236517205L)" for i in words)
    return f"((1 - ({lanes}) / {float(hashes)}) - {0.5**BITS}) / {1 - 0.5**BITS}"


def fine_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, fine array<long>: FINE minima's low bits of docs (doc_id, text), for what needs a closer estimate."""
    seeds = mix(np.arange(5001, 5001 + FINE, dtype=np.uint64))
    odd = mix(np.arange(9001, 9001 + FINE, dtype=np.uint64)) | np.uint64(1)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fine array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut_batches(batches, "text"):
            doc, h = shingle_sets(b.column(1))
            if not len(doc):
                continue
            start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            packed = np.zeros((len(start), FINE * BITS // 64), np.uint64)
            for j in range(FINE):
                low = mix(np.minimum.reduceat((h ^ seeds[j]) * odd[j], start))
                packed[:, j * BITS // 64] |= (low & np.uint64((1 << BITS) - 1)) << np.uint64(j * BITS % 64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1) * packed.shape[1], pa.int32()), pa.array(packed.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[start])), lists], ["doc_id", "fine"])

    return docs.mapInArrow(run, schema)


def only(texts: DataFrame, ids: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """The rows of texts whose doc_id is in ids (doc_id, distinct), without a shuffle of the others.

    Hashed ids mark bits of maps of 4 KB that are broadcast (16 MB at most, by most_bits); few others pass these, and the exact
    join removes them. With very many ids the maps let more rows through to the join; the result is the same.
    """
    bits = 1 << 15
    n = ids.count()
    while bits < min(16 * n, most_bits):
        bits *= 2
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    maps = ids.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("_map")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("_bits"))
    held = texts.withColumn("_p", place).withColumn("_map", F.expr("_p div 32768")).join(F.broadcast(maps), "_map")
    held = held.where("(CAST(conv(hex(substring(_bits, CAST(_p % 32768 div 8 AS INT) + 1, 1)), 16, 10) AS INT) >> CAST(_p % 8 AS INT)) & 1 = 1")
    # An inner join: a semi-join would be pushed below the maps, to all texts.
    return held.drop("_p", "_map", "_bits").join(ids, "doc_id")


def split(rows: DataFrame, per: int) -> DataFrame:
    """rows (bucket, doc_id, n: how many the bucket has) with `part`: a bucket's rows dealt into parts of about `per`."""
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.expr(f"(n - 1) div {per} + 1")))


def spread(buckets: DataFrame, per: int) -> DataFrame:
    """A row a bucket (with n), repeated for each part that split() makes."""
    return buckets.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {per})")))


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Each b is a centre: its text goes once to every salt that has partners of it, and the partners' texts stream past it in
    sorted order, so that a task holds one centre's set and one batch of texts, whatever the number of partners.
    """
    pairs = scratch(pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(64))))
    if pairs.isEmpty():
        return pairs.select("a", "b")
    texts = scratch(only(texts, scratch(pairs.select("a").union(pairs.select("b")).distinct().toDF("doc_id"))))
    centres = pairs.select("b", "salt").distinct()
    schema = f"a {pairs.schema['a'].dataType.simpleString()}, b {pairs.schema['b'].dataType.simpleString()}"
    left = pairs.join(texts, F.col("a") == F.col("doc_id")).select("b", "salt", F.lit(1).alias("role"), "a", "text")
    right = centres.join(texts, F.col("b") == F.col("doc_id")).select("b", "salt", F.lit(0).alias("role"), F.col("b").alias("a"), "text")
    dealt = left.unionByName(right).repartition("b", "salt").sortWithinPartitions("b", "salt", "role", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in cut_batches(batches, "text"):
            doc, h = shingle_sets(batch.column(4))
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            a, b, role = batch.column(3).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist()
            keep = []
            for i in range(batch.num_rows):
                mine = h[first[i] : first[i + 1]]
                if role[i] == 0:
                    centre, own = b[i], mine
                elif b[i] == centre and len(own) and len(mine):
                    at = np.searchsorted(own, mine)
                    at[at == len(own)] = 0
                    both = int((own[at] == mine).sum())
                    if 100 * both >= percent * (len(own) + len(mine) - both):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], batch.schema.field(3).type), pa.array([b[i] for i in keep], batch.schema.field(0).type)], ["a", "b"])

    return scratch(dealt.mapInArrow(run, schema).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of `edges` (a, b) reaches; minima of neighbours and pointer jumping."""
    both = scratch(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct())
    # At first the smallest neighbour; the node itself if that is smaller.
    label = scratch(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        low = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = scratch(low.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component")))
        label = new.drop("was")
        if new.where("component < was").isEmpty():
            return label


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Sets are the distinct 5-word shingles of the lower-cased (A-Z) words; fewer words are one shingle. Documents are linked where
    100 * intersection >= percent * union; component_id is the smallest linked id, kept says that it is the row's own.
    Null, empty or blank texts have empty sets and are linked with nothing, as are rows with a null id (component null, kept).
    Rows of one id are one document. Equal sets form a class of which one member is compared: hot copies cost no pairs.

    160 minima in 40 bands of 4 rows miss a pair at the threshold with probability (1 - 0.75**4)**40 < 3e-7. In each bucket the
    document that meets most others is compared with all; then, where a bucket still holds several components, the most met of the
    others. In the buckets that are left, documents outside the commonest component meet those of other components, where a closer
    signature of 1024 minima decides. A pair goes on if its signatures' estimates are within the slack; only
    texts of such pairs are shuffled, once, and full sets decide. Buckets of any size are dealt into parts of about 1000 rows.

    A text of any length is one set, made in one task by arrays of its words; ties cannot matter, as components take the
    smallest id; columns other than the two named are ignored, so their names may clash; an empty table gives no rows.
    """
    spark = docs.sparkSession
    facts = scratch(sketches(docs, doc_id, text))
    full = facts.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    classes = scratch(classes.where("rep < last").drop("last").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))))
    keyed = full.select("doc_id", "n_shingles", "k1", "k2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    member = scratch(keyed.join(classes, ["k1", "k2", "n_shingles", "salt"]).select("doc_id", "rep").where("doc_id <> rep").distinct())
    reps = full.join(member.select("doc_id"), "doc_id", "left_anti")

    rows = scratch(reps.selectExpr("doc_id", "explode(bands) AS bucket").distinct())
    shared = scratch(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    # Rows of large buckets are dealt into parts before they meet their bucket's row.
    large = shared.where(F.col("n") > 4 * PER_PART)
    large = F.broadcast(large) if large.count() <= 10_000 else large
    of_large = split(rows.join(large, "bucket"), PER_PART)
    of_small = rows.join(shared.where(F.col("n") <= 4 * PER_PART), "bucket").withColumn("part", F.lit(0).cast("long"))
    crowded = scratch(of_small.unionByName(of_large))

    def repeated(buckets: DataFrame) -> DataFrame:
        """A row a bucket, with n, for each part of its rows."""
        return buckets.withColumn("part", F.explode(F.expr(f"sequence(0L, IF(n > {4 * PER_PART}, (n - 1) div {PER_PART}, 0L))")))

    # How many others a document meets: an original meets its copies more often than they meet each other.
    met = crowded.groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("met"))
    bucket = scratch(crowded.join(met, "doc_id"))
    sig = scratch(full.join(met.select("doc_id"), "doc_id", "left_semi").select("doc_id", "sig").dropDuplicates(["doc_id"]))
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    floor = percent / 100 - SLACK

    def likely(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
        return p.where(f"{estimate('sa', 'sb')} >= {floor}").select("a", "b")

    def named(found: DataFrame) -> DataFrame:
        """The rows of buckets of three or more that still hold several components, with each bucket's commonest (main) and its rows (total)."""
        comp = scratch(bucket.where("n > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
        by = comp.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.first("n").alias("n")).groupBy("bucket")
        mixed = by.agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.first("n").alias("n"), F.sum("m").alias("total"), F.max(F.struct("m", "component")).alias("most")).where("c1 < c2")
        mixed = repeated(mixed.select("bucket", "n", "total", F.col("most.component").alias("main")))
        return scratch(comp.join(mixed.select("bucket", "part", "total", "main"), ["bucket", "part"]))

    # First each bucket's most met document against its others,
    centre = bucket.groupBy("bucket").agg(F.max(F.struct("met", F.col("doc_id").alias("b"))).alias("c"), F.first("n").alias("n"))
    centre = repeated(centre).select("bucket", "part", F.col("c.b").alias("b"))
    meets = lambda x, y, also: x.join(y.withColumnsRenamed({"bucket": "_bucket", "part": "_part"}), F.expr(f"bucket = _bucket AND part = _part AND {also}"))
    tried = scratch(meets(bucket.select("bucket", "part", F.col("doc_id").alias("a")), centre, "a <> b").select("a", "b").distinct())
    edges = confirm(likely(tried), texts, percent)
    found = components(edges)
    # then the most met outside the first one's component against all of other components,
    left = named(found)
    first = left.groupBy("bucket").agg(F.max(F.struct("met", "doc_id", F.col("component").alias("c"))).alias("f"), F.first("n").alias("n"))
    others = scratch(meets(left, repeated(first).select("bucket", "part", F.col("f.c").alias("fc")), "component <> fc").drop("_bucket", "_part"))
    second = others.groupBy("bucket").agg(F.max(F.struct("met", F.col("doc_id").alias("b"), F.col("component").alias("cb"))).alias("s"), F.first("n").alias("n"))
    second = repeated(second).select("bucket", "part", "s.b", "s.cb")
    again = scratch(meets(left.select("bucket", "part", F.col("doc_id").alias("a"), "component"), second, "component <> cb").select("a", "b").distinct())
    more = confirm(likely(again), texts, percent)
    if not more.isEmpty():
        edges = edges.union(more)
        found = components(edges)
        left = named(found)
    # at last in the buckets that remain those outside a bucket's commonest component against all of other components. A closer
    # signature tells near from nearly near; each pair leaves the join in its first common bucket only.
    facing = scratch(left.groupBy("doc_id").agg(F.collect_set("bucket").alias("all")))
    if not facing.isEmpty():
        fine = fine_signatures(only(texts, facing.select("doc_id")).dropDuplicates(["doc_id"]))
        signs = scratch(facing.join(sig, "doc_id").join(fine, "doc_id"))
        # The same parts of the rows that count here are dealt anew.
        open_rows = scratch(split(left.select("bucket", "doc_id", "component", "main", F.col("total").alias("n")), PER_PART).join(signs, "doc_id"))
        x = spread(open_rows.where("component <> main").drop("part"), PER_PART).select("bucket", "part", F.col("doc_id").alias("a"), F.col("component").alias("ca"), F.col("sig").alias("sa"), F.col("fine").alias("fa"), F.col("all").alias("la"), "main")
        y = open_rows.select("bucket", "part", F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("sig").alias("sb"), F.col("fine").alias("fb"), F.col("all").alias("lb"))
        # Two that are both outside the commonest component meet once.
        meet = f"""CASE WHEN ca = cb OR (cb <> main AND ca > cb) OR {estimate('sa', 'sb')} < {floor} THEN false
          WHEN {estimate('fa', 'fb', FINE)} < {percent / 100 - FINE_SLACK} THEN false ELSE array_min(array_intersect(la, lb)) = bucket END"""
        rest = scratch(meets(x, y, meet).select("a", "b").distinct())
        old = tried.union(again)
        rest = rest.join(old.union(old.select("b", "a")).distinct(), ["a", "b"], "left_anti")
        more = confirm(rest, texts, percent)
        if not more.isEmpty():
            found = components(edges.union(more))
    # A member takes its representative's component.
    of_reps = found.withColumnRenamed("node", "rep")
    hung = member.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    salted = of_reps.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    of_members = hung.join(salted, ["rep", "s"], "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    every = of_members.union(found.select("node", "component")).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = facts.select("doc_id", "n_shingles").join(every, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
