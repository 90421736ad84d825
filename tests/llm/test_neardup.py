import pytest
from pyspark.sql import functions as F

from tests.llm.brute import near_duplicates
from waymark.llm import neardup

SCHEMA = "doc_id long, text string"


def test_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = near_duplicates([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link(docs).collect()}
    assert got == want


def test_chains_and_classes(spark):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(12):  # neighbours are near, ends are not
        rows.append((100 - k, " ".join(base[2 * k :] + [f"x{i}" for i in range(2 * k)])))
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, rows[5][1].upper().replace("W", "w"))]
    want = near_duplicates(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    assert len({c for _, c, _ in got.values()}) < 5


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (7, "é b"), (8, "É b"), (9, "one"), (9, "one")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_shingles", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in neardup.link(docs).collect())
    assert got == [(0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 4, False), (9, 1, 4, False)]
    assert neardup.link(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("words", [3000])
def test_long_text(spark, words):
    text = " ".join(f"q{i % 997}x{i % 31}" for i in range(words * 20))
    got = neardup.link(spark.createDataFrame([(1, text), (2, text + " end"), (3, "a b c d e f")], SCHEMA)).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == [1, 1, 3]
