"""The divergence audit against a plain version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from waymark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, top=200):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(brute.lower(text or ""))
        docs[lang].update(set(found))
        count[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        each = {s: {t: count[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(each[s][t] for s in sources) for t in kept}
        shares = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: shares(each[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(h, sum((p[s][t] - p[h][t]) ** 2 // p[h][t] for t in kept)) for h in sources if h != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if each[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(found) if part == "pair" or n < top]
    return sorted(out)


def texts():
    rng = np.random.default_rng(3)
    words = ["The", "the", "über", "ÜBER", "don't", "a1b", "x_y", "naïve", "日本", "w0rd", "ПРИВЕТ", "é", "z"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(120):
        lang, source = [None, "", "en", "de"][i % 4], f"s{i % 5}" if i % 7 else None
        rows.append((" ".join(rng.choice(words, rng.integers(0, 30))), lang, source))
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("only two texts", "fr", "s1"), ("only two texts", "fr", "s3"), ("solo " * 5, "it", "s1"), ("long " * 30_000 + "the", "en", "s1")]
    return rows + rows[:3]


@pytest.mark.parametrize("blocks", [{}, {"block_terms": 4, "block_sources": 2}])
def test_equals_the_plain_version(spark, blocks):
    rows = texts()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    for c in ("term", "n", "docs", "one", "v", "block", "at", "mine", "part", "item", "value", "rank", "blocks", "parts"):
        df = df.withColumn(c, F.lit("clash"))
    got = divergence.audit(df, **blocks)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_top_terms_are_cut_over_blocks(spark):
    rows = texts()
    got = divergence.audit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA), top=3, block_terms=5)
    assert sorted(map(tuple, got.collect())) == plain(rows, top=3)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    count = np.array([[0, 7, 12_345_678_901, 3_999_999_999_999_999]])
    total = np.array([[4_100_000_000_000_003]])
    assert divergence.share(count, total).tolist() == [[1 + 10**9 * (c + 1) // int(total[0, 0]) for c in count[0].tolist()]]
    assert divergence.share(np.array([4]), np.array([5])).tolist() == [1 + 10**9]
