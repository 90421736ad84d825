"""URL rules, fingerprints, licences, mixing, language-model scores and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from waymark.llm import imatch, licenses, mixing, queries, urlfilter

SF = "/root/testdata/sf0.001"


def test_url_rules(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("com/de/", "block"), ("com/de/", "allow"), ("a.com/", "allow"), (None, "block")]
    urls = ["http://x.example.ORG/es/1?q", "https://example.org", "http://example.org/", "notaurl", None, "http://notexample.org/es/x", "http://a.com/de/1", "http://com/de/", "http://b.com#/de/", "http://a.com/deep", "://h.org/p#f", "http://" + "x" * 3000 + ".org/" + "y" * 3000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit("clash"))

    def plain(url):
        rest = (url or "").partition("://")
        host = path = ""
        if rest[1]:
            cut = min([i for i in (rest[2].find(c) for c in "/?#") if i >= 0], default=len(rest[2]))
            host = brute.lower(rest[2][:cut])
            path = rest[2][cut:].split("?")[0].split("#")[0]
        best = None
        for r, v in rules:
            if r:
                h, p = r.split("/", 1)
                if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(r), v) > (len(best[0]), best[1])):
                    best = (r, v)
        return (host, path, *(best or (None, "allow")))

    made = urlfilter.verdicts(pages, spark.createDataFrame(rules, "rule string, verdict string"))
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in made.collect()), key=str)
    want = sorted(((r["page_id"], *plain(r["url"])) for r in pages.collect()), key=str)
    assert got == want
    assert urlfilter.verdicts(pages.limit(0), spark.createDataFrame(rules, "rule string, verdict string")).count() == 0
    assert {r["verdict"] for r in urlfilter.verdicts(pages, spark.createDataFrame([], "rule string, verdict string")).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    """Every listed key passes the filter, and few others do."""
    import numpy as np

    words = urlfilter.bloom(spark.range(5000).selectExpr("concat('k', id) AS key"))
    assert words.shape[1] == 8
    probe = spark.range(10_000).selectExpr("id", "concat('k', id) AS key").selectExpr("id", "xxhash64(key) AS h", *(f"{urlfilter._bit(o)} AS b{i}" for i, o in enumerate(urlfilter._ODD))).orderBy("id").toPandas()
    block = (probe["h"].to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.int64) % len(words)
    passed = np.all([(words[block, i] & probe[f"b{i}"].to_numpy().view(np.uint64)) != 0 for i in range(8)], axis=0)
    assert passed[:5000].all() and passed[5000:].mean() < 0.02


def fingerprint_rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    extra = [(10_000, None), (10_001, ""), (10_002, rows[0][1]), (10_003, "é" * 9)]
    full = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("range", F.lit("clash")).withColumn("t", F.lit(0))
    got = fingerprint_rows(imatch.fingerprints(full, ranges=5))
    every = rows + [(i, t or "") for i, t in extra]
    for k, (i, t) in enumerate(every):
        q = len(t) // 4
        edited = t[: len(t) - q] + every[(k + 1) % len(every)][1][:q]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[10_002]["fingerprint"] == got[rows[0][0]]["fingerprint"]
    assert set(got[10_001]["fingerprint"]) <= {"_", "-"} and got[10_001]["near_next"] == 0
    near = [r["near_edited"] for r in got.values()]
    far = [r["near_next"] for r in got.values()]
    assert sum(near) / len(near) > 0.4 > 10 * sum(far) / len(far)
    assert imatch.fingerprints(full.limit(0)).count() == 0
    one = imatch.fingerprints(full.where("doc_id = 10002")).first()
    assert one["n_chars"] == len(rows[0][1])
    double = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d")], "doc_id long, text string")
    assert imatch.fingerprints(double).count() == 3


def plain_fingerprint(text, lexicon):
    """One fingerprint: hashes of the sorted lexicon terms in each cell that a subset stands for."""
    import re
    import struct

    import xxhash

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    term = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42))
    held = sorted(h for h in {term(t) for t in re.split(r"[\x00-/:-`{-\x7f]+", brute.lower(text)) if t} if lexicon is None or h in lexicon)
    if lexicon is None:
        return held
    out, bits = [], 0
    for some, cells in imatch.FAMILIES:
        for i in range(some):
            own = [h for h in held if (h >> bits) % cells == i]
            seed = 42
            for h in own:
                seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=seed)
            out.append(signed(seed) if own else None)
        bits += 20
    return out


def plain_likeness(a, b):
    shares, at = [], 0
    for some, _ in imatch.FAMILIES:
        x, y = a[at : at + some], b[at : at + some]
        filled = sum(p is not None or q is not None for p, q in zip(x, y, strict=True))
        shares.append(sum(p is not None and p == q for p, q in zip(x, y, strict=True)) / filled if filled else 0.0)
        at += some
    return max(shares)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_fingerprints_equal_a_plain_version(spark, kind):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()] + [(9_000, ""), (9_001, "x" * 200_000 + " the end")]
    if kind == "string":
        rows = [(f"id{i}", t) for i, t in rows]
    rows.sort()
    counts = Counter(h for _, t in rows for h in plain_fingerprint(t, None))
    lexicon = {h for h, n in counts.items() if len(rows) / 128 <= n <= len(rows) / 8}
    own = [plain_fingerprint(t, lexicon) for _, t in rows]
    shown = lambda f: "-".join("_" if v is None else format(v % (1 << 64), "x") for v in f)
    got = fingerprint_rows(imatch.fingerprints(spark.createDataFrame(rows, f"doc_id {kind}, text string"), ranges=7))
    for k, (i, t) in enumerate(rows):
        q = len(t) // 4
        edited = plain_fingerprint(t[: len(t) - q] + rows[(k + 1) % len(rows)][1][:q], lexicon)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (shown(own[k]), shown(edited))
        assert math.isclose(got[i]["near_edited"], plain_likeness(own[k], edited), abs_tol=1e-9)
        assert math.isclose(got[i]["near_next"], plain_likeness(own[k], own[(k + 1) % len(rows)]), abs_tol=1e-9)


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    parts = mit.split("\n")
    rows = [(1, mit), (2, "\n".join(reversed(parts))), (3, "Text. Licensed under the Apache License, Version 2.0.\nmore"), (4, None), (5, ""), (6, "nothing"), (7, "word. " * 20_000 + "Licensed under CC BY-NC 4.0."), (3, "other"), (None, "MIT License\n" + parts[0]), (8, "Licensed under CC BY-NC 4.0. Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("licenses", F.lit(1))
    got = sorted(((r["doc_id"] or 0, r["licenses"], r["n_licenses"]) for r in licenses.scan(docs).collect()), key=str)
    want = [(0, "MIT", 1), (1, "MIT", 1), (2, "", 0), (3, "Apache-2.0", 1), (3, "", 0), (4, "", 0), (5, "", 0), (6, "", 0), (7, "CC-BY-NC-4.0", 1), (8, "CC-BY-NC-4.0,MIT", 2)]
    assert got == sorted(want, key=str)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_raking_meets_the_margins(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    targets = {"lang": spark.createDataFrame([("en", 0.4), ("de", 0.2), ("fr", 0.2), ("es", 0.2)], "lang string, target double")}
    targets["topic"] = spark.createDataFrame([("prose", 0.7), ("table", 0.1), ("legal", 0.1), ("contact", 0.05), ("mention", 0.05)], "topic string, target double")
    got = mixing.mix(docs, targets=targets, share=0.5)
    totals = got.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("weight")).alias("w")).collect()
    whole = sum(r["w"] for r in totals)
    assert all(math.isclose(r["w"] / whole, {"en": 0.4}.get(r["lang"], 0.2), abs_tol=0.03) for r in totals)
    tokens, expected, kept = got.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability")), F.sum(F.when(F.col("kept"), F.col("tokens")))).first()
    assert math.isclose(expected, 0.5 * tokens, rel_tol=1e-6) and 0.3 * tokens < kept < 0.7 * tokens


def test_mixing_equals_plain_raking(spark):
    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), share=0.4).collect()
    tokens = Counter()
    for r in got:
        tokens[r["source"], r["lang"], r["topic"]] += r["tokens"]
    total = sum(tokens.values())
    targets = []
    for d in range(3):
        by = Counter()
        for c, n in tokens.items():
            by[c[d]] += n
        by = {v: n**0.7 for v, n in by.items() if n}
        targets.append({v: t / sum(by.values()) for v, t in by.items()})
    w = {c: n / total for c, n in tokens.items()}
    for _ in range(400):
        for d in range(3):
            now = Counter()
            for c, x in w.items():
                now[c[d]] += x
            w = {c: x * targets[d].get(c[d], 0) / now[c[d]] if now[c[d]] else 0.0 for c, x in w.items()}
    ratio = {c: w[c] / n if n else 0.0 for c, n in tokens.items()}
    low, high = 0.0, 1e18
    for _ in range(300):  # the factor at which 0.4 of all tokens are expected
        c = (low + high) / 2
        low, high = (c, high) if sum(n * min(1, c * ratio[k]) for k, n in tokens.items()) < 0.4 * total else (low, c)
    assert got[0]["margin_gap"] < 1e-6
    for r in got:
        k = (r["source"], r["lang"], r["topic"])
        assert math.isclose(r["weight"], ratio[k] * total, rel_tol=1e-3) and math.isclose(r["probability"], min(1, low * ratio[k]), rel_tol=1e-3)
        assert r["kept"] == (int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:13], 16) / 2**52 < r["probability"])


def test_contradicting_targets_are_told(spark):
    rows = [(i, "a b c", "s" if i < 5 else "t", "en" if i < 5 else "de") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": spark.createDataFrame([("s", 0.9), ("t", 0.1)], "source string, target double"), "lang": spark.createDataFrame([("en", 0.1), ("de", 0.9)], "lang string, target double")}
    assert mixing.mix(docs, targets=targets, sweeps=4).first()["margin_gap"] > 0.5


def test_mixing_odd_rows(spark):
    rows = [(1, None, "a", "en"), (2, "", None, None), (3, "x y z", "a", None), (None, "x y", "b", "en"), (3, "x y z", "a", None), (4, "long " * 30_000, "b", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("tokens", F.lit("clash")).withColumn("w", F.lit(0))
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and all(0 <= r["probability"] <= 1 and r["kept"] is not None for r in got)
    assert len({(r["kept"], r["probability"]) for r in got if r["doc_id"] == 3}) == 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_queries_carry_their_columns(spark):
    assert set(queries.queries()) >= {"op1_packing", "op10_quality"}


def plain_pipeline(rows):
    """Quality and near-duplicates by plain code on (id, text); language and mixing are taken from the stages themselves."""
    kept = [(i, t) for i, t in rows if not ((q := brute.quality(t))[0] < 10 or 100 * q[4] > 20 * q[0])]
    return {i for i, (_, _, k) in brute.near_duplicates(kept).items() if k}


def test_pipeline(spark):
    import corpus_pipeline
    from waymark.llm.base import scratch

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch(stage(spark, docs, SF))
        made[name] = docs
    for name in ("language", "quality", "near_duplicates", "mixing"):
        assert made[name].columns == columns
    rows = [(r["doc_id"], r["text"]) for r in made["language"].select("doc_id", "text").collect()]
    assert {r["doc_id"] for r in made["near_duplicates"].collect()} == plain_pipeline(rows)
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in made["mixing"].collect()}
    texts = {r["doc_id"]: r["text"] for r in made["mixing"].collect()}
    lib, whole = Tokenizer.from_file(queries.BYTE_BPE), {}
    for r in docs.orderBy("doc_id", "start").collect():
        assert len(r["ids"]) == 4 * r["length"] and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        whole[r["doc_id"]] = whole.get(r["doc_id"], b"") + bytes(r["ids"])
    assert all(whole[i] == b"".join(x.to_bytes(4, "little") for x in [*lib.encode(t, add_special_tokens=False).ids, 0]) for i, t in texts.items())


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_odd_rows(spark, stage):
    import corpus_pipeline

    text = " ".join(f"wort{i}" for i in range(50))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, text, "de", "a", 1), (3, text, "de", "a", 1), (None, text + " x", "de", None, 1), (4, text + " y", "de", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "")
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    if stage < 2:
        assert sorted(ids, key=str) == [3, 3, 4, None]
    if stage == 2:
        assert ids.count(3) == 1 and 4 not in ids
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), "").count() == 0
