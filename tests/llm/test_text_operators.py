"""Operators on texts against plain versions, and their defined results for odd rows."""

import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from waymark.llm import langid, packing, quality, tokencount

BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = [
    (0, None), (1, ""), (2, " \n\t"), (3, "a  b\n\n c"), (4, "<|endoftext|> x<|endoftext|>"), (5, "foo <|endoftext|>bar  "), (6, "\x1c a!\x1c b"), (7, "　x  y"), (8, "it's we'll I'm 12ab½ 日本語 😀"),
    (9, "word " * 30_000), (10, "same"), (10, "same"), (None, "null id"), (11, "x" * 20_000), (12, "\r\n\r\n a\x00b"),
]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("n_words", F.lit(1)).withColumn("source", F.lit(None).cast("string"))


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark):
    lib = library()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    got = sorted(tuple(r) for r in tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), BPE).collect())
    want = sorted((i, len((t or "").encode()), n := len(ids_of(lib, t)), n > 512) for i, t in rows)
    assert got == want
    assert tokencount.count_tokens(odd(spark).limit(0), BPE).count() == 0
    assert tokencount.count_tokens(odd(spark), BPE).columns == ["doc_id", "score", "n_words", "source", "n_bytes", "n_tokens", "over_limit"]


def check_packing(rows, pieces, window=1024):
    lib = library()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ids_of(lib, t) + [0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        # Rows that repeat an id are packed once each; their texts are equal here.
        ids, at, left = want[i][0], 0, sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in own)
        copies = len(want[i])
        for k in range(0, len(left), copies):
            assert len({x[:3] for x in left[k : k + copies]}) == 1 or copies > 1
        if copies == 1:
            for start, length, crc, total in left:
                assert start == at and total == len(ids)
                assert crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + length]))
                at += length
            assert at == len(ids)
        else:
            assert sum(x[1] for x in left) == copies * len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    total = sum(p["length"] for p in pieces)
    assert len(by_seq) <= total // window + 2


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], packing.pack(docs, BPE).collect())


def test_packing_odd_rows(spark):
    check_packing(ODD, packing.pack(odd(spark), BPE).collect())
    assert packing.pack(odd(spark).limit(0), BPE).count() == 0


def test_packing_plan_is_complete():
    import numpy as np

    rng = np.random.default_rng(1)
    hist = np.concatenate([[0], rng.integers(0, 50, 1024)])
    places, used, at, first = packing.plan(hist, 1024, 64)
    taken = defaultdict(int)
    for length, lo, hi, _, _ in places:
        assert lo == taken[length] and hi > lo
        taken[length] = hi
    assert all(taken[i] == used[i] <= hist[i] for i in range(1025))
    assert sum(hi - lo for n, lo, hi, _, _ in places for n in [n]) > 0.5 * hist.sum()


def test_quality_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] + [(1000 + k, t, None) for k, (_, t) in enumerate(ODD)] + [(2000, "a b c d e\n" * 3 + "x\n\nx\n  x", "s")]
    got = {}
    for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))
        assert not (r["kept"] and r["base_failed"])
    for i, t, _ in rows:
        w = brute.quality(t)
        assert got[i][0] == (*w, w[0] < 10 or 100 * w[4] > 20 * w[0])
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_bad_hosts_are_rejected_and_small_ones_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "short" if i % 10 else good, "bad") for i in range(400)] + [(1000 + i, good if i % 10 else "short", f"h{i % 7}") for i in range(700)] + [(5000, "short", "tiny"), (5001, good, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (10_000, 0):
        got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, small_hosts=limit).collect()}
        assert len(got) == len(rows)
        assert not any(got[i] for i in range(400))
        assert got[5001] and sum(got[1000 + i] for i in range(700)) == 630


def test_crf_messages_equal_plain_forward_backward():
    import numpy as np

    rng = np.random.default_rng(3)
    crf = langid.Crf(["a", "b", "c"], np.zeros((4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    count = np.array([0, 1, 5, 32, 33, 100])
    em = rng.normal(size=(count.sum(), 3))
    got, at = langid.label_shares(em, count, crf), 0
    for d, n in enumerate(count):
        if n:
            gamma, _ = langid.marginals(em[None, at : at + n], np.ones((1, n), bool), crf)
            assert np.allclose(got[d], gamma.sum((0, 1)), atol=1e-3)
        at += n


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    crf = langid.train(docs.where(~held), max_rows=500)
    seen = langid.identify(docs.where(held), crf).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in seen) >= 0.97 * len(seen)
    assert all(0 <= r["score"] <= 1 for r in seen)
    got = langid.identify(odd(spark), crf).collect()
    blank = {0, 1, 2}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in blank) for r in got) and len(got) == len(ODD)
    assert langid.train(docs.where("false")) is None
    assert {r["lang_pred"] for r in langid.identify(docs.limit(3), None).collect()} == {"und"}


@pytest.mark.parametrize("text", ["the of and to in is der die und das ist nicht " * 4])
def test_code_switching_follows_the_words(text):
    crf = langid.fit([("the of and to in is that it for was " * 30, "en"), ("der die und das ist nicht ein mit auf von " * 30, "de")] * 5, bits=12)
    import pyarrow as pa

    labels, scores = langid.predict(pa.array(["the of and to in", "der die und das", text], pa.large_string()), crf)
    assert labels[:2] == ["en", "de"] and scores[2] < 0.9
