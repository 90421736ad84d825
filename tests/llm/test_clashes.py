"""Every operator and stage on a table whose extra columns have the names that its code uses inside."""

import inspect
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import divergence, imatch, kmtree, langid, licenses, mixing, mixlm, neardup, packing, quality, tokencount, urlfilter, whitening

BPE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(40).drop("n_chars")


def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").limit(60).select("vec_id", "embedding")


def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet").limit(30).select("page_id", "url")


RULES = "SELECT 'org/' AS rule, 'allow' AS verdict UNION ALL SELECT 'com/de/', 'block'"
CASES = {
    "packing": (packing, documents, lambda s, d: packing.pack(d, BPE, window=256)),
    "langid": (langid, documents, lambda s, d: langid.identify(d, langid.train(d, max_rows=40))),
    "urlfilter": (urlfilter, pages, lambda s, d: urlfilter.verdicts(d, s.sql(RULES))),
    "imatch": (imatch, documents, lambda s, d: imatch.fingerprints(d)),
    "neardup": (neardup, documents, lambda s, d: neardup.link(d)),
    "mixing": (mixing, documents, lambda s, d: mixing.mix(d)),
    "licenses": (licenses, documents, lambda s, d: licenses.scan(d)),
    "mixlm": (mixlm, documents, lambda s, d: mixlm.score(d, F.col("doc_id") % 3 > 0)),
    "tokencount": (tokencount, documents, lambda s, d: tokencount.count_tokens(d, BPE)),
    "quality": (quality, documents, lambda s, d: quality.judge(d)),
    "divergence": (divergence, documents, lambda s, d: divergence.audit(d)),
    "kmtree": (kmtree, vectors, lambda s, d: kmtree.search(d, F.expr("pmod(vec_id, 20) = 0"))),
    "whitening": (whitening, vectors, lambda s, d: whitening.whiten(d, components=3)),
} | {f"stage {name}": (corpus_pipeline, documents, lambda s, d, f=f: f(s, d, SF)) for name, f in STAGES.items() if name not in ("mixing", "packing")}  # whose operators are above


def names_inside(module):
    return sorted(set(re.findall(r"""["'](_?[a-z][a-z0-9_]*)["']""", inspect.getsource(module))))


@pytest.mark.parametrize("case", CASES)
def test_inner_names_as_extra_columns(spark, case):
    module, table, run = CASES[case]
    plain = table(spark).cache()
    extra = [n for n in names_inside(module) if n not in plain.columns]
    crowded = plain.select("*", *(F.lit(f"extra {n}").alias(n) for n in extra))
    want, got = run(spark, plain), run(spark, crowded)
    columns = [c for c in want.columns if not (c in extra and case.startswith("stage"))]
    assert set(columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    rounded = lambda df: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()), key=str)
    if case != "whitening":  # the signs of its components are free
        assert rounded(got) == rounded(want)
    else:
        assert got.count() == want.count() > 0
