"""Whole jobs: full licence texts, hosts of junk, hot copies among the labelled rows."""

import os
import textwrap

import pytest
from pyspark.sql import functions as F

from waymark.llm import langid, licenses, quality

MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
]
APACHE = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "    http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
]
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE.",
]


@pytest.mark.parametrize("width", [40, 72, 100_000])
def test_wrapped_licences(spark, width):
    wrap = lambda parts, gap="\n\n", mark="": gap.join("\n".join(mark + s for s in textwrap.wrap(p, width, break_long_words=False)) for p in parts)
    texts = [wrap(MIT), wrap(GPL), wrap(APACHE), wrap(BSD), wrap(BSD[:3] + BSD[4:]), wrap(GPL).replace("\n", "\r\n"), wrap(MIT, "\n *\n", " * "), wrap(APACHE[2:]), "This is not " + wrap(MIT)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["licenses"] for i in range(9)] == ["MIT", "GPL-3.0", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0", "MIT", "", ""]
    assert [got[i]["sentence_ids"] for i in (0, 2, 3, 7)] == ["mit-grant mit-notice as-is", "apache-name apache-use apache-copy apache-basis", "bsd-redistribution bsd-endorse as-is", "apache-basis"]


COMMON = "/usr/share/common-licenses"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence files here")
def test_whole_licence_files(spark):
    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(k, open(f"{COMMON}/{k}", encoding="utf-8").read()) for k in want if os.path.exists(f"{COMMON}/{k}")]
    rows += [("isc", "Copyright (c) A B\n\n" + ISC), ("affero", GPL[0].replace("GNU General", "GNU Affero General") + "\n\n" + GPL[1].replace("GNU General", "GNU Affero General"))]
    want |= {"isc": "ISC", "affero": "AGPL-3.0"}
    got = {r["doc_id"]: r["licenses"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(want[k] in got[k] for k in got), got
    assert got["isc"] == ["ISC"] and got["affero"] == ["AGPL-3.0"] and "GPL-2.0" not in got.get("GPL-3", [])


def test_a_sentence_table_of_any_size(spark):
    table = spark.createDataFrame([("b", "hello there"), ("a", "hello there"), ("c", "good bye"), (None, "x"), ("d", None)], "id string, sentence string")
    docs = spark.createDataFrame([(1, "Hello, there! Good\nbye. Hello there."), (2, None), (3, "")] + [(4, "")] * 50, "doc_id long, text string")
    for limit in (10, 0):
        got = sorted((r["doc_id"], r["n_sentences"], r["sentence_ids"], r["licenses"]) for r in licenses.scan(docs, table, [("L", ["a", "c"]), ("M", ["c", "c"])], broadcast_sentences=limit).collect())
        assert got == [(1, 4, "a c a", "L"), (2, 0, "", ""), (3, 0, "", "")] + [(4, 0, "", "")] * 50


@pytest.mark.parametrize("seed", [2, 3, 6, 7])
def test_few_words_make_no_singular_model(seed):
    import pyarrow as pa

    for texts in ([("uno", "es"), ("one", "en")], [("uno", "es"), ("one", "en"), ("ein", "de")], [("uno", "es")]):
        labels, scores = langid.predict(pa.array(["uno one", "zzz", ""], pa.large_string()), langid.fit(texts, bits=10, seed=seed))
        assert labels[2] == "und" and all(0 <= v <= 1 for v in scores) and set(labels[:2]) <= {y for _, y in texts}


def test_hosts_of_junk_are_rejected_by_every_rule(spark):
    text = lambda i: "\n".join(" ".join(f"word{i}x{10 * j + k}" for k in range(8)) for j in range(6))
    symbols = lambda i: "#### $$$$ %%%% " * 2 + " ".join(f"word{i}x{k} ####" for k in range(20))
    repeated = lambda i: "\nclick here\n".join(f"word{i}x{k} other{i}x{k} more{i}x{k}" for k in range(12))
    letters = lambda i: " ".join(chr(97 + (i * 7 + k * k * 5 + k // 9) % 26) for k in range(60))
    junk = {"symbols": symbols, "lines": repeated, "letters": letters, "third": lambda i: symbols(i) if i % 5 < 2 else text(i)}
    rows = [(f"{h}{i}", (junk[h[:-1]] if h[:-1] in junk else text)(i), h) for h in [*(f"{j}0" for j in junk), *(f"clean{k}" for k in range(12))] for i in range(100)]
    rows += [(f"few{i}", symbols(i) if i < 10 else text(i), "few0") for i in range(100)]
    for limit in (10_000, 0):
        got = quality.judge(spark.createDataFrame(rows, "doc_id string, text string, source string"), small_hosts=limit)
        assert "_n_lines" not in got.columns
        by = {r["source"]: (r["k"], r["n"], r["b"]) for r in got.groupBy("source").agg(F.sum(F.col("kept").cast("int")).alias("k"), F.sum(F.col("base_failed").cast("int")).alias("b"), F.count("*").alias("n")).collect()}
        assert all(by[f"{j}0"][0] == 0 for j in junk), by
        assert all(by[f"{j}0"][2] == 0 for j in ("symbols", "lines", "third"))  # the base rule finds nothing there
        assert all(k == n for h, (k, n, _) in by.items() if h == "few0" or h.startswith("clean")), by


def test_hot_copies_leave_the_language_sample_whole(spark):
    """Thousands of copies with the smallest hash, of which there are more than the bound; every label has its share."""
    words = {"aa": "dar mas pola kint", "bb": "zhu wen xing yol", "cc": "ulk borra etten spiv"}
    say = lambda y, i: " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for w in words[y].split()) + " " + words[y]
    texts = spark.createDataFrame([(say(y, i), y) for y in words for i in range(60)], "text string, lang string")
    first = texts.orderBy(F.xxhash64("text")).first()
    hot = spark.range(3000).select(F.lit(first["text"]).alias("text"), F.lit(first["lang"]).alias("lang"))
    crf = langid.train(texts.unionByName(hot), max_rows=90)
    assert sorted(crf.labels) == sorted(words)
    got = langid.identify(texts, crf).where("lang_pred = lang").count()
    assert got == 180
    plain = langid.train(texts, max_rows=90)
    assert (plain.weights == crf.weights).all() and (plain.trans == crf.trans).all()


def test_language_quotas():
    assert langid.quotas({"a": 5, "b": 1000, "c": 1000}, 205) == {"a": (5, 5), "b": (100, 1000), "c": (100, 1000)}
    assert langid.quotas({}, 10) == {} and sum(k for k, _ in langid.quotas({str(i): 9 for i in range(20)}, 10).values()) == 20
