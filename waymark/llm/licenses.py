"""License scans by sentence rules: known licence sentences become identifiers, whose sequences match ordered licence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of well-known licences and notices, as they read after normalisation.
SENTENCES = [
    ("mit-name", "released under the mit license"),
    ("mit-name", "licensed under the mit license"),
    ("mit-name", "this project is licensed under the mit license"),
    ("mit-title", "the mit license"),
    ("mit-title", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied"),
    ("apache-name", "licensed under the apache license version 2 0"),
    ("apache-name", "licensed under the apache license version 2 0 the license"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl3-name", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-name", "licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc-4-name", "licensed under cc by nc 4 0"),
    ("cc-by-4-name", "licensed under cc by 4 0"),
    ("cc-by-sa-4-name", "licensed under cc by sa 4 0"),
    ("cc0-name", "licensed under cc0 1 0"),
    ("rights", "all rights reserved"),
]
#: The same as the licences' own texts have them, to the full stop; found over wrapped lines, which the query's SQL doesn't join.
WHOLE = [
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("as-is", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("apache-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("agpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl21-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl3-text", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl3-patents", "the gnu general public license does not permit incorporating your program into proprietary programs"),
    ("agpl3-text", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gpl2-text", "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"),
    ("lgpl3-text", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    ("lgpl21-text", "this is the first released version of the lesser gpl"),
    ("mpl2-form", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("cc0-text", "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s each and all an owner of an original work of authorship and or a database each a work"),
    ("cc-by-4-name", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4-name", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4-name", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
]
#: Licence, and the identifiers that stand for it in this order (others of the known may not come between).
RULES = [
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("Apache-2.0", ["apache-name"]),
    ("Apache-2.0", ["apache-use", "apache-copy"]),
    ("Apache-2.0", ["apache-use", "apache-copy", "apache-basis"]),
    ("GPL-3.0", ["gpl3-name"]),
    ("GPL-3.0", ["gpl-free", "gpl-hope"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "as-is"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-name"]),
    ("CC-BY-4.0", ["cc-by-4-name"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-name"]),
    ("CC0-1.0", ["cc0-name"]),
    ("proprietary", ["rights"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("GPL-2.0", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0", ["gpl2-text"]),
    ("GPL-3.0", ["gpl3-text"]),
    ("AGPL-3.0", ["agpl3-free", "gpl-hope"]),
    ("AGPL-3.0", ["agpl3-text"]),
    ("LGPL-2.1", ["lgpl21-free"]),
    ("LGPL-2.1", ["lgpl21-text"]),
    ("LGPL-3.0", ["lgpl3-free"]),
    ("LGPL-3.0", ["lgpl3-text"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("CC0-1.0", ["cc0-text"]),
]


def sentences(text: Column) -> Column:
    """Lines, cut after `.`, `!`, `?`, `;` or `:` before a blank; what has no letter or digit is left out."""
    lines = F.split(F.regexp_replace(text, r"([.!?;:])[ \t]+", "$1\n"), r"[\n\r]")
    return F.filter(lines, lambda s: s.rlike("[A-Za-z0-9]"))


def candidates(text: Column) -> Column:
    """Arrays, one for each sentence that may run over lines (up to `.`, `!` or `?` before a blank, or a line without letters and
    digits), of (level, clause, line, raw): the sentence (0), and where it has several its clauses up to `;` or `:` (1) and their lines (2).
    """
    whole = F.split(F.regexp_replace(text, "\r\n?", "\n"), r"(?<=[.!?])[ \t\n]+|\n[^A-Za-z0-9]*\n")
    one = lambda level, c, q, s: F.struct(F.lit(level).alias("level"), c.alias("clause"), q.alias("line"), s.alias("raw"))

    def parts(s: Column) -> Column:
        clauses, zero = F.split(s, r"(?<=[;:])[ \t\n]+"), F.lit(0)
        lines = F.flatten(F.transform(clauses, lambda c, i: F.transform(F.split(c, "\n"), lambda q, j: one(2, i, j, q))))
        first = F.array(one(0, zero, zero, s))
        return F.when(s.rlike("\n|[;:][ \t]"), F.concat(first, F.transform(clauses, lambda c, i: one(1, i, zero, c)), lines)).otherwise(first)

    return F.transform(F.filter(whole, lambda s: s.rlike("[A-Za-z0-9]")), parts)


def normalised(sentence: Column) -> Column:
    """A-Z lower-cased, everything but a-z and 0-9 to single spaces, none at the ends."""
    low = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def rule_hits(ids: str, rules: list[tuple[str, list[str]]]) -> Column:
    """The distinct sorted licences of which a rule's identifiers follow each other in `ids` (` id id ... `)."""
    hits = [F.when(F.instr(F.col(ids), f" {' '.join(seq)} ") > 0, F.lit(name)) for name, seq in rules]
    return F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))


#: Sentences that stand for a document itself, so that one without a known sentence is in the result too.
_MARKS = 512


def scan(docs: DataFrame, sentence_table: DataFrame | None = None, rules: list[tuple[str, list[str]]] | None = None, doc_id: str = "doc_id", text: str = "text", broadcast_sentences: int = 200_000) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, n_licenses for each row of docs.

    sentence_table: id, sentence (normalised); by default SENTENCES and WHOLE; of a sentence under two identifiers the smaller
    counts. A sentence is known as a whole, over its lines, or else by its clauses, or else by its single lines (n_sentences counts
    these). One pass: all sentences are exploded, normalised and looked up where they are (the table is broadcast only after
    counting it, else joined by shuffle); only what is known, and one mark a row, is shuffled, by a number of the row, so that
    copies and empty texts are spread. licenses is joined by commas and empty where no rule matches. Null or empty texts have no
    sentences; a text of any length is scanned whole; rows that repeat a text get equal results; an empty table gives no rows;
    columns other than the two named are ignored, so their names may clash. Built-in functions only.
    """
    spark = docs.sparkSession
    known = sentence_table if sentence_table is not None else spark.createDataFrame(SENTENCES + WHOLE, "id string, sentence string")
    known = known.where("sentence IS NOT NULL AND id IS NOT NULL").groupBy("sentence").agg(F.min("id").alias("id"))
    small = known.count() <= broadcast_sentences
    known = known.unionByName(spark.range(_MARKS).select(F.concat(F.lit("#"), "id").alias("sentence"), F.lit("").alias("id")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.size(sentences(F.col(text))), F.lit(0)).cast("long").alias("n"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("row"))
    mark = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).alias("clause"), F.lit(0).alias("line"), F.concat(F.lit("#"), F.pmod(F.xxhash64("row"), F.lit(_MARKS))).alias("raw")))
    parts = F.concat(F.array(mark), F.coalesce(candidates(F.col("t")), F.array().cast("array<array<struct<level: int, clause: int, line: int, raw: string>>>")))
    each = rows.select("row", "doc_id", "n", F.posexplode(parts).alias("at", "parts")).select("row", "doc_id", "n", "at", F.inline("parts"))
    each = each.withColumn("sentence", F.when(F.col("level") < 0, F.col("raw")).otherwise(normalised(F.col("raw")))).drop("raw")
    found = each.join(F.broadcast(known) if small else known, "sentence").drop("sentence")
    # Within a sentence: the whole, else of each clause the clause itself or its lines.
    heard = found.groupBy("row", "doc_id", "n", "at").agg(F.min("level").alias("least"), F.collect_list(F.struct("clause", "level", "line", "id")).alias("hits"))
    heard = heard.withColumn("own", F.expr("filter(hits, h -> h.level = 1).clause"))
    heard = heard.select("row", "doc_id", "n", F.explode(F.expr("filter(hits, h -> h.level <= 0 OR least > 0 AND (h.level = 1 OR NOT array_contains(own, h.clause)))")).alias("h"), "at")
    out = heard.groupBy("row", "doc_id", "n").agg(F.array_sort(F.collect_list(F.when(F.col("h.id") != "", F.struct("at", F.col("h.clause").alias("c"), F.col("h.line").alias("q"), F.col("h.id").alias("id"))))).alias("hits"))
    out = out.withColumn("ids", F.concat(F.lit(" "), F.array_join(F.col("hits.id"), " "), F.lit(" "))).withColumn("licenses", rule_hits("ids", rules or RULES))
    return out.select("doc_id", F.col("n").alias("n_sentences"), F.trim("ids").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.size("licenses").cast("long").alias("n_licenses"))
