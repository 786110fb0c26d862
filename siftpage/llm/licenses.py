"""Licence scan: TF-IDF cosine of passages to templates, then the nearest ancestor directory's licence. DataFrame functions only."""

from __future__ import annotations

import re
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

COSINE = 0.55
FILE_SHARE = 0.5  # of a file's words in licence passages, from which it is a licence file by content

# Statements of public licences as files and headers have them, by SPDX name. Each sentence is a template.
STATEMENTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# A sentence runs on over single line ends; where it does, its lines are passages of their own too.
SENTENCE = r"\n[ \t]*\n\s*|(?<=[.!?:]) +|(?<=[.!?:])\n"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_ENDS), lambda w: w != "")


WORD_ENDS = r"[^\p{L}\p{N}]+"


def template_words() -> list[list[str]]:
    return [[w for w in re.split(r"[\W_]+", t.lower()) if w] for _, t in STATEMENTS]


def template_weights(idf: dict[str, float]) -> list[dict[str, float]]:
    """Of each template its words' shares of its length: tf * idf, of length 1."""
    out = []
    for words in template_words():
        own = {w: words.count(w) * idf[w] for w in words}
        length = sqrt(sum(x * x for x in own.values()))
        out.append({w: x / length for w, x in own.items()})
    return out


def prefixes(weights: list[dict[str, float]], cosine: float) -> set[str]:
    """Words of which a passage must hold one to reach the cosine to any template: a template's heaviest, until the rest hold
    less than the cosine's square of its squared length, as the cosine is at most the length of what is shared."""
    out: set[str] = set()
    for own in weights:
        rest = 1.0
        for w, x in sorted(own.items(), key=lambda e: (-e[1], e[0])):
            if rest < cosine * cosine - 1e-9:
                break
            out.add(w)
            rest -= x * x
    return out


def scan(files: DataFrame, cosine: float = COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """files (id, path, body) -> one row per file: id, path, license, origin (header, file, inherited), score, directory.

    Passages are the sentences of the whole text, and the lines of those that run over several. Weights are tf * idf; idf
    counts all files for the templates' words, and any other word weighs as one that no file has. Only texts with a word of
    prefixes() are cut into passages, and only passages with one whose share of weight in the templates' words could reach
    the cosine go on to the sparse join, so none is lost before it. A passage is a statement if its best cosine to a
    template is `cosine` or more (ties: the name that sorts first). A file's own statement with the highest cosine is its
    licence. A file is a licence file if named LICENSE, LICENCE, COPYING or NOTICE or if statements hold `file_share` of
    its words; its licence covers its directory. Files without a statement inherit from the nearest directory above that
    is covered. Null or empty text and null paths have no statement; an empty path is the root. Rows of one id are one file,
    the one of the smallest path and, of these, of the text with the smallest hash; empty tables give empty results.
    """
    spark = files.sparkSession
    base = files.select("id", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("body", F.lit("")).alias("body"))
    many = base.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", F.xxhash64("body").alias("h"))).alias("first")).where("n > 1").select("id", "first")
    many = written(many, "license-repeats")
    if not many.isEmpty():  # ids are as a rule unique; where they are not, one row of each stays
        again = base.join(many, "id").where((F.col("path") == F.col("first.path")) & (F.xxhash64("body") == F.col("first.h"))).groupBy("id").agg(F.min("path").alias("path"), F.min("body").alias("body"))
        base = base.join(many.select("id"), "id", "left_anti").union(again)
    vocabulary = sorted({w for words in template_words() for w in words})
    texts = base.select("id", "body", F.split(F.lower("body"), WORD_ENDS).alias("every"))
    counted = texts.select(F.explode(F.array_append(F.array_intersect("every", F.lit(vocabulary)), F.lit(""))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = {r["term"]: r["df"] for r in counted.collect()}  # a row for each word of the templates
    n = df.pop("", 0)
    weight_of = {w: smooth_idf(n, df.get(w, 0)) for w in vocabulary}
    unseen = smooth_idf(n, 0)
    shares = template_weights(weight_of)
    heads = F.lit(sorted(prefixes(shares, cosine)))
    idf = spark.createDataFrame(list(weight_of.items()), "term string, idf double")
    weights = spark.createDataFrame([(i, STATEMENTS[i][0], w, x) for i, own in enumerate(shares) for w, x in own.items()], "form int, license string, term string, w double")
    # of the squared length of a passage its templates' words must hold the square of the cosine
    square = F.create_map(*(F.lit(x) for w in vocabulary for x in (w, weight_of[w] ** 2)))

    def judged(own: Column) -> Column:
        """The words, and whether they may be a statement; bound once for each passage."""
        weight = F.aggregate(F.array_intersect(own, F.lit(vocabulary)), F.lit(0.0), lambda s, w: s + square[w] * F.pow(F.size(F.filter(own, lambda x: x == w)), F.lit(2)))
        other = F.size(F.array_except(own, F.lit(vocabulary)))
        return F.struct(own.alias("words"), ((F.size(own) > 0) & (weight * (1 - cosine**2) + 1e-9 >= other * (unseen * cosine) ** 2)).alias("may"))

    runs = lambda s: F.when(F.contains(s, F.lit("\n")), F.concat(F.array(s), F.split(s, "\n"))).otherwise(F.array(s))
    near = texts.where(F.arrays_overlap("every", heads)).select("id", F.posexplode(F.flatten(F.transform(F.split("body", SENTENCE), runs))).alias("at", "passage"))
    near = near.where(F.arrays_overlap(F.split(F.lower("passage"), WORD_ENDS), heads))
    words = near.select("id", "at", F.get(F.transform(F.array(_words(F.col("passage"))), judged), F.lit(0)).alias("j")).where("j.may").select("id", "at", "j.words")
    near = words.select("id", "at", F.size("words").alias("n_words"), F.explode("words").alias("term"))
    tf = near.groupBy("id", "at", "n_words", "term").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(idf), "term", "left").withColumn("p", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    tf = written(tf.select("id", "at", "n_words", "term", "p"), "license-terms")
    length = tf.groupBy("id", "at").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
    dots = tf.join(F.broadcast(weights), "term").groupBy("id", "at", "n_words", "form", "license").agg(F.sum(F.col("p") * F.col("w")).alias("dot"))
    scored = dots.join(length, ["id", "at"]).select("id", "at", "n_words", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= cosine)
    statements = scored.groupBy("id", "at", "n_words").agg(F.min(F.struct(-F.col("score"), F.col("license"))).alias("b"))
    own = statements.groupBy("id").agg(F.min("b").alias("b"), F.sum("n_words").alias("words")).select("id", F.col("b.license").alias("own"), (-F.col("b.col1")).alias("score"), "words")
    own = written(own, "license-own")
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"(?i)^(licen[cs]e|copying|notice)")
    stated = base.join(own, "id").select("id", "own", "score", directory.alias("directory"), (named | (F.col("words") >= file_share * F.size(_words(F.col("body"))))).alias("is_file"))
    stated = written(stated, "license-stated")
    covers = stated.where("is_file").groupBy("directory").agg(F.min(F.struct(-F.col("score"), F.col("own"))).alias("b")).select(F.col("directory").alias("up"), F.col("b.own").alias("inherited"))
    dirs = base.select(directory.alias("directory")).distinct()
    parts = F.split("directory", "/")
    above = dirs.select("directory", F.explode(F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), F.array(F.lit("")))).alias("up"))
    nearest = above.join(covers, "up").groupBy("directory").agg(F.max_by("inherited", F.length("up")).alias("inherited"), F.max(F.length("up")).alias("n")).select("directory", "inherited", F.expr("left(directory, n)").alias("from"))
    rows = base.select("id", "path", directory.alias("directory")).join(stated.select("id", "own", "score", "is_file"), "id", "left").join(nearest, "directory", "left")
    origin = F.when(F.col("own").isNull(), F.when(F.col("inherited").isNotNull(), "inherited")).otherwise(F.when(F.col("is_file"), "file").otherwise("header"))
    return rows.select("id", "path", F.coalesce("own", "inherited").alias("license"), origin.alias("origin"), "score", F.when(F.col("own").isNull(), F.col("from")).alias("directory"))


def smooth_idf(n: int, df: int) -> float:
    """Smoothed inverse document frequency."""
    return log((1 + n) / (1 + df)) + 1


def scan_documents(docs: DataFrame) -> DataFrame:
    """Documents as files at source/lang/doc_id. Rows without a doc_id are left out."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    files = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), path.alias("path"), F.col("text").alias("body"))
    return scan(files).withColumnRenamed("id", "doc_id")
