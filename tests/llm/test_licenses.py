"""Own statements, licence files and inheritance on a small tree."""

from siftpage.llm import licenses


def test_tree(spark):
    prose = "The river runs past the mill. Nobody lives there now. " * 20
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (2, "a/b/x.txt", prose),
        (3, "a/b/y.txt", prose + "\nReleased under the MIT License.\n" + prose),
        (4, "c/z.txt", prose),
        (5, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (6, "a/b/c/w.txt", None),
        (7, None, ""),
        (8, "a/v.txt", "A driver needs a licence to drive a car on the road."),
    ]
    files = spark.createDataFrame([(*r, "x") for r in rows + [rows[1]]], "id long, path string, body string, term string")
    got = {r["id"]: (r["license"], r["origin"], r["directory"]) for r in licenses.scan(files).collect()}
    assert got == {
        1: ("Apache-2.0", "file", None),
        2: ("GPL", "inherited", "a/b"),
        3: ("MIT", "header", None),
        4: (None, None, None),
        5: ("GPL", "file", None),
        6: ("GPL", "inherited", "a/b"),
        7: (None, None, None),
        8: ("Apache-2.0", "inherited", "a"),
    }


def brute_force(rows):
    """Best cosine of any passage of each file, by plain dictionaries."""
    import math
    import re

    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    split = lambda t: [p for s in re.split(licenses.SENTENCE, t) for p in ([s, *s.split("\n")] if "\n" in s else [s])]
    passages = [(i, words(p)) for i, t in rows for p in split(t)]
    vocabulary = {w for _, t in licenses.STATEMENTS for w in words(t)}
    n = len(rows)
    df = {w: sum(w in words(t) for _, t in rows) for w in vocabulary}
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 1
    vector = lambda ws: {w: ws.count(w) * idf(w) for w in ws}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1.0
    forms = [(name, vector(words(t))) for name, t in licenses.STATEMENTS]
    best = {}
    for i, p in passages:
        v = vector(p)
        for name, f in forms:
            c = round(sum(x * f.get(w, 0) for w, x in v.items()) / norm(v) / norm(f), 9)
            if c >= licenses.COSINE:
                best[i] = min(best.get(i, (0, "")), (-c, name))
    return {i: (name, -c) for i, (c, name) in best.items()}


REAL = [
    ("MIT", 'Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n'),
    ("GPL", "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.\n"),
    ("Apache-2.0", '   Licensed under the Apache License, Version 2.0 (the "License");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at\n'),
    ("MIT", "// SPDX-License-Identifier: MIT\nint main() { return 0; }"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"),
    ("CC-BY-SA-4.0", "The text is available under the Creative Commons Attribution-ShareAlike 4.0 License"),
]


def test_real_statements_and_cosines_match_brute_force(spark):
    prose = ["The river runs past the mill and the law of the land.", "You may use this path at any time.", "She has the right to copy the text in any form, he said."]
    rows = [(i, t) for i, (_, t) in enumerate(REAL)] + [(100 + i, " ".join(prose[k % 3] for k in range(i, i + 9)) + f" Number {i}.") for i in range(40)]
    files = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in rows], "id long, path string, body string")
    got = {r["id"]: (r["license"], r["score"]) for r in licenses.scan(files).collect() if r["license"]}
    want = brute_force(rows)
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()} == {i: n for i, (n, _) in enumerate(REAL)}
    assert all(abs(got[i][1] - s) < 1e-6 for i, (_, s) in want.items())


def test_rows_of_one_id_are_one_file(spark):
    """Run on both orders: text and directory come from one row, that of the smallest path."""
    rows = [(1, "b/y.txt", "Released under the MIT License."), (1, "a/x.txt", "plain text"), (2, "a/z.txt", "other"), (3, "b/w.txt", "other"), (4, "z/c", "Licensed under CC BY 4.0."), (4, "z/c", "Licensed under CC BY 4.0.")]
    for order in (rows, rows[::-1]):
        got = {r["id"]: (r["path"], r["license"]) for r in licenses.scan(spark.createDataFrame(order, "id long, path string, body string").coalesce(1)).collect()}
        assert got == {1: ("a/x.txt", None), 2: ("a/z.txt", None), 3: ("b/w.txt", None), 4: ("z/c", "CC-BY-4.0")}


def test_prefixes_lose_no_passage():
    """Whatever part of a template's words a passage holds, without a word of prefixes() it stays under the cosine."""
    import random

    rng = random.Random(8)
    idf = {w: 1 + rng.random() * 9 for words in licenses.template_words() for w in words}
    weights = licenses.template_weights(idf)
    heads = licenses.prefixes(weights, 0.55)
    assert heads < set(idf)
    for own in weights:
        assert sum(x * x for w, x in own.items() if w not in heads) < 0.55**2


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "id long, path string, body string")).count() == 0
