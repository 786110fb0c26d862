import random
import re
from itertools import permutations

import pytest

from siftpage.llm import audit
from siftpage.llm.audit import interactions, later_copies, measures, refined

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    """rows: (doc_id, text, part)."""
    body = [(i, t or "", p or "") for i, t, p in rows]
    fails = []
    for i, t, p in body:
        w = WORD.findall(t)
        copy = i is not None and any(j is not None and j < i and u == t for j, u, _ in body)
        fails.append((p, {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": copy}, labels.get(i, (0, 0))))
    out = []
    for part in {p for p, _, _ in fails}:
        own = [(f, lab) for p, f, lab in fails if p == part]
        rows_ = []
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [(f, lab) for f, lab in left if f[x]]
                left = [(f, lab) for f, lab in left if not f[x]]
                unique = sum(f[x] and sum(f.values()) == 1 for f, _ in own)
                rows_.append([part, "".join(order), k + 1, len(left), len(gone), sum(f[x] for f, _ in own) - len(gone), unique, sum(q == 1 for _, (q, _) in gone), sum(t == 1 for _, (_, t) in gone)])
        for r in rows_:
            letter = r[1][r[2] - 1]
            out.append((*r, sum(s[4] for s in rows_ if s[1][s[2] - 1] == letter)))
    return sorted(out)


@pytest.fixture
def corpus(texts):
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(3000))
    rows = [(i, t, "en" if (i or 0) % 3 else None) for i, t in texts]
    rows += [(200 + k, long, "de") for k in range(5)] + [(210, long[:-1] + "!", "de"), (211, "X" + long[1:], "en")]  # of one length
    rows += [(220, "Ä" * 40, "en"), (221, "Ä" * 40, "fr"), (222, "AB" * 40, ""), (None, long, "de"), (None, None, None), (200, long, "de"), (200, "another text", "de"), (223, "# a", "en")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, p, 7, "x") for i, t, p in rows], "doc_id long, text string, lang string, n long, same string")


def test_audit_matches_brute_force(spark, corpus):
    labels = {200: (1, 0), 204: (1, 1), 3: (0, 1), 10: (1, 0), 221: (0, 1)}
    table = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()] + [(3, None, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, interactions(frame(spark, corpus), table).collect()))
    assert got == brute(corpus, labels) and len(got) == 600 * len({p or "" for _, _, p in corpus})
    empty = interactions(frame(spark, []), table)
    assert empty.count() == 0 and empty.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_texts_are_compared_when_hashes_are_not_enough(spark, monkeypatch):
    """With one hash for all blocks only the whole texts tell copies apart."""
    rows = [(1, "aaaa bbbb", "en"), (2, "cccc dddd", "en"), (3, "aaaa bbbb", "en"), (4, "cccc dddd", "en"), (5, "eeee ffff", "en"), (6, "short", "en")]
    docs = frame(spark, rows)
    from pyspark.sql import functions as F

    alike = measures(docs).withColumn("blocks", F.array(F.lit(0).cast("long")))
    found = refined(alike.select("doc_id", "same", "chars", "blocks"))
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.doc_id for r in later_copies(docs, found).collect()) == [3, 4]


def test_refinement_drops_what_is_alone(spark):
    a, b = "p" * 1024 + "q" * 5000, "p" * 1024 + "r" * 5000
    docs = frame(spark, [(1, a, "en"), (2, b, "en"), (3, b, "en"), (4, "z" * 6024, "en"), (5, "", "en"), (6, None, "en")])
    found = refined(measures(docs).select("doc_id", "same", "chars", "blocks"))
    assert sorted(r.doc_id for r in found.collect()) == [2, 3, 5, 6]
    assert audit.block_hashes(b"") == [] and len(audit.block_hashes(b"x" * 6024)) == 3
