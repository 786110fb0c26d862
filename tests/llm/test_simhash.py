import random

import pytest
import xxhash
from pyspark.sql import functions as F

from siftpage.llm.components import components
from siftpage.llm.simhash import links, near_groups


def brute_fp(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_groups_match_brute_force(make_docs, texts):
    rows = [(i, t) for i, t in texts if i != 3]
    fps = {i: brute_fp(t, 3) for i, t in rows}
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_groups(make_docs(rows)).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    assert near_groups(make_docs([])).count() == 0


@pytest.mark.parametrize("bits,blocks", [(2, 8), (1, 4)])
def test_links_lose_no_pair(spark, bits, blocks):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps |= {x} | {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.3) << rng.randrange(64) for _ in range(6)} | {x ^ (1 << rng.randrange(64)) for _ in range(3)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    got = {(r.a, r.b) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits, blocks).collect()}
    assert got == want and len(want) > 100


def test_no_table_is_broadcast(spark, make_docs, texts):
    """Small files can hold many rows, and an explode makes more of them: any broadcast fails here."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        assert near_groups(make_docs(texts)).count() == len(texts)
        fps = spark.range(2000).select(F.col("id").alias("fp"))
        assert components(links(fps)).agg(F.max("label"), F.count("id")).first() == (0, 2000)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, j) for j in range(8, 30)] + [(None, 3), (4, 4)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {j: 7 for j in range(7, 30)}
