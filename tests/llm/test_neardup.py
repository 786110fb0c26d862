import random

import pytest

from siftpage.llm import neardup


def brute_force(rows, words=5, similarity=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {" ".join(w)} if 0 < len(w) < words else {" ".join(w[j : j + words]) for j in range(len(w) - words + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids[: ids.index(i)]:
            both = len(sets[i] & sets[j])
            alike = both / (len(sets[i]) + len(sets[j]) - both) if sets[i] or sets[j] else 1.0
            if alike >= similarity and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    size = {i: sum(find(j) == find(i) for j in ids) for i in ids}
    return {i: find(i) for i in ids if size[i] > 1}


@pytest.mark.parametrize("block", [512, 16])
def test_group_from_an_absent_base_is_as_brute_force(make_docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(300)]
    edit = lambda share: " ".join(rng.choice(vocab) if rng.random() < share else w for w in base)
    rows = [(i, edit(0.017)) for i in range(150)] + [(200 + i, " ".join(rng.choice(vocab) for _ in range(60))) for i in range(20)]
    rows += [(300, rows[3][1].upper()), (301, rows[160][1]), (302, None), (303, " "), (304, "two words"), (305, "Two  words")]
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(make_docs(rows)).collect()}
    want = brute_force(rows)
    assert got == want and 40 < sum(1 for g in want.values() if g == want[300])


def test_repeated_rows_and_empty_table(make_docs):
    docs = make_docs([(1, "a b c d e f"), (1, "other words are in this row"), (2, "a b c d e f g h i j k l"), (None, "a b c d e f")])
    assert neardup.near_duplicates(docs).count() == 0 and neardup.near_duplicates(make_docs([])).count() == 0
    assert neardup.drop_near(docs).columns == docs.columns and neardup.drop_near(docs).count() == 4
