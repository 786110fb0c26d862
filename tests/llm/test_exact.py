import hashlib

from siftpage.llm.exact import drop_exact, exact_groups


def test_groups_match_brute_force(make_docs, texts):
    ids: dict = {}
    for i, t in texts:
        ids.setdefault(t or "", []).append(i)
    for keep, pick in (("min", min), ("max", max)):
        got = sorted(map(tuple, exact_groups(make_docs(texts), keep).collect()))
        want = sorted((i, pick(ids[t or ""]), len(ids[t or ""]), i == pick(ids[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
        assert got == want


def test_null_ids_and_empty_table(make_docs):
    got = {tuple(r) for r in exact_groups(make_docs([(None, "a"), (3, "a"), (None, "b")])).select("doc_id", "keep_id", "group_size", "kept").collect()}
    assert got == {(None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)}
    assert exact_groups(make_docs([])).count() == 0


def test_drop_keeps_columns(make_docs):
    docs = make_docs([(1, "a"), (2, "a"), (3, None), (4, "")])
    out = drop_exact(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
