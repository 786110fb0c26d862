from collections import Counter

import xxhash
from pyspark.sql import functions as F

from siftpage.llm.chunks import LEAST, MIN_WORDS, cut_points, drop_repeats, gear_table, repeated_spans


def parts(text):
    data = (text or "").encode()
    ends = cut_points(data, gear_table())
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def test_chunks_rebuild_the_text_and_resist_an_insertion(texts):
    for _, t in texts:
        got = parts(t)
        assert b"".join(got) == (t or "").encode() and all(p.decode() for p in got) and all(len(p) >= LEAST for p in got[:-1])
    long = texts[3][1]
    a, b = Counter(parts(long)), Counter(parts("new words " + long[:5000] + " é " + long[5000:]))
    assert sum((a - b).values()) <= 8


def test_spans_match_brute_force(make_docs, texts):
    rows = {i: t for i, t in texts[:-1]}
    first, seen = {}, Counter()
    for i in sorted(rows):
        for p in parts(rows[i]):
            first.setdefault(p, i)
            seen[p] += 1
    got = {r.doc_id: r for r in repeated_spans(make_docs(list(rows.items()))).collect()}
    assert set(got) == set(rows)
    for i, t in rows.items():
        ps, run, words = parts(t), 0, 0
        for p in [*ps, None]:
            if p is not None and seen[p] > 1:
                run += len(p.split())
            else:
                words, run = words + (run if run >= MIN_WORDS else 0), 0
        assert got[i].repeated_words == words and got[i].n_chunks == len(ps)
        for s in got[i].spans:
            assert (t or "").encode()[s.start : s.end] and all(k <= i for k in got[i].keepers)
    assert got[60].removed_bytes == 0 and got[60].repeated_words > 30 and got[61].removed_bytes > 100 and got[61].keepers == [60]
    assert got[51].removed_bytes > 0 and got[20].removed_bytes == 0
    assert xxhash.xxh3_128_digest(b"") and repeated_spans(make_docs([])).count() == 0


def test_rows_of_one_id_are_texts_of_their_own(make_docs, texts):
    long, passage = texts[3][1][:1500], dict(texts[:-1])[62]
    docs = make_docs([(1, passage), (1, "other words " + passage + " and an end"), (1, passage), (2, long), (2, long), (None, passage)])
    got = sorted((r.doc_id, r.removed_bytes > 100, r.keepers) for r in repeated_spans(docs).collect() if r.doc_id == 1)
    assert [k for *_, k in got].count([]) == 1 and sum(cut for _, cut, _ in got) == 2
    out = drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == 6 and [r.text for r in out.where("doc_id = 2").collect()] == [long, long]


def test_drop_cuts_later_copies(make_docs, texts):
    docs = make_docs(texts).withColumns({c: F.lit(7) for c in ("_id", "__same", "_spans", "digests", "rid")})
    got, passage = {r.doc_id: r.text for r in drop_repeats(docs).where("doc_id <> 21").collect()}, texts[52][1]
    assert drop_repeats(docs).columns == docs.columns
    assert got[60] == dict(texts)[60] and len(got[61]) < len(dict(texts)[61]) - 100 and len(got[62]) < len(passage)
    assert got[0] is None and got[1] == ""
