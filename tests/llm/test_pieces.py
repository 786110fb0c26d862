import hashlib
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from siftpage.llm.pieces import UNKNOWN_PENALTY, decoder, digests, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = {LIB.id_to_piece(i).replace("▁", " "): (LIB.get_score(i), i) for i in range(259, LIB.get_piece_size())}
LONGEST, LOWEST = max(map(len, PIECES)), min(s for s, _ in PIECES.values())


def best_path(text):
    """Plain dynamic programme over the whole text: highest sum of scores, the longer last piece among equals."""
    t = " " + text.replace("▁", " ") if text else ""
    best = [(0.0, None)] + [None] * len(t)
    for to in range(1, len(t) + 1):
        for start in range(max(0, to - LONGEST), to):
            found = PIECES.get(t[start:to]) or ((LOWEST - UNKNOWN_PENALTY, None) if to - start == 1 else None)
            if found and (best[to] is None or best[start][0] + found[0] > best[to][0]):
                best[to] = (best[start][0] + found[0], (start, found[1]))
    ids, at = [], len(t)
    while at:
        start, i = best[at][1]
        ids = ([i] if i is not None else [LIB.piece_to_id(f"<0x{b:02X}>") for b in t[start:at].encode()]) + ids
        at = start
    return ids


def test_ids_are_the_best_path_and_decode(spark, make_docs, texts):
    odd = ["  two   spaces\t tab\n\nlines 中文 \U0001f600 end ", "a" * 700, "The quick brown foxes' 1234.5 running", "\n", " ", "ab▁déf", "x" * 50 + "Ж" * 50, "▁▁", "٣ ünï\x00code \U0010ffff"]
    rows = {i: t for i, t in texts[:-1]} | {90 + i: t for i, t in enumerate(odd)}
    docs = make_docs([*rows.items(), texts[-1]])
    for batch_chars in (20_000, 16_000_000):
        coded = encode(docs, PATH, batch_chars)
        got = [(r.doc_id, list(r.ids), r.text) for r in coded.withColumn("text", decoder(spark, PATH)("ids")).collect()]
        assert sorted(i for i, _, _ in got) == sorted([*rows, texts[-1][0]])
        for i, ids, text in got:
            assert ids == best_path(rows[i] or ""), i
            assert text == (rows[i] or "").replace("▁", " ")  # the mark is read as a space


def test_digests_are_of_ids_and_decoded_texts(make_docs, texts):
    rows = {i: (t or "") for i, t in texts[:-1] if i != 3}
    for r in digests(make_docs(list(rows.items())), PATH).collect():
        ids = best_path(rows[r.doc_id])
        assert (r.n_ids, r.ids_crc32, r.decoded_md5) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.md5(rows[r.doc_id].encode()).hexdigest())


def test_no_rows_and_null_ids(make_docs):
    assert encode(make_docs([]), PATH).count() == 0
    assert encode(make_docs([(1, None), (2, "")]), PATH).orderBy("doc_id").collect() == [(1, []), (2, [])]
    assert [r.doc_id for r in encode(make_docs([(None, "a b"), (1, "a b")]), PATH).orderBy("doc_id").collect()] == [None, 1]
