import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from siftpage.llm.common import slices
from siftpage.llm.huffman import LANE_IDS, Code, WordTokenizer, code_lengths, digests, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,bits", [(1, 4), (2, 4), (37, 8), (300, 9), (300, 18)])
def test_lengths_are_a_full_code_within_the_limit(n, bits):
    counts = np.random.default_rng(n).zipf(1.3, n).clip(1, 10**9)
    got = code_lengths(counts, bits)
    assert got.max() <= max(bits, 1) and (n == 1 or sum(2.0**-got) == 1)
    if bits == 18 and n > 1:  # unlimited Huffman costs the sum of all merges
        heap, cost = sorted(counts.tolist()), 0
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert (got * counts).sum() >= cost and (got.max() == bits or (got * counts).sum() == cost)


@pytest.mark.parametrize("n", [0, 1, LANE_IDS, LANE_IDS + 1, 5000])
def test_code_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.unique(rng.integers(0, 49408, 900))
    code = Code(ids, code_lengths(rng.zipf(1.2, len(ids)).clip(1, 10**8)))
    xs = rng.choice(ids, n)
    data, marks, bits = code.encode(xs)
    assert len(data) == (bits + 7) // 8 and (code.decode(data, marks, n) == xs).all()


ODD = ["Ünïcode, a.b c., 's it's x's\tq r\nÁ ét 1st", "ﬁ ŉ ǆ.", "a,,", ".", " , .", "İ. ΑΣ, Σ", "e\u0301, e\u0301.", "x.\n\ny,", ""]


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_slices_give_the_library_ids(texts, dtype):
    lib, own = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    every = [t or "" for _, t in texts] + ODD
    array = pa.array(["skip me"] + every).slice(1)
    for most in (1, 5000, 1 << 24):
        got = [b for at, n in slices(array, most) for b in own(array.slice(at, n), 2, dtype).to_pylist()]
        assert [np.frombuffer(b, dtype=dtype).tolist() for b in got] == [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in every]


def test_files_round_trip_in_order(make_docs, texts):
    lib, rows = Tokenizer.from_file(PATH), {i: t or "" for i, t in texts[:-1]}
    docs = make_docs(list(rows.items())).repartition(3)
    blocks, code = write_tokens(docs, PATH, 2)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in digests(read_tokens(blocks, code)).collect()}
    want, at = {}, 0
    for i in sorted(rows):
        ids = [*lib.encode(rows[i], add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_no_rows(make_docs):
    assert digests(read_tokens(*write_tokens(make_docs([]), PATH, 2))).count() == 0
