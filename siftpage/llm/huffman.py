"""Token ids as length-limited canonical Huffman codes in independent blocks."""

from __future__ import annotations

from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, id_and_text, slices, written

MAX_BITS = 18  # longest code; raised where a vocabulary has more ids than that many bits can tell apart
BLOCK_IDS = 1 << 18  # ids of a block, unless its last document has more
LENGTH_BITS = 5  # hold the length of a code
LANE_IDS = 256  # a checkpoint holds the bit offset of every so many ids
SLICE_BYTES = 16 << 20  # of texts whose distinct words are encoded together
ODD_CASE = "\u0130\u03a3"  # letters whose lower case depends on more than the letter

_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Whole-text encoding through the tokenizers library: the distinct words of a slice of texts are encoded once.

    Only for a tokenizer whose pre-tokenizer never joins across a space or a line feed and removes both, and whose only
    normalisation is NFC, white space and lower case, as word_bpe has it. Splitting, finding distinct words and putting the
    ids together again are Arrow and numpy kernels over the slice; runs of letters are encoded in one call, told apart by the
    end-of-word mark, and a full stop or comma after letters is taken apart from them.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)  # the same model for words that are normalised and cut already
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.lib.get_vocab()
        self.size = max(vocab.values()) + 1
        self.last = np.zeros(self.size, dtype=bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._each([m])[0][0] for m in (".", ",")}

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words, one by one."""
        found = [e.ids for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in found for i in x], dtype=np.int64), np.array([len(x) for x in found], dtype=np.int64)

    def _letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of letters, all in one call."""
        if not len(words):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        plain = pc.binary_join(pa.scalar(words.to_pylist(), pa.list_(pa.string())), " ").as_py()
        plain = plain.lower() if plain.isascii() else normalize("NFC", plain).lower()
        ids = np.array(self.letters.encode_batch_fast([plain], add_special_tokens=False)[0].ids, dtype=np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or len(ids) != ends[-1]:
            return self._each(words.to_pylist())
        return ids, np.diff(ends, prepend=0)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct words."""
        n = len(words)
        mark = pc.utf8_slice_codeunits(words, -1)
        tail = {m: pc.equal(mark, m).to_numpy(zero_copy_only=False) for m in self.marks}
        ended = np.logical_or.reduce(list(tail.values()))
        stems = pc.if_else(pa.array(ended), pc.utf8_slice_codeunits(words, 0, -1), words)
        odd = pc.match_substring_regex(stems, f"[{ODD_CASE}]")
        plain = pc.and_(pc.utf8_is_alpha(stems), pc.invert(odd)).to_numpy(zero_copy_only=False)
        by_stem = stems.filter(pa.array(plain)).dictionary_encode()
        at = by_stem.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, sizes = self._letters(by_stem.dictionary)
        rest_ids, rest_sizes = self._each(words.filter(pa.array(~plain)).to_pylist())
        ends, rest_ends = np.cumsum(sizes), np.cumsum(rest_sizes)
        starts, out_sizes = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        starts[plain], out_sizes[plain] = (ends - sizes)[at], sizes[at] + ended[plain]
        starts[~plain], out_sizes[~plain] = len(ids) + rest_ends - rest_sizes, rest_sizes
        out, out_ends = gather(np.concatenate([ids, rest_ids, [0]]), starts, out_sizes)  # a mark's place holds the next word's id till now
        for m, has in tail.items():
            out[out_ends[has & plain] - 1] = self.marks[m]
        return out, out_sizes

    def __call__(self, texts: pa.Array, end_id: int, dtype: str = "<u4") -> pa.Array:
        """Binary array: the ids of each text and then end_id, as dtype. texts: a string array without nulls."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        ids, sizes = self._words(words.dictionary)
        ids, sizes = np.append(ids, end_id), np.append(sizes, 1)
        after = lists.offsets.to_numpy().astype(np.int64)
        after = after[1:] - after[0]
        order = np.insert(words.indices.to_numpy(zero_copy_only=False), after, len(words.dictionary))
        out, ends = gather(ids.astype(dtype), (np.cumsum(sizes) - sizes)[order], sizes[order])
        offsets = np.append(0, ends[after + np.arange(len(after))]) * out.itemsize
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def id_type(path: str, end_id: int) -> str:
    """Ids between the steps take two bytes where all fit."""
    return "<u2" if max(tokenizer(path).size, end_id + 1) <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned integers of id_type, end_id last."""
    dtype = id_type(path, end_id)

    def encode(batches):
        own = tokenizer(path)
        for batch in batches:
            texts = batch["body"]
            for at, n in slices(texts, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, n), own(texts.slice(at, n), end_id, dtype)], names=["doc_id", "ids"])

    return id_and_text(docs).where("doc_id is not null").mapInArrow(encode, "doc_id long, ids binary")


def id_counts(ids: DataFrame, dtype: str) -> DataFrame:
    """(id, n) over all rows; every task sends at most one row for each id."""

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            own = batch["ids"]
            if len(own):
                offsets = np.frombuffer(own.buffers()[1], dtype=np.int32)[own.offset : own.offset + len(own) + 1]
                c = np.bincount(np.frombuffer(own.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(dtype))
                if len(c) > len(total):
                    c, total = total, c
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than max_bits, by package-merge; counts are above zero."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    max_bits = max(max_bits, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.int64)
    weights, is_leaf = leaf, [np.ones(n, dtype=bool)]
    for _ in range(max_bits - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        weights = both[rank]
        is_leaf.append(rank < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        leaves = int(flags[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical codes: symbols in order of (length, id) get consecutive codes. Decoding looks up `bits` bits at a time."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.bits = int(lengths.max()) if len(lengths) else 1
        order = np.lexsort((ids, lengths))
        self.ids, lens = ids[order], lengths[order].astype(np.int64)
        first = np.concatenate([[0], np.cumsum(1 << (self.bits - lens))[:-1]]) if len(lens) else np.zeros(0, dtype=np.int64)
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64)
        self.code[self.ids] = (first >> (self.bits - lens)).astype(np.uint64)
        self.length[self.ids] = lens
        spans = 1 << (self.bits - lens)
        self.entry = np.ones(1 << self.bits, dtype=np.int64)  # the id and, in the last LENGTH_BITS bits, the length of its code
        self.entry[: spans.sum()] = np.repeat(self.ids << LENGTH_BITS | lens, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """The bits, the bit offset of every LANE_IDS-th id, and how many bits there are."""
        lens, code = self.length[ids], self.code[ids]
        if len(ids) % 2:
            lens, code = np.append(lens, 0), np.append(code, np.uint64(0))
        code = (code[::2] << lens[1::2].astype(np.uint64)) | code[1::2]  # two codes are placed as one
        lens = lens[::2] + lens[1::2]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        starts = ends - lens
        words = np.zeros(total // 64 + 2, dtype=np.uint64)
        at, shift = starts >> 6, 64 - (starts & 63) - lens
        over = np.flatnonzero(shift < 0)  # the one code of a word that reaches into the next
        head = code << np.maximum(shift, 0).astype(np.uint64)
        head[over] = code[over] >> (-shift[over]).astype(np.uint64)
        if len(ids):
            runs = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[runs]] = np.bitwise_or.reduceat(head, runs)
            words[at[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (total + 7) // 8], starts[:: LANE_IDS // 2].astype(np.int64), total

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All lanes between checkpoints advance together, one id each a step."""
        window = np.ndarray(len(data), dtype=">u8", buffer=data + b"\0" * 8, strides=(1,))  # eight bytes from every byte on
        at, lanes = checkpoints.astype(np.int64), len(checkpoints)
        out = np.zeros((LANE_IDS, lanes), dtype=np.uint32)
        mask, shift, last = (1 << self.bits) - 1, 64 - self.bits, (1 << LENGTH_BITS) - 1
        for k in range(min(LANE_IDS, n)):
            live = lanes if (lanes - 1) * LANE_IDS + k < n else lanes - 1
            pos = at[:live]
            look = (window[pos >> 3].astype(np.uint64) >> (shift - (pos & 7)).astype(np.uint64)).view(np.int64) & mask
            found = self.entry[look]
            out[k, :live] = found >> LENGTH_BITS
            pos += found & last
        return out.T.reshape(-1)[:n]


BLOCKS = "shard int, block int, start_in_shard long, n_ids long, n_bits long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, payload binary"
BLOCK_SCHEMA = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[t]) for n, t in map(str.split, BLOCKS.split(", "))])


def write_tokens(docs: DataFrame, path: str, end_id: int, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """Encode whole texts and write them in ascending doc_id order. Returns (blocks, code): both tables are the file format.

    code (id, length) rebuilds the canonical code. A block holds whole documents, its ids' bits and the bit offsets of every
    LANE_IDS-th id, and decodes on its own. Shards are ranges of doc_id, so any lost task is made again from its range.
    Null or empty text gives end_id alone; rows with a null doc_id have no place in the order and are left out; repeated
    rows are written each time. Empty tables give tables without rows. The only rows the driver sees are the counts, at
    most one for each id of the vocabulary.
    """
    spark = docs.sparkSession
    ids = written(tokenize(docs, path, end_id), "token-ids")
    dtype = id_type(path, end_id)
    counts = id_counts(ids, dtype).orderBy("id").toPandas()
    lengths = code_lengths(counts["n"].to_numpy(), max_bits)
    code = written(spark.createDataFrame(pd.DataFrame({"id": counts["id"].astype("int64"), "length": lengths.astype("int64")}), "id long, length long").coalesce(1), "token-code")
    table = spark.sparkContext.broadcast((counts["id"].to_numpy(dtype=np.int64), lengths))

    def pack(batches):
        coder, shard, block, start = Code(*table.value), TaskContext.get().partitionId(), 0, 0
        docs, sizes, parts = [], [], []

        def close(n):
            """A row of the first n documents held."""
            nonlocal docs, sizes, parts, block, start
            held, own = np.concatenate(parts), np.array(sizes[:n], dtype=np.int64)
            size = int(own.sum())
            data, marks, bits = coder.encode(held[:size])
            row = {"shard": shard, "block": block, "start_in_shard": start, "n_ids": size, "n_bits": bits, "doc_ids": docs[:n], "doc_tokens": own, "checkpoints": marks, "payload": data}
            docs, sizes, parts, block, start = docs[n:], sizes[n:], [held[size:]], block + 1, start + size
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for batch in batches:
            if not len(batch):
                continue
            own = batch["ids"]
            offsets = np.frombuffer(own.buffers()[1], dtype=np.int32)[own.offset : own.offset + len(own) + 1]
            parts.append(np.frombuffer(own.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(dtype))
            docs += batch["doc_id"].to_pylist()
            sizes += (np.diff(offsets) // parts[-1].itemsize).tolist()
            size = n = 0
            for k, x in enumerate(list(sizes), 1):
                size += x
                if size >= BLOCK_IDS:
                    yield close(k - n)
                    size, n = 0, k
        if docs:
            yield close(len(docs))

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(pack, BLOCKS), "token-blocks"), code


def read_tokens(blocks: DataFrame, code: DataFrame) -> DataFrame:
    """(doc_id, start, ids): decode every block; start counts the ids of all documents before it."""
    spark = blocks.sparkSession
    rows = code.toPandas()  # at most one row for each id of the vocabulary
    table = spark.sparkContext.broadcast((rows["id"].to_numpy(dtype=np.int64), rows["length"].to_numpy(dtype=np.int64)))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row for each shard
    before = dict(zip((r["shard"] for r in shards), np.concatenate([[0], np.cumsum([r["n"] for r in shards])]).tolist(), strict=False))

    def unpack(batches):
        coder = Code(*table.value)
        for batch in batches:
            for r in batch.to_pylist():
                ids = coder.decode(r["payload"], np.array(r["checkpoints"]), r["n_ids"])
                sizes = np.array(r["doc_tokens"])
                ends = np.cumsum(sizes)
                offsets = np.append(0, ends * ids.itemsize).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(before[r["shard"]] + r["start_in_shard"] + ends - sizes), binary], names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(unpack, "doc_id long, start long, ids binary")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document's ids as read back."""
    return tokens.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
