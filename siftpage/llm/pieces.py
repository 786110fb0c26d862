"""SentencePiece encoding over a relational lattice, and decoding."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gather, id_and_text, release, slices

SPACE = "▁"
BATCH_CHARS = 8_000_000  # of text that is taken apart and put together again at once, unless one text has more
SLICE_BYTES = 1 << 18  # of text that is cut at once
USES = 4096  # about as many batches share one encoding of a word
UNKNOWN_PENALTY = 10.0  # fixed value: below the lowest score, for a character that is no piece


def piece_table(spark: SparkSession, path: str) -> tuple[DataFrame, int, list[bytes], list[str]]:
    """((piece, id, score), id of byte 0, bytes of each id, pieces) of a model with byte fallback; spaces stand for SPACE."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows, surface = [], []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            surface.append(bytes([int(p[1:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            surface.append(b"")
        else:
            p = p.replace(SPACE, " ")
            surface.append(p.encode())
            rows.append((p, i, float(sp.get_score(i))))
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "id", "score"]), "piece string, id int, score double")
    return table, sp.piece_to_id("<0x00>"), surface, [r[0] for r in rows]


class Cutter:
    """Cuts texts where no piece can lie across: between two characters that stand side by side in no piece."""

    def __init__(self, pieces: list[str]):
        pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        number = {c: i for i, c in enumerate(sorted(set("".join(pairs))), 1)}
        self.kind = np.zeros(0x110000, dtype=np.int32)
        self.kind[[ord(c) for c in number]] = list(number.values())
        self.many = len(number) + 1
        self.joined = np.zeros(self.many * self.many, dtype=bool)
        self.joined[[number[x] * self.many + number[y] for x, y in pairs]] = True

    def __call__(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts in order, and how many each text has. A text gets a space in front; an empty one has no words."""
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.replace_substring(pc.binary_join_element_wise("", texts, " "), SPACE, " "))
        data = pc.binary_join(pa.scalar(spaced.to_pylist(), pa.list_(pa.string())), "").as_py()
        point = np.frombuffer(data.encode("utf-32-le"), dtype="<u4")
        first = np.append(0, np.cumsum(pc.utf8_length(spaced).to_numpy(zero_copy_only=False), dtype=np.int64))
        kind = self.kind[point]
        opens = np.ones(len(point) + 1, dtype=bool)
        opens[1:-1] = ~self.joined[kind[:-1] * self.many + kind[1:]]
        opens[first] = True
        starts = np.flatnonzero(opens)
        width = 1 + (point >= 0x80).astype(np.int8) + (point >= 0x800) + (point >= 0x10000)
        offsets = np.append(0, np.cumsum(width, dtype=np.int32))[starts].astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data.encode())])
        return words.dictionary_encode(), np.diff(np.searchsorted(starts, first))


TEXTS = "batch long, n_words int, doc_ids array<long>, sizes array<int>, places binary"
WORDS = "batch long, bucket int, words array<string>, places array<int>"


def _one(a: pa.Array) -> pa.ListArray:
    """A list array of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)


def take_apart(base: DataFrame, pieces: list[str], batch_chars: int, buckets: int = 0) -> DataFrame:
    """(doc_id, body) -> batches of texts: TEXTS, one row each with the texts as places in the batch's distinct words, or with
    buckets WORDS, those words and their places dealt by a hash of the word.

    batch is a number made from the place in the input and the content, so it tells when base is read twice and differs.
    """

    def run(batches):
        cut, task, made = Cutter(pieces), TaskContext.get().partitionId(), 0

        def close(ids, words, sizes):
            nonlocal made
            words = pa.chunked_array(words).unify_dictionaries()
            known = words.chunk(0).dictionary
            places = _compressed(np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in words.chunks]))
            name = xxhash.xxh3_64_intdigest(places + repr((task, made, ids, known[:1000].to_pylist())).encode()) >> 1
            made += 1
            if not buckets:
                row = [pa.array([name], pa.int64()), pa.array([len(known)], pa.int32()), _one(pa.array(ids, pa.int64())), _one(pa.array(np.concatenate(sizes), pa.int32())), pa.array([places], pa.binary())]
                return pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in TEXTS.split(", ")])
            at = (pd.util.hash_array(known.to_numpy(zero_copy_only=False), categorize=False) % buckets).astype(np.int32)
            order = np.argsort(at, kind="stable").astype(np.int32)
            at = at[order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            ends = pa.array(np.append(first, len(at)).astype(np.int32))
            row = [pa.array(np.full(len(first), name)), pa.array(at[first]), pa.ListArray.from_arrays(ends, known.take(pa.array(order))), pa.ListArray.from_arrays(ends, pa.array(order))]
            return pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in WORDS.split(", ")])

        ids, words, sizes, chars = [], [], [], 0
        for batch in batches:
            for at, n in slices(batch["body"], min(SLICE_BYTES, batch_chars)):
                texts = batch["body"].slice(at, n)
                w, k = cut(texts)
                ids += batch["doc_id"].slice(at, n).to_pylist()
                words.append(w)
                sizes.append(k)
                chars += len(texts) + (pc.sum(pc.utf8_length(texts)).as_py() or 0)
                if chars >= batch_chars:
                    yield close(ids, words, sizes)
                    ids, words, sizes, chars = [], [], [], 0
                    release()
        if ids:
            yield close(ids, words, sizes)
        ids = words = sizes = cut = batch = None
        release()

    return base.mapInArrow(run, WORDS if buckets else TEXTS)


# A character that is no piece has its code point for an id, marked by UNSEEN.
UNSEEN = 1 << 23
# One edge after the other. nodes: score and ids of the best path to each of the last places; place p is at p + shift.
_REACHED = "element_at(s.nodes, e.from + s.shift)"
_NODE = f"named_struct('score', {_REACHED}.score + e.score, 'ids', array_append({_REACHED}.ids, e.id))"
_STEP = f"""aggregate(edges, named_struct('at', 0, 'shift', 1, 'nodes', array(named_struct('score', 0D, 'ids', cast(array() as array<int>)))), (s, e) ->
    if(e.to = s.at,
        if({_REACHED}.score + e.score > element_at(s.nodes, e.to + s.shift).score,
            named_struct('at', s.at, 'shift', s.shift, 'nodes', array_append(slice(s.nodes, 1, size(s.nodes) - 1), {_NODE})),
            s),
        if(size(s.nodes) > :longest,
            named_struct('at', e.to, 'shift', s.shift - 1, 'nodes', array_append(slice(s.nodes, 2, :longest), {_NODE})),
            named_struct('at', e.to, 'shift', s.shift, 'nodes', array_append(s.nodes, {_NODE})))))"""


def _utf8(point: Column) -> Column:
    """The bytes of a code point."""
    tail = lambda k: 0x80 + F.shiftright(point, 6 * k) % 64
    two = F.array(0xC0 + F.shiftright(point, 6), tail(0))
    three = F.array(0xE0 + F.shiftright(point, 12), tail(1), tail(0))
    four = F.array(0xF0 + F.shiftright(point, 18), tail(2), tail(1), tail(0))
    return F.when(point < 0x80, F.array(point)).when(point < 0x800, two).when(point < 0x10000, three).otherwise(four)


def lattice(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(bucket, word, uses), dealt by bucket -> (uses, edges) with the edges of each word, by end and the longer first.

    Substrings up to the longest piece are exploded and meet the piece table (as many rows as the model has pieces, so it
    is broadcast) by equality. A character that is no piece is an edge too, at UNKNOWN_PENALTY below the lowest score. uses
    goes with the first character's row.
    """
    longest, lowest = pieces.agg(F.max(F.length("piece")), F.min("score")).first()
    longest, unknown = longest or 1, (lowest or 0.0) - UNKNOWN_PENALTY
    words = words.select("bucket", F.monotonically_increasing_id().alias("nth"), "word", "uses")
    subs = words.select("bucket", "nth", "word", "uses", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("to"))
    subs = subs.withColumn("uses", F.when(F.col("to") == 1, F.col("uses")))
    subs = subs.select("bucket", "nth", "word", "uses", "to", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("to")))).alias("len"))
    subs = subs.select("bucket", "nth", "uses", "to", "len", F.expr("substring(word, to - len + 1, len)").alias("piece"))
    edges = subs.join(F.broadcast(pieces), "piece", "left").where("id is not null or len = 1")
    edge = F.struct("to", (F.col("to") - F.col("len")).alias("from"), F.coalesce("id", F.ascii("piece") + UNSEEN).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score"))
    edges = edges.select("bucket", "nth", "uses", edge.alias("edge"))
    return edges.groupBy("nth", "bucket").agg(F.first("uses", ignorenulls=True).alias("uses"), F.sort_array(F.collect_list("edge")).alias("edges"))


def best_path(edges: DataFrame, longest: int, byte0: int) -> DataFrame:
    """(uses, edges) -> (uses, ids): the path with the highest sum of scores, by one fold over the edges.

    Of equal sums the path whose last piece is longer wins. Characters that are no piece become the ids of their bytes.
    """
    found = edges.select("uses", F.expr(f"element_at({_STEP.replace(':longest', str(longest))}.nodes, -1).ids").alias("ids"))
    as_bytes = lambda i: F.transform(_utf8(i - UNSEEN), lambda b: (b + byte0).cast("int"))
    bytewise = F.flatten(F.transform("ids", lambda i: F.when(i >= UNSEEN, as_bytes(i)).otherwise(F.array(i))))
    return found.select("uses", F.when(F.exists("ids", lambda i: i >= UNSEEN), bytewise).otherwise(F.col("ids")).alias("ids"))


def _packed(batches):
    """(batch, place, ids) of a task -> a row for each batch with all its places, sizes and ids."""

    def close(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("batch", "ascending")]))
        batch, lists = rows["batch"].to_numpy(), rows["ids"].combine_chunks()
        first = np.flatnonzero(np.diff(batch, prepend=batch[0] - 1))
        at, ends = lists.offsets.to_numpy(), np.append(first[1:], len(batch))
        flat, places, sizes = lists.values.to_numpy().astype("<u4"), rows["place"].to_numpy().astype("<u4"), np.diff(at).astype("<u4")
        blobs = [[_compressed(a[x:y]) for x, y in zip(lo, hi, strict=True)] for a, lo, hi in ((places, first, ends), (sizes, first, ends), (flat, at[first], at[ends]))]
        return pa.RecordBatch.from_arrays([pa.array(batch[first]), pa.array((ends - first).astype(np.int32)), pa.array((at[ends] - at[first]).astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], names=[c.split()[0] for c in PACKED.split(", ")])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= 250_000:
            yield close(held)
            held, n = [], 0
    if n:
        yield close(held)
    held.clear()
    release()


PACKED = "batch long, n_words int, n_ids int, places binary, sizes binary, ids binary"


def _compressed(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _restored(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(4, n).T.copy().view("<u4")[:, 0]


def encode(docs: DataFrame, path: str, batch_chars: int = BATCH_CHARS, then: Callable[[pa.Table], pa.Table] = lambda t: t, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """One row per row of docs: doc_id, ids array<int>; or what `then` makes of an Arrow table of these, with that schema.

    Texts are cut into words that no piece crosses, so the best path of a text is that of its words one after the other.
    Batches of texts become their distinct words and the texts as places in them. The words of all batches meet, each is
    encoded once by lattice and best_path (once for every USES batches or so, so no row grows with the input), and its ids
    go back to its batches, where the texts are put together; no task holds more than a batch of texts at a time. docs is
    read twice and must give the same rows both times, as a table does; else an error is raised. ids are those of the
    highest sum of scores. A model trained by merges takes another path for some words in its own library. Null and empty
    texts have no ids; rows with a null doc_id count like others; repeated rows each give a row; an empty table gives an
    empty result. SPACE in a text is read as a space.
    """
    spark = docs.sparkSession
    pieces, byte0, _, names = piece_table(spark, path)
    base = id_and_text(docs)
    chars = base.agg(F.sum(F.length("body"))).first()[0] or 0
    tasks = max(1, -(-chars // batch_chars))
    dealt = take_apart(base, names, batch_chars, tasks).repartition(tasks, "bucket")
    pairs = dealt.select("bucket", "batch", F.explode(F.arrays_zip("words", "places")).alias("w")).select("bucket", F.pmod("batch", F.lit(-(-tasks // USES))).alias("part"), F.col("w.words").alias("word"), F.struct("batch", F.col("w.places").alias("place")).alias("use"))
    words = pairs.groupBy("bucket", "part", "word").agg(F.collect_list("use").alias("uses"))
    coded = best_path(lattice(words, pieces), max(map(len, names), default=1), byte0)
    back = coded.select(F.explode("uses").alias("u"), "ids").select("u.batch", "u.place", "ids").mapInArrow(_packed, PACKED)

    def put_together(texts: pa.Table, coded: pa.Table) -> pa.Table:
        rows, parts = coded.to_pylist(), []
        column = lambda name, n: np.concatenate([_restored(r[name], r[n]) for r in rows]) if rows else np.zeros(0, "<u4")
        order, sizes, flat = column("places", "n_words"), column("sizes", "n_words").astype(np.int64), column("ids", "n_ids").view("<i4")
        starts, own = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        starts[order], own[order] = np.cumsum(sizes) - sizes, sizes
        for r in texts.to_pylist():
            if r["n_words"] != len(order):
                raise ValueError("the documents changed between two readings")
            units = np.array(r["sizes"], dtype=np.int64)
            places = _restored(r["places"], int(units.sum()))
            ids = np.concatenate([flat[:0], *(gather(flat, starts[p], own[p])[0] for p in np.array_split(places, len(places) // 200_000 + 1))])
            ends = np.append(0, np.cumsum(own[places]))[np.append(0, np.cumsum(units))].astype(np.int32)
            parts.append(then(pa.table({"doc_id": pa.array(r["doc_ids"], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))})))
        if not parts:
            raise ValueError("the documents changed between two readings")
        release()
        return pa.concat_tables(parts)

    texts = take_apart(base, names, batch_chars).repartition(tasks, "batch")
    return texts.groupBy("batch").cogroup(back.repartition(tasks, "batch").groupBy("batch")).applyInArrow(put_together, schema)


def decoder(spark: SparkSession, path: str):
    """A pandas UDF: ids -> text."""
    surface = piece_table(spark, path)[2]

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: decoded(surface, x))

    return decode


def decoded(surface: list[bytes], ids: np.ndarray) -> str:
    return b"".join(map(surface.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_md5): the ids of encode as little-endian 32-bit integers, and the text decoded from them."""
    surface = piece_table(docs.sparkSession, path)[2]

    def digest(coded: pa.Table) -> pa.Table:
        lists = coded["ids"].combine_chunks()
        ids, at = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
        rows = [ids[x:y] for x, y in zip(at, at[1:])]
        sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in rows]
        texts = [hashlib.md5(decoded(surface, x).encode()).hexdigest() for x in rows]
        return pa.table({"doc_id": coded["doc_id"], "n_ids": pa.array(np.diff(at).astype(np.int32)), "ids_crc32": pa.array(sums, pa.int64()), "decoded_md5": pa.array(texts, pa.string())})

    return encode(docs, path, then=digest, schema="doc_id long, n_ids int, ids_crc32 long, decoded_md5 string")
