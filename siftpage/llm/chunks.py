"""Substring dedup by content-defined chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, written

WINDOW = 24  # bytes that decide on a cut
MASK_BITS = 5  # a cut every 32 bytes or so
LEAST, MOST = 12, 128  # bytes of a chunk
MIN_WORDS = 24  # of a run of repeated chunks; a passage loses up to a chunk at either end and where cuts fall back in step, so of passages of 51 words about 3 in 100 leave less than this, of 60 words under 1


def gear_table() -> np.ndarray:
    """A 32-bit number for every byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint32)


def cut_points(data: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of a UTF-8 text. A cut depends on the WINDOW bytes before it, never splits a character, and leaves
    LEAST to MOST bytes (a longer last character apart)."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    if not n:
        return []
    g, h = gear[raw], np.zeros(n, dtype=np.uint32)
    for k in range(min(WINDOW, n)):  # gear hash: h = 2 h + g, kept to WINDOW bytes
        h[k:] += g[: n - k] << np.uint32(k)
    top = np.uint32(((1 << MASK_BITS) - 1) << (WINDOW - MASK_BITS))
    whole = np.ones(n, dtype=bool)
    whole[:-1] = (raw[1:] & 0xC0) != 0x80
    ends, at = [], 0
    for c in (np.flatnonzero(((h & top) == 0) & whole) + 1).tolist():
        while c - at > MOST:
            at += MOST
            while not whole[at - 1]:
                at += 1
            ends.append(at)
        if c - at >= LEAST:
            ends.append(c)
            at = c
    while n - at > MOST:
        at += MOST
        while not whole[at - 1]:
            at += 1
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunk(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, same, digests array<binary>, ends array<int>, words array<int>) for every row that has a doc_id.

    rid tells the rows apart, repeated ids too; same is the digest of the whole text.
    """

    def run(batches):
        gear, task, n = gear_table(), TaskContext.get().partitionId(), 0
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["body"], strict=True):
                data = t.encode()
                ends = cut_points(data, gear)
                parts = [data[a:b] for a, b in zip([0, *ends], ends)]
                rows.append((i, task << 36 | n, xxhash.xxh3_128_digest(data), [xxhash.xxh3_128_digest(p) for p in parts], ends, [len(p.split()) for p in parts]))
                n += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNKED.split(", ")])

    return id_and_text(docs).where("doc_id is not null").mapInPandas(run, CHUNKED)


CHUNKED = "doc_id long, rid long, same binary, digests array<binary>, ends array<int>, words array<int>"


def _runs(min_words: int):
    """A pandas UDF over a row's repeated chunks and all its ends and words."""

    @F.pandas_udf("repeated_words long, spans array<struct<start:int,end:int>>, keepers array<long>")
    def runs(cs: pd.Series, ends: pd.Series, words: pd.Series) -> pd.DataFrame:
        rows = []
        for own, all_ends, all_words in zip(cs, ends, words, strict=True):
            groups: list[list] = []
            for c in own if own is not None else []:
                if groups and c["pos"] == groups[-1][-1]["pos"] + 1:
                    groups[-1].append(c)
                else:
                    groups.append([c])
            total, spans, keepers = 0, [], set()
            for group in groups:
                size = sum(int(all_words[c["pos"]]) for c in group)
                if size < min_words:
                    continue
                total += size
                for c in group:
                    if c["later"]:
                        start = int(all_ends[c["pos"] - 1]) if c["pos"] else 0
                        if spans and spans[-1]["end"] == start:
                            spans[-1]["end"] = int(all_ends[c["pos"]])
                        else:
                            spans.append({"start": start, "end": int(all_ends[c["pos"]])})
                        keepers.add(c["keeper"])
            rows.append((total, spans, sorted(keepers)))
        return pd.DataFrame(rows, columns=["repeated_words", "spans", "keepers"])

    return runs


def _spans(docs: DataFrame, min_words: int) -> DataFrame:
    chunks = written(chunk(docs), "chunks")
    each = chunks.select("doc_id", "rid", F.posexplode("digests").alias("pos", "digest"))
    place = F.struct("doc_id", "rid", "pos")
    many = each.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first")
    again = each.join(many, "digest").select("rid", F.struct("pos", F.col("first.doc_id").alias("keeper"), (place != F.col("first")).alias("later")).alias("c"))
    listed = again.groupBy("rid").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    found = chunks.select("doc_id", "rid", "same", "ends", "words").join(listed, "rid", "left").select("doc_id", "same", F.size("ends").alias("n_chunks"), _runs(min_words)("cs", "ends", "words").alias("r"))
    cut = F.aggregate("r.spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "same", "n_chunks", "r.repeated_words", cut.cast("long").alias("removed_bytes"), "r.spans", "r.keepers")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_chunks, repeated_words, removed_bytes, spans, keepers.

    A gear rolling hash cuts the UTF-8 bytes where the last WINDOW bytes say so; an insertion moves the cuts near it and no
    others. Chunks are equal when their 128-bit digests are. The first holder of a chunk (least doc_id, then place) keeps
    it. spans are the [start, end) byte ranges of runs of later copies with min_words words or more in all, joined where
    they touch; keepers the doc_ids that keep them. repeated_words counts words in such runs, first holders included.
    Occurrences of a digest are counted by partial aggregation and met again by a join that Spark may split, so a very
    common passage is never gathered. Null or empty text has no chunks and no spans; rows of one doc_id are texts of their
    own, of which the one read first keeps; rows without a doc_id are left out; an empty table gives an empty result.
    """
    return _spans(docs, min_words).drop("same")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with the later copies cut out of `text`, all other columns as they are. Rows equal in id and text are cut
    alike, as the first of them is."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, spans, strict=True):
            if t is not None and ss is not None and len(ss):
                data, at, parts = t.encode(), 0, []
                for s in ss:
                    parts.append(data[at : s["start"]])
                    at = s["end"]
                t = b"".join([*parts, data[at:]]).decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    digest = F.pandas_udf(lambda texts: pd.Series([xxhash.xxh3_128_digest((t or "").encode()) for t in texts]), "binary")
    least = _spans(docs, min_words).groupBy("doc_id", "same").agg(F.min_by("spans", "removed_bytes").alias("spans")).where("size(spans) > 0")
    names = fresh(docs, "id", "same", "spans")
    spans = least.toDF(*names)
    keyed = docs.withColumn("_" + names[1], digest("text"))
    joined = keyed.join(spans, (keyed["doc_id"] == spans[names[0]]) & (keyed["_" + names[1]] == spans[names[1]]), "left")
    return joined.withColumn("text", cut("text", names[2])).select(*docs.columns)
