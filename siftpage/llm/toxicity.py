"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, without, written

TERMS = 512  # words of the index, at most: those tied closest to the label
LEAST_DOCS = 3  # training documents that such a word is in
MARGIN = 2.0  # of the log-likelihood ratio over the logarithm of the words weighed: among so many, some are tied to the label by chance
LIFT = 2.0  # times as frequent in toxic documents as in others, at least
EXAMPLES = 2048  # labelled examples of each class, at most
NEIGHBOURS = 16
PRIOR = 1.0  # votes at the rate of documents without such a word, which every document gets
BLOCK = 64
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))


class BlockMaxIndex:
    """Postings by word over examples in blocks, with the largest weight in each block. top() is exact: a block is opened
    only while its bound can still beat the k-th best, and bounds never fall below a cosine in the block."""

    def __init__(self, vectors: list[list[int]], idf: np.ndarray):
        self.idf, self.n = idf, len(vectors)
        norms = np.array([np.sqrt((idf[v] ** 2).sum()) if len(v) else 1.0 for v in vectors])
        self.order = np.array(sorted(range(self.n), key=lambda i: (sorted(vectors[i], key=lambda t: -idf[t])[:4], i)), dtype=np.int64)  # alike examples share blocks
        self.blocks = -(-self.n // BLOCK)
        weights = np.zeros((len(idf), self.blocks * BLOCK), dtype=np.float64)
        for place, i in enumerate(self.order):
            weights[vectors[i], place] = idf[vectors[i]] / norms[i]
        self.weights = weights.reshape(len(idf), self.blocks, BLOCK)
        self.most = self.weights.max(axis=2)

    def top(self, terms: list[int], k: int) -> list[tuple[int, float]]:
        """(example, cosine) of the k nearest with a cosine above zero and of all that are as near as the k-th, nearest first."""
        if not terms or not self.n:
            return []
        q = self.idf[terms] / np.sqrt((self.idf[terms] ** 2).sum())
        bound = q @ self.most[terms]
        places, cosines, least = np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] + 1e-11 < least:
                break
            cos = np.round(q @ self.weights[terms, b], 12)
            hit = np.flatnonzero((cos > 0) & (cos >= least))
            places, cosines = np.concatenate([places, self.order[b * BLOCK + hit]]), np.concatenate([cosines, cos[hit]])
            if len(cosines) >= k:
                least = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
        near = np.flatnonzero(cosines >= least)
        near = near[np.lexsort((places[near], -cosines[near]))]
        return list(zip(places[near].tolist(), cosines[near].tolist(), strict=True))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (the nearest examples with label and cosine).

    Learns from labelled rows outside the held-out fold alone. Word statistics of both classes run over all of them, idf
    over all documents; the TERMS words with the highest log-likelihood ratio among those LIFT times as frequent in toxic ones
    make the vectors (a word counts once in a text), if the ratio exceeds the logarithm of how many words were weighed by
    MARGIN, so the bar follows the size of the corpus. The examples are a bounded sample, EXAMPLES of each class in the order
    of a hash of doc_id, weighted back to the classes' sizes. score = weighted votes of the NEIGHBOURS nearest by cosine and
    of all others as near as the last of them, with PRIOR votes at the share of toxic ones among the rows learnt from that have
    none of the words; texts without any, null or empty ones too, get that share. It is 0 without any label. Rows with a null doc_id are scored, never learnt from; documents with several labels
    count once for each; repeated rows each give a row; empty tables give an empty result.
    """
    spark = docs.sparkSession
    base = id_and_text(docs)
    marked = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    train = base.where(~held_out(F.col("doc_id"))).join(marked.hint("merge"), "doc_id")  # one plan at every size: labels grow with the documents
    sets = train.select("doc_id", "y", _words(F.col("body")).alias("words"))
    sizes = {r["y"]: r["n"] for r in marked.join(base.select("doc_id"), "doc_id").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    terms = sets.select("y", F.explode("words").alias("term")).groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    a, b = F.col("a"), F.col("n") - F.col("a")
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    share = n1 / max(n1 + n0, 1)
    g2 = part(a, F.col("n") * share) + part(b, F.col("n") * (1 - share)) + part(n1 - a, (n1 + n0 - F.col("n")) * share) + part(n0 - b, (n1 + n0 - F.col("n")) * (1 - share))
    weighed = written(terms.where((F.col("n") >= LEAST_DOCS) & (F.col("term") != "")).select("term", "n", "a", g2.alias("g2")), "toxic-words")
    least = MARGIN + float(np.log(max(weighed.count(), 1)))
    picked = weighed.where((a * max(n0, 1) >= LIFT * b * max(n1, 1)) & (F.col("g2") >= least)).orderBy(F.round("g2", 6).desc(), "term").limit(TERMS)
    vocabulary = [r["term"] for r in picked.select("term").collect()] if n1 and n0 else []  # TERMS rows at most
    known = F.array_intersect(F.split(F.lower("body"), r"[^\p{L}\p{N}_]+"), F.lit(vocabulary or ["\u0000"]))
    places = F.array_sort(F.transform(known, lambda w: F.array_position(F.lit(vocabulary or ["\u0000"]), w).cast("int") - 1))  # numbers, as they are handed to Python
    found = written(base.select("doc_id", places.alias("terms")), "toxic-terms")
    counts = found.select(F.explode(F.array_append("terms", F.lit(-1))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # a row for each word of the index
    df = {r["term"]: r["df"] for r in counts}
    idf = np.array([np.log((1 + df.get(-1, 0)) / (1 + df.get(i, 0))) + 1 for i in range(len(vocabulary))])
    sample = []
    for y in (0, 1):
        chosen = marked.where(F.col("y") == y).join(found, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
        sample += [(r["doc_id"], y, list(r["terms"])) for r in chosen.select("doc_id", "terms").collect()]  # EXAMPLES rows at most
    weight = {y: n / max(sum(s[1] == y for s in sample), 1) for y, n in ((0, n0), (1, n1))}
    bare = marked.join(found.where("size(terms) = 0").select("doc_id"), "doc_id").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
    rate = ((bare["y"] or 0) + share) / (bare["n"] + 1)
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, idf, sample, weight, rate))

    @F.pandas_udf("score double, evidence array<struct<doc_id:bigint,label:int,cosine:double>>")
    def vote(batches: pd.Series) -> pd.DataFrame:
        _, _, sample, weight, rate = model.value
        index, seen = toxic_index(model), {}
        rows = []
        for own in batches:
            key = own.tobytes()
            if key not in seen:
                near = index.top(own.tolist(), NEIGHBOURS)
                for_, all_ = PRIOR * rate, PRIOR
                for i, c in near:
                    w = c * weight[sample[i][1]]
                    for_, all_ = for_ + w * sample[i][1], all_ + w
                seen[key] = (for_ / all_, [{"doc_id": sample[i][0], "label": sample[i][1], "cosine": c} for i, c in near[:3]])
            rows.append(seen[key])
        return pd.DataFrame(rows, columns=["score", "evidence"])

    out = found.select("doc_id", vote("terms").alias("v"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "v.score", (F.col("v.score") >= THRESHOLD).cast("int").alias("predicted"), "v.evidence")


_indexes: dict[str, BlockMaxIndex] = {}


def toxic_index(model) -> BlockMaxIndex:
    """Built once a worker for each model, which its first value names."""
    key, idf, sample, _, _ = model.value
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = BlockMaxIndex([s[2] for s in sample], idf)
    return _indexes[key]


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with all their columns. The rate alone, without an example near, drops nothing."""
    return without(docs, score(docs, labels).where("predicted = 1 and size(evidence) > 0").select("doc_id"))
