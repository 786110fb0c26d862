"""Fill-in-middle: units marked by an escaped delimiter, parts taken by rank, assembled with sentinels. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARK, ESCAPE = "\u0001", "\u0002"  # neither is white space, and escaped both stay in their unit
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escaped(text: Column) -> Column:
    """The text without MARK: ESCAPE 0 stands for ESCAPE, ESCAPE 1 for MARK."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(MARK), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    """What escaped() was given, without the marks put in since."""
    bare = F.replace(text, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the document: the first groups of the SHA-256 of "seed:doc_id"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n (units), form, prefix, middle, suffix (null if plain), output.

    `rate` of 100 documents are rearranged, `spm` of 100 of these suffix first. Units are runs of white space with the word
    after it; regexp_replace puts MARK behind each, so their count is the count of marks, and substring_index takes parts by
    rank, over the whole text whatever its length. Both cuts are drawn from the document's id alone, so the result does not
    depend on how rows are spread, and no row is shuffled.

    Null text counts as empty; empty texts and texts that hold a sentinel stay plain. A null doc_id draws as an empty one;
    repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
    """
    marked = F.regexp_replace(escaped(F.col("body")), f"({UNIT})", "$1" + MARK)
    rows = id_and_text(docs).select("doc_id", "body", marked.alias("marked"), F.array(*draws(F.col("doc_id"), seed)).alias("h"))
    n = F.length("marked") - F.length(F.replace(F.col("marked"), F.lit(MARK), F.lit("")))
    rows = rows.select("doc_id", "body", "marked", "h", n.cast("long").alias("n"))
    cuts = F.array_sort(F.transform(F.slice("h", 1, 2), lambda h: h % (F.col("n") + 1)))
    plain = (F.col("body") == "") | F.contains("body", F.lit(PREFIX)) | F.contains("body", F.lit(SUFFIX)) | F.contains("body", F.lit(MIDDLE)) | (F.col("h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "body", "marked", "n", cuts[0].cast("int").alias("a"), cuts[1].cast("int").alias("b"), form.alias("form"))
    part = lambda c: F.when(F.col("form") != "plain", unescaped(c))
    index = lambda s, k: F.call_function("substring_index", s, F.lit(MARK), k)  # noqa: E731  the rank is a column
    head = index(F.col("marked"), F.col("b"))  # b units
    rows = rows.select("doc_id", "body", "n", "form", part(index(F.col("marked"), F.col("a"))).alias("prefix"), part(index(head, F.col("a") - F.col("b"))).alias("middle"), part(index(F.col("marked"), F.col("b") - F.col("n").cast("int") - 1)).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_ = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("body"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged. Sentinels never overlap themselves, so the first of each is the one put in."""
    cut = lambda s, mark, k: F.substring_index(s, mark, k)
    after = lambda s, mark: F.substr(s, F.length(cut(s, mark, 1)) + len(mark) + 1)
    middle = after(output, MIDDLE)
    psm = F.concat(cut(after(output, PREFIX), SUFFIX, 1), middle, cut(after(output, SUFFIX), MIDDLE, 1))
    spm = F.concat(cut(after(output, PREFIX), MIDDLE, 1), middle, cut(after(output, SUFFIX), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and the SHA-256 of the text rebuilt from the output."""
    rows = transform(docs, seed)
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    return rows.select("doc_id", "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
