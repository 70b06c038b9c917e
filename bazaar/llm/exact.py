"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole.

Texts are equal when they are identical after every blank and control character from 9 to 13 is deleted.

1. The first scan reduces each text to its length (bytes that are left) and a hash of length and first ``PREFIX`` bytes;
   both are counted with pre-aggregation.  Lengths that stand once are done; of the others, beginnings that stand once
   under their length are done too.  The rest survives.
2. A bit field of the surviving hashes, whose size is bounded (``MAX_FIELD_BITS``), goes to all tasks.  The second scan takes a
   SHA-256 of the whole of those texts only that the field marks; a text that it marks by chance is hashed in vain, no more.
   What it writes are narrow rows without texts.
3. Rows are grouped by that digest.  The row with the most code points in its original text stays, of those the one with the
   smallest doc_id (null comes last), and of rows that share all this the first written one.

A group of copies is one row per task before it is shuffled; its rows meet their group again in a join that Spark
splits where it is skewed.  Null texts count as empty, and all empty ones are equal.  Columns other than doc_id and text
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import bit_field, fresh, in_batches, stored

PREFIX = 256
#: Bits of the field of surviving hashes, at most: 64 MB.
MAX_FIELD_BITS = 29

_SPACE = b" \t\n\x0b\x0c\r"


def _beginnings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Length of each text, and the hash of its length and first bytes."""
    from xxhash import xxh3_64_intdigest

    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    hashes = np.fromiter((xxh3_64_intdigest(t[:PREFIX], len(t)) for t in texts), np.uint64, len(texts))
    return sizes, hashes.view(np.int64)


def _stripped(column: pa.Array) -> list[bytes]:
    return [t.translate(None, _SPACE) if t else b"" for t in column.to_pylist()]


def surviving(documents: DataFrame) -> DataFrame:
    """(size, beginning, n) of the lengths and beginnings that more than one text has."""
    def each(batches):
        for batch in batches:
            sizes, hashes = _beginnings(_stripped(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(hashes)], names=["size", "beginning"])

    found = in_batches(documents.select(F.col("text").cast("binary").alias("text")), each, "size long, beginning long")
    counts = stored(found.groupBy("size", "beginning").agg(F.count("*").alias("n")), "beginnings")
    lengths = counts.groupBy("size").agg(F.sum("n").alias("of_size")).where("of_size > 1")
    return counts.join(lengths.select("size"), "size", "left_semi").where("n > 1")


def _hashed(documents: DataFrame, field: bytes, every: bool) -> DataFrame:
    """(row, doc_id, own, n_chars, digest, text_sha256): the digest only of texts that the field marks, the last of all if ``every``."""
    rows = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"),
                            F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"),
                            F.col("text").cast("binary").alias("text"))
    sent = documents.sparkSession.sparkContext.broadcast(field)

    def each(batches):
        marks = np.frombuffer(sent.value, np.int64)
        bits = np.uint64(64 - 6 - (len(marks).bit_length() - 1))
        for batch in batches:
            texts = _stripped(batch.column(3))
            bit = (_beginnings(texts)[1].view(np.uint64) >> bits).astype(np.int64)
            marked = (marks[bit >> 6] >> (bit & 63) & 1).astype(bool).tolist()
            digests = [hashlib.sha256(t) if every or m else None for t, m in zip(texts, marked)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([d.digest() if m else None for d, m in zip(digests, marked)], pa.binary()),
                 pa.array([d and d.hexdigest() for d in digests], pa.string())],
                names=["doc_id", "own", "n_chars", "digest", "text_sha256"])

    kind = dict(documents.dtypes)["doc_id"]
    found = in_batches(rows, each, f"doc_id {kind}, own long, n_chars long, digest binary, text_sha256 string")
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "*"), "exact-rows")


def exact_groups(documents: DataFrame, every_digest: bool = False) -> DataFrame:
    """A row per row of ``documents`` (doc_id, text): doc_id, keep_id, group_size, kept, own, text_sha256.

    ``own`` is XXH64 of the original text.  ``text_sha256``, of the text without white space, is null for
    texts that were told apart before their whole was hashed, unless ``every_digest`` asks for it.
    """
    field = bit_field(surviving(documents).select(F.col("beginning").alias("hash")), MAX_FIELD_BITS)
    rows = _hashed(documents, field.tobytes(), every_digest)
    order = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.min(order).alias("keep"), F.count("*").alias("group_size"))
    # Written, so that both sides of the join are dealt out for it and a hot digest can be split.
    groups = stored(groups.where("group_size > 1"), "exact-groups")
    hashed = rows.where("digest is not null").join(groups, "digest", "left")
    group_size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep_id = F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    kept = F.coalesce(F.col("row") == F.col("keep.row"), F.lit(True))
    alone = rows.where("digest is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "own", "text_sha256")
    return hashed.select("doc_id", keep_id.alias("keep_id"), group_size.alias("group_size"), kept.alias("kept"), "own", "text_sha256").unionByName(alone)


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, whole."""
    some_id, of, own = (fresh(documents, c) for c in ("_id", "_of", "_own"))
    stay = stored(exact_groups(documents).where("kept").groupBy("doc_id", "own").agg(F.count("*").alias("n")), "exact-stay")
    keys = stay.select(F.col("doc_id").alias(some_id), F.col("own").alias(of))
    rows = documents.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(keys, F.col("doc_id").eqNullSafe(F.col(some_id)) & (F.col(own) == F.col(of)), "left_semi")
    # Rows that repeat both doc_id and text cannot be told apart, so that one of them has to be taken.
    twice = stored(rows.groupBy("doc_id", own).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "exact-twice") \
        .select(F.col("doc_id").alias(some_id), F.col(own).alias(of))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    if twice.isEmpty():
        return rows.select(*columns)
    same = F.col("doc_id").eqNullSafe(F.col(some_id)) & (F.col(own) == F.col(of))
    return rows.join(twice, same, "left_anti").select(*columns).unionByName(
        rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", own]).select(*columns))


#: DuckDB SQL of the query's rows (doc_ids are unique there).
ORACLE_SQL = r"""
WITH bare AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents),
ranked AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""
