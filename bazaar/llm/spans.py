"""Substring dedup by sliding sentence spans.

A sentence ends at a line break, or at . ! ? followed by white space; every sentence is cut further after the
word whose hash is smallest (of equal ones the last) in any ``WINDOW`` words in a row that hold no sentence's end.  So a part has
``WINDOW`` words at most, and inside a passage the cuts are the same wherever it stands, but for its first and last ``WINDOW`` - 1
words.  From each part the shortest run over it and the next ones that holds ``SENTENCES`` parts and ``WORDS`` words is a
span, and so is the shortest such run that ends with it; a run that the text's end cuts short is none.  Hence a passage
of more than 50 words has a span in every copy, whatever stands around it.  White space
inside a span counts as one blank, case and punctuation count as they are.

Spans are hashed (128 bits) and grouped globally with pre-aggregation, so that one which a third of all
texts hold is one row per task; before that, hashes of 64 bits that occur once are counted out, and a bit field of fixed
size lets only the others out of the second scan.  Of the places of a repeated span the first (smallest
doc_id, then position in the text) stays; sentences that any other place covers are removed, together with
the white space after them.  Everything else of a text stays as it is.

Null and empty texts, and texts without a whole span, stay as they are.  Rows are told apart by doc_id and text:
rows that repeat both are one document and are treated alike; a null doc_id comes after all
others.  Input columns that have the name of an output column are replaced by it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import fresh, in_batches, stored

SENTENCES = 2
WORDS = 16
WINDOW = 9
#: Words that no part exceeds.
LONG = 30
#: Bits of the field that marks repeated hashes; it is this large whatever the input's size.
FIELD_BITS = 26
#: Bits of the field that marks rows with something to remove, at most.
TOUCHED_BITS = 26

_TOKEN = re.compile(r"\S+\s*")
_ENDS = np.isin(np.arange(256), list(b".!?"))


def _cut(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text joined by blanks, where each of them starts (and one more would), and the number of words up to each
    cut, from 0 on."""
    from zlib import crc32

    words, lines = [], []
    for line in text.split("\n"):
        words += line.split()
        lines.append(len(words))
    n = len(words)
    words = list(map(str.encode, words))
    joined, starts = b" ".join(words), np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)]
    final = _ENDS[np.frombuffer(joined, np.uint8)[starts[1:] - 2]]
    final[np.array([x - 1 for x in lines if x], np.int64)] = True
    # The hash, then the place: the last of equal ones is the smallest.  A sentence's last word comes before all others.
    key = np.fromiter(map(crc32, words), np.int64, n) + 1
    key[final] = 0
    low = (key << 30) | (n - np.arange(n))
    cut, width = final, 1
    while width < WINDOW and len(low):
        step = min(width, WINDOW - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    cut[n - (low & ((1 << 30) - 1))] = True
    return joined, starts, np.r_[0, np.flatnonzero(cut) + 1]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each part; the white space after a part belongs to it."""
    tokens, (_, _, at) = list(_TOKEN.finditer(text)), _cut(text)
    return [(tokens[a].start(), tokens[b - 1].end(), [t.group().rstrip() for t in tokens[a:b]])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _runs(text: str | None, at_least: int, least: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """First part, last part and digest (16 bytes each) of each span."""
    from xxhash import xxh3_128_digest

    joined, starts, at = _cut(text or "")
    part = np.arange(len(at) - 1)
    last = np.maximum(np.searchsorted(at, at[:-1] + least) - 1, part + at_least - 1)
    first = np.minimum(np.searchsorted(at, at[1:] - least, "right") - 1, part - at_least + 1)
    whole = last < len(part)
    back = first >= 0
    back[back] = last[first[back]] != part[back]  # the others are there already
    first, last = np.r_[part[whole], first[back]], np.r_[last[whole], part[back]]
    joined = memoryview(joined)
    digests = b"".join([xxh3_128_digest(joined[a:b]) for a, b in zip(starts[at[first]].tolist(), (starts[at[last + 1]] - 1).tolist())])
    return first, last, digests


def spans(text: str | None, at_least: int = SENTENCES, words: int = WORDS) -> list[tuple[int, int, bytes]]:
    """(first part, last part, digest) of each span."""
    first, last, digests = _runs(text, at_least, words)
    return [(a, b, digests[16 * i:16 * i + 16]) for i, (a, b) in enumerate(zip(first.tolist(), last.tolist()))]


def _text_hash(column: str = "text"):
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def _hashes(documents: DataFrame) -> DataFrame:
    """(h1) of every span of every text."""
    def each(batches):
        for batch in batches:
            digests = b"".join(_runs(x, SENTENCES, WORDS)[2] for x in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(digests, ">i8")[::2].astype(np.int64))], names=["h1"])

    return in_batches(documents.select("text"), each, "h1 long")


def _marks(hashes: DataFrame) -> np.ndarray:
    """The bit field, in words of 64 bits, of the hashes that occur more than once."""
    bit = F.shiftrightunsigned("h1", 64 - FIELD_BITS)
    words = (hashes.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select(bit.alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")))
    found, field = words.toArrow(), np.zeros(1 << FIELD_BITS - 6, np.int64)  # not more rows than the field has words
    field[found.column("at").to_numpy()] = found.column("set").to_numpy()
    return field


def _all_spans(documents: DataFrame, field: np.ndarray) -> DataFrame:
    """(doc_id, _text_hash, h1, h2, first, last) of every span of every text that ``field`` marks."""
    rows = documents.select("doc_id", _text_hash().alias("_text_hash"), "text")
    sent = documents.sparkSession.sparkContext.broadcast(field.tobytes())

    def each(batches):
        marks = np.frombuffer(sent.value, np.int64)
        for batch in batches:
            found = [_runs(x, SENTENCES, WORDS) for x in batch.column(2).to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            h = np.frombuffer(b"".join(x[2] for x in found), ">i8").astype(np.int64).reshape(-1, 2)
            bit = (h[:, 0].view(np.uint64) >> np.uint64(64 - FIELD_BITS)).astype(np.int64) if len(h) else np.empty(0, np.int64)
            marked = np.flatnonzero(marks[bit >> 6] >> (bit & 63) & 1)
            first, last = (np.concatenate([x[i] for x in found])[marked].astype(np.int32) if found else np.empty(0, np.int32) for i in (0, 1))
            of = pa.array(of[marked])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(of), batch.column(1).take(of), pa.array(h[marked, 0]), pa.array(h[marked, 1]),
                pa.array(first), pa.array(last)], names=["doc_id", "_text_hash", "h1", "h2", "first", "last"])

    kind = dict(documents.dtypes)["doc_id"]
    return in_batches(rows, each, f"doc_id {kind}, _text_hash long, h1 long, h2 long, first int, last int")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """The places to remove: (doc_id, _text_hash, first, last, first_doc_id), sentences from first to last."""
    every = stored(_all_spans(documents, _marks(_hashes(documents))), "marked-spans")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"),
                     F.col("first").alias("first"), F.col("last").alias("last"), F.col("_text_hash").alias("_text_hash"))
    repeated = stored(every.groupBy("h1", "h2").agg(F.min(place).alias("kept"), F.count("*").alias("n"))
                      .where("n > 1").drop("n"), "repeated-spans")
    again = every.join(repeated, ["h1", "h2"]).where(place != F.col("kept"))
    return again.select("doc_id", "_text_hash", "first", "last", F.col("kept.doc_id").alias("first_doc_id"))


def _told_apart(rows: DataFrame, own: str, places: DataFrame) -> tuple[DataFrame, F.Column]:
    """``rows`` with what it takes to tell, without moving a text, which of them no place is in (a few of these count as hit).

    A bit field over doc_id and text hash of the places, 2 ** ``TOUCHED_BITS`` bits at most, is joined as words of 64 bits; that
    many bits are 2 ** 20 rows of two numbers, which is the proven bound of the broadcast.
    """
    bits = min(TOUCHED_BITS, max(12, (16 * places.count()).bit_length()))
    bit, at, field = (fresh(rows, c) for c in ("_bit", "_at", "_field"))
    key = lambda text_hash: F.shiftrightunsigned(F.xxhash64("doc_id", text_hash), 64 - bits)
    words = (places.select(key("_text_hash").alias(bit)).groupBy(F.shiftright(bit, 6).alias(at))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({bit} & 63 as int))")).alias(field)))
    rows = rows.withColumn(bit, key(own)).withColumn(at, F.shiftright(bit, 6)).join(F.broadcast(words), at, "left")
    return rows, F.coalesce(F.expr(f"shiftright({field}, cast({bit} & 63 as int)) & 1") == 1, F.lit(False))


RESULTS = ("removed", "removed_chars", "first_doc_ids")


def without_repeats(documents: DataFrame, results: tuple[str, str, str] = RESULTS) -> DataFrame:
    """``documents`` with cleaned ``text`` and three columns more (their names: ``results``): the removed
    passages, their number of characters, and the documents where they stay; of untouched rows these are empty."""
    documents = documents.drop(*results)
    some_id, of, own, ranges, firsts = (fresh(documents, c) for c in ("_id", "_of", "_text_hash", "_ranges", "_firsts"))
    places = stored(repeated_spans(documents).groupBy("doc_id", "_text_hash").agg(
        F.collect_set(F.struct("first", "last")).alias("ranges"), F.collect_set("first_doc_id").alias("firsts")), "removals")
    rows = documents.withColumn(own, _text_hash())
    rows, hit = _told_apart(rows, own, places)
    places = places.select(F.col("doc_id").alias(some_id), F.col("_text_hash").alias(of), F.col("ranges").alias(ranges),
                           F.col("firsts").alias(firsts))
    untouched = rows.where(~hit).select(*(F.col(f"`{c}`") for c in documents.columns))
    rows = rows.where(hit).join(places, F.col("doc_id").eqNullSafe(F.col(some_id)) & (F.col(own) == F.col(of)), "left")
    keep = documents.schema.fields
    at = [f.name for f in keep].index("text")
    kind = dict(documents.dtypes)["doc_id"]

    def each(batches):
        for batch in batches:
            texts, removed = batch.column(at).to_pylist(), []
            for i, taken in enumerate(batch.column(len(keep)).to_pylist()):
                passages = []
                if taken:
                    parts = sentences(texts[i])
                    gone = sorted({n for r in taken for n in range(r["first"], r["last"] + 1)})
                    blocks = []
                    for n in gone:
                        if blocks and blocks[-1][1] == n - 1:
                            blocks[-1][1] = n
                        else:
                            blocks.append([n, n])
                    kept, at_char = [], 0
                    for a, b in blocks:
                        kept.append(texts[i][at_char:parts[a][0]])
                        passages.append(texts[i][parts[a][0]:parts[b][1]])
                        at_char = parts[b][1]
                    texts[i] = "".join([*kept, texts[i][at_char:]])
                removed.append(passages)
            columns = list(batch.columns[:len(keep)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(removed, pa.list_(pa.string())),
                 pa.array([sum(map(len, x)) for x in removed], pa.int64()), batch.column(len(keep) + 1)],
                names=[*batch.schema.names[:len(keep)], *results])

    rows = rows.select(*(F.col(f"`{f.name}`") for f in keep), ranges,
                       F.coalesce(firsts, F.array().cast(f"array<{kind}>")).alias(firsts))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{results[0]}` array<string>",
                        f"`{results[1]}` long", f"`{results[2]}` array<{kind}>"])
    none = (F.array().cast("array<string>"), F.lit(0).cast("long"), F.array().cast(f"array<{kind}>"))
    return in_batches(rows, each, schema).unionByName(untouched.select("*", *(x.alias(c) for x, c in zip(none, results))))


def repeats(documents: DataFrame) -> DataFrame:
    """One row per document that lost a passage: doc_id, cleaned text, passages, and the documents where they stay."""
    return without_repeats(documents.select("doc_id", "text")).where("removed_chars > 0")


def cleaned(documents: DataFrame) -> DataFrame:
    """``documents`` with cleaned texts (and ``n_chars`` counted again, where there is one); a text of which nothing is left goes."""
    names = tuple(fresh(documents, c) for c in ("_removed", "_removed_chars", "_first_doc_ids"))
    done = without_repeats(documents, names)
    done = done.where((F.col(names[1]) == 0) | (F.trim("text") != ""))
    columns = [F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in documents.columns]
    return done.select(*columns)
