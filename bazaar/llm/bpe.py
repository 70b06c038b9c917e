"""Byte-pair encoding and decoding through a table of distinct words.

A *word* is a piece of a text that starts at a space standing before a character that
is no white space.  No token of a byte-level BPE crosses such a place, and the
splitting rule never looks to the left, so the ids of a text are the ids of its words
in order of position.  Added tokens (``<|endoftext|>``) are words of their own, as in
the tokenizers library.

1. Spark counts the distinct words of all texts (pre-aggregated in each task).
2. Every word that is among the ``table_words`` most frequent is encoded once; that
   table, whose size ``table_words`` bounds, is broadcast and ids are joined back by
   position inside the scan of the documents.
3. Less frequent words are encoded once per task and kept there in a table that is
   emptied at ``task_words`` words.  A shuffled join for them would move each of their
   occurrences twice, and the texts once (see README).
4. Decoding looks each id up in the id-to-piece table, whose size is the vocabulary's,
   and joins the pieces by position.

Nulls count as empty texts; an empty text has no ids.  Repeated rows, extra columns and
very long texts need no special care: rows are handled one by one and kept whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.common import in_batches, stored

TABLE_WORDS = 200_000
TASK_WORDS = 100_000

_START = re.compile(r"(?= [^\s])")
_NOT_START = re.compile(r" (?:\s|$)")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def added_tokens(path: str) -> re.Pattern | None:
    with open(path, encoding="utf-8") as f:
        contents = [t["content"] for t in json.load(f).get("added_tokens", [])]
    return re.compile("(" + "|".join(map(re.escape, sorted(contents, key=len, reverse=True))) + ")") if contents else None


@lru_cache(maxsize=4)
def pieces(path: str) -> list[bytes]:
    """The bytes of each id: a byte-level vocabulary spells each byte as one printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    t = tokenizer(path)
    added = {i for i, a in t.get_added_tokens_decoder().items()}
    return [t.id_to_token(i).encode() if i in added else bytes(byte_of[c] for c in t.id_to_token(i))
            for i in range(t.get_vocab_size())]


def split_words(text: str, added: re.Pattern | None) -> list[str]:
    """The words of a text; joined, they are the text."""
    if added and added.search(text):
        return [w for part in added.split(text) if part
                for w in ([part] if added.fullmatch(part) else split_words(part, None))]
    if _NOT_START.search(text) or "\0" in text:
        return [w for w in _START.split(text) if w]
    words = text.replace(" ", "\0 ").split("\0")  # every space starts a word
    return words if words[0] else words[1:]


def count_words(texts: DataFrame, path: str) -> DataFrame:
    """(word, n) over all texts of the column ``text``."""
    def each(batches):
        added, counts = added_tokens(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(split_words(text or "", added))
            if len(counts) > TASK_WORDS:
                yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
                counts.clear()
        if counts:
            yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})

    return in_batches(texts.select("text"), each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encoded(words: list[str], path: str) -> list[bytes]:
    """The ids of each word, as 32-bit integers one after the other."""
    return [np.array(e.ids, np.int32).tobytes() for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]


def word_table(texts: DataFrame, path: str, table_words: int = TABLE_WORDS) -> DataFrame:
    """(word, ids as of ``encoded``) of the most frequent words, ``table_words`` at most; equal counts are all in or all out."""
    counts = stored(count_words(texts, path).where("n > 1"), "words")
    by_count = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    # One row per distinct count, not per word: the largest counts, as many as words may be had.
    kinds = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(table_words)
    least = (kinds.withColumn("so_far", F.sum("words").over(by_count)).where(F.col("so_far") <= table_words)
             .agg(F.min("n")).first()[0])

    def each(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"word": words, "ids": encoded(words, path)})

    frequent = counts.where(F.col("n") >= F.lit(least)).select("word")
    return in_batches(frequent, each, "word string, ids binary")


def _typed(df: DataFrame, name: str, kind: str) -> tuple[DataFrame, str]:
    """``df`` without a column ``name``, and its schema with that column at the end."""
    keep = [f for f in df.schema.fields if f.name != name]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{name}` {kind}"])
    return df.select(*(F.col(f"`{f.name}`") for f in keep)), schema


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def _encoder(df: DataFrame, path: str, table_words: int):
    """Adds ``ids`` to Arrow batches that have ``text``."""
    sc = df.sparkSession.sparkContext
    frequent = sc.broadcast({r["word"]: bytes(r["ids"]) for r in word_table(df, path, table_words).toLocalIterator()})

    def each(batches):
        added, known = added_tokens(path), dict(frequent.value)
        for batch in batches:
            texts = [split_words(x or "", added) for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            if len(known) > len(frequent.value) + TASK_WORDS:
                known = dict(frequent.value)
            new = list(set().union(*texts).difference(known))
            known.update(zip(new, encoded(new, path)))
            ids = [b"".join(map(known.__getitem__, words)) for words in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield _with_column(batch, "ids", pa.ListArray.from_arrays(pa.array(ends), flat))

    return each


def _decoder(path: str, column: str):
    """Adds the text of ``ids`` to Arrow batches."""
    def each(batches):
        piece = pa.array(pieces(path), pa.large_binary())
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            ends = np.r_[0, np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)))].astype(np.int64)
            joined = piece.take(lists.flatten())
            starts = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:] if len(joined) else np.zeros(1, np.int64)
            data = memoryview(joined.buffers()[2]) if len(joined) else memoryview(b"")
            texts = [str(data[starts[a]:starts[b]], "utf-8", "replace") for a, b in zip(ends, ends[1:])]
            yield _with_column(batch, column, pa.array(texts, pa.string()))

    return each


def encode_documents(df: DataFrame, path: str, table_words: int = TABLE_WORDS) -> DataFrame:
    """``df`` with ``ids`` (array of int): what the tokenizers library gives for the column ``text``."""
    rows, schema = _typed(df, "ids", "array<int>")
    return in_batches(rows, _encoder(df, path, table_words), schema)


def decode_documents(df: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """``df`` with the text of its ``ids``; bytes that are no UTF-8 become U+FFFD.  Null ids: empty text."""
    rows, schema = _typed(df, column, "string")
    return in_batches(rows, _decoder(path, column), schema)


def round_trip(df: DataFrame, path: str, table_words: int = TABLE_WORDS, column: str = "decoded") -> DataFrame:
    """``decode_documents(encode_documents(df))`` in one pass of the Python tasks."""
    rows, _ = _typed(df.drop(column), "ids", "array<int>")
    _, schema = _typed(df.drop(column), "ids", f"array<int>, `{column}` string")
    encode, decode = _encoder(df, path, table_words), _decoder(path, column)
    return in_batches(rows, lambda batches: decode(encode(batches)), schema)


def ids_sha256(ids) -> F.Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)
