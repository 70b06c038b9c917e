"""Alignment of the tokens of two tokenizers, by merge-path partitioning of their token ends.

Tokenizer A reads a blank and the text, B the text, to which it adds the blank itself; both then tile the same bytes.  Where a
token of A and a token of B end at the same byte, the tokens are cut into groups; every A token of a group is linked with every
B token of it.

* Words: both tokenizers are run on the distinct words of a task (a word starts at a single blank before a character that is no
  white space; no token of either crosses such a place, since no piece of B has a blank after another character) and ids
  are joined back by position.  The table of words is emptied when it holds ``TASK_CHARS`` characters.
* Merging: the ends of all texts of a batch form two sorted lists.  Binary searches on equidistant diagonals of their merge grid
  cut the merge into independent pieces of ``PIECE`` ends each, however long single texts are.  A piece emits the overlaps
  of A and B tokens in order and marks the common ends.  A group that lies across pieces has an open rest in each; numbering
  the common ends through all pieces joins the rests.
* Counts: each text's distinct id pairs with their numbers of links are written once.  Spark counts the texts of each pair,
  and the highest count of each A id.  The ``TABLE_PAIRS`` most frequent pairs are broadcast, a bounded table that holds all hot
  keys; what a text has of other pairs is joined by shuffle.

A text has no tokens if it is null or empty, or if the joined bytes of A or of B are not those of a blank and the text.  Special
tokens' strings are plain text.  Rows are handled one by one: rows that repeat count as texts of their own.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.bpe import pieces as bpe_pieces
from bazaar.llm.common import in_batches, stored

PIECE = 1 << 16
TABLE_PAIRS = 1_000_000
TASK_CHARS = 2_000_000
JOINED_WORDS = 2000
#: Characters whose tokens are worked on at a time (or one text), and links that are laid out at a time.
BATCH_CHARS = 1_000_000
BATCH_LINKS = 1 << 21

_START = re.compile(r"(?<! )(?= [^\s])")
_NOT_START = re.compile(r" (?:\s|$)")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=2)
def _pieces_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a sentence-piece model."""
    model = _pieces_model(path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


def split_words(text: str) -> list[str]:
    """The words of ``text``, which starts with a blank."""
    if "\0" in text or _NOT_START.search(text):
        return [w for w in _START.split(text) if w]
    return text.replace(" ", "\0 ").split("\0")[1:]


def _regular(word: str) -> bool:
    """Whether such words, written one after the other, are the words of that text."""
    return bool(word[1:2].strip()) and word[-1] != " "


class Words:
    """Ids of words by both tokenizers, as 32-bit integers one after the other."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _tokenizer(path_a), _pieces_model(path_b)
        self.bytes_a, self.bytes_b = bpe_pieces(path_a), piece_bytes(path_b)
        self.pieces = tuple(pa.array(x, pa.large_binary()) for x in (self.bytes_a, self.bytes_b))
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.bad: set[str] = set()  # words that do not get their own bytes
        self.chars = 0

    def _ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """By A and by B, of texts that start with a blank."""
        return ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)],
                self.b.encode([t[1:] for t in texts], num_threads=1))

    def _learn_one_by_one(self, words: list[str]) -> None:
        for w, a, b in zip(words, *self._ids(words)):
            whole = w.encode()
            same = whole == b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b))
            for known, ids in zip(self.known, (a, b)):
                known[w] = np.array(ids, np.int32).tobytes()
            if not same:
                self.bad.add(w)

    def _learn(self, words: list[str]) -> None:
        """Regular words are encoded as one text, whose ids are cut at the words' ends."""
        joined = "".join(words)
        whole, sizes = joined.encode(), np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        ends, cuts = np.cumsum(sizes), []
        for ids, piece in zip(self._ids([joined]), self.pieces):
            ids = np.array(ids[0], np.int32)
            spelt = piece.take(pa.array(ids))
            up_to = np.frombuffer(spelt.buffers()[1], np.int64)[1:]
            cut = np.searchsorted(up_to, ends)
            if spelt.buffers()[2].slice(0, up_to[-1]).to_pybytes() != whole or (up_to[np.minimum(cut, len(ids) - 1)] != ends).any():
                return self._learn_one_by_one(words)
            cuts.append((ids.tobytes(), (4 * (cut + 1)).tolist()))
        for known, (ids, cut) in zip(self.known, cuts):
            known.update(zip(words, [ids[x:y] for x, y in zip([0, *cut], cut)]))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """The ids of each text by A and by B; None if it has no tokens."""
        words = [split_words(" " + t) if t else [] for t in texts]
        if self.chars > TASK_CHARS:
            self.known, self.bad, self.chars = ({}, {}), set(), 0
        new = list(set().union(*words).difference(self.known[0]))
        self.chars += sum(map(len, new))
        regular = [w for w in new if _regular(w)]
        for i in range(0, len(regular), JOINED_WORDS):
            self._learn(regular[i:i + JOINED_WORDS])
        if len(regular) < len(new):
            self._learn_one_by_one([w for w in new if not _regular(w)])
        of_a, of_b = (known.__getitem__ for known in self.known)
        return [(b"".join(map(of_a, t)), b"".join(map(of_b, t))) if t and self.bad.isdisjoint(t) else None for t in words]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` come before each cut of their merge, ``piece`` ends apart; equal ends are not cut apart."""
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        take = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(d - 1 - middle, 0, len(b) - 1)])
        low, high = np.where(take, middle + 1, low), np.where(open_ & ~take, middle, high)
    of_a, of_b = low, d - low
    inside = (of_a > 0) & (of_b < len(b))
    torn = np.zeros(len(d), bool)
    torn[inside] = a[of_a[inside] - 1] == b[of_b[inside]]
    return of_a, of_b + torn


def overlaps(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps (A token, B token) that end at ``a[i0:i1]`` or ``b[j0:j1]``, and whether both tokens end there."""
    ends = np.concatenate([a[i0:i1], b[j0:j1]])
    ends.sort(kind="stable")  # two sorted runs: one merge
    if len(ends):
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]]
    i, j = np.searchsorted(a[i0:i1], ends), np.searchsorted(b[j0:j1], ends)
    common = np.zeros(len(ends), bool)
    inner = (i < i1 - i0) & (j < j1 - j0)
    common[inner] = a[i0:i1][i[inner]] == b[j0:j1][j[inner]]
    return i + i0, j + j0, common


def groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B lie up to the end of each group."""
    of_a, of_b = diagonals(a, b, piece)
    ends_a, ends_b = [], []
    for i0, i1, j0, j1 in zip(of_a[:-1].tolist(), of_a[1:].tolist(), of_b[:-1].tolist(), of_b[1:].tolist()):
        i, j, common = overlaps(a, b, i0, i1, j0, j1)
        ends_a.append(i[common] + 1)  # what follows the last one is the next piece's first group's beginning
        ends_b.append(j[common] + 1)
    none = [np.empty(0, np.int64)]
    return np.concatenate(ends_a or none), np.concatenate(ends_b or none)


class Aligned(NamedTuple):
    """Texts with tokens, one after the other: ids, and for texts and groups the numbers of tokens up to their ends."""
    a: np.ndarray
    b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    #: Number of groups up to the end of each text.
    text_groups: np.ndarray


def align(encoded: list[tuple[bytes, bytes]], lengths_a: np.ndarray, lengths_b: np.ndarray, piece: int = PIECE) -> Aligned:
    a, b = (np.frombuffer(b"".join([x[i] for x in encoded]), np.int32) for i in (0, 1))
    text_a, text_b = (np.cumsum([len(x[i]) // 4 for x in encoded], dtype=np.int64) for i in (0, 1))
    group_a, group_b = groups(np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b]), piece)
    return Aligned(a, b, text_a, text_b, group_a, group_b, np.searchsorted(group_a, text_a, "right"))


def pairs_of(x: Aligned, vocabulary_b: int, most: int = BATCH_LINKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links) of each text's distinct linked id pairs, by text and pair; a pair is a * ``vocabulary_b`` + b."""
    begin_a, begin_b = np.r_[0, x.group_a[:-1]], np.r_[0, x.group_b[:-1]]
    n_a, n_b = x.group_a - begin_a, x.group_b - begin_b
    text = np.searchsorted(x.text_groups, np.arange(len(n_a)), "right")
    until = np.cumsum(n_a * n_b)
    keys, links = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(key, n=None):
        found, of = np.unique(key, return_inverse=True)
        keys.append(found)
        links.append(np.bincount(of.ravel(), n, len(found)).astype(np.int64))

    g = 0
    while g < len(n_a):
        last = max(g + 1, int(np.searchsorted(until, (until[g - 1] if g else 0) + most, "right")))
        if n_a[g] * n_b[g] > most:  # one long group: its distinct ids, a slice of A's at a time
            of_a, in_a = np.unique(x.a[begin_a[g]:x.group_a[g]], return_counts=True)
            of_b, in_b = np.unique(x.b[begin_b[g]:x.group_b[g]], return_counts=True)
            step = max(1, most // len(of_b))
            for k in range(0, len(of_a), step):
                code = of_a[k:k + step, None].astype(np.int64) * vocabulary_b + of_b[None, :]
                add(((int(text[g]) << 32) + code).ravel(), (in_a[k:k + step, None] * in_b[None, :]).ravel())
            last = g + 1
        else:
            na, nb, size = n_a[g:last], n_b[g:last], n_a[g:last] * n_b[g:last]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            width = np.repeat(nb, size)
            of_a, of_b = x.a[np.repeat(begin_a[g:last], size) + at // width], x.b[np.repeat(begin_b[g:last], size) + at % width]
            add((np.repeat(text[g:last], size) << 32) + of_a.astype(np.int64) * vocabulary_b + of_b)
        g = last
    key, n = np.concatenate(keys), np.concatenate(links)
    if len(keys) > 2:
        key, of = np.unique(key, return_inverse=True)
        n = np.bincount(of.ravel(), n, len(key)).astype(np.int64)
    return key >> 32, key & 0xFFFFFFFF, n


@lru_cache(maxsize=2)
def _spelt(vocabulary_a: int, vocabulary_b: int) -> pa.Array:
    """Decimal ids with what follows them: inside A's or B's part of a group, or at its end."""
    a, b = range(vocabulary_a), range(vocabulary_b)
    return pa.array([f"{i}{c}".encode() for ids, c in ((a, ","), (a, "|"), (b, ","), (b, ";")) for i in ids], pa.large_binary())


def spelt_groups(x: Aligned, vocabulary_a: int, vocabulary_b: int) -> list[memoryview]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    n_a, n_b = np.diff(x.group_a, prepend=0), np.diff(x.group_b, prepend=0)
    row = np.empty(len(x.a) + len(x.b), np.int64)
    last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    last_a[x.group_a - 1] = vocabulary_a
    last_b[x.group_b - 1] = vocabulary_b
    row[np.arange(len(x.a)) + np.repeat(x.group_b - n_b, n_a)] = x.a + last_a
    row[np.arange(len(x.b)) + np.repeat(x.group_a, n_b)] = x.b + last_b + 2 * vocabulary_a
    spelt = _spelt(vocabulary_a, vocabulary_b).take(pa.array(row))
    starts = np.frombuffer(spelt.buffers()[1], np.int64)
    data = memoryview(spelt.buffers()[2])
    ends = starts[x.text_a + x.text_b].tolist()
    return [data[a:b - 1] for a, b in zip([0, *ends], ends)]


def _portions(batch: pa.RecordBatch, chars: int = BATCH_CHARS):
    """Slices of a batch (doc_id, text) of ``chars`` characters, or of one row, and their texts."""
    texts = batch.column(1).to_pylist()
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total > chars and i > begin:
            yield batch.slice(begin, i - begin), texts[begin:i]
            begin, total = i, len(t or "")
    if begin < len(texts):
        yield batch.slice(begin), texts[begin:]


def _kind(documents: DataFrame) -> str:
    return dict(documents.dtypes)["doc_id"]


def _tables(path_a: str, path_b: str) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(path_a, path_b)
    return words, *(np.array(list(map(len, t)), np.int64) for t in (words.bytes_a, words.bytes_b))


def _each_list(values: np.ndarray, ends: np.ndarray, has: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list per row: that of the text for rows that have tokens, else an empty one."""
    sizes = np.zeros(len(has), np.int64)
    sizes[has] = np.diff(ends, prepend=0)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values, kind))


def alignments(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends): the tokens of each text of ``documents`` (doc_id, text), and how many of A and of B
    lie up to the end of each of its groups."""
    def each(batches):
        words, lengths_a, lengths_b = _tables(path_a, path_b)
        for batch in batches:
            for rows, texts in _portions(batch):
                encoded = words.encode(texts)
                has = np.array([e is not None for e in encoded], bool)
                x = align([e for e in encoded if e is not None], lengths_a, lengths_b)
                text = np.searchsorted(x.text_groups, np.arange(len(x.group_a)), "right")
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), _each_list(x.a, x.text_a, has, pa.int32()), _each_list(x.b, x.text_b, has, pa.int32()),
                    _each_list(x.group_a - np.r_[0, x.text_a][text], x.text_groups, has, pa.int32()),
                    _each_list(x.group_b - np.r_[0, x.text_b][text], x.text_groups, has, pa.int32())],
                    names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    lists = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_ends", "b_ends"))
    return in_batches(documents.select("doc_id", "text"), each, f"doc_id {_kind(documents)}, {lists}")


def linked(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links), written: each text's distinct linked id pairs, coded as in
    ``pairs_of``, and their numbers of links."""
    def each(batches):
        words, lengths_a, lengths_b = _tables(path_a, path_b)
        for batch in batches:
            for rows, texts in _portions(batch):
                encoded = words.encode(texts)
                has = np.array([e is not None for e in encoded], bool)
                x = align([e for e in encoded if e is not None], lengths_a, lengths_b)
                text, pair, links = pairs_of(x, len(lengths_b))
                texts_with = int(has.sum())
                numbers = [np.diff(x.text_a, prepend=0), np.diff(x.text_b, prepend=0), np.diff(x.text_groups, prepend=0),
                           np.bincount(text, links, texts_with)]
                columns = [np.zeros(len(has), np.int64) for _ in numbers]
                for column, number in zip(columns, numbers):
                    column[has] = number
                shas = np.full(len(has), "", object)
                shas[has] = [hashlib.sha256(s).hexdigest() for s in spelt_groups(x, len(lengths_a), len(lengths_b))] if texts_with else []
                ends = np.searchsorted(text, np.arange(texts_with), "right")
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *map(pa.array, columns), pa.array(shas, pa.string()),
                     _each_list(pair, ends, has, pa.int64()), _each_list(links, ends, has, pa.int32())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])

    schema = (f"doc_id {_kind(documents)}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs array<long>, links array<int>")
    found = in_batches(documents.select("doc_id", "text"), each, schema)
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "*"), "linked")


def pair_counts(texts: DataFrame, vocabulary_b: int) -> DataFrame:
    """(pair, n, best) of ``linked`` texts: the number of texts that hold a pair, and whether no pair of its A id has more; written."""
    counts = stored(texts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / vocabulary_b).cast("long")
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))  # a row per id of A's vocabulary
    return stored(counts.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")


def _frequent(counts: DataFrame, table_pairs: int) -> DataFrame:
    """The most frequent pairs, ``table_pairs`` at most; equal counts are all in or all out."""
    by_count = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    kinds = counts.groupBy("n").agg(F.count("*").alias("pairs")).orderBy(F.desc("n")).limit(table_pairs)
    least = (kinds.withColumn("so_far", F.sum("pairs").over(by_count)).where(F.col("so_far") <= table_pairs).agg(F.min("n")).first()[0])
    return counts.where(F.col("n") >= F.lit(least))


def link_counts(documents: DataFrame, path_a: str, path_b: str, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """A row per row of ``documents`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no other pair of its A
    id exceeds in texts), count_sum (of the texts of the pair of each link) and groups_sha256."""
    vocabulary_b = len(piece_bytes(path_b))
    texts = linked(documents, path_a, path_b)
    counts = pair_counts(texts, vocabulary_b)
    table = _frequent(counts, table_pairs).toArrow().sort_by("pair")
    sent = documents.sparkSession.sparkContext.broadcast(tuple(
        table.column(c).to_numpy().astype(kind).tobytes() for c, kind in (("pair", np.int64), ("n", np.int64), ("best", bool))))
    del table

    def each(batches):
        known, n, best = (np.frombuffer(x, kind) for x, kind in zip(sent.value, (np.int64, np.int64, bool)))
        for batch in batches:
            row, pairs, links = batch.column(0), batch.column(1), batch.column(2)
            ends = np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            pair, times = pairs.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)
            text = np.searchsorted(ends, np.arange(len(pair)), "right")
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            there = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = np.zeros((2, len(row) + 1), np.int64)
            if there.any():
                times_there, at_there = times[there], at[there]
                for out, value in zip(sums, (times_there * best[at_there], times_there * n[at_there])):
                    total = np.r_[0, np.cumsum(value)]
                    of = np.r_[0, np.cumsum(there)][np.r_[0, ends]]
                    out[:len(row)] = np.diff(total[of])
            rest = np.flatnonzero(~there)
            none = np.zeros(len(rest), np.int64)
            # A row per text with what the table knows, then a row per pair that it does not know.
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([row, row.take(pa.array(text[rest]))]), pa.array(np.r_[np.full(len(row), -1), pair[rest]]),
                pa.array(np.r_[np.zeros(len(row), np.int64), times[rest]]), *(pa.array(np.r_[s[:len(row)], none]) for s in sums)],
                names=["row", "pair", "links", "n_best", "count_sum"])

    looked_up = stored(in_batches(texts.select("row", "pairs", "links"), each,
                                  "row long, pair long, links long, n_best long, count_sum long"), "looked-up")
    rare = looked_up.where("pair >= 0").select("row", "pair", "links").join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("rare_best"), F.sum(F.col("links") * F.col("n")).alias("rare_sum"))
    found = looked_up.where("pair < 0").select("row", "n_best", "count_sum")
    rows = texts.drop("pairs", "links").join(found, "row").join(rare, "row", "left")
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
