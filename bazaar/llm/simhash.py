"""SimHash near-duplicates, compared through bit planes.

* Fingerprint: A-Z are lower-cased; words are maximal runs of bytes other than blank and
  the control characters 9 to 13; every run of ``shingle`` words (repeats included; a
  text with fewer words: all of them) is hashed with XXH64, seed 42.  Bit i of the
  fingerprint is set if it is set in over half of the hashes.  No words, or a null
  text: zero, which links like any other.
* Copies of a text have one fingerprint, and so do many others: only distinct
  fingerprints are compared, so a group of copies of any size costs one row.
* Candidates: the 64 bits are cut into ``radius + 2`` slices.  Two fingerprints within
  the radius agree on at least two slices, so they meet under the key of a slice pair.
* Comparison: the fingerprints under a key stand in vertical bit planes; one pass over the
  64 planes adds up the distances to all of them in carry-save bitwise counters, and is
  abandoned when every distance exceeds the radius.
* A key with many fingerprints is dealt into cells of ``CELL`` and compared cell by cell
  in tasks of their own.  A task returns each fingerprint's link to the smallest
  fingerprint it reaches there, never all pairs.
* Components of the links give the smallest doc_id reachable.

Null doc_ids get fingerprint and component like others but are never the smallest unless
all are null.  Repeated rows, and rows that share a doc_id, are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import fresh, in_batches, stored
from bazaar.llm.components import components

SHINGLE = 3
RADIUS = 2
#: Fingerprints compared with one another at a time; memory is of the order of CELL * CELL / 8 bytes.
CELL = 1024

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_PIECE = 1 << 16  # hashes whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(b" ".join(r), 42) for r in runs), np.uint64)
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PIECE):
        part = hashes[i:i + _PIECE]
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, shingle: int = SHINGLE, column: str = "simhash") -> DataFrame:
    """``df`` with the fingerprint of ``text`` as a (signed) long."""
    def one(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            prints = [fingerprint(x, shingle) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(prints, np.uint64).view(np.int64))],
                                             names=[*batch.schema.names, column])

    keep = [f for f in df.schema.fields if f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{column}` long"])
    return in_batches(df.select(*(F.col(f"`{f.name}`") for f in keep)), one, schema)


def planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of bits, one bit for each fingerprint, packed in 64-bit words."""
    lanes = -(-len(prints) // 64) * 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[:len(prints)] = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(queries: np.ndarray, against: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """(query, word) masks: bit j of a row tells whether fingerprint j is within ``radius``.

    ``against`` are planes.  Counters of ``radius`` + 1 or more are held in binary over
    the lanes; what overflows them stays in ``over``.
    """
    digits = [np.zeros((len(queries), against.shape[1]), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros_like(digits[0])
    for k in range(64):
        bit = np.where((queries >> np.uint64(k)) & np.uint64(1), _ALL, np.uint64(0))[:, None]
        carry = against[k][None, :] ^ bit
        for d in digits:
            d ^= carry  # the sum's digit
            carry = carry & ~d  # it was 1 and is 0 now
        over |= carry
        if k % 8 == 7 and k < 63:
            if bool(np.all(_beyond(digits, over, radius) == _ALL)):
                break
    return ~_beyond(digits, over, radius)


def _beyond(digits: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds ``radius``: a comparison from the highest digit down."""
    more, same = over.copy(), ~over
    for k in reversed(range(len(digits))):
        if radius >> k & 1:
            same = same & digits[k]
        else:
            more |= same & digits[k]
            same = same & ~digits[k]
    return more


def _links(groups: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows that share a group: (fingerprint, smallest one linked with it here), where they differ."""
    masks = near(prints, planes(prints), radius)
    reach = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little", count=len(prints)).astype(bool)
    reach &= groups[:, None] == groups[None, :]
    order = np.argsort(prints, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    big = len(order)
    least = rank
    while True:  # the smallest rank spreads along the links
        now = np.where(reach, least[None, :], big).min(1)
        if np.array_equal(now, least):
            break
        least = now
    root = prints[order[least]]
    differ = root != prints
    return prints[differ], root[differ]


def links(prints: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Links (a, b) that join any two of the distinct fingerprints ``simhash`` within ``radius``, directly or by others."""
    cuts = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    slices = [F.shiftrightunsigned(F.shiftleft("simhash", 64 - hi), 64 - hi + lo) for lo, hi in zip(cuts, cuts[1:])]
    pairs = [(i, j) for i in range(len(slices)) for j in range(i)]
    keys = F.array(*(F.struct(F.lit(n).alias("pair"), slices[i].alias("x"), slices[j].alias("y"))
                     for n, (i, j) in enumerate(pairs)))
    keyed = prints.select("simhash", F.explode(keys).alias("k")).select("simhash", "k.*")
    crowded = keyed.groupBy("pair", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    cells = F.ceil(F.col("n") / cell).cast("int")
    dealt = (keyed.join(crowded, ["pair", "x", "y"])
             .withColumn("cells", cells).withColumn("own", F.pmod(F.xxhash64("simhash"), F.col("cells")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
             .select("simhash", F.xxhash64("pair", "x", "y").alias("g"),
                     F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))

    def each(batches):
        left_g, left_p = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for batch in chain_none(batches):
            if batch is not None:
                g = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3)], 1)
                left_g = np.concatenate([left_g, g])
                left_p = np.concatenate([left_p, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
            starts = np.flatnonzero(np.r_[True, np.any(left_g[1:] != left_g[:-1], 1)]) if len(left_p) else np.empty(0, int)
            ends = [*starts[1:], *([len(left_p)] if batch is None else [])]
            at = 0
            while at < len(ends):  # whole groups, packed into blocks
                first, last = starts[at], at
                while last + 1 < len(ends) and ends[last + 1] - first <= cell:
                    last += 1
                ids = np.searchsorted(starts, np.arange(first, ends[last]), side="right")
                a, b = _links(ids, left_p[first:ends[last]], radius)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})
                at = last + 1
            done = ends[-1] if len(ends) else 0
            left_g, left_p = left_g[done:], left_p[done:]

    placed = dealt.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    return in_batches(placed, each, "a long, b long")


def chain_none(batches):
    yield from batches
    yield None


def components_of(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(simhash, root, component_id) of each distinct fingerprint of ``rows`` (doc_id, simhash)."""
    prints = stored(rows.groupBy("simhash").agg(F.min("doc_id").alias("least")), "prints")
    root_of = components(links(prints, radius)).select(F.col("a").alias("simhash"), F.col("b").alias("root"))
    roots = prints.join(root_of, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(roots.drop("least").join(least, "root"), "components")


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, simhash, component_id) for each row of ``df`` (doc_id, text)."""
    rows = stored(with_fingerprint(df.select("doc_id", "text"), shingle).drop("text"), "simhash")
    return rows.join(components_of(rows, radius), "simhash").select("doc_id", "simhash", "component_id")


def hex_of(column: str) -> F.Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def one_of_each(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with its smallest doc_id; of several with that id, any one.

    Where no row of a component has a doc_id, any one of them stays.
    """
    rows = stored(with_fingerprint(df.select("doc_id", "text"), shingle).drop("text"), "simhash")
    of = components_of(rows, radius)
    stays = stored(rows.join(of, "simhash").where("doc_id <=> component_id").groupBy("doc_id")
                   .agg(F.count("*").alias("n")), "stays")
    columns = [F.col(f"`{c}`") for c in df.columns]
    once = df.join(stays.where("n = 1 and doc_id is not null").select("doc_id"), "doc_id", "left_semi").select(*columns)
    some_id, own, print_, root, least = (fresh(df, c) for c in ("_id", "_simhash", "_print", "_root", "_least"))
    more = stays.where("n > 1 or doc_id is null").select(F.col("doc_id").alias(some_id))
    if more.isEmpty():
        return once
    # Ids that stand in several rows: the rows' own fingerprints tell which belong to the component.
    again = with_fingerprint(df.join(more, F.col("doc_id").eqNullSafe(F.col(some_id)), "left_semi"), shingle, own)
    of = of.select(F.col("simhash").alias(print_), F.col("root").alias(root), F.col("component_id").alias(least))
    again = again.join(of, F.col(own) == F.col(print_)).where(F.col("doc_id").eqNullSafe(F.col(least))).dropDuplicates([root])
    return once.unionByName(again.select(*columns))
