"""The trie of conversation prefixes, by ternary search trees over shards of the sorted conversations.

* A turn is reduced to a code of 20 bytes: 128 bits of SHA-256 over role and text, and the text's number of words.
  A conversation is the string of its codes; prefixes of conversations are prefixes of that string.
* Conversations are dealt into shards by range of (codes, conv_id).  Copies of one conversation, however many, spread over as
  many shards as they need.
* A shard numbers its codes (a dictionary) and inserts its distinct conversations into a ternary search tree, the median first,
  then the medians of both halves, so that the children of a node form a balanced tree.  One walk from
  the last made node to the first, without recursion, adds up members, leaves and savings.
* A node lies in one shard only, unless it is on the path to a shard's first or last conversation.  The nodes on
  these two paths are merged by their hash: members and what lies below inside shards are sums; what a merged node itself
  adds to the nodes above it is counted in the first of its shards only.
* The ids of the conversations that end in a node are kept in parts of a shard each; the digest of a node with several
  parts reads them in order as a stream.

Turns are ordered by ``turn``, null first; turns with the same number by their codes.  Null roles and texts count as empty.  Rows
without conv_id belong to no conversation and are left out.  Repeated rows are turns of their own.  A conversation is held as
one row of 20 bytes per turn.  Other columns are not read; without any conversation there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.common import ROWS_PER_BATCH, crc_of_id, in_batches, stored

CODE = 20
#: Turns in a shard, on average, at most.
SHARD_TURNS = 1_000_000
#: Ids in a row of the streams of ids.
PART_IDS = 4096
ROOT = bytes(16)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_SHARD = ("shard int, side int, shared int, node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
          "n_children long, n_leaves long, saved_tokens long, words long, ends array<long>")


class Trie(NamedTuple):
    #: node, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    nodes: DataFrame
    #: node, part, conv_ids: the members that end in a node, ascending over parts and within them
    ends: DataFrame


def code(role: Column, text: Column) -> Column:
    """A turn's code as 40 hexadecimal digits."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32), F.lpad(F.hex(words), 8, "0"))


def coded(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of (conv_id, turn, role, text): the codes of each conversation in order."""
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", code(F.col("role"), F.col("text")).alias("code"))
    return (conversations.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .select("conv_id", F.col("turns.code").alias("turns")))


def branched(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``coded`` conversations whose first h turns are those of the first conversation of their family.

    The family of c begins with c - c % ``family``; h is crc32 of the decimal c modulo ``most``.
    """
    own = stored(coded(conversations), "turns")
    heads = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    h = (crc_of_id(F.col("conv_id")) % most).cast("int")
    none = F.array().cast("array<string>")
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h),
                                           F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


class Tree:
    """A ternary search tree over sequences of numbers; node 0 is the root, and parents come before their children."""

    def __init__(self, sequences: list[list[int]]):
        """``sequences`` are distinct and sorted."""
        self.number, self.parent = array("i", [-1]), array("i", [-1])
        self.low, self.high, self.below = array("i", [-1]), array("i", [-1]), array("i", [-1])
        self.end = [0] * len(sequences)
        halves = [(0, len(sequences))]
        while halves:
            a, b = halves.pop()
            if a < b:
                middle = (a + b) // 2
                self.end[middle] = self._insert(sequences[middle])
                halves += [(middle + 1, b), (a, middle)]

    def _new(self, number: int, parent: int) -> int:
        self.number.append(number)
        self.parent.append(parent)
        for link in (self.low, self.high, self.below):
            link.append(-1)
        return len(self.number) - 1

    def _insert(self, sequence: list[int]) -> int:
        number, at = self.number, 0
        for x in sequence:
            link, child = self.below, at
            while (found := link[child]) >= 0 and number[found] != x:
                link, child = (self.low if x < number[found] else self.high), found
            if found < 0:
                found = link[child] = self._new(x, at)
            at = found
        return at

    def path(self, node: int) -> list[int]:
        """The nodes from the root to ``node``."""
        up = []
        while node >= 0:
            up.append(node)
            node = self.parent[node]
        return up[::-1]


def _read(batches) -> tuple[list[bytes], list[array]]:
    """The distinct keys of a shard, in order, and the ids of each."""
    keys, members = [], []
    for batch in batches:
        for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not keys or keys[-1] != key:
                keys.append(key)
                members.append(array("q"))
            members[-1].append(conv_id)
    return keys, members


def _numbered(keys: list[bytes]) -> tuple[list[list[int]], list[int], list[bytes]]:
    """The keys as numbers of their codes, which follow the codes' order; the words and the code of each number."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, CODE)
    _, first, numbers = np.unique(np.ascontiguousarray(raw).view(f"V{CODE}").ravel(), return_index=True, return_inverse=True) \
        if len(raw) else (None, np.empty(0, int), np.empty(0, int))
    ends = np.cumsum([0, *(len(k) // CODE for k in keys)])
    numbers = numbers.ravel().tolist()
    words = np.ascontiguousarray(raw[first, 16:]).view(">u4").ravel().tolist()
    return [numbers[a:b] for a, b in zip(ends, ends[1:])], words, [raw[i].tobytes() for i in first]


def shard_rows(keys: list[bytes], members: list[array], shard: int) -> Iterator[tuple]:
    """The nodes of a shard as rows of ``_SHARD``.

    Nodes on the two outer paths have a ``side`` (the path they were met on first) and ``shared``, the depth down to which
    both paths are one.  Their n_children and n_leaves leave out nodes of these paths, and their saved_tokens count all members
    of these nodes where others count all but one.
    """
    sequences, words, codes = _numbered(keys)
    tree = Tree(sequences)
    number, parent, count = tree.number, tree.parent, len(tree.number)
    side = dict.fromkeys(tree.path(tree.end[-1]), 1) | dict.fromkeys(tree.path(tree.end[0]), 0)
    both = set(tree.path(tree.end[0])) & set(tree.path(tree.end[-1]))
    n, least, children, leaves, saved = (array("q", bytes(8 * count)) for _ in range(5))
    depth, ends = array("i", bytes(4 * count)), {}
    nodes = [ROOT]
    for v in range(1, count):
        depth[v] = depth[parent[v]] + 1
        nodes.append(hashlib.sha256(nodes[parent[v]] + codes[number[v]]).digest()[:16])
    for v in range(count):
        least[v] = 2 ** 63 - 1
    for v, ids in zip(tree.end, members):
        n[v], least[v], ends[v] = len(ids), ids[0], ids
    for v in range(count - 1, -1, -1):  # children come before their parents
        w = words[number[v]] if v else 0
        if v in side:
            saved[v] += n[v] * w
        else:
            saved[v] += (n[v] - 1) * w
            leaves[v] += children[v] == 0
        if v:
            p = parent[v]
            n[p] += n[v]
            least[p] = min(least[p], least[v])
            children[p] += v not in side
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    for v in range(count):
        p = parent[v]
        outer, under = v in side, p >= 0 and p in side
        yield (shard, side.get(v), len(both) - 1 if outer else None, nodes[v], nodes[p] if under else None, depth[v], least[v],
               None if p < 0 or under else least[p], n[v], children[v], leaves[v], saved[v], words[number[v]] if v else 0,
               ends[v].tolist() if v in ends else None)


def _shards(sequences: DataFrame) -> DataFrame:
    """All nodes of all shards of (key, conv_id)."""
    schema = pa.schema([("shard", pa.int32()), ("side", pa.int32()), ("shared", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()),
                        *((name, pa.int64()) for name in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                          "saved_tokens", "words")), ("ends", pa.list_(pa.int64()))])

    def each(batches):
        keys, members = _read(batches)
        if not keys:
            return
        rows = []
        for row in shard_rows(keys, members, TaskContext.get().partitionId()):
            rows.append(row)
            if len(rows) == ROWS_PER_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    turns = sequences.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    shards = max(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns // CODE // SHARD_TURNS)
    return in_batches(sequences.repartitionByRange(shards, "key", "conv_id").sortWithinPartitions("key", "conv_id"), each, _SHARD)


def _digests(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, part, conv_ids): parts of a node are read one after the other."""
    pieces = parts.select("node", "part", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor((F.size("conv_ids") - 1) / PART_IDS).cast("int")),
        lambda i: F.array_join(F.slice("conv_ids", i * PART_IDS + 1, F.lit(PART_IDS)).cast("array<string>"), ","))).alias("piece", "ids"))

    def each(batches):
        node = digest = None
        for batch in batches:
            done = []
            for of, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = of, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in done], pa.binary()), "ends_sha256": pa.array([x for _, x in done], pa.string())})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()])})

    placed = pieces.repartition("node").sortWithinPartitions("node", "part", "piece").select("node", "ids")
    return in_batches(placed, each, "node binary, ends_sha256 string")


def _merged(outer: DataFrame) -> DataFrame:
    """One row per node on outer paths, with what all its shards hold below it."""
    merged = outer.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        F.min("shard").alias("first"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    kids = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    merged = stored(merged.drop("kids"), "trie-merged")

    # What each of these nodes adds itself, in the first of its shards, to all above it on that shard's paths.
    own = outer.select("node", "shard", "side", "shared", "depth").join(merged.select("node", "first", "words", "n_children"), "node")
    here = F.col("shard") == F.col("first")
    own = own.withColumn("words", F.when(here, F.col("words")).otherwise(0)) \
        .withColumn("leaf", F.when(here & (F.col("n_children") == 0), 1).otherwise(0))
    down = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    branch = (F.col("side") == 0) & (F.col("depth") <= F.col("shared"))
    total = [F.sum(c).over(down) + F.when(branch, F.coalesce(F.sum(F.when(F.col("side") == 1, F.col(c))).over(Window.partitionBy("shard")), F.lit(0)))
             .otherwise(0) for c in ("words", "leaf")]
    added = own.select("node", total[0].alias("words"), total[1].alias("leaf")).groupBy("node").agg(
        F.sum("words").alias("own_words"), F.sum("leaf").alias("own_leaves"))
    return merged.join(added, "node").select(
        "node", "parent", "depth", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("own_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") - F.col("own_words")).alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> Trie:
    """The trie of (conv_id, turns), ``turns`` being codes as ``coded`` gives them."""
    sequences = stored(conversations.where("conv_id is not null").select(
        F.unhex(F.array_join("turns", "")).alias("key"), F.col("conv_id").cast("long").alias("conv_id")), "sequences")
    rows = stored(_shards(sequences), "trie-shards")
    inner, outer = rows.where("side is null"), rows.where("side is not null")
    ends = rows.where("ends is not null").select("node", F.col("shard").alias("part"), F.col("ends").alias("conv_ids"))

    merged = stored(_merged(outer), "trie-outer")
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("of_parent"))
    digests = _digests(outer.where("ends is not null").select("node", F.col("shard").alias("part"), F.col("ends").alias("conv_ids")))
    columns = ("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    whole = F.sha2(F.array_join(F.coalesce("ends", F.array().cast("array<long>")).cast("array<string>"), ",").cast("binary"), 256)
    inner = inner.join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_parent")).withColumn("ends_sha256", whole)
    outer = merged.join(parents, "parent", "left").withColumn("parent_conv_id", F.col("of_parent")).join(digests, "node", "left") \
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
    return Trie(inner.select(*columns).unionByName(outer.select(*columns)), ends)


#: DuckDB SQL of the query's rows.  It has no crc32, so that is spelt out over the id's digits.
ORACLE_SQL = r"""
WITH own AS (
    SELECT conv_id, list({'k': sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')),
                          'w': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST) AS turns,
           list_reduce(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT),
                       lambda c, b: xor(c >> 8, list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7],
                           lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b) & 255)),
                       4294967295::BIGINT) AS crc
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:xor(c.crc, 4294967295) % 4], c.turns[xor(c.crc, 4294967295) % 4 + 1:]) AS turns
    FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
nodes AS (
    SELECT turns[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs
    FROM rebuilt, unnest(range(0, len(turns) + 1)) AS t(d) GROUP BY 1, 2),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.path = k.path),
sums AS (
    SELECT path[1:d] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves,
           sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * path[depth].w END)::BIGINT AS saved_tokens
    FROM counted, unnest(range(0, depth + 1)) AS t(d) GROUP BY 1),
ends AS (SELECT turns AS path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM rebuilt GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM counted c JOIN sums s ON c.path = s.path LEFT JOIN ends e ON c.path = e.path
LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[1:c.depth - 1]
"""
