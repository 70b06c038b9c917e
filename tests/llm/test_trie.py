import hashlib
import random
from collections import defaultdict
from zlib import crc32

import duckdb

from bazaar.llm import queries, trie

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return len([w for w in text.translate({ord(c): " " for c in SPACE}).split(" ") if w])


def brute(rows):
    """The nodes of (conv_id, turn, role, text), straight from the contract."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    members, ends, below = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in own:
        h = crc32(str(c).encode()) % 4
        turns = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[c][h:]
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            for e in range(d + 1):
                below[tuple(turns[:e])].add(tuple(turns[:d]))
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below[p]),
                   sum((len(members[q]) - 1) * words(q[-1][1]) for q in below[p] if q),
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got(df):
    return sorted(tuple(r) for r in trie.prefix_trie(trie.branched(df)).nodes.select(*NAMES).collect())


def key(rows):
    return sorted(map(str, rows))


def test_generated_conversations_equal_brute_force(spark):
    random.seed(3)
    rows = []
    for c in range(-25, 160):
        length = random.choice([1, 1, 2, 3, 6])
        rows += [(c, t, random.choice(["user", "bot"]), random.choice(["hi", "hi you", "a  b\tc", ""])) for t in range(length)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(5)]  # one group of copies, over many shards
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert key(got(df)) == key(brute(rows))


def test_table_equals_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = got(df)
    assert key(rows) == key(brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    res = con.execute(queries.oracle_sql()["op13_prefix_trie"])
    assert [d[0] for d in res.description] == list(NAMES)
    assert key(rows) == key(res.fetchall())


def test_odd_rows(spark):
    rows = [(1, None, "user", "z"), (1, None, None, "z"), (1, 0, "user", None), (1, 0, "user", None), (1, 2, None, None), (None, 0, "user", "lost"),
            (20, 5, "user", "x " * 50_000), (21, 0, "user", "only"), (25, 0, "a", "b"), (26, 0, "ab", ""), (41, 0, "user", "turnless?")]
    df = spark.createDataFrame([(*r, "more", 1.5) for r in rows], "conv_id long, turn long, role string, text string, node string, key double")
    assert key(got(df)) == key(brute(rows))
    assert got(df.limit(0)) == []


def test_ends_hold_the_members(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(200, 260) for t in range(3)]
    found = trie.prefix_trie(trie.coded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    nodes = {bytes(r.node): r for r in found.nodes.collect()}
    parts = found.ends.orderBy("node", "part").collect()
    assert len(nodes) == 4 and len({bytes(r.node) for r in parts}) == 1
    assert [i for r in parts for i in r.conv_ids] == list(range(200, 260))
    leaf = nodes[bytes(parts[0].node)]
    assert (leaf.depth, leaf.n_convs, leaf.n_leaves, leaf.saved_tokens) == (3, 60, 1, 118)
    assert leaf.ends_sha256 == hashlib.sha256(",".join(map(str, range(200, 260))).encode()).hexdigest()


def test_tree_is_balanced_and_holds_its_sequences():
    sequences = [[x] for x in range(1023)]
    tree = trie.Tree(sequences)
    steps = []
    for x in range(1023):
        at, n = tree.below[0], 1
        while tree.number[at] != x:
            at, n = (tree.low if x < tree.number[at] else tree.high)[at], n + 1
        steps.append(n)
    assert max(steps) == 10
    assert [tree.path(v) for v in tree.end] == [[0, v] for v in tree.end]
