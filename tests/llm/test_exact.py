import hashlib
from collections import defaultdict

import duckdb

from bazaar.llm import exact, queries

SPACE = dict.fromkeys([32, *range(9, 14)])


def brute(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of (doc_id, text), straight from the contract."""
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[(text or "").translate(SPACE)].append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for text, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[keep[3]][0], len(members), m == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    found = exact.exact_groups(df, every_digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted(map(tuple, found.collect()), key=str)


def test_documents_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(documents) == brute(rows)


def test_equal_length_and_beginning_but_another_end(spark):
    start = "x" * (2 * exact.PREFIX)
    rows = [(1, start + "a"), (2, start + "b"), (3, start + " a"), (4, start + " "), (5, start[:-1] + "ab"), (6, " " + start + "\tb"),
            (7, "\x1c"), (8, ""), (9, "\x0b \x0c"), (10, None), (11, "é"), (12, "é")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found, kept = got(odd), [r for r in brute(rows) if r[3]]
    assert [r[:3] + r[4:] for r in found] == [r[:3] + r[4:] for r in brute(rows)]
    assert len([r for r in found if r[3]]) == len(kept) == 4
    assert got(nothing) == [] and exact.deduplicated(nothing).collect() == []
    assert sorted(str(r.text)[:9] for r in exact.deduplicated(odd).collect()) == sorted({text[:9] for _, text in rows if text})


def test_only_survivors_are_hashed_whole(spark):
    long = [(i, f"{i:04d}" + "y" * (1000 + i)) for i in range(50)] + [(100, "0007" + "y" * 1007)]
    rows = exact.exact_groups(spark.createDataFrame(long, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in rows if r.text_sha256) == [7, 100]


def test_deduplicated_keeps_whole_rows(documents):
    stay = {r.keep_id for r in exact.exact_groups(documents).collect()}
    rows = exact.deduplicated(documents)
    assert rows.columns == documents.columns
    assert sorted(r.doc_id for r in rows.collect()) == sorted(stay)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    res = con.execute(queries.oracle_sql()["op11_exact_dedup"])
    names = [d[0] for d in res.description]
    rows = queries.op11_exact_dedup(spark, sf).select(*names).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, res.fetchall()))
