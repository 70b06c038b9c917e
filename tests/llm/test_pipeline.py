import duckdb

import corpus_pipeline
from bazaar.llm import bpe, decontaminate, queries, simhash, spans, warc
from bazaar.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_follow_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), f"test-{name}")
        out[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == columns
        rows = {r.doc_id: r.text for r in before.collect()}
        if name == "simhash":
            prints = sorted((i, simhash.fingerprint(t)) for i, t in rows.items())
            for i, a in prints:  # each removed row is near another; no two that stay are
                near = {j for j, b in prints if j != i and (a ^ b).bit_count() <= simhash.RADIUS}
                assert near & rows.keys() if i not in out[name] else not near & out[name].keys()
        if name == "spans":
            seen = set()
            for i in sorted(out[name]):
                mine = {h for _, _, h in spans.spans(out[name][i].text)}
                assert not mine & seen or out[name][i].text == rows[i]
                seen |= mine
                assert out[name][i].n_chars == len(out[name][i].text)
        if name == "bpe":
            library = bpe.tokenizer(queries.tokenizer_path())
            assert out[name].keys() == rows.keys()
            assert all(r.round_trip and r.ids == library.encode(rows[i], add_special_tokens=False).ids for i, r in out[name].items())
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    before = spark.createDataFrame([(i, r.text) for i, r in out["spans"].items()], "doc_id long, text string")
    held = {r.doc_id for r in decontaminate.leaks(before, items).collect()}
    assert out["spans"].keys() - out["decontamination"].keys() == held


def test_warc_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    res = con.execute(warc.ORACLE_SQL)
    names = [d[0] for d in res.description]
    got = queries.op9_warc(spark, SF).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, res.fetchall()))


def test_every_query_runs(spark):
    for name in ("op1_html_text", "op2_licences", "op5_winnow", "op8_simhash"):
        df = queries.queries()[name](spark, SF)
        source = "pages" if name == "op1_html_text" else "documents"
        assert df.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
