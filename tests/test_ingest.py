"""Ingest queries: large totals, one parse per field, a load that does not sort its rows, an ordered copy made in parts."""

import os
import time
import uuid
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.readwriter import DataFrameWriter

from bazaar.operators.clean import coerce, report_rows, valid_rows
from bazaar.plans import ingest, load_job
from bazaar.schema import COLUMNS, SALES_SCHEMA
from bazaar.session import shuffles_removed
from bazaar.sources.csv import read_sales_csv
from rows import row


def test_totals_in_cents_beyond_bigint_are_exact(raw):
    big = {"Order_ID": "1", "Total_Sales": "9999999999999999.99", "Unit_Price": "1.25"}
    wide = ingest.in_bigint(ingest.column_profile(report_rows(raw(*[big] * 10)), cents=True))
    assert wide.first().Total_Sales_Cents == Decimal(9999999999999999990)
    assert (wide.first().Rows, wide.first().Unit_Price_Cents) == (10, 1250)
    assert dict(wide.dtypes)["Unit_Price_Cents"] == "bigint"
    small = ingest.in_bigint(ingest.column_profile(report_rows(raw(big, {"Order_ID": "2"})), cents=True))
    assert dict(small.dtypes)["Total_Sales_Cents"] == "bigint" and small.first().Total_Sales_Cents == 999999999999999999
    none = ingest.in_bigint(ingest.column_profile(report_rows(raw({"Order_ID": "2"})), cents=True))
    assert dict(none.dtypes)["Total_Sales_Cents"] == "bigint" and none.first().Total_Sales_Cents is None


def patterns(df) -> int:
    """How often the plan tests a text for being a number."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")


def test_valid_rows_parse_each_field_once(raw):
    assert patterns(valid_rows(coerce(raw({"Order_ID": "1", "Age": "30"})))) <= 8


def test_staged_rows_parse_each_field_once(raw):
    assert patterns(load_job.staged(raw({"Order_ID": "1", "Age": "30"}))) <= 8


def test_load_writes_its_rows_unsorted(spark, raw, tmp_path, monkeypatch):
    db, plans, writers, insert = f"unsorted_{uuid.uuid4().hex[:8]}", [], [], DataFrameWriter.insertInto
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")

    def explained(self, table, overwrite=None):
        self._df.createOrReplaceTempView("rows_to_load")
        plans.append(spark.sql(f"EXPLAIN EXTENDED INSERT OVERWRITE {table} SELECT * FROM rows_to_load").first()[0])
        writers.append(int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        insert(self, table, overwrite)

    monkeypatch.setattr(DataFrameWriter, "insertInto", explained)
    rows = raw({"Order_ID": "1"}, {"Order_ID": ""}, {"Order_ID": "2"}, {"Order_ID": "3", "Age": "1.5"})
    got = load_job.run(spark, rows, db, warehouse=str(tmp_path)).first()
    assert (got.Loaded_Rows, got.Quarantined_Rows, got.Reconciled) == (2, 2, True)
    assert plans and not any("Sort [" in p for p in plans)
    assert min(writers) > 2  # at its limit, a task sorts the rest of its rows
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_csv_copy_is_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "shared_path", lambda spark, *parts: "/".join([str(tmp_path), *parts]))
    names = os.listdir(ingest.sales_csv(spark, "/root/testdata/sf0.001"))
    data = [n for n in names if n.startswith("part-")]
    assert data and all(n.endswith(".csv.gz") for n in data)


def odd_rows(n):
    """Rows with NULLs in every column, ids and whole rows that come twice, and values that sort otherwise as text."""
    def some(k, step, value):
        return None if k % step == 0 else value

    rows = [row(Order_ID=some(k, 3, f"{k % 97}-{k % 7}"), Order_Date=some(k, 5, date(999, 12, 30) + timedelta(k % 4)), Customer_ID=some(k, 11, "C"),
                Customer_Name=some(k, 13, 'a "b", c'), Age=some(k, 4, k % 120 - 9), Gender=some(k, 6, "Male"), City=some(k, 8, "\u00c9vian"),
                Product=some(k, 9, f" {k % 2}"), Category=some(k, 10, "X"), Quantity=some(k, 14, k % 12),
                Unit_Price=some(k, 15, Decimal(k % 30)), Total_Sales=some(k, 16, Decimal(k % 1000 - 99) / 100)) for k in range(n)]
    return rows + rows[::9]


def as_fact(spark, rows):
    """The rows as a file table holds them: any column may be NULL."""
    return spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in SALES_SCHEMA]))


def ordered_copy(spark, rows, tmp_path, monkeypatch):
    fact = as_fact(spark, rows)
    monkeypatch.setattr(ingest, "shared_path", lambda spark, *parts: "/".join([str(tmp_path), *parts]))
    monkeypatch.setattr(ingest, "sales_table", lambda spark, sf_dir: fact)
    path = ingest.ordered_csv(spark, "/root/testdata/sf0.001")
    text = fact.select(*[fact[c].cast("string") for c in COLUMNS], *[fact[c].alias(f"_{c}") for c in COLUMNS]).sort(*[f"_{c}" for c in COLUMNS])
    got = read_sales_csv(spark, path, places=True).sort("src_file", "src_block", "src_row").collect()
    assert [tuple(r)[:len(COLUMNS)] for r in got] == [tuple(r)[:len(COLUMNS)] for r in text.collect()]
    assert all(r.src_file.endswith(".csv.gz") for r in got)
    return got


def test_ordered_copy_in_parts_holds_all_rows_in_order(spark, tmp_path, monkeypatch):
    for name, value in (("FILE_ROWS", 40), ("PART_ROWS", 100), ("SORT_PARTS", 3)):
        monkeypatch.setattr(ingest, name, value)
    got = ordered_copy(spark, odd_rows(900), tmp_path, monkeypatch)
    assert len(got) == 1000
    assert len({os.path.dirname(r.src_file) for r in got}) == 3
    assert len({r.src_file for r in got}) > 21  # more ranges for more rows: 7 in a part otherwise


def test_ordered_copy_of_a_small_an_equal_and_an_empty_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "PART_ROWS", 2)
    for name, rows in (("small", odd_rows(5)), ("equal", [row()] * 30), ("empty", [])):
        assert len(ordered_copy(spark, rows, tmp_path / name, monkeypatch)) == len(rows)


def test_no_range_has_more_files_than_their_names_can_number(spark, tmp_path, monkeypatch):
    """Of more than 1,000 files, c1000 is read before c101."""
    monkeypatch.setattr(ingest, "FILE_ROWS", 1)
    got = ordered_copy(spark, [row()] * 1010 + [row(Order_ID="O0"), row(Order_ID="O2")], tmp_path, monkeypatch)
    assert max(len(r.src_file.split("-c")[-1].split(".")[0]) for r in got) == 3 and (got[0].Order_ID, got[-1].Order_ID) == ("O0", "O2")


def test_each_part_of_the_ordered_copy_is_read_by_itself(spark):
    fact = as_fact(spark, odd_rows(300))
    cuts = ingest.cut_rows(fact, 4, 334)
    whole_row = F.struct(*COLUMNS)
    below = [fact.where(whole_row < c).count() for c in cuts]
    assert below == sorted(below) and len(cuts) == 3 and below[0] > 40 and below[-1] < 300
    assert all(fact.where(whole_row >= c).count() == 334 - n for c, n in zip(cuts, below))


def test_shuffle_files_go_as_queries_end(spark, tmp_path):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        blocks = disk.getAllBlocks()
        return {b for b in (blocks.apply(i).name() for i in range(blocks.size())) if b.startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_before = shuffles(), spark.conf.get(name, "false")
    kept = spark.range(1000).repartition(3)  # a reference keeps its shuffle from being collected
    with shuffles_removed(spark):
        assert spark.conf.get(name) == "true"
        kept.write.parquet(str(tmp_path / "a"))
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(name) == set_before
