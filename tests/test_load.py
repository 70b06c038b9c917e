"""The load job: reconciliation in the write, versions, ids in source order."""

import random

import pytest

from bazaar.plans import load_job
from bazaar.schema import COLUMNS
from bazaar.sources.csv import read_sales_csv
from bazaar.sources.versions import Versions, written_once

HEADER = ",".join(COLUMNS)


def line(order_id, age="30"):
    return f"{order_id},2025-01-05,C,N,{age},Male,Pune,P,X,2,5.00,10.00"


def csv_file(path, ids):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([HEADER, *(i if "," in i else line(i) for i in ids)]) + "\n")


def load(spark, path, db, tmp_path):
    return load_job.run(spark, read_sales_csv(spark, str(path), places=True), db, str(tmp_path / "warehouse")).first()


def test_ids_follow_file_and_line(spark, tmp_path):
    """Files of mixed sizes, most of them cut into several splits that the scan packs by size."""
    random.seed(4)
    want = []
    for f in range(9):
        ids = [f"F{f}-{i}" for i in range(random.choice([1, 3, 40, 700]))]
        csv_file(tmp_path / "in" / f"part-{f}.csv", [line(i, "29.5") if k % 7 == 3 else i for k, i in enumerate(ids)])
        want += ids
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = load(spark, tmp_path / "in", "ids_db", tmp_path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (got.Source_Rows, got.Reconciled) == (len(want), True) and got.Quarantined_Rows > 0
    rows = load_job.sales_rows(spark, "ids_db").selectExpr("id", "coalesce(Order_ID, raw_Order_ID) AS o", "src_block").collect()
    assert [r.o for r in sorted(rows)] == want and sorted(r.id for r in rows) == list(range(1, len(want) + 1))
    assert len({r.src_block for r in rows}) > 2


def test_reconciliation_reads_the_source_once_and_sees_a_loss(spark, tmp_path, monkeypatch):
    csv_file(tmp_path / "a.csv", ["A", "B", "C"])
    assert load(spark, tmp_path / "a.csv", "loss_db", tmp_path).Reconciled
    csv_file(tmp_path / "b.csv", ["D", "E", "F", "G"])
    staged = load_job.staged
    monkeypatch.setattr(load_job, "staged", lambda *a, **k: staged(*a, **k).where("Order_ID != 'E'"))
    row = load(spark, tmp_path / "b.csv", "loss_db", tmp_path)
    assert (row.Source_Rows, row.Loaded_Rows, row.Reconciled) == (4, 3, False)
    assert sorted(r.Order_ID for r in load_job.sales_data(spark, "loss_db").collect()) == ["A", "B", "C"]  # the old rows stay
    monkeypatch.undo()
    again = load_job.run(spark, read_sales_csv(spark, str(tmp_path / "b.csv"), places=True), "loss_db", str(tmp_path / "warehouse"))
    assert again.first().Source_Rows == 4 and not again.inputFiles()  # nothing is left to be read for it
    assert sorted(r.Order_ID for r in load_job.sales_data(spark, "loss_db").collect()) == ["D", "E", "F", "G"]


def test_a_write_that_fails_half_way_leaves_the_old_rows(spark, tmp_path):
    csv_file(tmp_path / "a.csv", ["A", "B"])
    load(spark, tmp_path / "a.csv", "half_db", tmp_path)
    raw = read_sales_csv(spark, str(tmp_path / "a.csv"), places=True)
    broken = raw.union(raw).selectExpr(*COLUMNS[:-1], "if(src_row < 1, Total_Sales, raise_error('disk gone')) AS Total_Sales", "_malformed", "src_file", "src_block", "src_row")
    with pytest.raises(Exception, match="disk gone"):
        load_job.run(spark, broken, "half_db", str(tmp_path / "warehouse"))
    assert sorted(r.Order_ID for r in load_job.sales_data(spark, "half_db").collect()) == ["A", "B"]
    versions = load_job._versions(spark, "half_db")
    assert versions.files.names(f"{versions.root}/versions") == sorted(versions.published())
    tables = {t.name for t in spark.catalog.listTables("half_db") if t.name.startswith("sales_load_")}
    assert tables == {f"sales_load_{v}" for v in versions.published()}


def test_readers_keep_their_version_and_old_ones_go(spark, tmp_path):
    csv_file(tmp_path / "0.csv", ["A0"])
    load(spark, tmp_path / "0.csv", "many_db", tmp_path)
    for n in range(1, 4):
        reader = load_job.sales_data(spark, "many_db")
        csv_file(tmp_path / f"{n}.csv", [f"A{n}"])
        load(spark, tmp_path / f"{n}.csv", "many_db", tmp_path)
        assert [r.Order_ID for r in reader.collect()] == [f"A{n - 1}"]
    versions = load_job._versions(spark, "many_db")
    assert len(versions.published()) == load_job.KEEP == len(versions.files.names(f"{versions.root}/versions"))
    assert len([t for t in spark.catalog.listTables("many_db") if t.name.startswith("sales_load_")]) <= load_job.KEEP


def test_two_drivers_never_share_a_folder(spark, tmp_path):
    a, b = (Versions(spark, str(tmp_path / "t")) for _ in range(2))

    def write(versions, name):
        return lambda v: spark.range(1).selectExpr(f"'{name}' AS who").write.parquet(versions.folder(v))

    # b begins and ends while a is at work.
    a.write(lambda v: (write(a, "a")(v), b.write(write(b, "b"))))
    assert len(a.published()) == 2 and a.current() == b.current()
    assert [spark.read.parquet(a.folder(v)).first().who for v in a.published()] == ["b", "a"]


def test_written_once(spark, tmp_path):
    calls = []

    def write(folder):
        calls.append(folder)
        spark.range(3).write.parquet(folder)

    first, second = (written_once(spark, str(tmp_path / "once"), write) for _ in range(2))
    assert first == second and calls == [first] and spark.read.parquet(first).count() == 3
