"""The one-pass EDA job gives the same sections as the single reports."""

from bazaar.operators.summaries import full_rollup
from bazaar.plans import catalog, eda_job
from bazaar.sources.tables import sales_table

SF = "/root/testdata/sf0.001"


def test_job_sections_equal_single_reports(spark):
    fact = sales_table(spark, SF)
    secs = eda_job.sections(fact)
    for name, df in secs.items():
        single = catalog.REPORTS[name](fact)
        assert sorted(df.columns) == sorted(single.columns), name
        assert sorted(map(tuple, df.select(*single.columns).collect())) == sorted(map(tuple, single.collect())), name


def test_the_fact_is_read_once(spark):
    """One scan in the plan of the job's rollup, none in any section's."""
    fact = sales_table(spark, SF)
    table = fact.inputFiles()[0].rsplit("/", 4)[1]
    plan = full_rollup(fact)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("Expand [") == 1 and plan.count("Aggregate [") == 1
    for name, df in eda_job.sections(fact).items():
        assert not any(table in f for f in df.inputFiles()), name


def test_rollup_of_an_empty_fact(sales):
    secs = eda_job.sections(sales())
    for name, df in secs.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, catalog.REPORTS[name](sales()).collect())), name


def test_write_sections(spark, tmp_path):
    fact = sales_table(spark, SF)
    secs = {k: v for k, v in eda_job.sections(fact).items() if k in ("kpi_summary", "chart_city_sales")}
    eda_job.write_sections(secs, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "chart_city_sales")).count() == secs["chart_city_sales"].count()


def test_run_writes_sections_and_report(spark, tmp_path):
    from datetime import datetime
    fact = sales_table(spark, SF)
    written = eda_job.run(fact, out_dir=str(tmp_path), generated_at=datetime(2026, 1, 1, 9, 30))
    assert written["kpi_summary"].count() == 1 and len(written) == 21
    assert spark.read.parquet(str(tmp_path / "kpi_summary")).count() == 1
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.startswith("> **Generated:** 01 January 2026, 09:30")
