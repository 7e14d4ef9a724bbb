from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from harborline.operators import generation as G
from harborline.operators.rules import ValidationError
from harborline.plans import build as B
from harborline.plans import catalogue  # noqa: F401
from harborline.plans.star import DEFAULT_RATE
from harborline.plans.views import rolled_up
from harborline.settings import Settings
from harborline.sources.ingest import ingest
from harborline.sources.staged import STAGED, stage_csv
from tests.test_ingest import internet


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    src, out, data = (str(tmp_path_factory.mktemp(x)) for x in ("generated", "warehouse", "data"))
    G.generate_all(spark, 300, G.Profile(), G.Window(date(2024, 1, 1), date(2026, 6, 30)), src)
    ingest(spark, Settings(data=data), get=internet)
    report = B.build_warehouse(spark, src, out, ingested=f"{data}/sources")
    assert report.passed and len(report.results) > 100
    return src, out


def test_counts_and_dimensions(spark, folder):
    counts = B.table_counts(spark, folder[1])
    assert counts["dim_customer"] == 300 and counts["dim_channel"] == 10 and all(counts.values())
    assert (counts["ref_fx_rate"], counts["ref_uci_campaign"], counts["ref_peer_financials"]) == (2, 120, 78)
    dates = spark.read.parquet(f"{folder[1]}/dim_date")
    assert dates.where("date_key = 20250331").first().fiscal_year == 2024
    row = dates.where("date_key = 20250401").first()
    assert (row.fiscal_year, row.fiscal_quarter) == (2025, 1)
    assert {r.month for r in dates.where("is_festive_season = 1").select("month").distinct().collect()} == {10, 11}


@pytest.mark.parametrize("name", ["q01_customer_360", "q02_rfm_segmentation", "q03_revenue_trend", "q04_product_pareto", "q05_cohort_retention", "q06_churn_risk", "q07_campaign_funnel", "q08_channel_rollup", "q09_clv_deciles", "q10_executive_kpis"])
def test_every_query_runs_on_the_warehouse(spark, folder, name):
    rows = B.run_query(spark, name, folder[1]).collect()
    assert rows
    if name == "q01_customer_360":
        assert len(rows) == 300
    if name == "q04_product_pareto":
        assert abs(rows[-1].cumulative_share_pct - 100) < 1e-6 and [r.revenue_rank for r in rows] == list(range(1, len(rows) + 1))
    if name == "q05_cohort_retention":
        assert all(r.m01_pct >= r.m03_pct >= r.m06_pct for r in rows)
    if name == "q08_channel_rollup":
        assert sum(r.n_transactions for r in rows if r.level == "acquisition_x_txn") == next(r.n_transactions for r in rows if r.level == "total")
    if name == "q09_clv_deciles":
        assert {r.clv_decile for r in rows} <= set(range(1, 11)) and all((r.active_clv_decile is None) == (r.churned == 1) for r in rows)
    if name == "q10_executive_kpis":
        assert [r.kpi_order for r in rows] == list(range(1, 9)) and rows[4].prior_value is None


def test_unmapped_keys_and_unknown_queries_raise(spark, folder, tmp_path):
    dim = spark.createDataFrame([("a", 1)], "customer_id string, customer_key int")
    with pytest.raises(B.WarehouseError):
        B.mapped(spark.createDataFrame([("b",)], "customer_id string"), dim, "customer_id", "customer_key")
    with pytest.raises(B.WarehouseError):
        B.run_query(spark, "nope", folder[1])
    with pytest.raises(B.WarehouseError):
        B.build_warehouse(spark, str(tmp_path), str(tmp_path))
    assert B.run_query(spark, "q03_revenue_trend", folder[1], 2).count() == 2 and "q10_executive_kpis" in B.catalogue()


def test_the_lending_rate_comes_from_the_source(spark, folder):
    macro = spark.read.parquet(f"{folder[1]}/ref_macro_indicator")
    assert macro.where("indicator = 'FR.INR.LEND' and year = 2022").first().value == 8.5
    rows = B.Warehouse(spark, folder[1]).ref_macro_indicator.where("indicator = 'FR.INR.LEND' and value is not null")
    assert rows.agg(F.max_by("value", "year")).first()[0] == 8.5 != DEFAULT_RATE


def test_reference_tables_are_renamed_typed_and_told_apart_by_their_keys(spark):
    given = spark.createDataFrame([(1, "b", "TX", date(2024, 3, 31), "5", 1.0), (1, "a", "TX", date(2024, 3, 31), "5", None), (None, "x", "TX", date(2024, 3, 31), "1", 1.0), (2, "y", None, None, "1", 1.0)], "CERT long, institution_name string, STALP string, report_date date, ASSET string, ROA double")
    got = B.reference("ref_peer_financials", given, spark).collect()
    assert [(r.cert, r.institution_name, r.asset_thousands_usd, r.roa_pct, r.nim_thousands_usd) for r in got] == [(1, "a", 5.0, None, None)]
    assert B.reference("ref_fx_rate", None, spark).collect() == []


def test_a_bad_row_leaves_the_old_tables(spark, folder, tmp_path):
    src, out = folder
    before = {t: spark.read.parquet(f"{out}/{t}").count() for t in B.TABLES}
    for t in STAGED:
        df = spark.read.parquet(f"{src}/{t}")
        if t == "transactions":
            df = df.withColumn("amount_inr", F.when(F.col("txn_id") == df.first().txn_id, F.lit(0.0)).otherwise(F.col("amount_inr")))
        df.write.parquet(f"{tmp_path}/{t}")
    with pytest.raises(ValidationError, match="fact_transaction.amount_inr_in_range: 1 of"):
        B.build_warehouse(spark, str(tmp_path), out)
    assert {t: spark.read.parquet(f"{out}/{t}").count() for t in B.TABLES} == before
    assert not [p for p in Path(out).iterdir() if p.name.startswith("_incoming")]


def test_built_from_csv(spark, folder, tmp_path):
    src, out = folder
    for t in STAGED:
        stage_csv(spark.read.parquet(f"{src}/{t}"), f"{tmp_path}/{t}")
    B.build_warehouse(spark, str(tmp_path), f"{tmp_path}/out", form="csv")
    for t in ("dim_customer", "fact_transaction", "fact_customer_snapshot"):
        assert spark.read.parquet(f"{tmp_path}/out/{t}").exceptAll(spark.read.parquet(f"{out}/{t}")).count() == 0, t
    assert spark.read.parquet(f"{tmp_path}/out/ref_macro_indicator").count() == 0


def test_views(spark, folder):
    B.register_views(spark, folder[1])
    who = spark.sql("SELECT count(*) AS n, count(DISTINCT customer_id) AS d, sum(n_products) AS p FROM v_customer_360").first()
    latest = spark.read.parquet(f"{folder[1]}/fact_customer_snapshot").agg(F.sum("n_products")).first()[0]
    assert (who.n, who.d, who.p) == (300, 300, latest)
    accounts = spark.read.parquet(f"{folder[1]}/fact_monthly_account")
    view = spark.table("v_monthly_revenue")
    assert view.agg(F.round(F.sum("total_revenue_inr"), 0)).first()[0] == accounts.agg(F.round(F.sum("total_revenue_inr"), 0)).first()[0]
    assert view.groupBy("month", "product_code", "segment").count().where("count > 1").count() == 0
    rolled = {r.month: r.n_customers for r in rolled_up(view, "month").collect()}
    for r in accounts.groupBy("month").agg(F.count_distinct("customer_key").alias("n")).collect():
        assert rolled[r.month] == pytest.approx(r.n, rel=0.03, abs=1)


def test_the_latest_month_is_cut_in_the_scan(spark):
    from harborline.plans.warehouse import latest_holdings

    plan = latest_holdings(B.Star(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "l_shipdate" in line]
    assert any("DataFilters" in line and "l_shipdate" in line.split("DataFilters", 1)[1].split("Format")[0] for line in scans)
