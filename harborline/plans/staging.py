"""Staged files and ingested payloads as queries: each writes or spells out the given tables and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.plans.atomic import read
from harborline.plans.build import reference
from harborline.plans.registry import query
from harborline.plans.star import LENDING, Star
from harborline.plans.warehouse import sql
from harborline.sources import parsers
from harborline.sources.staged import scan_csv, stage_csv, staging_folder


@query("csv_scan_orders", """WITH o AS (SELECT o_orderstatus AS s, floor(o_totalprice * 100 + 0.5)::BIGINT AS c, CASE WHEN o_orderkey % 97 = 0 THEN 'malformed' WHEN o_orderkey % 101 = 0 THEN 'missing o_custkey' END AS bad FROM orders)
SELECT coalesce(bad, s) AS kind, bad IS NOT NULL AS rejected, count(*)::BIGINT AS n, sum(c) FILTER (bad IS NULL)::BIGINT AS cents FROM o GROUP BY 1, 2""")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders as CSV, some with a price or a customer that their type or schema does not hold, scanned by the declared schema."""
    key = F.col("o_orderkey")
    price = F.when(key % 97 == 0, "oops").otherwise(F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).cast("string"))
    lines = read(spark, d, "orders").select("o_orderkey", F.when(key % 101 == 0, None).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderstatus", price.alias("cents"), F.to_date("o_orderdate").alias("o_orderdate"))
    found = scan_csv(spark, stage_csv(lines, staging_folder(spark, "orders")), "o_orderkey bigint not null, o_custkey bigint not null, o_orderstatus string not null, cents bigint, o_orderdate date")
    good = found.rows.groupBy(F.col("o_orderstatus").alias("kind"), F.lit(False).alias("rejected")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    bad = found.rejects.groupBy(F.col("reason").alias("kind"), F.lit(True).alias("rejected")).agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("cents"))
    return good.unionByName(bad)


@query("ref_macro_indicator", sql(f"SELECT '{LENDING}' AS indicator, 'Lending interest rate (%)' AS indicator_label, 'IND' AS country_iso3, year, value FROM macro"))
def ref_macro(spark: SparkSession, d: str) -> DataFrame:
    """Yearly rates spelled out as an answer of the World Bank, each twice, once without a value, and one without a year."""
    rates = Star(spark, d).ref_macro_indicator
    twice = rates.unionByName(rates.withColumn("value", F.lit(None).cast("double"))).unionByName(rates.limit(1).withColumn("year", F.lit(None).cast("int")))
    row = F.struct(F.struct(F.col("indicator").alias("id"), F.lit(parsers.INDICATORS[LENDING]).alias("value")).alias("indicator"), F.lit("IND").alias("countryiso3code"), F.col("year").cast("string").alias("date"), F.col("value").cast("string").alias("value"))
    body = F.concat(F.lit('[{"page":1},'), F.to_json(F.collect_list(row)), F.lit("]"))
    return reference("ref_macro_indicator", parsers.world_bank(twice.groupBy("year").agg(body.alias("body")).select("body")), spark)


@query("ref_peer_financials", """SELECT c_nationkey::INT AS cert, n_name AS institution_name, NULL AS state, make_date(year(o_orderdate)::INT, 12, 31) AS report_date, count(*)::DOUBLE AS asset_thousands_usd, count(DISTINCT c_custkey)::DOUBLE AS deposits_thousands_usd,
 NULL::DOUBLE AS net_income_thousands_usd, NULL::DOUBLE AS nim_thousands_usd, (count(*) FILTER (o_orderstatus = 'F'))::DOUBLE AS nimy_pct, NULL::DOUBLE AS roa_pct, NULL::DOUBLE AS roe_pct, NULL::DOUBLE AS efficiency_ratio_pct
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def ref_peers(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a nation and year spelled out as filings of a bank."""
    orders = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    filed = orders.groupBy("c_nationkey", "n_name", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("k"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    row = F.struct(F.struct(F.col("c_nationkey").cast("string").alias("CERT"), F.col("n_name").alias("NAME"), F.format_string("%d1231", "y").alias("REPDTE"), F.format_number("n", 0).alias("ASSET"), F.col("k").cast("string").alias("DEP"), F.col("f").alias("NIMY"), F.lit("n/a").alias("ROA")).alias("data"))
    payloads = filed.groupBy("c_nationkey").agg(F.concat(F.lit('{"data":'), F.to_json(F.collect_list(row)), F.lit("}")).alias("body"))
    filings = parsers.bank_filings(payloads.select("body"), ["ASSET", "DEP", "NIMY", "ROA"]).withColumnRenamed("NAME", "institution_name")
    return reference("ref_peer_financials", filings, spark)


@query("ref_fx_rate", "SELECT ts::DATE AS date, 'USD' AS base, event_type AS quote, count(*)::DOUBLE AS rate FROM events GROUP BY 1, 3")
def ref_fx(spark: SparkSession, d: str) -> DataFrame:
    """Events of a day by type spelled out as rates of a day, a payload for each month."""
    seen = read(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").cast("double").alias("rate"))
    days = seen.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "rate"))).alias("rates"))
    months = days.groupBy(F.trunc("day", "MM").alias("m")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("day").cast("string"), "rates"))).alias("rates"))
    return reference("ref_fx_rate", parsers.fx_series(months.select(F.to_json(F.struct(F.lit("USD").alias("base"), "rates")).alias("body"))), spark)


@query("ref_uci_campaign", "SELECT (18 + c_custkey % 60)::INT AS age, c_mktsegment AS job, (c_nationkey % 3)::VARCHAR || ';x' AS default_credit, (c_custkey % 7)::INT AS campaign, (c_custkey % 5 / 10.0)::DOUBLE AS emp_var_rate, (c_custkey % 9 = 0)::INT AS subscribed, count(*)::BIGINT AS n FROM customer GROUP BY ALL")
def ref_campaign(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as a ;-separated file of contacts, with separators inside quotes and the column that leaks."""
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(18 + k % 60, "c_mktsegment", F.concat((F.col("c_nationkey") % 3).cast("string"), F.lit(";x")), k % 7, k % 5 / 10, k, F.when(k % 9 == 0, "yes").otherwise("no")).toDF("age", "job", "default", "campaign", "emp.var.rate", "duration", "y")
    path = staging_folder(spark, "contacts")
    rows.write.option("header", True).option("sep", ";").option("quoteAll", True).csv(path)
    found = reference("ref_uci_campaign", parsers.campaign_contacts_at(spark, path), spark)
    return found.groupBy("age", "job", "default_credit", "campaign", "emp_var_rate", "subscribed").agg(F.count("*").alias("n"))
