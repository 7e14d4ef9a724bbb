"""The bank star schema as views over order, line-item and event tables.

Money is whole cents (BIGINT) inside the model, so sums are exact in any order; outputs divide by 100.
``STAR_SQL`` states the same views for the DuckDB oracle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the channel dimension: code, name, digital flag. 5-LOW has no row on purpose.
CHANNELS = [("1-URGENT", "Mobile app", 1), ("2-HIGH", "Net banking", 1), ("3-MEDIUM", "Branch", 0), ("4-NOT SPECIFIED", "ATM", 0)]
#: The series of the lending rate; the rate where nothing is known, and other fixed values of the model.
LENDING = "FR.INR.LEND"
DEFAULT_RATE, CHURN_DAYS, DAYS_PER_MONTH, CAMPAIGNS = 8.567143, 180, 30.44, 12


def cents(x: Column) -> Column:
    return F.floor(x * 100 + F.lit(0.5)).cast("bigint")


def money(c: Column | str) -> Column:
    return F.col(c) / F.lit(100.0) if isinstance(c, str) else c / F.lit(100.0)


def to(x: Column, digits: int = 2) -> Column:
    """Rounded half up by floor, the same arithmetic in every engine."""
    p = F.lit(float(10**digits))
    return F.floor(x * p + F.lit(0.5)).cast("double") / p


def line_revenues() -> tuple[Column, Column]:
    """Interest and fee of a line in cents."""
    price = F.col("l_extendedprice")
    return cents(price * (1 - F.col("l_discount")) * 0.01), cents(price * F.col("l_tax") * 0.01)


def months(a: Column, b: Column) -> Column:
    """Calendar months from a to b."""
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("int")


def truncated_months(days: Column) -> Column:
    return (days / F.lit(DAYS_PER_MONTH)).cast("int")


@dataclass
class Star:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def as_of(self) -> Column:
        """The last order date, as a one-row subquery."""
        return self.table("orders").agg(F.max(F.to_date("o_orderdate"))).scalar()

    @cached_property
    def fact_transaction(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        return self.table("orders").select(
            F.col("o_orderkey").alias("txn_id"), F.col("o_custkey").alias("customer_key"), day.alias("txn_date"), F.trunc(day, "MM").alias("month"),
            F.when(F.col("o_orderstatus") == "P", "credit").otherwise("debit").alias("direction"), cents(F.col("o_totalprice")).alias("amount_c"), F.col("o_orderpriority").alias("channel_code"),
        )

    @cached_property
    def dim_channel(self) -> DataFrame:
        return self.spark.createDataFrame(CHANNELS, "channel_code string, channel_name string, is_digital int")

    @cached_property
    def dim_product(self) -> DataFrame:
        code = F.concat_ws("/", "p_brand", "p_type")
        found = self.table("part").select(code.alias("product_code"), F.col("p_brand").alias("product_name"), F.col("p_type").alias("category")).distinct()
        # the catalogue is small by nature: brands times types
        return found.withColumn("product_key", F.row_number().over(Window.orderBy("product_code")))

    @cached_property
    def dim_customer(self) -> DataFrame:
        digital = F.col("channel_code").isin("1-URGENT", "2-HIGH")
        orders = self.fact_transaction.groupBy("customer_key").agg(
            F.min("txn_date").alias("acquired_date"), F.min_by("channel_code", F.struct("txn_date", "txn_id")).alias("acquisition_channel"), F.count_if(digital).alias("n_digital"), F.count("*").alias("n_orders")
        )
        nation = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        age = (18 + F.pmod(F.col("c_custkey"), F.lit(60))).cast("int")
        who = self.table("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_key"), F.col("c_name").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("city"), F.col("r_name").alias("state"), cents(F.col("c_acctbal")).alias("income_c"),
            age.alias("age"), F.when(age <= 25, "<25").when(age <= 35, "25-34").when(age <= 45, "35-44").when(age <= 55, "45-54").when(age <= 65, "55-64").otherwise("65+").alias("age_band"), (300 + F.pmod(F.col("c_custkey"), F.lit(601))).cast("int").alias("credit_score"),
        )
        return who.join(orders, "customer_key").withColumn("tenure_months", months(F.col("acquired_date"), self.as_of)).withColumn("digital_engagement", F.col("n_digital") / F.col("n_orders"))

    @cached_property
    def fact_monthly_account(self) -> DataFrame:
        return self.accounts(self.table("lineitem"))

    @cached_property
    def latest_accounts(self) -> DataFrame:
        """The accounts of the last month: lines are cut by a range of ship dates in the scan, before anything is joined."""
        return self.accounts(self.table("lineitem").where(F.col("l_shipdate") >= self.latest_month))

    def priced(self, lines: DataFrame, *measures: Column, of_part: tuple[Column, ...] = ()) -> DataFrame:
        """Measures of lines with their customer, month and columns of their part; nothing else is moved."""
        lines = lines.select("l_orderkey", "l_partkey", F.trunc(F.to_date("l_shipdate"), "MM").alias("month"), *measures)
        parts = self.table("part").select("p_partkey", *of_part)
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("customer_key"))
        return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])

    def accounts(self, lines: DataFrame) -> DataFrame:
        code, (interest, fee) = F.concat_ws("/", "p_brand", "p_type").alias("product_code"), line_revenues()
        joined = self.priced(lines, cents(F.col("l_extendedprice")).alias("balance_c"), interest.alias("interest_c"), fee.alias("fee_c"), of_part=(code,))
        sums = [F.sum(c).alias(c) for c in ("balance_c", "interest_c", "fee_c")]
        return joined.groupBy("customer_key", "product_code", "month").agg(*sums, F.sum(F.col("interest_c") + F.col("fee_c")).alias("revenue_c"))

    @cached_property
    def monthly_revenue(self) -> DataFrame:
        """(customer_key, month, revenue_c) over all accounts, from the lines themselves: no account is made, no product code moves."""
        interest, fee = line_revenues()
        return self.priced(self.table("lineitem"), (interest + fee).alias("c")).groupBy("customer_key", "month").agg(F.sum("c").alias("revenue_c"))

    @cached_property
    def latest_month(self) -> Column:
        return self.table("lineitem").agg(F.trunc(F.to_date(F.max("l_shipdate")), "MM")).scalar()

    @cached_property
    def fact_campaign_contact(self) -> DataFrame:
        key = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(CAMPAIGNS)).alias("campaign_key")
        won = (F.col("event_type") == "purchase").cast("int").alias("converted")
        rows = self.table("events").select(key, F.col("user_id").alias("customer_key"), "ts", "event_id", won, cents(F.col("value")).alias("cost_c"))
        by = Window.partitionBy("campaign_key", "customer_key").orderBy("ts", "event_id")
        before = F.lag("converted").over(by)
        outcome = F.when(before.isNull(), "nonexistent").when(before == 1, "success").otherwise("failure")
        return rows.select("campaign_key", "customer_key", F.row_number().over(by).alias("contact_sequence"), "converted", outcome.alias("prior_outcome"), "cost_c")

    @cached_property
    def dim_campaign(self) -> DataFrame:
        keys = self.spark.range(CAMPAIGNS).select(F.col("id").cast("int").alias("campaign_key"))
        start = F.add_months(F.lit("1995-01-01").cast("date"), F.col("campaign_key"))
        named = keys.select("campaign_key", F.format_string("CMP%03d", F.col("campaign_key")).alias("campaign_id"), start.alias("start_date"), (F.col("campaign_key") + 1).alias("product_key"))
        return named.join(F.broadcast(self.dim_product.select("product_key", "product_code")), "product_key")

    @cached_property
    def fact_customer_snapshot(self) -> DataFrame:
        last = self.fact_transaction.groupBy("customer_key").agg(F.min("txn_date").alias("acquired_date"), F.max("txn_date").alias("last_date"), F.count("*").alias("n_transactions"))
        gone = F.col("last_date") < F.date_sub(self.as_of, CHURN_DAYS)
        end = F.when(gone, F.col("last_date")).otherwise(self.as_of)
        return last.select("customer_key", "acquired_date", F.when(gone, F.col("last_date")).alias("churn_date"), gone.cast("int").alias("churned"), (~gone).cast("int").alias("censored"), months(F.col("acquired_date"), end).alias("observed_months"), "n_transactions")

    @cached_property
    def ref_macro_indicator(self) -> DataFrame:
        """The mean tax of a ship year stands for its lending rate; the last year is not published yet."""
        year = F.year("l_shipdate").alias("year")
        rates = self.table("lineitem").groupBy(year).agg(to(F.sum(F.floor(F.col("l_tax") * 100 + F.lit(0.5))) / F.count("*"), 6).alias("value"))
        last = self.table("lineitem").agg(F.year(F.max("l_shipdate"))).scalar()
        return rates.select(F.lit(LENDING).alias("indicator"), "year", F.when(F.col("year") < last, F.col("value")).alias("value"))

    def dim_date(self, start: str, end: str) -> DataFrame:
        """One row per day; the fiscal year begins in April and the festive season is October and November."""
        return self.dated(self.spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date")))

    @cached_property
    def dates(self) -> DataFrame:
        """The date dimension over all ship dates, from the first day of their first month."""
        ends = self.table("lineitem").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
        return self.dated(ends.where("a is not null").select(F.explode(F.sequence(F.trunc(F.to_date("a"), "MM").cast("date"), F.to_date("b"))).alias("full_date")))

    def dated(self, days: DataFrame) -> DataFrame:
        day = F.col("full_date")
        return days.select(
            (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).alias("date_key"), day, F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"), F.date_format(day, "MMMM").alias("month_name"), F.dayofmonth(day).alias("day"),
            F.weekday(day).alias("day_of_week"), F.date_format(day, "EEEE").alias("day_name"), F.weekofyear(day).alias("week_of_year"), (F.weekday(day) >= 5).cast("int").alias("is_weekend"), (F.last_day(day) == day).cast("int").alias("is_month_end"), F.trunc(day, "MM").alias("month_start_date"),
            *fiscal(day),
        )


def fiscal(day: Column) -> list[Column]:
    month = F.month(day)
    return [
        (F.year(day) - (month < 4).cast("int")).cast("int").alias("fiscal_year"),
        (F.floor(F.pmod(month - 4, F.lit(12)) / 3) + 1).cast("int").alias("fiscal_quarter"),
        month.isin(10, 11).cast("int").alias("is_festive_season"),
    ]


def star(spark: SparkSession, folder: str) -> Star:
    """The schema over a folder: a built warehouse where there is one, else views over order tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/dim_customer")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        from harborline.plans.build import Warehouse

        return Warehouse(spark, folder)
    return Star(spark, folder)


STAR_SQL = """
as_of AS (SELECT max(o_orderdate::DATE) AS d FROM orders),
txn AS (
  SELECT o_orderkey AS txn_id, o_custkey AS customer_key, o_orderdate::DATE AS txn_date, date_trunc('month', o_orderdate)::DATE AS month,
         if(o_orderstatus = 'P', 'credit', 'debit') AS direction, floor(o_totalprice * 100 + 0.5)::BIGINT AS amount_c, o_orderpriority AS channel_code
  FROM orders),
channel(channel_code, is_digital) AS (VALUES ('1-URGENT', 1), ('2-HIGH', 1), ('3-MEDIUM', 0), ('4-NOT SPECIFIED', 0)),
product AS (
  SELECT *, row_number() OVER (ORDER BY product_code) AS product_key
  FROM (SELECT DISTINCT p_brand || '/' || p_type AS product_code, p_brand AS product_name, p_type AS category FROM part)),
firsts AS (
  SELECT customer_key, txn_date AS acquired_date, channel_code AS acquisition_channel
  FROM txn QUALIFY row_number() OVER (PARTITION BY customer_key ORDER BY txn_date, txn_id) = 1),
spread AS (SELECT customer_key, count(*) AS n_orders, count(*) FILTER (channel_code IN ('1-URGENT', '2-HIGH')) AS n_digital FROM txn GROUP BY 1),
cust AS (
  SELECT c_custkey AS customer_key, c_name AS customer_id, c_mktsegment AS segment, n_name AS city, r_name AS state, floor(c_acctbal * 100 + 0.5)::BIGINT AS income_c,
         (18 + c_custkey % 60)::INT AS age, (300 + c_custkey % 601)::INT AS credit_score, acquired_date, acquisition_channel,
         ((year(d) - year(acquired_date)) * 12 + month(d) - month(acquired_date))::INT AS tenure_months, n_digital / n_orders AS digital_engagement
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN firsts ON firsts.customer_key = c_custkey JOIN spread ON spread.customer_key = c_custkey, as_of),
account AS (
  SELECT o_custkey AS customer_key, p_brand || '/' || p_type AS product_code, date_trunc('month', l_shipdate)::DATE AS month,
         sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::BIGINT AS balance_c,
         sum(floor(l_extendedprice * (1 - l_discount) * 0.01::DOUBLE * 100 + 0.5)::BIGINT)::BIGINT AS interest_c,
         sum(floor(l_extendedprice * l_tax * 0.01::DOUBLE * 100 + 0.5)::BIGINT)::BIGINT AS fee_c, interest_c + fee_c AS revenue_c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
latest AS (SELECT max(date_trunc('month', l_shipdate)::DATE) AS m FROM lineitem),
contact AS (
  SELECT *, row_number() OVER w AS contact_sequence,
         coalesce(CASE lag(converted) OVER w WHEN 1 THEN 'success' WHEN 0 THEN 'failure' END, 'nonexistent') AS prior_outcome
  FROM (SELECT json_extract_string(props, '$.k')::INT % 12 AS campaign_key, user_id AS customer_key, ts, event_id, (event_type = 'purchase')::INT AS converted, floor(value * 100 + 0.5)::BIGINT AS cost_c FROM events)
  WINDOW w AS (PARTITION BY campaign_key, customer_key ORDER BY ts, event_id)),
campaign AS (
  SELECT k::INT AS campaign_key, printf('CMP%03d', k) AS campaign_id, (DATE '1995-01-01' + to_months(k::INT))::DATE AS start_date, product_code
  FROM range(12) AS r(k) JOIN product ON product_key = k + 1),
macro AS (
  SELECT year, if(year < (SELECT max(year(l_shipdate)) FROM lineitem), floor(sum(floor(l_tax * 100 + 0.5))::BIGINT / count(*)::DOUBLE * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE, NULL) AS value
  FROM (SELECT year(l_shipdate)::INT AS year, l_tax FROM lineitem) GROUP BY year),
snapshot AS (
  SELECT customer_key, acquired, if(gone, last, NULL) AS churn_date, gone::INT AS churned, 1 - gone::INT AS censored,
         ((year(stop) - year(acquired)) * 12 + month(stop) - month(acquired))::INT AS observed_months, n_transactions
  FROM (SELECT *, last < d - 180 AS gone, if(last < d - 180, last, d) AS stop
        FROM (SELECT customer_key, min(txn_date) AS acquired, max(txn_date) AS last, count(*) AS n_transactions FROM txn GROUP BY 1), as_of))
"""
