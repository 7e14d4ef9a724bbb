"""One small query per relational operator: joins, aggregates, windows, sets, generators, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborline.plans.registry import query
from harborline.plans.star import Star, cents, fiscal, money, to
from harborline.plans.views import customer_360, monthly_revenue
from harborline.plans.warehouse import r2, sql


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("join_inner_dims", "SELECT r_name, n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    dims = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(spark, d, "customer").join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


@query("join_left_filled", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_events FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON c_custkey = user_id")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    seen = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return read(spark, d, "customer").join(seen, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_events"))


@query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "events"), F.col("c_custkey") == F.col("user_id"), "left_anti").select("c_custkey")


@query("join_cross_scalar", f"SELECT o_orderkey, {r2('100.0::DOUBLE * o_totalprice / t', 6)} AS share_pct FROM orders, (SELECT sum(floor(o_totalprice * 100 + 0.5)::BIGINT)::BIGINT / 100.0::DOUBLE AS t FROM orders)")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    total = orders.agg(F.sum(cents(F.col("o_totalprice")))).scalar()
    return orders.select("o_orderkey", to(F.lit(100.0) * F.col("o_totalprice") / (total / 100.0), 6).alias("share_pct"))


@query("join_interval_liveness", "SELECT o_custkey, count(*)::BIGINT AS n_months FROM (SELECT DISTINCT o_custkey, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) FROM (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)) GROUP BY 1")
def liveness(spark: SparkSession, d: str) -> DataFrame:
    spans = read(spark, d, "orders").groupBy("o_custkey").agg(F.trunc(F.min("o_orderdate"), "MM").alias("a"), F.trunc(F.max("o_orderdate"), "MM").alias("b"))
    return spans.select("o_custkey", F.explode(F.sequence("a", "b", F.expr("interval 1 month")))).groupBy("o_custkey").agg(F.count("*").alias("n_months"))


@query("agg_conditional", "SELECT l_returnflag, count(*)::BIGINT AS n, count(*) FILTER (l_discount > 0.05)::BIGINT AS n_discounted, count(DISTINCT l_suppkey)::BIGINT AS n_suppliers, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_partkey END)::BIGINT AS n_large_parts FROM lineitem GROUP BY 1")
def conditional(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("n_large_parts"))


@query("agg_having_duplicates", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("agg_quantiles", f"SELECT p_type, {r2('quantile_cont(p_retailprice, 0.25)', 6)} AS q25, {r2('quantile_cont(p_retailprice, 0.5)', 6)} AS q50, {r2('quantile_cont(p_retailprice, 0.9)', 6)} AS q90 FROM part GROUP BY 1")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "part").groupBy("p_type").agg(F.percentile("p_retailprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select("p_type", *[to(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q90"))])


@query("agg_weighted_average", f"SELECT l_linestatus, {r2('sum((l_quantity * 100)::BIGINT * (l_discount * 100)::BIGINT)::BIGINT / sum((l_quantity * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE', 6)} AS discount FROM lineitem GROUP BY 1")
def weighted(spark: SparkSession, d: str) -> DataFrame:
    q, x = F.round(F.col("l_quantity") * 100).cast("bigint"), F.round(F.col("l_discount") * 100).cast("bigint")
    return read(spark, d, "lineitem").groupBy("l_linestatus").agg(to(F.sum(q * x) / F.sum(q) / 100.0, 6).alias("discount"))


@query("agg_latest_per_group", "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct("o_orderdate", "o_orderkey", "o_orderstatus")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max(row).alias("r")).select("o_custkey", "r.o_orderkey", "r.o_orderdate", "r.o_orderstatus")


@query("agg_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS F, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS O, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS P FROM orders GROUP BY 1")
def pivot(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("agg_nested", sql(f"SELECT {r2('sum(s)::BIGINT / count(*)::DOUBLE / 100.0::DOUBLE', 4)} AS avg_customer_value FROM (SELECT customer_key, sum(amount_c)::BIGINT AS s FROM txn GROUP BY 1)"))
def nested(spark: SparkSession, d: str) -> DataFrame:
    per = Star(spark, d).fact_transaction.groupBy("customer_key").agg(F.sum("amount_c").alias("s"))
    return per.agg(to(F.sum("s") / F.count("*") / 100.0, 4).alias("avg_customer_value"))


@query("window_lag_frames", "SELECT event_id, user_id, lag(event_id) OVER w AS previous, lag(event_id, 12) OVER w AS twelfth, (count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT AS in_frame, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("event_id", "user_id", F.lag("event_id").over(w).alias("previous"), F.lag("event_id", 12).over(w).alias("twelfth"), F.count("*").over(w.rowsBetween(-2, 0)).alias("in_frame"), F.row_number().over(w).cast("bigint").alias("rn"))


@query("window_running_total", sql("SELECT customer_key, txn_id, (sum(amount_c) OVER (PARTITION BY customer_key ORDER BY txn_date, txn_id ROWS UNBOUNDED PRECEDING))::BIGINT / 100.0::DOUBLE AS running FROM txn"))
def running(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("customer_key").orderBy("txn_date", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    return Star(spark, d).fact_transaction.select("customer_key", "txn_id", money(F.sum("amount_c").over(w)).alias("running"))


@query("window_ntile_cume_dist", f"SELECT p_partkey, ntile(10) OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey)::INT AS decile, {r2('cume_dist() OVER (PARTITION BY p_type ORDER BY p_retailprice)', 6)} AS share FROM part")
def ntile_cume(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_type")
    return read(spark, d, "part").select("p_partkey", F.ntile(10).over(w.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("decile"), to(F.cume_dist().over(w.orderBy("p_retailprice")), 6).alias("share"))


@query("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("set_union_distinct", "SELECT c_nationkey AS k, 'customer' AS side FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 'supplier' FROM supplier GROUP BY 1")
def union(spark: SparkSession, d: str) -> DataFrame:
    one = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("side")).distinct()
    return one.unionByName(read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("side")).distinct())


@query("generate_date_dimension", """SELECT year(d) * 10000 + month(d) * 100 + day(d) AS date_key, d AS full_date, year(d) AS year, quarter(d) AS quarter, month(d) AS month, strftime(d, '%B') AS month_name, day(d) AS day, isodow(d) - 1 AS day_of_week, strftime(d, '%A') AS day_name, weekofyear(d) AS week_of_year,
(isodow(d) >= 6)::INT AS is_weekend, (last_day(d) = d)::INT AS is_month_end, date_trunc('month', d)::DATE AS month_start_date, year(d) - (month(d) < 4)::INT AS fiscal_year, (month(d) + 8) % 12 // 3 + 1 AS fiscal_quarter, (month(d) IN (10, 11))::INT AS is_festive_season
FROM (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::DATE AS d)""")
def dates(spark: SparkSession, d: str) -> DataFrame:
    first, last = read(spark, d, "orders").agg(F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))).first()
    return Star(spark, d).dim_date(str(first), str(last))


@query("generate_repeat_rows", "SELECT s_suppkey, i::INT AS i FROM supplier, range(1, s_suppkey % 4 + 1) AS r(i)")
def repeat(spark: SparkSession, d: str) -> DataFrame:
    n = F.pmod(F.col("s_suppkey"), F.lit(4)).cast("int")
    return read(spark, d, "supplier").where(n > 0).select("s_suppkey", F.explode(F.sequence(F.lit(1), n)).alias("i"))


@query("function_dates", "SELECT o_orderkey, (o_orderdate::DATE - DATE '1995-01-01')::INT AS days, trunc((o_orderdate::DATE - DATE '1995-01-01') / 30.44::DOUBLE)::INT AS months, strftime(o_orderdate, '%Y-%m') AS ym, (o_orderdate::DATE - INTERVAL 3 MONTH)::DATE AS three_before, year(o_orderdate) - (month(o_orderdate) < 4)::INT AS fiscal_year, (month(o_orderdate) + 8) % 12 // 3 + 1 AS fiscal_quarter, (month(o_orderdate) IN (10, 11))::INT AS is_festive_season FROM orders")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    days = F.datediff(day, F.lit("1995-01-01").cast("date"))
    return read(spark, d, "orders").select("o_orderkey", days.alias("days"), (days / 30.44).cast("int").alias("months"), F.date_format(day, "yyyy-MM").alias("ym"), F.add_months(day, -3).alias("three_before"), *fiscal(day))


@query("function_strings", "SELECT p_partkey, lower(trim(p_name)) AS name, p_brand || '-' || p_size AS code, TRY_CAST(replace(p_size || ',000', ',', '') AS DOUBLE) AS number, regexp_matches(p_name, '^[A-Za-z]') AS starts_with_letter FROM part")
def strings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("name"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("code"), F.regexp_replace(F.concat(F.col("p_size").cast("string"), F.lit(",000")), ",", "").try_cast("double").alias("number"), F.col("p_name").rlike("^[A-Za-z]").alias("starts_with_letter"))


@query("function_bins", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'S' WHEN p_size <= 25 THEN 'M' ELSE 'L' END AS bin, CASE WHEN p_retailprice > 1500 THEN p_retailprice END AS high_price, least(p_size, 20)::INT AS capped, CASE p_type WHEN 'STANDARD' THEN 0 ELSE 1 END AS sort_key FROM part")
def bins(spark: SparkSession, d: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return read(spark, d, "part").select("p_partkey", F.when(size <= 10, "S").when(size <= 25, "M").otherwise("L").alias("bin"), F.when(price > 1500, price).alias("high_price"), F.least(size, F.lit(20)).cast("int").alias("capped"), F.when(F.col("p_type") == "STANDARD", 0).otherwise(1).alias("sort_key"))


@query("json_map_entries", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_entries(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("constraint_orphans", "SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))::BIGINT AS orders_without_customer, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))::BIGINT AS lines_without_order, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders)::BIGINT AS repeated_orders")
def orphans(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem")
    a = orders.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count("*")).scalar()
    b = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*")).scalar()
    return orders.agg(a.alias("orders_without_customer"), b.alias("lines_without_order"), (F.count("*") - F.count_distinct("o_orderkey")).alias("repeated_orders"))


@query("view_monthly_revenue", sql("SELECT month, category, product_code, product_name, segment, count(DISTINCT customer_key)::BIGINT AS n_customers, sum(balance_c)::BIGINT / 100.0::DOUBLE AS balance_inr, sum(interest_c)::BIGINT / 100.0::DOUBLE AS interest_revenue_inr, sum(fee_c)::BIGINT / 100.0::DOUBLE AS fee_revenue_inr, sum(revenue_c)::BIGINT / 100.0::DOUBLE AS total_revenue_inr FROM account JOIN product USING (product_code) JOIN cust USING (customer_key) GROUP BY ALL"))
def monthly_view(spark: SparkSession, d: str) -> DataFrame:
    return monthly_revenue(Star(spark, d)).drop("customers")


@query("view_customer_360", sql("""SELECT customer_id, c.segment, city, state, age, CASE WHEN age <= 25 THEN '<25' WHEN age <= 35 THEN '25-34' WHEN age <= 45 THEN '35-44' WHEN age <= 55 THEN '45-54' WHEN age <= 65 THEN '55-64' ELSE '65+' END AS age_band, income_c / 100.0::DOUBLE AS annual_income_inr, credit_score, acquisition_channel, acquired_date, tenure_months, digital_engagement,
 churned, censored, churn_date, observed_months, coalesce(n, 0)::INT AS n_products, coalesce(b, 0) / 100.0::DOUBLE AS total_balance_inr, coalesce(r, 0) / 100.0::DOUBLE AS total_revenue_inr, n_transactions
 FROM cust c LEFT JOIN snapshot s USING (customer_key) LEFT JOIN (SELECT customer_key, count(DISTINCT product_code) AS n, sum(balance_c)::BIGINT AS b, sum(revenue_c)::BIGINT AS r FROM account, latest WHERE month = m GROUP BY 1) USING (customer_key)"""))
def customer_view(spark: SparkSession, d: str) -> DataFrame:
    return customer_360(Star(spark, d))
