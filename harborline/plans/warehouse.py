"""The ten analytical queries over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborline.operators.ranking import globally_ranked, ntile
from harborline.plans.registry import query
from harborline.plans.star import DAYS_PER_MONTH, DEFAULT_RATE, LENDING, STAR_SQL, Star, star, money, to, truncated_months

# The named segments in order of precedence, as conditions on the three scores.
RFM_SEGMENTS = [
    ("Champions", {"r": (4, 5), "f": (4, 5), "m": (4, 5)}),
    ("Loyal", {"r": (3, 5), "f": (3, 5), "m": (4, 5)}),
    ("New / Promising", {"r": (4, 5), "f": (1, 2)}),
    ("At Risk - High Value", {"r": (1, 2), "f": (4, 5), "m": (4, 5)}),
    ("At Risk", {"r": (1, 2), "f": (3, 5)}),
    ("Hibernating", {"r": (1, 2), "f": (1, 2)}),
    ("Big Spenders", {"m": (4, 5)}),
]
HORIZONS = [1, 3, 6, 12, 18, 24, 36]


def sql(body: str) -> str:
    return f"WITH {STAR_SQL}{body}"


def pct(a: Column, b: Column) -> Column:
    """100 a / b to two places, null where b is zero or null."""
    return to(F.try_divide(F.lit(100.0) * a, b.cast("double")))


def r2(x: str, digits: int = 2) -> str:
    return f"(floor(({x}) * {10**digits}.0::DOUBLE + 0.5::DOUBLE) / {10**digits}.0::DOUBLE)"


def p2(a: str, b: str) -> str:
    return r2(f"100.0::DOUBLE * ({a}) / nullif(({b})::DOUBLE, 0)")


def latest_holdings(s: Star) -> DataFrame:
    return s.latest_accounts.groupBy("customer_key").agg(F.count_distinct("product_code").cast("int").alias("n_products"), F.sum("balance_c").alias("balance_c"), F.sum("revenue_c").alias("revenue_c"))


@query("q01_customer_360", sql("""
SELECT c.customer_id, c.segment, c.age, c.city, c.state, c.income_c / 100.0::DOUBLE AS annual_income_inr, c.credit_score, c.acquisition_channel, c.acquired_date, c.tenure_months,
       %s AS digital_engagement, s.churned, s.censored, s.churn_date, s.observed_months,
       coalesce(h.n, 0)::INT AS n_products, coalesce(h.b, 0) / 100.0::DOUBLE AS total_balance_inr, coalesce(h.r, 0) / 100.0::DOUBLE AS monthly_revenue_inr,
       coalesce(t.n, 0)::INT AS n_transactions, coalesce(t.v, 0) / 100.0::DOUBLE AS total_txn_value_inr, %s AS avg_txn_value_inr, t.last AS last_txn_date,
       trunc((d - t.last) / 30.44::DOUBLE)::INT AS months_since_last_txn, coalesce(k.n, 0)::INT AS n_campaign_contacts, coalesce(k.w, 0)::INT AS n_campaign_conversions
FROM cust c LEFT JOIN snapshot s USING (customer_key)
LEFT JOIN (SELECT customer_key, count(DISTINCT product_code) AS n, sum(balance_c)::BIGINT AS b, sum(revenue_c)::BIGINT AS r FROM account, latest WHERE month = m GROUP BY 1) h USING (customer_key)
LEFT JOIN (SELECT customer_key, count(*) AS n, sum(amount_c)::BIGINT AS v, max(txn_date) AS last FROM txn GROUP BY 1) t USING (customer_key)
LEFT JOIN (SELECT customer_key, count(*) AS n, sum(converted)::BIGINT AS w FROM contact GROUP BY 1) k USING (customer_key), as_of
""" % (r2("c.digital_engagement", 4), r2("coalesce(t.v / t.n::DOUBLE, 0) / 100.0::DOUBLE"))))  # fmt: skip
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    txns = s.fact_transaction.groupBy("customer_key").agg(F.count("*").alias("n_txn"), F.sum("amount_c").alias("value_c"), F.max("txn_date").alias("last_txn_date"))
    contacts = s.fact_campaign_contact.groupBy("customer_key").agg(F.count("*").alias("n_contacts"), F.sum("converted").alias("n_won"))
    all_ = s.dim_customer.join(s.fact_customer_snapshot.drop("acquired_date", "n_transactions", "n_products", "balance_c", "revenue_c"), "customer_key", "left")
    for side in (latest_holdings(s), txns, contacts):
        all_ = all_.join(side, "customer_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return all_.select(
        "customer_id", "segment", "age", "city", "state", money("income_c").alias("annual_income_inr"), "credit_score", "acquisition_channel", "acquired_date", "tenure_months",
        to(F.col("digital_engagement"), 4).alias("digital_engagement"), "churned", "censored", "churn_date", "observed_months",
        zero("n_products").alias("n_products"), money(zero("balance_c")).alias("total_balance_inr"), money(zero("revenue_c")).alias("monthly_revenue_inr"),
        zero("n_txn").cast("int").alias("n_transactions"), money(zero("value_c")).alias("total_txn_value_inr"), to(money(F.coalesce(F.col("value_c") / F.col("n_txn"), F.lit(0.0)))).alias("avg_txn_value_inr"), "last_txn_date",
        truncated_months(F.datediff(s.as_of, "last_txn_date")).alias("months_since_last_txn"), zero("n_contacts").cast("int").alias("n_campaign_contacts"), zero("n_won").cast("int").alias("n_campaign_conversions"),
    )


def _segment_sql() -> str:
    cases = [f"WHEN {' AND '.join(f'{k}_score BETWEEN {a} AND {b}' for k, (a, b) in rule.items())} THEN '{name}'" for name, rule in RFM_SEGMENTS]
    return f"CASE {' '.join(cases)} ELSE 'Needs Attention' END"


@query("q02_rfm_segmentation", sql(f""",
seen AS (SELECT customer_key, max(txn_date) AS last_txn_date, (d - max(txn_date))::INT AS recency_days, count(*)::INT AS frequency, sum(amount_c)::BIGINT AS c FROM txn, as_of WHERE direction = 'debit' GROUP BY customer_key, d),
scored AS (SELECT *, ntile(5) OVER (ORDER BY recency_days DESC, customer_key) AS r_score, ntile(5) OVER (ORDER BY frequency, customer_key) AS f_score, ntile(5) OVER (ORDER BY c, customer_key) AS m_score FROM seen)
SELECT customer_id, segment, city, acquisition_channel, last_txn_date, recency_days, frequency, c / 100.0::DOUBLE AS monetary_inr, r_score::INT AS r_score, f_score::INT AS f_score, m_score::INT AS m_score,
       concat(r_score, f_score, m_score) AS rfm_cell, (r_score + f_score + m_score)::INT AS rfm_total, {_segment_sql()} AS rfm_segment, churned
FROM scored JOIN cust USING (customer_key) LEFT JOIN snapshot USING (customer_key)"""))  # fmt: skip
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    seen = s.fact_transaction.where("direction = 'debit'").groupBy("customer_key").agg(F.max("txn_date").alias("last_txn_date"), F.count("*").cast("int").alias("frequency"), F.sum("amount_c").alias("c"))
    seen = seen.withColumn("recency_days", F.datediff(s.as_of, "last_txn_date"))
    base = seen.cache()
    n = base.agg(F.count("*")).scalar()
    for name, key in (("r_score", -F.col("recency_days")), ("f_score", F.col("frequency")), ("m_score", F.col("c"))):
        seen = globally_ranked(seen, key, "customer_key", "rn", base=base).withColumn(name, ntile(F.col("rn"), n, 5)).drop("rn")
    segment = F.lit("Needs Attention")
    for name, rule in reversed(RFM_SEGMENTS):
        fits = F.lit(True)
        for k, (a, b) in rule.items():
            fits = fits & F.col(f"{k}_score").between(a, b)
        segment = F.when(fits, name).otherwise(segment)
    scores = [F.col(f"{k}_score") for k in "rfm"]
    out = seen.join(s.dim_customer, "customer_key").join(s.fact_customer_snapshot.select("customer_key", "churned"), "customer_key", "left")
    return out.select("customer_id", "segment", "city", "acquisition_channel", "last_txn_date", "recency_days", "frequency", money("c").alias("monetary_inr"), *scores, F.concat(*[x.cast("string") for x in scores]).alias("rfm_cell"), sum(scores[1:], scores[0]).alias("rfm_total"), segment.alias("rfm_segment"), "churned")


@query("q03_revenue_trend", sql(f""",
monthly AS (SELECT month, count(DISTINCT customer_key)::INT AS n, sum(balance_c)::BIGINT AS b, sum(interest_c)::BIGINT AS i, sum(fee_c)::BIGINT AS f, sum(revenue_c)::BIGINT AS r FROM account GROUP BY month)
SELECT month, n AS n_customers, b / 100.0::DOUBLE AS balance_inr, i / 100.0::DOUBLE AS interest_revenue_inr, f / 100.0::DOUBLE AS fee_revenue_inr, r / 100.0::DOUBLE AS total_revenue_inr,
       {r2("r / n::DOUBLE / 100.0::DOUBLE")} AS revenue_per_customer_inr, lag(r) OVER w / 100.0::DOUBLE AS prev_month_revenue, {p2("r - lag(r) OVER w", "lag(r) OVER w")} AS mom_pct,
       lag(r, 12) OVER w / 100.0::DOUBLE AS prev_year_revenue, {p2("r - lag(r, 12) OVER w", "lag(r, 12) OVER w")} AS yoy_pct,
       {r2("(sum(r) OVER a)::BIGINT / (count(*) OVER a)::DOUBLE / 100.0::DOUBLE")} AS revenue_ma3, {r2("(sum(r) OVER b)::BIGINT / (count(*) OVER b)::DOUBLE / 100.0::DOUBLE")} AS revenue_ma12,
       (sum(r) OVER w)::BIGINT / 100.0::DOUBLE AS cumulative_revenue_inr, (year(month) - (month(month) < 4)::INT)::INT AS fiscal_year, ((month(month) + 8) % 12 // 3 + 1)::INT AS fiscal_quarter, (month(month) IN (10, 11))::INT AS is_festive_season
FROM monthly WINDOW w AS (ORDER BY month), a AS (ORDER BY month ROWS 2 PRECEDING), b AS (ORDER BY month ROWS 11 PRECEDING) ORDER BY month"""))  # fmt: skip
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    monthly = s.fact_monthly_account.groupBy("month").agg(F.count_distinct("customer_key").cast("int").alias("n_customers"), *[F.sum(f"{c}_c").alias(c) for c in ("balance", "interest", "fee", "revenue")])
    calendar = s.dates.select(F.col("full_date").alias("month"), "fiscal_year", "fiscal_quarter", "is_festive_season")
    monthly = monthly.join(F.broadcast(calendar), "month", "left")  # a row for each day of the calendar
    by = Window.orderBy("month")  # one row per calendar month
    r = F.col("revenue")
    mean = lambda k: to(F.sum(r).over(by.rowsBetween(-k, 0)) / F.count("*").over(by.rowsBetween(-k, 0)) / 100.0)
    prev, year = F.lag(r).over(by), F.lag(r, 12).over(by)
    return monthly.select(
        "month", "n_customers", money("balance").alias("balance_inr"), money("interest").alias("interest_revenue_inr"), money("fee").alias("fee_revenue_inr"), money("revenue").alias("total_revenue_inr"), to(r / F.col("n_customers") / 100.0).alias("revenue_per_customer_inr"),
        money(prev).alias("prev_month_revenue"), pct(r - prev, prev).alias("mom_pct"), money(year).alias("prev_year_revenue"), pct(r - year, year).alias("yoy_pct"), mean(2).alias("revenue_ma3"), mean(11).alias("revenue_ma12"), money(F.sum(r).over(by)).alias("cumulative_revenue_inr"), "fiscal_year", "fiscal_quarter", "is_festive_season",
    ).orderBy("month")


@query("q04_product_pareto", sql(f""",
sold AS (SELECT product_code, product_name, category, count(DISTINCT customer_key)::INT AS n, sum(balance_c)::BIGINT AS b, sum(revenue_c)::BIGINT AS r FROM account JOIN product USING (product_code) GROUP BY 1, 2, 3),
placed AS (SELECT *, (sum(r) OVER ())::BIGINT AS total, (sum(r) OVER (ORDER BY r DESC, product_code ROWS UNBOUNDED PRECEDING))::BIGINT AS run, row_number() OVER (ORDER BY r DESC, product_code) AS rank FROM sold)
SELECT rank::INT AS revenue_rank, product_code, product_name, category, n AS n_customers, b / 100.0::DOUBLE AS balance_inr, r / 100.0::DOUBLE AS revenue_inr, {p2("r", "total")} AS revenue_share_pct, run / 100.0::DOUBLE AS running_revenue_inr,
       {p2("run", "total")} AS cumulative_share_pct, (100.0::DOUBLE * run / total::DOUBLE <= 80)::INT AS in_top_80_pct FROM placed ORDER BY 1"""))  # fmt: skip
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    sold = s.fact_monthly_account.groupBy("product_code").agg(F.count_distinct("customer_key").cast("int").alias("n_customers"), F.sum("balance_c").alias("b"), F.sum("revenue_c").alias("r"))
    sold = sold.join(F.broadcast(s.dim_product), "product_code")
    by = Window.orderBy(F.desc("r"), "product_code")  # one row per product of the catalogue
    total, run = F.sum("r").over(Window.partitionBy()), F.sum("r").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return sold.select(
        F.row_number().over(by).alias("revenue_rank"), "product_code", "product_name", "category", "n_customers", money("b").alias("balance_inr"), money("r").alias("revenue_inr"), pct(F.col("r"), total).alias("revenue_share_pct"), money(run).alias("running_revenue_inr"),
        pct(run, total).alias("cumulative_share_pct"), (F.lit(100.0) * run / total <= 80).cast("int").alias("in_top_80_pct"),
    ).orderBy("revenue_rank")


def _survived(h: int) -> str:
    value = p2(f"count(*) FILTER (survived >= {h})", "count(*)")
    return f"{value} AS m{h:02d}_pct" if h < 12 else f"CASE WHEN max(observed_months) >= {h} THEN {value} END AS m{h:02d}_pct"


@query("q05_cohort_retention", sql(f""",
life AS (SELECT strftime(acquired, '%Y-%m') AS cohort_month, observed_months, churned, if(churned = 1, trunc((churn_date - acquired) / 30.44::DOUBLE)::INT, observed_months) AS survived FROM snapshot)
SELECT cohort_month, count(*)::INT AS cohort_size, {", ".join(map(_survived, HORIZONS))}, max(observed_months) AS max_months_observed, sum(churned)::INT AS n_churned FROM life GROUP BY 1 ORDER BY 1"""))  # fmt: skip
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    lived = F.when(F.col("churned") == 1, truncated_months(F.datediff("churn_date", "acquired_date"))).otherwise(F.col("observed_months"))
    life = s.fact_customer_snapshot.select(F.date_format("acquired_date", "yyyy-MM").alias("cohort_month"), lived.alias("survived"), "observed_months", "churned")

    def share(h: int) -> Column:
        value = pct(F.count_if(F.col("survived") >= h), F.count("*"))
        return (value if h < 12 else F.when(F.max("observed_months") >= h, value)).alias(f"m{h:02d}_pct")

    return life.groupBy("cohort_month").agg(F.count("*").cast("int").alias("cohort_size"), *map(share, HORIZONS), F.max("observed_months").alias("max_months_observed"), F.sum("churned").cast("int").alias("n_churned")).orderBy("cohort_month")


@query("q06_churn_risk", sql(f""",
act AS (SELECT customer_key, trunc((any_value(d) - max(txn_date)) / 30.44::DOUBLE)::INT AS idle, count(*) FILTER (txn_date >= d - INTERVAL 3 MONTH) AS last3, count(*) FILTER (txn_date >= d - INTERVAL 6 MONTH AND txn_date < d - INTERVAL 3 MONTH) AS prior3 FROM txn, as_of GROUP BY 1),
held AS (SELECT customer_key, count(DISTINCT product_code) AS n, sum(balance_c)::BIGINT AS b, sum(revenue_c)::BIGINT AS r FROM account, latest WHERE month = m GROUP BY 1),
facts AS (SELECT customer_id, segment, tenure_months, digital_engagement AS e, coalesce(n, 0)::INT AS n_products, coalesce(b, 0) AS b, coalesce(r, 0) AS r, coalesce(idle, 99)::INT AS months_inactive, coalesce(last3, 0)::INT AS l, coalesce(prior3, 0)::INT AS p
          FROM cust JOIN snapshot USING (customer_key) LEFT JOIN act USING (customer_key) LEFT JOIN held USING (customer_key) WHERE churned = 0),
flags AS (SELECT *, (months_inactive >= 3)::INT AS f1, (n_products <= 1)::INT AS f2, (tenure_months <= 6)::INT AS f3, (e < 0.25)::INT AS f4, (b < 2500000)::INT AS f5, (p > 0 AND l < p * 0.5)::INT AS f6, f1 + f2 + f3 + f4 + f5 + f6 AS s FROM facts)
SELECT customer_id, segment, tenure_months, n_products, b / 100.0::DOUBLE AS total_balance_inr, r / 100.0::DOUBLE AS monthly_revenue_inr, months_inactive, l AS txn_last_3m, p AS txn_prior_3m, f1 AS flag_inactive, f2 AS flag_single_product, f3 AS flag_new_customer, f4 AS flag_low_digital,
       f5 AS flag_low_balance, f6 AS flag_declining_activity, s::INT AS risk_score, if(s >= 4, 'High', if(s >= 2, 'Medium', 'Low')) AS risk_band, r * 12 / 100.0::DOUBLE AS annual_revenue_at_risk_inr FROM flags"""))  # fmt: skip
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    day, three, six = F.col("txn_date"), F.add_months(s.as_of, -3), F.add_months(s.as_of, -6)
    acts = s.fact_transaction.groupBy("customer_key").agg(F.max(day).alias("last"), F.count_if(day >= three).alias("last3"), F.count_if((day >= six) & (day < three)).alias("prior3"))
    left = s.dim_customer.join(s.fact_customer_snapshot.where("churned = 0").select("customer_key"), "customer_key").join(acts, "customer_key", "left").join(latest_holdings(s), "customer_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    facts = left.select("customer_id", "segment", "tenure_months", "digital_engagement", zero("n_products").alias("n_products"), F.coalesce("balance_c", F.lit(0)).alias("b"), F.coalesce("revenue_c", F.lit(0)).alias("r"), F.coalesce(truncated_months(F.datediff(s.as_of, "last")), F.lit(99)).alias("months_inactive"), zero("last3").alias("txn_last_3m"), zero("prior3").alias("txn_prior_3m"))
    flags = {
        "flag_inactive": F.col("months_inactive") >= 3,
        "flag_single_product": F.col("n_products") <= 1,
        "flag_new_customer": F.col("tenure_months") <= 6,
        "flag_low_digital": F.col("digital_engagement") < 0.25,
        "flag_low_balance": F.col("b") < 2_500_000,
        "flag_declining_activity": (F.col("txn_prior_3m") > 0) & (F.col("txn_last_3m") < F.col("txn_prior_3m") * 0.5),
    }
    flagged = facts.select("*", *[f.cast("int").alias(n) for n, f in flags.items()])
    score = sum((F.col(n) for n in flags), F.lit(0))
    band = F.when(score >= 4, "High").when(score >= 2, "Medium").otherwise("Low")
    out = flagged.select("customer_id", "segment", "tenure_months", "n_products", money("b").alias("total_balance_inr"), money("r").alias("monthly_revenue_inr"), "months_inactive", "txn_last_3m", "txn_prior_3m", *flags, score.alias("risk_score"), band.alias("risk_band"), money(F.col("r") * 12).alias("annual_revenue_at_risk_inr"))
    return out.orderBy(F.desc("risk_score"), F.desc("annual_revenue_at_risk_inr"), "customer_id")


@query("q07_campaign_funnel", sql(f""",
stats AS (SELECT campaign_key, count(*) AS n, count(DISTINCT customer_key) AS reach, sum(converted)::BIGINT AS won, sum(cost_c)::BIGINT AS cost, sum(contact_sequence)::BIGINT AS seq,
                 count(*) FILTER (contact_sequence = 1) AS n1, count(*) FILTER (contact_sequence = 1 AND converted = 1) AS w1, count(*) FILTER (prior_outcome = 'success') AS n2, count(*) FILTER (prior_outcome = 'success' AND converted = 1) AS w2 FROM contact GROUP BY 1),
earned AS (SELECT campaign_key, sum(revenue_c)::BIGINT AS r FROM contact JOIN campaign USING (campaign_key) JOIN account USING (customer_key, product_code), latest WHERE converted = 1 AND month = m GROUP BY 1)
SELECT campaign_id, product_code, start_date, n::INT AS n_contacts, reach::INT AS n_customers_reached, won::INT AS n_conversions, {r2("seq / n::DOUBLE")} AS avg_contacts_per_customer, {p2("won", "n")} AS conversion_rate_per_contact_pct, {p2("won", "reach")} AS conversion_rate_per_customer_pct,
       {p2("w1", "n1")} AS first_contact_conversion_pct, {p2("w2", "n2")} AS repeat_buyer_conversion_pct, cost / 100.0::DOUBLE AS total_cost_inr, {r2("cost / nullif(won, 0)::DOUBLE / 100.0::DOUBLE")} AS cost_per_acquisition_inr,
       coalesce(r, 0) * 12 / 100.0::DOUBLE AS attributed_annual_revenue_inr, {p2("coalesce(r, 0) * 12 - cost", "cost")} AS roi_pct FROM campaign JOIN stats USING (campaign_key) LEFT JOIN earned USING (campaign_key)"""))  # fmt: skip
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    first, again, won = F.col("contact_sequence") == 1, F.col("prior_outcome") == "success", F.col("converted") == 1
    stats = s.fact_campaign_contact.groupBy("campaign_key").agg(
        F.count("*").cast("int").alias("n_contacts"), F.count_distinct("customer_key").cast("int").alias("n_customers_reached"), F.sum("converted").cast("int").alias("n_conversions"), F.sum("cost_c").alias("cost"), F.sum("contact_sequence").alias("seq"), F.count_if(first).alias("n1"), F.count_if(first & won).alias("w1"), F.count_if(again).alias("n2"), F.count_if(again & won).alias("w2")
    )
    accounts = s.latest_accounts.select("customer_key", "product_code", "revenue_c")
    earned = s.fact_campaign_contact.where(won).join(F.broadcast(s.dim_campaign), "campaign_key").join(accounts, ["customer_key", "product_code"]).groupBy("campaign_key").agg(F.sum("revenue_c").alias("r"))
    out = s.dim_campaign.join(stats, "campaign_key").join(earned, "campaign_key", "left")
    c, r = F.col, F.coalesce("r", F.lit(0)) * 12
    return out.select(
        "campaign_id", "product_code", "start_date", "n_contacts", "n_customers_reached", "n_conversions", to(c("seq") / c("n_contacts")).alias("avg_contacts_per_customer"), pct(c("n_conversions"), c("n_contacts")).alias("conversion_rate_per_contact_pct"), pct(c("n_conversions"), c("n_customers_reached")).alias("conversion_rate_per_customer_pct"),
        pct(c("w1"), c("n1")).alias("first_contact_conversion_pct"), pct(c("w2"), c("n2")).alias("repeat_buyer_conversion_pct"), money("cost").alias("total_cost_inr"), to(F.try_divide(c("cost").cast("double"), c("n_conversions")) / 100.0).alias("cost_per_acquisition_inr"), money(r).alias("attributed_annual_revenue_inr"), pct(r - c("cost"), c("cost")).alias("roi_pct"),
    ).orderBy(F.desc("roi_pct"))


@query("q08_channel_rollup", sql(f"""
SELECT CASE grouping_id(a, x) WHEN 0 THEN 'acquisition_x_txn' WHEN 1 THEN 'acquisition' WHEN 2 THEN 'transaction' ELSE 'total' END AS level, a AS acquisition_channel, x AS txn_channel, count(DISTINCT customer_key)::INT AS n_customers, count(*)::INT AS n_transactions,
       sum(amount_c)::BIGINT / 100.0::DOUBLE AS total_value_inr, {r2("sum(amount_c)::BIGINT / count(*)::DOUBLE / 100.0::DOUBLE")} AS avg_txn_value_inr, {p2("sum(is_digital)::BIGINT", "count(*)")} AS digital_share_pct,
       {r2("count(*) / count(DISTINCT customer_key)::DOUBLE")} AS txns_per_customer, {r2("sum(amount_c)::BIGINT / count(DISTINCT customer_key)::DOUBLE / 100.0::DOUBLE")} AS value_per_customer_inr
FROM (SELECT t.customer_key, amount_c, acquisition_channel AS a, h.channel_code AS x, is_digital FROM txn t JOIN cust USING (customer_key) LEFT JOIN channel h ON h.channel_code = t.channel_code) GROUP BY GROUPING SETS ((a, x), (a), (x), ())"""))  # fmt: skip
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    channel = s.dim_channel.select("channel_code", F.col("channel_code").alias("txn_channel"), "is_digital")
    base = s.fact_transaction.join(s.dim_customer.select("customer_key", "acquisition_channel"), "customer_key").join(F.broadcast(channel), "channel_code", "left")
    a, x = F.col("acquisition_channel"), F.col("txn_channel")
    sets = base.groupingSets([[a, x], [a], [x], []], a, x).agg(F.grouping_id().alias("g"), F.count_distinct("customer_key").alias("n"), F.count("*").alias("k"), F.sum("amount_c").alias("v"), F.sum("is_digital").alias("d"))
    level = F.when(F.col("g") == 0, "acquisition_x_txn").when(F.col("g") == 1, "acquisition").when(F.col("g") == 2, "transaction").otherwise("total")
    n, k, v = F.col("n"), F.col("k"), F.col("v")
    out = sets.select(level.alias("level"), a, x, n.cast("int").alias("n_customers"), k.cast("int").alias("n_transactions"), money("v").alias("total_value_inr"), to(v / k / 100.0).alias("avg_txn_value_inr"), pct(F.col("d"), k).alias("digital_share_pct"), to(k / n).alias("txns_per_customer"), to(v / n / 100.0).alias("value_per_customer_inr"), F.col("g"))
    return out.orderBy(F.desc("g"), F.desc("total_value_inr")).drop("g")


@query("q09_clv_deciles", sql(f""",
rate AS (SELECT coalesce((SELECT value FROM macro WHERE value IS NOT NULL ORDER BY year DESC LIMIT 1), {DEFAULT_RATE}::DOUBLE) / 100 / 12 AS i),
paid AS (SELECT customer_key, sum(revenue_c)::BIGINT AS r, count(DISTINCT month) AS n FROM account GROUP BY 1),
future AS (SELECT customer_id, segment, city, acquisition_channel, income_c, tenure_months, churned, observed_months, r, r / n::DOUBLE / 100.0::DOUBLE AS avg, if(churned = 1, 0, least(120, 12 + observed_months * 1.5::DOUBLE)) AS months, customer_key, i
           FROM cust JOIN paid USING (customer_key) JOIN snapshot USING (customer_key), rate),
valued AS (SELECT *, if(months > 0, {r2("avg * (1 - pow(1 + i, -months)) / i")}, 0) AS efv, floor(r + efv * 100 + 0.5)::BIGINT AS total_c FROM future),
placed AS (SELECT *, ntile(10) OVER (ORDER BY total_c DESC, customer_key) AS dec, cume_dist() OVER (ORDER BY total_c) AS cd, (sum(total_c) OVER (ORDER BY total_c DESC, customer_key ROWS UNBOUNDED PRECEDING))::BIGINT AS run, (sum(total_c) OVER ())::BIGINT AS total,
                  ntile(10) OVER (PARTITION BY churned ORDER BY total_c DESC, customer_key) AS adec FROM valued)
SELECT customer_id, segment, city, acquisition_channel, income_c / 100.0::DOUBLE AS annual_income_inr, tenure_months, churned, observed_months, r / 100.0::DOUBLE AS lifetime_revenue_to_date_inr, {r2("avg")} AS avg_monthly_revenue_inr, months::DOUBLE AS expected_remaining_months, efv::DOUBLE AS expected_future_value_inr,
       total_c / 100.0::DOUBLE AS total_clv_inr, dec::INT AS clv_decile, {r2("cd", 4)} AS clv_percentile, {r2("100.0::DOUBLE * total_c / total::DOUBLE", 4)} AS share_of_total_clv_pct, run / 100.0::DOUBLE AS running_clv_inr, {p2("run", "total")} AS cumulative_clv_share_pct, 1 - churned AS is_active, if(churned = 0, adec, NULL)::INT AS active_clv_decile FROM placed"""))  # fmt: skip
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    known = s.ref_macro_indicator.where((F.col("indicator") == LENDING) & F.col("value").isNotNull()).agg(F.coalesce(F.max_by("value", "year"), F.lit(DEFAULT_RATE))).scalar()
    paid = s.monthly_revenue.groupBy("customer_key").agg(F.sum("revenue_c").alias("r"), F.count("month").alias("n"))
    months = F.when(F.col("churned") == 1, F.lit(0.0)).otherwise(F.least(F.lit(120.0), 12 + F.col("observed_months") * 1.5))
    snap = s.fact_customer_snapshot.select("customer_key", "churned", "observed_months", months.alias("months"))
    rows = s.dim_customer.join(paid, "customer_key").join(snap, "customer_key").withColumn("avg", F.col("r") / F.col("n") / 100.0).withColumn("i", known / 100 / 12)
    annuity = to(F.col("avg") * (1 - F.pow(1 + F.col("i"), -F.col("months"))) / F.col("i"))
    rows = rows.withColumn("efv", F.when(F.col("months") > 0, annuity).otherwise(0.0)).withColumn("total_c", F.floor(F.col("r") + F.col("efv") * 100 + 0.5).cast("bigint"))
    base = rows.cache()
    sums = base.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col("churned") == 0).alias("active"), F.sum("total_c").alias("total"))).scalar()
    rows = globally_ranked(rows, -F.col("total_c"), "customer_key", "rn", {"run": "total_c"}, base)
    # rows of equal value share the best rank from above, so cume_dist counts from the worst
    ties = rows.groupBy("total_c").agg(F.min("rn").alias("best"))
    rows = globally_ranked(rows, F.col("churned") * (1 << 60) - F.col("total_c"), "customer_key", "arn", base=base).withColumn("_all", sums)
    rows = rows.join(ties, "total_c")
    n, total = F.col("_all.n"), F.col("_all.total")
    return rows.select(
        "customer_id", "segment", "city", "acquisition_channel", money("income_c").alias("annual_income_inr"), "tenure_months", "churned", "observed_months", money("r").alias("lifetime_revenue_to_date_inr"), to(F.col("avg")).alias("avg_monthly_revenue_inr"), F.col("months").alias("expected_remaining_months"), F.col("efv").alias("expected_future_value_inr"),
        money("total_c").alias("total_clv_inr"), ntile(F.col("rn"), n, 10).alias("clv_decile"), to((n - F.col("best") + 1) / n, 4).alias("clv_percentile"), to(F.lit(100.0) * F.col("total_c") / total.cast("double"), 4).alias("share_of_total_clv_pct"), money("run").alias("running_clv_inr"), pct(F.col("run"), total).alias("cumulative_clv_share_pct"),
        (1 - F.col("churned")).alias("is_active"), F.when(F.col("churned") == 0, ntile(F.col("arn"), F.col("_all.active"), 10)).alias("active_clv_decile"),
    ).orderBy(F.desc("total_clv_inr"), "customer_id")


# Fixed values of the KPI sheet: key, label, format, good direction.
KPIS = [
    ("monthly_revenue_inr", "Monthly Revenue", "currency", "up"),
    ("active_customers", "Active Customers", "integer", "up"),
    ("total_balance_inr", "Balances Under Management", "currency", "up"),
    ("revenue_per_customer_inr", "Revenue per Customer", "currency", "up"),
    ("churn_rate_pct", "Churn Rate", "percent", "down"),
    ("products_per_customer", "Products per Customer", "decimal", "up"),
    ("campaign_conversion_pct", "Campaign Conversion", "percent", "up"),
    ("avg_transaction_value_inr", "Average Transaction Value", "currency", "up"),
]


def _kpi_sql() -> str:
    value = {
        "monthly_revenue_inr": "r{0} / 100.0::DOUBLE", "active_customers": "n{0}::DOUBLE", "total_balance_inr": "b{0} / 100.0::DOUBLE", "revenue_per_customer_inr": "r{0} / n{0}::DOUBLE / 100.0::DOUBLE",
        "churn_rate_pct": "100.0::DOUBLE * (SELECT sum(churned)::BIGINT / count(*)::DOUBLE FROM snapshot)", "products_per_customer": "k{0} / n{0}::DOUBLE", "campaign_conversion_pct": "100.0::DOUBLE * (SELECT sum(converted)::BIGINT / count(*)::DOUBLE FROM contact)", "avg_transaction_value_inr": "(SELECT sum(amount_c)::BIGINT / count(*)::DOUBLE / 100.0::DOUBLE FROM txn WHERE month = m{0})",
    }
    rows = []
    for i, (key, label, kind, good) in enumerate(KPIS, 1):
        now, old = (value[key].format(x) for x in "01") if "{0}" in value[key] else (value[key], "NULL::DOUBLE")
        digits = 3 if kind == "decimal" else 2
        rows.append(f"SELECT {i} AS kpi_order, '{key}' AS kpi_key, '{label}' AS kpi_label, '{kind}' AS kpi_format, {r2(now, digits)} AS current_value, {r2(old, digits)} AS prior_value, {r2(f'100.0::DOUBLE * ({now} - {old}) / ({old})')} AS change_pct, '{good}' AS good_direction FROM sums")
    return " UNION ALL ".join(rows)


@query("q10_executive_kpis", sql(f""",
ends AS (SELECT m AS m0, (SELECT max(month) FROM account, latest WHERE month < m) AS m1 FROM latest),
sums AS (SELECT any_value(m0) AS m0, any_value(m1) AS m1, {", ".join(f"(sum(revenue_c) FILTER (month = m{i}))::BIGINT AS r{i}, (sum(balance_c) FILTER (month = m{i}))::BIGINT AS b{i}, count(*) FILTER (month = m{i}) AS k{i}, count(DISTINCT customer_key) FILTER (month = m{i}) AS n{i}" for i in (0, 1))} FROM account, ends)
{_kpi_sql()}"""))  # fmt: skip
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    accounts = s.fact_monthly_account.groupBy("month").agg(F.sum("revenue_c").alias("r"), F.sum("balance_c").alias("b"), F.count("*").alias("k"), F.count_distinct("customer_key").alias("n"))
    txns = s.fact_transaction.groupBy("month").agg((F.sum("amount_c") / F.count("*") / 100.0).alias("t"))
    both = accounts.join(txns, "month", "left").withColumn("place", F.row_number().over(Window.orderBy(F.desc("month"))))  # a row per month
    two = both.where("place <= 2").agg(*[F.max(F.when(F.col("place") == i + 1, F.col(c))).alias(f"{c}{i}") for i in (0, 1) for c in "rbknt"])
    churn = s.fact_customer_snapshot.agg(F.lit(100.0) * F.sum("churned") / F.count("*")).scalar()
    won = s.fact_campaign_contact.agg(F.lit(100.0) * F.sum("converted") / F.count("*")).scalar()
    c, none = F.col, F.lit(None).cast("double")
    values = [
        *[[f(str(i)) for i in (0, 1)] for f in (lambda i: c("r" + i) / 100.0, lambda i: c("n" + i).cast("double"), lambda i: c("b" + i) / 100.0, lambda i: c("r" + i) / c("n" + i) / 100.0)],
        [churn, none], [c("k0") / c("n0"), c("k1") / c("n1")], [won, none], [c("t0"), c("t1")],
    ]
    rows = [F.struct(F.lit(i).alias("kpi_order"), F.lit(k).alias("kpi_key"), F.lit(label).alias("kpi_label"), F.lit(kind).alias("kpi_format"), to(a, 3 if kind == "decimal" else 2).alias("current_value"), to(b, 3 if kind == "decimal" else 2).alias("prior_value"), to(F.lit(100.0) * (a - b) / b).alias("change_pct"), F.lit(good).alias("good_direction")) for i, ((k, label, kind, good), (a, b)) in enumerate(zip(KPIS, values, strict=True), 1)]
    return two.select(F.explode(F.array(*rows)).alias("x")).select("x.*").orderBy("kpi_order")
