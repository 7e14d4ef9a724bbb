"""The two views of the schema, over any star: a built warehouse or the views over order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.plans.star import Star, money
from harborline.plans.warehouse import latest_holdings

OF_CUSTOMER = ["customer_id", "segment", "city", "state", "age", "age_band", "job", "annual_income_inr", "credit_score", "acquisition_channel", "acquired_date", "tenure_months", "digital_engagement"]
GRAIN = ["month", "category", "product_code", "product_name", "segment"]


def customer_360(s: Star) -> DataFrame:
    """v_customer_360: every customer with its snapshot, if it has one; columns that a star lacks are left out."""
    snapshot = s.fact_customer_snapshot.drop("acquired_date")
    if "n_products" not in snapshot.columns:
        held = latest_holdings(s)
        snapshot = snapshot.join(held, "customer_key", "left").na.fill(0, ["n_products", "balance_c", "revenue_c"])
    who = s.dim_customer.withColumn("annual_income_inr", money("income_c"))
    kept = [c for c in OF_CUSTOMER if c in who.columns]
    both = who.select("customer_key", *kept).join(snapshot, "customer_key", "left")
    return both.select(*kept, "churned", "censored", "churn_date", "observed_months", "n_products", money("balance_c").alias("total_balance_inr"), money("revenue_c").alias("total_revenue_inr"), "n_transactions")


def monthly_revenue(s: Star) -> DataFrame:
    """v_monthly_revenue by month, product and segment: customers, a mergeable sketch of them, balance and revenue.

    Counts of distinct customers do not add up over products or segments; ``customers`` does (``rolled_up``).
    """
    rows = s.fact_monthly_account.join(s.dim_product.select("product_code", "product_name", "category"), "product_code").join(s.dim_customer.select("customer_key", "segment"), "customer_key")
    sums = {"balance_inr": "balance_c", "interest_revenue_inr": "interest_c", "fee_revenue_inr": "fee_c", "total_revenue_inr": "revenue_c"}
    return rows.groupBy(*GRAIN).agg(F.count_distinct("customer_key").alias("n_customers"), F.hll_sketch_agg("customer_key", F.lit(14)).alias("customers"), *[money(F.sum(c)).alias(n) for n, c in sums.items()])


def rolled_up(view: DataFrame, *by: str | Column) -> DataFrame:
    """``v_monthly_revenue`` at a coarser grain: sums, and the number of customers to within about a hundredth."""
    sums = [F.sum(c).alias(c) for c in ("balance_inr", "interest_revenue_inr", "fee_revenue_inr", "total_revenue_inr")]
    return view.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("n_customers"), *sums)
