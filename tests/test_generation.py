from datetime import date

import pytest
from pyspark.sql import functions as F

from harborline.operators import generation as G


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("book"))
    w = G.Window(date(2023, 1, 1), date(2026, 6, 30))
    sizes = G.generate_all(spark, 600, G.Profile(), w, out)
    return sizes, {n: spark.read.parquet(f"{out}/{n}") for n in sizes}, w


def test_grain_and_references(book):
    sizes, t, w = book
    assert sizes["customers"] == 600 and sizes["products"] == 12 and min(sizes.values()) > 0
    for name, keys in {"customers": ["customer_id"], "holdings": ["customer_id", "product_code"], "churn_panel": ["customer_id", "month"], "churn_outcomes": ["customer_id"], "transactions": ["txn_id"], "monthly_snapshots": ["customer_id", "product_code", "month"], "campaign_contacts": ["campaign_id", "customer_id", "contact_sequence"]}.items():
        assert t[name].groupBy(*keys).count().where("count > 1").count() == 0, name
        if name != "customers":
            assert t[name].join(t["customers"], "customer_id", "left_anti").count() == 0


def test_customers_and_holdings(book):
    _, t, w = book
    c = t["customers"]
    assert c.where((F.col("age") < 18) | (F.col("credit_score") < 300) | (F.col("credit_score") > 900) | (F.col("annual_income_inr") <= 0)).count() == 0
    assert c.where((F.col("acquired_date") < str(w.start)) | (F.col("acquired_date") > str(w.end))).count() == 0
    h = t["holdings"]
    assert h.join(c, "customer_id").where("opened_date < acquired_date").count() == 0
    assert h.select("customer_id").join(h.where("product_code = 'SAV'"), "customer_id", "left_anti").count() == 0


def test_churn_is_censored_or_dated(book):
    _, t, w = book
    o = t["churn_outcomes"]
    assert o.where("churned + censored != 1 or (churned = 1) != (churn_date is not null)").count() == 0
    assert 0.05 < o.agg(F.avg("churned")).first()[0] < 0.9
    rate = t["churn_panel"].groupBy((F.col("month") >= "2025-03-01").alias("late")).agg(F.avg("hazard").alias("h")).collect()
    assert {r.late: r.h for r in rate}[True] > {r.late: r.h for r in rate}[False]
    gone = t["transactions"].join(o.where("churned = 1"), "customer_id")
    assert gone.where("month >= trunc(churn_date, 'MM')").count() == 0


def test_campaigns_remember(book):
    _, t, w = book
    k = t["campaign_contacts"]
    assert k.where("converted = 1").join(k.select("campaign_id", "customer_id", F.col("contact_sequence").alias("s")), ["campaign_id", "customer_id"]).where("s > contact_sequence").count() == 0
    assert k.join(t["holdings"], ["customer_id", "product_code"], "left_semi").count() == 0
    assert k.where("response_probability < 0.001 or response_probability > 0.85").count() == 0


def test_same_seed_same_book(spark, book):
    _, t, w = book
    again = G.generate_customers(spark, 600, G.Profile(), w).repartition(7)
    assert again.exceptAll(t["customers"]).count() == 0
    assert G.generate_customers(spark, 600, G.Profile(seed=1), w).exceptAll(t["customers"]).count() > 500


def test_calibration(spark):
    df = spark.range(2000).select(G.lognormal(2.0, 0.5, 1, "x", F.col("id")).alias("x"), (F.col("id") % 3).alias("g"), F.col("id").alias("d"), (F.col("id") > 1000).cast("int").alias("y"))
    fit = G.fit_lognormal(df, "x")
    assert fit["mu"] == pytest.approx(2.0, abs=0.05) and fit["sigma"] == pytest.approx(0.5, abs=0.05)
    with pytest.raises(G.CalibrationError):
        G.fit_lognormal(df.limit(5), "x")
    assert G.joint_demographics(df, ["g"]).agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert G.macro_elasticity(df, "d", "y") > 0
    env = {"ROA": (1.1, 1.3, 1.7), "NIMY": (3.7, 4.0, 4.2)}
    assert G.assert_calibrated({"ROA": 1.34, "NIMY": 4.02, "X": 1.0}, env) == {"ROA": "inside", "NIMY": "inside", "X": "unchecked"}
    with pytest.raises(G.CalibrationError):
        G.assert_calibrated({"ROA": 9.9}, env)
    n = spark.range(4000).select(G.poisson(G.uniform(1, "p", F.col("id")), F.lit(3.0)).alias("k"), G.beta(1.4, 3.0, 1, "b", F.col("id")).alias("b")).agg(F.avg("k"), F.variance("k"), F.avg("b")).first()
    assert n[0] == pytest.approx(3, abs=0.15) and n[1] == pytest.approx(3, abs=0.3) and n[2] == pytest.approx(1.4 / 4.4, abs=0.02)


def test_draws_beyond_any_cap(spark):
    """Poisson far beyond 60 and beyond where exp(-mean) is a number, geometric beyond 8, beta against its moments."""
    rows = spark.range(3000)
    for mean in (0.02, 3.0, 90.0, 300.0, 2000.0):
        r = rows.select(G.poisson_draw(F.lit(mean), 1, "p", F.col("id")).alias("k")).agg(F.avg("k"), F.variance("k"), F.max("k")).first()
        assert r[0] == pytest.approx(mean, abs=5 * (mean / 3000) ** 0.5) and r[1] == pytest.approx(mean, rel=0.15 if mean > 1 else 0.5) and (mean < 1 or r[2] > mean + 2 * mean**0.5)
    extreme = spark.range(1).select(G.poisson(F.lit(1 - 2.0**-53), F.lit(50.0)).alias("k"), G.geometric(F.lit(2.0**-53), 0.55).alias("g"), G.geometric(F.lit(0.999), 0.55).alias("one")).first()
    assert 110 < extreme.k < 150 and extreme.g == 47 and extreme.one == 1
    g = rows.select(G.geometric(G.uniform(2, "g", F.col("id")), 0.2).alias("k")).agg(F.avg("k"), F.variance("k")).first()
    assert g[0] == pytest.approx(5, abs=0.4) and g[1] == pytest.approx(20, rel=0.2)
    a, b = 1.4, 3.0
    x = sorted(r.x for r in spark.range(4000).select(G.beta(a, b, 3, "b", F.col("id")).alias("x")).collect())
    assert max(abs(G.betainc(a, b, v) - (i + 0.5) / 4000) for i, v in enumerate(x)) < 1.63 / 4000**0.5 and 0 < x[0] and x[-1] < 1


def test_ground_truth_lies_beside_the_tables(spark, book, tmp_path):
    sizes, t, w = book
    path = t["customers"].inputFiles()[0].rsplit("/", 2)[0]
    truth = spark.read.json(f"{path}/ground_truth").collect()
    assert len(truth) == 1 and truth[0].hazard_coefficients.frailty_sigma == G.FRAILTY_SIGMA and truth[0].row_counts.customers == 600
    assert "ground_truth" not in sizes and not any("frailty_sigma" in df.columns for df in t.values())
