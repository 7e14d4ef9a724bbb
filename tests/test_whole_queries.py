"""Queries run their operator's whole job."""

import random

from pyspark.sql import functions as F

import __spark_entry__
from harborline.operators.ranking import _place
from harborline.plans.star import star
from tests.oracle import check


def test_kmeans_uses_every_dimension(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        x = [rng.gauss(0, 0.1) for _ in range(64)]
        x[10 + i % 4] += 9.0
        rows.append((i, x))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.cluster for r in __spark_entry__.queries()["kmeans_embeddings"](spark, str(tmp_path)).collect()}
    assert len({got[i] for i in range(4)}) == 4 and all(got[i] == got[i % 4] for i in got)


def test_orders_without_a_customer_are_a_test_too(spark, tmp_path):
    spark.createDataFrame([(i, None if i % 7 == 0 else i % 50) for i in range(1, 300)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    (tmp_path / "sql").mkdir()
    spark.read.parquet(f"{tmp_path}/orders.parquet").toPandas().to_parquet(f"{tmp_path}/sql/orders.parquet")
    name = "adjusted_p_values"
    check(spark, str(tmp_path / "sql"), lambda s, d: __spark_entry__.queries()[name](s, d), __spark_entry__.oracle_sql()[name])


def test_lifetime_values_make_no_accounts(spark):
    """Revenue and paying months come from the lines: no product code is grouped by, and the sums are those of the accounts."""
    s = star(spark, "/root/testdata/sf0.001")
    plan = s.monthly_revenue._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws" not in plan
    want = s.fact_monthly_account.groupBy("customer_key", "month").agg(F.sum("revenue_c").alias("revenue_c"))
    assert sorted(map(tuple, s.monthly_revenue.collect())) == sorted(map(tuple, want.collect()))


def test_many_bins_place_rows_as_few_comparisons_do(spark):
    """64 bins take two steps of comparisons; a row's bin is the number of boundaries under it."""
    df = spark.range(5000).select(F.struct((F.col("id") * 7919 % 5003).alias("k"), F.col("id").alias("t")).alias("_k"))
    place = _place(df, 5000, 64)
    assert place._jc.toString().startswith("CASE WHEN")
    got = sorted((tuple(r[0]), r[1]) for r in df.select("_k", place).collect())
    bins = [b for _, b in got]
    assert bins == sorted(bins) and set(bins) == set(range(max(bins) + 1)) and max(bins) >= 60
