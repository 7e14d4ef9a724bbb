"""Data quality, profiling, anomaly, statistics and metrics as queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.functions.hypothesis import contingency
from harborline.functions import intervals
from harborline.functions.intervals import difference_in_proportions_interval, proportion_table
from harborline.operators import profiling as P
from harborline.operators.metrics import confusion, curve, lift_table, ranking_metrics
from harborline.operators.models import KMeansFit, fit_kmeans, fit_logistic
from harborline.operators.rules import Severity, foreign_key, in_range, in_set, matches, monotonic_dates, no_future_dates, non_negative, not_null, row_count_between, rule_counts, unique
from harborline.plans.atomic import read
from harborline.plans.registry import query
from harborline.plans.star import to
from harborline.plans.warehouse import r2


@query("rules_orders", """SELECT * FROM (SELECT unnest([
 {'rule': 'o_orderkey_not_null', 'n_checked': count(*), 'n_failed': count(*) FILTER (o_orderkey IS NULL)}, {'rule': 'o_totalprice_in_range', 'n_checked': count(*), 'n_failed': count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 300000)},
 {'rule': 'o_totalprice_non_negative', 'n_checked': count(*), 'n_failed': count(*) FILTER (o_totalprice < 0)}, {'rule': 'o_orderstatus_in_set', 'n_checked': count(*), 'n_failed': count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))},
 {'rule': 'o_orderpriority_matches', 'n_checked': count(*), 'n_failed': count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]-'))}, {'rule': 'o_custkey_unique', 'n_checked': count(*), 'n_failed': (SELECT sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1))::BIGINT},
 {'rule': 'o_custkey_foreign_key', 'n_checked': count(*), 'n_failed': count(*) FILTER (o_custkey NOT IN (SELECT user_id FROM events))}], recursive := true) FROM orders)""")  # fmt: skip
def rules_orders(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        not_null("o_orderkey"), in_range("o_totalprice", 1000, 300000), non_negative("o_totalprice"), in_set("o_orderstatus", ["F", "O"]), matches("o_orderpriority", "[1-4]-", Severity.WARNING),
        unique("o_custkey"), foreign_key("o_custkey", read(spark, d, "events"), "user_id"),
    ]
    return rule_counts(read(spark, d, "orders"), rules)


@query("profile_part", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*)::BIGINT AS n_rows, count(*) FILTER ({c} IS NULL)::BIGINT AS n_missing, count(DISTINCT {c})::BIGINT AS n_distinct, {r2(f'quantile_cont({c}::DOUBLE, 0.01)', 6)} AS p01, {r2(f'quantile_cont({c}::DOUBLE, 0.5)', 6)} AS p50, {r2(f'skewness({c})', 6)} AS skew, (SELECT count(*) FROM part, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM part) WHERE {c} < a - 1.5::DOUBLE * (b - a) OR {c} > b + 1.5::DOUBLE * (b - a))::BIGINT AS n_outliers FROM part" for c in ("p_size", "p_retailprice")))
def profile_part(spark: SparkSession, d: str) -> DataFrame:
    found = P.profile_table(read(spark, d, "part"), ["p_size", "p_retailprice"])
    return found.select("column_name", "n_rows", "n_missing", "n_distinct", to(F.col("quantiles")[0], 6).alias("p01"), to(F.col("quantiles")[2], 6).alias("p50"), to(F.col("skew"), 6).alias("skew"), "n_outliers")


@query("missingness_labels", "SELECT a, b, count(*) FILTER (CASE a WHEN 'doc_id' THEN doc_id IS NULL WHEN 'quality' THEN quality IS NULL ELSE toxic IS NULL END AND CASE b WHEN 'doc_id' THEN doc_id IS NULL WHEN 'quality' THEN quality IS NULL ELSE toxic IS NULL END) / count(*) AS rate FROM labels, (SELECT unnest(['doc_id', 'quality', 'toxic']) AS a), (SELECT unnest(['doc_id', 'quality', 'toxic']) AS b) GROUP BY a, b")
def missingness(spark: SparkSession, d: str) -> DataFrame:
    return P.missingness_matrix(read(spark, d, "labels"))


@query("correlation_lineitem", f"SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, {r2('corr(l_quantity, l_extendedprice)', 6)} AS r FROM lineitem WHERE true")
def correlation(spark: SparkSession, d: str) -> DataFrame:
    found = P.correlation_pairs(read(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), threshold=0.0)
    return found.select("a", "b", to(F.col("r"), 6).alias("r"))


@query("benford_prices", f"SELECT digit::INT AS digit, coalesce(n, 0)::BIGINT AS n, {r2('coalesce(n, 0) / (SELECT count(*) FROM lineitem WHERE l_extendedprice <> 0)::DOUBLE', 6)} AS observed, {r2('log10(1 + 1 / digit::DOUBLE)', 6)} AS expected FROM range(1, 10) AS t(digit) LEFT JOIN (SELECT left(abs(l_extendedprice)::VARCHAR, 1)::INT AS digit, count(*) AS n FROM lineitem WHERE abs(l_extendedprice) >= 1 GROUP BY 1) USING (digit)")
def benford(spark: SparkSession, d: str) -> DataFrame:
    return P.first_digits(read(spark, d, "lineitem"), "l_extendedprice").select("digit", "n", to(F.col("observed"), 6).alias("observed"), to(F.col("expected"), 6).alias("expected"))


@query("mad_outliers_orders", "WITH m AS (SELECT median(o_totalprice) AS m FROM orders), d AS (SELECT median(abs(o_totalprice - m)) AS d FROM orders, m) SELECT o_orderkey FROM orders, m, d WHERE 0.6745::DOUBLE * abs(o_totalprice - m) / d > 1.2")
def mad(spark: SparkSession, d: str) -> DataFrame:
    return P.mad_outliers(read(spark, d, "orders"), "o_totalprice", 1.2).where("is_outlier").select("o_orderkey")


@query("iqr_outliers_events", "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id FROM events, q WHERE value < a - 0.25::DOUBLE * (b - a) OR value > b + 0.25::DOUBLE * (b - a)")
def iqr(spark: SparkSession, d: str) -> DataFrame:
    return P.iqr_outliers(read(spark, d, "events"), "value", 0.25).where("is_outlier").select("event_id")


@query("round_number_bias", f"SELECT b::INT AS base, {r2('count(*) FILTER (l_quantity % b = 0) / count(*)::DOUBLE', 6)} AS share FROM lineitem, (VALUES (5), (10)) AS t(b) GROUP BY b")
def round_bias(spark: SparkSession, d: str) -> DataFrame:
    return P.round_number_bias(read(spark, d, "lineitem"), "l_quantity", (5, 10)).select("base", to(F.col("share"), 6).alias("share"))


@query("duplicate_clusters", "SELECT o_custkey, o_orderstatus, count(*)::BIGINT AS cluster_size FROM orders GROUP BY 1, 2 HAVING count(*) >= 5")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    return P.duplicate_clusters(read(spark, d, "orders"), ["o_custkey", "o_orderstatus"], 5)


@query("standardised_rate", f"WITH x AS (SELECT year(o_orderdate)::INT AS period, o_orderpriority AS s, (o_orderstatus = 'F')::INT AS y FROM orders), w AS (SELECT s, count(*) / (SELECT count(*) FROM x)::DOUBLE AS w FROM x GROUP BY 1), c AS (SELECT period, s, avg(y) AS r FROM x GROUP BY 1, 2) SELECT period, {r2('sum(w * r) / sum(w)', 6)} AS rate, {r2('sum(w)', 6)} AS coverage FROM c JOIN w USING (s) GROUP BY 1")
def standardised(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select(F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("s"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return P.standardise_rate(rows, "period", "y", "s").select("period", to(F.col("rate"), 6).alias("rate"), to(F.col("coverage"), 6).alias("coverage"))


@query("break_scan_orders", f"WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, count(*)::DOUBLE AS x FROM orders GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY m) AS k, x, count(*) OVER () AS n FROM m) SELECT k::INT AS split, {r2('(SELECT avg(x) FROM s t WHERE t.k <= s.k)', 4)} AS before, {r2('(SELECT avg(x) FROM s t WHERE t.k > s.k)', 4)} AS after, {r2('abs((SELECT avg(x) FROM s t WHERE t.k <= s.k) - (SELECT avg(x) FROM s t WHERE t.k > s.k)) / sqrt((SELECT var_samp(x) FROM s t WHERE t.k <= s.k) / k + (SELECT var_samp(x) FROM s t WHERE t.k > s.k) / (n - k))', 4)} AS score FROM s WHERE k >= 6 AND k < n - 6")
def breaks(spark: SparkSession, d: str) -> DataFrame:
    monthly = read(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("m")).agg(F.count("*").alias("x"))
    return P.break_scan(monthly, "m", "x").select("split", *[to(F.col(c), 4).alias(c) for c in ("before", "after", "score")])


@query("wilson_by_priority", f"WITH g AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS s, 1.959963984540054::DOUBLE AS z FROM orders GROUP BY 1), h AS (SELECT *, s / n::DOUBLE AS p, 1 + z * z / n AS c FROM g) SELECT o_orderpriority, n::BIGINT AS n, s::BIGINT AS successes, {r2('p', 6)} AS rate, {r2('(p + z * z / (2 * n)) / c - z / c * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))', 6)} AS low, {r2('(p + z * z / (2 * n)) / c + z / c * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))', 6)} AS high FROM h")
def wilson(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").withColumn("won", F.col("o_orderstatus") == "F")
    return proportion_table(rows, "o_orderpriority", "won").select("o_orderpriority", "n", "successes", *[to(F.col(c), 6).alias(c) for c in ("rate", "low", "high")])


@query("contingency_orders", f"SELECT a.o_orderstatus, b.o_orderpriority, (SELECT count(*) FROM orders o WHERE o.o_orderstatus = a.o_orderstatus AND o.o_orderpriority = b.o_orderpriority)::BIGINT AS n, {r2('a.n * b.n / (SELECT count(*) FROM orders)::DOUBLE', 6)} AS expected FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) a, (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) b")
def contingency_orders(spark: SparkSession, d: str) -> DataFrame:
    return contingency(read(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select("o_orderstatus", "o_orderpriority", "n", to(F.col("expected"), 6).alias("expected"))


@query("moments_by_group", f"SELECT o_orderstatus, count(*)::BIGINT AS n, {r2('avg(o_totalprice)', 4)} AS mean, {r2('stddev_samp(o_totalprice)', 4)} AS sd FROM orders GROUP BY 1")
def group_moments(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), to(F.avg("o_totalprice"), 4).alias("mean"), to(F.stddev_samp("o_totalprice"), 4).alias("sd"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id")
    return both.select("doc_id", F.col("quality").cast("int").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("s"))


SCORED = "WITH s AS (SELECT doc_id, quality AS y, n_chars / (n_chars + 1000.0::DOUBLE) AS s FROM labels JOIN documents USING (doc_id))"


@query("confusion_matrix", f"{SCORED} SELECT count(*) FILTER (s >= 0.5 AND y = 1)::BIGINT AS tp, count(*) FILTER (s >= 0.5 AND y = 0)::BIGINT AS fp, count(*) FILTER (s < 0.5 AND y = 1)::BIGINT AS fn, count(*) FILTER (s < 0.5 AND y = 0)::BIGINT AS tn FROM s")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).agg(*confusion(F.col("y"), F.col("s"), 0.5))


@query("roc_points", f"{SCORED}, g AS (SELECT s, count(*) AS n, sum(y) AS p FROM s GROUP BY 1) SELECT {r2('s', 6)} AS score, n::BIGINT AS n, p::BIGINT AS pos, (sum(p) OVER w)::BIGINT AS tp, (sum(n - p) OVER w)::BIGINT AS fp FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return curve(scored(spark, d), "y", "s").withColumn("score", to(F.col("score"), 6))


@query("ranking_metrics", f"{SCORED}, g AS (SELECT s, count(*) AS n, sum(y) AS p FROM s GROUP BY 1), c AS (SELECT *, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER () AS np, sum(n - p) OVER () AS nn FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT {r2('sum((n - p) * (tp - p / 2.0::DOUBLE)) / max(np) / max(nn)', 6)} AS roc_auc, {r2('sum(p * tp / (tp + fp)::DOUBLE) / max(np)', 6)} AS average_precision, {r2('max(tp / np::DOUBLE - fp / nn::DOUBLE)', 6)} AS ks_statistic, {r2('sum(p * (1 - s) * (1 - s) + (n - p) * s * s) / sum(n)', 6)} AS brier_score FROM c")
def ranking(spark: SparkSession, d: str) -> DataFrame:
    found = ranking_metrics(scored(spark, d), "y", "s")
    return found.select(*[to(F.col(c), 6).alias(c) for c in found.columns])


@query("lift_table", f"{SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS rn, count(*) OVER () AS n, sum(y) OVER () AS p FROM s), b AS (SELECT *, (SELECT max(i) FROM range(10) AS t(i) WHERE floor(i * n / 10.0::DOUBLE) < rn) + 1 AS bin FROM r) SELECT bin::INT AS bin, count(*)::BIGINT AS n, sum(y)::BIGINT AS positives, {r2('avg(y)', 6)} AS rate, {r2('avg(y) / (max(p) / max(n)::DOUBLE)', 6)} AS lift FROM b GROUP BY bin")
def lift(spark: SparkSession, d: str) -> DataFrame:
    return lift_table(scored(spark, d), "y", "s", "doc_id").select("bin", "n", "positives", to(F.col("rate"), 6).alias("rate"), to(F.col("lift"), 6).alias("lift"))


@query("logistic_quality")
def logistic(spark: SparkSession, d: str) -> DataFrame:
    return fit_logistic(scored(spark, d), ["s"], "y").summary(spark)


@query("kmeans_embeddings")
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return fit_kmeans(points, "x", 4).predict(points, "x").select("vec_id", "cluster")


@query("rules_order_dates", """WITH l AS (SELECT o_orderdate, o_orderdate < lag(o_orderdate) OVER (ORDER BY o_orderkey) AS back FROM orders), c AS (SELECT count(*) AS n, count(*) FILTER (back) AS b, count(*) FILTER (o_orderdate > TIMESTAMP '1998-01-01') AS f FROM l)
SELECT 'row_count' AS rule, n AS n_checked, if(n BETWEEN 1 AND 10, 0, n) AS n_failed FROM c UNION ALL SELECT 'o_orderdate_monotonic', n, b FROM c UNION ALL SELECT 'o_orderdate_not_future', n, f FROM c""")
def rules_order_dates(spark: SparkSession, d: str) -> DataFrame:
    rules = [row_count_between(1, 10), monotonic_dates("o_orderdate", "o_orderkey"), no_future_dates("o_orderdate", "1998-01-01")]
    return rule_counts(read(spark, d, "orders"), rules)


@query("spearman_lineitem", f"WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, {r2('corr(r.a, r.b)', 6)} AS r FROM r")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    found = P.correlation_pairs(read(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), threshold=0.0, method="spearman")
    return found.select("a", "b", to(F.col("r"), 6).alias("r"))


_WILSON = "(p + z * z / (2 * n)) / (1 + z * z / n) {0} z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n))"


@query("newcombe_difference", f"""WITH g AS (SELECT o_orderstatus AS s, count(*)::DOUBLE AS n, count(*) FILTER (o_orderpriority < '3') / count(*)::DOUBLE AS p, 1.959963984540054::DOUBLE AS z FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
w AS (SELECT s, p, {_WILSON.format('-')} AS lo, {_WILSON.format('+')} AS hi FROM g), b AS (SELECT f.p - o.p AS d, sqrt((f.p - f.lo) ** 2 + (o.hi - o.p) ** 2) AS down, sqrt((f.hi - f.p) ** 2 + (o.p - o.lo) ** 2) AS up FROM w f, w o WHERE f.s = 'F' AND o.s = 'O')
SELECT {r2('d', 6)} AS difference, {r2('d - down', 6)} AS low, {r2('d + up', 6)} AS high FROM b""")
def newcombe(spark: SparkSession, d: str) -> DataFrame:
    sums = read(spark, d, "orders").where("o_orderstatus in ('F', 'O')").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority") < "3").alias("s"), F.count("*").alias("n")).collect()
    of = {r.o_orderstatus: (r.s, r.n) for r in sums}
    i = difference_in_proportions_interval(*of.get("F", (0, 0)), *of.get("O", (0, 0)))
    return spark.createDataFrame([(i.estimate, i.low, i.high)], "difference double, low double, high double").select(*[to(F.col(c), 6).alias(c) for c in ("difference", "low", "high")])


def _weights(b: int, seed: int) -> str:
    """The bootstrap's weights of orders in SQL: a splitmix hash of key and resample, and where Poisson(1) stands for it."""
    whole = "18446744073709551616::UHUGEINT"
    steps = ", ".join(f"{x:.17e}" for x in intervals._STEPS)
    return f"""h0 AS (SELECT o_orderkey, (o_totalprice * 100)::BIGINT AS x, o_orderstatus = 'F' AS f, b, (o_orderkey::UHUGEINT * 11400714819323198485::UHUGEINT + b::UHUGEINT * 15111065706836454659::UHUGEINT + {seed}::UHUGEINT) % {whole} AS h FROM orders, range(1, {b + 1}) AS t(b)),
h1 AS (SELECT * REPLACE ((xor(h, h >> 30) * 13787848793156543929::UHUGEINT) % {whole} AS h) FROM h0), h2 AS (SELECT * REPLACE ((xor(h, h >> 27) * 10723151780598845931::UHUGEINT) % {whole} AS h) FROM h1),
u AS (SELECT x, f, b, (xor(h, h >> 31) >> 11)::DOUBLE / 9007199254740992::DOUBLE AS u FROM h2), w AS (SELECT x, f, b, len(list_filter([{steps}], lambda s: s <= u)) AS w FROM u)"""


def _resampled(name: str, whole: str, each: str) -> str:
    return f"SELECT '{name}' AS statistic, {r2(f'({whole})', 4)} AS estimate, {r2('quantile_cont(v, 0.025)', 4)} AS low, {r2('quantile_cont(v, 0.975)', 4)} AS high FROM ({each})"


@query("bootstrap_orders", f"""WITH {_weights(100, 7)}, c AS (SELECT b, x, sum(w) OVER (PARTITION BY b ORDER BY x) AS c, sum(w) OVER (PARTITION BY b) AS n FROM w)
{_resampled("mean", "SELECT sum((o_totalprice * 100)::BIGINT) / count(*)::DOUBLE FROM orders", "SELECT sum(w * x) / sum(w)::DOUBLE AS v FROM w GROUP BY b")}
UNION ALL {_resampled("share_of_f", "SELECT sum((o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = 'F') / sum((o_totalprice * 100)::BIGINT)::DOUBLE FROM orders", "SELECT sum(w * x) FILTER (f) / sum(w * x)::DOUBLE AS v FROM w GROUP BY b")}
UNION ALL {_resampled("median", "SELECT quantile_disc((o_totalprice * 100)::BIGINT, 0.5)::DOUBLE FROM orders", "SELECT min(x)::DOUBLE AS v FROM c WHERE c >= 0.5::DOUBLE * n GROUP BY b")}""")
def bootstrap_orders(spark: SparkSession, d: str) -> DataFrame:
    x = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = read(spark, d, "orders").select("o_orderkey", x.alias("x"), F.when(F.col("o_orderstatus") == "F", x).otherwise(0).alias("f"))
    asked = {"mean": intervals.mean_of(F.col("x")), "share_of_f": intervals.ratio_of(F.col("f"), F.col("x")), "median": intervals.Quantile(F.col("x"), 0.5)}
    found = [(name, i.estimate, i.low, i.high) for name, i in ((name, intervals.bootstrap_interval(rows, s, 100, 7, key="o_orderkey")) for name, s in asked.items())]
    return spark.createDataFrame(found, "statistic string, estimate double, low double, high double").select("statistic", *[to(F.col(c), 4).alias(c) for c in ("estimate", "low", "high")])


@query("kmeans_planted", "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey % 4) AS leader FROM orders")
def kmeans_planted(spark: SparkSession, d: str) -> DataFrame:
    """Four groups far apart: whatever the seeds, each cluster is one of them; a cluster is named by its least order."""
    points = read(spark, d, "orders").select("o_orderkey", F.array((F.col("o_custkey") % 4 * 1000 + F.col("o_orderkey") % 50).cast("double"), (F.col("o_orderkey") % 30).cast("double")).alias("x"))
    found = fit_kmeans(points, "x", 4, n_init=2).predict(points, "x")
    return found.join(F.broadcast(found.groupBy("cluster").agg(F.min("o_orderkey").alias("leader"))), "cluster").select("o_orderkey", "leader")


#: Fixed centres, one for each corner of the first two dimensions and the origin of the others, so that SQL can assign points as well.
CORNERS = [(x, y, *[0.0] * 62) for x in (0.5, -0.5) for y in (0.5, -0.5)]


_CENTRES = ", ".join(f"({i}, [{', '.join(map(str, c))}]::DOUBLE[])" for i, c in enumerate(CORNERS))


@query("kmeans_assignment", f"WITH c AS (SELECT * FROM (VALUES {_CENTRES}) AS t(i, c)), e AS (SELECT vec_id, i, list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM embeddings, c) SELECT vec_id, i AS cluster FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1")
def assigned(spark: SparkSession, d: str) -> DataFrame:
    points = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return KMeansFit(np.array(CORNERS), 0.0, 0).predict(points, "x").select("vec_id", "cluster")
