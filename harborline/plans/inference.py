"""Hypothesis tests as queries: their statistics and effects can be stated in SQL, their p-values are held by textbook cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.functions import hypothesis as H
from harborline.functions import intervals as I
from harborline.operators.models import fit_logistic
from harborline.plans.atomic import read
from harborline.plans.registry import query
from harborline.plans.star import to
from harborline.plans.warehouse import r2


def _anova(cte: str) -> str:
    """F and eta squared of a relation of (n, m, v) per group."""
    return f"""(SELECT (b / (k - 1)) / (w / (t - k)) AS statistic, b / (b + w) AS effect FROM (SELECT count(*)::DOUBLE AS k, any_value(t)::DOUBLE AS t, sum(n * (m - mean) * (m - mean)) AS b, sum((n - 1) * v) AS w
      FROM {cte}, (SELECT sum(n)::DOUBLE AS t, sum(n * m) / sum(n) AS mean FROM {cte})))"""


@query("hypothesis_orders", f"""WITH o AS (SELECT o_orderstatus AS s, o_orderpriority AS p, floor(o_totalprice * 100 + 0.5)::DOUBLE AS x FROM orders),
two AS (SELECT s, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS v, (count(*) FILTER (p < '3'))::DOUBLE AS k FROM o WHERE s IN ('F', 'O') GROUP BY s),
five AS (SELECT p, count(*)::DOUBLE AS n, avg(x) AS m, var_samp(x) AS v FROM o GROUP BY p),
away AS (SELECT s, count(*)::DOUBLE AS n, avg(d) AS m, var_samp(d) AS v FROM (SELECT s, abs(x - median(x) OVER (PARTITION BY s)) AS d FROM o) GROUP BY s),
r AS (SELECT s, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM o WHERE s IN ('F', 'O')),
u AS (SELECT sum(r) FILTER (s = 'F') - na * (na + 1) / 2 AS u, na, nb FROM r, (SELECT (count(*) FILTER (s = 'F'))::DOUBLE AS na, (count(*) FILTER (s = 'O'))::DOUBLE AS nb FROM r) GROUP BY na, nb),
c AS (SELECT a.s, b.p, (SELECT count(*) FROM o WHERE o.s = a.s AND o.p = b.p) AS n, a.n * b.n / t::DOUBLE AS e, t FROM (SELECT s, count(*) AS n FROM o GROUP BY s) a, (SELECT p, count(*) AS n FROM o GROUP BY p) b, (SELECT count(*) AS t FROM o)),
x AS (SELECT sum((n - e) * (n - e) / e) AS x, any_value(t)::DOUBLE AS t, least(count(DISTINCT s), count(DISTINCT p)) - 1 AS k FROM c),
found AS (
 SELECT 't' AS test, (f.m - o.m) / sqrt(f.v / f.n + o.v / o.n) AS statistic, (f.m - o.m) / sqrt(((f.n - 1) * f.v + (o.n - 1) * o.v) / (f.n + o.n - 2)) AS effect FROM two f, two o WHERE f.s = 'F' AND o.s = 'O'
 UNION ALL SELECT 'proportion z', (f.k / f.n - o.k / o.n) / sqrt((f.k + o.k) / (f.n + o.n) * (1 - (f.k + o.k) / (f.n + o.n)) * (1 / f.n + 1 / o.n)), 2 * (asin(sqrt(f.k / f.n)) - asin(sqrt(o.k / o.n))) FROM two f, two o WHERE f.s = 'F' AND o.s = 'O'
 UNION ALL SELECT 'anova', statistic, effect FROM {_anova("five")} UNION ALL SELECT 'levene', statistic, NULL FROM {_anova("away")}
 UNION ALL SELECT 'chi-square', x, sqrt(x / (t * k)) FROM x UNION ALL SELECT 'mann-whitney u', u, 2 * u / (na * nb) - 1 FROM u)
SELECT test, {r2('statistic', 4)} AS statistic, {r2('effect', 6)} AS effect FROM found""")
def hypothesis_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).cast("double").alias("x"))
    two = orders.where("s in ('F', 'O')")
    of = {r.s: (r.k, r.n) for r in two.groupBy("s").agg(F.count_if(F.col("p") < "3").alias("k"), F.count("*").alias("n")).collect()}
    tests = [H.t_test(two, "x", "s"), H.proportion_z_test(*of["F"], *of["O"]), H.anova_oneway(orders, "x", "p"), H.levene_test(orders, "x", "s"), H.chi_square_independence(orders, "s", "p"), H.mann_whitney_u(two, "x", "s")]
    rows = spark.createDataFrame([(t.name, t.statistic, t.effect) for t in tests], "test string, statistic double, effect double")
    return rows.select("test", to(F.col("statistic"), 4).alias("statistic"), to(F.col("effect"), 6).alias("effect"))


@query("adjusted_p_values", f"""WITH t AS (SELECT o_custkey, least(1, (sum(o_orderkey) % 9973 + 1) / 10000.0::DOUBLE) AS p FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, o_custkey) AS i, count(*) OVER () AS m FROM t),
a AS (SELECT *, least(1, min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
SELECT o_custkey, {r2('q', 6)} AS p_adjusted, q <= 0.5::DOUBLE AS rejected, {r2('least(1, p * m)', 6)} AS p_bonferroni FROM a""")
def adjusted(spark: SparkSession, d: str) -> DataFrame:
    tests = read(spark, d, "orders").groupBy("o_custkey").agg(F.least(F.lit(1.0), (F.sum("o_orderkey") % 9973 + 1) / F.lit(10000.0)).alias("p")).cache()
    held = H.bonferroni(tests, "p").withColumnRenamed("p_adjusted", "held")
    return H.benjamini_hochberg(held, "p", "o_custkey", 0.5).select("o_custkey", to(F.col("p_adjusted"), 6).alias("p_adjusted"), "rejected", to(F.col("held"), 6).alias("p_bonferroni"))


@query("logistic_odds_orders", f"""WITH n AS (SELECT (count(*) FILTER (y AND x))::DOUBLE AS a, (count(*) FILTER (NOT y AND x))::DOUBLE AS b, (count(*) FILTER (y AND NOT x))::DOUBLE AS c, (count(*) FILTER (NOT y AND NOT x))::DOUBLE AS d FROM (SELECT o_orderstatus = 'F' AS y, o_orderpriority < '3' AS x FROM orders))
SELECT 'intercept' AS term, {r2('ln(c / d)', 5)} AS coef, {r2('sqrt(1 / c + 1 / d)', 5)} AS se, {r2('c / d', 5)} AS odds_ratio FROM n
UNION ALL SELECT 'urgent', {r2('ln(a * d / (b * c))', 5)}, {r2('sqrt(1 / a + 1 / b + 1 / c + 1 / d)', 5)}, {r2('a * d / (b * c)', 5)} FROM n""")
def logistic_odds(spark: SparkSession, d: str) -> DataFrame:
    """With one feature of two values the fit is known: the logarithm of the odds ratio."""
    rows = read(spark, d, "orders").select((F.col("o_orderpriority") < "3").cast("int").alias("urgent"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    found = fit_logistic(rows, ["urgent"], "y").summary(spark)
    return found.select("term", *[to(F.col(c), 5).alias(c) for c in ("coef", "se", "odds_ratio")])


@query("proportion_intervals", f"""WITH g AS (SELECT o_orderstatus AS s, count(*)::DOUBLE AS n, (count(*) FILTER (o_orderpriority < '3'))::DOUBLE AS k, 1.959963984540054::DOUBLE AS z FROM orders GROUP BY 1), h AS (SELECT *, k / n AS p, (k + z * z / 2) / (n + z * z) AS q FROM g)
SELECT s, 'wald' AS kind, {r2('p - z * sqrt(p * (1 - p) / n)', 6)} AS low, {r2('p + z * sqrt(p * (1 - p) / n)', 6)} AS high FROM h
UNION ALL SELECT s, 'agresti-coull', {r2('q - z * sqrt(q * (1 - q) / (n + z * z))', 6)}, {r2('q + z * sqrt(q * (1 - q) / (n + z * z))', 6)} FROM h""")
def proportion_intervals(spark: SparkSession, d: str) -> DataFrame:
    sums = read(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority") < "3").alias("k"), F.count("*").alias("n")).collect()
    rows = [(r.o_orderstatus, kind, i.low, i.high) for r in sums for kind, i in (("wald", I.wald_interval(r.k, r.n)), ("agresti-coull", I.agresti_coull_interval(r.k, r.n)))]
    return spark.createDataFrame(rows, "s string, kind string, low double, high double").select("s", "kind", to(F.col("low"), 6).alias("low"), to(F.col("high"), 6).alias("high"))
