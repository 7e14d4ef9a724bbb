"""Hypothesis tests: distributed sufficient statistics, then a formula on a few numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions.distributions import chi2_sf, f_sf, normal_sf, t_ppf, t_two_sided_p
from harborline.functions.intervals import Interval, z_of
from harborline.operators.profiling import average_rank
from harborline.operators.ranking import SMALL, globally_ranked, least_from


#: Cells of a contingency table at most.
MOST_CELLS = 1_000_000


@dataclass(frozen=True)
class TestResult:
    name: str
    statistic: float
    p_value: float
    df: float | tuple[float, float] | None = None
    effect: float | None = None
    interval: Interval | None = None
    note: str = ""

    __test__ = False

    def significant(self, alpha: float = 0.05) -> bool:
        return self.p_value < alpha


def moments(df: DataFrame, value: str, group: str) -> list:
    """Per group: n, mean and sample variance, in order of the group."""
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v")).orderBy(group).collect()


def t_test(df: DataFrame, value: str, group: str, equal_var: bool = False, confidence: float = 0.95) -> TestResult:
    """Welch's (or Student's) test of the first group against the second, with Cohen's d."""
    a, b = moments(df, value, group)
    pooled = ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)
    va, vb = (pooled / a.n, pooled / b.n) if equal_var else (a.v / a.n, b.v / b.n)
    se, diff = math.sqrt(va + vb), a.m - b.m
    free = a.n + b.n - 2 if equal_var else (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1)) if se else a.n + b.n - 2
    t = diff / se if se else math.copysign(math.inf, diff) if diff else 0.0
    half = t_ppf(0.5 + confidence / 2, free) * se
    return TestResult("t", t, t_two_sided_p(t, free) if math.isfinite(t) else 0.0, free, diff / math.sqrt(pooled) if pooled else None, Interval(diff, diff - half, diff + half, confidence))


def paired_t_test(df: DataFrame, a: str, b: str, confidence: float = 0.95) -> TestResult:
    d = F.col(a).cast("double") - F.col(b)
    r = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
    if not r.s:
        return TestResult("paired t", math.copysign(math.inf, r.m) if r.m else 0.0, 0.0 if r.m else 1.0, r.n - 1)
    se = r.s / math.sqrt(r.n)
    half = t_ppf(0.5 + confidence / 2, r.n - 1) * se
    return TestResult("paired t", r.m / se, t_two_sided_p(r.m / se, r.n - 1), r.n - 1, r.m / r.s, Interval(r.m, r.m - half, r.m + half, confidence))


def anova_oneway(df: DataFrame, value: str, group: str) -> TestResult:
    groups = moments(df, value, group)
    n, k = sum(g.n for g in groups), len(groups)
    mean = sum(g.n * g.m for g in groups) / n
    between, within = sum(g.n * (g.m - mean) ** 2 for g in groups), sum((g.n - 1) * g.v for g in groups)
    f = between / (k - 1) / (within / (n - k)) if within else math.inf if between else 0.0
    return TestResult("anova", f, f_sf(f, k - 1, n - k) if math.isfinite(f) else 0.0, (k - 1, n - k), between / (between + within) if between + within else 0.0)


def levene_test(df: DataFrame, value: str, group: str) -> TestResult:
    """Brown and Forsythe's: an analysis of variance of distances to the group medians."""
    middle = df.groupBy(group).agg(F.median(F.col(value).cast("double")).alias("_m"))
    off = df.join(middle, group).withColumn("_off", F.abs(F.col(value) - F.col("_m")))
    r = anova_oneway(off, "_off", group)
    return TestResult("levene", r.statistic, r.p_value, r.df)


def proportion_z_test(s1: int, n1: int, s2: int, n2: int, confidence: float = 0.95) -> TestResult:
    p1, p2, p = s1 / n1, s2 / n2, (s1 + s2) / (n1 + n2)
    se = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    z = (p1 - p2) / se if se else 0.0
    half = z_of(confidence) * math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    return TestResult("proportion z", z, 2 * normal_sf(abs(z)), None, 2 * (math.asin(math.sqrt(p1)) - math.asin(math.sqrt(p2))), Interval(p1 - p2, p1 - p2 - half, p1 - p2 + half, confidence))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, expected) of all cells, also the empty ones; raises beyond MOST_CELLS of them."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("_r")), cells.groupBy(b).agg(F.sum("n").alias("_c"))
    total = cells.agg(F.sum("n")).scalar()
    # the categories of a contingency table, not rows, are crossed
    if (n := rows.count() * cols.count()) > MOST_CELLS:
        raise ValueError(f"{n} cells: {a} and {b} are not categories")
    grid = rows.crossJoin(cols)
    return grid.join(cells, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"), (F.col("_r") * F.col("_c") / total).alias("expected"))


def chi_square_independence(df: DataFrame, a: str, b: str) -> TestResult:
    e = F.col("expected")
    r = contingency(df, a, b).agg(F.sum((F.col("n") - e) ** 2 / e).alias("x"), F.sum("n").alias("n"), F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"), F.count_if(e < 5).alias("low")).first()
    free, least = (r.r - 1) * (r.c - 1), min(r.r, r.c) - 1
    return TestResult("chi-square", r.x, chi2_sf(r.x, free), free, math.sqrt(r.x / (r.n * least)) if least else None, note=f"{r.low} expected counts under 5" if r.low else "")


def mann_whitney_u(df: DataFrame, value: str, group: str) -> TestResult:
    """Normal approximation with the correction for ties; effect is the rank-biserial correlation."""
    ranked = average_rank(df.where(F.col(value).isNotNull()), value, "_rank")
    a, b = ranked.groupBy(group).agg(F.count("*").alias("n"), F.sum("_rank").alias("r")).orderBy(group).collect()
    ties = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t"))).first()[0]
    n, u = a.n + b.n, a.r - a.n * (a.n + 1) / 2
    var = a.n * b.n / 12 * (n + 1 - ties / (n * (n - 1)))
    shift = u - a.n * b.n / 2
    z = (abs(shift) - 0.5) / math.sqrt(var) * math.copysign(1, shift) if var and shift else 0.0
    return TestResult("mann-whitney u", u, min(1.0, 2 * normal_sf(abs(z))), None, 2 * u / (a.n * b.n) - 1)


def benjamini_hochberg(tests: DataFrame, p: str, key: str, alpha: float = 0.05, small: int = SMALL) -> DataFrame:
    """``tests`` with p_adjusted and rejected; tests without a p-value come last, and count. ``key`` tells tests apart."""
    ranked = globally_ranked(tests, F.coalesce(F.col(p), F.lit(math.nan)), key, "_i", small=small, bin_as="_place")
    ratio = F.col(p) * tests.agg(F.count("*")).scalar() / F.col("_i")
    found = least_from(ranked, ratio, "_i", "_place", "_least").withColumn("p_adjusted", F.least(F.col("_least"), F.lit(1.0)))
    return found.withColumn("rejected", F.col("p_adjusted") <= alpha).drop("_i", "_place", "_least")


def bonferroni(tests: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    m = tests.agg(F.count("*")).scalar()
    return tests.withColumn("p_adjusted", F.least(F.col(p) * m, F.lit(1.0))).withColumn("rejected", F.col("p_adjusted") <= alpha)
