"""Column profiles, co-missingness, correlations, and anomaly scans as DataFrame aggregations."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborline.operators.ranking import exact_quantiles, globally_ranked

#: Expected first-digit shares, and fixed values: critical chi-squares of 8 degrees, bands of the mean deviation.
BENFORD = {d: math.log10(1 + 1 / d) for d in range(1, 10)}
CRITICAL = {0.10: 13.362, 0.05: 15.507, 0.01: 20.090, 0.001: 26.125}
BANDS = [(0.006, "close conformity"), (0.012, "acceptable conformity"), (0.015, "marginal conformity")]
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in NUMERIC or kind.startswith("decimal")]


def profile_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: counts for all; moments, quantiles and outliers for numbers; NaN counts as missing."""
    columns = columns or df.columns
    numbers = [c for c in numeric_columns(df) if c in columns]
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c)).alias(c) if c in numbers else F.col(c) for c in columns])
    marks = [0.01, 0.25, 0.5, 0.75, 0.99]
    found = exact_quantiles(clean, {c: F.col(c) for c in numbers}, marks) if numbers else {}
    cells = []
    for c in columns:
        v = F.col(c)
        cell = [F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), F.count_if(v.isNull()).alias("n_missing"), F.count_distinct(v).alias("n_distinct")]
        if c in numbers:
            x, n = v.cast("double"), F.count(v)
            low, high = found[c][1], found[c][3]
            out = (x < low - 1.5 * (high - low)) | (x > high + 1.5 * (high - low)) if low is not None else F.lit(False)
            quantiles = F.array(*[F.lit(q) for q in found[c]]) if low is not None else F.lit(None).cast("array<double>")
            # the sample-size correction that turns the population skewness into the unbiased one
            skew = F.when((n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
            cell += [F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), quantiles.alias("quantiles"), F.max(x).alias("max"), skew.alias("skew"), F.count_if(x == 0).alias("n_zero"), F.count_if(x < 0).alias("n_negative"), F.count_if(out).alias("n_outliers")]
        else:
            none = F.lit(None).cast("double")
            cell += [none.alias("mean"), none.alias("sd"), none.alias("min"), F.lit(None).cast("array<double>").alias("quantiles"), none.alias("max"), none.alias("skew"), *[F.lit(None).cast("bigint").alias(k) for k in ("n_zero", "n_negative", "n_outliers")]]
        cells.append(F.struct(*cell))
    return clean.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x")).select("x.*").withColumn("is_constant", F.col("n_distinct") <= 1)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def missingness_matrix(df: DataFrame) -> DataFrame:
    """(a, b, rate): how often two columns are missing together, for all pairs of columns."""
    columns = df.columns
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.avg((F.col(a).isNull() & F.col(b).isNull()).cast("double")).alias("rate")) for a in columns for b in columns]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the average rank of a column, from counts per distinct value."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    upto = globally_ranked(sizes, F.col("_v"), "_v", "_i", {"_upto": "_n"})
    ranks = upto.select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, df[column] == F.col("_v"), "left").drop("_v")


def correlation_pairs(df: DataFrame, threshold: float = 0.8, method: str = "pearson") -> DataFrame:
    """(a, b, r) of numeric columns with |r| at the threshold or over, over the rows that have both."""
    columns = numeric_columns(df)
    if method == "spearman":
        for c in columns:
            df = average_rank(df, c, f"_r_{c}")
        names = {c: f"_r_{c}" for c in columns}
    else:
        names = {c: c for c in columns}

    def r(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(both, F.col(names[a]).cast("double")), F.when(both, F.col(names[b]).cast("double")))

    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(a, b).alias("r")) for a, b in combinations(columns, 2)]
    if not cells:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    found = df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")
    return found.where(F.abs("r") >= threshold).orderBy(F.desc(F.abs("r")), "a", "b")


def first_digit(x: Column) -> Column:
    """Leading digit of |x|; null for zero, NaN and infinities."""
    a = F.abs(x.cast("double"))
    ok = (a > 0) & ~F.isnan(a) & (a < float("inf"))
    digit = F.floor(a / F.pow(F.lit(10.0), F.floor(F.log10(a))))
    return F.when(ok, F.greatest(F.lit(1), F.least(F.lit(9), digit)).cast("int"))


def first_digits(df: DataFrame, column: str) -> DataFrame:
    """(digit, n, observed, expected) for 1 to 9."""
    seen = df.select(first_digit(F.col(column)).alias("digit")).where("digit is not null").groupBy("digit").agg(F.count("*").alias("n"))
    want = df.sparkSession.createDataFrame(list(BENFORD.items()), "digit int, expected double")
    all_ = want.join(seen, "digit", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return all_.select("digit", "n", (F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0))).alias("observed"), "expected")


@dataclass(frozen=True)
class Benford:
    n: int
    chi2: float
    mad: float
    conforms: bool
    interpretation: str


def benford_test(df: DataFrame, column: str, alpha: float = 0.05) -> Benford:
    rows = first_digits(df, column).collect()
    n = sum(r.n for r in rows)
    if not n:
        return Benford(0, 0.0, 0.0, False, "no data")
    chi2 = sum((r.n - n * r.expected) ** 2 / (n * r.expected) for r in rows)
    mad = sum(abs(r.observed - r.expected) for r in rows) / 9
    return Benford(n, chi2, mad, chi2 <= CRITICAL[alpha], next((name for top, name in BANDS if mad < top), "non-conformity"))


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """``df`` with is_outlier by quartile fences."""
    x = F.col(column).cast("double")
    low, high = exact_quantiles(df, {"x": x}, [0.25, 0.75])["x"]
    if low is None:
        return df.withColumn("is_outlier", F.lit(False))
    q, spread = (low, high), high - low
    return df.withColumn("is_outlier", F.coalesce((x < q[0] - k * spread) | (x > q[1] + k * spread), F.lit(False)))


def mad_outliers(df: DataFrame, column: str, threshold: float = 3.5) -> DataFrame:
    """``df`` with is_outlier by the modified z-score.

    Where over half of the values are equal the median deviation is 0: quartile fences decide then,
    and if the quartiles are equal too, every value off the median is an outlier.
    """
    x = F.col(column).cast("double")
    low, middle, high = exact_quantiles(df, {"x": x}, [0.25, 0.5, 0.75])["x"]
    if middle is None:
        return df.withColumn("is_outlier", F.lit(False))
    off, spread = F.abs(x - middle), high - low
    (mad,) = exact_quantiles(df, {"x": off}, [0.5])["x"]
    if mad > 0:
        flag = 0.6745 * off / mad > threshold
    else:
        flag = (x < low - 1.5 * spread) | (x > high + 1.5 * spread) if spread > 0 else x != middle
    return df.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))


def round_number_bias(df: DataFrame, column: str, bases: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """(base, share) of values that a base divides."""
    x = F.col(column).cast("double")
    cells = [F.struct(F.lit(b).alias("base"), F.avg((F.pmod(x, F.lit(float(b))) == 0).cast("double")).alias("share")) for b in bases]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("x")).select("x.*")


def duplicate_clusters(df: DataFrame, subset: list[str], min_size: int = 2) -> DataFrame:
    return df.groupBy(*subset).agg(F.count("*").alias("cluster_size")).where(F.col("cluster_size") >= min_size).orderBy(F.desc("cluster_size"), *subset)


def standardise_rate(df: DataFrame, period: str, outcome: str, stratum: str, min_coverage: float = 0.8, weights: dict[str, float] | None = None) -> DataFrame:
    """(period, rate, coverage): the outcome's rate per period under the pooled mix of strata, or under given weights.

    Weights of strata absent in a period are spread over those present; below ``min_coverage`` of the
    weight the rate is null.
    """
    mix = df.groupBy(stratum).agg(F.count("*").alias("n")).select(stratum, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("w"))
    if weights:
        total = sum(weights.values())
        mix = df.sparkSession.createDataFrame([(k, v / total) for k, v in weights.items()], f"{stratum} string, w double")
    cells = df.groupBy(period, stratum).agg(F.avg(F.col(outcome).cast("double")).alias("r"))
    both = cells.join(mix, stratum)
    out = both.groupBy(period).agg((F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("rate"), F.sum("w").alias("coverage"))
    return out.select(period, F.when(F.col("coverage") >= min_coverage, F.col("rate")).alias("rate"), "coverage")


@dataclass(frozen=True)
class Break:
    index: int
    before: float
    after: float
    score: float

    @property
    def pct_change(self) -> float | None:
        """The change of level in percent of the level before; None if that is 0."""
        return 100 * (self.after - self.before) / abs(self.before) if self.before else None


def break_scan(series: DataFrame, order: str, value: str, min_segment: int = 6) -> DataFrame:
    """(split, before, after, score) of every legal split of a series: Welch's statistic from prefix sums.

    One ordered pass over a time series, which is short by nature (a row per period).
    """
    by, x = Window.orderBy(order), F.col(value).cast("double")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy()
    s = series.where(F.col(value).isNotNull()).select((F.row_number().over(by)).alias("split"), F.sum(x).over(upto).alias("s"), F.sum(x * x).over(upto).alias("q"), F.count("*").over(all_).alias("n"), F.sum(x).over(all_).alias("ts"), F.sum(x * x).over(all_).alias("tq"))
    k, m = F.col("split"), F.col("n") - F.col("split")
    a, b = F.col("s") / k, (F.col("ts") - F.col("s")) / m
    va = F.greatest((F.col("q") - F.col("s") * a) / (k - 1), F.lit(0.0))
    vb = F.greatest((F.col("tq") - F.col("q") - (F.col("ts") - F.col("s")) * b) / (m - 1), F.lit(0.0))
    legal = s.where((k >= min_segment) & (k < F.col("n") - min_segment)).where((k > 1) & (m > 1))
    error = F.sqrt(va / k + vb / m)
    tiny = error <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1e-300))
    score = F.when(tiny & (F.abs(a - b) <= 1e-12 * F.greatest(F.abs(a), F.abs(b))), 0.0).when(tiny, float("inf")).otherwise(F.abs(a - b) / error)
    return legal.select("split", a.alias("before"), b.alias("after"), score.alias("score"))


def detect_structural_break(series: DataFrame, order: str, value: str, min_segment: int = 6) -> Break | None:
    """The first split of the highest score; None if the series is too short."""
    best = break_scan(series, order, value, min_segment).orderBy(F.desc("score"), "split").first()
    return Break(best.split, best.before, best.after, best.score) if best else None
