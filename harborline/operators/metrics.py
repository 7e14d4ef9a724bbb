"""Metrics of scored rows, from counts per distinct score, so ties cannot change a result."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborline.operators.ranking import exact_quantiles, globally_ranked


@dataclass(frozen=True)
class ConfusionMatrix:
    tp: int
    fp: int
    fn: int
    tn: int

    @staticmethod
    def _share(a: float, b: float) -> float:
        return a / b if b else 0.0

    @property
    def n(self) -> int:
        return self.tp + self.fp + self.fn + self.tn

    @property
    def accuracy(self) -> float:
        return self._share(self.tp + self.tn, self.n)

    @property
    def precision(self) -> float:
        return self._share(self.tp, self.tp + self.fp)

    @property
    def recall(self) -> float:
        return self._share(self.tp, self.tp + self.fn)

    @property
    def specificity(self) -> float:
        return self._share(self.tn, self.tn + self.fp)

    @property
    def f1(self) -> float:
        return self._share(2 * self.tp, 2 * self.tp + self.fp + self.fn)

    @property
    def balanced_accuracy(self) -> float:
        return (self.recall + self.specificity) / 2

    @property
    def mcc(self) -> float:
        d = (self.tp + self.fp) * (self.tp + self.fn) * (self.tn + self.fp) * (self.tn + self.fn)
        return self._share(self.tp * self.tn - self.fp * self.fn, math.sqrt(d))


def confusion(y: Column, score: Column, threshold: float | Column) -> list[Column]:
    hit, one = score >= threshold, y == 1
    return [F.count_if(c).alias(n) for n, c in (("tp", hit & one), ("fp", hit & ~one), ("fn", ~hit & one), ("tn", ~hit & ~one))]


def confusion_matrix(df: DataFrame, y: str, score: str, threshold: float = 0.5) -> ConfusionMatrix:
    return ConfusionMatrix(*df.agg(*confusion(F.col(y), F.col(score), threshold)).first())


def curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, n, pos, tp, fp) per distinct score, cumulative from the highest."""
    sizes = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos"))
    down = globally_ranked(sizes, -F.col("score"), "score", "_i", {"tp": "pos", "_upto": "n"})
    return down.select("score", "n", "pos", "tp", (F.col("_upto") - F.col("tp")).alias("fp"))


def roc_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    c, all_ = curve(df, y, score), Window.partitionBy()
    return c.select("score", (F.col("tp") / F.nullif(F.max("tp").over(all_), F.lit(0))).alias("tpr"), (F.col("fp") / F.nullif(F.max("fp").over(all_), F.lit(0))).alias("fpr"))


def ranking_metrics(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: roc_auc, average_precision, ks_statistic, brier_score; null where a class is missing."""
    c = curve(df, y, score)
    ends = c.agg(F.struct(F.max("tp").alias("p"), F.max("fp").alias("q"))).scalar()
    p, q = F.nullif(ends["p"], F.lit(0)), F.nullif(ends["q"], F.lit(0))
    neg = F.col("n") - F.col("pos")
    auc = F.sum(neg * (F.col("tp") - F.col("pos") / 2.0))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    ks = F.max(F.col("tp") / p - F.col("fp") / q)
    brier = F.sum(F.col("pos") * (1 - F.col("score")) ** 2 + neg * F.col("score") ** 2) / F.sum("n")
    return c.agg((auc / F.max(p) / F.max(q)).alias("roc_auc"), (ap / F.max(p)).alias("average_precision"), ks.alias("ks_statistic"), brier.alias("brier_score"))


def lift_table(df: DataFrame, y: str, score: str, key: str, n_bins: int = 10) -> DataFrame:
    """Per bin of equal size from the highest score: rows, positives, rate, lift, cumulative gain; ties by key."""
    scored = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select(F.col(key).alias("k"), F.col(y).cast("bigint").alias("y"), F.col(score).cast("double").alias("s"))
    total = scored.agg(F.struct(F.count("*").alias("n"), F.sum("y").alias("p"))).scalar()
    ranked = globally_ranked(scored, -F.col("s"), "k", "rn").withColumn("_t", total)
    n = F.col("_t.n")
    # edges lie at floor(i * n / bins): a row of 0-based place r is in the last bin whose edge is at most r
    place = F.col("rn") - 1
    bin_ = F.floor(((place + 1) * n_bins - 1) / n)
    out = ranked.groupBy((bin_ + 1).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.min("s").alias("min_score"), F.max("s").alias("max_score"), F.first("_t.p").alias("p"), F.first("_t.n").alias("t"))
    gain = F.sum("positives").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    rate = F.col("positives") / F.col("n")
    return out.select("bin", "n", "positives", "min_score", "max_score", rate.alias("rate"), (rate / F.nullif(F.col("p") / F.col("t"), F.lit(0.0))).alias("lift"), (gain / F.nullif("p", F.lit(0))).alias("cumulative_gain"))


def optimal_threshold(df: DataFrame, y: str, score: str, metric: str = "f1") -> tuple[float, float]:
    """The percentile of the scores with the best value of a ConfusionMatrix property, and that value."""
    marks = sorted({x for x in exact_quantiles(df, {"x": F.col(score)}, [i / 100 for i in range(1, 100)])["x"] if x is not None})
    cells = df.agg(*[F.struct(*confusion(F.col(y), F.col(score), t)).alias(f"t{i}") for i, t in enumerate(marks)]).first()
    found = [(getattr(ConfusionMatrix(*cells[i]), metric), -t) for i, t in enumerate(marks)]
    best, t = max(found)
    return -t, best


def evaluate(df: DataFrame, y: str, score: str, threshold: float = 0.5) -> dict[str, float | None]:
    m, r = confusion_matrix(df, y, score, threshold), ranking_metrics(df, y, score).first()
    names = ("accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy", "mcc")
    return {k: getattr(m, k) for k in names} | r.asDict()
