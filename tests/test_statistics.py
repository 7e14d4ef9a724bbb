import math
import random

import numpy as np
import pytest

from harborline.functions import distributions as D
from harborline.functions import hypothesis as H
from harborline.functions import intervals as I
from harborline.operators import metrics as M
from harborline.operators import models as L
from harborline.operators import profiling as P
from harborline.operators import rules as R


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (D.normal_cdf(1.96), 0.9750021), (D.normal_sf(8), 6.2210e-16), (D.normal_ppf(0.975), 1.9599640), (D.t_two_sided_p(2.2281389, 10), 0.05), (D.t_sf(1.812461, 10), 0.05), (D.t_ppf(0.975, 10), 2.2281389),
        (D.chi2_sf(15.507313, 8), 0.05), (D.chi2_ppf(0.95, 8), 15.507313), (D.f_sf(3.68232, 2, 15), 0.05), (D.betainc(2, 3, 0.4), 0.5248), (D.gammainc(3, 0.5), 0.0143877), (D.f_cdf(3.68232, 2, 15), 0.95), (D.chi2_cdf(15.507313, 8), 0.95),
    ],
)
def test_distribution_tables(got, want):
    assert got == pytest.approx(want, rel=1e-4)


def test_far_tails_keep_their_precision():
    assert 0 < D.chi2_sf(300, 3) < 1e-60 and 0 < D.t_two_sided_p(60, 40) < 1e-35 and D.normal_sf(20) > 0


def two(spark, a, b):
    return frame(spark, [("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, x double")


def test_t_tests(spark):
    a, b = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9, 16.9, 20.1, 21.9, 22.6, 23.1, 19.6, 19.0, 21.7, 21.4], [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8, 22.0, 24.8, 20.2, 21.9, 22.1, 22.9, 30.0, 23.9]
    r = H.t_test(two(spark, a, b), "x", "g")
    mean = lambda v: sum(v) / len(v)
    se2 = [sum((x - mean(v)) ** 2 for x in v) / (len(v) - 1) / len(v) for v in (a, b)]
    assert r.statistic == pytest.approx((mean(a) - mean(b)) / math.sqrt(sum(se2)))
    assert r.df == pytest.approx(sum(se2) ** 2 / sum(x * x / 14 for x in se2)) and 0.005 < r.p_value < 0.01 and r.interval.high < 0
    assert H.t_test(two(spark, a, b), "x", "g", equal_var=True).df == 28
    p = H.paired_t_test(frame(spark, [(1.0, 1.0), (2.0, 2.0)], "a double, b double"), "a", "b")
    assert (p.statistic, p.p_value) == (0.0, 1.0)


def test_anova_and_levene(spark):
    groups = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    df = frame(spark, [(g, float(x)) for g, v in groups.items() for x in v], "g string, x double")
    r = H.anova_oneway(df, "x", "g")
    assert r.statistic == pytest.approx(9.2647, abs=1e-3) and r.p_value == pytest.approx(0.0024, abs=1e-4) and r.df == (2, 15)
    assert 0 < H.levene_test(df, "x", "g").p_value <= 1


def test_chi_square_proportions_and_ranks(spark):
    rows = [("a", "x")] * 20 + [("a", "y")] * 30 + [("b", "x")] * 30 + [("b", "y")] * 20
    r = H.chi_square_independence(frame(spark, rows, "p string, q string"), "p", "q")
    assert r.statistic == pytest.approx(4.0) and r.df == 1 and r.p_value == pytest.approx(0.0455, abs=1e-4) and r.effect == pytest.approx(0.2)
    z = H.proportion_z_test(40, 100, 30, 100)
    assert z.statistic == pytest.approx(1.4825, abs=1e-3) and z.p_value == pytest.approx(0.1382, abs=1e-3)
    u = H.mann_whitney_u(two(spark, [1, 2, 2, 3], [2, 4, 5, 6]), "x", "g")
    assert u.statistic == 2.0 and u.effect == pytest.approx(-0.75)


def test_multiple_testing(spark):
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]
    df = frame(spark, [(i, x) for i, x in enumerate(p)], "k int, p double")
    assert sum(r.rejected for r in H.benjamini_hochberg(df, "p", "k").collect()) == 4
    assert sum(r.rejected for r in H.bonferroni(df, "p").collect()) == 3


def test_intervals(spark):
    w = I.wilson_interval(5, 10)
    assert (round(w.low, 4), round(w.high, 4)) == (0.2366, 0.7634)
    assert I.wilson_interval(0, 10).low == 0 and I.wilson_interval(10, 10).high == 1 and I.wald_interval(5, 10).contains(0.5) and I.agresti_coull_interval(5, 10).width < 0.6
    d = I.difference_in_proportions_interval(56, 70, 48, 80)
    assert d.low == pytest.approx(0.0524, abs=1e-3) and d.high == pytest.approx(0.3339, abs=1e-3)
    df = frame(spark, [(i, float(i % 10)) for i in range(500)], "k int, x double")
    m, b = I.mean_interval(df, "x"), I.bootstrap_interval(df, "x", 300, key="k")
    assert m.contains(4.5) and b.contains(4.5) and b.width == pytest.approx(m.width, rel=0.25)
    assert b == I.bootstrap_interval(df.repartition(7), "x", 300, key="k")


def test_bootstrap_of_any_statistic(spark):
    rng = random.Random(8)
    rows = [(i, rng.lognormvariate(0, 1), rng.gauss(0, 1)) for i in range(400)]
    rows += [(1000, None, 1.0), (1001, float("nan"), 1.0)]
    df, x = frame(spark, rows, "k long, x double, y double"), I.F.col("x")
    known = np.array([r[:3] for r in rows[:400]])
    w = I.poisson_weights(known[:, 0].astype(np.int64), 50, 3)
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.05 and w.max() > 4
    ranked = known[known[:, 1].argsort(), 1]
    heavy = np.cumsum(w[known[:, 1].argsort()], axis=0)
    for s, want in (
        (I.mean_of(x), (w * known[:, 1:2]).sum(0) / w.sum(0)),
        (I.ratio_of(I.F.col("y"), x), (w * known[:, 2:]).sum(0) / (w * known[:, 1:2]).sum(0)),
        (I.deviation_of(x), np.array([np.repeat(known[:, 1], w[:, b]).std(ddof=1) for b in range(50)])),
        (I.correlation_of(x, I.F.col("y")), np.array([np.corrcoef(np.repeat(known[:, 1], w[:, b]), np.repeat(known[:, 2], w[:, b]))[0, 1] for b in range(50)])),
        (I.Quantile(x, 0.9), np.array([ranked[np.argmax(heavy[:, b] >= 0.9 * heavy[-1, b])] for b in range(50)])),
    ):
        clean = df.where("k < 1000")
        whole, got = I.bootstrap_values(clean.repartition(3), s, 50, 3, I.F.col("k"))
        assert got == pytest.approx(want, rel=1e-9) and min(want) <= whole <= max(want)
    assert I.bootstrap_values(df, I.Quantile(x, 0.5), 20, 3, I.F.col("k"))[0] == sorted(known[:, 1])[199]
    with pytest.raises(ValueError, match="no value"):
        I.bootstrap_values(df.limit(0), I.mean_of(x), 10)


def test_metrics(spark):
    df = frame(spark, [(1, 0.9, 1), (1, 0.4, 2), (0, 0.8, 3), (0, 0.1, 4)], "y int, s double, k int")
    m = M.confusion_matrix(df, "y", "s")
    assert (m.tp, m.fn, m.fp, m.tn) == (1, 1, 1, 1) and m.mcc == 0 and m.f1 == 0.5
    assert M.evaluate(df, "y", "s")["roc_auc"] == 0.75
    flat = df.withColumn("s", df.s * 0 + 0.5)
    assert M.ranking_metrics(flat, "y", "s").first().roc_auc == 0.5
    assert M.ranking_metrics(df.where("y = 1"), "y", "s").first().roc_auc is None
    assert M.optimal_threshold(df, "y", "s")[1] == pytest.approx(0.8)
    assert [r.n for r in M.lift_table(frame(spark, [(i % 2, i / 11, i) for i in range(11)], "y int, s double, k int"), "y", "s", "k", 4).orderBy("bin").collect()] in ([2, 3, 3, 3], [3, 3, 3, 2])


def test_logistic_recovers_coefficients(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(20000):
        x = [rng.gauss(0, 1) for _ in range(3)]
        p = 1 / (1 + math.exp(-(-1.5 + 0.8 * x[0] - 1.2 * x[1])))
        rows.append((*x, int(rng.random() < p)))
    fit = L.fit_logistic(frame(spark, rows, "a double, b double, c double, y int"), ["a", "b", "c"], "y")
    assert fit.converged and not fit.separated and all(abs(g - w) < 0.07 for g, w in zip(fit.coef, (-1.5, 0.8, -1.2, 0), strict=True))
    assert fit.p_values[1] < 1e-10 and fit.likelihood_ratio[1] < 1e-10 and 0 < fit.mcfadden_r2 < 1 and fit.aic < fit.bic


def test_kmeans_finds_blobs(spark):
    rng = random.Random(4)
    rows = [([cx + rng.gauss(0, 0.5), cy + rng.gauss(0, 0.5)],) for cx, cy in ((0, 0), (6, 6), (0, 6)) for _ in range(150)]
    df = frame(spark, rows, "x array<double>")
    fit = L.fit_kmeans(df, "x", 3, n_init=2)
    assert sorted(fit.sizes) == [150, 150, 150] and L.silhouette_score(fit.predict(df, "x"), "x", "cluster") > 0.7
    frame_ = fit.centroid_frame(spark).collect()
    assert [r.cluster for r in frame_] == [0, 1, 2] and {r.share_pct for r in frame_} == {33.33} and fit.converged
    chosen = L.choose_k(df, "x", [2, 3, 4], n_init=2)
    assert [c["recommended"] for c in chosen] == [False, True, False] and chosen[1]["elbow"]


def test_kmeans_shares_its_passes(spark, monkeypatch):
    """Twenty planted clusters: found from every seed, in passes that do not grow with the starts."""
    rows = [([100.0 * (i % 20) + i % 7, 50.0 * (i % 20 % 3)],) for i in range(2000)]
    df = frame(spark, rows, "x array<double>")
    for starts in (1, 4):
        passes = []
        for name in ("_seeding_pass", "_assignment_pass"):
            monkeypatch.setattr(L, name, lambda *a, f=getattr(L, name): (passes.append(1), f(*a))[1])
        assert L.fit_kmeans(df, "x", 20, n_init=starts).sizes == [100] * 20 if starts == 4 else True
        monkeypatch.undo()
        assert len(passes) <= 1 + 5 + 1 + 10


def test_standardise(spark):
    got = L.standardise(frame(spark, [(1.0, 5.0, 1), (3.0, 5.0, 2)], "a double, b double, k int"), ["a", "b"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0, 1), (1.0, 0.0, 2)]


def test_anomalies(spark):
    one = lambda v: frame(spark, [(float(x) if x is not None else None,) for x in v], "x double")
    count = lambda df: df.where("is_outlier").count()
    assert count(P.mad_outliers(one([10, 11, 10, 12, 11, 10, 11, 5000]), "x")) == 1
    assert count(P.mad_outliers(one([10] * 20 + [900, 950, 1000]), "x")) == 3
    assert count(P.mad_outliers(one([5] * 10), "x")) == 0 and count(P.mad_outliers(one([5] * 30 + [9999]), "x")) == 1
    digits = one([1, -19, 1900, 0.0019, 23, 900, 0, float("nan"), float("inf"), 5]).select(P.first_digit(P.F.col("x")).alias("d")).collect()
    assert [r.d for r in digits] == [1, 1, 1, 1, 2, 9, None, None, None, 5]
    assert P.benford_test(one([2**i for i in range(200)]), "x").conforms and not P.benford_test(one([5 + i % 3 for i in range(300)]), "x").conforms
    series = frame(spark, [(i, 10.0 if i < 20 else 30.0) for i in range(40)], "t int, x double")
    found = P.detect_structural_break(series, "t", "x")
    assert (found.index, found.before, found.after) == (20, 10, 30)
    assert found.pct_change == 200 and P.Break(1, 0.0, 3.0, 1.0).pct_change is None
    assert P.detect_structural_break(series.limit(5), "t", "x") is None
    rates = P.standardise_rate(frame(spark, [(1, "a", 1), (1, "b", 0), (2, "a", 0), (3, "c", 1)], "p int, s string, y int"), "p", "y", "s", weights={"a": 3, "b": 1})
    assert {r.p: (r.rate, r.coverage) for r in rates.collect()} == {1: (0.75, 1.0), 2: (None, 0.75)}
    pairs = P.correlation_pairs(frame(spark, [(float(i), 2.0 * i, float(i * i % 7)) for i in range(20)], "a double, b double, c double")).collect()
    assert [(r.a, r.b) for r in pairs] == [("a", "b")]
    assert P.profile_table(one([1, 2, 3, 10, None])).first().skew == pytest.approx(1.7636, abs=1e-3)


def test_rules(spark):
    df = frame(spark, [(1, "a", 0.0), (None, "b", 5.0), (3, "z", 10.0), (None, None, 11.0), (1, "a", -1.0)], "k int, s string, x double")
    parent = frame(spark, [(1,), (2,)], "id int")
    rules = [R.not_null("k"), R.unique("k"), R.in_range("x", 0, 10), R.in_set("s", ["a", "b"]), R.foreign_key("k", parent, "id"), R.row_count_between(1, 3), R.matches("s", "[a-b]"), R.not_null("absent"), R.non_negative("x"), R.monotonic_dates("x", "x")]
    report = R.validate(df, rules, "t")
    assert {r.rule: r.n_failed for r in report.results} == {"k_not_null": 2, "k_unique": 4, "x_in_range": 2, "s_in_set": 2, "k_foreign_key": 1, "row_count": 5, "s_matches": 2, "x_non_negative": 1, "x_monotonic": 0}
    assert report.skipped == [("t", "absent_not_null")] and not report.passed and len(report.results[0].sample) == 2
    with pytest.raises(R.ValidationError):
        report.raise_if_failed()
    assert R.validate(df.limit(0), rules, "t").passed
    assert report.to_frame(spark).count() == 9


def test_failing_rows_are_sampled_in_the_counting_job(spark):
    rows = [(i, f"s{i}", float(-i) if i % 3 else None) for i in range(900)]
    df = frame(spark, rows, "k int, s string, x double").repartition(7)
    rules = [R.not_null("x"), R.non_negative("x"), R.in_range("k", 3, 10_000), R.not_null("k"), *[R.expression(f"e{i}", lambda i=i: R.F.col("k") == i, ("k",)) for i in range(70)]]
    spark.sparkContext.setJobGroup("rules", "")
    report = R.validate(df, rules, "t")
    again = R.validate(df.repartition(3), rules, "t")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    by = {r.rule: r for r in report.results}
    assert (by["x_not_null"].n_failed, by["x_non_negative"].n_failed, by["k_in_range"].n_failed, by["k_not_null"].n_failed) == (300, 600, 3, 0)
    assert [by[f"e{i}"].sample for i in (0, 69)] == [[{"k": i, "s": f"s{i}", "x": None}] for i in (0, 69)]
    assert len(by["x_not_null"].sample) == 5 and all(x["x"] is None for x in by["x_not_null"].sample) and sorted(x["k"] for x in by["k_in_range"].sample) == [0, 1, 2] and by["k_not_null"].sample == []
    assert report == again


def test_monotonic_dates_across_bins(spark):
    from harborline.operators.ranking import previous

    rng = random.Random(2)
    rows = [(rng.choice([1, 1, rng.randrange(500)]), rng.choice([None, rng.randrange(9)])) for _ in range(1500)]
    ordered = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    for n in (1, 7, 90):
        got = previous(frame(spark, rows, "o int, v int").repartition(5), "v", "o", "before", bins=n).collect()
        want = [(o, v, b) for (o, v), b in zip(ordered, [None, *[v for _, v in ordered]], strict=False)]
        assert sorted(map(str, ((r.o, r.v, r.before) for r in got))) == sorted(map(str, want))


def test_rates_are_judged_by_their_base(spark):
    df = frame(spark, [("2024-01-01", "USD", "INR", 10.0), ("2024-01-01", "EUR", "INR", 10.0)], "date string, base string, quote string, rate double")
    assert {r.rule: r.n_failed for r in R.validate(df, R.fx_suite(), "fx").results}["usd_inr_plausible"] == 1


def test_many_tables_one_report(spark):
    a, b = frame(spark, [(1,), (None,)], "x int"), frame(spark, [("y",)], "s string")
    report = R.validate_many({"a": (a, [R.not_null("x")]), "b": (b, [R.not_null("s"), R.not_null("t")])})
    assert [(r.table, r.n_failed) for r in report.results] == [("a", 1), ("b", 0)] and report.skipped == [("b", "t_not_null")]


def test_points_go_to_python_packed_and_ties_keep_the_first_centre(spark):
    rng = np.random.default_rng(3)
    centres = np.vstack([c := rng.normal(0, 1, (3, 8)), c[:1], c[1] + 1e-15])
    points = np.vstack([rng.normal(0, 1, (3000, 8)), (c[0] + c[1]) / 2, c, 1e8 + rng.normal(0, 1, (50, 8)), np.zeros((0, 8))])
    d = ((points[:, None] - centres[None]) ** 2).sum(-1)
    at, gap = L.nearest(points, centres)
    assert (at == d.argmin(1)).all() and (gap == d.min(1)).all()
    df = spark.createDataFrame([(p.tolist(), i) for i, p in enumerate(points)], "x array<double>, h long").repartition(2)
    rows = L.packed(df).collect()
    assert len(rows) == 2 and sum(r.n for r in rows) == len(points)
    assert sorted(h for r in rows for h in np.frombuffer(r.h, np.int64)) == list(range(len(points)))
