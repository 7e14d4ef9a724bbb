import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.functions.hypothesis import benjamini_hochberg
from harborline.operators import ranking
from harborline.operators.models import fit_kmeans
from harborline.operators.ranking import exact_quantiles, globally_ranked, ntile, order_key, value_of


def test_ranks_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 5, 7, rng.randrange(100)]), rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(5)
    got = {}
    for small in (0, 10_000):
        out = globally_ranked(df, -F.col("k"), "id", "rn", {"run": "v"}, bins=13, small=small)
        got[small] = [(r.id, r.rn, r.run) for r in out.orderBy("rn").collect()]
    total, want = 0, []
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v
        want.append((i, n, total))
    assert got[0] == want and got[10_000] == want


def test_ntile(spark):
    for n in (1, 3, 10, 23):
        rows = spark.range(1, n + 1).select(ntile(F.col("id"), F.lit(n), 10).alias("t")).collect()
        want = [i + 1 for i in range(min(10, n)) for _ in range(n // 10 + (i < n % 10))]
        assert [r.t for r in rows] == want


def test_exact_quantiles_by_bins(spark):
    rng = random.Random(4)
    values = [rng.choice([0.0, 1.0, rng.gauss(0, 1), rng.gauss(0, 1e9)]) for _ in range(3000)] + [None, float("nan")]
    df = spark.createDataFrame([(v, 7.0) for v in values], "x double, same double")
    marks = [0.0, 0.01, 0.25, 0.5, 0.733, 0.99, 1.0]
    got = exact_quantiles(df, {"x": F.col("x"), "same": F.col("same"), "none": F.lit(None)}, marks, small=40)
    known = sorted(v for v in values if v is not None and v == v)
    assert got["same"] == [7.0] * len(marks) and got["none"] == [None] * len(marks)
    assert got["x"] == pytest.approx(np.quantile(known, marks).tolist(), rel=1e-12)
    assert got == exact_quantiles(df, {"x": F.col("x"), "same": F.col("same"), "none": F.lit(None)}, marks)


WIDE = [-1.7e308, 1.0, 2.0, 3.0, 1.7e308]


@pytest.mark.parametrize("values", [WIDE, [-math.inf, *WIDE, math.inf, 0.0, -0.0], [5e-324, -5e-324, 2.2250738585072014e-308, 1e-310, 0.0], [math.nextafter(2.0**e, d) for e in (-1022, -3, 0, 1, 52, 1023) for d in (0, math.inf)]])
def test_quantiles_of_wide_values(spark, values):
    rows = (values * 9)[:33]
    df = spark.createDataFrame([(v,) for v in rows], "x double")
    assert exact_quantiles(df, {"x": F.col("x")}, [i / 32 for i in range(33)], small=0)["x"] == sorted(rows)


def test_order_key(spark):
    rng = random.Random(5)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)] + [2.0**e for e in range(-1074, 1024)] + [-(2.0**e) * (1 - 2**-53) for e in range(-1021, 1024)]
    values = [v for v in values if v == v]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", order_key(F.col("x")).alias("k")).collect()
    assert all(value_of(r.k) == r.x for r in got)


def test_nine_scans_do_for_all_columns_together(spark, monkeypatch):
    scans = []
    for name in ("_counted", "_read"):
        monkeypatch.setattr(ranking, name, lambda *a, f=getattr(ranking, name): (scans.append(1), f(*a))[1])
    rng = random.Random(6)
    rows = [(struct.unpack("<d", rng.randbytes(7) + b"\x40")[0], -rng.random(), float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = exact_quantiles(df, {c: F.col(c) for c in "abc"}, [0.01, 0.25, 0.5, 0.75, 0.99], small=0)
    assert len(scans) <= 8  # and the one that counts
    for i, c in enumerate("abc"):
        assert got[c] == pytest.approx(np.quantile([r[i] for r in rows], [0.01, 0.25, 0.5, 0.75, 0.99]).tolist(), rel=1e-12)


def test_kmeans_with_few_distinct_points(spark):
    df = spark.range(60000).select(F.array((F.col("id") % 2).cast("double"), F.lit(0.0)).alias("x"))
    assert sorted(fit_kmeans(df, "x", 2, n_init=1).sizes) == [30000, 30000]


def test_least_of_all_later_ranks(spark):
    """Adjusted p-values over many bins and over one, with ties, missing values and keys, against plain Python."""
    rng = random.Random(2)
    p = [rng.choice([0.001, 0.2, rng.random(), rng.random() ** 4, 1.0]) for _ in range(2000)] + [None, None, math.nan]
    df = spark.createDataFrame([(i or None, x) for i, x in enumerate(p)], "k int, p double").repartition(5)
    order = sorted((i for i, x in enumerate(p) if x == x and x is not None), key=lambda i: p[i])
    want, least = {}, 1.0
    for rank in range(len(order), 0, -1):
        least = min(least, p[order[rank - 1]] * len(p) / rank)
        want[order[rank - 1]] = least
    for small in (0, 10_000):
        got = benjamini_hochberg(df, "p", "k", 0.3, small=small).collect()
        assert len(got) == len(p)
        assert all(r.p_adjusted == want.get(r.k or 0, 1.0) and r.rejected == (r.p_adjusted <= 0.3) for r in got)
