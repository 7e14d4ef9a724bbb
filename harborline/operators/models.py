"""Logistic regression by reweighted least squares, and k-means, on distributed sums."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborline.functions.distributions import chi2_sf, normal_sf
from harborline.functions.intervals import z_of


#: Bytes of points in one row of a packed table.
PACKED = 1 << 19


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), x))))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant column becomes 0."""
    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns])).scalar()
    return df.withColumn("_s", stats).select(*[((F.col(c) - F.col("_s")[c]["m"]) / F.when(F.col("_s")[c]["s"] > 0, F.col("_s")[c]["s"]).otherwise(1.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


@dataclass
class LogisticFit:
    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    n: int
    log_likelihood: float
    null_log_likelihood: float
    iterations: int
    converged: bool
    separated: bool
    alpha: float = 0.05

    @property
    def z(self) -> np.ndarray:
        return self.coef / self.se

    @property
    def p_values(self) -> list[float]:
        return [2 * normal_sf(abs(z)) for z in self.z]

    @property
    def intervals(self) -> list[tuple[float, float]]:
        half = z_of(1 - self.alpha) * self.se
        return list(zip((self.coef - half).tolist(), (self.coef + half).tolist(), strict=True))

    @property
    def odds_ratios(self) -> np.ndarray:
        return np.exp(self.coef)

    @property
    def deviance(self) -> float:
        return -2 * self.log_likelihood

    @property
    def mcfadden_r2(self) -> float:
        return 1 - self.log_likelihood / self.null_log_likelihood

    @property
    def aic(self) -> float:
        return self.deviance + 2 * len(self.coef)

    @property
    def bic(self) -> float:
        return self.deviance + math.log(self.n) * len(self.coef)

    @property
    def likelihood_ratio(self) -> tuple[float, float]:
        x = 2 * (self.log_likelihood - self.null_log_likelihood)
        return x, chi2_sf(x, len(self.coef) - 1)

    def linear(self) -> Column:
        return sum((F.col(n) * float(b) for n, b in zip(self.names[1:], self.coef[1:], strict=True)), F.lit(float(self.coef[0])))

    def predict_proba(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return df.withColumn(name, sigmoid(self.linear()))

    def summary(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(b), float(s), float(z), p, *i, float(math.exp(b))) for n, b, s, z, p, i in zip(self.names, self.coef, self.se, self.z, self.p_values, self.intervals, strict=True)]
        return spark.createDataFrame(rows, "term string, coef double, se double, z double, p_value double, low double, high double, odds_ratio double")


def fit_logistic(df: DataFrame, features: list[str], y: str, max_iter: int = 50, tol: float = 1e-8, ridge: float = 1e-8, alpha: float = 0.05) -> LogisticFit:
    """Newton's method on the log-likelihood.

    An iteration is one aggregation: Python workers sum X'WX, X'(y-p) and the log-likelihood over Arrow
    batches, and each returns one fixed-size row. Rows with a null are left out.
    """
    k = len(features) + 1
    data = df.select(*[F.col(c).cast("double") for c in features], F.col(y).cast("double").alias("_y")).dropna().cache()

    def sums(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, g, ll, n, pos = np.zeros((k, k)), np.zeros(k), 0.0, 0, 0.0
            for b in batches:
                cols = [np.array(c) for c in b.columns]
                x, t = np.column_stack([np.ones(b.num_rows), *cols[:-1]]), cols[-1]
                eta = np.clip(x @ beta, -35, 35)
                p = 1 / (1 + np.exp(-eta))
                h += (x * (p * (1 - p))[:, None]).T @ x
                g += x.T @ (t - p)
                ll += float((t * eta - np.logaddexp(0, eta)).sum())
                n, pos = n + b.num_rows, pos + float(t.sum())
            yield pa.record_batch([pa.array([np.concatenate([h.ravel(), g, [ll, n, pos]]).tolist()])], ["s"])

        cells = data.mapInArrow(run, "s array<double>").select(*[F.col("s")[i].alias(f"s{i}") for i in range(k * k + k + 3)])
        v = np.array(cells.agg(*[F.sum(c) for c in cells.columns]).first(), float)
        return v[: k * k].reshape(k, k), v[k * k : k * k + k], v[-3], int(v[-2]), v[-1]

    beta, converged, i = np.zeros(k), False, 0
    for i in range(1, max_iter + 1):
        h, g, ll, n, pos = sums(beta)
        step = np.linalg.solve(h + ridge * np.eye(k), g - ridge * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < tol:
            converged = True
            break
    h, _, ll, n, pos = sums(beta)
    data.unpersist()
    rate = pos / n
    null = n * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate)) if 0 < rate < 1 else 0.0
    se = np.sqrt(np.diag(np.linalg.inv(h + ridge * np.eye(k))))
    return LogisticFit(["intercept", *features], beta, se, n, ll, null, i, converged, bool(np.abs(beta).max() > 15 or ll > -1e-6 * n), alpha)


def squared_distance(x: str, centre: np.ndarray) -> Column:
    """Squared Euclidean distance of an array column to a point."""
    point = F.array(*[F.lit(float(c)) for c in centre])
    return F.aggregate(F.zip_with(x, point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


@dataclass
class KMeansFit:
    centres: np.ndarray
    inertia: float
    iterations: int
    sizes: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    converged: bool = True

    def predict(self, df: DataFrame, x: str, name: str = "cluster") -> DataFrame:
        """``df`` with the nearest centre, the lowest number where two are as near."""
        nearest = F.array_min(F.array(*[F.struct(squared_distance(x, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)]))
        return df.withColumn(name, nearest["i"]).withColumn(f"{name}_distance", nearest["d"])

    def centroid_frame(self, spark: SparkSession) -> DataFrame:
        """(cluster, a column for each dimension, size, share_pct)."""
        names, total = self.names or [f"f{i}" for i in range(self.centres.shape[1])], sum(self.sizes) or 1
        rows = [(i, *map(float, c), n, round(100 * n / total, 2)) for i, (c, n) in enumerate(zip(self.centres, self.sizes, strict=True))]
        return spark.createDataFrame(rows, f"cluster int, {', '.join(f'`{n}` double' for n in names)}, size long, share_pct double")


def packed(data: DataFrame) -> DataFrame:
    """(n, x, h): n points of ``data`` (x, h) a row, all of one width, as the bytes of their doubles and hashes.

    Every pass reads all points, and bytes go to Python as they are, without a conversion of each number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, h = batch.column("x"), batch.column("h").to_numpy()
            points = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            step = max(1, PACKED // max(1, points.shape[1] * 8))
            for at in range(0, len(points), step):
                part = points[at : at + step]
                yield pa.record_batch([pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([h[at : at + step].tobytes()], pa.binary())], ["n", "x", "h"])

    return data.select("x", "h").mapInArrow(run, "n int, x binary, h binary")


def points_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The points and hashes of each row that ``packed`` made."""
    for n, x, h in zip(*(batch.column(c) for c in ("n", "x", "h")), strict=True):
        yield np.frombuffer(x.as_buffer(), float).reshape(n.as_py(), -1), np.frombuffer(h.as_buffer(), np.uint64)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centre, the first where two are as near, and the squared distance, in blocks of bounded size.

    Products of matrices tell the nearest one apart; where another is as near to within their rounding, all differences are taken."""
    at, gap = np.zeros(len(points), np.int64), np.zeros(len(points))
    step = max(1, (1 << 18) // max(1, len(centres) + points.shape[1]))
    squares = (centres**2).sum(1)
    for i in range(0, len(points), step):
        part = points[i : i + step]
        with np.errstate(over="ignore", invalid="ignore"):
            d = squares - 2 * (part @ centres.T)
            best = d.argmin(1)
            least = d[np.arange(len(part)), best]
            # the rounding of a product of this length, with room
            error = 1e-13 * points.shape[1] * ((part**2).sum(1) + squares.max())
            close = np.flatnonzero(~((d <= (least + error)[:, None]).sum(1) == 1))
        for some in range(0, len(close), inner := max(1, (1 << 22) // max(1, centres.size))):
            rows = close[some : some + inner]
            best[rows] = ((part[rows, None] - centres[None]) ** 2).sum(-1).argmin(1)
        at[i : i + step], gap[i : i + step] = best, ((part - centres[best]) ** 2).sum(-1)
    return at, gap


def _seeding_pass(data: DataFrame, starts: list[np.ndarray], take: int, seed: int) -> list[np.ndarray]:
    """``take`` points for each start, drawn without replacement by their squared distance to its centres.

    A point's key is an exponential number over its distance, and the least keys are the sample, so a task
    passes on its own least ones and no total has to be known before. A start without centres draws evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, list[float]]]] = [[] for _ in starts]
        for points, h in (x for batch in batches for x in points_of(batch)):
            for s, centres in enumerate(starts):
                with np.errstate(over="ignore", divide="ignore"):
                    z = (h ^ np.uint64((seed + 1) * 0x9E3779B9 + s)) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ z >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
                    u = ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
                    key = -np.log(u) / (nearest(points, centres)[1] if len(centres) else 1.0)
                some = np.flatnonzero(np.isfinite(key))
                if len(some) > take:
                    some = some[np.argpartition(key[some], take - 1)[:take]]
                best[s] = sorted(best[s] + [(float(key[i]), points[i].tolist()) for i in some])[:take]
        for s, own in enumerate(best):
            yield pa.record_batch([pa.array([s] * len(own), pa.int32()), pa.array([k for k, _ in own], pa.float64()), pa.array([p for _, p in own], pa.list_(pa.float64()))], ["s", "key", "p"])

    drawn = data.mapInArrow(run, "s int, key double, p array<double>")
    first = F.row_number().over(Window.partitionBy("s").orderBy("key", "p")) <= take
    found: list[list[list[float]]] = [[] for _ in starts]
    for r in drawn.withColumn("first", first).where("first").collect():  # starts x take, both given
        found[r.s].append(r.p)
    return [np.unique(np.array(x), axis=0) if x else np.zeros((0, 0)) for x in found]


def _assignment_pass(data: DataFrame, starts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every start in one pass: points and distance of each centre, the sum of its points, and the farthest point of all."""
    width = starts[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [(np.zeros(len(c)), np.zeros(len(c)), np.zeros((len(c), width))) for c in starts]
        far: list[tuple[float, list[float]]] = [(-1.0, [])] * len(starts)
        for points, _ in (x for batch in batches for x in points_of(batch)):
            for i, (centres, (n, d, total)) in enumerate(zip(starts, states, strict=True)):
                if len(points):
                    at, gap = nearest(points, centres)
                    n += np.bincount(at, minlength=len(centres))
                    d += np.bincount(at, gap, minlength=len(centres))
                    total += (at == np.arange(len(centres))[:, None]).astype(float) @ points
                    far[i] = max(far[i], (float(gap.max()), points[gap.argmax()].tolist()))
        rows = [(i, j, float(n[j]), float(d[j]), total[j].tolist(), far[i][0], far[i][1]) for i, (n, d, total) in enumerate(states) for j in range(len(n))]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64())]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["s", "c", "n", "d", "total", "gap", "far"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for r in (r for batch in batches for r in batch.to_pylist()):
            have = found.setdefault((r["s"], r["c"]), [0.0, 0.0, np.zeros(width), (-1.0, [])])
            have[0], have[1], have[2], have[3] = have[0] + r["n"], have[1] + r["d"], have[2] + r["total"], max(have[3], (r["gap"], r["far"]))
        rows = [(*at, n, d, total.tolist(), *far) for at, (n, d, total, far) in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64())]
    names, schema = ["s", "c", "n", "d", "total", "gap", "far"], "s int, c int, n double, d double, total array<double>, gap double, far array<double>"
    # one row a task and centre, which are added up as arrays: a sum for each dimension takes longer to plan than to add
    sums = data.mapInArrow(run, schema).repartition("s", "c").mapInArrow(add, schema)
    out = [(np.zeros(len(c)), np.zeros(len(c)), np.zeros(c.shape), np.zeros(width)) for c in starts]
    for r in sums.collect():
        n, d, total, far = out[r.s]
        n[r.c], d[r.c], total[r.c], far[:] = r.n, r.d, r.total, r.far
    return out


def seeds(data: DataFrame, k: int, n_init: int, seed: int, rounds: int = 5) -> list[np.ndarray]:
    """k centres for each start, by oversampled parallel seeding: ``rounds`` passes draw 2k candidates each, one
    pass weighs them by the points next to them, and k-means++ over the weighted candidates picks k."""
    starts = _seeding_pass(data, [np.zeros((0, 0))] * n_init, 1, seed)
    for i in range(rounds):
        more = _seeding_pass(data, starts, 2 * k, seed + 1 + i)
        starts = [np.unique(np.vstack([a, b]), axis=0) if len(b) else a for a, b in zip(starts, more, strict=True)]
    out = []
    for s, (candidates, (weights, *_)) in enumerate(zip(starts, _assignment_pass(data, starts), strict=True)):
        rng = np.random.default_rng(seed + s)
        centres = candidates[rng.choice(len(candidates), p=weights / weights.sum())][None]
        while len(centres) < k:
            chance = weights * nearest(candidates, centres)[1]
            centres = np.vstack([centres, candidates[rng.choice(len(candidates), p=chance / chance.sum() if chance.sum() else None)]])
        out.append(centres)
    return out


def fit_kmeans(df: DataFrame, x: str, k: int, max_iter: int = 300, tol: float = 1e-6, n_init: int = 5, seed: int = 1, names: list[str] | None = None) -> KMeansFit:
    """Lloyd's iterations from parallel seeds; the best of ``n_init`` starts, all of which share every pass.

    A pass adds up, for every start, the points of each centre in the tasks, a state of fixed size. An
    empty cluster restarts at the farthest point. Labels belong to the final centres. Null points are left out.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(limit, None)
    conf.set(limit, str(4 << 20))
    try:
        return _fit_kmeans(df, x, k, max_iter, tol, n_init, seed, names)
    finally:
        conf.unset(limit) if before is None else conf.set(limit, before)


def _fit_kmeans(df: DataFrame, x: str, k: int, max_iter: int, tol: float, n_init: int, seed: int, names: list[str] | None) -> KMeansFit:
    data = df.select(F.transform(F.col(x), lambda v: v.cast("double")).alias("x")).where("x is not null").withColumn("h", F.xxhash64("x", F.monotonically_increasing_id()))
    data = packed(data).cache()
    if (data.agg(F.sum("n")).first()[0] or 0) < k:
        raise ValueError("fewer points than clusters")
    starts = seeds(data, k, n_init, seed)
    live, done = list(range(n_init)), {}
    for i in range(1, max_iter + 2):
        for s, (n, d, total, far) in zip(list(live), _assignment_pass(data, [starts[s] for s in live]), strict=True):
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], far)
            still = ((moved - starts[s]) ** 2).sum() <= tol
            if still or i > max_iter:
                done[s] = KMeansFit(starts[s], float(d.sum()), min(i, max_iter), n.astype(int).tolist(), names or [], bool(still))
                live.remove(s)
            else:
                starts[s] = moved
        if not live:
            break
    data.unpersist()
    return min(done.values(), key=lambda f: f.inertia)


def silhouette_score(df: DataFrame, x: str, label: str, sample: int = 5000) -> float:
    """Mean Euclidean silhouette over a bounded sample, drawn by hash: a fixed number of points, compared in blocks."""
    n = df.count()
    rate = min(1.0, sample / max(n, 1))
    rows = df.where(F.pmod(F.xxhash64(x), F.lit(1 << 20)) <= int(rate * (1 << 20))).select(x, label).limit(2 * sample).collect()
    points, labels = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    kinds = np.unique(labels)
    if len(kinds) < 2:
        return 0.0
    out = []
    for at in range(0, len(points), 256):
        gaps = np.sqrt(((points[at : at + 256, None] - points[None]) ** 2).sum(-1))
        sums = np.stack([gaps[:, labels == c].sum(1) for c in kinds], 1)
        sizes = np.array([(labels == c).sum() for c in kinds])
        own = np.searchsorted(kinds, labels[at : at + 256])
        row = np.arange(len(own))
        a = sums[row, own] / np.maximum(sizes[own] - 1, 1)
        means = sums / sizes
        means[row, own] = np.inf
        b = means.min(1)
        out.append(np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0))
    return float(np.concatenate(out).mean())


def choose_k(df: DataFrame, x: str, ks: list[int], seed: int = 1, n_init: int = 3) -> list[dict]:
    """Per k: inertia, silhouette, whether the inertia bends there (centred second difference), whether it is recommended."""
    fits = [fit_kmeans(df, x, k, n_init=n_init, seed=seed) for k in ks]
    scores = [silhouette_score(f.predict(df, x), x, "cluster") for f in fits]
    bends = {i: fits[i - 1].inertia - 2 * fits[i].inertia + fits[i + 1].inertia for i in range(1, len(ks) - 1)}
    elbow, best = max(bends, key=bends.get, default=0), max(range(len(ks)), key=scores.__getitem__)
    return [{"k": k, "inertia": f.inertia, "silhouette": s, "elbow": i == elbow, "recommended": i == best} for i, (k, f, s) in enumerate(zip(ks, fits, scores, strict=True))]
