"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

The features are statistics of a whole text, standardised on the sample. cos(Wx + b) with W drawn from
a normal distribution approximates a Gaussian kernel; its normal equations are sums over rows, taken
per partition, so what reaches the driver is a fixed number of fixed-size matrices. Half of the sample
fits the ridge weights, the other half the isotonic map from raw score to probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline.llm.labelled import SAMPLE, held_out, sample
from harborline.llm.rules import STRESS, SYMBOLS, UPPER, repeated_lines, repeated_words
from harborline.llm.scratch import Scratch, fresh
from harborline.llm.text import bounded_batches, chunks, frugal, mix, per_text, words

N_FEATURES, WIDTH, PARTS = 12, 192, 8


def statistics(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """N_FEATURES statistics of each text; all zero without words."""
    w = words(data, texts)
    hashes = w.hashes(lower=True)
    raw = data.tobytes()
    lines = np.array([repeated_lines(raw[a:b]) for a, b in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True)], float).reshape(-1, 2)
    n, chars = w.counts.astype(float), np.diff(texts).astype(float)
    lengths = (w.ends - w.starts).astype(float)
    key = np.sort(hashes ^ mix(w.owner.astype(np.uint64)))
    # distinct words per text, counted where a word first occurs in it
    order = np.argsort(hashes ^ mix(w.owner.astype(np.uint64)), kind="stable")
    fresh = np.zeros(len(key), bool)
    fresh[order[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]] = True
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])
    ascii_other = (data >= 33) & (data < 127) & ~(((data | 32) >= 97) & ((data | 32) <= 122)) & ~((data >= 48) & (data < 58))
    digits = (data >= 48) & (data < 58)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (w.owner[1:] == w.owner[:-1])
    words_, bytes_ = np.maximum(n, 1), np.maximum(chars, 1)
    mean = total(lengths) / words_
    out = np.column_stack([
        np.log1p(n),
        mean,
        np.sqrt(np.maximum(total(lengths**2) / words_ - mean**2, 0)),
        per_text(UPPER[data], texts) / bytes_,
        per_text(SYMBOLS[data], texts) / bytes_,
        per_text(STRESS[data], texts) / bytes_,
        per_text(ascii_other, texts) / bytes_,
        per_text(digits, texts) / bytes_,
        total(fresh) / words_,
        repeated_words(hashes, w.first, w.windows(3)) / words_,
        lines[:, 1] / np.maximum(lines[:, 0], 1),
        total(same) / words_,
    ])
    out[n == 0] = 0
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: block starts in x and the mean of y in each block, rising."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    at, first, last = np.unique(x, return_index=True, return_counts=True)
    sums, counts, starts = [], [], []
    for value, i, n in zip(at, first, last, strict=True):
        sums.append(float(y[i : i + n].sum()))
        counts.append(int(n))
        starts.append(float(value))
        while len(sums) > 1 and sums[-2] * counts[-1] >= sums[-1] * counts[-2]:
            s, c = sums.pop(), counts.pop()
            starts.pop()
            sums[-1] += s
            counts[-1] += c
    return np.array(starts), np.array(sums) / np.array(counts)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.w, self.b) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps):
            return np.zeros(len(x))
        return self.levels[np.maximum(np.searchsorted(self.steps, self.raw(x), "right") - 1, 0)]


def fourier(z: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.column_stack([np.cos(z @ w + b) * np.sqrt(2 / len(b)), z, np.ones(len(z))])


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, label, x) with the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, texts in chunks(batch):
                x = statistics(data, texts)
                flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32), pa.array(x.ravel()))
                yield pa.record_batch([batch.column("doc_id")[rows.start : rows.stop], batch.column("label")[rows.start : rows.stop], flat], ["doc_id", "label", "x"])

    return docs.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(frugal(run), "doc_id long, label int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, modulus: int = 5, remainder: int = 0, bound: int = SAMPLE, width: int = WIDTH, gamma: float = 0.08, ridge: float = 1e-2, seed: int = 7) -> Model:
    """The model of the labelled sample; without labelled rows, one that scores 0."""
    rows = scratch.save(featured(sample(docs, labels, "quality", modulus, remainder, bound)), "features")
    at = F.col("x")
    moments = rows.agg(F.count("*"), *[F.avg(at[i]) for i in range(N_FEATURES)], *[F.stddev_pop(at[i]) for i in range(N_FEATURES)]).first()
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (N_FEATURES, width)), rng.uniform(0, 2 * np.pi, width)
    if not moments[0]:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), w, b, np.zeros(width + N_FEATURES + 1), np.zeros(0), np.zeros(0))
    mean, scale = np.array(moments[1 : N_FEATURES + 1], float), np.array(moments[N_FEATURES + 1 :], float)
    scale[scale < 1e-9] = 1.0
    k = width + N_FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx, xy = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            x = np.array(batch.column("x").flatten()).reshape(-1, N_FEATURES)
            z, y = fourier((x - mean) / scale, w, b), np.array(batch.column("label"), float)
            xx += z.T @ z
            xy += z.T @ y
        yield pa.record_batch([pa.array([xx.tobytes()]), pa.array([xy.tobytes()])], ["xx", "xy"])

    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    parts = rows.where(half).select("x", "label").repartition(PARTS).mapInArrow(frugal(sums), "xx binary, xy binary").collect()
    xx = sum(np.frombuffer(p.xx).reshape(k, k) for p in parts)
    xy = sum(np.frombuffer(p.xy) for p in parts)
    weights = np.linalg.solve(xx + ridge * np.eye(k), xy)
    model = Model(mean, scale, w, b, weights, np.zeros(0), np.zeros(0))
    rest = rows.where(~half).select("x", "label").toArrow()
    if not rest.num_rows:  # a handful of labels that all fell to the other half
        rest = rows.select("x", "label").toArrow()
    if rest.num_rows:
        x = np.array(rest.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES)
        # rounded, so that the order in which partitions were summed cannot split a step
        model.steps, model.levels = isotonic(np.round(model.raw(x), 6), np.array(rest.column("label"), float))
    return model


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, texts in chunks(batch):
                yield pa.record_batch([*[batch.column(i)[rows.start : rows.stop] for i in range(batch.num_columns)], pa.array(shared.value.score(statistics(data, texts)))], names)

    names = [*docs.columns, name]
    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, remainder: int = 0, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts are scored by all-zero statistics. A document labelled more than once counts
    with its largest label; labels without a document and null labels are ignored. Without any
    labelled row every score is 0. Extra columns are ignored, repeated rows each get a row, a null doc_id is
    kept and not held out, a text of any length is one row, an empty table gives an empty result. Equal scores are predicted alike.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(docs, labels, scratch, modulus, remainder, bound)
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns, whatever their names.

    Rows are treated as in ``quality``; an empty table stays empty. Without a labelled row outside the
    held-out fold nothing can be judged, which is an error for a table with rows.
    """
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, Scratch(docs.sparkSession, "quality"))
    if not len(model.steps) and not docs.isEmpty():
        raise ValueError("no labelled document to learn quality from")
    (name,) = fresh(docs, "_score")
    return scored(docs, model, name).where(F.col(name) >= threshold).drop(name)
