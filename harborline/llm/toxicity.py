"""Toxic passages by maximum-scoring segments.

Fitting counts, over three quarters of the labelled sample, the documents of either class that hold a
token (or the stem it begins with), but no more than the distinct words it follows there, lest copies
of one passage count as many, and takes log-odds under a Dirichlet prior proportional to the token's
share of the sample. Tokens whose log-odds differ from zero by more than chance keep a score of their
own; all others share one. Both classes are distributions over that alphabet and a score is the log of
their ratio, so its expectation over clean text is negative and the scale of its extremes is about 1
(lambda of extreme-value theory).

Scoring scans a text once and finds every maximal segment; tokens of one sign in a row are one item.
A token's return within ``NEAR`` tokens counts half of what it counted before, because words in one
place are no independent draws; further away it counts in full, so a passage is found wherever it
stands. The chance that clean text of n tokens holds a segment of score S is 1 - exp(-K n exp(-S)).
Segments with an expectation under ``expect`` are significant and all are given. Their excesses over
that floor add up to the text's evidence, halved for each earlier segment of the same leading token,
and a logistic map turns it into the probability of label 1. K and that map are fitted on the last
quarter of the sample, which the scores have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.labelled import SAMPLE, held_out, sample
from harborline.llm.scratch import Scratch
from harborline.llm.text import LOWER, PUNCTUATED, Words, bounded_batches, chunks, frugal, mix, span_hash, words

#: Log-odds in standard errors from which a token has a score of its own; the prior's weight in documents. With
#: this prior a token that stands in a few documents cannot be significant, so the lexicon is far smaller than
#: the bounded sample it comes from.
SIGNIFICANT, PRIOR = 4.0, 50.0
#: Tokens within which returns of a token are discounted.
NEAR = 64

#: A token is known by itself or by its first bytes, so inflected forms of one stem count together.
STEMS = (4, 5)


def forms(w: Words) -> list[np.ndarray]:
    """Hashes of the lower-cased tokens, then of their stems; a token no longer than a stem has none (0)."""
    values = LOWER[w.data].astype(np.uint64) + np.uint64(1)
    stems = [np.where(w.ends - w.starts > n, span_hash(values, w.starts, np.minimum(w.starts + n, w.ends)) ^ np.uint64(n), 0) for n in STEMS]
    return [span_hash(values, w.starts, w.ends), *stems]


@dataclass
class Lexicon:
    keys: np.ndarray
    scores: np.ndarray
    other: float
    k: float = 1.0
    a: float = 0.0
    b: float = 0.0

    def tokens(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
        """Every token's discounted score and the form it has it from (0: none)."""
        w = words(data, texts, PUNCTUATED)
        scores, key = np.full(len(w.starts), self.other), np.zeros(len(w.starts), np.uint64)
        best = np.zeros(len(w.starts))
        for h in forms(w) if len(self.keys) else ():
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            better = (self.keys[at] == h) & (np.abs(self.scores[at]) > best)
            scores[better], key[better] = self.scores[at[better]], h[better]
            best[better] = np.abs(scores[better])
        hot = np.flatnonzero(scores > 0)
        order = hot[np.lexsort((hot, key[hot], w.owner[hot]))]
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (w.owner[order][1:] != w.owner[order][:-1])
        # places on one axis, on which different forms or texts are further apart than NEAR
        place = np.cumsum(new) * (len(scores) + NEAR + 1) + order
        scores[order] *= 0.5 ** np.minimum(np.arange(len(order)) - np.searchsorted(place, place - NEAR), 60)
        return scores, key, w


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, by one linear scan.

    A segment is maximal if no segment that overlaps it scores more and none that contains it has the
    property too; segments of score 0 or less are none.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(positive)) + 1
    begin = np.concatenate([[0], edge])
    sums = np.add.reduceat(scores, begin)
    end = np.concatenate([edge, [len(scores)]])
    found: list[list[float]] = []  # start, end, total before it, total with it
    total = 0.0
    for s, e, x in zip(begin.tolist(), end.tolist(), sums.tolist(), strict=True):
        if x > 0:
            new = [s, e, total, total + x]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= new[2]:
                    j = int(found[j][4]) if len(found[j]) > 4 else j - 1
                if j < 0 or found[j][3] >= new[3]:
                    found.append([*new, j])
                    break
                new = [found[j][0], e, found[j][2], new[3]]
                del found[j:]
        total += x
    return [(int(f[0]), int(f[1]), f[3] - f[2]) for f in found]


def evidence(lexicon: Lexicon, data: np.ndarray, texts: np.ndarray, expect: float = 0.5) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
    """Per text: the combined excess of its significant segments, its tokens, and those segments."""
    scores, key, w = lexicon.tokens(data, texts)
    out, found = np.zeros(len(texts) - 1), [[] for _ in range(len(texts) - 1)]
    hot = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(scores > 0)])[w.first]))
    for i in hot.tolist():
        n = w.first[i + 1] - w.first[i]
        floor = np.log(lexicon.k * n / expect)
        found[i] = [(s, e, x) for s, e, x in segments(scores[w.first[i] : w.first[i + 1]]) if x > floor]
        if found[i]:
            lead = [key[w.first[i] + s + int(np.argmax(scores[w.first[i] + s : w.first[i] + e]))] for s, e, _ in found[i]]
            excess = np.array([x - max(floor, 0) for _, _, x in found[i]])
            out[i] = (excess * 0.5 ** np.minimum(_returns(np.array(lead), -excess), 60)).sum()
    return out, w.counts, found


def _returns(keys: np.ndarray, by: np.ndarray) -> np.ndarray:
    """How many equal keys come before each, in the order of ``by``."""
    order = np.lexsort((np.arange(len(keys)), by, keys))
    first = np.concatenate([[0], np.flatnonzero(np.diff(keys[order])) + 1])
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(first, np.diff(np.concatenate([first, [len(keys)]])))
    return out


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, modulus: int = 3, remainder: int = 1, bound: int = SAMPLE) -> Lexicon:
    """The lexicon of the labelled sample with its calibration; without both classes, one that scores 0."""
    last = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    whole = scratch.save(sample(docs, labels, "toxic", modulus, remainder, bound).select("doc_id", "text", F.col("label").cast("int"), last.alias("last")), "sample")
    sizes = {(r.label, r.last): r.n for r in whole.groupBy("label", "last").agg(F.count("*").alias("n")).collect()}
    split = all(sizes.get((label, part)) for label in (0, 1) for part in (False, True))
    toxic, clean = (sizes.get((label, False), 0) + (0 if split else sizes.get((label, True), 0)) for label in (1, 0))
    if not toxic or not clean:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0), 0.0, a=-50.0)
    # a sample with a class in one part only is too small to be split: both fits take all of it
    rows, unseen = (whole.where("not last"), whole.where("last")) if split else (whole, whole)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per form: the documents of either class that hold it."""
        for batch in batches:
            for part, data, texts in chunks(batch):
                w = words(data, texts, PUNCTUATED)
                h, owner = np.concatenate(forms(w)), np.tile(w.owner, len(STEMS) + 1)
                first = np.unique(h ^ mix(owner.astype(np.uint64)), return_index=True)[1]
                key, at = np.unique(h[first], return_inverse=True)
                one = np.array(batch.column("label")[part.start : part.stop])[owner[first]] == 1
                t = np.bincount(at, one, len(key)).astype(np.int64)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(t), pa.array(np.bincount(at, minlength=len(key)) - t)], ["token", "t", "c"])

    def ranked(counts: DataFrame) -> pa.Table:
        """The forms that differ by more than chance, by hash."""
        share = (F.col("t") + F.col("c")) / (toxic + clean)
        t, c = F.col("t") + PRIOR * share, F.col("c") + PRIOR * share
        odds = F.log(t / (toxic + PRIOR + 1 - t)) - F.log(c / (clean + PRIOR + 1 - c))
        z = F.abs(odds / F.sqrt(1 / t + 1 / c))
        found = counts.select("token", "t", "c", z.alias("z")).where(F.col("z") > SIGNIFICANT).toArrow()
        return found.take(np.argsort(np.array(found.column("token"), np.int64).view(np.uint64)))

    first = ranked(rows.select("text", "label").mapInArrow(frugal(count), "token long, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    known = docs.sparkSession.sparkContext.broadcast(np.array(first.column("token"), np.int64).view(np.uint64))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per known form and word before it: whether a class has the pair."""
        for batch in batches:
            for part, data, texts in chunks(batch):
                w = words(data, texts, PUNCTUATED)
                h, owner = forms(w), w.owner
                left = np.zeros_like(h[0])
                left[1:] = np.where(owner[1:] == owner[:-1], h[0][:-1], 0)
                h, left, owner = np.concatenate(h), np.tile(left, len(h)), np.tile(owner, len(h))
                at = np.flatnonzero(known.value[np.minimum(np.searchsorted(known.value, h), len(known.value) - 1)] == h) if len(known.value) else np.zeros(0, int)
                one = (np.array(batch.column("label")[part.start : part.stop])[owner[at]] == 1).astype(np.int64)
                pair = np.unique(np.rec.fromarrays([h[at].view(np.int64), left[at].view(np.int64), one]))
                yield pa.record_batch([pa.array(np.ascontiguousarray(pair[x])) for x in pair.dtype.names], ["token", "left", "one"])

    pairs = rows.select("text", "label").mapInArrow(frugal(neighbours), "token long, left long, one long").distinct()
    contexts = pairs.groupBy("token").agg(F.sum("one").alias("tp"), F.sum(1 - F.col("one")).alias("cp"))
    table = docs.sparkSession.createDataFrame(first.select(["token", "t", "c"]))
    top = ranked(table.join(contexts, "token").select("token", F.least("t", "tp").alias("t"), F.least("c", "cp").alias("c")))
    keys = np.array(top.column("token"), np.int64).view(np.uint64)
    t, c = np.array(top.column("t"), float), np.array(top.column("c"), float)
    # a token of a document is one of about n; the class-wise chance of a token is its documents over all tokens
    lengths = scratch.save(rows.select("label", "text").mapInArrow(frugal(_lengths), "label int, n long"), "lengths").groupBy("label").agg(F.sum("n").alias("n")).collect()
    n = {r.label: max(1, r.n) for r in lengths}
    prior = PRIOR * (t + c) / (n[0] + n[1])
    p, q = (t + prior) / (n[1] + PRIOR), (c + prior) / (n[0] + PRIOR)
    lexicon = Lexicon(keys, np.log(p / q), float(np.log(max(1 - p.sum(), 1e-6) / max(1 - q.sum(), 1e-6))))
    lexicon.other = min(lexicon.other, -1e-3)
    found = _evidence(unseen, lexicon, 1e30).toArrow()  # every segment, before K is known
    y = np.array(found.column("label"), float)
    best, size = np.array(found.column("best"), float), np.array(found.column("n"), float)
    neg = y == 0
    lexicon.k = float(max(neg.sum(), 1) / max((size[neg] * np.exp(-best[neg])).sum(), 1.0))
    found = _evidence(unseen, lexicon, 0.5).toArrow().sort_by("doc_id")
    lexicon.a, lexicon.b = logistic(np.array(found.column("x"), float), np.array(found.column("label"), float))
    return lexicon


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, texts in chunks(batch):
            yield pa.record_batch([batch.column("label")[part.start : part.stop], pa.array(words(data, texts, PUNCTUATED).counts)], ["label", "n"])


def _evidence(rows: DataFrame, lexicon: Lexicon, expect: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, texts in chunks(batch):
                x, n, found = evidence(shared.value, data, texts, expect)
                best = np.array([max((s for _, _, s in f), default=0.0) for f in found], float)
                yield pa.record_batch([*[batch.column(c)[part.start : part.stop] for c in ("doc_id", "label")], pa.array(x), pa.array(n), pa.array(best)], ["doc_id", "label", "x", "n", "best"])

    return rows.select("doc_id", "text", "label").mapInArrow(frugal(run), "doc_id long, label int, x double, n long, best double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of a logistic fit of y on x, the slope not below 0; beyond 30 more evidence does not steer the fit."""
    design, beta = np.column_stack([np.ones(len(x)), np.minimum(x, 30)]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, modulus: int = 3, remainder: int = 1, bound: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and its toxic passages.

    passages: first token, token after the last, and score of every significant maximal segment.
    Tokens are runs of letters and digits, lower-cased in ASCII. Null and empty texts have no passage
    and the score of a text without evidence; a text of any length is one row. Labels are treated as in
    the quality classifier. Repeated rows each get a row, a null doc_id is kept and not held out, extra
    columns are ignored, an empty table gives an empty result. Equal scores are predicted alike; segments
    of equal score stand in the order of the text.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, scratch, modulus, remainder, bound))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, data, texts in chunks(batch):
                x, _, found = evidence(model, data, texts)
                score = 1 / (1 + np.exp(-np.clip(model.a + model.b * x, -700, 700)))
                passages = pa.array([[{"start": s, "end": e, "score": v} for s, e, v in f] for f in found], kind)
                yield pa.record_batch([batch.column("doc_id")[part.start : part.stop], pa.array(score), passages], ["doc_id", "score", "passages"])

    found = docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, score double, passages array<struct<start:int,end:int,score:double>>")
    return found.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
