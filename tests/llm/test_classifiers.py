import random

import numpy as np

from harborline.llm.quality import isotonic, quality
from harborline.llm.text import LOWER, span_hash
from harborline.llm.toxicity import NEAR, Lexicon, _returns, evidence, segments, toxicity


def brute_segments(x):
    """Recursive definition: the best segment (longest of the least that score it), then both sides."""
    best = max(((sum(x[i:j]), -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    s, _, i, j = best
    return brute_segments(x[:i]) + [(i, j, s)] + [(a + j, b + j, v) for a, b, v in brute_segments(x[j:])]


def test_segments_match_the_definition():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.uniform(-1, 1) + rng.choice([-0.3, 0.2]) for _ in range(rng.randrange(0, 14))]
        fine = [(a, b, round(v, 9)) for a, b, v in brute_segments(x)]
        assert [(a, b, round(v, 9)) for a, b, v in segments(np.array(x))] == fine


def lexicon(**scores):
    """A lexicon of whole words of up to four letters."""
    hashes = []
    for word in scores:
        values = LOWER[np.frombuffer(word.encode(), np.uint8)].astype(np.uint64) + np.uint64(1)
        hashes.append(span_hash(values, np.array([0]), np.array([len(word)]))[0])
    order = np.argsort(np.array(hashes))
    return Lexicon(np.array(hashes)[order], np.array(list(scores.values()))[order], -0.2, k=0.1)


def passages(model, *texts):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    return evidence(model, np.frombuffer(b"".join(raw), np.uint8), ends)


def test_a_passage_is_found_wherever_it_stands():
    model, filler, bad = lexicon(zork=4.0, blar=4.0, quux=4.0, fnor=4.0), "ok " * 2 * NEAR, "zork blar quux fnor "
    once, five, late, word = passages(model, filler + bad + filler, (filler + bad) * 5, ("zork " + filler) * 20 + bad, "zork " * 40)[2]
    assert [round(x) for _, _, x in once] == [16] and len(five) == 5
    assert [(s, e) for s, e, _ in five] == [(i * (2 * NEAR + 4) + 2 * NEAR, (i + 1) * (2 * NEAR + 4)) for i in range(5)]
    assert all(abs(x - once[0][2]) < 1e-9 for _, _, x in five)
    assert late and late[-1][1] == 20 * (2 * NEAR + 1) + 4 and round(late[-1][2]) == 16
    assert sum(x for _, _, x in word) <= 8  # one word over and over is little evidence
    x = passages(model, filler + bad + "ok " * 4 * (2 * NEAR + 4), (filler + bad) * 5)[0]
    assert x[0] < x[1] < 2 * x[0]  # and so are copies of one passage


def test_returns_are_counted_by_score():
    assert list(_returns(np.array([7, 5, 7, 7]), -np.array([1.0, 9, 3, 2]))) == [2, 0, 0, 1]


def test_isotonic():
    steps, levels = isotonic(np.array([3.0, 1, 2, 4, 4]), np.array([0.0, 0, 1, 1, 0]))
    assert list(steps) == [1, 2] and list(levels) == [0, 0.5]
    assert list(isotonic(np.zeros(0), np.zeros(0))[0]) == []


def corpus(spark, bad):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(30, 120))]
        y = int(rng.random() < 0.2)
        rows.append((i, bad(rng, w) if y else " ".join(w), "en", 1.0))
        labels.append((i, y, 1 - y))
    rows += [(5000, None, "en", 0.0), (5001, "", None, 0.0), (5001, "", None, 0.0), (5002, "a" * 200000, "en", 0.0)]
    labels += [(3, None, None), (None, 1, 1), (99999, 1, 0)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"),
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int"),
        {i: y for i, y, _ in labels[:900]},
    )


def accuracy(found, truth):
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert held
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_toxicity_finds_planted_words(spark):
    def insult(rng, w):
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(["Zork!", "blarg", "(quux)"])
        return " ".join(w)

    docs, labels, truth = corpus(spark, insult)
    found = toxicity(docs, labels).collect()
    assert len(found) == 904 and all(0 <= r.score <= 1 for r in found)
    assert accuracy(found, truth) > 0.97
    assert [r.passages for r in found if r.doc_id == 5000] == [[]]
    assert all(r.predicted == 0 for r in found if r.doc_id >= 5000)


def test_quality_rejects_junk(spark):
    docs, labels, truth = corpus(spark, lambda rng, w: " ".join([w[0]] * len(w)) if rng.random() < 0.5 else " ".join(x.upper() + "!!" for x in w))
    found = quality(docs, labels).collect()
    assert len(found) == 904 and all(0 <= r.score <= 1 for r in found)
    assert accuracy(found, {i: 1 - y for i, y in truth.items()}) > 0.97


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for f in (toxicity, quality):
        assert [(r.doc_id, r.predicted) for r in f(docs, none).collect()] == [(1, 0)]
        assert f(docs.limit(0), none).count() == 0
