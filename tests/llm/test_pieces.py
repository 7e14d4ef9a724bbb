import math
import os
from collections import Counter

import numpy as np
import __spark_entry__
import pytest

from harborline.llm.pieces import MODEL, Lattices, Vocabulary, decoded, forward, sampled, top_k

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer file")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary()


def every(v, text):
    """All segmentations of a text with their probabilities."""
    out = {}

    def walk(i, ids, w):
        if i == len(text):
            out[tuple(ids)] = w
            return
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in v.ids:
                x = v.ids[text[i:j]]
                walk(j, [*ids, x], w * v.weights[x])
        if text[i] not in v.ids:
            walk(i + 1, [*ids, *[v.byte_ids[b] for b in text[i].encode()]], w)

    walk(0, [], 1.0)
    total = sum(out.values())
    return {k: w / total for k, w in out.items()}


TEXTS = ["the", "a b", "on▁é\n", "ab  c", "日本\U0001f600", "x"]


def test_probabilities_and_distinct_samples(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, ""), (0, TEXTS[0])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sample int")
    got = sampled(docs, k=6).collect()
    for i, t in enumerate(TEXTS):
        want = every(vocabulary, " " + t)
        mine = {tuple(r.ids): r for r in got if r.doc_id == i}
        assert len(mine) == min(6, len(want))
        assert all(math.exp(r.log_prob) == pytest.approx(want[ids], rel=1e-9) for ids, r in mine.items())
        values = [r.perturbed for r in sorted(mine.values(), key=lambda r: r.sample)]
        assert values == sorted(values, reverse=True) and len(set(values)) == len(values)
        assert all(0 < r.inclusion <= 1 and math.log(r.inclusion) == pytest.approx(r.log_inclusion, abs=1e-9) for r in mine.values())
    assert all(r.decoded_equal and r.n_pieces == len(r.ids) for r in got)
    assert [(r.sample, r.n_pieces, r.inclusion) for r in got if r.doc_id == 101] == [(1, 0, 1.0)]
    assert len([r for r in got if r.doc_id == 0]) == 2 * len({r.ids_hash for r in got if r.doc_id == 0})
    back = {(r.doc_id, r.text) for r in decoded(sampled(docs, k=2)).collect()}
    assert back == {(i, t or "") for i, t in rows}


def test_long_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab" * 40000), (2, "word and " * 30000), (3, "\n" * 1000), (4, " " * 5000)], "doc_id long, text string")
    got = sampled(docs, k=3).collect()
    assert all(r.decoded_equal for r in got) and Counter(r.doc_id for r in got) == {1: 3, 2: 3, 3: 1 if len([r for r in got if r.doc_id == 3]) == 1 else 3, 4: 3}
    assert sampled(docs.limit(0)).count() == 0


def test_frequencies_follow_gumbel_top_k(vocabulary):
    """First picks follow the probabilities, second picks those of drawing without replacement."""
    text = "onl"
    want = every(vocabulary, " " + text)
    lattices = Lattices(vocabulary)
    n, first, pairs = 6000, Counter(), Counter()
    nodes, units = lattices.units([text] * n)
    assert len(set(nodes.tolist())) < 4
    arcs = lattices.view()
    keys = np.random.default_rng(3).integers(0, 2**63, n).astype(np.uint64)
    paths, there, _ = top_k(arcs, nodes, units, keys, 2)
    read = [arcs.piece[p.flat[forward(p)]] for p in paths]
    ids = [[tuple(x[p.text_at[i] : p.text_at[i + 1]].tolist()) for i in range(n)] for x, p in zip(read, paths, strict=True)]
    for a, b in zip(*ids, strict=True):
        assert a != b
        first[a] += 1
        pairs[a, b] += 1
    for a, p in want.items():
        assert abs(first[a] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        for b, q in want.items():
            if a != b:
                r = p * q / (1 - p)
                assert abs(pairs[a, b] / n - r) < 5 * math.sqrt(r * (1 - r) / n) + 1e-3


def test_deep_branches_are_worked_out_when_needed(vocabulary, monkeypatch):
    def ids():
        lattices = Lattices(vocabulary)
        nodes, units = lattices.units(["onl thing", "the", "a"] * 20)
        arcs = lattices.view()
        paths, there, threshold = top_k(arcs, nodes, units, np.arange(60, dtype=np.uint64), 4)
        return [arcs.piece[p.flat].tolist() for p in paths], [x.tolist() for x in there], threshold.tolist()

    want = ids()
    monkeypatch.setattr("harborline.llm.pieces.DEEP", 0.5)
    assert ids() == want


def test_the_result_does_not_depend_on_partitioning(spark):
    docs = spark.createDataFrame([(i, f"some text number {i} and more") for i in range(50)], "doc_id long, text string")
    key = lambda df: sorted((r.doc_id, r.sample, r.ids_hash) for r in sampled(df).collect())
    assert key(docs.repartition(1)) == key(docs.repartition(7))


def test_lattices_built_together_and_alone_agree(vocabulary):
    units = [" the", "ation", "日本x", " ", "\n", "!!??", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    one, two = Lattices(vocabulary), Lattices(vocabulary)
    codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    assert list(one.add_all(codes, np.array([len(u) for u in units]))) == [two.add(u) for u in units]
    for name in ("first", "number", "piece", "start", "node"):
        assert list(getattr(one, name)) == list(getattr(two, name)), name
    assert np.allclose(one.p, two.p) and np.allclose(one.upto, two.upto)


def test_op10_returns_the_segmentations(spark, tmp_path):
    spark.createDataFrame([(1, "some words to cut"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["op10_sentencepiece_sampling"](spark, str(tmp_path)).collect()
    assert all(len(r.ids) == r.n_pieces for r in got) and sum(r.n_pieces > 0 for r in got) == 2
