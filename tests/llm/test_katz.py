import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from harborline.llm import katz
from harborline.llm.katz import discounts, fit, in_slots, kept_slots, lm_scores, pair_key
from harborline.llm.scratch import Scratch
from harborline.llm.text import Lookup


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    uni, bi = Counter(), Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            x = tokens(t)
            uni.update(x)
            bi.update(zip(["<s>", *x], x, strict=False))
    n, v = sum(uni.values()), len(uni)
    d1, d2 = discounts(Counter(uni.values())), discounts(Counter(bi.values()))
    cut = lambda c, d: d[c - 1] * c if c <= 5 else c
    seen = sum(cut(c, d1) for c in uni.values()) / max(n, 1)
    unknown = max(1 - seen, 1 / (n + 1))
    p1 = defaultdict(lambda: unknown, {w: cut(c, d1) * (1 - unknown) / seen / n for w, c in uni.items()})
    after = defaultdict(dict)
    for (h, w), c in bi.items():
        after[h][w] = cut(c, d2)
    ch = lambda h: sum(not x for x in held) if h == "<s>" else uni[h]
    p2, alpha = {}, {}
    for h, ws in after.items():
        share = min(sum(ws.values()) / ch(h), ch(h) / (ch(h) + 1))
        p2[h] = {w: x * share / sum(ws.values()) for w, x in ws.items()}
        alpha[h] = (1 - share) / (1 - sum(p1[w] for w in ws))
        total = sum(p2[h].values()) + alpha[h] * (sum(p for w, p in p1.items() if w not in ws) + unknown)
        assert total == pytest.approx(1, abs=1e-9)
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        x = tokens(t)
        s = sum(math.log10(p2[a][w] if w in p2.get(a, ()) else alpha.get(a, 1.0) * p1[w]) for a, w in zip(["<s>", *x], x, strict=False))
        out.append((-1 if i is None else i, h, len(x), sum(uni[w] > 0 for w in x), n, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), s))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "near"), [(0, 0), (7, 5), (1 << 18, 1 << 17)])
def test_matches_brute_force(spark, hot, near):
    rng = random.Random(9)
    word = lambda: f"W{int(rng.paretovariate(0.7)) % 500}" + rng.choice(["", "", "É"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [rows[5], rows[5], (None, "w1 w2 w3 unseen"), (900, None), (901, ""), (902, "w1 " * 3000), (0, "another text of a used id"), (903, rows[7][1])]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = sorted(((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in lm_scores(docs, hot=hot, near=near).collect()), key=str)
    want = brute(rows)
    key = lambda r: (r[0], r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


def test_no_rows_and_no_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(100)], "doc_id long, text string")
    assert lm_scores(docs.limit(0)).count() == 0
    only = docs.where("crc32(cast(doc_id as string)) % 10 = 0")
    assert {(r.score, r.base_score, r.n_known) for r in lm_scores(only).collect()} == {(0.0, 0.0, 0)}


def test_discounts_fall_back():
    assert all(0 < d <= 1 for d in discounts({}) + discounts({1: 5}) + discounts({1: 1, 2: 50, 3: 9, 6: 4}))


def test_bigrams_seen_once_stay_where_held_out_texts_have_them(spark):
    """Any other bigram of a training text that is not found was seen once, so it need not be joined."""
    docs = spark.createDataFrame([("a b", False), ("a b c d", False), ("c d x c d", True)], "text string, held boolean")
    model = fit(docs, Scratch(spark, "katz-test"))
    assert sorted(r.c for r in model.pairs.collect()) == [1, 1, 2, 2] and (model.n, model.v) == (8, 5)
    assert sorted(r.c for r in model.histories.collect()) == [1, 1, 2, 2, 2]


def test_slots_are_found_alike_in_both_engines(spark):
    x = np.random.default_rng(4).integers(-(1 << 63), (1 << 63) - 1, (600, 2))
    table = kept_slots(spark.createDataFrame(x[:300].tolist(), "h long, w long")).value
    found = in_slots(table, pair_key(*x.T.astype(np.int64).view(np.uint64).copy()))
    assert found[:300].all() and found[300:].sum() < 10 and not in_slots(np.zeros(8192, np.uint8), pair_key(*x.T.copy().view(np.uint64))).any()


def test_few_rows_leave_a_text():
    """Bigrams of a training text that were seen once stay, and a word and its history are one row."""
    none = Lookup.of(np.zeros(0, np.uint64), np.zeros((0, 2)))
    shared, slots = (type("", (), {"value": v}) for v in ([none, none], np.zeros(8192, np.uint8)))
    batch = pa.record_batch([[1, 2], [1, 2], ["a b c d", "a b c d"], [False, True]], ["row", "row2", "text", "held"])
    (got,) = katz._looked_up(shared, slots, -0.5, 0, 1)(iter([batch]))
    # four words, an end and a start; the held-out text's five bigrams; a row of sums
    assert [sum(r["row"] == i for r in got.to_pylist()) for i in (1, 2)] == [7, 12]
    assert [r["extra"] for r in got.to_pylist() if r["extra"]] == [[5.0, 0.0, -2.5, 0.0], [5.0, 0.0, 0.0, 0.0]]
