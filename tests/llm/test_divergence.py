"""Divergence against fractions-free plain Python, and against SQL."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from harborline.llm import divergence as module
from harborline.llm.divergence import SQL, divergence, per_billion
from tests.oracle import check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, groups, whole = Counter(), {}, Counter()
        for g, s, terms in docs:
            if g == lang:
                df.update(set(terms))
                groups.setdefault(s, Counter()).update(terms)
                whole.update(terms)
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)

        def p(c, t, kept=kept):
            return 1 + 1000000000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept))

        for s, c in groups.items():
            f = lambda a, b: (a - b) * (a - b) // (a + b)
            pairs = [(sum(f(p(c, t), p(e, t)) for t in kept), o) for o, e in groups.items() if o != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t)]
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                for i, (v, x) in enumerate(sorted(found, key=lambda y: (-y[0], y[1].encode()))[:n]):
                    out.append((lang, s, part, x, v, i + 1))
    return sorted(map(str, out))


def run(docs, **kw):
    return sorted(str(tuple(r)) for r in divergence(docs, **kw).collect())


def made(n=150):
    rng = random.Random(4)
    words = ["Alpha", "beta", "gam-ma", "Äpfel", "äpfel", "été", "日本", "z9z", "x_y", "\U0001f600", "zebra", "rare" + "x" * 300]
    return [(i, " ".join(rng.choices(words, weights=range(1, 13), k=rng.randrange(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ß", None, ""]), i) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_python(spark, monkeypatch, small):
    if small:  # many chunks, terms over the edge of a batch, texts passed on in parts
        for name, size in (("HELD", 20), ("ROWS", 3), ("TERMS", 2), ("CELLS", 7)):
            monkeypatch.setattr(module, name, size)
    rows = made()
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_nulls_repeats_long_texts_and_clashes(spark):
    rows = [(None,) * 5, *[(3, "ONE " * 50000 + "two", "en", "s", 1)] * 12, (4, "", "en", "t", 1), (5, "12 .. 3", "xx", "only", 1), (6, "few", "yy", "a", 1), (7, "few", "yy", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("term", "n", "d", "part", "item", "value", "rank", "names"):
        docs = docs.withColumn(name, docs.n_chars)
    assert run(docs) == brute(rows)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_no_overflow():
    counts, total = np.array([0, 1, 10**12, 9 * 10**14]), 9 * 10**14 + 7
    assert per_billion(counts + 2, total).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]


def test_sql(spark):
    check(spark, "/root/testdata/sf0.001", lambda s, d: divergence(s.read.parquet(f"{d}/documents.parquet")), SQL)
