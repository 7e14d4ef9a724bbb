import random

import corpus_pipeline
import numpy as np

from harborline.llm import wide
from harborline.llm.text import mix
from harborline.llm.wide import _STEPS, _TIES, FEW, MINIMUM, SETS, STARS, WORDS, found_share, least_equal_bits, one_of_each, overlaps, rarest, signatures, to_least, xxhash_long


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows, least=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if similarity(x, sets[j]) >= least and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    first = {}
    for (d, _), r in zip(rows, root, strict=True):
        first[r] = min(d, first.get(r, d))
    return sorted(first.values())


def corpus(rng):
    vocab = [f"w{i}" for i in range(500)]
    rows = [[rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 60, 150, 300]))] for _ in range(60)]
    for _ in range(140):
        near = list(rng.choice(rows))
        for _ in range(rng.randrange(0, 9)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        rows.append(near)
    return list(enumerate([" ".join(r) for r in rows] + ["", None, " \t", "a b c d e " * 3000]))


def test_edited_copies_leave_the_pipeline(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(400)]
        rows.append((2 * i, " ".join(base)))
        for _ in range(5):
            base[rng.randrange(400)] = "edit"
        rows.append((2 * i + 1, " ".join(base)))
    assert all(0.8 <= similarity(shingles(rows[i][1]), shingles(rows[i + 1][1])) < 0.95 for i in range(0, 80, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(0, 80, 2))


def test_matches_brute_force(spark):
    rows = corpus(random.Random(6))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, key string")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute(rows)
    assert one_of_each(docs.limit(0)).count() == 0


def pair_found(a, b, n):
    """Whether the index finds random sets of a and b shingles of which n are in both: a list in common, and the tally."""
    rng = np.random.default_rng([a, b, n])
    trials = 200
    pool = rng.integers(0, 1 << 63, (trials, a + b - n), np.uint64)
    one, other = (signatures(x.ravel(), np.full(trials, x.shape[1])) for x in (pool[:, :a], pool[:, a - n :]))
    equal = (one ^ other).view(np.uint8).reshape(trials, 8 * WORDS) == 0
    return float(((equal.sum(1) >= MINIMUM) & equal[:, SETS].all(2).any(1)).mean()), float((np.bitwise_count(~(one ^ other)).sum(1) >= least_equal_bits(0.8)).mean())


def test_recall_of_the_index_over_sizes():
    """Sets beyond FEW at the least similarity, sizes odd and even, equal and unequal: 0.9 on the whole, nothing far below."""
    shares = []
    for n in [*range(FEW + 1, 130, 5), 150, 151, 200, 255, 320, 400]:
        for b in {n, n + n // 10}:
            both = -(-4 * (n + b) // 9)  # the least overlap that reaches 0.8
            found, possible = pair_found(n, b, both)
            shares.append(found)
            assert found >= 0.9 and possible > 0.99, (n, b, found, possible)
    assert np.mean(shares) > 0.94
    assert found_share(0.8) > 0.95 and found_share(0.85) > 0.996 and found_share(0.9) > 0.9999


def test_short_texts_miss_no_pair(spark):
    """Every set size up to FEW, one pair right at or just over the similarity and one just under."""
    rng, rows, want = random.Random(8), [], []
    for n in range(4, FEW + 1):
        for less in (0, 1):
            common = -(-8 * n // 9) - less  # of two sets of n: n - common replaced at the end
            if n + n - common > 0 and common > 0:
                words = [f"v{rng.randrange(10**9)}" for _ in range(n + 4)]
                near = [*words[: common + 4], *[f"e{rng.randrange(10**9)}" for _ in range(n - common)]]
                assert (similarity(shingles(" ".join(words)), shingles(" ".join(near))) >= 0.8) == (common / (2 * n - common) >= 0.8)
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(near))]
                want += [len(rows) - 2] if common * 5 >= (2 * n - common) * 4 else [len(rows) - 2, len(rows) - 1]
    assert sorted(r.doc_id for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_a_group_of_near_copies_makes_few_rows(spark):
    """Copies of one text with edits of their own, under the similarity to each other: they share no rare shingle."""
    rng = random.Random(9)
    base, rows = [f"v{i}" for i in range(200)], []
    for i in range(600):
        own = list(base)
        for k in rng.sample(range(0, 200, 5), 9):
            own[k] = f"e{i}x{k}"
        rows.append((i, " ".join(own)))
    rows += [(1000, " ".join(base)), (1001, " ".join([*base[:199], "end"]))]
    sets = spark.createDataFrame([(i, [hash(x) & (1 << 62) - 1 for x in shingles(t)]) for i, t in rows], "class long, shingles array<long>")
    assert rarest(sets, 0.8).count() < 20 * len(rows)
    assert sorted(r.doc_id for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)


def test_slots_are_found_alike_in_both_engines(spark):
    x = np.array([0, 1, -1, 2**62, -(2**63), 123456789], np.int64)
    got = spark.createDataFrame([(int(v),) for v in x], "x long").selectExpr("xxhash64(x) AS h").collect()
    assert [r.h for r in got] == xxhash_long(x).view(np.int64).tolist()


def test_signatures_of_long_texts():
    rng = np.random.default_rng(3)
    hashes, counts = rng.integers(0, 1 << 63, 1700, np.uint64), np.array([1, 255, 256, 1188])
    got, at = signatures(hashes, counts), 0
    for row, n in zip(got, counts, strict=True):
        for word, step, tie in zip(row.tolist(), _STEPS, _TIES, strict=True):
            bits = (mix(hashes[at : at + n] * step)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            assert word == sum(1 << i for i, ones in enumerate(bits.sum(axis=0).tolist()) if 2 * ones > n or (2 * ones == n and tie[i]))
        at += n


def test_columns_named_as_the_operators_own_and_ties(spark):
    rows = [(1, "a b c", "y", 1, 1, 1, 1), (1, "a b c", "x", 1, 1, 1, 1), (1, "a b c", "x", 1, 1, 1, 1), (2, "A B  c", "w", 1, 1, 1, 1), (None, None, "v", 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _doc long, _h long, _key long, _n long")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.lang) for r in kept.collect()) == [(0, "v"), (1, "x")]


def test_overlaps():
    rng = random.Random(12)
    sets = [None, *[np.array(sorted(rng.sample(range(9000), k)), np.int64) for k in (1, 5, 300, 4000, 6000)], np.zeros(0, np.int64)]
    got = overlaps(np.array([*sets, None], object)[:-1])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == (0 if a is None or b is None else len(set(a) & set(b)))


def test_a_class_meets_few_least_ones(spark):
    """A class of a large group stands in hundreds of lists, each with a least class of its own."""
    members = [(k, 3, c, k % 300) for k in range(1000) for c in (k % 300, 1000, 1001 + k % 2)] + [(2000 + k, 2, c, 299) for k in range(9) for c in (299, 1000)]
    got = [tuple(r) for r in to_least(spark.createDataFrame(members, "key long, n long, class long, least long")).collect()]
    assert len(got) == len(set(got)) and all(sum(b == c for _, b in got) <= 2 * STARS for c in (1000, 1001, 1002))
    assert {(0, 1000), (299, 1000), (0, 1001), (1, 1002)} <= set(got)


def test_lists_of_the_same_classes_are_compared_once(spark, monkeypatch):
    """Two texts under the similarity that share many rare shingles."""
    seen, blocks = [], wide.in_blocks
    monkeypatch.setattr(wide, "in_blocks", lambda rows, *a, **k: (seen.append(rows.count()), blocks(rows, *a, **k))[1])
    one = [f"v{i}" for i in range(204)]
    rows = [(1, " ".join(one)), (2, " ".join([*one[:176], *[f"e{i}" for i in range(28)]]))]
    assert 0.7 < similarity(shingles(rows[0][1]), shingles(rows[1][1])) < 0.8
    assert sorted(r.doc_id for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 2]
    assert seen == [2]


def test_long_near_copies_make_few_rows(spark, monkeypatch):
    """Texts beyond CARRIED with edits of their own: most pairs are under the similarity, and all look near by fingerprint."""
    made, blocks = [], wide.in_blocks

    def counted(rows, *a, **k):
        made.append((rows.count(), (out := blocks(rows, *a, **k)).count()))
        return out

    monkeypatch.setattr(wide, "in_blocks", counted)
    rng = random.Random(14)
    base, rows = [f"v{i}" for i in range(700)], []
    for i in range(48):
        own = list(base)
        for k in rng.sample(range(0, 700, 5), 18):
            own[k] = f"e{i}x{k}"
        own[1], own[3] = f"p{i % 3}", f"q{i % 3}"  # rare shingles in common
        rows.append((i, " ".join(own)))
    near = rows[7][1].split()
    rows.append((100, " ".join([*near[:690], *[f"z{i}" for i in range(10)]])))
    sets = [shingles(t) for _, t in rows]
    assert all(len(s) > wide.CARRIED for s in sets) and len(brute(rows)) > 1
    for bound in (wide.TOGETHER, 4096):
        monkeypatch.setattr(wide, "TOGETHER", bound)
        assert sorted(r.doc_id for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute(rows)
    assert all(out <= n for n, out in made) and len(made) == 4
