import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from harborline.llm.decontaminate import RUN, SHARE, contaminated, decontaminate


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def brute(docs, items):
    """Every alignment, judged by the rule alone: no seed is asked for."""
    found = set()
    for d, text in docs:
        a = words(text)
        for i, item in items:
            b = words(item)
            need = min(RUN, len(b))
            flags = [[a[x + s] == b[x] for x in range(len(b)) if 0 <= x + s < len(a)] for s in range(-len(b), len(a))]
            if b and any(sum(f[k : k + need]) >= -(-need * SHARE // 1) for f in flags for k in range(len(f) - need + 1)):
                found.add((d, i))
    return found


def test_every_placing_of_replaced_words(spark):
    """Items of 1 to 20 words with every choice of words that the rule lets differ within a run."""
    rng = random.Random(10)
    vocab = [f"v{i}" for i in range(5000)]
    items, docs, want = [], [], set()
    for n in range(1, 21):
        b = [rng.choice(vocab) for _ in range(n)]
        items.append((n, " ".join(b)))
        need = min(RUN, n)
        for gone in combinations(range(need), need - int(-(-need * SHARE // 1))):
            w = ["x" if k in gone else b[k] for k in range(need)]
            want.add((len(docs), n))
            docs.append((len(docs), " ".join(["y", *w, "z"])))
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= got and len(want) > 700


def test_columns_named_as_the_operators_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 1, 2, 3), (2, "some thing else", 1, 2, 3), (None, None, 1, 2, 3)], "doc_id long, text string, _doc long, _h long, __h long")
    kept = decontaminate(docs, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, None}


def test_substitutions_and_edges(spark):
    rng = random.Random(8)
    vocab = [f"wort{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(10, 45)))) for i in range(12)] + [(50, "too short an item"), (51, None), (3, "again " * 20)]
    docs = []
    for i in range(90):
        w = text(rng.randrange(5, 80))
        if i % 3:
            b = items[rng.randrange(12)][1].split()
            for _ in range(i % 5):
                b[rng.randrange(len(b))] = rng.choice(vocab).upper()
            cut = rng.choice([0, 0, 0, 4])
            w = w[: len(w) // 2] + b[cut : len(b) - cut] + w[len(w) // 2 :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(500, None), (501, ""), (None, docs[1][1]), (502, "again " * 300), docs[1], (1, "other text of a repeated id"), (503, " ".join(text(30000)))]
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, item_id int, h string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(d, b).collect()}
    want = brute([x for x in docs if x[0] != 503], items)
    assert {x for x in got if x[0] != 503} == want and len(want) > 40
    kept = decontaminate(d, b)
    assert kept.columns == d.columns
    bad = {x for x, _ in want}
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect())
    assert left == sorted((-1 if i is None else i, t or "") for i, t in docs if i not in bad or t == "other text of a repeated id")


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert contaminated(d.limit(0), b).count() == 0
    assert contaminated(d, b.limit(0)).count() == 0
    assert decontaminate(d, b.limit(0)).count() == 1


def test_every_alignment_of_a_short_item(spark):
    """Judged by the rule alone, without asking for a seed."""
    rng = random.Random(9)
    vocab = [f"wort{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(n * 10 + k, " ".join(text(n))) for n in range(1, 16) for k in range(3)] + [(900, "same same same same same same"), (901, "a b a b a b a b a b"), (902, "")]
    docs = []
    for i in range(240):
        b = items[rng.randrange(len(items) - 1)][1].split()
        for _ in range(i % 4):
            b[rng.randrange(len(b))] = "other"
        docs.append((i, " ".join([f"x{rng.randrange(99)}" for _ in range(rng.randrange(4))] + b + text(rng.randrange(3)))))
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 150


def test_an_item_of_one_frequent_word(spark):
    """A hundred thousand rows hold the word, some of them thousands of times: no text gathers its hits."""
    d = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50000 == 0, F.repeat(F.lit("yes word "), 2000)).when(F.col("id") % 3 == 0, F.lit("Yes.")).otherwise(F.concat(F.lit("oh yes "), F.col("id"))).alias("text"))
    b = spark.createDataFrame([(1, "Yes."), (2, "oh yes 77")], "item_id long, text string")
    got = contaminated(d, b).groupBy("item_id").count().collect()
    assert {r.item_id: r["count"] for r in got} == {1: 100_000, 2: 1}
    assert decontaminate(d, b, least=3).count() == 99_999
