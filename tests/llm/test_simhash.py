import random
import re

import xxhash

from harborline.llm.graph import components
from harborline.llm.scratch import Scratch
from harborline.llm.simhash import links, near_duplicates


def brute(rows):
    def fp(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = [(i, fp(t)) for i, t in rows]
    root = {i: i for i, _ in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in marks:
        for j, b in marks:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((i, f"{a:016x}", find(i)) for i, a in marks)


def corpus():
    rng = random.Random(1)
    vocab = [f"w{i}É" if i % 7 == 0 else f"W{i}" for i in range(400)]
    rows = []
    for i in range(60):
        rows.append([rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 80, 300]))])
    for i in range(60):
        near = list(rows[rng.randrange(60)])
        for _ in range(rng.choice([0, 1, 2])):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        rows.append(near)
    texts = [rng.choice([" ", "\n", " \t"]).join(r) for r in rows]
    return list(enumerate([*texts, "", None, "   ", "x" * 50000, "a b c d " * 3000]))


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(tuple(r) for r in near_duplicates(docs).collect())
    assert got == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert near_duplicates(docs).count() == 0


def test_long_lists_are_cut_into_blocks(spark):
    rng = random.Random(2)
    base = rng.getrandbits(32) << 32
    values = [base | rng.getrandbits(10) for _ in range(200)]
    distinct = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    scratch = Scratch(spark, "test")
    found = {(r.a, r.b) for r in links(spark.createDataFrame([(v,) for v in distinct], "fp long"), 4, scratch, block=16).collect()}
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 4 for a, b in found)
    assert len(found) < len(distinct) ** 2 / 4
    groups = {r.root for r in components(spark.createDataFrame(list(found), "a long, b long"), scratch).collect()}
    todo, comps = set(distinct), 0
    while todo:
        comps, edge = comps + 1, [todo.pop()]
        while edge:
            a = edge.pop()
            near = {b for b in todo if ((a ^ b) & mask).bit_count() <= 4}
            todo -= near
            edge += near
    singles = sum(1 for v in distinct if all(v not in e for e in found))
    assert len(groups) + singles == comps


def test_a_very_long_list_is_posted_once_more(spark):
    rng = random.Random(3)
    base = 0x1234ABCD << 32
    values = [base | rng.getrandbits(32) for _ in range(30000)]
    pairs = [(v, v ^ sum(1 << b for b in rng.sample(range(32), 1 + i % 4))) for i, v in enumerate(values[:300])]
    distinct = sorted({*values, *(b for _, b in pairs)})
    scratch = Scratch(spark, "test")
    edges = links(spark.createDataFrame([(v,) for v in distinct], "fp long"), 4, scratch)
    root = {r.node: r.root for r in components(edges, scratch).collect()}
    assert all(root[a] == root[b] for a, b in pairs)
    assert all((r.a ^ r.b).bit_count() <= 4 for r in edges.collect())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]}
