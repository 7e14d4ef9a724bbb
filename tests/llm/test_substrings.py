import hashlib
import random
import re
from collections import Counter

from harborline.llm.scratch import Scratch
from harborline.llm.substrings import nonbranching, substring_dedup


def brute(rows, width):
    texts = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {p + j for p in range(len(w) - width + 1) if seen[tuple(w[p : p + width])] > 1 for j in range(width)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    for width, anchor, vocab in ((7, 3, 40), (35, 12, 3000), (5, 2, 3)):
        word = lambda v=vocab: f"w{rng.randrange(v)}" + rng.choice(["", "", "é", "\xa0"])  # noqa: E731, B023
        passages = [[word() for _ in range(rng.randrange(width - 2, 3 * width))] for _ in range(8)]
        rows = []
        for i in range(80):
            w = []
            for _ in range(rng.randrange(1, 5)):
                w += [word() for _ in range(rng.randrange(0, 40))]
                if rng.random() < 0.5:
                    p = rng.choice(passages)
                    a = rng.randrange(0, 4)
                    w += p[a : len(p) - rng.randrange(0, 4)]
            rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
        rows += [rows[3], (200, rows[4][1]), (None, rows[5][1]), (None, "solo " * 3), (201, None), (202, ""), (203, "of " * 500), (204, "of " * 40), (206, "und " * 400), (207, "x1 x2 x3 " * 90), (208, " ".join(f"y{i % 20}" for i in range(90))), (209, " ".join(f"z{i}" for i in range(60)) + " tail " * 50), (200, "other text"), (205, " ".join(word() for _ in range(20000)))]
        docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n_words int, h string")
        got = substring_dedup(docs, width, anchor).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, width), width
        assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nonbranching_chains_compact(spark):
    # 1 -> 2 -> 3 is a chain; 5 and 6 both leave the node where 4 ends; 7 -> 8 -> 7 is a cycle; 9 stands alone
    edges = [(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 20, 21), (5, 21, 22), (6, 21, 23), (7, 30, 31), (8, 31, 30), (9, 40, 41)]
    edges += [(100 + i, 1000 + i, 1001 + i) for i in range(300)]
    df = spark.createDataFrame(edges, "path long, head long, tail long")
    found = {r.path: r.unitig for r in nonbranching(df, Scratch(spark, "test")).collect()}
    assert found == dict.fromkeys((1, 2, 3), 1) | dict.fromkeys((7, 8), 7) | dict.fromkeys(range(100, 400), 100)
