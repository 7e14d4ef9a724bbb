"""The manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest

from harborline.llm.merkle import manifest, manifest_sql
from tests.oracle import check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(leaves):
    """The root, and for every leaf its steps (run, place)."""
    paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for path, i in zip(paths, at, strict=True):
            path.append((runs[i // 8], i % 8))
        level, at = [h("".join(r)) for r in runs], [i // 8 for i in at]
    return level[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for g in langs}
    trees = {g: tree([leaf_of(*r) for r in groups[g]]) for g in langs}
    root, crowns = tree([trees[g][0] for g in langs])
    out = []
    for g, crown in zip(langs, crowns, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            full, proof = path + crown, ""
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            now = leaf_of(r[0], r[1].encode().lower().decode(), *r[2:]) if changed else leaf_of(*r)
            for run, i in full:
                proof += "".join(run[:i] + run[i + 1 :])
                now = h("".join(run[:i] + [now] + run[i + 1 :]))
            out.append((r[0], leaf_of(*r), trees[g][0], root, h(proof), now, now == root))
    return sorted(map(str, out))


def run(spark, rows, extra=()):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        docs = docs.withColumn(name, docs.n_chars)
    return sorted(str(tuple(r)) for r in manifest(docs).collect())


@pytest.mark.parametrize("counts", [{"en": 1}, {"en": 8, "de": 9}, {"en": 65, None: 1, "": 7, "ü": 64, "zz": 2}, {f"l{i}": 1 + i % 3 for i in range(11)}])
def test_against_a_plain_tree(spark, counts):
    rows = [(1000 * j + i * 7 % 61 if i % 5 else i, f"Text {i} ÄB" * (i % 4), g, None if i % 6 == 0 else f"s{i % 3}", i) for j, (g, n) in enumerate(counts.items()) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_long_texts_and_clashes(spark):
    rows = [(None, None, None, None, None), (None, "", "en", "", 0), (3, "LONG " * 100000, "en", "s", 5), *[(3, "LONG " * 100000, "en", "s", 5)] * 9, (4, "1:a", "en", "-", 1), (5, "x", "de", "s", 1)]
    assert run(spark, rows, ("g", "pos", "n", "digest", "row", "part", "run", "path", "root", "changed")) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_lower_casing_is_found_out_and_only_that(spark):
    rows = [(i, "Capital" if i % 2 else "none", "en", "s", 1) for i in range(200)]
    for doc_id, *_, verified in (tuple(r) for r in manifest(spark.createDataFrame(rows, SCHEMA)).collect()):
        assert verified == (doc_id % 2 == 0 or zlib.crc32(str(doc_id).encode()) % 3 != 0)


def test_sql(spark):
    check(spark, "/root/testdata/sf0.001", lambda s, d: manifest(s.read.parquet(f"{d}/documents.parquet")), manifest_sql())
