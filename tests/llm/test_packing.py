"""Packing: ids against whole-text encoding, places gapless, bounds against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harborline.llm import packing
from harborline.llm.packing import best_fit_decreasing, best_fit_packing, bounds, sequences, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def direct(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(vocabulary_path()).encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(list("aBz09'.,=<>|%\u0301\u0338\u0331HKéßñΣ日\U0001f600\x1c\xa0\u0130_ \n")), st.characters(codec="utf-8")), max_size=12), max_size=6))
def test_words_by_units_are_what_whole_texts_give(texts):
    texts = [*texts, *[t + "<|endoftext|>," for t in texts[:1]], *["don't'S " + t for t in texts[:1]]]
    ids, n = packing.encoder(vocabulary_path()).encode([t.encode() for t in texts])
    want = [[*packing.encoder(vocabulary_path()).tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [len(w) for w in want] == n.tolist() and [i for w in want for i in w] == ids.tolist()


def least(lengths, capacity):
    """The true number of bins, by trying all packings."""
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + lengths[i] <= capacity:
                put(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=7), st.just(24))
def test_bounds_never_exceed_the_least_number(lengths, capacity):
    whole = bounds(np.bincount(lengths, minlength=capacity + 1)).least
    true = least(sorted(lengths, reverse=True), capacity)
    bins, offsets, filled = best_fit_decreasing(np.array(lengths), capacity)
    assert -(-sum(lengths) // capacity) <= whole <= true <= len(filled)
    assert filled.max() <= capacity and sorted(offsets[bins == 0])[0] == 0


def test_bounds_see_more_than_the_sum():
    assert bounds(np.bincount([2100] * 10, minlength=4097)).least == 10
    assert bounds(np.bincount([1400] * 9, minlength=4097)).least == 5  # two fit, by sum it were 4


def checked(rows, got):
    """Everything the packing promises; gives the number of sequences and the bound."""
    want = sorted((d, zlib.crc32(np.array(ids[i : i + 4096], "<u4").tobytes()), i // 4096, i, len(ids[i : i + 4096])) for d, ids in ((r[0], direct(r[1])) for r in rows) for i in range(0, len(ids), 4096)) if all(r[0] is not None for r in rows) else None
    if want is not None:
        assert sorted((r.doc_id, r.ids_crc32, r.piece, r.start, r.length) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), bounds(np.bincount([r.length for r in got], minlength=4097)).least


def made(n, long=3):
    rng = random.Random(9)
    words = ["Größe", "naïve", "don't", "x=1;", "日本語", "\U0001f600!!", "hello", "WORLD", "é", "a b", "\x1c", "<|endoftext|>x", "3.14", "Σας"]
    rows = [(i, " \t\n".join(rng.choices(words, k=rng.randrange(0, 400))), "en", "s", 1) for i in range(n)]
    return rows + [(n + i, "word and " * (3000 + i), "en", "s", 1) for i in range(long)]


def test_whole_texts(spark):
    rows = made(120)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    n, bound = checked(rows, best_fit_packing(docs).collect())
    assert n == bound


def test_gaps_close_by_exchange(spark):
    """Blocks of large pieces leave room that only the small pieces of other blocks fill."""
    rows = [(i, "word " * (2729 if i < 30 else 1365), "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).repartitionByRange(6, "doc_id")
    n, bound = checked(rows, best_fit_packing(docs).collect())
    assert n == bound == 30


def test_nulls_repeats_empties_and_clashes(spark):
    rows = [(None, None, None, None, None), (None, "some", "en", "s", 1), (1, "", "en", "s", 1), (1, "", "en", "s", 1), (2, "long " * 50000, "en", "s", 1), *[(3, "same text", "en", "s", 1)] * 50]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("piece", "start", "length", "ids", "gap", "filled", "sequence_id", "offset"):
        docs = docs.withColumn(name, docs.n_chars)
    got = best_fit_packing(docs).collect()
    n, bound = checked(rows, got)
    assert n == bound and sum(r.length for r in got) == 1 + 2 + 2 * 1 + 50001 + 50 * 3


def test_empty_table(spark):
    assert best_fit_packing(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sequences_hold_the_tokens(spark):
    rows = made(40, 1)
    packed = best_fit_packing(spark.createDataFrame(rows, SCHEMA), with_ids=True)
    ids = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in packed.collect():
        assert direct(rows[r.doc_id][1])[r.start : r.start + r.length] == ids[r.sequence_id][r.offset : r.offset + r.length]


def test_words_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    coder, texts = packing.Encoder(vocabulary_path()), ["one two", "", "three four one's", "two, One 10"] * 3
    for t in texts:
        assert coder.encode([t.encode()])[0].tolist() == direct(t)


@pytest.mark.parametrize("size", [1, 7])
def test_blocks_cut(spark, monkeypatch, size):
    monkeypatch.setattr(packing, "PIECES", size)
    rows = made(25, 1)
    checked(rows, best_fit_packing(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect())
