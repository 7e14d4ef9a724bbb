"""Best-fit packing of token sequences, with lower bounds that certify the number of bins.

Each scan task tokenises its texts and packs them by best-fit decreasing where they are, so no text and no
token is shuffled. A block of pieces is certified by dual-feasible functions: a function f with
sum f(x) <= 1 for all lengths that share a sequence bounds the number of sequences from below by the sum of
f over all of them. Two families are tried, all their members exactly: items over C - t count whole and
those under t nothing, and the stepped functions that round multiples of a k-th down. Blocks with more
sequences than the bound's function gives their lengths have a gap (the function is the one that is best for
all lengths together, so the gaps add up to what may still be saved): the pieces of their unfilled
sequences are dealt out anew, among fewer blocks, and best-fit decreasing runs again, until the bound is met
or a round saves no sequence. A full sequence never moves, so what is exchanged shrinks to a few rows a block.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.pieces import ranges
from harborline.llm.scratch import Scratch
from harborline.llm.text import bounded_batches, chunks, frugal

#: Tokens of a sequence, and the token that ends a document.
LENGTH, END = 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of one block; distinct words a task keeps for reuse, and their bytes.
PIECES, KEPT_WORDS, KEPT_BYTES = 1 << 17, 1 << 20, 1 << 25
#: Steps of the second family of bounds.
STEPS = 32
_WHERE = "sequence_id long, offset long, filled int, block long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


_UNITS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
_TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Between units that are encoded together; a unit never holds this digit.
_MARK = b"0"


def units(word: bytes) -> list[bytes]:
    """Parts of a word that the tokenizer encodes apart from each other, so that fewer distinct ones are left.

    It splits runs of letters, digits and all else, after lower-casing. Only ASCII without apostrophes (whose
    contractions it keeps) is split in full; of another word the marks after a Latin letter come off."""
    if b"<|" in word:  # may be a special token, which is looked for before anything else
        return [word]
    if word.isascii():
        return [word] if b"'" in word else _UNITS.findall(word.lower())
    core = word.rstrip(_TAIL)
    last = core.decode("utf-8", "replace")[-1:]
    return [core, word[len(core) :]] if len(core) < len(word) and last < "\u0250" and last.isalpha() else [word]


class Encoder(dict):
    """Ids of many texts. White space separates words before any rule of the tokenizer, so a distinct word is
    encoded once, from units that are each encoded once, and looked up after that. What is kept is bounded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        self.units: dict[bytes, bytes] = {}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.size, self.flat, self.lengths = 0, bytearray(), array("q")
        if len(self.units) > KEPT_WORDS or sum(map(len, self.units)) > KEPT_BYTES:
            self.units = {}

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code

    def encode_units(self, new: list[bytes]) -> None:
        """Units are joined by a mark that has an id of its own, and their ids cut there."""
        plain = [u for u in new if _MARK not in u and b"<|" not in u]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            text = (b" " + _MARK + b" ").join(part).decode("utf-8", "replace")
            (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark).tolist()
            raw = ids.tobytes()
            self.units.update(zip(part, (raw[4 * a : 4 * b] for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True)), strict=True))
        for u in new:
            if u not in self.units:
                self.units[u] = np.array(self.tokenizer.encode(u.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each text's followed by END, and how many each has."""
        if len(self) > KEPT_WORDS or self.size > KEPT_BYTES:
            self.reset()
        words = [t.split() for t in texts]
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64)
        if self.new:
            parts = [units(w) for w in self.new]
            self.encode_units(list({u for p in parts for u in p if u not in self.units}))
            for p in parts:
                ids = b"".join([self.units[u] for u in p])
                self.flat += ids
                self.lengths.append(len(ids) >> 2)
            self.size += sum(map(len, self.new))
            self.new = []
        lengths = np.array(self.lengths, np.int64)
        n = lengths[codes]
        ids = np.frombuffer(self.flat, "<u4")[ranges((np.cumsum(lengths) - lengths)[codes], n)] if self.flat else np.zeros(0, "<u4")
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(own) for own in words], dtype=np.int64)]
        return np.insert(ids, ends, END), np.diff(ends, prepend=0) + 1


@cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each length, its place there, and what each bin holds.

    Open bins stand in stacks by what they have left, and the bits of one integer tell which stacks are not
    empty, so the fullest bin that still fits is the lowest bit from the length on."""
    bins, offsets, filled = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                some ^= 1 << left
        else:
            left, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        left -= size
        if left:
            stacks[left].append(b)
            some |= 1 << left
    return bins, offsets, np.array(filled, np.int64)


@dataclass
class Bound:
    """The dual-feasible function that bounds the number of sequences best: SQL of f(length) times unit, and its sum."""

    value: str
    unit: int
    total: int

    @property
    def least(self) -> int:
        return -(-self.total // self.unit)


def bounds(counts: np.ndarray) -> Bound:
    """The best bound for counts[x] items of length x; ties go to the first family, the plain sum of lengths foremost."""
    capacity = len(counts) - 1
    x = np.arange(capacity + 1)
    number, weight = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    t = np.arange(capacity // 2 + 1)
    sums = (number[-1] - number[capacity - t + 1]) * capacity + weight[capacity - t + 1] - weight[t]
    t = int(np.argmax(sums))
    best = Bound(f"CASE WHEN length > {capacity - t} THEN {capacity} WHEN length >= {t} THEN length ELSE 0 END", capacity, int(sums[t]))
    for k in range(1, STEPS + 1):
        total = int(np.dot(counts, np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)))
        if total * best.unit > best.total * k * capacity:
            best = Bound(f"CASE WHEN {k + 1} * length % {capacity} = 0 THEN {k} * length ELSE {k + 1} * length div {capacity} * {capacity} END", k * capacity, total)
    return best


def packed_block(lengths: np.ndarray, first: int) -> tuple[list[pa.Array], int]:
    """The columns sequence_id, offset, filled, block of one block whose sequences are numbered from ``first``, and their number."""
    bins, offsets, filled = best_fit_decreasing(lengths)
    return [pa.array(bins + first), pa.array(offsets), pa.array(filled[bins].astype(np.int32)), pa.array(np.full(len(bins), first))], len(filled)


def numbered(turn: int) -> int:
    """Where a task's numbers of sequences begin: apart by round and task."""
    return (turn << 57) + (TaskContext.get().partitionId() << 33)


def first_packing(docs: DataFrame, path: str, with_ids: bool) -> DataFrame:
    """Pieces of all texts, packed within their scan tasks."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, held = encoder(path), numbered(0), []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal at, held
            table = pa.Table.from_batches(held).combine_chunks()
            where, n = packed_block(table.column("length").to_numpy(), at)
            at, held = at + n, []
            yield from pa.table([*table.columns, *where], [*names, "sequence_id", "offset", "filled", "block"]).to_batches(1 << 14)

        for batch in batches:
            for part, data, texts in chunks(batch):
                raw = data.tobytes()
                ids, lengths = coder.encode([raw[a:b] for a, b in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True)])
                pieces = -(-lengths // LENGTH)
                owner = np.repeat(np.arange(len(lengths)), pieces)
                number = ranges(np.zeros(len(pieces), np.int64), pieces)
                start = number * LENGTH
                size = np.minimum(LENGTH, lengths[owner] - start)
                edges = np.concatenate([[0], np.cumsum(size)])
                sums = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)), np.int64, len(size))
                columns = [batch.column("doc_id")[part.start : part.stop].take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(size), pa.array(sums)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))))
                held.append(pa.record_batch(columns, names))
                if sum(x.num_rows for x in held) >= (PIECES >> 4 if with_ids else PIECES):
                    yield from block()
        if held:
            yield from block()

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids array<int>, " if with_ids else "") + _WHERE
    return docs.select("doc_id", "text").mapInArrow(frugal(run), kinds)


def exchanged(pool: DataFrame, blocks: int, turn: int) -> DataFrame:
    """``pool`` dealt out among so many blocks and packed again."""
    own = [c for c in pool.columns if c not in ("sequence_id", "offset", "filled", "block")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            where, _ = packed_block(table.column("length").to_numpy(), numbered(turn))
            yield from pa.table([*table.columns, *where], [*own, "sequence_id", "offset", "filled", "block"]).to_batches(1 << 14)

    dealt = pool.repartition(blocks, F.xxhash64("sequence_id", "offset", F.lit(turn)))
    return dealt.select(*own).mapInArrow(frugal(run), pool.schema)


def best_fit_packing(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset) of every piece of every document.

    A document is its text's ids and END; a null text is empty, and an empty one is END alone. Only a
    document of more than LENGTH ids is cut, into pieces of LENGTH and a last one that may be shorter. The
    strings of special tokens in a text are those tokens, as is the tokenizer's default. Repeated rows
    and rows without an id are documents of their own. Equal lengths keep their order. A text is encoded
    whole by one task; extra columns are ignored; an empty table gives an empty result. The number of
    sequences is least where it meets the bound; where no dealing meets it, the last gain stands.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "packing")
    now = scratch.save(first_packing(docs, path or vocabulary_path(), with_ids), "packed-0")
    counts = np.zeros(LENGTH + 1, np.int64)
    for r in now.groupBy("length").count().collect():  # at most LENGTH rows
        counts[r["length"]] = r["count"]
    bound, done, turn = bounds(counts), [], 0
    begun = F.count(F.when(F.col("offset") == 0, 1))
    total = now.agg(begun).first()[0]
    while total > bound.least:
        turn += 1
        certified = now.groupBy("block").agg((begun * bound.unit).alias("n"), F.sum(F.expr(bound.value)).alias("share")).where("n <= share").select("block")
        certified = scratch.save(certified, f"certified-{turn}")
        unfilled = now.where(F.col("filled") < LENGTH)
        pool = scratch.save(unfilled.join(certified, "block", "left_anti").select(now.columns), f"pool-{turn}")
        rows, before = pool.agg(F.count("*"), begun).first()
        again = scratch.save(exchanged(pool, max(1, -(-rows // (PIECES >> 4 if with_ids else PIECES))), turn), f"packed-{turn}")
        after = again.agg(begun).first()[0]
        if after >= before:
            break
        done += [now.where(F.col("filled") == LENGTH), unfilled.join(certified, "block", "left_semi").select(now.columns)]
        now, total = again, total - before + after
    for x in done:
        now = now.unionByName(x)
    return now.drop("filled", "block")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the token sequences of a packing made ``with_ids``; at most LENGTH ids are gathered for each."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
