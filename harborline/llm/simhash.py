"""SimHash near-duplicates through a byte-position index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most four bits differ in
at most four bytes, so they share at least four positional bytes: the guaranteed minimum. A posting
list of one byte holds a 256th of all fingerprints, so tallying pairs over single bytes would grow
with the square of the corpus. The index therefore posts each fingerprint under its 70 sets of four
positional bytes: a pair shares a list exactly if its tally of shared bytes reaches the minimum. Within
a list the shared bytes of every pair are tallied, pairs under the minimum are dropped, each other pair
is kept in the first of its lists only, and verified on all 64 bits.

Equal fingerprints are one row throughout. A list is cut into blocks of a fixed size and blocks are
compared pairwise, each comparison in a group of its own that returns a spanning forest of the links it
found, so no list, however long, meets in one task, and no list emits its pairs. A long list is first
posted once more: four of its bytes are equal and four bits may differ in the others, so of the eight
half bytes there at least four are equal; the 70 finer lists hold 2**16 fingerprints at most each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.graph import components
from harborline.llm.scratch import Scratch
from harborline.llm.text import LOWER, bounded_batches, chunks, frugal, words

#: Fingerprints of one block of a posting list, those of a list that is posted once more, parts of a component.
BLOCK, HOT, SALTS = 1024, 4096, 32


def shingle_hashes(data: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of lower-cased words joined by spaces, and the shingles of each text."""
    w = words(LOWER[data], texts)
    lengths = w.ends - w.starts
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])
    joined = np.full(begin[-1], 32, np.uint8)
    at = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined[begin[:-1][at] + within] = w.data[w.starts[at] + within]
    counts = np.where(w.counts > size, w.counts - size + 1, np.minimum(w.counts, 1))
    owner = np.repeat(np.arange(len(counts)), counts)
    first = w.first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.minimum(first + size, w.first[1:][owner]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    ends = begin[last] + lengths[last] if len(last) else last
    return np.fromiter((digest(raw[a:b], 42) for a, b in zip(begin[first].tolist(), ends.tolist(), strict=True)), np.uint64, len(first)), counts


def fingerprints(data: np.ndarray, texts: np.ndarray, size: int = 4) -> np.ndarray:
    """A 64-bit SimHash of each text: a bit is set if over half of its shingles' hashes have it; 0 without words."""
    hashes, counts = shingle_hashes(data, texts, size)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_table(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, h, fp): a hash of the text and its fingerprint as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, texts in chunks(batch):
                kept = [batch.column(c)[rows.start : rows.stop] for c in ("doc_id", "h")]
                yield pa.record_batch([*kept, pa.array(fingerprints(data, texts, size).view(np.int64))], ["doc_id", "h", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(frugal(run), "doc_id long, h long, fp long")


def signed(x: int) -> int:
    """The signed long of an unsigned one."""
    return x - (1 << 64) if x >> 63 else x


def byte_sets(keep: int) -> list[int]:
    """A mask for every choice of ``keep`` of the eight positional bytes, in order of their positions."""
    return [signed(sum(0xFF << 8 * i for i in chosen)) for chosen in combinations(range(8), keep)]


def in_blocks(posted: DataFrame, keys: list[str], value: str, found: Callable[[dict[str, np.ndarray]], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(a, b): what ``found`` makes of every two blocks of a list.

    ``posted`` has the keys of a list, its size ``n`` and columns of longs. A list is cut into blocks by
    a hash of ``value`` and blocks are compared pairwise, each comparison in a group of its own.
    """
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = (
        posted.withColumn("mine", F.pmod(F.xxhash64(value), blocks.cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*posted.columns, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
        .drop("n")
    )
    by = [*keys, "lo", "hi"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups stand together in a sorted partition; the last group of a batch waits for the next."""

        def pairs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            new = np.ones(table.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in (table.column(k).to_numpy() for k in by)])
            edges = [*np.flatnonzero(new).tolist(), table.num_rows]
            columns = {c: table.column(c).to_numpy() for c in table.column_names}
            parts = [{c: v[i:j] for c, v in columns.items()} for i, j in zip(edges[: len(edges) - 1 - (not last)], edges[1:], strict=False) if j - i > 1]
            flat = np.concatenate([found(p).reshape(-1, 2) for p in parts] or [np.zeros((0, 2), np.int64)]).astype(np.int64)
            return pa.record_batch([pa.array(flat.min(axis=1)), pa.array(flat.max(axis=1))], ["a", "b"]), table.slice(edges[-2]).combine_chunks()

        kept = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                out, kept = pairs(pa.concat_tables([kept, table]) if kept is not None else table, False)
                yield out
        if kept is not None:
            yield pairs(kept, True)[0]

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(frugal(compare), "a long, b long")


def first_equal(keep: int) -> np.ndarray:
    """For every pattern of equal bytes: the first ``keep`` of them, as a pattern; 0 if there are fewer."""
    bits = [[i for i in range(8) if p >> i & 1] for p in range(256)]
    return np.array([sum(1 << i for i in b[:keep]) if len(b) >= keep else 0 for b in bits], np.uint8)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links that a symmetric matrix holds."""
    left, found = np.ones(len(near), bool), []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        if left[i]:
            left[i], edge = False, [i]
            while edge:
                j = edge.pop()
                new = np.flatnonzero(near[j] & left)
                left[new] = False
                found += [(j, int(x)) for x in new]
                edge += new.tolist()
    return found


def listed(posted: DataFrame, distance: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """The linked pairs of lists of two, and the postings (..., n) of longer ones; ``posted`` is (fp, set, mask, shared)."""
    by = ["set", "mask", "shared"]
    lists = scratch.save(posted.groupBy(*by).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), name)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # the lists grow with the corpus: one plan for all sizes, which broadcasts none of them
    return lists.where("n = 2").where(near).select("a", "b"), posted.join(lists.where("n > 2").select(*by, "n").hint("merge"), by)


def links(distinct: DataFrame, distance: int, scratch: Scratch, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within the distance, enough of them to join every component."""
    keep = 8 - distance
    sets = [sum(1 << i for i in chosen) for chosen in combinations(range(8), keep)]
    pairs = F.array(*[F.struct(F.lit(s).cast("short").alias("set"), F.lit(m).alias("mask")) for s, m in zip(sets, byte_sets(keep), strict=True)])
    posted = distinct.select("fp", F.explode(pairs).alias("p")).select("fp", "p.set", "p.mask", F.col("fp").bitwiseAND(F.col("p.mask")).alias("shared"))
    twos, many = listed(posted, distance, scratch, "lists")
    # a long list is posted once more: where it lets bytes differ, as many half bytes as bytes are still equal
    halves = [[half for i in range(8) if not s >> i & 1 for half in (2 * i, 2 * i + 1)] for s in sets]
    finer = {s: [signed(sum(0xF << 4 * x for x in chosen)) for chosen in combinations(h, distance)] for s, h in zip(sets, halves, strict=True)}
    table = F.create_map(*[x for s in sets for x in (F.lit(s).cast("short"), F.array(*[F.lit(m) for m in finer[s]]))])
    again = many.where(F.col("n") > hot).select("fp", "set", "mask", F.explode(table[F.col("set")]).alias("more"))
    again = again.select("fp", "set", F.col("mask").bitwiseOR(F.col("more")).alias("mask")).withColumn("shared", F.col("fp").bitwiseAND(F.col("mask")))
    more_twos, more = listed(again, distance, scratch, "longer-lists")
    first = first_equal(keep)

    def found(x: dict[str, np.ndarray]) -> np.ndarray:
        """Pairs are tallied by equal bytes and kept from the minimum on, in the first of the lists they share."""
        v = x["fp"].view(np.uint64)
        differ = v[:, None] ^ v[None, :]
        equal = np.packbits(differ.view(np.uint8).reshape(len(v), len(v), 8) == 0, axis=2, bitorder="little")[:, :, 0]
        near = (first[equal] == x["set"][0]) & (np.bitwise_count(differ) <= distance)
        np.fill_diagonal(near, False)
        return np.array([(x["fp"][i], x["fp"][j]) for i, j in forest(near)], np.int64).reshape(-1, 2)

    lists = many.where(F.col("n") <= hot).unionByName(more).select("set", "mask", "shared", "n", "fp")
    return twos.unionByName(more_twos).distinct().unionByName(in_blocks(lists, ["set", "mask", "shared"], "fp", found, block))


def grouped(docs: DataFrame, size: int, distance: int, scratch: Scratch) -> DataFrame:
    """(doc_id, h, fp, component_id) of every row."""
    bounded_batches(docs.sparkSession)
    marked = scratch.save(fingerprint_table(docs, size), "fingerprints")
    classes = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = scratch.save(components(links(classes.select("fp"), distance, scratch), scratch).withColumnRenamed("node", "fp"), "roots")
    linked = classes.join(roots, "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # a component may hold a large share of all rows, so its name is joined to SALTS parts of it
    named = scratch.save(named, "named").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(named, ["root", "salt"])
    found = classes.join(linked.select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(scratch.save(found, "components"), "fp")


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Fingerprints within ``distance`` bits are linked; component_id is the smallest doc_id that links
    reach. Null and wordless texts have fingerprint zero and are linked like any other. A null doc_id
    takes part but never names a component; repeated rows give repeated results. A text of any length
    is one row. Extra columns are ignored; an empty table gives an empty result.
    """
    found = grouped(docs, size, distance, Scratch(docs.sparkSession, "simhash"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
