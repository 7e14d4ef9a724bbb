"""Near duplicates by shingle sets: wide SimHash fingerprints in a byte-position index, then the exact check.

A text's class is the hash of its set of word shingles; equal sets are one class throughout. A class has
a fingerprint of WORDS times 64 bits, over its distinct shingles, whose bytes are posted by LISTS sets of four
positions each: permutations of all positions cut into fours, so every position is in as many sets. A pair shares
a list exactly if it agrees in the four bytes of a set. Candidates are tallied over all positional bytes and dropped
below MINIMUM; only pairs whose sets truly reach the similarity are linked. ``found_share`` computes what
share of the pairs of a similarity has a list in common and passes the tally: 0.95 at 0.80, 0.997 at 0.85.

Keys are counted first. What stands in a list of several is then told by a table of slots of a bounded size, so
that postings that stand alone, nearly all of them, are not shuffled a second time.

A class is compared with the least ones of its lists first, with a bounded number of them. Then every class that
stands in a list, and every class of few shingles, whose fingerprint says
little, goes through an exact way: each class posts its rarest shingles, as many as it cannot do without in any pair that
reaches the similarity (its size less the overlap needed, and one). No such pair is without a posted shingle
in common, and copies with edits of their own mostly post those edits, which nobody shares. The lists of that index, one of each set of classes, are
again compared with their least class first, and then in blocks of bounded size, where only pairs of different
components are left: on the sets themselves, which a block links by a forest, and for sets of more than CARRIED shingles
on sizes that fit and fingerprints that may belong to a pair of the similarity. Of those pairs a block gives a forest too; what
it joins is a cluster, which holds every such pair. The sets of a cluster then meet once, in blocks of bounded size, not in every list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.graph import components
from harborline.llm.scratch import Scratch, fresh
from harborline.llm.simhash import forest, in_blocks, signed
from harborline.llm.text import bounded_batches, chunks, frugal, mix, span_hash, words

#: 64-bit words of a fingerprint, sets of positions, those posted at a time (their postings are gone before the next), equal bytes of a candidate.
WORDS, LISTS, ROUND, MINIMUM = 16, 1024, 128, 16
#: Slots of the table of keys that stand in a list of several: so many for a key, within these bounds. A full table only filters less.
ROOM, FEWEST, MOST = 16, 1 << 16, 1 << 24
_PERMUTED = np.random.default_rng(22)
#: The sets of four of the 8 * WORDS positional bytes.
SETS = np.concatenate([_PERMUTED.permutation(8 * WORDS).reshape(-1, 4) for _ in range(LISTS // (2 * WORDS))])
#: Shingles up to which a class always takes the exact way, and standard errors below its expectation at which bits rule out a pair.
FEW, ERRORS = 64, 4.0
#: Classes with which one is compared first: so many that stand in most of its lists, and as many of the least.
STARS = 4
#: Shingles up to which a set goes along to the comparison of a block, which then links only what reaches the similarity.
CARRIED = 512
#: Classes of a block, and shingles of one of a cluster (a longer set is a block of its own).
BLOCK, TOGETHER = 512, 1 << 20
_STEPS = np.random.default_rng(20).integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
#: What a bit is that exactly half of the hashes have: either, but the same for all texts.
_TIES = np.unpackbits(np.random.default_rng(21).integers(0, 256, (WORDS, 8), np.uint8), axis=1, bitorder="little").astype(bool)
#: For every byte, its bits as eight counters of a byte each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]


def found_share(similarity: float, words: int = WORDS, minimum: int = MINIMUM, lists: int = LISTS) -> float:
    """The share of pairs of a Jaccard similarity that the index finds, for bits that agree independently."""
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    p, n = agree**8, 8 * words
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) * (1 - (1 - math.comb(k, 4) / math.comb(n, 4)) ** lists) for k in range(minimum, n + 1))


def least_equal_bits(similarity: float) -> int:
    """Equal bits of two fingerprints under which a pair of the similarity would be ERRORS standard errors off."""
    n, agree = 64 * WORDS, 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(n * agree - ERRORS * math.sqrt(n * agree * (1 - agree)))


def shingle_sets(data: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and how many each has; fewer words are one shingle."""
    w = words(data, texts)
    counts = np.where(w.counts > size, w.counts - size + 1, np.minimum(w.counts, 1))
    owner = np.repeat(np.arange(len(counts)), counts)
    first = w.first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes = span_hash(w.hashes(lower=True), first, np.minimum(first + size, w.first[1:][owner]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts))


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """WORDS words for each text of at least one hash: a bit is set if over half of the text's hashes have it, or by _TIES if half do."""
    begin = np.cumsum(counts) - counts
    # counters of a byte hold 255 hashes, so longer texts are summed in pieces
    pieces = -(-counts // 255)
    owner = np.repeat(np.arange(len(counts)), pieces)
    at = begin[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    whole = np.cumsum(pieces) - pieces
    out = np.zeros((len(counts), WORDS), np.uint64)
    for i, step in enumerate(_STEPS):
        parts = mix(hashes * step).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.stack([np.add.reduceat(_SPREAD[parts[:, b]], at).view(np.uint8).reshape(-1, 8) for b in range(8)], axis=1).reshape(-1, 64)
        twice = 2 * np.add.reduceat(ones, whole, axis=0, dtype=np.int64)
        out[:, i] = np.packbits((twice > counts[:, None]) | ((twice == counts[:, None]) & _TIES[i]), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def classes_and_signatures(data: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each text, its fingerprint and the size of its set; texts without words are class 0."""
    hashes, counts = shingle_sets(data, texts, size)
    classes, found = np.zeros(len(counts), np.uint64), np.zeros((len(counts), WORDS), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        with np.errstate(over="ignore"):
            classes[full] = mix(np.add.reduceat(mix(hashes), (np.cumsum(counts) - counts)[full]) + counts[full].astype(np.uint64))
            found[full] = signatures(hashes, counts[full])
    return classes, found, counts


def marked_table(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, class, fp, m): a hash of the text, its class, fingerprint and set size; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, texts in chunks(batch):
                kept = [batch.column(c)[rows.start : rows.stop] for c in ("doc_id", "h")]
                found, fp, sizes = classes_and_signatures(data, texts, size)
                at = np.arange(len(found) + 1, dtype=np.int32) * WORDS
                yield pa.record_batch([*kept, pa.array(found.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(fp.ravel().view(np.int64))), pa.array(sizes.astype(np.int64))], ["doc_id", "h", "class", "fp", "m"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(frugal(run), "doc_id long, h long, class long, fp array<long>, m long")


def set_table(rows: DataFrame, size: int) -> DataFrame:
    """(class, shingles) of rows (class, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, texts in chunks(batch):
                hashes, counts = shingle_sets(data, texts, size)
                at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.record_batch([batch.column("class")[part.start : part.stop], pa.ListArray.from_arrays(at, pa.array(hashes.view(np.int64)))], ["class", "shingles"])

    return rows.select("class", "text").mapInArrow(frugal(run), "class long, shingles array<long>")


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positional bytes two fingerprints share."""
    equal = lambda x: sum(((x.bitwiseAND(F.lit(signed(0xFF << 8 * i)))) == 0).cast("int") for i in range(8))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + equal(x))


def ratio(similarity: float) -> Fraction:
    """The similarity as a fraction, so that a pair right at it is told exactly."""
    return Fraction(similarity).limit_denominator(1000)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets reach the similarity."""
    r = ratio(similarity)
    side = lambda n: sets.select(F.col("class").alias(n), F.col("shingles").alias(f"of_{n}"), F.size("shingles").alias(f"n_{n}"))
    fits = F.least("n_a", "n_b") * r.denominator >= F.greatest("n_a", "n_b") * r.numerator
    sizes = pairs.join(side("a").select("a", "n_a"), "a").join(side("b").select("b", "n_b"), "b").where(fits).select("a", "b")
    both = sizes.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(common * r.denominator >= (F.col("n_a") + F.col("n_b") - common) * r.numerator).select("a", "b")


def rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, class): each class's rarest shingles, of which every pair that reaches the similarity has one in common.

    Shingles are ordered by how many classes have them, then by hash; those of one class are not posted."""
    r = ratio(similarity)
    one = sets.select("class", F.size("shingles").alias("m"), F.explode("shingles").alias("key"))
    counts = one.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    # counts of one are as good as none, and they come first
    known = one.join(counts.hint("merge"), "key", "left").select("class", "m", F.struct(F.coalesce("c", F.lit(1)).alias("c"), "key").alias("x"))
    needed = F.expr(f"(m * {r.numerator} + {r.denominator - 1}) div {r.denominator}")
    first = known.groupBy("class", "m").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("class", F.slice("xs", F.lit(1), (F.col("m") - needed + 1).cast("int")).alias("xs"))
    return first.select("class", F.explode(F.filter("xs", lambda x: x["c"] > 1)).alias("x")).select("x.key", "class")


def listed(keys: Callable[[Broadcast | None], DataFrame], scratch: Scratch, name: str) -> DataFrame:
    """(key, n, class, least) of the lists of more than one class; ``keys`` makes the postings, or those that are likely to stand in a list."""
    lists = scratch.save(keys(None).groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("least")).where("n > 1"), f"{name}-lists")
    table = kept_slots(lists)
    out = scratch.save(keys(table).join(lists.hint("merge"), "key").select("key", "n", "class", "least"), name)
    table.destroy()
    scratch.drop(f"{name}-lists")
    return out


def to_least(members: DataFrame, most: int = STARS) -> DataFrame:
    """(a, b): every class with least ones of its lists, at most ``most`` that most of them have and as many that are the least.

    The lists of a large group of near copies have hundreds of different ones; the least of all are the same for most classes."""
    pairs = members.where("class <> least").groupBy(F.col("least").alias("a"), F.col("class").alias("b")).agg(F.count("*").alias("n"))
    places = {"often": F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a")), "low": F.row_number().over(Window.partitionBy("b").orderBy("a"))}
    return pairs.withColumns(places).where(F.least("often", "low") <= most).select("a", "b")


def overlaps(sets: np.ndarray) -> np.ndarray:
    """How many elements every two of the sets share; None is the empty set."""
    sizes = np.array([0 if s is None else len(s) for s in sets])
    values = np.concatenate([np.zeros(0, np.int64), *[s for s in sets if s is not None]])
    _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    kept, column = shared[place], (np.cumsum(shared) - 1)[place]
    rows, column = np.repeat(np.arange(len(sets)), sizes)[kept], column[kept]
    out, step = np.zeros((len(sets), len(sets)), np.int64), 4096
    for first in range(0, int(shared.sum()), step):
        here = (column >= first) & (column < first + step)
        marks = np.zeros((len(sets), step), np.float32)
        marks[rows[here], column[here] - first] = 1
        out += (marks @ marks.T).astype(np.int64)
    return out


def reaching(sets: np.ndarray, m: np.ndarray, asked: np.ndarray, r: Fraction) -> np.ndarray:
    """Which of the ``asked`` pairs of sets, of m elements each, reach the similarity r."""
    if not asked.any():
        return asked
    common = overlaps(sets)
    return asked & (common * r.denominator >= (m[:, None] + m - common) * r.numerator)


def may_reach(m: np.ndarray, root: np.ndarray, r: Fraction) -> np.ndarray:
    """Which pairs are of different roots and have sizes that fit."""
    return (np.minimum(m[:, None], m) * r.denominator >= np.maximum(m[:, None], m) * r.numerator) & (root[:, None] != root)


def rooted(members: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The members with their roots by ``links``, of the lists that have several."""
    roots = components(links, Scratch(members.sparkSession, name))
    found = scratch.save(members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), f"{name}-rooted")
    open_ = found.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return found.join(open_, "key", "left_semi")


def xxhash_long(x: np.ndarray) -> np.ndarray:
    """What ``F.xxhash64`` makes of a column of longs, as unsigned numbers."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turn(x.view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return h ^ h >> np.uint64(32)


def posted(classes: DataFrame, first: int, likely: Broadcast | None = None) -> DataFrame:
    """(key, class) of ROUND sets of each fingerprint: a set's number and its four bytes, in one long; of ``likely`` keys only."""
    sets = SETS[first : first + ROUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(first, first + len(sets), dtype=np.int64) << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column("fp").flatten().to_numpy().astype("<i8").view(np.uint8).reshape(part.num_rows, 8 * WORDS)
                keys = (number + np.ascontiguousarray(fp[:, sets]).view("<u4")[:, :, 0]).ravel()
                classes = np.repeat(part.column("class").to_numpy(), len(sets))
                if likely is not None:
                    table = likely.value
                    kept = table[(xxhash_long(keys) % np.uint64(len(table))).astype(np.int64)] > 0
                    keys, classes = keys[kept], classes[kept]
                yield pa.record_batch([pa.array(keys), pa.array(classes)], ["key", "class"])

    return classes.select("class", "fp").mapInArrow(frugal(run), "key long, class long")


def kept_slots(lists: DataFrame) -> Broadcast:
    """A table with a byte for every slot, 1 where the key of a list falls, of a bounded size."""
    n, size = lists.count(), FEWEST
    while size < ROOM * n and size < MOST:
        size *= 2
    slots = lists.select(F.pmod(F.xxhash64("key"), F.lit(size)).alias("s"))
    stretches = slots.groupBy(F.expr("s div 32768").alias("i")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits"))
    table = np.zeros(size, np.uint8)
    for r in stretches.collect():  # 512 at most
        table[r.i << 15 : (r.i + 1) << 15] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    return lists.sparkSession.sparkContext.broadcast(table)


def different(members: DataFrame) -> DataFrame:
    """``members`` (key, n, class, least) of one list of each set of classes; sets are told apart by 128 bits.

    Classes that share one rare shingle mostly share several."""
    sets = members.groupBy("key", "n", "least").agg(F.bit_xor("class").alias("x"), F.bit_xor(F.xxhash64("class")).alias("y"))
    return members.join(sets.groupBy("n", "least", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def in_clusters(rough: DataFrame, links: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b): a forest of the pairs that reach the similarity in the components of ``rough``, of classes that ``links`` leave apart."""
    r = ratio(similarity)
    clusters = scratch.save(components(rough, Scratch(sets.sparkSession, "rough")).select(F.col("root").alias("key"), F.col("node").alias("class")), "clusters")
    members = rooted(clusters, links, scratch, "third").join(sets, "class").select("key", "class", "root", F.size("shingles").cast("long").alias("m"), "shingles")
    # blocks by number and by length, whichever are more
    sizes = members.groupBy("key").agg(F.greatest(F.count("*"), F.ceil(F.sum("m") * BLOCK / TOGETHER)).alias("n"))

    def found(x: dict[str, np.ndarray]) -> np.ndarray:
        return x["class"][np.array(forest(reaching(x["shingles"], x["m"], may_reach(x["m"], x["root"], r), r)), np.int64).reshape(-1, 2)]

    return in_blocks(members.join(sizes, "key").select("key", "n", "class", "root", "m", "shingles"), ["key"], "class", found, block=BLOCK)


def grouped(docs: DataFrame, size: int, similarity: float, scratch: Scratch, few: int = FEW) -> DataFrame:
    """(doc_id, h, root) of every row: rows of one root are linked by pairs that reach the similarity."""
    spark, r = docs.sparkSession, ratio(similarity)
    bounded_batches(spark)
    marked = scratch.save(marked_table(docs, size), "marked")
    classes = marked.where("class <> 0").groupBy("class").agg(F.min("fp").alias("fp"), F.min("m").alias("m"), F.min(F.struct("doc_id", "h")).alias("k"))
    classes = scratch.save(classes, "classes")
    rounds = range(0, LISTS, ROUND)
    members = reduce(DataFrame.unionByName, [listed(partial(posted, classes, first), scratch, f"members-{first}") for first in rounds])
    stars = scratch.save(to_least(members), "stars")
    # a class of few shingles may be near to one that has a little more
    small = classes.where(F.col("m") * r.numerator <= few * r.denominator).select("class")
    there = scratch.save(classes.join(members.select("class").unionByName(small).distinct(), "class"), "listed")
    scratch.drop(*[f"members-{first}" for first in rounds])
    named = there.select("class", F.col("k.doc_id").alias("_doc"), F.col("k.h").alias("_h"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")))
    # rows that share doc_id and text give a class once more
    sets = scratch.save(set_table(texts, size).dropDuplicates(["class"]), "sets")
    side = lambda n: there.select(F.col("class").alias(n), F.col("fp").alias(f"fp_{n}"))
    counted = stars.join(side("a"), "a").join(side("b"), "b").where(shared_bytes(F.col("fp_a"), F.col("fp_b")) >= MINIMUM).select("a", "b")
    near = scratch.save(verified(scratch.save(counted, "counted"), sets, similarity).distinct(), "near-least")

    rare = scratch.save(rarest(sets, similarity), "rarest")
    exact = scratch.save(different(listed(lambda _: rare, scratch, "rare-all")), "rare")
    pairs = scratch.save(to_least(rooted(exact, near, scratch, "first")), "rare-stars")
    near = scratch.save(near.unionByName(verified(pairs, sets, similarity)).distinct(), "near-rare")
    rest = rooted(exact, near, scratch, "second").join(there.select("class", "fp", "m"), "class")
    rest = rest.join(sets.where(F.size("shingles") <= CARRIED), "class", "left")
    rest = rest.select("key", "n", "class", "root", "m", *[F.col("fp")[i].alias(f"w{i}") for i in range(WORDS)], "shingles")
    bits = least_equal_bits(similarity)

    def found(x: dict[str, np.ndarray]) -> np.ndarray:
        m, carried = x["m"], np.array([s is not None for s in x["shingles"]])
        fits, known = may_reach(m, x["root"], r), carried[:, None] & carried
        near, rough = reaching(x["shingles"], m, fits & known, r), fits & ~known
        if rough.any():
            equal = np.zeros(fits.shape, np.int16)
            for i in range(WORDS):
                v = x[f"w{i}"].view(np.uint64)
                equal += np.bitwise_count(~(v[:, None] ^ v[None, :])).astype(np.int16)
            rough &= equal >= bits
        return x["class"][np.array([*forest(near), *forest(rough)], np.int64).reshape(-1, 2)]

    others = scratch.save(in_blocks(rest, ["key"], "class", found, block=BLOCK).distinct(), "others")
    links = scratch.save(near.unionByName(verified(others, sets, similarity)), "near-others")
    # a pair with a longer set is known by its fingerprints only
    longer = lambda n: there.where(F.col("m") > CARRIED).select(F.col("class").alias(n))
    rough = scratch.save(others.join(longer("a"), "a", "left_semi").unionByName(others.join(longer("b"), "b", "left_semi")), "rough")
    if not rough.isEmpty():
        links = links.unionByName(scratch.save(in_clusters(rough, links, sets, similarity, scratch), "near-clusters"))
    roots = components(links, Scratch(spark, "near")).withColumnRenamed("node", "class")
    return marked.join(roots, "class", "left").select("doc_id", "h", F.coalesce("root", "class").alias("root"))


def first_of_each(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that come first in their root of ``found`` (doc_id, h, root), one row of each (doc_id, text)."""
    doc, h, n, key = fresh(docs, "_doc", "_h", "_n", "_key")
    rows = found.groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "h", "n")).alias("k"))
    kept = scratch.save(kept.select(F.col("k.doc_id").alias(doc), F.col("k.h").alias(h), F.col("k.n").alias(n)), "kept")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(F.col(doc)) & (F.col(key) == F.col(h))
    once = keyed.join(kept.where(F.col(n) == 1), same, "left_semi").drop(key)
    whole = F.struct(*[F.col(f"`{c.replace(chr(96), chr(96) * 2)}`") for c in docs.columns])
    again = keyed.join(kept.where(F.col(n) > 1), same, "left_semi")
    again = again.groupBy("doc_id", key).agg(F.min_by(whole, F.to_json(whole)).alias(h)).select(f"{h}.*")
    return once.unionByName(again)


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The first document of each component, by doc_id (null first), with its own columns, whatever their names.

    Documents whose sets of ``size``-word shingles have the Jaccard similarity or more are linked; a
    text of fewer words is one shingle, and null, empty and wordless texts are alike. Rows that share
    doc_id and text are one document, of which one row stays: the first by the JSON of its columns.
    A text of any length is one row. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    found = scratch.save(grouped(docs, size, similarity, scratch), "groups")
    return first_of_each(docs, found, scratch)
