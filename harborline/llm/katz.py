"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Tokens are lower-cased words and one end per text; words outside the training vocabulary are one
unknown event. Every bigram of the training texts, those seen once too, has its discounted relative
frequency; the mass that discounts leave at a history is spread over all other tokens in proportion to
their unigram probability, so the probabilities after every history sum to 1. A seen bigram has probability
d(c) s(h), where d(c) is its discounted count and s(h) the history's scale; any other backs off:

    log p(w|h) = log s(h) + log d(c)     if (h, w) was seen c times
               = log a(h) + log p(w)     otherwise, and so on from p(w) to the unknown event

So a text's score is a sum over its histories and bigrams, all looked up at once by one join, plus the
recursion for the bigrams that this join does not find, which a second, small one evaluates.

Most bigrams are seen once. Those that no held-out text has are not looked up: a bigram of a training text that the
lookup does not find was seen once, and one of a held-out text was never seen. So the counting pass reads the held-out texts too.
A table of slots of a bounded size tells most of the former before they leave a task. A word and the history that it is are looked up as one.

Bigrams are counted in PASSES passes and scored in BLOCKS, by the hash of the history: a pass's shuffle is
gone before the next one's. In every lookup the rows with the largest counts, at most ``HOT`` or ``NEAR``, are
broadcast and looked up in place; that bound holds for any corpus, and it also rids the joins of their
frequent keys. All other rows are joined by a shuffle whose number of partitions follows their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.labelled import held_out
from harborline.llm.scratch import Scratch
from harborline.llm.text import Lookup, Words, bounded_batches, chunks, frugal, mix, words

#: Counts up to GOOD_TURING are discounted; rows that are broadcast at most: bigrams; words to a join (four times as many, with their histories, to Python).
GOOD_TURING, HOT, NEAR = 5, 1 << 19, 1 << 17
#: Bigrams that a task adds up before they leave it; parts of the histories that are counted or scored at a time.
TOGETHER, PASSES, BLOCKS = 2_000_000, 2, 3
#: Looked-up rows per task of a scoring join.
PART = 500_000
#: Slots of the table of a block's bigrams: so many for one, within these bounds. A full table only filters less.
ROOM, FEWEST, MOST = 16, 1 << 16, 1 << 26
#: Rows of one Arrow batch that leaves a Python worker.
PIECE = 1 << 16
#: Bits under a count in the shuffle that tell whether held-out texts have the bigram.
MARK = 20
END, START = np.uint64(0xE5D1E5D1E5D1E5D1), np.uint64(0x57A2757A2757A275)
#: Stands for the history where a word is looked up as a bigram is.
WORD = np.uint64(0x1F0E1F0E1F0E1F0E)


def signed(x: int) -> int:
    return int(x) - (1 << 64) if int(x) >> 63 else int(x)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Histories and tokens of consecutive texts, each ended, and the text of each token."""
    n = w.counts
    ends = np.cumsum(n + 1) - 1
    out = np.empty(len(w.starts) + len(n), np.uint64)
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = w.hashes(lower=True), END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[ends - n] = START
    return before, out, np.repeat(np.arange(len(n)), n + 1)


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """xxhash64(before, token), as Spark computes it for two longs (seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: x << np.uint64(n) | x >> np.uint64(64 - n)
    h = np.full(len(token), 42, np.uint64)
    for x in (before, token):
        h += p5 + np.uint64(8)
        h ^= turned(x * p2, 31) * p1
        h = turned(h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return h


def counted(docs: DataFrame) -> DataFrame:
    """(w, c): how often each token stands in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, texts in chunks(batch):
                w, n = np.unique(tokens(words(data, texts))[1], return_counts=True)
                yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(n)], ["w", "c"])

    return docs.select("text").mapInArrow(frugal(run), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def summed(key: np.ndarray, columns: list[np.ndarray], n: np.ndarray, kind: str = "quicksort") -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """One row per key: its values of the columns, and the sum of n."""
    order = np.argsort(key, kind=kind)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = order[new]
    return key[first], [c[first] for c in columns], np.add.reduceat(n[order], np.flatnonzero(new)) if len(key) else n


def in_part(before: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Which histories lie in one of several parts."""
    return before.view(np.int64) % parts == part


def flags(batch: pa.RecordBatch, rows: slice) -> np.ndarray:
    """The column ``held`` of some rows."""
    return batch.column("held")[rows.start : rows.stop].to_numpy(zero_copy_only=False)


def counted_pairs(docs: DataFrame, part: int, parts: int) -> DataFrame:
    """(h, w, c, held) of all bigrams of the training texts whose history lies in a part, in order of h within a partition.

    ``held`` says whether a held-out text has the bigram too; ``docs`` is (text, held).
    A task adds up what it reads, TOGETHER bigrams at most, before anything leaves it, so the shuffle
    takes a frequent bigram once per task or so; the engine adds up behind the shuffle, and can spill.
    """

    def added(found: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
        """Sums (key, h, w, n) of parts, given out whenever they hold more than TOGETHER bigrams."""
        have, waiting, size = [np.zeros(0, np.uint64)] * 3 + [np.zeros(0, np.int64)], [], 0

        def merged() -> list[np.ndarray]:
            key, h, w, n = (np.concatenate(x) for x in zip(have, *waiting, strict=True))
            key, (h, w), n = summed(key, [h, w], n, "stable")  # runs in order merge
            return [key, h, w, n]

        for x in found:
            waiting.append(x)
            size += len(x[0])
            if size > max(1 << 18, len(have[0]) // 2):
                have = merged()
                waiting, size = [], 0
                if len(have[0]) > TOGETHER:
                    yield have
                    have = [x[:0] for x in have]
        yield merged() if waiting else have

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read_parts() -> Iterator[list[np.ndarray]]:
            for batch in batches:
                for rows, data, texts in chunks(batch):
                    before, token, of = tokens(words(data, texts))
                    mine = in_part(before, part, parts)
                    before, token = before[mine], token[mine]
                    # a task's counts: of training texts in the low half, of others in the high one
                    one = np.where(flags(batch, rows)[of[mine]], 1 << 32, 1)
                    key, (h, w), n = summed(pair_key(before, token), [before, token], one)
                    yield [key, h, w, n]

        for _, h, w, n in added(read_parts()):
            # what leaves it: the training count, and in the low MARK bits, which count tasks, whether others have it
            n = ((n & 0xFFFFFFFF) << MARK) + (n >> 32 > 0)
            for i in range(0, len(h), PIECE):
                yield pa.record_batch([pa.array(x[i : i + PIECE].view(np.int64)) for x in (h, w, n)], ["h", "w", "c"])

    rows = docs.select("text", "held").mapInArrow(frugal(read), "h long, w long, c long")
    found = rows.repartition("h", "w").groupBy("h", "w").agg(F.sum("c").alias("c"))
    found = found.select("h", "w", F.shiftright("c", MARK).alias("c"), (F.col("c").bitwiseAND(F.lit((1 << MARK) - 1)) > 0).alias("held"))
    return found.where("c > 0").sortWithinPartitions("h")


def discounts(n: dict[int, int], k: int = GOOD_TURING) -> list[float]:
    """Katz's discounts of counts 1 to k from the counts of counts 1 to k+1.

    Where the counts of counts are too few or too rough for the Good-Turing estimate to lie between 0
    and 1, an absolute discount takes its place.
    """
    out = []
    n1, n2 = n.get(1, 0), n.get(2, 0)
    absolute = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    common = (k + 1) * n.get(k + 1, 0) / n1 if n1 else 1.0
    for r in range(1, k + 1):
        d = -1.0
        if common < 1 and n.get(r, 0):
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common)
        out.append(d if 0 < d <= 1 else (r - min(max(absolute, 0.01), 0.99)) / r)
    return out


def discounted(c: Column, d: list[float]) -> Column:
    out = c.cast("double")
    for r, x in enumerate(d, 1):
        out = F.when(c == r, x * r).otherwise(out)
    return out


def hot_from(table: DataFrame, room: int) -> int:
    """The least count c such that at most ``room`` rows of a table have it or more, to a 16th of an octave."""
    step = F.floor(F.log2("c") * 16).cast("int")
    out = 1 << 62
    for row in sorted(table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda x: -x.step):
        room -= row.n
        if room < 0:
            break
        out = math.ceil(2 ** (row.step / 16))
    return out


@dataclass
class Model:
    """Unigrams (w, c, p), bigrams (h, w, c), histories (h, c, s, a: logs of scale and backoff weight), discounts, the cost of unknown tokens.

    Of the bigrams seen once, only those that held-out texts have too are kept: any other bigram of a training text was seen once."""

    uni: DataFrame
    pairs: DataFrame
    histories: DataFrame
    d2: list[float]
    n: int
    v: int
    unknown: float


def with_p(pairs: DataFrame, uni: DataFrame, near: int = NEAR) -> DataFrame:
    """Bigrams with p, the unigram probability of their second token: frequent ones by a broadcast, the others by a shuffle."""
    hot = hot_from(uni, near)
    first = pairs.join(F.broadcast(uni.where(F.col("c") >= hot).select("w", "p")), "w", "left")
    rest = first.where("p is null").drop("p").join(uni.where(F.col("c") < hot).select("w", "p"), "w")
    return first.where("p is not null").unionByName(rest)


def fit(docs: DataFrame, scratch: Scratch, near: int = NEAR, passes: int = PASSES) -> Model:
    """The model of the rows of ``docs`` (text, held) that are not held out."""
    uni = scratch.save(counted(docs.where("not held")), "unigrams")
    r = F.when(F.col("c") <= GOOD_TURING + 1, F.col("c")).otherwise(0)
    of_counts = {x.r: (x.n, x.s) for x in uni.groupBy(r.alias("r")).agg(F.count("*").alias("n"), F.sum("c").alias("s")).collect()}
    n, v = sum(s for _, s in of_counts.values()), sum(k for k, _ in of_counts.values())
    d = discounts({a: b for a, (b, _) in of_counts.items() if a})
    seen = sum(k * a * d[a - 1] if 0 < a <= GOOD_TURING else s for a, (k, s) in of_counts.items()) / max(n, 1)
    unknown = max(1 - seen, 1 / (n + 1))
    uni = uni.select("w", "c", (discounted(F.col("c"), d) * ((1 - unknown) / seen / n if n else 0.0)).alias("p"))
    pairs = reduce(DataFrame.unionByName, [scratch.save(counted_pairs(docs, i, passes), f"bigrams-{i}") for i in range(passes)])
    levels = pairs.where(F.col("c") <= GOOD_TURING + 1).groupBy("c").agg(F.count("*").alias("n")).collect()
    d2 = discounts({x.c: x.n for x in levels})
    sums = with_p(pairs, uni, near).groupBy("h").agg(F.sum("c").alias("c"), F.sum(discounted(F.col("c"), d2)).alias("d"), F.sum("p").alias("q"))
    share = F.least(F.col("d") / F.col("c"), F.col("c") / (F.col("c") + 1.0))
    alpha = (1 - share) / F.greatest(1 - F.col("q"), F.lit(1e-12))
    histories = sums.select("h", "c", F.log10(share / F.col("d")).alias("s"), F.log10(alpha).alias("a"))
    histories, pairs = scratch.save(histories, "histories"), scratch.save(pairs.where("c > 1 or held").select("h", "w", "c"), "bigrams")
    scratch.drop(*[f"bigrams-{i}" for i in range(passes)])
    return Model(uni, pairs, histories, d2, n, v, math.log10(unknown))


def score(docs: DataFrame, model: Model, scratch: Scratch, hot: int = HOT, near: int = NEAR, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs`` (doc_id, text, held)."""
    base = lambda c: F.log10((c + 0.1) / F.lit(model.n + 0.1 * (model.v + 1)))
    none = F.lit(None).cast("double")
    # two hashes of doc_id and text: rows that share both are the same row
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.hash("doc_id", "text").alias("row2"), "text", "held")
    # a word is a history too, but for the end, and the start is a history only
    words_ = model.uni.select("w", "c").join(model.histories.select(F.col("h").alias("w"), F.col("c").alias("as_h"), "s"), "w", "full")
    words_ = scratch.save(words_.select("w", F.coalesce("c", "as_h").alias("c"), F.coalesce("s", F.lit(0.0)).alias("x"), base(F.col("c")).alias("b")), "words")
    # what is looked up, with its count: bigrams, words
    orders = [
        model.pairs.select("h", "w", "c", F.log10(discounted(F.col("c"), model.d2)).alias("x"), none.alias("b")),
        words_.select(F.lit(signed(WORD)).alias("h"), "w", "c", "x", "b"),
    ]
    cuts = [hot_from(order, room) for order, room in zip(orders, (hot, 4 * near), strict=True)]
    shared = docs.sparkSession.sparkContext.broadcast([_lookup(o.where(F.col("c") >= cut)) for o, cut in zip(orders, cuts, strict=True)])
    n_terms = sum(table.count() for table in (model.pairs, words_))
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_terms // (blocks * PART)))
    sums, once = [], math.log10(model.d2[0])
    for b in range(blocks):
        mine = lambda h, b=b: F.pmod(h, F.lit(blocks)) == b
        parts = [o.where(mine(F.col(c)) & (F.col("c") < cut)) for o, c, cut in zip(orders, "hw", cuts, strict=True)]
        terms = parts[0].unionByName(parts[1]).select("h", "w", "x", F.col("b").alias("base"))
        slots = kept_slots(parts[0])
        cold = rows.select("row", "row2", "text", "held").mapInArrow(frugal(_looked_up(shared, slots, once, b, blocks)), "row long, row2 int, h long, w long, n int, extra array<double>")
        bigram = F.col("extra").isNull() & (F.col("h") != signed(WORD))
        # terms have distinct keys and PART of them or fewer per task, whatever their number: a bound for the hashed side
        to = lambda df: df.repartition(n_parts, "h", "w")
        found = to(cold).join(to(terms.withColumnRenamed("x", "x_")).hint("shuffle_hash"), ["h", "w"], "left")
        # a bigram of a training text that is not found was seen once; held-out texts have a negative n
        missed = F.col("x_").isNull() & bigram & (F.col("n") < 0)
        found = found.withColumns({"uh": F.when(missed, F.col("h")), "uw": F.when(missed, F.col("w")), "x_": F.coalesce("x_", F.when(bigram & (F.col("n") > 0), F.lit(once))), "n": F.abs("n")})
        # one row per text for what is found, and one for every bigram that is not
        found = found.groupBy("row", "row2", "uh", "uw").agg(
            F.sum(F.coalesce(F.col("n") * F.col("x_"), F.get("extra", F.lit(2)))).alias("sx"), F.sum(F.coalesce(F.col("n") * F.col("base"), F.get("extra", F.lit(3)))).alias("sb"),
            F.sum(F.coalesce(F.when(F.col("base").isNotNull(), F.col("n").cast("double")), F.get("extra", F.lit(1)))).alias("known"), F.sum(F.get("extra", F.lit(0))).alias("tokens"), F.count("extra").alias("times"), F.sum("n").alias("n"),
        )
        sums.append(scratch.save(found, f"scores-{b}"))
        slots.destroy()
    every = reduce(DataFrame.unionByName, sums)
    unseen = every.where("uh is not null").select("row", "row2", F.col("uh").alias("h"), F.col("uw").alias("w"), "n")
    every = every.where("uh is null")
    back = unseen.join(model.uni.select("w", F.log10("p").alias("p")), "w", "left").join(model.histories.select("h", "s", "a"), "h", "left")
    cost = F.coalesce("p", F.lit(model.unknown)) + F.coalesce(F.col("a") - F.col("s"), F.lit(0.0))
    # a history that is known gave its scale to every token after it, so a backed-off one takes it off again
    back = back.groupBy("row", "row2").agg(F.sum(F.col("n") * cost).alias("su"))
    # rows that repeat have sent everything once each
    share = lambda c: F.coalesce(F.sum(c) / F.max("times"), F.lit(0.0)).alias(c)
    columns = ("sx", "sb", "known", "tokens")
    total = every.select("row", "row2", "times", *columns, none.alias("su")).unionByName(back.select("row", "row2", F.lit(None).cast("long").alias("times"), *[none.alias(c) for c in columns], "su"))
    total = scratch.save(total.groupBy("row", "row2").agg(*[share(c) for c in (*columns, "su")]), "totals")
    joined = rows.select("doc_id", "row", "row2").join(total, ["row", "row2"])
    known = F.round("known")
    unknown = F.round("tokens") - known
    return joined.select("doc_id", F.round("tokens").cast("bigint").alias("n_tokens"), known.cast("bigint").alias("n_known"), (F.col("sb") + unknown * base(F.lit(0.0))).alias("base_score"), (F.col("sx") + F.col("su")).alias("score"))


def _lookup(rows: DataFrame) -> Lookup:
    """A table of the values x and b of rows (h, w, x, b), which are bounded in number."""
    found = rows.select(F.xxhash64("h", "w").alias("key"), "x", F.coalesce("b", F.lit(0.0)).alias("b")).toArrow()
    return Lookup.of(np.array(found.column("key"), np.int64).view(np.uint64), np.column_stack([np.array(found.column(c), float) for c in ("x", "b")]))


def kept_slots(pairs: DataFrame) -> Broadcast:
    """A bit for every slot, set where one of the bigrams (h, w) falls, in a table of a bounded size."""
    n, size = pairs.count(), FEWEST
    while size < ROOM * n and size < MOST:
        size *= 2
    slots = pairs.select(F.pmod(F.xxhash64("h", "w"), F.lit(size)).alias("s"))
    table = np.zeros(size // 8, np.uint8)
    for r in slots.groupBy(F.expr("s div 32768").alias("i")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits")).collect():  # 2,048 at most
        table[r.i << 12 : (r.i + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return pairs.sparkSession.sparkContext.broadcast(table)


def in_slots(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys have their slot's bit; of others the table holds none."""
    at = (key & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _looked_up(shared, slots, once: float, block: int, blocks: int):
    """The bigrams and words of each text that are not broadcast, with their counts, and one row with what is known
    already: tokens (in the first block) and tokens known, log-probability, base. Bigrams of training texts without
    a slot were seen once, at a log-probability of ``once``. The counts of held-out texts are negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, texts in chunks(batch):
                before, token, owner = tokens(words(data, texts))
                n = len(texts) - 1
                here = in_part(before, block, blocks)
                of, before_, token_ = owner[here], before[here], token[here]
                looked = np.concatenate([token, np.full(n, START)])
                here = in_part(looked, block, blocks)
                looked, by = looked[here], np.concatenate([owner, np.arange(n)])[here]
                sums, cold, held = np.zeros((4, n)), [], flags(batch, part)
                for table, (h, w, of) in zip(shared.value, [(before_, token_, of), (np.full_like(looked, WORD), looked, by)], strict=True):
                    key = pair_key(h, w)
                    at, hit = table.find(key)
                    sums[2] += np.bincount(of[hit], table.values[at[hit], 0], n)
                    sums[3] += np.bincount(of[hit], table.values[at[hit], 1], n)
                    left = ~hit
                    if cold:
                        sums[1] = np.bincount(of[hit & (w != START)], minlength=n)
                    else:
                        single = np.flatnonzero(left & ~held[of])
                        single = single[~in_slots(slots.value, key[single])]
                        sums[2] += once * np.bincount(of[single], minlength=n)
                        left[single] = False
                    cold.append((key[left], h[left], w[left], of[left]))
                if not block:
                    sums[0] = np.bincount(owner, minlength=n)
                key, h, w, of = (np.concatenate(c) for c in zip(*cold, strict=True))
                _, (h, w, of), times = summed(key ^ mix(of.astype(np.uint64)), [h, w, of], np.ones(len(of), np.int64))
                times = np.where(held[of], -times, times)
                # rows of a text together: they compress; short numbers are sorted by their digits
                order = np.argsort(of.astype(np.uint16) if n < 1 << 16 else of, kind="stable")
                ids, seconds = (np.array(batch.column(c)[part.start : part.stop]) for c in ("row", "row2"))
                row, row2 = (np.concatenate([c[of[order]], c]) for c in (ids, seconds))
                h, w = (np.concatenate([c[order].view(np.int64), ids]) for c in (h, w))
                extra = pa.ListArray.from_arrays(np.concatenate([np.zeros(len(of), np.int32), np.arange(0, 4 * n + 1, 4, dtype=np.int32)]), pa.array(sums.T.ravel()), mask=pa.array(np.arange(len(row)) < len(of)))
                yield pa.record_batch([pa.array(row), pa.array(row2), pa.array(h), pa.array(w), pa.array(np.concatenate([times[order], np.zeros(n, np.int64)]).astype(np.int32)), extra], ["row", "row2", "h", "w", "n", "extra"])

    return run


def lm_scores(docs: DataFrame, modulus: int = 10, remainder: int = 0, hot: int = HOT, near: int = NEAR) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from the rows that are not held out. A null or empty text is an end alone; a text
    of any length is one row; a null doc_id is not held out; repeated rows count each time and each get
    a row. Without training rows every token is unknown with probability 1; an empty table gives an
    empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "katz")
    docs = docs.select("doc_id", "text", held_out(modulus, remainder).alias("held"))
    model = fit(docs, scratch, near)
    return score(docs, model, scratch, hot, near).select("doc_id", held_out(modulus, remainder).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")
