"""Benchmark passages in documents by spaced seeds. DataFrame operations only.

A seed is the hash of the words a mask selects from a window; positions the mask leaves out may differ,
so substitutions do not hide a passage from all masks: of any two words replaced in a run of RUN, one of
the masks has a place that avoids both. A place of a document is worth hashing only if its first two
words stand side by side in the benchmark, so these pairs are looked up first, in a table of slots;
the seeds of the places left are looked up in a second one, and only those that hit are joined to the
benchmark's. A hit fixes an alignment of document and item, and the alignment is verified on the words
themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.scratch import Scratch, fresh

#: Places of a window that each mask compares; each begins with two words side by side.
MASKS = [(0, 1, 2, 3, 5, 6, 7), (0, 1, 2, 3, 5, 7, 8), (0, 1, 4, 7, 8, 9, 10)]
#: Runs of one to four words: the seeds of items no longer than a verified run.
RUNS = [tuple(range(n)) for n in range(1, 5)]
#: Words of a verified run, and the share of them that must agree.
RUN, SHARE = 13, 0.8
#: Slots of a lookup table: at least so many per entry, within these bounds. A full table only filters less.
ROOM, FEWEST, MOST = 16, 1 << 16, 1 << 24
#: A benchmark of at most so many seeds is broadcast; a larger one is joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words, which ASCII punctuation and space separate; null has none."""
    cut = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS), lambda w: w != "")
    return F.transform(cut, lambda w: F.xxhash64(w))


def places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, words, pos, first, second) for every word of rows with ``words``; the last has no second."""
    beside = F.arrays_zip(F.col("words").alias("first"), F.slice("words", F.lit(2), F.size("words")).alias("second"))
    return rows.select(*keys, "words", F.posexplode(beside).alias("pos", "at")).select(*keys, "words", "pos", "at.first", "at.second")


def pair() -> Column:
    """What the table of pairs holds: two words, or one if the item has no other."""
    return F.xxhash64("first", "second")


def seeds(at: DataFrame, keys: list[str], masks: list[int]) -> DataFrame:
    """(*keys, pos, pair, seed) of the masks that fit in the words from a place on."""

    def of(mask: int) -> Column:
        chosen = (MASKS + RUNS)[mask]
        seed = F.xxhash64(F.lit(mask), *[F.get("words", F.col("pos") + o) for o in chosen])
        return F.when(F.col("pos") + chosen[-1] < F.size("words"), F.struct((pair() if len(chosen) > 1 else F.xxhash64("first")).alias("pair"), seed.alias("seed")))

    return at.select(*keys, "pos", F.explode(F.array(*[of(m) for m in masks])).alias("s")).where("s is not null").select(*keys, "pos", "s.pair", "s.seed")


def item_seeds(items: DataFrame, run: int, share: float) -> tuple[DataFrame, list[int]]:
    """(item, size, pair, seed, at) of the items, every place of a seed, and the masks they use.

    An item of at most ``run`` words counts only if all of it is there with few words replaced, so of
    one more run of its words than may be replaced, end to end, one is whole: these runs are its seeds.
    """
    missing = F.col("size") - F.ceil(F.col("size") * F.lit(share)).cast("int")
    length = F.least(F.floor(F.col("size") / (missing + 1)).cast("int"), F.lit(len(RUNS)))
    short = items.where(F.col("size").between(1, run)).withColumns({"missing": missing, "length": length})
    used = sorted(r.length for r in short.select("length").distinct().collect())
    columns = ["item", "size", "pair", "seed", F.col("pos").alias("at")]
    long = items.where(F.col("size") > run)
    masks = list(range(len(MASKS))) if long.limit(1).count() else []
    found = seeds(places(long, ["item", "size"]), ["item", "size"], list(range(len(MASKS)))).select(*columns)
    keys = ["item", "size", "missing"]
    for n in used:
        mask = len(MASKS) + n - 1
        of = seeds(places(short.where(F.col("length") == n), keys), keys, [mask])
        found = found.unionByName(of.where((F.col("pos") % n == 0) & (F.col("pos") <= F.col("missing") * n)).select(*columns))
        masks.append(mask)
    return found, masks or [0]


class Slots:
    """One byte per slot, 1 where a hash falls; of a size set by the number of hashes."""

    def __init__(self, hashes: DataFrame):
        size = FEWEST
        n = hashes.distinct().count()
        while size < ROOM * n and size < MOST:
            size *= 2
        column = hashes.columns[0]
        # a bitmap for each stretch of 2**15 slots; at most 512 of them
        stretches = hashes.select(F.pmod(column, F.lit(size)).alias("s")).groupBy(F.expr("s div 32768").alias("i")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits"))
        table = np.zeros(size, np.uint8)
        for r in stretches.collect():
            table[r.i << 15 : (r.i + 1) << 15] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        self.size, self.table = size, hashes.sparkSession.createDataFrame([(bytearray(table),)], "t binary").scalar()

    def holds(self, x: Column) -> Column:
        return F.substring(self.table, F.pmod(x, F.lit(self.size)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")


def contaminated(docs: DataFrame, benchmark: DataFrame, run: int = RUN, share: float = SHARE, least: int = 1) -> DataFrame:
    """(doc_id, h, item_id, first_word, n_words, n_matched) for every document that holds an item's passage.

    A passage counts if ``run`` aligned words in a row (all, of a shorter item) agree in ``share`` of
    the places. For the default run and share every such passage is found; for others that allow more
    words to differ, some may lack a seed. Items of fewer than ``least`` words match nothing; null texts are empty; a
    text of any length is one row, its words one array. h is the hash of the text: a repeated doc_id
    with other text is another document; a null doc_id is a document too. Repeated rows of either table
    count once; of equally good alignments the first is given. An empty table on either side gives an
    empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "contamination")
    items = benchmark.select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("item"), word_hashes(F.col("text")).alias("words"))
    items = scratch.save(items.withColumn("size", F.size("words")).where(F.col("size") >= max(1, least)), "items")
    known, masks = item_seeds(items, run, share)
    known = scratch.save(known.distinct(), "seeds")
    small = known.count() <= BROADCAST_SEEDS
    near = F.broadcast if small else (lambda df: df)
    pairs, whole = Slots(known.select("pair")), Slots(known.select("seed"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    at = places(rows.select("doc_id", "h", word_hashes(F.col("text")).alias("words")), ["doc_id", "h"])
    single = pairs.holds(F.xxhash64("first")) if len(MASKS) in masks else F.lit(False)
    mine = seeds(at.where(pairs.holds(pair()) | single), ["doc_id", "h"], masks)
    hits = mine.where(whole.holds(F.col("seed"))).join(near(known.drop("pair")), "seed").select("doc_id", "h", F.struct("item", "size", (F.col("pos") - F.col("at")).alias("shift")).alias("hit"))
    # the alignments of one text, which its length bounds
    hits = scratch.save(hits.groupBy("doc_id", "h").agg(F.collect_set("hit").alias("hits")), "hits")
    back = hits.withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    both = rows.join(back, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))).dropDuplicates(["doc_id", "h"])
    both = both.select("doc_id", "h", "hits", word_hashes(F.col("text")).alias("words"))
    aligned = F.transform("hits", lambda x: F.struct(x["item"].alias("item"), x["shift"].alias("shift"), F.slice("words", F.greatest(x["shift"], F.lit(0)) + 1, x["size"] + F.least(x["shift"], F.lit(0))).alias("part")))
    lined = both.select("doc_id", "h", F.explode(aligned).alias("a")).select("doc_id", "h", "a.*")
    joined = lined.join(near(items.select("item", "item_id", F.col("words").alias("of"), "size")), "item")
    other = F.slice("of", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("part"))
    joined = joined.select("doc_id", "h", "item", "item_id", F.greatest("shift", F.lit(0)).alias("from"), F.zip_with("part", other, lambda x, y: (x == y).cast("int")).alias("same"), F.least("size", F.lit(run)).alias("need"))
    sums = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("need")), lambda i: F.aggregate(F.slice("same", i + 1, F.col("need")), F.lit(0), lambda a, x: a + x))
    scored = joined.where(F.size("same") >= F.col("need")).select("*", F.array_max(sums).alias("most")).where(F.col("most") >= F.ceil(F.col("need") * F.lit(share)))
    matched = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    best = F.max(F.struct(matched.alias("matched"), (-F.col("from")).alias("from"), F.size("same").alias("n"))).alias("b")
    out = scored.groupBy("doc_id", "h", "item", "item_id").agg(best)
    return out.select("doc_id", "h", "item_id", (-F.col("b.from")).alias("first_word"), F.col("b.n").alias("n_words"), F.col("b.matched").alias("n_matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with their own columns, whatever their names.

    Items of fewer than ``least`` words remove nothing: a word or two stands in many a clean document. Null and empty texts stay, repeated rows stay or go together; an empty benchmark removes nothing.
    """
    doc, h = fresh(docs, "_doc", "_h")
    found = contaminated(docs, benchmark, least=least).select(F.col("doc_id").alias(doc), F.col("h").alias(h)).distinct()
    found = Scratch(docs.sparkSession, "contaminated").save(found, "rows")
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")
