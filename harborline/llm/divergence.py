"""Divergence of sources: how far the word use of each source lies from the others' of its language.

Terms are counted per (lang, source) inside the tasks and summed in one shuffle. The counts are then dealt
out by ranges of (lang, term), so all sources of a term meet in one sorted partition, and a chunk of it
becomes integers: the sorted array of its kept terms is the dictionary, searchsorted gives each count's id,
and every group's counts become one dense row. Ids ascend as the terms do in UTF-8, so a tie
between terms is broken by the id. A second pass over the chunks, now with the groups' totals, computes
what each chunk adds to the distance of two sources, and its strongest terms. All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.scratch import Scratch
from harborline.llm.text import bounded_batches, buffers, frugal

#: Documents that keep a term, ranks of part ``term``.
LEAST, TOP = 10, 10
#: Distinct counts a task holds before it passes them on; rows, terms and cells of a chunk.
HELD, ROWS, TERMS, CELLS = 200_000, 1 << 17, 1 << 12, 1 << 20
SCALE = 1_000_000_000
#: Everything in ASCII but letters ends a term; only A-Z are lower-cased.
_TERMS = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents of each term, summed in parts; an empty term marks a group."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = [b"", *n]
            columns = [pa.array([x]).take(pa.array(np.zeros(len(terms), np.int32))) for x in (lang, source)]
            counts = [pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(d.__getitem__, n)], pa.int64())]
            yield pa.record_batch([*columns, pa.array(terms, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            data, at = buffers(batch.column("text"))
            raw, at = memoryview(data), at.tolist()
            for lang, source, a, b in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), at[:-1], at[1:], strict=True):
                if (lang, source) not in held:
                    held[lang, source] = (Counter(), Counter())
                n, d = held[lang, source]
                found = bytes(raw[a:b]).translate(_TERMS).split()
                size -= len(n)
                n.update(found)
                d.update(set(found))
                size += len(n) + 1
                if size >= HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")
    parts = named.mapInArrow(frugal(run), "lang string, source string, term string, n long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def changes(table: pa.Table, names: list[str]) -> np.ndarray:
    """The rows that differ from the one before, the first included."""
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in map(table.column, names)])
    return np.flatnonzero(new)


def encoded(table: pa.Table, least: int, terms_most: int, cells_most: int) -> Iterator[pa.RecordBatch]:
    """Chunks of one lang's rows (term, source, n, d) in the order of terms: the kept terms and a dense row of counts a source."""
    starts = changes(table, ["term"])
    run = np.repeat(np.arange(len(starts)), np.diff([*starts, table.num_rows]))
    kept = np.flatnonzero(np.add.reduceat(table.column("d").to_numpy(), starts) >= least)
    if not len(kept):
        return
    ids = np.searchsorted(kept, run)
    known = (ids < len(kept)) & (kept[np.minimum(ids, len(kept) - 1)] == run)
    table, ids = table.filter(pa.array(known)), ids[known]
    sources = table.column("source").combine_chunks().dictionary_encode()
    codes, names, n = sources.indices.to_numpy(), sources.dictionary, table.column("n").to_numpy()
    terms = table.column("term").take(pa.array(changes(table, ["term"]))).combine_chunks()
    step = max(1, min(terms_most, cells_most // len(names)))
    for first in range(0, len(kept), step):
        a, b = np.searchsorted(ids, [first, first + step])
        width = min(step, len(kept) - first)
        cells = np.zeros((len(names), width), np.int64)
        cells[codes[a:b], ids[a:b] - first] = n[a:b]  # a source has one row a term
        lists = [terms.slice(first, width), names, pa.array(cells.sum(axis=1)), pa.array(cells.ravel())]
        yield pa.record_batch([table.column("lang").slice(0, 1).combine_chunks(), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]], ["lang", "terms", "sources", "sums", "cells"])


def chunked(counts: DataFrame, least: int) -> DataFrame:
    """(lang, terms, sources, sums, cells) of the terms in at least ``least`` documents of their lang."""

    def parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        edges = [*changes(table, ["lang"]), table.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield from encoded(table.slice(a, b - a), least, TERMS, CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= ROWS:
                table = pa.Table.from_batches(held)
                last = int(changes(table, ["lang", "term"])[-1])  # the last term may go on
                if last:
                    yield from parts(table.slice(0, last))
                held = table.slice(last).to_batches()
        if sum(x.num_rows for x in held):
            yield from parts(pa.Table.from_batches(held))

    dealt = counts.where("term <> ''").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.select("lang", "term", "source", "n", "d").mapInArrow(frugal(run), "lang string, terms array<string>, sources array<string>, sums array<long>, cells array<long>")


def per_billion(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total) for count <= total, three digits at a time so that nothing overflows."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def compared(chunks: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value): what each chunk adds to each pair of sources, and its ``top`` terms of each source.

    ``chunks`` has, besides its own columns, all groups of its lang (names, totals) and the lang's number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, totals = row["names"], np.array(row["totals"], np.int64)
                place = {s: i for i, s in enumerate(names)}
                own = np.array([place[s] for s in row["sources"]])
                given = np.array(row["cells"], np.int64).reshape(len(own), -1)
                size, terms = 2 * row["size"], row["terms"]
                sums, out = np.zeros((len(names), len(names)), np.int64), ([], [], [], [])
                step = max(1, CELLS // len(names))
                for first in range(0, len(terms), step):
                    part = given[:, first : first + step]
                    cells = np.zeros((len(names), part.shape[1]), np.int64)
                    cells[own] = part
                    p = per_billion(cells + 2, (totals + size)[:, None])
                    q = per_billion(cells.sum(axis=0) + 2, int(totals.sum()) + size)
                    for i in range(len(names)):
                        sums[i, i + 1 :] += distance(p[i], p[i + 1 :]).sum(axis=1)
                        far = np.flatnonzero((cells[i] > 0) & (p[i] > q))
                        value = distance(p[i, far], q[far])
                        best = np.argsort(-value, kind="stable")[:top]
                        for x, y in zip(out, ([names[i]] * len(best), ["term"] * len(best), [terms[first + j] for j in far[best]], value[best].tolist()), strict=True):
                            x += y
                sums += sums.T
                for i, name in enumerate(names):
                    others = [j for j in range(len(names)) if j != i]
                    for x, y in zip(out, ([name] * len(others), ["pair"] * len(others), [names[j] for j in others], sums[i, others].tolist()), strict=True):
                        x += y
                yield pa.record_batch([pa.array([row["lang"]] * len(out[0]), pa.string()), *[pa.array(x, pa.string()) for x in out[:3]], pa.array(out[3], pa.int64())], ["lang", "source", "part", "item", "value"])

    return chunks.mapInArrow(frugal(run), "lang string, source string, part string, item string, value long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its lang, and the terms that mark it.

    Null text, lang and source count as empty. Part ``pair`` has a row for each other source, 0 where the
    lang keeps no term; part ``term`` the ``top`` terms that a source uses more than its lang. Values
    descend by rank, ties ascend by the item's UTF-8 bytes. Every row of ``docs`` is a document, repeated
    ones too. A text of any length is counted whole by one task; extra columns and doc_id are ignored; an
    empty table gives an empty result. The pairs of a lang grow with the square of its sources.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.save(counted(docs), "counts")
    groups = counts.where("term = ''").select("lang", "source")
    chunks = scratch.save(chunked(counts, least), "chunks")
    sums = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("total"))
    totals = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("groups"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("size"))
    langs = scratch.save(totals.join(sizes, "lang").select("lang", "size", F.col("groups.source").alias("names"), F.col("groups.total").alias("totals")), "langs")
    found = scratch.save(compared(chunks.drop("sums").join(langs, "lang"), top), "found")
    others = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").unionByName(others).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranks = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(ranks))
    return ranked(pairs).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))


#: The same in DuckDB.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 2) // (coalesce(n.n, 0) + 2 * l.v) AS p, 1 + 1000000000 * (k.c + 2) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
