"""Removal of word spans that occur more than once, over a compacted de Bruijn graph.

Every window of ``width`` words is an edge between its first and its last width-1 words. Storing each
edge of a corpus is too much, so edges are compacted within texts first. Every window has an anchor: the
least hash among its ``anchor``-word k-mers. A run of consecutive windows with one anchor is a path from
the first width-1 words of its first window to the last width-1 words of its last, named by the anchor
and the hash of all the words it spans; equal text gives equal paths wherever it stands. Joins over
paths then tell:

- an anchor with a single path, found once: none of its windows repeats;
- a path found at two source coordinates or more: all its windows repeat, and it needs one
  representative;
- a path found once whose anchor also has other paths (a branch), or stands in the path more than once
  (a cycle, as in text that repeats a few words): its windows are compared as single edges, with those
  of the other paths too, of which repeated ones take part by their representative.

The repeated paths are the edges of the graph across texts. A node that one of them enters and one
leaves does not branch; the two are joined there, and chains of such joins compact, in a number of rounds
that grows with the logarithm of their length, into maximal nonbranching paths. Occurrences that follow
each other in one nonbranching path and at adjoining source coordinates are one long repeated span.

So only branches and cycles are expanded to edges, and what is removed is exact for 128-bit window hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborline.llm.graph import components
from harborline.llm.scratch import Scratch
from harborline.llm.text import Words, bounded_batches, chunks, frugal, mix, span_hash, words

_SECOND = 0xC2B2AE3D27D4EB4F
_SECOND_INVERSE = pow(_SECOND, -1, 1 << 64)
#: What is known of a path: it repeats as a whole; its windows are to be compared one by one.
WHOLE, EDGES = 1, 2


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of x[i : i + size] for every i, the end padded."""
    have, out = 1, x.copy()
    while have < size:
        step = min(have, size - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def paths(w: Words, hashes: np.ndarray, width: int, anchor: int, cycles: bool = False) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor and hash of the words of each path, in order.

    With ``cycles``, also whether its anchor stands in the path more than once; in a path where it
    stands once, no two windows can be equal.
    """
    at = w.windows(width)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return (at, at, none, none, np.zeros(0, bool))[: 4 + cycles]
    kmers = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    whole = np.arange(len(hashes) - anchor + 1)
    kmers[whole] = span_hash(hashes, whole, whole + anchor)
    least = sliding_min(kmers, width - anchor + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    found = start, n, least[first], span_hash(hashes, start, start + n - 1 + width)
    if not cycles:
        return found
    # occurrences by (k-mer, place), and how many of the anchor's lie within the path
    values, rank = np.unique(kmers, return_inverse=True)
    places = np.sort(rank.astype(np.int64) << 32 | np.arange(len(kmers)))
    mine = np.searchsorted(values, least[first]).astype(np.int64) << 32
    last = start + n - 1 + width - anchor
    return *found, np.searchsorted(places, mine | last, "right") - np.searchsorted(places, mine | start) > 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def nonbranching(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, unitig): the paths of ``edges`` (path, head, tail) that join another at a node with one way in and one out.

    Paths of one unitig are a maximal nonbranching chain, or a cycle. A path that joins no other is left out.
    """
    ends = edges.select(F.col("head").alias("node"), F.col("path").alias("out"), F.lit(None).cast("long").alias("into"))
    ends = ends.unionByName(edges.select(F.col("tail").alias("node"), F.lit(None).cast("long").alias("out"), F.col("path").alias("into")))
    degrees = ends.groupBy("node").agg(F.count("into").alias("n_in"), F.count("out").alias("n_out"), F.max("into").alias("a"), F.max("out").alias("b"))
    return components(degrees.where("n_in = 1 and n_out = 1").select("a", "b"), scratch).select(F.col("node").alias("path"), F.col("root").alias("unitig"))


def substring_dedup(docs: DataFrame, width: int = 35, anchor: int = 12) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) of every row.

    A word is removed if it lies in a window of ``width`` words whose words also stand at any other
    place, in the same row or another. ``removed`` lists the removed spans as (first word, word after
    the last). A null or empty text has no words; a text of any length is one row. Rows are told apart
    by doc_id and text, so a null or repeated doc_id is no obstacle, and a repeated row counts as
    another place. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "substrings")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")

    def find_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, texts in chunks(batch):
                w = words(data, texts)
                hashes = w.hashes()
                start, n, least, span, again = paths(w, hashes, width, anchor, cycles=True)
                head, tail = span_hash(hashes, start, start + width - 1), span_hash(hashes, start + n, start + n - 1 + width)
                owner = np.searchsorted(w.first, start, "right") - 1
                ids = [batch.column(c)[part.start : part.stop].take(pa.array(owner)) for c in ("doc_id", "h")]
                places = [pa.array((start - w.first[owner]).astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.record_batch([*ids, *places, _signed(least), _signed(span), _signed(head), _signed(tail), pa.array(again)], ["doc_id", "h", "start", "n", "anchor", "span", "head", "tail", "again"])

    found = scratch.save(rows.mapInArrow(frugal(find_paths), "doc_id long, h long, start int, n int, anchor long, span long, head long, tail long, again boolean"), "paths")
    spans = found.groupBy("anchor", "span").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "h")).alias("chosen"), F.max("again").alias("again"), F.min("head").alias("head"), F.min("tail").alias("tail"))
    spans = scratch.save(spans, "spans")
    anchors = spans.groupBy("anchor").agg(F.sum("times").alias("all"), F.max("again").alias("cycle")).where("all > 1 or cycle").select("anchor", "all")
    # written first, so that both sides of each join are plain exchanges, of which a skewed one can be split
    kept = scratch.save(spans.join(scratch.save(anchors, "anchors"), "anchor").withColumn("path", F.xxhash64("anchor", "span")), "repeated")
    scratch.drop("spans", "anchors")
    unitigs = scratch.save(nonbranching(kept.where("times > 1").select("path", "head", "tail"), Scratch(spark, "unitigs")), "unitigs")
    kept = scratch.save(kept.join(unitigs, "path", "left").select("anchor", "span", "times", "all", "chosen", F.coalesce("unitig", "path").alias("unitig")), "known-paths")
    scratch.drop("repeated", "unitigs")
    chosen = (F.col("chosen.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("chosen.h") == F.col("h"))
    code = F.when(F.col("times") == 1, EDGES).when(chosen & (F.col("all") > F.col("times")), WHOLE | EDGES).otherwise(WHOLE)
    # of an anchor that stands alone, only paths with a cycle are kept above
    marked = found.drop("again", "head", "tail").join(kept, ["anchor", "span"]).select("doc_id", "h", "start", "n", code.cast("int").alias("code"), "unitig")
    # repeated rows say everything twice; then adjoining occurrences of one unitig become one span
    marked = marked.repartition("doc_id", "h").groupBy("doc_id", "h", "start").agg(F.min("n").alias("n"), F.bit_or("code").alias("code"), F.min("unitig").alias("unitig"))
    by = Window.partitionBy("doc_id", "h").orderBy("start")
    follows = (F.lag(F.col("start") + F.col("n")).over(by) == F.col("start")) & (F.lag("unitig").over(by) == F.col("unitig")) & (F.lag("code").over(by) == F.col("code"))
    marked = marked.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("of", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("doc_id", "h", "of").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("code").alias("code"))
    marks = merged.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n", "code")).alias("marks"))
    marks = scratch.save(marks.select("doc_id", "h", "marks", F.exists("marks", lambda m: m["code"] >= EDGES).alias("open")), "marks")
    scratch.drop("paths", "known-paths")

    of = lambda side: side.withColumnsRenamed({"doc_id": "_doc", "h": "_h"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of the paths to compare; those of a repeated path count twice."""
        for batch in batches:
            for part, data, texts in chunks(batch):
                w = words(data, texts)
                hashes = w.hashes()
                start, n, code = _marks(w, batch.column("marks")[part.start : part.stop])
                start, n, code = (x[code >= EDGES] for x in (start, n, code))
                at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner = np.searchsorted(w.first, at, "right") - 1
                ids = [batch.column(c)[part.start : part.stop].take(pa.array(owner)) for c in ("doc_id", "h")]
                one = span_hash(hashes, at, at + width)
                two = span_hash(mix(hashes), at, at + width, _SECOND, _SECOND_INVERSE)
                weight = np.repeat(1 + (code & WHOLE), n).astype(np.int32)
                yield pa.record_batch([*ids, pa.array((at - w.first[owner]).astype(np.int32)), _signed(one), _signed(two), pa.array(weight)], ["doc_id", "h", "start", "one", "two", "weight"])

    compared = rows.join(of(marks.where("open").select("doc_id", "h", "marks")), same).select("doc_id", "h", "text", "marks")
    windows = scratch.save(compared.mapInArrow(frugal(edges), "doc_id long, h long, start int, one long, two long, weight int"), "windows")
    twice = scratch.save(windows.groupBy("one", "two").agg(F.sum("weight").alias("n")).where("n > 1").select("one", "two"), "twice")
    hits = windows.join(twice, ["one", "two"]).groupBy("doc_id", "h").agg(F.collect_set("start").alias("hits"))
    hits = scratch.save(hits, "hits")
    scratch.drop("windows", "twice")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part, data, texts in chunks(batch):
                w = words(data, texts)
                start, n, code = _marks(w, batch.column("marks")[part.start : part.stop])
                raw, whole = data.tobytes(), (code & WHOLE) > 0
                change = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(change, start[whole], 1)
                np.add.at(change, start[whole] + n[whole] - 1 + width, -1)
                for i, hit in enumerate(batch.column("hits")[part.start : part.stop].to_pylist()):
                    if hit:
                        at = w.first[i] + np.array(hit)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                digests, spans = [], []
                for i in range(len(texts) - 1):
                    out, mine = raw[texts[i] : texts[i + 1]].split(), gone[w.first[i] : w.first[i + 1]]
                    if mine.any():
                        out = [x for x, g in zip(out, mine.tolist(), strict=True) if not g]
                    digests.append(hashlib.sha256(b" ".join(out)).hexdigest())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))).tolist()
                    spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
                yield pa.record_batch([batch.column("doc_id")[part.start : part.stop], pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digests, pa.string()), pa.array(spans, kind)], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    known = marks.select("doc_id", "h", "marks").join(of(hits), same, "left").select("doc_id", "h", "marks", "hits")
    known = scratch.save(known, "known")
    final = rows.join(of(known), same, "left").select("doc_id", "text", "marks", "hits")
    return final.mapInArrow(frugal(cut), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>")


def _marks(w: Words, marks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and code of every mark of consecutive texts; null has none."""
    lengths = np.array(pc.fill_null(pc.list_value_length(marks), 0), np.int64)
    flat = marks.flatten()
    start, n, code = (np.array(flat.field(c), np.int64) for c in ("start", "n", "code"))
    return start + np.repeat(w.first[:-1], lengths), n, code
