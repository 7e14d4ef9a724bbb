"""Quality rules whose cutoffs adapt to each language and source.

The statistics of a document are compared with thresholds read from quantile sketches of its own
(lang, source). A sketch is a histogram on a logarithmic scale: bin b holds the values within a fixed
relative error of its middle. Two sketches merge by adding bins, in any order and exactly, so the
result does not depend on how rows are dealt out. A source's threshold is drawn towards that of its
language, and a language's towards that of everything, the more the fewer rows it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harborline.llm.scratch import Scratch
from harborline.llm.text import bounded_batches, chunks, frugal, mix, per_text, span_hash, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
STRESS = np.zeros(256, bool)
STRESS[[ord(c) for c in "!?"]] = True
#: Relative width of a sketch's bins, and the value from which they are counted.
GAMMA, LEAST = 1.02, 1e-4

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stress"]
#: Metric: its expression, and how far over the adaptive threshold a value must lie at least.
METRICS: dict[str, tuple[Column | str, float]] = {
    "repeats": ("n_repeat_words / n_words", 0.10),
    "dup_lines": ("n_dup_lines / n_lines", 0.10),
    "symbols": ("n_symbols / word_chars", 0.03),
    "stress": ("n_stress / word_chars", 0.03),
    "upper": ("n_upper / word_chars", 0.10),
    "word_length": ("word_chars / n_words", 1.0),
}


def repeated_words(hashes: np.ndarray, first: np.ndarray, starts: np.ndarray, size: int = 3) -> np.ndarray:
    """Words per text within windows of ``size`` words found twice or more in that text."""
    owner = np.searchsorted(first, starts, "right") - 1
    key = span_hash(hashes, starts, starts + size) ^ mix(owner.astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(hashes) + size, bool)
    for j in range(size):
        covered[starts[again] + j] = True
    return per_text(covered[: len(hashes)], first)


def repeated_lines(raw: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def measure(data: np.ndarray, texts: np.ndarray) -> dict[str, np.ndarray]:
    """The counts named in COUNTS for each text."""
    w = words(data, texts)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    raw = data.tobytes()
    lines = np.array([repeated_lines(raw[a:b]) for a, b in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True)], np.int64).reshape(-1, 2)
    return {
        "n_words": w.counts,
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80), texts),
        "n_symbols": per_text(SYMBOLS[data], texts),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeated_words(w.hashes(), w.first, w.windows(3)),
        "n_lines": lines[:, 0],
        "n_upper": per_text(UPPER[data], texts),
        "n_stress": per_text(STRESS[data], texts),
    }


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) with the counts of each whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, texts in chunks(batch):
                found = measure(data, texts)
                kept = [batch.column(c)[rows.start : rows.stop] for c in ("doc_id", "lang", "source")]
                yield pa.record_batch([*kept, *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], ["doc_id", "lang", "source", *COUNTS])

    return docs.select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(frugal(run), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def sketches(values: DataFrame) -> DataFrame:
    """Bins (lang, source, metric, bin, n) of the metrics, over rows with at least one word."""
    bin_of = lambda x: F.when(x <= LEAST, 0).otherwise(F.ceil(F.log(x / LEAST) / math.log(GAMMA))).cast("int")
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(F.col(f"m_{m}")).alias("bin")) for m in METRICS]))
    return values.where("n_words > 0").select("lang", "source", stacked.alias("x")).groupBy("lang", "source", "x.metric", "x.bin").agg(F.count("*").alias("n"))


def fences(bins: DataFrame, keys: list[str], spread: float) -> DataFrame:
    """Per key and metric: the threshold median + spread * (third quartile - median), and the rows behind it."""
    merged = bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "metric")
    ranked = merged.select("*", F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(by).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin")))
    value = lambda b: F.when(b == 0, 0.0).otherwise(LEAST * F.pow(F.lit(GAMMA), b) * 2 / (1 + GAMMA))
    found = ranked.groupBy(*keys, "metric").agg(at(0.5).alias("mid"), at(0.75).alias("high"), F.first("total").alias("total"))
    return found.select(*keys, "metric", "total", (value(F.col("mid")) + spread * (value(F.col("high")) - value(F.col("mid")))).alias("fence"))


def quality_rules(docs: DataFrame, spread: float = 7.0, prior: float = 200.0) -> DataFrame:
    """One row per document: doc_id, counts, base_failed, kept and the names of the rules it broke.

    base_failed: under 50 words, or over half of the words repeated. kept is false for those, and for
    documents over an adaptive threshold by the metric's margin. A group's threshold is the mean of its
    own, weighted by its rows, and of the next larger group's, weighted by ``prior``. Null lang or source
    is a group like any other; null and empty texts have zero counts and fail; a text of any length is
    one row. Repeated rows each count; a null doc_id is kept. An empty table gives an empty result.
    Extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    scratch = Scratch(spark, "rules")
    stats = scratch.save(measured(docs), "stats")
    ratio = {m: F.coalesce(F.try_divide(*[F.col(x.strip()).cast("double") for x in e.split("/")]), F.lit(0.0)).alias(f"m_{m}") for m, (e, _) in METRICS.items()}
    values = stats.select("*", *ratio.values())
    bins = scratch.save(sketches(values), "sketches")
    levels = [["lang", "source"], ["lang"], []]
    wide = []
    for keys in levels:
        entry = F.struct("metric", F.struct("fence", "total"))
        wide.append(fences(bins, keys, spread).groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(f"f{len(keys)}")))
    groups = bins.select("lang", "source").distinct()
    for keys, f in zip(levels, wide, strict=True):
        if keys:
            f = f.select(*[F.col(k).alias(f"_{k}") for k in keys], f"f{len(keys)}")
            on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            groups = groups.join(f, on, "left").drop(*[f"_{k}" for k in keys])
        else:
            groups = groups.withColumn("f0", f.scalar())
    drawn = lambda own, near: (own["total"] * own["fence"] + prior * near) / (own["total"] + prior)
    of_lang = F.map_zip_with("f1", "f0", lambda _, own, near: drawn(own, near["fence"]))
    groups = groups.withColumn("fence", F.map_zip_with("f2", of_lang, lambda _, own, near: drawn(own, near)))
    table = scratch.save(groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "fence"), "thresholds")
    over = F.array_compact(F.array(*[F.when(F.col(f"m_{m}") > F.col("fence")[m] + slack, F.lit(m)) for m, (_, slack) in METRICS.items()]))
    joined = values.join(table, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broke = F.coalesce(over, F.array().cast("array<string>"))
    return joined.select("doc_id", *COUNTS[:5], base.alias("base_failed"), (~base & (F.size(broke) == 0)).alias("kept"), broke.alias("broken_rules"))
