"""A bounded sample of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a classifier is fitted on at most, in expectation. The fit needs no more; scoring and
#: everything else covers all rows.
SAMPLE = 20_000


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out fold.

    A document's label is its largest where rows repeat. Rows are drawn by a hash of doc_id at the
    rate that leaves ``bound`` of them, so the draw is the same at every run; the drawn labels are
    bounded, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus, remainder)).groupBy("doc_id").agg(F.max(label).alias("label"))
    n = known.count()
    rate = min(1.0, bound / max(1, n))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(rate * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
