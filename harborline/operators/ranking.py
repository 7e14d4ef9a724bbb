"""Ranks and running sums over a whole table without moving it to one task.

Rows are binned by boundaries read from a bounded sample of the sort keys, ranked within their bin,
and shifted by the sizes of the bins before. The bins are a column, so skewed keys spread as long as
the tie-breaker does.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows sampled for boundaries, bins at least and at most, and rows that one task may rank alone.
SAMPLE, BINS, MOST_BINS, SMALL = 10_000, 64, 4_096, 50_000
#: Boundaries that a row is compared with one by one.
FLAT = 16
#: Parts of a span of keys that one scan counts.
SPLIT = 512


def _place(keyed: DataFrame, n: int, bins: int) -> Column:
    """The bin of ``_k``, a struct, by boundaries read from a bounded sample of it: two steps of comparisons where bins are more than a few."""
    rate = min(1.0, max(SAMPLE, 16 * bins) / n)
    rows = keyed.where(F.pmod(F.xxhash64("_k"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).select("_k.*").limit(4 * max(SAMPLE, 16 * bins)).collect()
    drawn = sorted(set(rows), key=lambda r: tuple((x is not None, x) for x in r))
    kinds = keyed.select("_k.*").dtypes
    edges = [F.struct(*[F.lit(x).cast(kind).alias(c) for x, (c, kind) in zip(r, kinds, strict=True)]) for r in drawn[:: max(1, len(drawn) // bins)][1:]]
    over = lambda some: F.size(F.filter(some, lambda e: e < F.col("_k")))
    if not edges:
        return F.lit(0)
    if len(edges) <= FLAT:
        return over(F.array(*edges))
    step = math.isqrt(len(edges)) + 1
    blocks = [edges[i : i + step] for i in range(0, len(edges), step)]
    block = over(F.array(*[x[-1] for x in blocks]))
    inside = F.coalesce(over(F.get(F.array(*[F.array(*x) for x in blocks]), block)), F.lit(0))
    return F.when(block == len(blocks), len(edges)).otherwise(block * step + inside)


def _bins(n: int, bins: int | None) -> int:
    """Bins follow the rows: a million each, as far as MOST_BINS."""
    return bins or min(MOST_BINS, max(BINS, n // 1_000_000))


def globally_ranked(df: DataFrame, key: Column, tie: str, name: str = "rn", running: dict[str, str] | None = None, base: DataFrame | None = None, bins: int | None = None, small: int = SMALL, bin_as: str | None = None) -> DataFrame:
    """``df`` with ``name``, the row number by (key, tie) ascending, and running sums of columns.

    ``key`` is numeric and ``tie`` unique. ``running`` maps new columns to the columns summed. ``base``
    has the same rows before other ranks were added; boundaries and bin sizes are read from it, so it is
    worth caching where several ranks are taken. Up to ``small`` rows, one task ranks them all. ``bin_as``
    names a column that keeps a row's bin; bins ascend with the rank.
    """
    base = df if base is None else base
    n = base.count()
    if n <= small:
        by = Window.orderBy(key, tie)
        sums = {a: F.sum(b).over(by.rowsBetween(Window.unboundedPreceding, 0)) for a, b in (running or {}).items()}
        return df.withColumn(name, F.row_number().over(by)).withColumns(sums).withColumns({bin_as: F.lit(0)} if bin_as else {})
    keyed = lambda x: x.withColumn("_k", F.struct(key.alias("k"), F.col(tie).alias("t")))
    place = _place(keyed(base), n, _bins(n, bins))
    sums = {f"_s_{a}": F.sum(b).alias(f"_s_{a}") for a, b in (running or {}).items()}
    sizes = keyed(base).withColumn("_bin", place).groupBy("_bin").agg(F.count("*").alias("_n"), *sums.values())
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", *sums)])
    within = Window.partitionBy("_bin").orderBy("_k")
    binned = keyed(df).withColumn("_bin", place)
    out = binned.join(F.broadcast(offsets), "_bin").withColumn(name, F.row_number().over(within) + F.col("_n_before"))
    for a, b in (running or {}).items():
        out = out.withColumn(a, F.sum(b).over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_s_{a}_before"))
    out = out.drop("_k", "_n_before", *[f"{s}_before" for s in sums])
    return out.withColumnRenamed("_bin", bin_as) if bin_as else out.drop("_bin")


def least_from(ranked: DataFrame, value: Column, rank: str, place: str, name: str) -> DataFrame:
    """``ranked`` with ``name``, the least ``value`` of a row and of all rows of higher rank; ``place`` is the bin of the rank.

    A bin runs down from its highest rank, which takes one step a row, and starts from the least of the bins after it.
    """
    down = Window.partitionBy(place).orderBy(F.desc(rank)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, -1)
    later = ranked.groupBy(place).agg(F.min(value).alias("_low")).select(place, F.min("_low").over(after).alias("_later"))
    return ranked.join(F.broadcast(later), place).withColumn(name, F.least(F.min(value).over(down), "_later")).drop("_later")


def previous(df: DataFrame, column: str, order: str, name: str, bins: int | None = None) -> DataFrame:
    """``df`` with ``name``, the column's value in the row before by (order, column), nulls first; null in the first row.

    Rows are binned by ranges of that order; a bin takes its first row's value from the last row of the
    last bin before it that has any, so no bin waits for another. Rows equal in both columns share the bins that a hash
    of the whole row gives them.
    """
    keyed = df.withColumn("_k", F.struct(F.col(f"`{order}`").alias("o"), F.col(f"`{column}`").alias("v"), F.xxhash64(*[F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))]).alias("h")))
    n = df.count()
    binned = keyed.withColumn("_bin", _place(keyed, max(n, 1), _bins(n, bins)))
    last = binned.groupBy("_bin").agg(F.max("_k").alias("_last"))
    last = last.select("_bin", F.lag("_last").over(Window.orderBy("_bin"))["v"].alias("_handed"))
    within = Window.partitionBy("_bin").orderBy("_k")
    first = F.row_number().over(within) == 1
    out = binned.join(F.broadcast(last), "_bin").withColumn(name, F.when(first, F.col("_handed")).otherwise(F.lag(column).over(within)))
    return out.drop("_k", "_bin", "_handed")


def ntile(rn: Column, n: Column, k: int) -> Column:
    """The bucket that NTILE(k) gives row ``rn`` of ``n``."""
    q, r = F.floor(n / k), n % k
    head = r * (q + 1)
    return F.when(q == 0, rn).when(rn <= head, F.floor((rn - 1) / (q + 1)) + 1).otherwise(r + F.floor((rn - 1 - head) / F.greatest(q, F.lit(1))) + 1).cast("int")


def order_key(x: Column) -> Column:
    """A long that orders as the double ``x`` does: the bits of its absolute value, negated for negative numbers.

    Infinities are the ends and both zeros are 0. Every step is exact: powers of two, and divisions by them.
    """
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    two = lambda e: F.pow(F.lit(2.0), e)
    # log2 may be off by one next to a power of two
    exponent = F.when(two(guess) > a, guess - 1).when(two(guess + 1) <= a, guess + 1).otherwise(guess)
    normal = (exponent + 1023) * (1 << 52) + ((a / two(exponent) - 1) * float(1 << 52)).cast("long")
    tiny = (a * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(a == math.inf, F.lit(2047 << 52)).when(a < 2.0**-1022, tiny).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def value_of(key: int) -> float:
    """The double of a key."""
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(key)))[0], key)


@dataclass
class Span:
    """An interval of one column's keys that holds some of the ranks sought, counted from its own start."""

    column: str
    low: int
    high: int
    n: int
    ranks: dict[int, int]

    @property
    def shift(self) -> int:
        """The bits to drop so that at most SPLIT different keys are left; at least eight bits of the width go."""
        s = 0
        while (self.high >> s) - (self.low >> s) >= SPLIT:
            s += 1
        return s


def _inside(keys: DataFrame, spans: list[Span]) -> DataFrame:
    """(i, bin, k) of every key in span i; the spans of a column are disjoint."""
    cells: dict[str, Column] = {}
    for i, s in enumerate(spans):
        inside, found = F.col(s.column).between(s.low, s.high), F.struct(F.lit(i).alias("i"), F.shiftright(s.column, s.shift).alias("bin"), F.col(s.column).alias("k"))
        cells[s.column] = cells[s.column].when(inside, found) if s.column in cells else F.when(inside, found)
    return keys.select(F.explode(F.array(*cells.values())).alias("x")).where("x is not null").select("x.*")


def _counted(keys: DataFrame, spans: list[Span]) -> list[list[tuple[int, int, int]]]:
    """One scan: (low, high, n) of the parts of every span, ascending."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in spans]
    for r in _inside(keys, spans).groupBy("i", "bin").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n")).collect():
        out[r.i].append((r.low, r.high, r.n))
    return [sorted(x) for x in out]


def _read(keys: DataFrame, spans: list[Span]) -> list[list[int]]:
    """One scan: the keys of every span, ascending; the caller has bounded their number."""
    out: list[list[int]] = [[] for _ in spans]
    for r in _inside(keys, spans).select("i", "k").collect():
        out[r.i].append(r.k)
    return [sorted(x) for x in out]


def _between(low: float, high: float, share: float) -> float:
    """Interpolated; next to an infinity the nearer end, so that nothing becomes NaN."""
    if math.isinf(low) or math.isinf(high):
        return low if share < 0.5 else high
    return low + (high - low) * share if math.isfinite(high - low) else low * (1 - share) + high * share


def _keyed(columns: dict[str, Column], df: DataFrame) -> DataFrame:
    values = df.select(*[c.cast("double").alias(k) for k, c in columns.items()])
    return values.select(*[F.when(~F.isnan(k), order_key(F.col(k))).alias(k) for k in columns])


def _ends(keys: DataFrame) -> dict[str, tuple[int, int, int]]:
    """One scan: how many keys each column has, the least and the largest."""
    r = keys.agg(*[F.struct(F.count(k), F.min(k), F.max(k)).alias(k) for k in keys.columns]).first()
    return {k: tuple(r[k]) for k in keys.columns}


def _at_ranks(keys: DataFrame, ends: dict[str, tuple[int, int, int]], ranks: dict[str, list[int]], small: int) -> dict[tuple[str, int], float]:
    """The value at each rank (from 0) of each column."""
    known: dict[tuple[str, int], int] = {}
    spans = [Span(k, ends[k][1], ends[k][2], ends[k][0], {r: r for r in ranks[k]}) for k in ranks if ranks[k]]
    while spans:
        for s in spans:
            if s.low == s.high:
                known |= {(s.column, r): s.low for r in s.ranks}
        spans = [s for s in spans if s.low < s.high]
        if spans and sum(s.n for s in spans) <= small:
            for s, held in zip(spans, _read(keys, spans), strict=True):
                known |= {(s.column, r): held[i] for r, i in s.ranks.items()}
            break
        parts = _counted(keys, spans) if spans else []
        narrower = []
        for i, s in enumerate(spans):
            before = 0
            for low, high, n in parts[i]:
                here = {r: at - before for r, at in s.ranks.items() if before <= at < before + n}
                if here:
                    narrower.append(Span(s.column, low, high, n, here))
                before += n
        spans = narrower
    return {at: value_of(k) for at, k in known.items()}


def exact_ranks(df: DataFrame, column: Column, ranks: list[int], small: int = SMALL) -> list[float]:
    """The values of a column at ranks from 0, as ``exact_quantiles`` finds them."""
    keys = _keyed({"x": column}, df)
    found = _at_ranks(keys, _ends(keys), {"x": list(dict.fromkeys(ranks))}, small)
    return [found["x", r] for r in ranks]


def exact_quantiles(df: DataFrame, columns: dict[str, Column], marks: list[float], small: int = SMALL) -> dict[str, list[float | None]]:
    """The exact, interpolated quantiles of every column, without gathering its values in one task.

    Values become 64-bit keys of the same order. A scan counts the least and largest key of each column; each
    further one splits the spans that hold a sought rank, of all columns and ranks together, and goes on in
    the parts that hold it, at least eight bits narrower. Spans of ``small`` rows in all are read as they are.
    Nine scans suffice for any table. Null and NaN are missing; without values all quantiles are None.
    """
    if not columns:
        return {}
    names = {k: f"k{i}" for i, k in enumerate(columns)}
    keys = _keyed({names[k]: c for k, c in columns.items()}, df)
    ends = _ends(keys)
    places = {k: [(ends[k][0] - 1) * q for q in marks] if ends[k][0] else [] for k in names.values()}
    known = _at_ranks(keys, ends, {k: sorted({f(p) for p in own for f in (math.floor, math.ceil)}) for k, own in places.items()}, small)
    return {k: [_between(known[name, math.floor(p)], known[name, math.ceil(p)], p - math.floor(p)) for p in places[name]] or [None] * len(marks) for k, name in names.items()}
