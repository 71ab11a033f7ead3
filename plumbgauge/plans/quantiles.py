"""Exact quantiles (linear interpolation) that stay bounded at any size.

The built-in exact ``percentile`` keeps every distinct value of a column in one task. Here each
wanted order statistic is cornered instead. A pass counts the values per equal-width bucket between
the column's extremes; the bucket that holds the wanted rank becomes the new interval, a few
thousand times smaller. When an interval holds few enough values they are sorted and looked up. All
columns share every pass, and a task never holds more than the buckets. Where equal widths do not
narrow (a far outlier squeezes everything into one bucket), approximate percentiles, also of
bounded size, propose the next interval.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgauge.plans.stats import col

BUCKETS = 4096
SORT_LIMIT = 100_000
SKETCH_ACCURACY = 10_000


@dataclass(frozen=True)
class Interval:
    """Values of a (double, NaN-free) column between two bounds, each of which may be excluded."""

    column: str
    low: float
    high: float
    open_low: bool = False
    open_high: bool = False

    def inside(self) -> Column:
        c = col(self.column)
        above = c > F.lit(self.low) if self.open_low else c >= F.lit(self.low)
        below = c < F.lit(self.high) if self.open_high else c <= F.lit(self.high)
        return F.when(above & below, c)

    def width(self) -> float:
        return (self.high - self.low) / BUCKETS


@dataclass
class _Target:
    """The value of 0-based rank ``rank`` among the ``size`` values of an interval."""

    interval: Interval
    rank: int
    size: int
    value: float | None = None
    sketch: bool = False

    def enter(self, interval: Interval, skipped: int, size: int) -> None:
        # Equal widths that keep a quarter of the values or more are not worth another round.
        self.sketch = not self.sketch and size * 4 > self.size
        self.interval, self.rank, self.size = interval, self.rank - skipped, size
        if interval.low == interval.high:
            self.value = interval.low


def number(name: str) -> Column:
    """The column as double with NaN as null."""
    c = col(name).cast("double")
    return F.when(~F.isnan(c), c)


def range_aggregates(columns: list[str]) -> list[Column]:
    """Aggregates a caller can add to a pass of its own, to be read back with :func:`ranges_from`."""
    return [f(number(c)).alias(f"_{n}{i}") for i, c in enumerate(columns)
            for n, f in (("count", F.count), ("low", F.min), ("high", F.max))]


def ranges_from(row, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    return {c: (row[f"_count{i}"], row[f"_low{i}"], row[f"_high{i}"]) for i, c in enumerate(columns)}


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], *,
                    ranges: dict[str, tuple[int, float, float]] | None = None,
                    sort_limit: int = SORT_LIMIT) -> dict[str, list[float | None]]:
    """Quantiles of each column over its non-null values; ``None`` for an empty column.

    The result is a handful of scalars per column, so the later pass that uses them compares with
    literals and needs no join. ``ranges`` (count, minimum, maximum) save the first pass when a
    caller has them already. At most ``sort_limit`` values in total are ever sorted in one place.
    """
    if not columns:
        return {}
    df = df.select(*[number(c).alias(c) for c in columns])
    if ranges is None:
        ranges = ranges_from(df.agg(*range_aggregates(columns)).first(), columns)
    filled = {c: ranges[c] for c in columns if ranges[c][0]}
    spots = {(c, p): p * (n - 1) for c, (n, _, _) in filled.items() for p in probabilities}
    targets = {(c, r): _Target(Interval(c, *filled[c][1:]), r, filled[c][0])
               for (c, _), s in spots.items() for r in (math.floor(s), math.ceil(s))}
    for t in targets.values():
        if t.interval.low == t.interval.high:
            t.value = t.interval.low
    while True:
        unsolved = [t for t in targets.values() if t.value is None]
        wide = _beyond_sorting(unsolved, sort_limit)
        if not wide:
            break
        sketched = [t for t in wide if t.sketch or not 0 < t.interval.width() < math.inf]
        bucketed = [t for t in wide if t not in sketched]
        if bucketed:
            _narrow_by_buckets(df, bucketed)
        if sketched:
            _narrow_by_sketch(df, sketched)
    if unsolved:
        _look_up(df, unsolved)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        line: list[float | None] = []
        for p in probabilities:
            if c not in filled:
                line.append(None)
                continue
            spot = spots[c, p]
            low, high = targets[c, math.floor(spot)].value, targets[c, math.ceil(spot)].value
            line.append(low + (high - low) * (spot - math.floor(spot)))
        out[c] = line
    return out


def _beyond_sorting(targets: list[_Target], sort_limit: int) -> list[_Target]:
    """Targets to narrow further, largest intervals first, until the rest may be sorted together."""
    sizes = {t.interval: t.size for t in targets}
    keep: set[Interval] = set()
    room = sort_limit
    for interval, size in sorted(sizes.items(), key=lambda item: item[1]):
        if size <= room or size <= 1:
            keep.add(interval)
            room -= size
    return [t for t in targets if t.interval not in keep]


def _narrow_by_buckets(df: DataFrame, targets: list[_Target]) -> None:
    intervals = list(dict.fromkeys(t.interval for t in targets))
    cells = []
    for i, interval in enumerate(intervals):
        v = interval.inside()
        place = F.least(F.floor((v - F.lit(interval.low)) / F.lit(interval.width())), F.lit(BUCKETS - 1))
        cells.append(F.struct(F.lit(i).alias("interval"), place.cast("int").alias("bucket"), v.alias("v")))
    counted = (df.select(F.inline(F.array(*cells))).filter("bucket IS NOT NULL").groupBy("interval", "bucket")
               .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    rows: dict[Interval, list] = {interval: [] for interval in intervals}
    for r in counted.orderBy("interval", "bucket").collect():
        rows[intervals[r["interval"]]].append(r)
    for t in targets:
        before = 0
        for r in rows[t.interval]:
            if t.rank < before + r["n"]:
                t.enter(Interval(t.interval.column, r["low"], r["high"]), before, r["n"])
                break
            before += r["n"]


def _narrow_by_sketch(df: DataFrame, targets: list[_Target]) -> None:
    margin = 2.0 / SKETCH_ACCURACY
    guesses = []
    for i, t in enumerate(targets):
        share = (t.rank + 0.5) / t.size
        around = [max(0.0, share - margin), min(1.0, share + margin)]
        guesses.append(F.percentile_approx(t.interval.inside(), around, SKETCH_ACCURACY).alias(f"g{i}"))
    row = df.agg(*guesses).first()
    splitters = [tuple(row[f"g{i}"]) for i in range(len(targets))]
    counts = []
    for i, (t, (a, b)) in enumerate(zip(targets, splitters)):
        v = t.interval.inside()
        for j, cond in enumerate((v < F.lit(a), v <= F.lit(a), v < F.lit(b), v <= F.lit(b))):
            counts.append(F.count_if(cond).alias(f"c{i}_{j}"))
    row = df.agg(*counts).first()
    for i, (t, (a, b)) in enumerate(zip(targets, splitters)):
        below_a, upto_a, below_b, upto_b = (row[f"c{i}_{j}"] for j in range(4))
        now = t.interval
        if t.rank < below_a:
            t.enter(Interval(now.column, now.low, a, now.open_low, True), 0, below_a)
        elif t.rank < upto_a:
            t.value = a
        elif t.rank < below_b:
            t.enter(Interval(now.column, a, b, True, True), upto_a, below_b - upto_a)
        elif t.rank < upto_b:
            t.value = b
        else:
            t.enter(Interval(now.column, b, now.high, True, now.open_high), upto_b, t.size - upto_b)


def _look_up(df: DataFrame, targets: list[_Target]) -> None:
    """Sort the few values left in each interval and read off the wanted ranks."""
    intervals = list(dict.fromkeys(t.interval for t in targets))
    ordered = df.agg(*[F.sort_array(F.collect_list(interval.inside())).alias(f"v{i}")
                       for i, interval in enumerate(intervals)])
    picks = [F.get(F.col(f"v{intervals.index(t.interval)}"), F.lit(t.rank)).alias(f"t{i}") for i, t in enumerate(targets)]
    row = ordered.select(*picks).first()
    for i, t in enumerate(targets):
        t.value = row[f"t{i}"]
