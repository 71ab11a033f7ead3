"""Exact quantiles, ranks, segmented windows: against plain computations on small frames."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbgauge.plans.quantiles import exact_quantiles
from plumbgauge.plans.ranking import global_rank, rank_within
from plumbgauge.plans.segments import asof_join, neighbours
from plumbgauge.plans.stats import column_stats, few_distinct, local_rows

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame({
        "uniform": rng.random(n),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n)),
        "heavy": np.exp(rng.normal(size=n) * 40),
        "outlier": np.r_[rng.random(n - 1), 1e300],
        "few": rng.integers(0, 5, n).astype(float),
        "constant": np.full(n, 3.5),
    })
    pdf.loc[::9, "uniform"] = np.nan
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("sort_limit", [20, 500, 1_000_000])
def test_exact_quantiles_match_pandas(numbers, sort_limit):
    pdf, df = numbers
    found = exact_quantiles(df, list(pdf.columns), PROBABILITIES, sort_limit=sort_limit)
    for c in pdf.columns:
        assert np.allclose(found[c], pdf[c].quantile(PROBABILITIES), rtol=1e-13, atol=0), c


def test_quantiles_of_few_or_no_values(spark):
    df = local_rows(spark, "a double, b double, c bigint", [(1.0, None, 1), (2.0, None, 2), (3.0, None, 3), (10.0, None, None)])
    found = exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5])
    assert found == {"a": [1.75, 2.5], "b": [None, None], "c": [1.5, 2.0]}


def test_infinite_values_do_not_stall(spark):
    df = local_rows(spark, "a double", [(float("-inf"),)] + [(float(i),) for i in range(99)])
    assert exact_quantiles(df, ["a"], [0.5], sort_limit=5)["a"] == [48.5]


def test_global_rank_is_the_sorted_position(spark):
    df = spark.range(5000).select(F.col("id"), (F.xxhash64("id") % 7).alias("v"))
    rows = global_rank(df.repartition(6), [F.desc("v"), F.asc("id")]).collect()
    expected = sorted(((r["v"], r["id"]) for r in df.collect()), key=lambda p: (-p[0], p[1]))
    assert {(r["v"], r["id"]): r["rank"] for r in rows} == {p: i + 1 for i, p in enumerate(expected)}


def test_rank_within_a_dominant_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5).alias("g"), "id")
    rows = rank_within(df, ["g"], [F.asc("id")]).collect()
    by_group: dict = {}
    for r in rows:
        by_group.setdefault(r["g"], []).append((r["id"], r["rank"]))
    for members in by_group.values():
        assert [k for _, k in sorted(members)] == list(range(1, len(members) + 1))


@pytest.mark.parametrize("segment_size", [1, 3, 1000])
def test_neighbours_cross_segment_borders(spark, segment_size):
    rows = [(g, t, f"{g}-{t}") for g in (1, 2) for t in (0, 1, 2, 5, 9, 10, 11, 40)]
    df = local_rows(spark, "g int, t bigint, v string", rows)
    found = {(r["g"], r["t"]): (r["prev_v"], r["next_v"]) for r in neighbours(df, "g", "t", ["v"], segment_size=segment_size).collect()}
    times = [t for g, t, _ in rows if g == 1]
    for g in (1, 2):
        for i, t in enumerate(times):
            before = f"{g}-{times[i - 1]}" if i else None
            after = f"{g}-{times[i + 1]}" if i + 1 < len(times) else None
            assert found[g, t] == (before, after)


def test_asof_join_brute_force(spark):
    rng = np.random.default_rng(3)
    start = datetime.datetime(2024, 1, 1)

    def frame(n, name):
        rows = [(int(k), start + datetime.timedelta(minutes=int(m)), i)
                for i, (k, m) in enumerate(zip(rng.choice([1, 1, 1, 2, 3], n), rng.integers(0, 3000, n)))]
        pdf = pd.DataFrame(rows, columns=["k", name, f"{name}_id"])
        return rows, spark.createDataFrame(pdf)

    left_rows, left = frame(200, "lt")
    right_rows, right = frame(60, "rt")
    found = {r["lt_id"]: (r["asof_rt"], r["asof_rt_id"]) for r in asof_join(left, right, "k", "lt", "rt", ["rt_id"]).collect()}
    assert len(found) == 200
    for k, t, i in left_rows:
        options = [(rt, rid) for rk, rt, rid in right_rows if rk == k and rt <= t]
        assert found[i] == (max(options) if options else (None, None))


@pytest.mark.parametrize("segment_size", [7, 65_536])
def test_asof_join_with_one_busy_hour(spark, segment_size):
    """Nine tenths of the rows are one key within one hour; segments cut it by rows."""
    start = datetime.datetime(2024, 1, 1)
    rng = np.random.default_rng(9)
    times = [start + datetime.timedelta(seconds=int(s)) for s in rng.integers(0, 3600, 360)] + [start + datetime.timedelta(hours=int(h)) for h in rng.integers(2, 90, 40)]
    left = spark.createDataFrame([(1, t, i) for i, t in enumerate(times[::2])], "k int, lt timestamp, lt_id int")
    right_rows = [(1, t, i) for i, t in enumerate(times[1::2])]
    right = spark.createDataFrame(right_rows, "k int, rt timestamp, rt_id int")
    found = {r["lt_id"]: r["asof_rt_id"] for r in asof_join(left, right, "k", "lt", "rt", ["rt_id"], segment_size=segment_size).collect()}
    for i, t in enumerate(times[::2]):
        options = [(rt, rid) for _, rt, rid in right_rows if rt <= t]
        assert found[i] == (max(options)[1] if options else None)


def test_segments_hold_a_bounded_number_of_rows_however_sparse(spark):
    from plumbgauge.plans.segments import _segments
    df = spark.range(1000).select(F.lit(1).alias("g"), (F.col("id") * 100_000).alias("t"))
    sizes = [r["count"] for r in _segments(df, ["g", "t"], 64).groupBy("_seg").count().collect()]
    assert max(sizes) <= 64 and len(sizes) <= 17


def test_few_distinct_stops_at_the_bound(spark):
    df = spark.range(1000).select((F.col("id") % 4).alias("a"), F.col("id").alias("b"), (F.col("id") % 30).alias("c"))
    assert few_distinct(df, ["a", "b", "c"], 10) == {"a": 4, "b": 10, "c": 10}


def test_text_is_counted_by_fingerprint_exactly(spark):
    df = local_rows(spark, "a string, b string", [("x", None), ("X", None), ("x", ""), (None, "")])
    found = {r["column_name"]: (r["null_count"], r["distinct_count"]) for r in column_stats(df).collect()}
    assert found == {"a": (1, 2), "b": (2, 1)}
