"""Correlations of many columns from blocks of products, merged in a tree.

Each task multiplies its rows as matrices and keeps, per tile of columns by columns, six sums over the rows in which both columns have a value: the number, both sums,
both squares and the product. Values are taken relative to a pivot per column, so a large common offset costs no digits. Tiles of all tasks are added in two steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgauge.plans.stats import col

TILE = 64
_SUMS = 6


def _finite(name: str) -> Column:
    c = col(name).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def _tiles(n: int) -> list[tuple[int, int]]:
    count = -(-n // TILE)
    return [(i, j) for i in range(count) for j in range(i, count)]


def pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, sums): per tile of columns the sums of all rows, as doubles of shape (6, columns of i, columns of j)."""
    # near the values is near enough: a pivot is the mean of the first rows
    head = df.select(*[_finite(c).alias(f"c{n}") for n, c in enumerate(columns)]).limit(1000)
    first = head.agg(*[F.avg(f"c{n}").alias(f"c{n}") for n in range(len(columns))]).first()
    pivot = np.array([x or 0.0 for x in first])
    tiles = _tiles(len(columns))
    schema = "i int, j int, part int, sums binary"

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        seen = 0
        for batch in batches:
            seen += batch.num_rows
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64) - pivot
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(np.float64)
            for i, j in tiles:
                a, b = slice(i * TILE, (i + 1) * TILE), slice(j * TILE, (j + 1) * TILE)
                sums = np.stack([m[:, a].T @ m[:, b], x[:, a].T @ m[:, b], m[:, a].T @ x[:, b], (x[:, a] ** 2).T @ m[:, b], m[:, a].T @ (x[:, b] ** 2), x[:, a].T @ x[:, b]])
                total[i, j] = total.get((i, j), 0.0) + sums
        rows = [(i, j, seen % 32, s.tobytes()) for (i, j), s in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["i", "j", "part", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
        return pa.table([table.column("i").slice(0, 1), table.column("j").slice(0, 1), table.column("part").slice(0, 1), pa.array([total.tobytes()])], names=["i", "j", "part", "sums"])

    values = F.array(*[F.coalesce(_finite(c), F.lit(float("nan"))) for c in columns])
    parts = df.select(values.alias("x")).mapInArrow(run, schema)
    return parts.groupBy("i", "j", "part").applyInArrow(added, schema).groupBy("i", "j").applyInArrow(added, schema).select("i", "j", "sums")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for every ordered pair of columns, over the rows in which both have a finite value; null without variation."""
    names = list(columns)

    def told(batches):
        for batch in batches:
            for i, j, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = names[i * TILE:(i + 1) * TILE], names[j * TILE:(j + 1) * TILE]
                n, sx, sy, xx, yy, xy = np.frombuffer(blob).reshape(_SUMS, len(a), len(b))
                with np.errstate(all="ignore"):
                    vx, vy = xx - sx * sx / n, yy - sy * sy / n
                    # what is left of the squares by rounding alone is no variation
                    flat = (vx <= 1e-13 * xx) | (vy <= 1e-13 * yy)
                    r = np.where(flat, np.nan, np.clip((xy - sx * sy / n) / np.sqrt(vx * vy), -1.0, 1.0))
                rows = [(p, q, 1.0 if p == q else r[k, m]) for k, p in enumerate(a) for m, q in enumerate(b)]
                if i != j:
                    rows += [(q, p, v) for p, q, v in rows]
                xs, ys, vs = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(xs), pa.array(ys), pa.array(np.array(vs), from_pandas=True)], names=["x", "y", "r"])
    return pair_sums(df, columns).mapInArrow(told, "x string, y string, r double")
