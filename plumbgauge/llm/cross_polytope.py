"""Nearest vectors by inner product with cross-polytope hashing.

A table turns unit vectors by fast pseudo-rotations, three rounds of random signs and a Hadamard transform, and assigns each to the nearest signed axis; a bucket is the combination of
one or more such axes, the last of them among the first few coordinates only, so that the number of buckets follows the number of vectors. A query looks into the buckets of each table whose axes it is nearest to, in order of
what they lack against its nearest (multiprobe). What a bucket holds is scored exactly, in double precision, where it lies; only the best of each task are shuffled on.

How many buckets a query looks into is measured: for at most ``SAMPLE`` query vectors the nearest are found in all rows, and the least number of probes
that would have shown ``recall`` of them is taken; if ``MOST_PROBES`` do not suffice, buckets are made coarser. A query that found fewer than k looks
into all buckets of one table, which is every row.

Vectors of different norm lie in buckets of their own band of norms, and queries look into all bands. Of equal vectors only the k + 1 with the
smallest ids can be among the k nearest, so others are no candidates; equal queries are searched once. A bucket of many vectors is cut into tiles.

Defined results: null, empty and zero vectors, those with null or non-finite components, and rows without id take no part; vectors of different length are not compared;
repeated rows count once; ties go to the smaller id; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgauge.llm.common import cut, ship

TILE = 4096
SAMPLE = 128
MOST_PROBES = 2048
#: Vectors a bucket should hold, and the ratio of the largest to the smallest norm of a band.
OCCUPANCY, BAND = 512, 1.25
_HELD = 400_000


class Tables:
    """The pseudo-rotations of ``tables`` tables of 2 ** ``bits`` buckets, for vectors of any length."""

    def __init__(self, bits: int, tables: int, seed: int):
        self.bits, self.tables, self.seed = bits, tables, seed
        self._signs: dict[int, np.ndarray] = {}

    def parts(self, width: int) -> list[int]:
        """Bits of each cross-polytope of a bucket: one for the sign, the others for the axis."""
        most, left, out = width.bit_length(), self.bits, []
        while left:
            out.append(min(most, left))
            left -= out[-1]
        return out

    def turned(self, vectors: np.ndarray, table: int) -> list[np.ndarray]:
        """Coordinates in which each part's nearest signed axis is sought."""
        unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        width = 1 << max(1, (vectors.shape[1] - 1).bit_length())
        parts = self.parts(width)
        if width not in self._signs:
            self._signs[width] = np.random.default_rng([self.seed, width]).choice([-1.0, 1.0], (self.tables, len(parts), 3, width))
        out = []
        for i, bits in enumerate(parts):
            x = np.zeros((len(unit), width))
            x[:, :unit.shape[1]] = unit
            for signs in self._signs[width][table, i]:
                x = hadamard(x * signs)
            out.append(x[:, :1 << (bits - 1)])
        return out

    def codes(self, vectors: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(vectors), dtype=np.int64)
        for x in self.turned(vectors, table):
            axis = np.abs(x).argmax(axis=1)
            code = code * 2 * x.shape[1] + 2 * axis + (x[np.arange(len(x)), axis] < 0)
        return code

    def probes(self, queries: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` nearest buckets of each query, nearest first; all of them if there are no more."""
        codes, lack = np.zeros((len(queries), 1), dtype=np.int64), np.zeros((len(queries), 1))
        for x in self.turned(queries, table):
            values = np.stack([x, -x], axis=2).reshape(len(x), -1)
            short = (values.max(axis=1, keepdims=True) - values) ** 2
            lack = (lack[:, :, None] + short[:, None, :]).reshape(len(x), -1)
            codes = (codes[:, :, None] * values.shape[1] + np.arange(values.shape[1])).reshape(len(x), -1)
            order = np.argsort(lack, axis=1, kind="stable")[:, :most]
            codes, lack = np.take_along_axis(codes, order, 1), np.take_along_axis(lack, order, 1)
        return codes


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, which keeps their lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as double precision rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_length(column: pa.Array):
    """(places, rows) of the vectors of each length."""
    lengths = np.diff(column.offsets.to_numpy())
    for length in np.unique(lengths).tolist():
        at = np.nonzero(lengths == length)[0]
        yield at, matrix(column.take(pa.array(at)))


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows with a row or rows, each by the same sums whatever stands beside it."""
    got = (vectors * query).sum(axis=1)
    return np.where(np.isnan(got), -np.inf, got)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, and of a few more, so that a last digit decides nothing."""
    k = min(k + 4, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.broadcast_to(np.arange(k), (len(scores), k))


def fine(column: Column) -> Column:
    """A vector that can be compared: components that are all finite, not all zero."""
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
                      & F.exists(column, lambda x: x != 0), F.lit(False))


def first_of_equal(rows: DataFrame, keys: list[str], id_col: str, most: int) -> DataFrame:
    """Of rows equal in ``keys`` those with the ``most`` smallest ids; repeated rows once. Tasks keep no more of a group before it is shuffled."""
    once = rows.select(id_col, *keys).distinct()
    return once.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(id_col))).where(F.col("_nth") <= most).drop("_nth")


def _calibrated(vectors: DataFrame, queries: DataFrame, tables: Tables, k: int, recall: float) -> int | None:
    """Number of probes that shows ``recall`` of the k nearest of a sample of the queries; None if MOST_PROBES do not."""
    sample = queries.orderBy(F.xxhash64("h1", F.lit(17))).limit(SAMPLE).collect()  # SAMPLE vectors at most
    asked: dict[int, list[tuple[int, list]]] = {}
    for i, row in enumerate(sample):
        asked.setdefault(len(row["v"]), []).append((i, row["v"]))
    matrices = {length: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)) for length, rows in asked.items()}
    looks = {length: [tables.probes(m, t, MOST_PROBES) for t in range(tables.tables)] for length, (_, m) in matrices.items()}

    def run(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            for at, x in by_length(batch.column(0)):
                if x.shape[1] not in matrices:
                    continue
                mine, m = matrices[x.shape[1]]
                scores = m @ x.T
                top = best(scores, k)
                needed, back = np.unique(top, return_inverse=True)
                place = np.full(top.shape, MOST_PROBES)
                for t, probes in enumerate(looks[x.shape[1]]):
                    codes = tables.codes(x[needed], t)[back.reshape(top.shape)]
                    for q in range(len(mine)):
                        same = probes[q][None, :] == codes[q][:, None]
                        place[q] = np.minimum(place[q], np.where(same.any(axis=1), same.argmax(axis=1), MOST_PROBES))
                for q, i in enumerate(mine.tolist()):
                    kept[i] = sorted([*kept.get(i, []), *zip(scores[q, top[q]].tolist(), place[q].tolist())], reverse=True)[:k + 1]
        rows = [(i, s, p) for i, found in kept.items() for s, p in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [(), (), ()], (pa.int64(), pa.float64(), pa.int64()))], names=["q", "s", "place"])

    near = Window.partitionBy("q").orderBy(F.desc("s"), "place")
    # the nearest of a query is mostly itself, which is in its first bucket
    found = vectors.select("v").mapInArrow(run, "q long, s double, place long").withColumn("_nth", F.row_number().over(near)).where(f"_nth > 1 and _nth <= {k + 1}")
    places = np.array([r["place"] for r in found.select("place").collect()])  # k rows of SAMPLE vectors at most
    for probes in range(1, MOST_PROBES + 1):
        if not len(places) or (places < probes).mean() >= recall:
            return probes
    return None


def _searched(vectors: DataFrame, queries: DataFrame, tables: Tables, used: int, probes: int, k: int) -> DataFrame:
    """(h1, h2, vec_id, score): at least the k best of what each query meets in the first ``used`` tables."""
    kind = vectors.schema["v"].dataType.simpleString()
    shape = "field int, band int, place int, code long"

    def assigned(batches):
        for batch in batches:
            for at, x in by_length(batch.column(1)):
                scale = np.abs(x).max(axis=1)
                norm = np.log(scale) + np.log(np.linalg.norm(x / scale[:, None], axis=1))
                band = np.floor(norm / math.log(BAND) + 0.5).astype(np.int32)
                rows = batch.take(pa.array(at))
                for t in range(used):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x.shape[1], dtype=np.int32)), pa.array(band), pa.array(np.full(len(at), t, dtype=np.int32)),
                                                      pa.array(tables.codes(x, t)), rows.column(0), rows.column(1)], names=["field", "band", "place", "code", "vec_id", "v"])

    def looked(batches):
        for batch in batches:
            for at, x in by_length(batch.column(2)):
                for s in range(0, len(at), 64):
                    rows, part = batch.take(pa.array(at[s:s + 64])), x[s:s + 64]
                    for t in range(used):
                        codes = tables.probes(part, t, probes)
                        times = pa.array(np.repeat(np.arange(len(part)), codes.shape[1]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(codes.size, x.shape[1], dtype=np.int32)), pa.array(np.full(codes.size, t, dtype=np.int32)),
                                                          pa.array(codes.ravel()), *(c.take(times) for c in rows.columns)], names=["field", "place", "code", "h1", "h2", "v"])

    bucket = ["field", "band", "place", "code"]
    held = vectors.select("vec_id", "v").mapInArrow(assigned, f"{shape}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v {kind}")
    asked = queries.select("h1", "h2", "v").mapInArrow(looked, f"field int, place int, code long, h1 long, h2 long, v {kind}")
    sizes = held.groupBy(*bucket).agg(F.count("*").alias("_n"))
    # what is in no bucket need not be asked for; only buckets over a tile are cut
    buckets = cut(sizes.withColumn("tiles", F.ceil(F.col("_n") / TILE).cast("int")).drop("_n"))
    large = buckets.where("tiles > 1")
    held = held.join(large, bucket, "left").withColumn("tile", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.coalesce("tiles", F.lit(1))).cast("int"))
    asked = asked.join(buckets, ["field", "place", "code"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    unit = [*bucket, "tile"]
    both = held.select(*unit, F.lit(0).alias("kind"), F.col("vec_id").cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "v").unionByName(
        asked.select(*unit, F.lit(1).alias("kind"), "h1", "h2", "v"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scored(batches):
        now, ids, rows = None, [], []
        stacked: np.ndarray | None = None
        out: list[list[np.ndarray]] = [[], [], [], []]
        size = 0

        def pruned():
            h1, h2, vec, score = (np.concatenate(c) if c else np.zeros(0) for c in out)
            order = np.lexsort((vec, -score, h2, h1))
            h1, h2, vec, score = h1[order], h2[order], vec[order], score[order]
            new = np.ones(len(h1), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            again = ~new
            again[1:] &= (vec[1:] == vec[:-1]) & (score[1:] == score[:-1])
            h1, h2, vec, score, new = (c[~again] for c in (h1, h2, vec, score, new))
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, dtype=np.int64)
            keep = np.arange(len(new)) - start < k + 4
            return [[c[keep]] for c in (h1, h2, vec, score)]

        def batch_of(columns):
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(columns, types)], names=["h1", "h2", "vec_id", "score"])

        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(6)]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in keys:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:]):
                if s == e:
                    continue
                mine, asks = tuple(int(c[s]) for c in keys[:5]), int(keys[5][s])
                if mine != now:
                    now, ids, rows, stacked = mine, [], [], None
                part = batch.slice(s, e - s)
                if not asks:
                    ids.append(part.column(6).to_numpy())
                    rows.append(matrix(part.column(8)))
                    continue
                if not ids:
                    continue
                if stacked is None:
                    stacked, ids = np.concatenate(rows), [np.concatenate(ids)]
                    rows = []
                queries, names, others = matrix(part.column(8)), part.column(6).to_numpy(), part.column(7).to_numpy()
                for at in range(0, len(queries), 256):
                    q = queries[at:at + 256]
                    with np.errstate(over="ignore", invalid="ignore"):
                        rough = q @ stacked.T
                        top = best(np.where(np.isnan(rough), -np.inf, rough), k)
                        exact = products(stacked[top.ravel()], np.repeat(q, top.shape[1], axis=0))
                    for c, more in zip(out, (np.repeat(names[at:at + 256], top.shape[1]), np.repeat(others[at:at + 256], top.shape[1]), ids[0][top.ravel()], exact)):
                        c.append(more)
                    size += top.size
                    if size > _HELD:
                        out = pruned()
                        size = len(out[0][0])
                        if size > _HELD // 2:
                            yield batch_of(out)
                            out, size = [[], [], [], []], 0
        yield batch_of(pruned())

    return both.select(*unit, "kind", "h1", "h2", "v").repartition(parts, *unit).sortWithinPartitions(*unit, "kind").mapInArrow(
        scored, "h1 long, h2 long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97, tables: int = 6, seed: int = 11,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row for which ``is_query`` holds (over ``vec_id``), by largest inner product."""
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & fine(F.col("v"))).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)).alias("v"))
    stored = cut(first_of_equal(rows, ["v"], "vec_id", k + 4))
    named = rows.where(is_query).select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    queries = cut(named.groupBy("h1", "h2").agg(F.first("v").alias("v")))
    bits = max(3, round(math.log2(max(stored.count(), 1) / OCCUPANCY)))
    while True:
        hashing = Tables(bits, tables, seed)
        probes = _calibrated(stored, queries, hashing, k, recall)
        if probes or bits <= 3:
            break
        bits = max(3, bits - 2)
    top = Window.partitionBy("query_id", "h1", "h2").orderBy(F.desc("score"), "vec_id")

    def told(asked: DataFrame, found: DataFrame) -> DataFrame:
        met = found.distinct().withColumn("_nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))).where(F.col("_nth") <= k + 4)
        pairs = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(met, ["h1", "h2"]).where("query_id <> vec_id")
        return pairs.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "h1", "h2", "rank", "vec_id", "score")

    first = cut(told(named, _searched(stored, queries, hashing, tables, probes or MOST_PROBES, k)))
    enough = first.where(F.col("rank") == k).select("h1", "h2").distinct()
    short = cut(queries.join(enough, ["h1", "h2"], "left_anti"))
    whole = first.where("false") if short.isEmpty() else told(
        named.join(short.select("h1", "h2"), ["h1", "h2"]), _searched(stored, short, Tables(3, 1, seed), 1, 8, k))
    done = first.join(short.select("h1", "h2"), ["h1", "h2"], "left_anti").unionByName(whole)
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
