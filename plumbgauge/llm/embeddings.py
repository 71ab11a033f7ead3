"""Near-duplicate embeddings by random-hyperplane sign hashing.

Equal vectors of a label are one vector with a count. A vector has one code per table: the signs of its products with
that table's hyperplanes. Vectors with the same label and code in a table form a bucket. Buckets with
more than a tile of vectors are cut into tiles, by hash, and every pair of tiles is one unit of work of bounded size. A unit
computes the exact cosines of its pairs, and counts a pair only in the first table where the two codes agree. It returns the number
of links of each vector and a spanning forest of its links, so a group of n alike vectors gives about n rows, not n squared.

The number of tables follows from the number of hyperplanes, so that a pair at the threshold
is missed with a probability of at most ``miss``; the hyperplanes grow with the logarithm of the number of vectors.

Defined results: vectors without label, null, empty, zero or with null or non-finite components link with nothing, as do vectors
of different length; repeated rows count as other vectors; vec_id null is the name of a group only if no
other is there; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.llm.common import components, cut, ship

TILE = 512


def tables_for(planes: int, threshold: float, miss: float) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** planes
    return math.ceil(math.log(miss) / math.log(1 - agree))


def _planes(dimension: int, tables: int, planes: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, tables * planes))


def _codes(vectors: np.ndarray, tables: int, planes: int, seed: int) -> np.ndarray:
    signs = vectors @ _planes(vectors.shape[1], tables, planes, seed) > 0
    return (signs.reshape(len(vectors), tables, planes) * (1 << np.arange(planes, dtype=np.int64))).sum(axis=2)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, each times the power of two that brings its largest component near one: exact, and no square of it leaves the range of doubles."""
    if not len(column):
        return np.zeros((0, 1))
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def unit_links(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, counts: np.ndarray, tile: np.ndarray | None, table: int,
               threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links found in one unit: per vector the number of linked vectors, copies counted, and a spanning forest of the links."""
    norms = np.linalg.norm(vectors, axis=1)
    near = vectors @ vectors.T >= threshold * norms[:, None] * norms[None, :] - 1e-9
    np.fill_diagonal(near, False)
    if tile is not None:  # pairs within a tile belong to that tile's own unit
        near &= tile[:, None] != tile[None, :]
    a, b = np.nonzero(np.triu(near))
    if len(a):
        cosine = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b])
        keep = cosine >= threshold
        if table:
            keep &= ~(codes[a, :table] == codes[b, :table]).any(axis=1)
        a, b = a[keep], b[keep]
    linked = np.zeros(len(ids), dtype=np.int64)
    np.add.at(linked, a, counts[b])
    np.add.at(linked, b, counts[a])
    root, forest = np.arange(len(ids)), []
    while len(a):  # join roots until every link lies within one tree
        top = np.maximum(root[a], root[b])
        least = np.minimum(root[a], root[b])
        apart = top != least
        a, b, top, least = a[apart], b[apart], top[apart], least[apart]
        if not len(a):
            break
        order = np.lexsort((least, top))
        first = order[np.concatenate(([True], top[order][1:] != top[order][:-1]))]
        forest += list(zip(ids[a[first]].tolist(), ids[b[first]].tolist()))
        root[top[first]] = least[first]
        while (root != root[root]).any():
            root = root[root]
        root = root[root]
    return linked, forest


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-4, seed: int = 7, id_col: str = "vec_id",
                    vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable by links) and kept."""
    spark = vectors.sparkSession
    ship(spark)
    value = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), value.alias("v"))
    fine = (F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
            & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # the name of a vector is a hash of it, so that rows, even with the same id, find theirs again
    rows = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("label", "v")))
    sized = cut(rows.where("fine").groupBy("node", "label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first")))
    n = sized.count()
    planes = min(24, max(12, math.ceil(math.log2(max(n, 2)))))
    tables = tables_for(planes, threshold, miss)

    def hashed(batches):
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            codes = np.zeros((len(lengths), tables), dtype=np.int64)
            for length in np.unique(lengths).tolist():
                at = np.nonzero(lengths == length)[0]
                codes[at] = _codes(_matrix(batch.column(1).take(pa.array(at))), tables, planes, seed)
            offsets = np.arange(len(lengths) + 1, dtype=np.int32) * tables
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))], names=["node", "codes"])

    coded = cut(sized.select("node", "v").mapInArrow(hashed, "node long, codes array<long>")
                .join(sized.select("node", "label", "copies", F.size("v").alias("length")), "node"))
    places = coded.select("node", F.xxhash64("label", "length").alias("field"), F.posexplode("codes").alias("table", "code"))
    bucket = ["field", "table", "code"]
    full = places.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn(
        "tiles", F.ceil(F.col("n") / TILE).cast("int"))
    inside = places.join(full, bucket).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    units = inside.withColumn("other", other).select(
        "node", "tile", *bucket, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    data = sized.select("node", "v", "copies").join(coded.select("node", "codes"), "node")
    work = units.join(data, "node")
    key = [*bucket, "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def linked(batches):
        held: list[pa.RecordBatch] = []
        now = None

        def finish():
            unit = pa.Table.from_batches(held).combine_chunks()
            ids = unit.column("node").to_numpy()
            if len(ids) < 2:
                return [], [], []
            counts = unit.column("copies").to_numpy()
            got, forest = unit_links(ids, _matrix(unit.column("v").combine_chunks()), np.stack(unit.column("codes").to_numpy()),
                                     counts, unit.column("tile").to_numpy() if now[-2] != now[-1] else None, int(unit.column("table")[0].as_py()), threshold)
            hit = np.nonzero(got)[0]
            nodes = ids[hit].tolist() + [a for a, _ in forest]
            return nodes, got[hit].tolist() + [0] * len(forest), [None] * len(hit) + [b for _, b in forest]

        out: tuple[list, list, list] = ([], [], [])

        def taken():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "links", "b"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in key]
            change = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            starts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:]):
                if s == e:
                    continue
                mine = tuple(k[s] for k in keys)
                if now is not None and mine != now:
                    for c, more in zip(out, finish()):
                        c.extend(more)
                    held.clear()
                now = mine
                held.append(batch.slice(s, e - s))
            if len(out[0]) > 20_000:
                yield taken()
        if held:
            for c, more in zip(out, finish()):
                c.extend(more)
        yield taken()

    found = cut(work.select(*key, "tile", "node", "v", "copies", "codes").repartition(parts, *key).sortWithinPartitions(*key)
                .mapInArrow(linked, "a long, links long, b long"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    group = components(found.where("b is not null").select("a", "b"))
    told = sized.select("node", "copies", "first").join(links, "node", "left").join(group, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first",
        F.coalesce("component", "node").alias("component"))
    told = cut(told)
    named = told.groupBy("component").agg(F.min("first").alias("component_id"))
    told = told.join(named, "component").select("node", "n_links", "component_id")
    return rows.select("vec_id", "node").join(told, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
