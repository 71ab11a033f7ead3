"""Nearest vectors through an inverted file: lists around centroids, opened only as far as a distance bound asks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbgauge.operators.retrieval import closest_rows, stacked
from plumbgauge.operators.kpi import top_per_group
from plumbgauge.plans.stats import col, fields
from plumbgauge.session import materialise

#: Rows the centroids are fitted on, lists, rows of a block and queries of a unit, all at most.
SAMPLE, LISTS, BLOCK, CHUNK = 20_000, 1024, 1024, 512


@dataclass
class InvertedFile:
    """Every row of a corpus in the list of its nearest centroid, in blocks by distance from it.

    ``blocks`` has (block, list, near, far, ids, vectors): the least and greatest distance of a block's rows from the centroid. ``centroids``, ``near`` and ``far``
    are small arrays, one entry a list.
    """

    blocks: DataFrame
    centroids: np.ndarray
    near: np.ndarray
    far: np.ndarray
    sizes: np.ndarray
    corpus_id: str

    @classmethod
    def build(cls, corpus: DataFrame, corpus_id: str, corpus_vector: str, lists: int | None = None, seed: int = 1) -> InvertedFile:
        """Centroids come from a sample of at most SAMPLE rows, chosen by a hash of the id; every row is assigned. Vectors are all of one length."""
        rows = corpus.select(col(corpus_id).alias("id"), col(corpus_vector).cast("array<double>").alias("v"))
        n = rows.count()
        wanted = lists or max(1, min(LISTS, round(n ** 0.5)))
        every = max(1, -(-n // SAMPLE))
        sample = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(every)) == 0).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE)
        if n and sample.isEmpty():
            sample = rows.limit(SAMPLE)
        model = KMeans(k=max(2, wanted), seed=seed, maxIter=8, featuresCol="f").fit(materialise(sample.select(array_to_vector("v").alias("f")), "sample")) if n else None
        centroids = np.array(model.clusterCenters()) if model else np.zeros((1, 1))

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    at = ((centroids ** 2).sum(axis=1)[None, :] - 2 * vectors @ centroids.T).argmin(axis=1)
                    apart = np.sqrt(((vectors - centroids[at]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(apart)], names=["id", "v", "list", "apart"])

        schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("apart", T.DoubleType())])
        names = ["block", "list", "near", "far", "ids", "vectors"]

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def finish():
                part = pa.Table.from_batches(held).combine_chunks()
                apart, ids, vectors = part.column("apart").to_numpy(), part.column("id").combine_chunks(), part.column("v").combine_chunks()
                name = f"{part.column('list')[0].as_py()}:{apart[0]!r}:{ids[0].as_py()}"
                whole = pa.array([0, len(ids)], pa.int32())
                return pa.RecordBatch.from_arrays([pa.array([name]), part.column("list").combine_chunks().slice(0, 1), pa.array([apart[0]]), pa.array([apart[-1]]),
                                                   pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, vectors)], names=names)
            for batch in batches:
                lists_ = batch.column(2).to_numpy()
                starts = [0, *(np.nonzero(lists_[1:] != lists_[:-1])[0] + 1).tolist(), batch.num_rows]
                for s, e in zip(starts, starts[1:]):
                    while s < e:
                        size = sum(b.num_rows for b in held)
                        if held and (size == BLOCK or held[-1].column(2)[0] != batch.column(2)[s]):
                            yield finish()
                            held, size = [], 0
                        step = min(e - s, BLOCK - size)
                        held.append(batch.slice(s, step))
                        s += step
            if held:
                yield finish()

        kept = T.StructType([T.StructField("block", T.StringType()), T.StructField("list", T.IntegerType()), T.StructField("near", T.DoubleType()), T.StructField("far", T.DoubleType()),
                             T.StructField("ids", T.ArrayType(fields(rows)["id"])), T.StructField("vectors", T.ArrayType(T.ArrayType(T.DoubleType())))])
        order = ["list", "apart", "id"]
        # ranges of (list, distance, id): a list of any size is dealt to as many tasks as it needs
        blocks = materialise(rows.mapInArrow(assigned, schema).repartitionByRange(max(1, -(-n // (16 * BLOCK))), *order).sortWithinPartitions(*order).mapInArrow(packed, kept), "lists")
        near, far, sizes = np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf), np.zeros(len(centroids), dtype=np.int64)
        for r in blocks.groupBy("list").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.sum(F.size("ids")).alias("n")).collect():  # LISTS rows at most
            near[r["list"]], far[r["list"]], sizes[r["list"]] = r["near"], r["far"], r["n"]
        return cls(blocks, centroids, near, far, sizes, corpus_id)

    def search(self, queries: DataFrame, query_id: str, query_vector: str, k: int = 3, probes: int = 4) -> DataFrame:
        """The ``k`` nearest rows of each query with rank and squared distance; exact, the id settles ties.

        First the ``probes`` nearest lists are searched, or as many as hold ``k`` rows. What is found there bounds the distance of the k-th; in the second round
        every list, and of each list every block, that may hold something nearer is searched. On data in groups these are few.
        """
        asked = materialise(queries.select(col(query_id).alias("q"), col(query_vector).cast("array<double>").alias("v")), "asked")
        chunks = max(1, -(-asked.count() // CHUNK))
        first = materialise(self._hits(self._lists(asked.withColumn("kth", F.lit(None).cast("double")), k, probes), asked, chunks, k), "first")
        kth = first.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("kth"))
        second = self._hits(self._lists(asked.join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf")))), k, probes), asked, chunks, k)
        both = first.select("q", "id", "distance").unionAll(second.select("q", "id", "distance"))
        best = top_per_group(both, ["q"], [F.asc("distance"), F.asc("id")], k)
        return best.withColumnsRenamed({"q": query_id, "id": self.corpus_id})

    def _lists(self, asked: DataFrame, k: int, probes: int) -> DataFrame:
        """(q, list, apart, kth): the first lists of a query without a bound, the others that may hold something nearer of one with a bound."""
        centroids, near, far, sizes = self.centroids, self.near, self.far, self.sizes
        schema = T.StructType([asked.schema["q"], T.StructField("list", T.IntegerType()), T.StructField("apart", T.DoubleType()), T.StructField("kth", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                kth = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                apart = np.sqrt(np.maximum((vectors ** 2).sum(axis=1)[:, None] + (centroids ** 2).sum(axis=1)[None, :] - 2 * vectors @ centroids.T, 0))
                slack = 1e-6 * (1 + apart)  # more than rounding can be
                order = np.argsort(np.where(sizes > 0, apart, np.inf), axis=1, kind="stable")
                held = np.cumsum(sizes[order], axis=1)
                place = np.arange(len(centroids))[None, :]
                opened = np.zeros(apart.shape, dtype=bool)
                np.put_along_axis(opened, order, ((place < probes) | (held - sizes[order] < k)) & (sizes[order] > 0), 1)
                bound = np.maximum(np.maximum(apart - far[None, :], near[None, :] - apart), 0) - slack
                later = ~opened & (sizes > 0)[None, :] & (bound <= np.sqrt(kth)[:, None])
                a, b = np.nonzero(np.where(np.isnan(kth)[:, None], opened, later))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a)), pa.array(b.astype(np.int32)), pa.array(apart[a, b]), pa.array(kth[a], from_pandas=True)],
                                                 names=["q", "list", "apart", "kth"])
        return asked.select("q", "v", "kth").mapInArrow(run, schema)

    def _hits(self, wanted: DataFrame, asked: DataFrame, chunks: int, k: int) -> DataFrame:
        """(q, id, distance, rank): the k nearest in the blocks of the wanted lists that may hold something nearer than the k-th."""
        reach = F.sqrt("kth") + 1e-6 * (1 + F.col("apart"))
        heads = self.blocks.select("block", "list", "near", "far")
        pairs = wanted.join(heads, "list").where(F.col("kth").isNull() | ((F.col("apart") - F.col("far") <= reach) & (F.col("near") - F.col("apart") <= reach)))
        units = (pairs.select("q", "block").join(asked, "q").groupBy("block", F.pmod(F.xxhash64("q"), F.lit(chunks)).alias("chunk"))
                 .agg(F.collect_list(F.struct("q", "v")).alias("a")).select("block", F.col("a.q").alias("qi"), F.col("a.v").alias("qv")))
        work = units.join(self.blocks.select("block", "ids", "vectors"), "block")
        schema = T.StructType([asked.schema["q"], T.StructField("id", fields(self.blocks)["ids"].elementType), T.StructField("distance", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    one = batch.slice(n, 1)
                    yield closest_rows(one.column("qi").flatten(), stacked(one.column("qv")), one.column("ids").flatten(), stacked(one.column("vectors")), k, ["q", "id", "distance"])
        return top_per_group(work.mapInArrow(run, schema), ["q"], [F.asc("distance"), F.asc("id")], k)
