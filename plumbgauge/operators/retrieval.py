"""Paragraph chunks, vectors, exact nearest neighbours."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, CountVectorizerModel, IDFModel, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbgauge.functions.text import strip
from plumbgauge.operators.kpi import top_per_group
from plumbgauge.plans.stats import col, fields
from plumbgauge.session import materialise, stored

MAX_BROADCAST_QUERIES = 4096
#: Rows of a bucket that a task holds at once, and rows that are dealt to buckets at once, a copy per table.
LSH_BLOCK, LSH_ROWS = 32_768, 1 << 18


def chunk_paragraphs(df: DataFrame, keys: list[str], text: str = "text", separator: str = "\n\n") -> DataFrame:
    """One row per non-empty paragraph with its position; line breaks inside become blanks.

    A text without the separator stays one chunk.
    """
    pieces = F.filter(F.transform(F.split(col(text), separator), strip), lambda p: p != "")
    return (df.select(*[col(k) for k in keys], F.posexplode(pieces).alias("chunk_no", "chunk"))
            .withColumn("chunk", F.regexp_replace("chunk", "\n", " ")))


class TfIdfEmbedder:
    """Hashed TF-IDF vectors of unit length, for use where no embedding model is at hand."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions
        self._model: IDFModel | None = None

    def _counts(self, df: DataFrame, text: str) -> DataFrame:
        tokens = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+").transform(df)
        # a place by a hash that every engine has
        place = lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint") % self.dimensions).cast("string")
        counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(self.dimensions)], inputCol="_tokens", outputCol="_tf")
        return counter.transform(tokens.withColumn("_tokens", F.transform("_words", place)))

    def fit(self, df: DataFrame, text: str = "chunk") -> "TfIdfEmbedder":
        self._model = IDF(inputCol="_tf", outputCol="_tfidf").fit(self._counts(df, text))
        return self

    def transform(self, df: DataFrame, text: str = "chunk", output: str = "embedding") -> DataFrame:
        if self._model is None:
            raise ValueError("fit first")
        weighted = Normalizer(inputCol="_tfidf", outputCol="_unit").transform(
            self._model.transform(self._counts(df, text)))
        return weighted.withColumn(output, vector_to_array("_unit")).select(*[col(c) for c in df.columns], output)


def embed_with(df: DataFrame, encode: Callable[[list[str]], np.ndarray], text: str = "chunk",
               output: str = "embedding") -> DataFrame:
    """Vectors from a caller's model, one call per Arrow batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = np.asarray(encode(batch[text].tolist()), dtype=np.float32)
            yield batch.assign(**{output: list(vectors)})

    return df.mapInPandas(run, schema)


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int = 3, *, corpus_id: str, corpus_vector: str,
                query_id: str, query_vector: str, max_queries: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """Exact ``k`` nearest corpus rows per query by squared Euclidean distance; the id settles ties.

    The queries are counted first. Up to ``max_queries`` of them travel to the tasks, each of which
    reduces its batches to ``k`` rows per query before anything is shuffled. Larger sets never reach the driver: both
    sides are packed into tiles of at most about ``max_queries`` rows, each pair of tiles is one unit of work on the
    executors, and a unit keeps ``k`` rows per query.
    """
    queries = queries.select(col(query_id), col(query_vector).cast("array<double>").alias("_q"))
    corpus = corpus.select(col(corpus_id), col(corpus_vector).cast("array<double>").alias("_v"))
    schema = T.StructType([T.StructField(query_id, fields(queries)[query_id]), T.StructField(corpus_id, fields(corpus)[corpus_id]),
                           T.StructField("distance", T.DoubleType())])
    order = [F.asc("distance"), F.asc(corpus_id)]
    if queries.count() <= max_queries:
        rows = queries.collect()
        if not rows:
            return top_per_group(corpus.sparkSession.createDataFrame([], schema), [query_id], order, k)
        return top_per_group(corpus.mapInPandas(_nearest(rows, k, query_id, corpus_id), schema), [query_id], order, k)
    left = _tiles(queries, query_id, "_q", max_queries).withColumnsRenamed({"ids": "qi", "vectors": "qv"})
    right = _tiles(corpus, corpus_id, "_v", max_queries).withColumnsRenamed({"ids": "ci", "vectors": "cv"})

    def unit(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                yield closest_rows(one.column("qi").flatten(), stacked(one.column("qv")), one.column("ci").flatten(), stacked(one.column("cv")), k,
                                   [query_id, corpus_id, "distance"])

    return top_per_group(left.crossJoin(right).mapInArrow(unit, schema), [query_id], order, k)


def _tiles(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Rows (ids, vectors) of about ``size`` rows of ``df`` each, written once because each meets many others."""
    parts = max(1, -(-df.count() // size))
    dealt = df.groupBy(F.pmod(F.xxhash64(col(key)), F.lit(parts)).alias("_tile")).agg(F.collect_list(F.struct(col(key).alias("i"), col(vector).alias("v"))).alias("rows"))
    return materialise(dealt.select(F.col("rows.i").alias("ids"), F.col("rows.v").alias("vectors")), "tiles")


def closest_rows(ids: pa.Array, points: np.ndarray, keys: pa.Array, vectors: np.ndarray, k: int, names: list[str]) -> pa.RecordBatch:
    """(query id, corpus id, squared distance) of the ``k`` nearest of each point, ties by corpus id."""
    q, v, d = _closest(points, vectors, k)
    order = pa.Table.from_arrays([pa.array(q), keys.take(pa.array(v)), pa.array(d)], names=["q", "key", "d"]).sort_by(
        [("q", "ascending"), ("d", "ascending"), ("key", "ascending")])
    places = order.column("q").to_numpy()
    rank = np.arange(len(places)) - np.searchsorted(places, places)
    best = order.filter(pa.array(rank < k))
    return pa.RecordBatch.from_arrays([ids.take(best.column("q").combine_chunks()), best.column("key").combine_chunks(), best.column("d").combine_chunks()], names=names)


def stacked(column: pa.Array) -> np.ndarray:
    vectors = column.flatten()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _closest(points: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, exact distance) of all that may be among the ``k`` nearest."""
    norms = (points ** 2).sum(axis=1)
    rough = norms[:, None] + (vectors ** 2).sum(axis=1)[None, :] - 2.0 * points @ vectors.T
    at = min(k, len(vectors)) - 1
    kth = np.partition(rough, at, axis=1)[:, at]
    # The product form rounds; keep what may be among the k and measure it again exactly.
    q, v = np.nonzero(rough <= (kth + 1e-9 * (1.0 + norms + kth))[:, None])
    return q, v, ((points[q] - vectors[v]) ** 2).sum(axis=1)


def _nearest(rows: list, k: int, query_id: str, corpus_id: str):
    ids = [r[query_id] for r in rows]
    points = np.array([r["_q"] for r in rows], dtype=np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            keys = batch[corpus_id].to_numpy()
            vectors = np.stack(batch["_v"].to_numpy())
            q, v, exact = _closest(points, vectors, k)
            near = pd.DataFrame({"q": q, "key": keys[v], "distance": exact}).sort_values(["q", "distance", "key"])
            near = near.groupby("q").head(k)
            yield pd.DataFrame({query_id: [ids[i] for i in near["q"]], corpus_id: near["key"].to_numpy(),
                                "distance": near["distance"].to_numpy()})

    return run


def vector_topk_lsh(corpus: DataFrame, queries: DataFrame, k: int = 3, *, corpus_id: str, corpus_vector: str, query_id: str, query_vector: str,
                    planes: int = 5, tables: int = 8, seed: int = 1) -> DataFrame:
    """Approximate ``k`` nearest rows: vectors are met by equality of hyperplane signs, queries also looking one sign away.

    Distances of what is met are exact. More tables raise the recall, more planes lower the work; a corpus that is larger by a factor
    of two affords one plane more. Both sides are dealt to the executors by bucket, of which a task holds at most ``LSH_BLOCK`` rows of either side at once, and a
    block keeps ``k`` rows per query: pairs are never written. A large corpus is dealt for few tables at a time, so the disk holds it once or twice, not once per table.
    Rows that share an id are one, at its least distance.
    """
    def codes(df: DataFrame, key: str, vector: str, near: bool, few: range) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = _matrix(batch.column(1))
                normals = np.random.default_rng(seed).standard_normal((vectors.shape[1], tables * planes))
                signs = (vectors @ normals > 0).reshape(len(vectors), tables, planes)[:, few]
                code = (signs * (1 << np.arange(planes))).sum(axis=2) + (np.array(few) << planes)
                every = np.concatenate([code] + [code ^ (1 << p) for p in range(planes) if near], axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, every.size + 1, every.shape[1], dtype=np.int32), pa.array(every.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "v", "codes"])
        # floats stay as they are on their way and are doubles where they are measured
        floats = df.schema[vector].dataType.simpleString() == "array<float>"
        plain = df.select(col(key).alias("id"), col(vector).cast("array<float>" if floats else "array<double>").alias("v"))
        told = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))]))
        return told.select("id", "v", F.explode("codes").alias("code"))

    def asked(few: range) -> DataFrame:
        return codes(queries, query_id, query_vector, True, few)

    def there(few: range) -> DataFrame:
        return codes(corpus, corpus_id, corpus_vector, False, few)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / LSH_BLOCK).cast("int").alias(name))

    # a row per bucket: into how many blocks its rows and its queries are cut
    sizes = stored(blocks(there(range(tables)), "n").join(blocks(asked(range(tables)), "m"), "code"), "buckets")
    part, every = (lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    schema = T.StructType([T.StructField(query_id, fields(queries)[query_id]), T.StructField(corpus_id, fields(corpus)[corpus_id]), T.StructField("distance", T.DoubleType())])
    names = schema.fieldNames()

    def unit(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [] if not left.num_rows or not right.num_rows else list(_bucket_hits(left, right, k, names))
        return pa.Table.from_batches(found) if found else pa.table({n: pa.array([], t) for n, t in zip(names, (
            left.schema.field("id").type, right.schema.field("id").type, pa.float64()))})

    at_once = max(1, min(tables, LSH_ROWS // max(1, corpus.count())))
    order, hits = [F.asc("distance"), F.asc(corpus_id)], []
    for first in range(0, tables, at_once):
        few = range(first, min(first + at_once, tables))
        left = asked(few).join(sizes, "code").withColumn("j", part("m")).withColumn("i", every("n")).select("code", "i", "j", "id", "v")
        right = there(few).join(sizes, "code").withColumn("i", part("n")).withColumn("j", every("m")).select("code", "i", "j", "id", "v")
        cells = left.groupBy("code", "i", "j").cogroup(right.groupBy("code", "i", "j")).applyInArrow(unit, schema)
        best = top_per_group(cells.groupBy(query_id, corpus_id).agg(F.min("distance").alias("distance")), [query_id], order, k).drop("rank")
        hits.append(stored(best, "hits") if at_once < tables else best)
        if at_once < tables:  # Spark drops the shuffle of these tables when the plan is collected
            gc.collect()
            corpus.sparkSession.sparkContext._jvm.System.gc()
    merged = hits[0] if len(hits) == 1 else reduce(DataFrame.unionAll, hits).groupBy(query_id, corpus_id).agg(F.min("distance").alias("distance"))
    return top_per_group(merged, [query_id], order, k)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as doubles, null components as not a number."""
    if column.null_count:
        raise ValueError("a row has no vector")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _bucket_hits(left: pa.Table, right: pa.Table, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(query id, corpus id, squared distance) of the ``k`` nearest different ids of each query of a block; pairs with a null component have no distance and come first."""
    right = right.sort_by("id").combine_chunks()
    left = left.combine_chunks()
    ids, keys = left.column("id").combine_chunks(), right.column("id").combine_chunks()
    points, vectors = (_matrix(t.column("v").combine_chunks()) for t in (left, right))
    lacking = [np.isnan(m).any(axis=1) & pc.is_null(t.column("v").combine_chunks().flatten()).to_numpy(zero_copy_only=False).reshape(m.shape).any(axis=1)
               for t, m in ((left, points), (right, vectors))]
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()  # in order, for the rows are sorted
    starts = np.nonzero(np.append(True, codes[1:] != codes[:-1]))[0]
    norms = (vectors ** 2).sum(axis=1)
    for at in range(0, len(points), 256):
        q, gone = points[at:at + 256], lacking[0][at:at + 256]
        own = (q ** 2).sum(axis=1)
        rough = own[:, None] + norms[None, :] - 2.0 * q @ vectors.T
        rough[np.isnan(rough)] = np.inf
        rough[gone[:, None] | lacking[1][None, :]] = -np.inf
        least = rough if len(starts) == len(codes) else np.minimum.reduceat(rough, starts, axis=1)
        nth = min(k, least.shape[1]) - 1
        kth = np.partition(least, nth, axis=1)[:, nth]
        # the product form rounds; what may be among the k is measured again
        slack = 1e-9 * (1.0 + own + np.abs(kth) + norms.max())
        near = rough <= np.where(np.isfinite(kth) & np.isfinite(slack), kth + slack, kth)[:, None]
        a, b = np.nonzero(near)
        steps = q[a] - vectors[b]
        exact = np.cumsum(steps * steps, axis=1)[:, -1] if steps.shape[1] else np.zeros(len(a))
        nothing = gone[a] | lacking[1][b]
        placed = np.where(nothing, -np.inf, np.where(np.isnan(exact), np.inf, exact))
        order = np.lexsort((b, placed, a))
        a, b, exact, nothing = a[order], b[order], exact[order], nothing[order]
        new = np.sort(np.unique(a * np.int64(len(codes)) + codes[b], return_index=True)[1])  # of an id's rows the nearest
        a, b, exact, nothing = a[new], b[new], exact[new], nothing[new]
        first = np.arange(len(a)) - np.searchsorted(a, a) < k
        a, b = a[first], b[first]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a + at)), keys.take(pa.array(b)), pa.array(exact[first], mask=nothing[first])], names=names)


def hit_snippets(hits: DataFrame, texts: DataFrame, corpus_id: str, text: str = "text",
                 best: int = 2, chars: int = 150) -> DataFrame:
    """Numbered snippets of the best hits of each query; a hit without a text keeps its number and an empty snippet."""
    snippet = F.concat(F.lit("[Block "), F.col("rank").cast("string"), F.lit("]: "),
                       F.substring(F.regexp_replace(F.coalesce(col(text), F.lit("")), "\n", " "), 1, chars), F.lit("..."))
    return (hits.filter(F.col("rank") <= best).join(texts, corpus_id, "left")
            .select(*[col(c) for c in hits.columns if c != "distance"], snippet.alias("snippet")))
