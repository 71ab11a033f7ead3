"""Queries: chunks, vectors, nearest neighbours, transcripts, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.catalogue.fixtures import GAPPY_SQL, SPACED_TEXT, gappy_conversations, spaced_documents
from plumbgauge.catalogue.registry import Tables, query
from plumbgauge.operators import retrieval as R
from plumbgauge.operators import transcript as H
from plumbgauge.operators.claims import claim_mismatches
from plumbgauge.operators.inverted import InvertedFile

_CHUNK_SQL = f"""WITH s AS (SELECT doc_id, {SPACED_TEXT} AS text FROM documents),
  p AS (SELECT doc_id, [x FOR x IN [regexp_replace(y, '^\\s+|\\s+$', '', 'g') FOR y IN string_split(text, chr(10) || chr(10))] IF x <> ''] AS l FROM s)
SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS chunk_no, replace(unnest(l), chr(10), ' ') AS chunk FROM p"""


@query("chunk_paragraphs", _CHUNK_SQL)
def chunk_paragraphs(t: Tables) -> DataFrame:
    return R.chunk_paragraphs(spaced_documents(t), ["doc_id"])


def _vector_sql(name: str, texts: str, keys: str, text: str) -> str:
    """Reference SQL: unit TF-IDF values by hashed place, weighted by the document frequencies over the chunks."""
    return f"""{name}_t AS (SELECT {keys}, unnest([x FOR x IN regexp_split_to_array(lower({text}), '\\W+') IF x <> '']) AS w FROM {texts}),
  {name}_n AS (SELECT {keys}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384 AS place, count(*) AS n FROM {name}_t GROUP BY ALL),
  {name}_w AS (SELECT {keys}, place, n * ln(((SELECT count(*) FROM chunks) + 1.0) / (coalesce(d, 0) + 1.0)) AS v FROM {name}_n LEFT JOIN freq USING (place)),
  {name} AS (SELECT {keys}, place, v / sqrt(sum(v * v) OVER (PARTITION BY {keys})) AS v FROM {name}_w WHERE v <> 0)"""


_CHUNK_VECTORS = f"""chunks AS ({_CHUNK_SQL}),
  freq_t AS (SELECT doc_id, chunk_no, unnest([x FOR x IN regexp_split_to_array(lower(chunk), '\\W+') IF x <> '']) AS w FROM chunks),
  freq AS (SELECT place, count(*) AS d FROM (SELECT DISTINCT doc_id, chunk_no, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 384 AS place FROM freq_t) GROUP BY place),
  {_vector_sql("cv", "chunks", "doc_id, chunk_no", "chunk")}"""


@query("embed_tfidf", f"""WITH {_CHUNK_VECTORS}
SELECT doc_id, chunk_no, count(place) AS filled_dimensions, round(coalesce(sum(v * (place + 1)), 0.0), 4) AS weighted_sum
FROM chunks LEFT JOIN cv USING (doc_id, chunk_no) GROUP BY doc_id, chunk_no""")
def embed_tfidf(t: Tables) -> DataFrame:
    chunks = R.chunk_paragraphs(spaced_documents(t), ["doc_id"])
    vectors = R.TfIdfEmbedder(384).fit(chunks).transform(chunks)
    places = F.transform("embedding", lambda x, i: x * (i + 1))
    return vectors.select("doc_id", "chunk_no", F.size(F.filter("embedding", lambda x: x != 0)).alias("filled_dimensions"),
                          F.round(F.aggregate(places, F.lit(0.0), lambda acc, x: acc + x), 4).alias("weighted_sum"))


@query("retrieve_chunks", f"""WITH {_CHUNK_VECTORS},
  {_vector_sql("qv", "benchmark", "item_id", "text")},
  dots AS (SELECT item_id, doc_id, chunk_no, sum(q.v * c.v) AS dot FROM qv q JOIN cv c USING (place) GROUP BY ALL),
  qn AS (SELECT item_id, sum(v * v) AS qq FROM qv GROUP BY item_id), cn AS (SELECT doc_id, chunk_no, sum(v * v) AS cc FROM cv GROUP BY ALL),
  far AS (SELECT item_id, coalesce(qq, 0) + coalesce(cc, 0) - 2 * coalesce(dot, 0) AS d FROM benchmark LEFT JOIN qn USING (item_id) CROSS JOIN chunks
    LEFT JOIN cn USING (doc_id, chunk_no) LEFT JOIN dots USING (item_id, doc_id, chunk_no)),
  ranked AS (SELECT item_id, d, row_number() OVER (PARTITION BY item_id ORDER BY d) AS rank FROM far)
SELECT item_id, rank, abs(round(d, 5)) AS distance FROM ranked WHERE rank <= 3""")
def retrieve_chunks(t: Tables) -> DataFrame:
    """Distances of the best three chunks of the documents for every benchmark text; equal chunks may stand in for one another."""
    chunks = R.chunk_paragraphs(spaced_documents(t), ["doc_id"]).withColumn(
        "chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")))
    embedder = R.TfIdfEmbedder(384).fit(chunks)
    questions = embedder.transform(t.benchmark, text="text", output="question_vector")
    hits = R.vector_topk(embedder.transform(chunks), questions, 3, corpus_id="chunk_id", corpus_vector="embedding",
                         query_id="item_id", query_vector="question_vector")
    return hits.select("item_id", "rank", F.abs(F.round("distance", 5)).alias("distance"))


def label_centres(t: Tables) -> DataFrame:
    """Mean vector per label: the query points."""
    means = (t.embeddings.select("label", F.posexplode("embedding").alias("place", "x"))
             .groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("mean")))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "mean"))), lambda s: s["mean"])
    return means.groupBy("label").agg(ordered.alias("centre"))


_TOPK_SQL = """WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings),
  means AS (SELECT label, place, avg(x) AS mean FROM parts GROUP BY label, place),
  centres AS (SELECT label, list(mean ORDER BY place) AS centre FROM means GROUP BY label),
  pairs AS (SELECT c.label, e.vec_id, list_distance(c.centre, e.embedding::DOUBLE[]) AS d FROM centres c, embeddings e),
  ranked AS (SELECT label, vec_id, d * d AS distance, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rank FROM pairs)"""


def _centre_hits(t: Tables) -> DataFrame:
    return R.vector_topk(t.embeddings, label_centres(t), 3, corpus_id="vec_id", corpus_vector="embedding",
                         query_id="label", query_vector="centre")


@query("vector_topk", _TOPK_SQL + "\nSELECT label, vec_id, rank, round(distance, 4) AS distance FROM ranked WHERE rank <= 3")
def vector_topk(t: Tables) -> DataFrame:
    return _centre_hits(t).withColumn("distance", F.round("distance", 4))


def _hundredth(t: Tables) -> DataFrame:
    """Every hundredth vector as a query against all."""
    return t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("vector_topk_lsh")
def vector_topk_lsh(t: Tables) -> DataFrame:
    """Approximate, so without SQL: its recall is tested against the exact search."""
    return R.vector_topk_lsh(t.embeddings, _hundredth(t), 10, corpus_id="vec_id", corpus_vector="embedding", query_id="query_id", query_vector="embedding")


@query("vector_topk_ivf", """WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank, round(d * d, 4) AS distance FROM pairs QUALIFY rank <= 10""")
def vector_topk_ivf(t: Tables) -> DataFrame:
    """Every hundredth vector against all through an inverted file."""
    index = InvertedFile.build(t.embeddings, "vec_id", "embedding")
    return index.search(_hundredth(t), "query_id", "embedding", 10).withColumn("distance", F.round("distance", 4))


@query("hit_snippets", _TOPK_SQL + """
SELECT label, vec_id, rank, concat('[Block ', CAST(rank AS STRING), ']: ', substr(replace(coalesce(text, ''), chr(10), ' '), 1, 150), '...') AS snippet
FROM ranked LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 2""")
def hit_snippets(t: Tables) -> DataFrame:
    return R.hit_snippets(_centre_hits(t), t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")


# --- transcripts --------------------------------------------------------------------------

_PAIR_SQL = """n AS (SELECT *, lag(role) OVER w AS before_role, lag(text) OVER w AS before_text, lead(role) OVER w AS after_role
    FROM gappy WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  pairs AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text WHEN before_role = 'user' THEN before_text ELSE 'System Query' END AS question,
    CASE WHEN role = 'user' THEN '' ELSE text END AS answer FROM n WHERE role <> 'user' OR after_role IS NULL OR after_role = 'user')"""


@query("qa_pairs", f"WITH {GAPPY_SQL}, {_PAIR_SQL} SELECT * FROM pairs")
def qa_pairs(t: Tables) -> DataFrame:
    return H.qa_pairs(gappy_conversations(t))


@query("qa_unpair", f"WITH {GAPPY_SQL}, {_PAIR_SQL} SELECT conv_id, turn, 0 AS part, 'user' AS role, question AS text FROM pairs "
                    "UNION ALL SELECT conv_id, turn, 1, 'assistant', answer FROM pairs")
def qa_unpair(t: Tables) -> DataFrame:
    return H.qa_unpair(H.qa_pairs(gappy_conversations(t)), ["conv_id", "turn"])


@query("messages_ordered", "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations")
def messages_ordered(t: Tables) -> DataFrame:
    return H.messages_ordered(t.conversations)


@query("report_scope_current", "SELECT conv_id, turn, role, text FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations m WHERE m.conv_id = c.conv_id)")
def report_scope_current(t: Tables) -> DataFrame:
    return H.scope_filter(t.conversations, "current", "conv_id", "turn")


@query("export_counts", "SELECT count(*) AS responses, count(CASE WHEN turn % 2 = 1 THEN 1 END) AS charts, count(CASE WHEN length(text) % 3 > 0 THEN 1 END) AS tables "
                        "FROM conversations WHERE role = 'assistant'")
def export_counts(t: Tables) -> DataFrame:
    rows = t.conversations.select("role", F.when(F.col("turn") % 2 == 1, F.col("text")).alias("chart"),
                                  (F.length("text") % 3).alias("table_rows"))
    return H.export_counts(rows, "role", "chart", "table_rows")


@query("anti_delete", "WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) "
                      "SELECT 'customer' AS table_name, count(*) AS remaining FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone) "
                      "UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)")
def anti_delete(t: Tables) -> DataFrame:
    kept = H.remove_owned({"customer": (t.customer, "c_custkey"), "orders": (t.orders, "o_custkey")},
                          t.customer.filter("c_acctbal < 0"), "c_custkey")
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("remaining")) for n, df in kept.items()]
    return parts[0].unionAll(parts[1])


_ANSWER = ("concat('Largest order ', CAST(CAST(floor(max(o_totalprice)) AS BIGINT) AS STRING), ', on average ', "
           "CAST(CAST(floor(avg(o_totalprice)) AS BIGINT) AS STRING), ' over ', CAST(count(*) AS STRING), ' orders in 2024')")


@query("claim_mismatches", f"""WITH answers AS (SELECT o_custkey, {_ANSWER} AS answer FROM orders GROUP BY o_custkey),
  claims AS (SELECT o_custkey, unnest(regexp_extract_all(answer, '\\b\\d+(?:\\.\\d+)?\\b')) AS claim FROM answers),
  results AS (SELECT o_custkey, round(o_totalprice, 2) AS r FROM orders UNION ALL SELECT o_custkey, trunc(o_totalprice) FROM orders)
SELECT o_custkey, claim FROM claims c WHERE CAST(claim AS DOUBLE) >= 5 AND CAST(claim AS DOUBLE) NOT BETWEEN 1990 AND 2040
  AND NOT EXISTS (SELECT 1 FROM results x WHERE x.o_custkey = c.o_custkey AND abs(r - round(CAST(claim AS DOUBLE), 2)) < 0.05 * greatest(abs(r), 1))""")
def claims(t: Tables) -> DataFrame:
    answers = t.orders.groupBy("o_custkey").agg(F.expr(_ANSWER).alias("answer"))
    return claim_mismatches(answers, t.orders.select("o_custkey", "o_totalprice"), "o_custkey", "answer", ["o_totalprice"])
