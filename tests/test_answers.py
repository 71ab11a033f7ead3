"""KPI, shaping, retrieval, transcripts, storage and SQL on small frames."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbgauge.functions.lexicon import UNASSIGNED_PREFIX
from plumbgauge.operators import kpi as K
from plumbgauge.operators import retrieval as R
from plumbgauge.operators import shape as S
from plumbgauge.operators import transcript as H
from plumbgauge.operators.claims import claim_mismatches
from plumbgauge.plans.stats import local_rows
from plumbgauge.sources import readers
from plumbgauge.sources.sql import ReadOnlyError, run_sql, run_statements, split_statements
from plumbgauge.sources.tables import Versions, list_tables, save_table, table_exists, table_name


def test_grouped_kpi_puts_unassigned_last(spark):
    df = local_rows(spark, "city string, sales double", [("a", 1.0), ("b", 5.0), (None, 50.0), ("Unknown", 9.0), ("", 2.0)])
    rows = K.grouped_kpi(df, ["city"], {"total": F.sum("sales")}).collect()
    assert [r["city"] for r in rows] == ["b", "", "a", f"{UNASSIGNED_PREFIX} (Missing City)", f"{UNASSIGNED_PREFIX} (Missing City)"]
    assert {r["city_completeness_pct"] for r in rows} == {40.0}


def test_valid_and_missing_add_up(spark):
    df = local_rows(spark, "city string, units bigint", [("a", 1), (" ", 2), ("nan", 3), (None, 4)])
    done = K.dimension_completeness(df, ["city"]).first()
    lost = K.unattributed_totals(df, ["city"]).first()
    assert done["valid_rows"] + lost["missing_rows"] == done["total_rows"] == 4
    assert lost["units"] == 9.0


def test_main_metric(spark):
    assert K.main_metric(local_rows(spark, "a string, n int, sales double")) == "sales"
    assert K.main_metric(local_rows(spark, "a string, n int, m double")) == "n"
    with pytest.raises(ValueError):
        K.main_metric(local_rows(spark, "a string"))


def test_trend_rejects_unknown_units(spark):
    with pytest.raises(ValueError):
        K.trend(local_rows(spark, "d timestamp"), "d", "hourly", {})


def test_page_beyond_the_end_is_empty(spark):
    assert S.paginate(spark.range(30), [F.asc("id")], 99, 10).isEmpty()
    assert [r["rank"] for r in S.paginate(spark.range(30), [F.asc("id")], 3, 10).collect()] == list(range(21, 31))


@pytest.mark.parametrize("descending,expected", [(False, [1, 2, 3, 5, 4]), (True, [3, 2, 1, 5, 4])])
def test_sort_rows_keeps_gaps_last(spark, descending, expected):
    df = local_rows(spark, "id bigint, v string", [(1, "a"), (2, "b"), (3, "c"), (4, f"{UNASSIGNED_PREFIX} (x)"), (5, None)])
    ranked = S.sort_rows(df, "v", ["id"], descending).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == expected


def test_histogram_counts_everything_once(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.sqrt("id")).alias("x"))
    rows = S.histogram(df, "x").collect()
    expected, edges = np.histogram([math.sqrt(i) for i in range(1000) if i % 10], bins=15)
    assert [r["frequency"] for r in sorted(rows, key=lambda r: r["bin"])] == expected.tolist()
    assert S.histogram(local_rows(spark, "x double", [(2.0,)] * 3), "x").collect()[0]["frequency"] == 3
    assert S.histogram(local_rows(spark, "x double", [(None,)]), "x").isEmpty()


def test_correlation_is_symmetric(spark):
    df = spark.range(100).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    r = {(x["x"], x["y"]): x["r"] for x in S.correlation_matrix(df).collect()}
    assert all(r[a, b] == r[b, a] for a, b in r) and r["a", "a"] == 1.0


def test_chart_recommendation_classes(spark):
    summary = local_rows(spark, "table_name string, position int, column_name string, dtype string", [
        ("line", 0, "day_date", "string"), ("line", 1, "v", "double"), ("bar", 0, "v", "int"), ("bar", 1, "city", "string"),
        ("two", 0, "date", "double"), ("two", 1, "flag", "boolean"), ("one", 0, "v", "double"), ("text", 0, "a", "string"), ("text", 1, "b", "string")])
    assert S.chart_recommendation(summary).filter("table_name = 'text'").first()["alternatives"] == "bar,line,pie,scatter,heatmap"
    found = {r["table_name"]: (r["chart"], r["x"], r["y"]) for r in S.chart_recommendation(summary).collect()}
    assert found == {"line": ("line", "day_date", "v"), "bar": ("bar", "city", "v"), "two": ("scatter", "date", "flag"),
                     "one": ("table", None, None), "text": ("bar", "a", "b")}
    assert S.missing_axes(summary, "position", "absent") == ["absent"]


# --- retrieval ----------------------------------------------------------------------------


@pytest.mark.parametrize("max_queries", [1000, 4])
def test_vector_topk_brute_force(spark, max_queries):
    rng = np.random.default_rng(5)
    corpus, queries = rng.normal(size=(200, 8)), rng.normal(size=(11, 8))
    corpus[50:60] = corpus[3]  # ties: the smaller id comes first
    queries[0] = corpus[3]
    cdf = spark.createDataFrame(pd.DataFrame({"id": range(200), "v": list(corpus)})).repartition(5)
    qdf = spark.createDataFrame(pd.DataFrame({"q": range(11), "w": list(queries)}))
    hits = R.vector_topk(cdf, qdf, 4, corpus_id="id", corpus_vector="v", query_id="q", query_vector="w", max_queries=max_queries)
    found = {(r["q"], r["rank"]): r["id"] for r in hits.collect()}
    for q in range(11):
        d = ((corpus - queries[q]) ** 2).sum(axis=1)
        best = sorted(range(200), key=lambda i: (d[i], i))[:4]
        assert [found[q, k + 1] for k in range(4)] == best


def test_more_neighbours_than_rows(spark):
    cdf = spark.createDataFrame(pd.DataFrame({"id": [1, 2], "v": [[0.0, 1.0], [1.0, 0.0]]}))
    hits = R.vector_topk(cdf, cdf.select(F.col("id").alias("q"), F.col("v").alias("w")), 5, corpus_id="id", corpus_vector="v", query_id="q", query_vector="w")
    assert hits.count() == 4


def test_chunks(spark):
    df = local_rows(spark, "id bigint, text string", [(1, "a\n\n b\nc \n\n\n\n"), (2, "one\ntwo"), (3, " \n\n ")])
    assert [(r["id"], r["chunk_no"], r["chunk"]) for r in R.chunk_paragraphs(df, ["id"]).collect()] == [(1, 0, "a"), (1, 1, "b c"), (2, 0, "one two")]


def test_tfidf_brute_force(spark):
    texts = ["red blue red", "blue green", "green green blue", "Blue, yellow!"]
    df = local_rows(spark, "id bigint, chunk string", list(enumerate(texts)))
    rows = {r["id"]: np.array(r["embedding"]) for r in R.TfIdfEmbedder(1 << 14).fit(df).transform(df).collect()}
    tokens = [t.lower().replace(",", "").replace("!", "").split() for t in texts]
    vocabulary = sorted({w for t in tokens for w in t})
    idf = np.array([math.log((len(texts) + 1) / (sum(w in t for t in tokens) + 1)) for w in vocabulary])
    weights = np.array([[t.count(w) for w in vocabulary] for t in tokens]) * idf
    unit = weights / np.linalg.norm(weights, axis=1, keepdims=True)
    for i in range(4):
        for j in range(4):
            assert rows[i] @ rows[j] == pytest.approx(unit[i] @ unit[j], abs=1e-9)


def test_embedding_hook(spark):
    df = local_rows(spark, "id bigint, chunk string", [(1, "abc"), (2, "a")])
    rows = R.embed_with(df, lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert {r["id"]: r["embedding"] for r in rows} == {1: [3.0, 1.0], 2: [1.0, 1.0]}


# --- transcripts --------------------------------------------------------------------------


@pytest.mark.parametrize("segment_size", [1, 2, 4096])
def test_pairing_rules(spark, segment_size):
    talk = [("assistant", "hello"), ("user", "q1"), ("user", "q2"), ("assistant", "a2"), ("system", "note"), ("user", "q3")]
    df = local_rows(spark, "conv_id bigint, turn bigint, role string, text string", [(1, i, r, x) for i, (r, x) in enumerate(talk)])
    pairs = H.qa_pairs(df, segment_size=segment_size).orderBy("turn").collect()
    assert [(r["question"], r["answer"]) for r in pairs] == [
        ("System Query", "hello"), ("q1", ""), ("q2", "a2"), ("System Query", "note"), ("q3", "")]


def test_scope(spark):
    df = local_rows(spark, "owner string, t bigint, x string", [("a", 1, "old"), ("a", 2, "new"), ("b", 5, "only")])
    assert sorted(r["x"] for r in H.scope_filter(df, "current", "owner", "t").collect()) == ["new", "only"]
    assert H.scope_filter(df, "session", "owner", "t").count() == 3


def test_claims_brute_force(spark):
    rng = np.random.default_rng(11)
    answers, results, expected = [], [], []
    for key in range(40):
        numbers = [round(float(x), 2) for x in rng.uniform(-50, 400, rng.integers(0, 6))]
        words = f"about {round(float(rng.uniform(6, 400)), 1)} things"
        results += [(key, x, words) for x in numbers]
        stated = [round(float(x), 2) for x in rng.uniform(0, 400, 5)] + [2024.0]
        answers.append((key, " and ".join(str(s) for s in stated)))
        pool = [v for x in numbers for v in (x, float(int(x)))] + ([float(words.split()[1])] if numbers else [])
        for s in stated:
            if s >= 5 and not 1990 <= s <= 2040 and not any(abs(r - s) < 0.05 * max(abs(r), 1) for r in pool):
                expected.append((key, str(s)))
    found = claim_mismatches(local_rows(spark, "k bigint, answer string", answers), local_rows(spark, "k bigint, v double, w string", results),
                             "k", "answer", ["v", "w"])
    assert sorted((r["k"], r["claim"]) for r in found.collect()) == sorted(expected)


# --- SQL ----------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE VIEW v AS SELECT 1", "SET a=b", "SELECT 1) ; DROP VIEW t --",
                                  "SHOW TABLES", "ALTER TABLE t ADD COLUMN x INT", "CACHE TABLE t"])
def test_only_queries_pass(spark, text):
    spark.range(1).createOrReplaceTempView("t")
    with pytest.raises(ReadOnlyError):
        run_sql(spark, text)
    assert spark.table("t").count() == 1


def test_literals_may_hold_any_word(spark):
    row = run_sql(spark, "SELECT 'drop update; delete' AS \"a b\" -- insert\n").first()
    assert row["a b"] == "drop update; delete"
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"


def test_statements(spark):
    assert split_statements("a; 'b;c' ;; -- d;e\nf") == ["a", "'b;c'", "-- d;e\nf"]
    results, errors = run_statements(spark, "DROP TABLE x; SELECT 1 AS a; SELECT 2 AS a")
    assert [r.first()["a"] for r in results] == [1, 2] and len(errors) == 1
    with pytest.raises(ReadOnlyError):
        run_statements(spark, "DROP TABLE x")


# --- files --------------------------------------------------------------------------------


def test_csv_skips_long_lines_and_pads_short_ones(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,x,2.5\n2,y\n3,z,1.0,extra\n4,"q,r",NaN\n')
    rows = readers.load_table(spark, str(path)).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 2.5), (2, "y", None), (4, "q,r", None)]
    assert [r["line"] for r in readers.malformed_lines(spark, str(path)).collect()] == ["3,z,1.0,extra"]


def test_json_array_and_lines(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows))
    for name in ("array.json", "lines.json"):
        assert [tuple(r) for r in readers.load_table(spark, str(tmp_path / name)).orderBy("a").collect()] == [(1, "x"), (2, None)]


@pytest.mark.parametrize("content,columns", [("\n\na\tb\n1\t2\n", ["a", "b"]), ("a,b\n1,2\n", ["a", "b"]), ("one, line", ["text"]), ("no\nseparators", ["text"])])
def test_text_sniffing(spark, tmp_path, content, columns):
    path = tmp_path / "f.txt"
    path.write_text(content)
    assert readers.load_table(spark, str(path)).columns == columns


def test_invalid_bytes_are_dropped(spark, tmp_path):
    path = tmp_path / "f.txt"
    path.write_bytes(b"caf\xff one")
    assert readers.load_table(spark, str(path)).first()["text"] == "caf one"


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        readers.load_table(spark, "x.exe")


def test_tables(spark, tmp_path):
    assert table_name("/a/My Table.csv") == "my_table"
    save_table(spark.range(3), str(tmp_path), "saved_numbers")
    save_table(spark.range(5), str(tmp_path), "saved_numbers")
    assert spark.table("saved_numbers").count() == 5
    assert "saved_numbers" in list_tables(spark) and table_exists(spark, "SAVED_Numbers") and not table_exists(spark, "absent")


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    assert store.manifest().isEmpty()
    store.create("t", spark.range(3), "raw")
    store.create("t", spark.range(2), "clean")
    assert [r["version_num"] for r in store.listing("t").collect()] == [2, 1]
    assert store.latest("t").count() == 2
    current, schema, metadata = store.roll_back("t", 1)
    assert current.count() == 3 and schema.count() == 1 and metadata.first()["row_count"] == 3
    assert store.duplicate("t", "copy") == 2
    assert [r["description"] for r in store.listing("copy").collect()] == ["clean [Rows: 2, Columns: 1]", "raw [Rows: 3, Columns: 1]"]
    with pytest.raises(ValueError):
        store.latest("absent")
    (tmp_path / "raw_only.csv").write_text("a,b\n1,2\n")
    assert store.activate("raw_only", str(tmp_path / "raw_only.csv")).count() == 1
    assert store.activate("copy", "absent.csv").count() == 2
    assert store.activate("t", "absent.csv").count() == 3  # rolled back above, still registered


def test_header_promotion(spark):
    rows = [("x", 1, 0, "name|n"), ("x", 1, 1, "a|1"), ("x", 1, 2, "b|2"), ("x", 2, 0, "only a header")]
    df = local_rows(spark, "doc_id string, table_no bigint, row_no bigint, joined string", rows)
    cells = df.select("doc_id", "table_no", "row_no", F.split("joined", r"\|").alias("cells"))
    found = readers.promote_header(cells, ["doc_id", "table_no"]).collect()
    assert {(r["row_no"], r["column_name"], r["value"]) for r in found} == {(1, "name", "a"), (1, "n", "1"), (2, "name", "b"), (2, "n", "2")}


def test_staged_tables_are_released(spark):
    from plumbgauge.session import materialise, staged
    with staged(spark):
        kept = materialise(spark.range(5))
        path = kept.inputFiles()[0]
        assert kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_closing_semicolon_and_initcap_in_literals(spark):
    from plumbgauge.sources.sql import prepared, run_sql
    assert run_sql(spark, "SELECT 1 AS x; -- done\n").first()["x"] == 1
    assert prepared("SELECT InitCap (a), 'initcap(b);' FROM t ;; ") == "SELECT initcap_ws (a), 'initcap(b);' FROM t "


def test_missing_words_and_quoted_breaks(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,n,note\n1,NA,"two\nlines, one ""record"""\n2,5,N/A\n3,7,x,surplus\n4,null,\n')
    df = readers.load_csv(spark, str(tmp_path / "f.csv"))
    assert dict(df.dtypes) == {"id": "int", "n": "int", "note": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, None, 'two\nlines, one "record"'), (2, 5, None), (4, None, None)]
    assert [r["line"] for r in readers.malformed_lines(spark, str(tmp_path / "f.csv")).collect()] == ["3,7,x,surplus"]


def test_roll_back_is_found_by_a_later_session(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    store.create("c", spark.range(3), "raw")
    store.create("c", spark.range(2), "clean")
    store.roll_back("c", 1)
    assert Versions(spark, str(tmp_path)).latest("c").count() == 3
    assert store.create("c", spark.range(9), "again") == 3 and store.latest("c").count() == 9
