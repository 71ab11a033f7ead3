"""Operators whose plans must hold at any size: near spellings, inverted file, grouped quantiles, pages."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbgauge.catalogue import everything
from plumbgauge.catalogue.registry import Tables
from plumbgauge.operators import inverted, profile
from plumbgauge.operators import kpi as K
from plumbgauge.operators import retrieval as R
from plumbgauge.operators import shape as S
from plumbgauge.plans import spelling
from plumbgauge.plans.grouped_quantiles import grouped_quantiles
from plumbgauge.plans.pages import PageDirectory
from plumbgauge.plans.stats import local_rows

FOLDER = "/root/testdata/sf0.01"


# near spellings

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_pairs(words):
    ordered = sorted(set(words))
    return {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:]
            if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2 and d < 0.3 * max(len(a), len(b))}


def found_pairs(spark, words):
    rows = spelling.near_text_pairs(spark.createDataFrame([("c", w) for w in set(words)], "column_name string, low string")).collect()
    pairs = [(r["low_a"], r["low_b"]) for r in rows]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_values_without_letters_are_compared(spark):
    words = ["2021-1", "2021-01", "555-0100", "555 0100", "18-24", "18 - 24", "+1 555", "+1-555", "$1,000.00", "$1000.00", "12", "13", "123", "124", "1234", "1235", "é-1234", "e-1234"]
    assert found_pairs(spark, words) == plain_pairs(words)
    assert ("2021-01", "2021-1") in found_pairs(spark, words)
    df = local_rows(spark, "phase string", [("2021-1",), ("2021-01",), ("1999-7",)])
    assert profile.near_duplicate_categories(profile.spellings(df)).count() == 1


@pytest.mark.parametrize("low,high,alphabet", [(3, 9, "01"), (22, 29, "ab"), (5, 12, "0123456789")])
def test_pairs_equal_brute_force(spark, low, high, alphabet):
    rng = random.Random(low)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(110)}
    for w in list(words)[:40]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1:]}
    assert found_pairs(spark, words) == plain_pairs(words)


def test_long_values_that_share_their_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HOT", 5)
    rng = random.Random(2)
    words = {f"https://www.example.com/products/{rng.randrange(10 ** 6):06d}/view" for _ in range(60)}
    words |= {w[:33] + w[34:] for w in list(words)[:20]} | {w[:-1] + "x" for w in list(words)[:20]}
    long = "the same beginning of a text that is longer than those which meet by deletions, " * 2
    words |= {long + str(rng.randrange(1000)) for _ in range(40)}
    assert found_pairs(spark, words) == plain_pairs(words)


def test_long_values_meet_by_few_keys(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(25, 40))) for _ in range(60)}
    for w in list(words):
        for _ in range(3):
            for _ in range(2):  # two edits at any two places
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcd") + w[i:], w[:i] + rng.choice("abcd") + w[i + 1:]])
            words.add(w)
    assert len(plain_pairs(words)) > 180 and found_pairs(spark, words) == plain_pairs(words)
    texts = spark.createDataFrame([(i, "c", w) for i, w in enumerate(sorted(words))], "id long, column_name string, low string")
    short, long = spelling._piece_keys(texts)
    assert short.groupBy("id_a").count().agg(F.max("count")).first()[0] == 3
    assert long.groupBy("id_b").count().agg(F.max("count")).first()[0] <= 12


def test_no_key_of_many_digit_strings_is_shared_by_many(spark):
    rng = random.Random(3)
    values = spark.createDataFrame([("c", f"{rng.randrange(10 ** 10):010d}") for _ in range(20_000)], "column_name string, low string").distinct()
    keys = values.select(F.explode(spelling._without_two(F.col("low"))).alias("k")).groupBy("k").count()
    assert keys.agg(F.max("count")).first()[0] < 50


# inverted file

def plain_nearest(corpus, queries, k):
    out = {}
    for q, v in queries:
        d = ((np.array([x for _, x in corpus]) - v) ** 2).sum(axis=1)
        order = sorted(zip(d.tolist(), [i for i, _ in corpus]))[:k]
        out[q] = [(i, pytest.approx(s, abs=1e-9)) for s, i in order]
    return out


def hits(df, query, key):
    out = {}
    for r in df.orderBy(query, "rank").collect():
        out.setdefault(r[query], []).append((r[key], r["distance"]))
    return out


def test_inverted_file_is_exact_on_grouped_vectors(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 32)
    monkeypatch.setattr(inverted, "CHUNK", 8)
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((30, 6)) * 20
    corpus = [(i, (centers[i % 30] + rng.standard_normal(6))) for i in range(1500)] + [(i, centers[0] + 0.5) for i in range(1500, 1800)]  # copies fill a list
    df = spark.createDataFrame([(i, v.tolist()) for i, v in corpus], "doc long, vec array<double>")
    asked = [(f"q{i}", corpus[i * 13][1] + 0.1 * rng.standard_normal(6)) for i in range(60)]
    queries_ = spark.createDataFrame([(q, v.tolist()) for q, v in asked], "name string, vec array<double>")
    index = inverted.InvertedFile.build(df, "doc", "vec")
    assert index.sizes.sum() == 1800 and index.blocks.agg(F.max(F.size("ids"))).first()[0] <= 32
    assert hits(index.search(queries_, "name", "vec", 5), "name", "doc") == plain_nearest(corpus, asked, 5)
    # far fewer pairs of query and list are opened than there are
    opened = index._lists(queries_.select(F.col("name").alias("q"), F.col("vec").alias("v"), F.lit(None).cast("double").alias("kth")), 5, 4).count()
    later = index._lists(queries_.select(F.col("name").alias("q"), F.col("vec").alias("v"), F.lit(9.0).alias("kth")), 5, 4).count()
    assert opened + later < 0.35 * 60 * len(index.centroids)


def test_inverted_file_of_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [0.0, 0.9])], "query_id long, embedding array<double>")
    index = inverted.InvertedFile.build(df, "vec_id", "embedding")
    assert [i for i, _ in hits(index.search(asked, "query_id", "embedding", 10), "query_id", "vec_id")[9]] == [1, 2, 3]
    assert index.search(asked.limit(0), "query_id", "embedding", 3).count() == 0
    nothing = inverted.InvertedFile.build(df.limit(0), "vec_id", "embedding")
    assert nothing.search(asked, "query_id", "embedding", 3).count() == 0


def test_approximate_search_in_blocks_and_rounds_of_tables(spark, monkeypatch):
    rng = np.random.default_rng(6)
    points = rng.standard_normal((300, 8)).astype(np.float32)
    rows = [(i, points[i].tolist()) for i in range(300)] + [(i, points[i].tolist()) for i in range(0, 300, 50)]  # some rows twice
    rows += [(1000 + i, points[7].tolist()) for i in range(40)]  # and a bucket of copies
    corpus = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    asked = corpus.filter("id % 10 = 0").select(F.col("id").alias("q"), "v")

    def search():
        found = R.vector_topk_lsh(corpus, asked, 5, corpus_id="id", corpus_vector="v", query_id="q", query_vector="v", planes=3, tables=4)
        return found, {(r["q"], r["rank"]): (r["id"], r["distance"]) for r in found.collect()}
    normals = np.random.default_rng(1).standard_normal((8, 12))
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    signs = {i: (v @ normals > 0).reshape(4, 3) for i, v in vectors.items()}
    wanted = {}
    for q in (i for i in vectors if i % 10 == 0):
        met = [i for i in vectors if ((signs[q] != signs[i]).sum(axis=1) <= 1).any()]
        for rank, (d, i) in enumerate(sorted((((vectors[q] - vectors[i]) ** 2).sum(), i) for i in met)[:5], 1):
            wanted[q, rank] = (i, pytest.approx(d, abs=1e-12))
    plain, got = search()
    assert got == wanted
    monkeypatch.setattr(R, "LSH_BLOCK", 7)
    monkeypatch.setattr(R, "LSH_ROWS", 400)
    assert search()[1] == wanted
    plan = plain._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # pairs with their vectors are not rows of a join


def test_recall_of_approximate_search(spark):
    t = Tables(spark, FOLDER)
    got = everything.queries()["vector_topk_lsh"](spark, FOLDER).select("query_id", "vec_id").collect()
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = R.vector_topk(t.embeddings, asked, 10, corpus_id="vec_id", corpus_vector="embedding", query_id="query_id", query_vector="embedding").collect()
    found = {tuple(r) for r in got} & {(r["query_id"], r["vec_id"]) for r in exact}
    assert len(exact) == 50 and len(found) >= 0.9 * len(exact)


# grouped quantiles

@pytest.mark.parametrize("limit", [10_000, 20, 1])
def test_grouped_quantiles_equal_sorting(spark, limit):
    rng = np.random.default_rng(2)
    frames = {"most": np.concatenate([rng.standard_normal(3000) * 10.0 ** rng.integers(-9, 9, 3000), [0.0] * 500, [7.5] * 400]), "few": np.array([3.0, 1.0]), "one": np.array([5.0]),
              None: rng.integers(-5, 5, 300).astype(float), "far": np.concatenate([rng.random(200), [1e300, -1e300]]), "none": np.array([])}
    rows = [(k, float(x)) for k, v in frames.items() for x in v] + [("none", None), ("few", float("nan")), ("few", None)]
    df = spark.createDataFrame(rows, "k string, x double").withColumn("v", F.col("x")).withColumn("size", F.lit(1))
    ps = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["k"], r["column_name"], r["probability"]): r["value"] for r in grouped_quantiles(df, ["k"], ["x", "v"], ps, limit).collect()}
    assert len(got) == len(frames) * 2 * len(ps)
    for k, v in frames.items():
        for p in ps:
            for c in ("x", "v"):
                assert got[k, c, p] == (pytest.approx(float(np.quantile(v, p)), rel=1e-12) if len(v) else None)


def test_grouped_quantiles_of_infinite_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, float("-inf")), (1, 2.0), (1, 1e308), (1, -1e308)], "k long, x double")
    got = {r["probability"]: r["value"] for r in grouped_quantiles(df, ["k"], ["x"], [0.0, 0.25, 0.5, 1.0], 1).collect()}
    assert got == {0.0: float("-inf"), 0.25: -1e308, 0.5: 2.0, 1.0: float("inf")}
    assert grouped_quantiles(df.limit(0), ["k"], ["x"], [0.5]).count() == 0


# pages

def test_pages_open_few_files(spark):
    rows = pd.DataFrame({"a": np.random.default_rng(3).integers(0, 500, 5000), "id": range(5000)})
    df = spark.createDataFrame(rows).repartition(6)
    pages = PageDirectory.build(df, [F.desc("a"), F.asc("id")], rows_per_file=300)
    ordered = rows.sort_values(["a", "id"], ascending=[False, True])["id"].tolist()
    assert pages.ends[-1] == 5000 and len(pages.files) >= 17
    for page, size in ((1, 20), (2, 150), (120, 20), (250, 20), (5, 1000), (1, 6000), (251, 20), (10 ** 9, 50)):
        got = pages.page(page, size).orderBy("rank")
        wanted = ordered[(page - 1) * size:page * size]
        assert [(r["id"], r["rank"]) for r in got.collect()] == [(i, (page - 1) * size + n + 1) for n, i in enumerate(wanted)]
        if size <= 150:
            assert len(got.inputFiles()) <= 2
    assert PageDirectory.build(df.limit(0), [F.asc("id")]).page(1, 10).count() == 0


# correlations and overview

def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame(rng.standard_normal((400, 150)), columns=[f"c {i}" for i in range(150)])
    frame["c 3"] = frame["c 2"] * -3 + 1
    frame["c 5"] = frame["c 5"] * 1e-3 + 1e9  # little variation on a large offset
    frame["c 7"] = 4.0
    frame = frame.mask(rng.random(frame.shape) < 0.2)
    frame["c 8"] = [1.0] + [None] * 399
    df = spark.createDataFrame(frame).repartition(5)
    got = {(r["x"], r["y"]): r["r"] for r in S.correlation_matrix(df).collect()}
    wanted = (frame - frame.mean()).corr()
    assert len(got) == 150 ** 2
    for (x, y), r in got.items():
        w = 1.0 if x == y else wanted.loc[x, y]
        if x != y and {"c 7", "c 8"} & {x, y}:
            assert r is None
        else:
            assert r == pytest.approx(w, abs=2e-6 if "c 5" in (x, y) else 1e-9), (x, y)


def test_wide_and_narrow_correlations_agree(spark, monkeypatch):
    df = Tables(spark, FOLDER).lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("n"))
    narrow = {(r["x"], r["y"]): r["r"] for r in S.correlation_matrix(df).collect()}
    monkeypatch.setattr(S, "WIDE", 0)
    wide = {(r["x"], r["y"]): r["r"] for r in S.correlation_matrix(df).collect()}
    assert set(narrow) == set(wide) and all(wide[k] == pytest.approx(v, abs=1e-9) for k, v in narrow.items())


def test_overview_scans_once(spark):
    lines = Tables(spark, FOLDER).lineitem
    plan = K.overview_groups(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    groups, single = K.overview_groups(lines), K.overview(lines)
    for d in ("l_returnflag", "l_linestatus"):
        assert ({(r["value"], round(r["total"], 2)) for r in groups.filter(F.col("dimension") == d).collect()}
                == {(r[d], round(r["total_l_quantity"], 2)) for r in single[f"by_{d}"].collect()})
    assert K.overview_groups(lines.select("l_comment" if "l_comment" in lines.columns else "l_returnflag")).count() == 0
