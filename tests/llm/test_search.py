"""Spelling variants, nearest vectors and hard negatives, each against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbgauge.llm import cover_tree, cross_polytope, permuterm, queries
from tests.llm.conftest import FOLDER

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# spelling variants

def edit(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    by_less = {}
    for w in words:  # one deletion makes all near words of a word meet
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_less.setdefault(key, set()).add(w)
    forms, near_of = {}, {}
    for w in words:
        met = set().union(*(by_less[k] for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}))
        near = [o for o in met if edit(w, o)]
        near_of[w] = len(near)
        best = min(near, key=lambda o: (-words[o], o.encode()), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, near_of[w], words[forms[w]] if forms[w] else None)
    return out


def as_dict(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def test_spelling_of_all_documents(spark, docs):
    words = counted(docs.select("doc_id", "text").collect())
    assert as_dict(queries.op11_spelling(spark, FOLDER)) == plain_variants(words)


def test_spelling_of_odd_documents(edge, empty):
    rows = edge.select("doc_id", "text").collect()
    assert as_dict(permuterm.spelling_variants(edge)) == plain_variants(counted(rows))
    assert permuterm.spelling_variants(empty).count() == 0


def test_spelling_of_crafted_words(spark):
    words = {"aaaaa": 3, "aaaaaa": 8, "aaaaaaa": 20, "aaaab": 3, "baaaa": 4, "kiloé": 3, "kiloe": 9, "kilo": 50, "kiloee": 4, "abcde": 7, "abcdf": 7, "abcdg": 3,
             "acbde": 5, "bcde": 90, "x": 4, "xy": 8, "\U0001f600abcd": 3, "abcd": 6, "abcd": 6}
    got = permuterm.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert as_dict(got) == plain_variants(words)


def test_near_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 7))) for _ in range(400)})
    got = permuterm.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()
    assert Counter((r["word"], r["other"]) for r in got) == Counter((a, b) for a in words for b in words if edit(a, b))


def test_long_text_counts_like_short_ones(monkeypatch):
    text = ("Straße Ünder LONGword × ab1cd " * 50).encode()
    whole = permuterm.document_words(text, "7", 97)
    monkeypatch.setattr(permuterm, "_LONG", 10)
    assert permuterm.document_words(text, "7", 97) == whole and whole["longword".encode()] == 50 and b"stra\xc3\x9fe" in whole


# nearest vectors

@given(st.integers(1, 70), st.integers(3, 12))
@settings(max_examples=20, deadline=None)
def test_every_bucket_is_probed_once_and_the_own_first(length, bits):
    tables = cross_polytope.Tables(bits, 2, 1)
    x = np.random.default_rng(length).standard_normal((5, length))
    codes, probes = tables.codes(x, 1), tables.probes(x, 1, 1 << bits)
    assert (np.sort(probes, axis=1) == np.arange(1 << bits)).all() and (probes[:, 0] == codes).all()


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).standard_normal((3, 64))
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def plain_nearest(rows, k, every):
    """{query: [(vec_id, score)]} over (vec_id, vector)."""
    out = {}
    for q, v in rows:
        if q % every == 0:
            scored = [(float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v)]
            out[q] = [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def checked(got, wanted, k, at_least):
    """Scores are right, ranks follow them, and enough of what brute force gives is there."""
    by_query = {}
    for r in got:
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == {q for q, rows in wanted.items() if rows}
    hit = total = 0
    for q, rows in by_query.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(wanted[q]) + 1))
        assert [(r["score"], -r["vec_id"]) for r in rows] == sorted(((r["score"], -r["vec_id"]) for r in rows), reverse=True)
        hit += len({r["vec_id"] for r in rows} & {i for i, _ in wanted[q]})
        total += len(wanted[q])
    assert hit >= at_least * total
    return hit / total


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_nearest(spark, folder):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    wanted = plain_nearest(rows, 20, 20)
    got = queries.op12_nearest(spark, folder).collect()
    checked(got, wanted, 20, 0.93)
    vectors = dict(rows)
    for r in got[:500]:
        assert r["score"] == pytest.approx(float(np.dot(vectors[r["query_id"]], vectors[r["vec_id"]])), abs=1e-14)


def test_nearest_of_different_norms(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(12) * 10.0 ** rng.integers(-2, 3)) for i in range(600)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    checked(cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect(), plain_nearest(rows, 10, 20), 10, 0.93)


def test_nearest_among_many_copies_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "TILE", 64)
    rng = np.random.default_rng(6)
    one = rng.standard_normal(8)
    rows = [(i, one) for i in range(200)] + [(i, one + 1e-3 * rng.standard_normal(8)) for i in range(200, 500)] + [(i, rng.standard_normal(8)) for i in range(500, 700)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()
    wanted = plain_nearest(rows, 20, 20)
    checked(got, wanted, 20, 0.95)
    equal = {r["rank"]: r["vec_id"] for r in got if r["query_id"] == 40 and rows[r["vec_id"]][1] is one}
    assert sorted(equal.values()) == [i for i in range(40) if i in equal.values()] or len(equal) < 20


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]),
            (20, [-1.0, 0.0]), (40, [3.0]), (60, [1e200, 1e200]), (80, [1e-200, 0.0]), (100, [-0.0, 2.0]), (120, [5.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("v", "h1", "h2", "code", "band", "rank", "query_id"):
        df = df.withColumn(name, F.lit(name))
    got = {}
    for r in cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[0] == [(60, 1e200), (1, 0.5), (80, 1e-200), (100, 0.0), (20, -1.0)]
    assert got[40] == [(8, 3.0)] and 120 not in got and set(got) == {0, 20, 40, 60, 80, 100}
    assert cross_polytope.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# hard negatives

def plain_negatives(rows, every, positives=5, negatives=10):
    """Over (vec_id, label, integers)."""
    out = []
    for a, label, x in rows:
        if a % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), i, lab) for i, lab, y in rows if i != a and len(y) == len(x)))
        for s, p, _ in [t for t in scored if t[2] == label][:positives]:
            inside = [(i, -n) for n, i, lab in scored if lab != label and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out += [(a, p, rank + 1, i, -s, n) for rank, (i, n) in enumerate(inside)]
    return sorted(out)


NEGATIVE = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 64)
    monkeypatch.setattr(cover_tree, "TILE", 8)
    rng = np.random.default_rng(8)
    centers = rng.integers(-40, 41, (12, 6))
    rows = []
    for i in range(900):
        c = rng.integers(12)
        rows.append((i, int(c % 3), (centers[c] + rng.integers(-4, 5, 6)).tolist()))
    rows += [(i, 1, [9, 9, 9, 0, 0, 0]) for i in range(900, 1100)] + [(i, 2, [8, 8, 8, 0, 0, 0]) for i in range(1100, 1160)]
    df = spark.createDataFrame(rows, "vec_id long, label long, x array<long>")
    got = cover_tree.hard_negatives(df, F.col("vec_id") % 20 == 0)
    assert got.columns == NEGATIVE
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 20)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 200), st.sampled_from([3, 100, 1 << 20, 1 << 40]))
def test_descent_finds_what_a_scan_finds(seed, n, size):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-size, size + 1, (n, 3))
    rows[rng.integers(0, n, n // 3)] = rows[0]
    ids = rng.permutation(n).astype(np.int64)
    tree, query = cover_tree.Tree(rows, ids), rng.integers(-size, size + 1, 3)
    exact = [int(sum(int(a) * int(b) for a, b in zip(r, query))) for r in rows]
    exact = [max(1 - (1 << 63), min((1 << 63) - 1, e)) for e in exact]
    ends = sorted(exact)[n // 3], sorted(exact)[2 * n // 3]
    low, high = np.array([-(1 << 63), ends[0]]), np.array([(1 << 63) - 1, ends[1]])
    for (got, scores), a, b in zip(tree.search(query, low, high, 5), low.tolist(), high.tolist()):
        wanted = sorted((-e, i) for e, i in zip(exact, ids.tolist()) if a <= e <= b)[:5]
        assert list(zip((-scores).tolist() if size < 1 << 40 else [-int(s) for s in scores], got.tolist())) == wanted


def test_descent_leaves_nodes_out():
    """On grouped rows a descent looks at a small part of a block."""
    rng = np.random.default_rng(1)
    rows = (rng.integers(-1000, 1000, (20, 8))[:, None, :] + rng.integers(-9, 10, (20, 100, 8))).reshape(-1, 8)
    tree, seen = cover_tree.Tree(rows, np.arange(len(rows))), []
    taken = cover_tree.products
    cover_tree.products = lambda r, *rest: (seen.append(len(r)), taken(r, *rest))[1]
    try:
        tree.search(rows[7], np.array([-(1 << 63)]), np.array([(1 << 63) - 1]), 5)
    finally:
        cover_tree.products = taken
    assert sum(seen) <= len(rows) // 4


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, 1, [1.0, 0.0]), (100, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.1]), (3, 2, [0.5, 0.1]), (4, None, [0.5, 0.5]), (5, 2, None), (6, 2, [nan, 0.5]), (8, 2, [inf, 0.5]),
            (9, 2, [None, 0.5]), (10, 2, []), (11, 2, [0.5]), (None, 2, [0.5, 0.2]), (200, 5, [-1.0, 0.0]), (12, 5, [1.0, 0.0]), (300, 6, [0.0, 0.0]), (13, 6, [0.0, 1.0]), (400, 7, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for name in ("x", "h1", "h2", "width", "part", "rank", "high"):
        df = df.withColumn(name, F.lit(name))
    got = cover_tree.hard_negatives(cover_tree.whole_numbers(df), F.col("vec_id") % 100 == 0)
    rows = [(1, 1, [256, 128]), (2, 2, [128, 25]), (3, 2, [128, 25]), (100, 1, [256, 0]), (200, 5, [-256, 0]), (12, 5, [256, 0]), (300, 6, [0, 0]), (13, 6, [0, 256]), (400, 7, [1 << 62, 256])]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 100)
    assert cover_tree.hard_negatives(cover_tree.whole_numbers(df).where("false"), F.col("vec_id") % 100 == 0).count() == 0
