import random
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from plumbgauge.llm import simhash


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """(doc_id, fp) to smallest doc_id per row, by all pairs."""
    fps = sorted({fp for _, fp in prints})
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for doc, fp in prints:
        if doc is not None:
            least[find(fp)].append(doc)
    return {(doc, fp): min(least[find(fp)], default=None) for doc, fp in prints}


def check(df):
    texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    prints = [(d, plain_fingerprint(t)) for d, t in texts]
    expected = plain_components(prints)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted(((d, f"{fp:016x}", expected[d, fp]) for d, fp in prints), key=repr)


def test_equals_all_pairs(spark, docs):
    check(docs)


def test_odd_rows(spark, edge):
    check(edge)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_links_find_every_pair_whatever_the_bands(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(120):
        base = rng.getrandbits(64)
        fps.add(base)
        for bits in (1, 3, 4, 5):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    mask = (1 << 64) - 1
    expected = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 4)
    for bands in (6, 7, 8, 10):
        assert sorted(map(tuple, simhash.links(table, 4, bands).collect())) == expected


def test_keep_one_keeps_all_columns_and_one_row_per_group(edge):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    # the one group in which no row has an id is named by its fingerprint here
    name = F.coalesce(F.col("component_id").cast("string"), "fingerprint")
    groups = simhash.near_duplicates(edge).select(name.alias("name")).distinct().count()
    assert kept.count() == groups
