"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's target is a number of words. It takes every document as often as the target holds
its source, and of one more pass over the source just as many blocks (documents, in an order permuted by hash) as are
still wanted; the last block is taken in part. Thus the number of blocks of each source, its quota, is exact. The tree deals
the quotas out: at each node the blocks of one half of the output shards are drawn without replacement from
those of the node, which gives every shard a share of every source as a random deal of all blocks would, but
from a few numbers. Each shard then owns a run of every source's permuted blocks, disjoint from the others',
and orders its blocks by another hash. Same seed, same mix.

Defined results: a null text has no words and is taken with the blocks of its source; null sources are one source, after all
others; sources without words get nothing; repeated rows are blocks of their own; an empty table gives an empty mix. Other columns are ignored.
The driver sees one row per source, and one per range of blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbgauge.llm.common import cut, numbered, unfolded, whole, word_count

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST = 3


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Share of the whole for each source by weight; what a source cannot hold goes to the others by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free -= over
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Per shard the number of blocks of each source; columns add up to ``quotas``, rows to equal numbers within one."""
    def down(counts: np.ndarray, first: int, n: int, rng_key: tuple) -> list[list[int]]:
        if n == 1:
            return [counts.tolist()]
        left = n // 2
        rng = np.random.default_rng([seed, *rng_key])
        total = int(counts.sum())
        drawn, want, rest = np.zeros_like(counts), total * left // n, total
        for i, c in enumerate(counts.tolist()):  # source after source: the multivariate draw
            if not want:
                break
            drawn[i] = _draw(rng, c, rest - c, want)
            want, rest = want - int(drawn[i]), rest - c
        return down(drawn, first, left, (*rng_key, 0)) + down(counts - drawn, first + left, n - left, (*rng_key, 1))
    return down(np.array(quotas, dtype=np.int64), 0, shards, ())


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric draw; beyond the generator's range by its normal limit, which is then exact to a millionth."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    share = good / (good + bad)
    spread = (n * share * (1 - share) * (good + bad - n) / (good + bad - 1)) ** 0.5
    return int(min(max(round(rng.normal(n * share, spread)), n - bad, 0), good, n))


def plan(sized: DataFrame) -> list[dict]:
    """Per source: its size and target in words, by code point of its name, null last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(rows))]
    return [{"source": r["source"], "size": r["size"], "target": t}
            for r, t in zip(rows, targets([r["size"] for r in rows], weights))]


def _key(id_col: str, text_col: str, seed: int):
    return F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))


def _permuted(narrow: DataFrame) -> DataFrame:
    """Rows with ``row`` (their number), ``block`` (their place in their source's permuted order) and the words of the source before them."""
    ranked = cut(numbered(narrow.withColumn("missing", F.col("source").isNull()), ["missing", "source", "key", "doc_id"]))
    n = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a stretch has a bounded number of rows; what lies before it in its source comes from a table of one row per stretch and source
    width = max(1, -(-ranked.count() // n))
    ranked = ranked.withColumn("stretch", F.floor(F.col("_rank") / width).cast("long"))
    per = ranked.groupBy("stretch", "source").agg(F.sum("size").alias("words"), F.min("_rank").alias("row"))
    so_far = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = per.select(F.col("stretch").alias("_t"), F.col("source").alias("_s"), (F.sum("words").over(so_far) - F.col("words")).alias("base"),
                      F.min("row").over(Window.partitionBy("source")).alias("first"))
    inside = Window.partitionBy("stretch", "source").orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("inside", F.sum("size").over(inside)).join(
        base, (F.col("stretch") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("_rank").alias("row"), "doc_id", "key", "size", "source", (F.col("_rank") - F.col("first")).alias("block"),
        (F.col("base") + F.col("inside") - F.col("size")).alias("words_before"))


def allot(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its size, its source's size and target, how many whole passes take it, and its words in the part pass."""
    sized = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"),
                        _key(id_col, text_col, seed).alias("key"))
    ranked = cut(_permuted(sized))
    rows = []
    for i, known in enumerate(plan(ranked)):
        whole, part = divmod(int(round(known["target"])), known["size"]) if known["size"] else (0, 0)
        rows.append((i, known["source"], known["size"], known["target"], whole, part))
    sources = docs.sparkSession.createDataFrame(rows, "source_no int, _name string, source_size long, target double, whole int, part_words long")
    part = F.least(F.greatest(F.col("part_words") - F.col("words_before"), F.lit(0)), F.col("size"))
    return ranked.join(sources, F.col("source").eqNullSafe(F.col("_name"))).select(
        "row", "doc_id", "key", "size", "source_no", "source_size", "target", "whole", part.alias("part"), "block")


def blocks(allotted: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """One row per block taken: its document's ``row`` and ``key``, the pass, the words taken, the output shard and the order there.

    Pass 0 is the part pass. ``allotted`` is what ``allot`` gives, cut from its lineage.
    """
    spark = allotted.sparkSession
    passes = F.concat(F.array(F.struct(F.lit(0).alias("pass"), F.col("part").alias("taken"))),
                      F.transform(F.sequence(F.lit(1), F.lit(MOST)), lambda p: F.struct(p.alias("pass"), F.col("size").alias("taken"))))
    wanted = F.filter(passes, lambda p: (p["taken"] > 0) & (p["pass"] <= F.col("whole")))
    taken = allotted.select("row", "key", "source_no", "block", F.explode(wanted).alias("p")).select(
        "row", "key", "source_no", "block", "p.pass", "p.taken")
    # blocks are numbered through the passes of their source; documents without words leave gaps, which nothing falls into
    lengths = {(r["source_no"], r["pass"]): r["n"] for r in
               taken.groupBy("source_no", "pass").agg((F.max("block") + 1).alias("n")).collect()}
    sources = 1 + max((i for i, _ in lengths), default=-1)
    before, quotas = [], []
    for i in range(sources):
        total = 0
        for p in range(MOST + 1):
            before.append((i, p, total))
            total += lengths.get((i, p), 0)
        quotas.append(total)
    dealt = split_quotas(quotas, shards, seed)
    bounds = [(i, [sum(dealt[s][i] for s in range(t + 1)) for t in range(shards)]) for i in range(sources)]
    before = spark.createDataFrame(before, "source_no int, pass int, before long")
    bounds = spark.createDataFrame(bounds, "source_no int, bounds array<long>")
    number = F.col("before") + F.col("block")
    return taken.join(before, ["source_no", "pass"]).join(bounds, "source_no").select(
        "row", "key", "pass", "taken", F.size(F.filter("bounds", lambda b: b <= number)).alias("shard"),
        F.xxhash64(F.lit(seed + 1), "row", "pass").alias("place"))


def taken_words(docs: DataFrame, shards: int = 16, seed: int = 0, **columns) -> DataFrame:
    """Per document: doc_id, size, source_size, target, ``taken``, the words of all its blocks in the mix, and ``blocks``: the shard the tree deals each to, its pass and words."""
    allotted = cut(allot(docs, seed, **columns))
    # a document has a block for each pass at most
    taken = blocks(allotted, shards, seed).groupBy("row").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_list(F.struct("pass", "shard", F.col("taken").alias("words")))).alias("blocks"))
    none = F.array().cast("array<struct<pass:int,shard:int,words:bigint>>")
    return allotted.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("blocks", none).alias("blocks"))


def mixed_documents(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document once per block taken, the last block of a source cut to its first words.

    Shard after shard, each ordered by hash. Rows that are wholly equal are told apart by number.
    """
    allotted = cut(allot(docs, seed, id_col, text_col, source_col))
    taken = blocks(allotted, shards, seed)
    alike = Window.partitionBy("_key").orderBy("_row")
    chosen = taken.select(F.col("key").alias("_key"), F.col("row").alias("_row"), F.struct("shard", "place", "pass", "taken").alias("b"))
    chosen = chosen.groupBy("_key", "_row").agg(F.collect_list("b").alias("blocks")).withColumn("nth", F.row_number().over(alike))
    rows = docs.select(whole(docs), _key(id_col, text_col, seed).alias("_key"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    out = rows.join(chosen, ["_key", "nth"]).withColumn("b", F.explode("blocks"))
    words = F.regexp_extract_all(F.col("_text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    start = F.array_join(F.slice(words, F.lit(1), F.col("b.taken").cast("int")), "")
    text = F.when(F.col("b.pass") == 0, start).otherwise(F.col("_text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, "b.shard", "b.place").sortWithinPartitions("b.shard", "b.place").select(*unfolded(docs.columns, **{text_col: text}))
