"""What several of these operators need: words, recovery points, splits of a hot group, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

import plumbgauge
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints to the shared folder the cluster names; only a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="checkpoints-")
        configured = _LOCAL[context.applicationId]
    context.setCheckpointDir(configured)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, whatever executors are lost.

    Spark drops shuffle files when the driver collects the plan that made them, so that is asked for here:
    a chain of such steps then needs the disk of its largest step, not of their sum.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint()
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def ship(spark: SparkSession) -> None:
    """Send this library to the Python workers, once per application, so that they can import it wherever they run."""
    context = spark.sparkContext
    mark = f"py-{context.applicationId}"
    if mark in _LOCAL:
        return
    top = os.path.dirname(plumbgauge.__file__)
    _LOCAL[mark] = archive = os.path.join(tempfile.mkdtemp(prefix="library-"), "plumbgauge.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("plumbgauge", os.path.relpath(path, top)))
    context.addPyFile(archive)


def present(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: Bits of the filter of ``maybe_among``: 2 MB at most are broadcast.
FILTER_BITS = 1 << 23


def maybe_among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: true if the long in ``column`` is among the ``lid`` of ``ids``, seldom true otherwise.

    A bitmap of fixed size. The more ids, the less it rules out; what it lets through is to be joined with ``ids``.
    """
    bit = F.pmod("lid", F.lit(FILTER_BITS))
    bits = ids.groupBy(F.shiftright(bit, 6).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(lid, {FILTER_BITS}) & 63 as int))")).alias("_bits"))
    at = F.pmod(column, F.lit(FILTER_BITS))
    marked = rows.withColumn("_word", F.shiftright(at, 6)).withColumn("_bit", at.bitwiseAND(63).cast("int"))
    marked = marked.join(F.broadcast(bits), "_word", "left")  # FILTER_BITS / 64 rows at most
    return marked.withColumn("_maybe", F.coalesce(F.expr("(shiftrightunsigned(_bits, _bit) & 1) = 1"), F.lit(False))).drop("_word", "_bit", "_bits")


def whole(df: DataFrame) -> Column:
    """All columns of a row in one, so that no name of theirs meets one of an operator's."""
    return F.struct(*[F.col(f"`{name.replace('`', '``')}`") for name in df.columns]).alias("whole")


def unfolded(names: list[str], **replaced: Column) -> list[Column]:
    """The columns that ``whole`` took in, some replaced."""
    return [replaced.get(name, F.col("whole").getField(name)).alias(name) for name in names]


def word_count(text: Column) -> Column:
    """Number of words as long; null counts as empty."""
    return F.regexp_count(present(text), F.lit(WORD)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Large-star and small-star rounds on edge tables until nothing changes. A round keeps no
    more edges than it was given and none is ever gathered in one place: minima are combined
    before the shuffle, and the joins are plain equality joins that Spark splits where skewed.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _fingerprint(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = cut(small)
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def numbered(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``_rank``, its place from 0 in the given order, without ever sorting in one task.

    Rows are dealt out by ranges of the order columns, numbered within each range, and moved
    by the sizes of the ranges before. The ranges come from a sample, so a value that a third
    of the rows hold is split by the columns after it. What the driver sees is one count per range.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                .withColumn("_row", F.monotonically_increasing_id()))
    part, at = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    offsets, total = [], 0
    for row in sizes:
        offsets += [F.lit(row["p"]), F.lit(total)]
        total += row["n"]
    base = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return dealt.withColumn("_rank", (base + at).cast("long")).drop("_row")
