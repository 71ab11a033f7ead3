"""Pairs of nearly equal texts within a column, found by equality joins at any number of values and for values of any kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgauge.functions.text import near_spelling
from plumbgauge.session import stored

_PIECES, _EDITS = 3, 2
#: Texts of at most SHORT characters meet by what two deletions leave of them; so do those of at most LONG that share a piece with more than HOT others.
SHORT, LONG, HOT = 24, 160, 256


def _piece(text: Column, length: Column, i: Column, shift: Column) -> Column:
    """Piece ``i`` of the thirds of a text of ``length``, read from ``text`` at its place moved by ``shift``; null beyond the ends."""
    start = F.floor(length * i / _PIECES).cast("int") + shift
    size = F.floor(length * (i + 1) / _PIECES).cast("int") - F.floor(length * i / _PIECES).cast("int")
    return F.when((start >= 0) & (start + size <= F.length(text)), F.substr(text, start + 1, size))


def _shifts(i: int, less: int) -> range:
    """By how much piece ``i`` of a text that is shorter by ``less`` need be moved to be looked for.

    At most ``i`` edits before an unchanged piece and the rest of them behind it: where there are more before it, an earlier piece is unchanged, and
    where there are more behind it, a later one is.
    """
    behind = _EDITS - i
    return range(max(-i, less - behind), min(i, less + behind) + 1)


def _without_two(text: Column) -> Column:
    """Hashes of ``text`` and of what is left of it without any one or two characters, each once.

    Two texts that are two edits apart share one of them, for each edit is undone by a deletion on one side or both. So what is met
    is near or at most four edits off, however many texts look alike: no key is shared by more than the ways to put two characters back.
    """
    size = F.length(text)

    def one(i: Column) -> Column:
        return F.transform(F.sequence(F.least(i + 1, size), size), lambda j: F.xxhash64(F.concat(
            F.substr(text, F.lit(1), i), F.substr(text, i + 2, F.greatest(j - i - 1, F.lit(0))), F.substr(text, j + 2))))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), size), one)))


def _met_without_two(texts: DataFrame) -> DataFrame:
    keyed = texts.select("id", F.explode(F.transform(_without_two(F.col("low")), lambda h: F.xxhash64("column_name", h))).alias("key"))
    return keyed.withColumnRenamed("id", "id_a").join(keyed.withColumnRenamed("id", "id_b"), "key").filter("id_a < id_b").select("id_a", "id_b")


def _piece_keys(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id_a, size) and (key, id_b, size_b): near texts are at most two edits apart, so of three pieces of the shorter one is found unchanged
    in the longer, moved by one of ``_shifts``: 3 keys a text on one side, 12 on the other."""
    def keyed(name: str, size: str, choices: list[tuple[int, int, int]]) -> DataFrame:
        # a row per choice first, so that one short expression makes all keys: twelve of them in an array are too much code to be compiled
        every = texts.select(F.col("id").alias(name), F.length("low").alias(size), "column_name", "low",
                             F.inline(F.array(*[F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in choices])))
        length = F.col(size) - F.col("less")
        piece = _piece(F.col("low"), length, F.col("i"), F.col("shift"))
        return every.withColumn("piece", piece).filter("piece IS NOT NULL").select(name, size, F.xxhash64("column_name", length, "i", "piece").alias("key"))

    return (keyed("id_a", "size", [(0, i, 0) for i in range(_PIECES)]),
            keyed("id_b", "size_b", [(less, i, shift) for less in range(_EDITS + 1) for i in range(_PIECES) for shift in _shifts(i, less)]))


def _ordered(met: DataFrame) -> DataFrame:
    return met.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def near_text_pairs(values: DataFrame) -> DataFrame:
    """(column_name, low_a, low_b), low_a < low_b, for the near spellings among distinct ``(column_name, low)``.

    Short texts meet by deletions, so that codes and formatted numbers, which share their pieces by the thousand, meet only those they are near to. Longer
    ones meet by pieces; a piece that more than ``HOT`` texts have is left out, and its texts meet by deletions as well, up to ``LONG`` characters. Texts of
    under four characters have no near spelling. What meets are hashes; each pair of texts is measured once. ``values`` is read several times.
    """
    named, size = values.select("column_name", "low").filter(F.length("low") >= 3).withColumn("id", F.xxhash64("column_name", "low")), F.length("low")
    few = _met_without_two(named.filter(size <= SHORT + _EDITS))
    longer = named.filter(size > SHORT)
    short, long = _piece_keys(longer)
    hot = short.filter(F.col("size") <= LONG).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT).select("key", F.lit(True).alias("_hot"))
    hot = stored(hot, "hot")
    if hot.isEmpty():  # the usual case: nothing to leave out
        ids = few.unionAll(_ordered(short.join(long, "key")))
    else:
        # whatever the pieces, texts longer than LONG stay with them
        met = short.join(hot, "key", "left").filter(F.col("_hot").isNull() | (F.col("size") > LONG)).join(long, "key")
        crowded = longer.join(long.filter(F.col("size_b") <= LONG + _EDITS).join(hot, "key", "left_semi").select(F.col("id_b").alias("id")).distinct(), "id", "left_semi")
        ids = few.unionAll(_ordered(met)).unionAll(_met_without_two(crowded))
    ids = ids.distinct()
    a = named.select(F.col("id").alias("id_a"), "column_name", F.col("low").alias("a"))
    b = named.select(F.col("id").alias("id_b"), F.col("column_name").alias("_column"), F.col("low").alias("b"))
    told = ids.join(a, "id_a").join(b, "id_b").filter((F.col("column_name") == F.col("_column")) & (F.col("a") != F.col("b")) & near_spelling(F.col("a"), F.col("b")))
    return told.select("column_name", F.least("a", "b").alias("low_a"), F.greatest("a", "b").alias("low_b"))
