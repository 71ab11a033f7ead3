"""Corpus-wide removal of fuzzy duplicate lines, in DataFrame operations only.

Lines of at least ``min_chars`` characters (after trimming) count as copies when the Jaccard similarity of their sets of
``shingle``-character shingles reaches ``similarity``. Shorter lines are left alone: they repeat by chance.

1. Signature: ``bands * rows`` minima over all shingles, each hashed once. A row orders the hashes by another rotation of their
   bits, so the rows of a band are independent; a band takes from each the hash nearest to a start of its own. Lines alike in all rows of a band share a bucket.
2. Every line of a bucket is checked, exactly and on all its shingles, against the bucket's first line, and the links
   found are joined to components. Then pairs of the same bucket that are still in different components are
   checked. So no pair with a common bucket is lost, yet n copies of a line cost about n checks. The Jaccard distance is a
   metric: two lines whose distances to the bucket's first line differ by more than a link allows need no check.
3. Of each component the first line stays, by doc_id (rows without one last), then a hash of the row, then line number.

Defined results: a null text stays null and an empty one empty, a text all of whose lines go becomes empty, rows that repeat
doc_id and text keep the lines of one of them, an empty table gives no rows. Extra columns stay, whatever their names.
A hot line is pre-aggregated before every shuffle that groups; joins are plain equality joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgauge.llm.common import components, cut, maybe_among, unfolded, whole

BANDS, ROWS = 8, 4
_UTF32 = 4


def _row_names(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumn("_u1", F.xxhash64(id_col, text_col)).withColumn("_u2", F.hash(text_col, id_col))


def lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_doc, _u1, _u2, _no, _line, _lid) of every line that is long enough."""
    split = _row_names(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")), "_doc", "_text").select(
        "_doc", "_u1", "_u2", F.posexplode(F.split("_text", "\n")).alias("_no", "_line"))
    return split.withColumn("_line", F.btrim("_line", F.lit(" \t\r"))).where(F.length("_line") >= min_chars).withColumn(
        "_lid", F.xxhash64("_line"))


def _rotated(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) if bits else h


def _bin(band: int) -> Column:
    """The band's number in the first bits of a long."""
    return F.lit((band if band < BANDS // 2 else band - BANDS) << (64 - BANDS.bit_length() + 1))


def signatures(found: DataFrame, shingle: int) -> DataFrame:
    """(lid, times, keys): how often each different line occurs, and its bucket key per band."""
    last = F.greatest(F.length("_line") - shingle, F.lit(0))
    wide = found.select(F.col("_lid").alias("lid"), last.alias("last"), _wide(F.col("_line")).alias("wide"))
    every = wide.select("lid", "wide", F.explode(F.sequence(F.lit(0), "last")).alias("at"))
    hashed = every.select("lid", "at", _hashed(F.col("wide"), F.col("at"), shingle).alias("h"))
    turned = hashed.select("lid", "at", *[_rotated(F.col("h"), 64 // ROWS * r).alias(f"h{r}") for r in range(ROWS)])
    minima = [F.min(F.col(f"h{r}").bitwiseXOR(_bin(b))).alias(f"m{b}_{r}") for b in range(BANDS) for r in range(ROWS)]
    signed = turned.groupBy("lid").agg(F.count_if(F.col("at") == 0).alias("times"), *minima)
    keys = [F.xxhash64(F.lit(b), *[F.col(f"m{b}_{r}") for r in range(ROWS)]) for b in range(BANDS)]
    return signed.select("lid", "times", F.array(*keys).alias("keys"))


def _stars(signed: DataFrame) -> DataFrame:
    """(band, key, first, lid): every further line of a bucket with the bucket's first."""
    placed = signed.select("lid", F.posexplode("keys").alias("band", "key"))
    first = F.first("lid").over(Window.partitionBy("key").orderBy("lid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("first", first).where("first <> lid")


def _wide(line: Column) -> Column:
    """``line`` with four bytes a character: any piece of it is found without a walk from its start."""
    return F.encode(line, "UTF-32")


def _hashed(wide: Column, at: Column, shingle: int) -> Column:
    return F.xxhash64(F.substring(wide, at * _UTF32 + 1, F.lit(shingle * _UTF32)))


def _shingles(line: Column, shingle: int) -> Column:
    """Hashes of the different shingles of ``line``."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(line) - shingle, F.lit(0)))
    # the outer array holds one value, so that a line is made wide once and not for each of its shingles
    return F.get(F.transform(F.array(_wide(line)), lambda wide: F.array_distinct(F.transform(starts, lambda at: _hashed(wide, at, shingle)))), 0)


def _texts(ids: DataFrame, found: DataFrame) -> DataFrame:
    """(lid, line) of the different lines ``ids``."""
    ids = cut(ids)
    texts = maybe_among(found.select("_lid", "_line"), "_lid", ids).where("_maybe").select(F.col("_lid").alias("lid"), F.col("_line").alias("line")).distinct()
    return cut(texts.join(ids, "lid", "left_semi"))


def compared(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b, d, n): exact Jaccard distance of the lines of each pair, by all their shingles, and the number of shingles of b."""
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("la")), "a").join(
        texts.select(F.col("lid").alias("b"), F.col("line").alias("lb")), "b")
    sets = both.select("a", "b", _shingles(F.col("la"), shingle).alias("sa"), _shingles(F.col("lb"), shingle).alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    counted = sets.select("a", "b", common.alias("i"), F.size("sa").alias("na"), F.size("sb").alias("n"))
    return counted.select("a", "b", (1 - F.col("i") / (F.col("na") + F.col("n") - F.col("i"))).alias("d"), "n")


def line_classes(found: DataFrame, signed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, component) of the different lines that have a near copy."""
    most = 1 - similarity + 1e-9
    stars = cut(_stars(signed))
    texts = _texts(stars.select(F.col("first").alias("lid")).unionByName(stars.select("lid")).distinct(), found)
    tested = cut(compared(stars.select(F.col("first").alias("a"), F.col("lid").alias("b")).distinct(), texts, shingle))
    links = tested.where(F.col("d") <= most).select("a", "b")
    group = components(links)
    members = stars.join(tested, (F.col("first") == F.col("a")) & (F.col("lid") == F.col("b"))).select("band", "key", "lid", "d", "n")
    members = cut(members.join(group, F.col("lid") == F.col("node"), "left").select("band", "key", "lid", "d", "n", F.coalesce("component", "lid").alias("c")))
    mixed = members.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    rest = cut(members.join(mixed, "key", "left_semi"))
    if rest.isEmpty():
        return group
    known = texts.join(rest.select("lid").distinct(), "lid").select("lid", _shingles(F.col("line"), shingle).alias("s")).join(
        signed.select("lid", "keys"), "lid")
    rest = rest.join(known, "lid")
    a, b = rest.alias("a"), rest.alias("b")
    # the check is part of the join, so that pairs which are not alike are never written; a pair is checked in its first common band only
    before = F.exists(F.arrays_zip(F.slice("a.keys", F.lit(1), F.col("a.band")).alias("x"), F.slice("b.keys", F.lit(1), F.col("a.band")).alias("y")),
                      lambda z: z["x"] == z["y"])
    alike = F.size(F.array_intersect("a.s", "b.s")) * (1 + similarity) >= (similarity - 1e-9) * (F.col("a.n") + F.col("b.n"))
    more = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.c") < F.col("b.c")) & (F.abs(F.col("a.d") - F.col("b.d")) <= most)
                  & (F.least("a.n", "b.n") >= (similarity - 1e-9) * F.greatest("a.n", "b.n")) & ~before & alike).select(
        F.col("a.lid").alias("a"), F.col("b.lid").alias("b"))
    return components(links.unionByName(more))


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, min_chars: int) -> DataFrame:
    """(_u1, _u2, _no) of every line that goes."""
    found = lines(docs, id_col, text_col, min_chars)
    signed = cut(signatures(found, shingle))
    group = cut(line_classes(found, signed, shingle, similarity))
    repeated = group.select(F.col("node").alias("lid")).unionByName(signed.where("times > 1").select("lid"))
    place = F.struct(F.col("_doc").isNull().alias("x"), F.col("_doc").alias("d"), F.col("_u1").alias("u1"), F.col("_u2").alias("u2"), F.col("_no").alias("n"))
    told = cut(maybe_among(found.select("_lid", place.alias("p")), "_lid", repeated).where("_maybe").join(group, F.col("_lid") == F.col("node"), "left").select(
        F.coalesce("component", "_lid").alias("c"), "p"))
    stays = told.groupBy("c").agg(F.min("p").alias("stays"), F.count("*").alias("n")).where("n > 1")
    return told.join(stays, "c").where("p <> stays").select(
        F.col("p.u1").alias("_u1"), F.col("p.u2").alias("_u2"), F.col("p.n").alias("_no"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 12, similarity: float = 0.8,
          min_chars: int = 24) -> DataFrame:
    """``docs`` without the lines that repeat, and with ``n_lines_dropped``, the number that went."""
    gone = cut(dropped_lines(docs, id_col, text_col, shingle, similarity, min_chars)).distinct()
    gone = gone.groupBy("_u1", "_u2").agg(F.collect_list("_no").alias("gone"))
    nth = F.row_number().over(Window.partitionBy("_u1", "_u2").orderBy("_u1"))
    told = _row_names(docs.select(whole(docs), F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")), "_doc", "_text")
    told = told.join(gone, ["_u1", "_u2"], "left").withColumn("nth", nth).withColumn("lines", F.split("_text", "\n"))
    every = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.length(F.btrim(F.get(F.col("lines"), i), F.lit(" \t\r"))) >= min_chars)
    told = told.withColumn("gone", F.when(F.col("nth") > 1, every).otherwise(F.col("gone")))
    number = F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0))
    kept = F.array_join(F.filter("lines", lambda line, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(number > 0, kept).otherwise(F.col("_text"))
    return told.select(*unfolded(docs.columns, **{text_col: text}), number.cast("long").alias("n_lines_dropped"))
