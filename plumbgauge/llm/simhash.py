"""Near-duplicate documents by SimHash.

A fingerprint has 64 bits. Its embedding counts the set bits of 32 two-bit segments; the
Manhattan distance of two embeddings never exceeds the number of bits in which the
fingerprints differ. The segments are laid in ``bands``. Of fingerprints at most ``distance``
bits apart, the embeddings agree wholly in all but ``distance`` bands, so each embedding is
put into one grid cell for every choice of ``bands - distance`` bands and meets the others of
its cell. There the Manhattan distance sorts most out, and the exact bit distance decides.

Defined results: a null or empty text has fingerprint zero, which links like any other;
a row without doc_id keeps its fingerprint and gets the component of its fingerprint, named by
the smallest doc_id in it (null if none has one); repeated rows are returned as they are; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgauge.llm.common import components, cut, ship, unfolded, whole

SEGMENTS = 32
#: Ways to lay out the bands; each finds every pair. More bands mean more cells per fingerprint and fewer strangers in them.
EXTRA_BANDS = (2, 3, 4, 5, 6)
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Majority of the bits of the hashed word shingles; A-Z count as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK])], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, row, fp) of every row: ``row`` is a hash of id and text, ``fp`` a signed long."""
    kind = docs.schema[id_col].dataType
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], names=["doc_id", "row", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), _row(id_col, text_col).alias("row"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, row long, fp long")


def _embedding(fp: Column) -> Column:
    """32 counts of 0 to 2, two bits each, in one long."""
    odd = 0x5555555555555555
    upper = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(odd), 1).bitwiseOR(fp.bitwiseXOR(upper).bitwiseAND(odd))


def _manhattan(a: Column, b: Column) -> Column:
    """Distance of two embeddings: in a field, 01 and 11 differ by one, 10 by two."""
    odd = 0x5555555555555555
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(odd), F.shiftrightunsigned(x, 1).bitwiseAND(odd)
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _band_masks(bands: int) -> list[int]:
    edges = [round(i * SEGMENTS / bands) for i in range(bands + 1)]
    return [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(edges, edges[1:])]


def choose_bands(n: int, distance: int) -> int:
    """Number of bands with the least work for ``n`` different fingerprints: cells written against strangers met."""
    def work(extra: int) -> float:
        bands = distance + extra
        cells = comb(bands, extra)
        agree = (3 / 8) ** (SEGMENTS * extra / bands)  # two random two-bit segments hold equally many bits
        return n * cells + 0.02 * n * n / 2 * cells * agree
    return distance + min(EXTRA_BANDS, key=work)


def links(prints: DataFrame, distance: int = 4, bands: int | None = None) -> DataFrame:
    """(a, b) for fingerprints ``fp`` of the table at most ``distance`` bits apart, each pair once, a < b."""
    bands = bands or choose_bands(prints.count(), distance)
    masks = _band_masks(bands)
    cells = []
    for chosen in combinations(range(bands), bands - distance):
        mask = sum(masks[i] for i in chosen)
        # a pair is reported in the first cell it shares: no band skipped before the last chosen one may agree
        skipped = sum(1 << i for i in range(chosen[-1]) if i not in chosen)
        cells.append(F.struct(F.lit(len(cells)).alias("choice"), F.lit(skipped).alias("skipped"),
                              F.col("e").bitwiseAND(_signed(mask)).alias("cell")))
    placed = prints.select("fp", _embedding(F.col("fp")).alias("e")).select("fp", "e", F.explode(F.array(*cells)).alias("c")).select(
        "fp", "e", "c.choice", "c.skipped", "c.cell")
    a, b = placed.alias("a"), placed.alias("b")
    differ = F.col("a.e").bitwiseXOR(F.col("b.e"))
    first = F.lit(True)
    for i, mask in enumerate(masks):
        first = first & ((F.col("a.skipped").bitwiseAND(1 << i) == 0) | (differ.bitwiseAND(_signed(mask)) != 0))
    near = ((F.col("a.choice") == F.col("b.choice")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
            & (_manhattan(F.col("a.e"), F.col("b.e")) <= distance)
            & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance) & first)
    return a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int, bands: int | None) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the rows, and of each fingerprint its component, named by one of its fingerprints, and its smallest doc_id."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    group = components(links(distinct.select("fp"), distance, bands))
    return prints, cut(distinct.join(group, distinct.fp == group.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    distance: int = 4, bands: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links)."""
    prints, members = _grouped(docs, id_col, text_col, shingle, distance, bands)
    named = members.groupBy("component").agg(F.min("first").alias("component_id"))
    named = members.join(named, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
             distance: int = 4, bands: int | None = None) -> DataFrame:
    """``docs`` with the first document of each component only: by doc_id, rows without one last, then by a hash; of wholly equal rows one."""
    prints, members = _grouped(docs, id_col, text_col, shingle, distance, bands)
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    per_print = prints.groupBy("fp").agg(F.min(place).alias("p"))
    kept = per_print.join(members.select("fp", "component"), "fp").groupBy("component").agg(F.min("p").alias("p")).select(F.col("p.c").alias("_row"))
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    rows = docs.select(whole(docs), _row(id_col, text_col).alias("_row")).join(cut(kept), "_row", "left_semi")
    return rows.withColumn("nth", nth).where("nth = 1").select(*unfolded(docs.columns))
