"""Deterministic dirty views over the supplied tables, which hold no nulls themselves.

The expressions are plain SQL that Spark and other SQL engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.catalogue.registry import Tables
from plumbgauge.session import materialise, spread

_PRICE = "(CAST(5 AS DOUBLE) + (k % 200) * CAST(0.25 AS DOUBLE))"
DIRTY_SALES = {
    "sale_id": "k",
    "sale_date": "CASE WHEN k % 97 = 0 THEN 'not a date' WHEN k % 89 = 0 THEN NULL "
                 "ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END",
    "region": "CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 'unknown' WHEN k % 19 = 0 THEN lower(r_name) "
              "WHEN k % 23 = 0 THEN concat(' ', r_name, ' ') WHEN k % 29 = 0 AND r_name = 'AFRICA' THEN 'AFRICCA' "
              "ELSE r_name END",
    "channel": "CASE k % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'Retail' ELSE 'WHOLESALE' END",
    "units_sold": "CASE WHEN k % 31 = 0 THEN NULL WHEN k % 37 = 0 THEN -5 ELSE 1 + k % 50 END",
    "unit_price": f"CASE WHEN k % 41 = 0 THEN NULL ELSE {_PRICE} END",
    "revenue": f"CASE WHEN k % 11 = 0 THEN NULL WHEN k % 997 = 0 THEN CAST(1000000 AS DOUBLE) "
               f"ELSE (1 + k % 50) * {_PRICE} END",
    "cogs": f"CASE WHEN k % 43 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) * (1 + k % 50) * {_PRICE} END",
    "profit": f"CASE WHEN k % 47 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) * (1 + k % 50) * {_PRICE} END",
    "margin": "CASE WHEN k % 53 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END",
    "promo_active": "CASE WHEN k % 59 = 0 THEN NULL WHEN k % 4 = 0 THEN 'Yes' WHEN k % 4 = 1 THEN 'no' "
                    "WHEN k % 4 = 2 THEN ' TRUE' ELSE 'f' END",
    "customer_gender": "CASE k % 5 WHEN 0 THEN 'f' WHEN 1 THEN 'Male' WHEN 2 THEN 'FEMALE' WHEN 3 THEN 'm ' "
                       "ELSE CASE WHEN k % 2 = 0 THEN 'non  binary' ELSE 'gender-fluid' END END",
    "customer_age": "CASE WHEN k % 61 = 0 THEN 150 WHEN k % 67 = 0 THEN NULL ELSE 18 + k % 60 END",
    "amount_text": "CASE WHEN k % 71 = 0 THEN 'n/a' ELSE concat('$', CAST(1 + k % 9 AS STRING), ',', "
                   "lpad(CAST(k % 1000 AS STRING), 3, '0'), '.50') END",
    "product_type": "CASE WHEN k % 2 = 0 THEN 'craft ipa' ELSE 'pale  ALE abv' END",
    "empty_col": "CAST(NULL AS STRING)",
}


def dirty_sales(t: Tables) -> DataFrame:
    """Sales rows with nulls, misspellings, impossible and formatted values; some rows occur twice."""
    base = (spread(t.orders).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("o_orderkey").alias("k"), "o_orderdate", "r_name"))
    copies = F.when(F.col("k") % 101 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = base.withColumn("_copy", F.explode(copies))
    return rows.select(*[F.expr(e).alias(c) for c, e in DIRTY_SALES.items()])


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_Y, _M, _D = "CAST(year(o_orderdate) AS STRING)", "CAST(month(o_orderdate) AS STRING)", "CAST(day(o_orderdate) AS STRING)"
_MM, _DD = f"lpad({_M}, 2, '0')", f"lpad({_D}, 2, '0')"
_NAME = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTHS, 1)) + " END"
# One column in eleven formats, one wholly in month/day/year, one that is a date by its name only.
ODD_DATES = {
    "order_key": "o_orderkey",
    "order_date": f"CASE o_orderkey % 12 WHEN 0 THEN concat({_Y}, '-', {_M}, '-', {_D}) WHEN 1 THEN concat({_M}, '/', {_D}, '/', {_Y}) "
                  f"WHEN 2 THEN concat({_MM}, '/', {_DD}, '/', substr({_Y}, 3, 2)) WHEN 3 THEN concat(substr({_NAME}, 1, 3), ' ', {_D}, ', ', {_Y}) "
                  f"WHEN 4 THEN concat({_D}, ' ', {_NAME}, ' ', {_Y}) WHEN 5 THEN concat({_Y}, {_MM}, {_DD}) WHEN 6 THEN concat({_Y}, '-', {_MM}, '-', {_DD}, ' 10:00') "
                  f"WHEN 7 THEN concat({_Y}, '-', {_MM}, '-', {_DD}, 'T10:00:00Z') WHEN 8 THEN concat({_Y}, '-', {_MM}, '-', {_DD}, ' 10:00:00.123456') "
                  f"WHEN 9 THEN concat({_Y}, '/', {_MM}, '/', {_DD}) WHEN 10 THEN concat({_DD}, '.', {_MM}, '.', {_Y}) ELSE 'soon' END",
    "update_date": f"concat({_M}, '/', {_D}, '/', {_Y})",
    "sentiment": "CASE WHEN o_orderkey % 3 = 0 THEN 'good' WHEN o_orderkey % 3 = 1 THEN 'bad' END",
}
ODD_DATES_SQL = "odd_dates AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in ODD_DATES.items()) + " FROM orders)"


def odd_dates(t: Tables) -> DataFrame:
    return spread(t.orders).select(*[F.expr(e).alias(c) for c, e in ODD_DATES.items()])


# A brand column with 1,000 or more values, of which every fiftieth also occurs misspelt.
BRANDS_SQL = ("brands AS (SELECT o_orderkey AS item_id, md5(CAST(o_orderkey AS STRING)) AS brand FROM orders UNION ALL "
              "SELECT o_orderkey, concat('x', md5(CAST(o_orderkey AS STRING))) FROM orders WHERE o_orderkey % 50 = 7)")


def brands(t: Tables) -> DataFrame:
    plain = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    orders = t.orders.select("o_orderkey", plain.alias("brand"))
    wrong = orders.filter("o_orderkey % 50 = 7").select("o_orderkey", F.concat(F.lit("x"), "brand").alias("brand"))
    return orders.unionAll(wrong).withColumnRenamed("o_orderkey", "item_id")


def stored_sales(t: Tables) -> DataFrame:
    """The same rows written once, for operators that pass over them many times."""
    return materialise(dirty_sales(t), "dirty_sales")


_EXPRESSIONS = ", ".join(f"{e} AS {c}" for c, e in DIRTY_SALES.items())
DIRTY_SALES_SQL = f"""base AS (SELECT o_orderkey AS k, o_orderdate, r_name FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey),
  one_copy AS (SELECT {_EXPRESSIONS} FROM base),
  dirty_sales AS (SELECT * FROM one_copy UNION ALL SELECT * FROM one_copy WHERE sale_id % 101 = 0)"""


def with_dirty(body: str, *more: str) -> str:
    """Reference SQL over the dirty sales rows, with further named steps."""
    return "WITH " + ",\n  ".join([DIRTY_SALES_SQL, *more]) + "\n" + body


# Transcript with gaps: some roles are swapped, so that user turns meet and answers lose their question.
GAPPY_ROLE = ("CASE WHEN (conv_id * 3 + turn) % 5 = 2 THEN CASE WHEN role = 'user' THEN 'assistant' ELSE 'user' END "
              "ELSE role END")


def gappy_conversations(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.expr(GAPPY_ROLE).alias("role"), "text")


GAPPY_SQL = f"gappy AS (SELECT conv_id, turn, {GAPPY_ROLE} AS role, text FROM conversations)"

# Documents in which every other text has blank lines between its paragraphs.
SPACED_TEXT = "CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), concat(chr(10), chr(10))) ELSE text END"


def spaced_documents(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", F.expr(SPACED_TEXT).alias("text"))
