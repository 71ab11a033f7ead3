"""Queries: recommendations, cleaning steps, quality score, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.catalogue.fixtures import BRANDS_SQL, DIRTY_SALES, ODD_DATES_SQL, brands, dirty_sales, odd_dates, stored_sales, with_dirty
from plumbgauge.catalogue.profiling import FORMATTED, SALES_NUMERIC, SALES_TEXT, union
from plumbgauge.catalogue.registry import Tables, query
from plumbgauge.functions import lexicon as L
from plumbgauge.functions import parsing
from plumbgauge.functions.text import standard_gender, strip, title_case
from plumbgauge.operators import clean as C
from plumbgauge.operators import quality as Q
from plumbgauge.operators import recommend as R
from plumbgauge.plans.stats import local_rows
from plumbgauge.sources.sql import run_sql

ALL = list(DIRTY_SALES)
ROLES = {"sale_id": "IDENTIFIER", "sale_date": "DATE", "region": "DIMENSION", "channel": "DIMENSION",
         "units_sold": "BUSINESS_METRIC", "unit_price": "BUSINESS_METRIC", "revenue": "BUSINESS_METRIC",
         "cogs": "BUSINESS_METRIC", "profit": "BUSINESS_METRIC", "margin": "BUSINESS_METRIC",
         "promo_active": "DIMENSION", "customer_gender": "DIMENSION", "customer_age": "ATTRIBUTE",
         "amount_text": "BUSINESS_METRIC", "product_type": "DIMENSION", "empty_col": "DIMENSION"}
METRICS = [c for c in SALES_NUMERIC if ROLES[c] not in ("IDENTIFIER", "DATE")]
ACTIONS = (["clean_invalid_values:units_sold", "clean_invalid_values:customer_age", "flag_outliers:revenue",
            "impute_missing:region:Unknown", "impute_missing:promo_active:Unknown", "impute_missing:customer_age:median",
            "merge_categories:region"])


# --- recommendations ----------------------------------------------------------------------


def _missing_sql(source: str) -> str:
    fill = {"DIMENSION": "Unknown", "ATTRIBUTE": "median"}
    return union([f"SELECT 'impute_missing:{c}:{fill[ROLES[c]]}' AS rec_id, 'impute_missing' AS rec_type, '{c}' AS column_name, "
                  f"'minor' AS severity, count(*) - count({c}) AS affected_rows FROM {source} HAVING count(*) > count({c})"
                  for c in ALL if ROLES[c] in fill])


def fence_sql(source: str, columns: list[str], factor: float) -> str:
    """Reference SQL: outlier fences per column."""
    return union([f"SELECT '{c}' AS column_name, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
                  f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, {factor} AS factor FROM {source}" for c in columns])


def _outlier_rec_sql(source: str, columns: list[str], fence: str = "fence") -> str:
    return union([f"SELECT 'flag_outliers:{c}' AS rec_id, 'flag_outliers' AS rec_type, '{c}' AS column_name, 'minor' AS severity, "
                  f"count(*) AS affected_rows FROM {source}, {fence} f WHERE f.column_name = '{c}' AND f.q3 > f.q1 AND "
                  f"({c} < f.q1 - 3 * (f.q3 - f.q1) OR {c} > f.q3 + 3 * (f.q3 - f.q1)) HAVING count(*) > 0" for c in columns])


_NEGATIVE = [c for c in SALES_NUMERIC if any(w in c for w in L.NEGATIVE_WORDS)]
_INVALID_SQL = union(
    [f"SELECT 'clean_invalid_values:{c}' AS rec_id, 'clean_invalid_values' AS rec_type, '{c}' AS column_name, 'major' AS severity, "
     f"count(*) AS affected_rows FROM dirty_sales WHERE {c} < 0 HAVING count(*) > 0" for c in _NEGATIVE]
    + ["SELECT 'clean_invalid_values:customer_age', 'clean_invalid_values', 'customer_age', 'major', count(*) FROM dirty_sales "
       "WHERE customer_age < 0 OR customer_age > 120 HAVING count(*) > 0",
       "SELECT 'clean_invalid_values:sale_date', 'clean_invalid_values', 'sale_date', 'major', count(*) FROM dirty_sales "
       "WHERE sale_date IS NOT NULL AND try_strptime(sale_date, '%Y-%m-%d') IS NULL HAVING count(*) > 0"])


def _variants_sql(source: str, columns: list[str]) -> str:
    """Most frequent spelling per lower-case form, for columns of two or more values."""
    counted = union([f"SELECT '{c}' AS column_name, CAST({c} AS STRING) AS value, count(*) AS n FROM {source} "
                     f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns])
    return (f"counted AS ({counted}), small AS (SELECT column_name FROM counted GROUP BY column_name HAVING count(*) >= 2), "
            "leaders AS (SELECT * FROM (SELECT *, regexp_replace(lower(value), '^\\s+|\\s+$', '', 'g') AS low, row_number() OVER "
            "(PARTITION BY column_name, regexp_replace(lower(value), '^\\s+|\\s+$', '', 'g') ORDER BY n DESC, value) AS r FROM counted "
            "WHERE column_name IN (SELECT column_name FROM small)) WHERE r = 1), "
            "merges AS (SELECT a.column_name, a.value AS kept, b.value AS replaced, b.n AS n FROM leaders a JOIN leaders b ON "
            "a.column_name = b.column_name AND (a.n > b.n OR (a.n = b.n AND a.value < b.value)) WHERE levenshtein(a.low, b.low) <= 2 "
            "AND levenshtein(a.low, b.low) < 0.3 * greatest(length(a.low), length(b.low)))")


_CATEGORY_REC_SQL = ("SELECT concat('merge_categories:', column_name) AS rec_id, 'merge_categories' AS rec_type, column_name, "
                     "'minor' AS severity, count(*) AS affected_rows FROM merges GROUP BY column_name")
_DIMENSIONS = [c for c in ALL if ROLES[c] == "DIMENSION"]
_REC = ["rec_id", "rec_type", "column_name", "severity", "affected_rows"]


@query("rec_missing", with_dirty(_missing_sql("dirty_sales")))
def rec_missing(t: Tables) -> DataFrame:
    return R.rec_missing(dirty_sales(t)).select(_REC)


@query("rec_outliers", with_dirty(
    "SELECT * FROM (" + _outlier_rec_sql("dirty_sales", METRICS) + ") UNION ALL " + _outlier_rec_sql("events", ["value"], "event_fence"),
    f"fence AS ({fence_sql('dirty_sales', METRICS, 3.0)})", f"event_fence AS ({fence_sql('events', ['value'], 3.0)})"))
def rec_outliers(t: Tables) -> DataFrame:
    return R.rec_outliers(stored_sales(t)).unionAll(R.rec_outliers(t.events)).select(_REC)


@query("rec_invalid", with_dirty(_INVALID_SQL))
def rec_invalid(t: Tables) -> DataFrame:
    return R.rec_invalid(dirty_sales(t)).select(_REC)


@query("rec_categories", with_dirty(_CATEGORY_REC_SQL, _variants_sql("dirty_sales", _DIMENSIONS)))
def rec_categories(t: Tables) -> DataFrame:
    return R.rec_categories(dirty_sales(t)).select(_REC)


@query("recommendations", with_dirty(
    f"SELECT * FROM ({_missing_sql('dirty_sales')}) UNION ALL SELECT * FROM ({_outlier_rec_sql('dirty_sales', METRICS)}) "
    f"UNION ALL SELECT * FROM ({_INVALID_SQL}) UNION ALL {_CATEGORY_REC_SQL}",
    f"fence AS ({fence_sql('dirty_sales', METRICS, 3.0)})", _variants_sql("dirty_sales", _DIMENSIONS)))
def recommendations(t: Tables) -> DataFrame:
    return R.recommendations(stored_sales(t)).select(_REC)


@query("rec_categories_many", f"WITH {BRANDS_SQL} SELECT 'merge_categories:brand' AS rec_id, 'merge_categories' AS rec_type, 'brand' AS column_name, "
                              "'minor' AS severity, count(*) AS affected_rows FROM brands WHERE item_id % 50 = 7 AND substr(brand, 1, 1) <> 'x'")
def rec_categories_many(t: Tables) -> DataFrame:
    return R.rec_categories(brands(t)).select(_REC)


@query("auto_approve", with_dirty("SELECT 'sales' AS table_name, false AS approved UNION ALL SELECT 'brands', true"))
def auto_approve(t: Tables) -> DataFrame:
    """Sales rows hold invalid values, which need approval; brand names do not."""
    rows = [("sales", R.auto_approve(R.rec_invalid(dirty_sales(t)))), ("brands", R.auto_approve(R.recommendations(brands(t))))]
    return local_rows(t.spark, "table_name string, approved boolean", rows)


@query("merge_categories_many", f"WITH {BRANDS_SQL} SELECT item_id, CASE WHEN item_id % 50 = 7 THEN md5(CAST(item_id AS STRING)) ELSE brand END AS brand FROM brands")
def merge_categories_many(t: Tables) -> DataFrame:
    """Of two equally frequent spellings the smaller one stays."""
    return C.merge_categories(brands(t), ["brand"])


# --- single cleaning steps ----------------------------------------------------------------


@query("drop_duplicates", with_dirty("SELECT DISTINCT * FROM dirty_sales"))
def drop_duplicates(t: Tables) -> DataFrame:
    return C.drop_duplicates(dirty_sales(t))


_TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query("standardize_boolean", with_dirty(
    "SELECT sale_id, CASE WHEN lower(" + _TRIM.format(c="promo_active") + ") IN ('yes', 'true', 't', '1') THEN true "
    "WHEN lower(" + _TRIM.format(c="promo_active") + ") IN ('no', 'false', 'f', '0') THEN false END AS promo_active FROM dirty_sales"))
def standardize_boolean(t: Tables) -> DataFrame:
    df = dirty_sales(t).select("sale_id", "promo_active")
    return C.fit_standardiser(df).convert(df)


@query("standardize_gender", with_dirty(
    "SELECT sale_id, CASE WHEN lower(trim(customer_gender)) IN ('f', 'female') THEN 'Female' WHEN lower(trim(customer_gender)) "
    "IN ('m', 'male') THEN 'Male' ELSE CASE WHEN customer_gender = 'gender-fluid' THEN 'Gender-Fluid' ELSE 'Non  Binary' END END AS customer_gender FROM dirty_sales"))
def standardize_gender(t: Tables) -> DataFrame:
    return dirty_sales(t).select("sale_id", standard_gender(F.col("customer_gender")).alias("customer_gender"))


@query("trim_strings", with_dirty("SELECT sale_id, " + ", ".join(f"{_TRIM.format(c=c)} AS {c}" for c in SALES_TEXT) + " FROM dirty_sales"))
def trim_strings(t: Tables) -> DataFrame:
    return dirty_sales(t).select("sale_id", *[strip(F.col(c)).alias(c) for c in SALES_TEXT])


@query("standardize_dates", with_dirty("SELECT sale_id, CAST(try_strptime(sale_date, '%Y-%m-%d') AS DATE) AS sale_date FROM dirty_sales"))
def standardize_dates(t: Tables) -> DataFrame:
    return dirty_sales(t).select("sale_id", parsing.parse_date(F.col("sale_date")).alias("sale_date"))


_ODD_DATE = "CASE WHEN order_date <> 'soon' THEN CAST(o_orderdate AS DATE) END"


@query("standardize_dates_mixed", f"WITH {ODD_DATES_SQL} SELECT order_key, {_ODD_DATE} AS order_date, CAST(o_orderdate AS DATE) AS update_date "
                                  "FROM odd_dates JOIN orders ON order_key = o_orderkey")
def standardize_dates_mixed(t: Tables) -> DataFrame:
    return odd_dates(t).select("order_key", *[parsing.parse_date(F.col(c)).alias(c) for c in ("order_date", "update_date")])


@query("clean_odd_dates", f"WITH {ODD_DATES_SQL} SELECT order_key, {_ODD_DATE} AS order_date, CAST(o_orderdate AS DATE) AS update_date, sentiment, "
                          "false AS is_outlier FROM odd_dates JOIN orders ON order_key = o_orderkey")
def clean_odd_dates(t: Tables) -> DataFrame:
    """No column with values goes: neither the one in another format nor the text with a date's name."""
    return C.clean(odd_dates(t)).data


@query("clean_odd_dates_log", f"WITH {ODD_DATES_SQL} SELECT 'values_lost_in_conversion' AS action_type, 'order_date' AS column_name, count(*) AS affected_rows "
                              "FROM odd_dates WHERE order_date = 'soon' UNION ALL SELECT 'kept_as_text', 'sentiment', count(sentiment) FROM odd_dates")
def clean_odd_dates_log(t: Tables) -> DataFrame:
    return C.clean(odd_dates(t)).action_log().drop("step")


_MONEY = "TRY_CAST(regexp_replace(amount_text, '[$€£%,]', '', 'g') AS DOUBLE)"


@query("parse_currency", with_dirty(f"SELECT sale_id, CASE WHEN (SELECT count(CASE WHEN regexp_matches(amount_text, '{FORMATTED}') THEN 1 END) "
                                    f"> 0.5 * count(amount_text) FROM dirty_sales) THEN {_MONEY} END AS amount_text FROM dirty_sales"))
def parse_currency(t: Tables) -> DataFrame:
    df = dirty_sales(t).select("sale_id", "amount_text")
    return C.fit_standardiser(df).convert(df)


def title_sql(c: str) -> str:
    """Reference SQL for title case with protected acronyms."""
    words = ", ".join(f"'{w}'" for w in L.PROTECTED_UPPERCASE)
    return (f"array_to_string([CASE WHEN upper(w) IN ({words}) THEN upper(w) ELSE concat(upper(substr(w, 1, 1)), lower(substr(w, 2))) END "
            f"FOR w IN regexp_split_to_array({_TRIM.format(c=c)}, '\\s+') IF w <> ''], ' ')")


@query("title_case_safe", with_dirty("SELECT sale_id, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN {title_sql(c)} END AS {c}" for c in ("region", "channel", "product_type")) + " FROM dirty_sales"))
def title_case_safe(t: Tables) -> DataFrame:
    return dirty_sales(t).select("sale_id", *[title_case(F.col(c)).alias(c) for c in ("region", "channel", "product_type")])


@query("initcap_normalized", with_dirty(
    "SELECT sale_id, array_to_string([concat(upper(substr(w, 1, 1)), lower(substr(w, 2))) FOR w IN regexp_split_to_array(product_type, '\\s+') "
    "IF w <> ''], ' ') AS product_type FROM dirty_sales"))
def initcap_normalized(t: Tables) -> DataFrame:
    return run_sql(t.spark, "SELECT sale_id, initcap_ws(product_type) AS product_type FROM dirty_sales_view",
                   {"dirty_sales_view": dirty_sales(t)})


@query("drop_empty_rows", with_dirty("SELECT * FROM dirty_sales WHERE sale_id % 11 <> 3"))
def drop_empty_rows(t: Tables) -> DataFrame:
    """All columns of the sales rows, of which every eleventh holds nothing."""
    rows = dirty_sales(t)
    return C.drop_empty_rows(rows.select(*[F.when(F.col("sale_id") % 11 != 3, F.col(c)).alias(c) for c in rows.columns]))


@query("drop_empty_columns", with_dirty("SELECT " + ", ".join(c for c in ALL if c != "empty_col") + ", false AS is_outlier FROM dirty_sales"))
def drop_empty_columns(t: Tables) -> DataFrame:
    return C.drop_empty_columns(dirty_sales(t)).withColumn("is_outlier", F.lit(False))


@query("null_invalid_values", with_dirty(
    "SELECT sale_id, CASE WHEN units_sold >= 0 THEN units_sold END AS units_sold, CASE WHEN unit_price >= 0 THEN unit_price END AS unit_price, "
    "CASE WHEN customer_age BETWEEN 0 AND 120 THEN customer_age END AS customer_age FROM dirty_sales"))
def null_invalid_values(t: Tables) -> DataFrame:
    df = dirty_sales(t).select("sale_id", "units_sold", "unit_price", "customer_age")
    return C.null_invalid(df, ["units_sold", "unit_price", "customer_age"])


_FENCES = f"fence AS ({fence_sql('dirty_sales', METRICS, 3.0)})"


def _beyond(c: str) -> str:
    one = f"(SELECT {{}} FROM fence WHERE column_name = '{c}' AND q3 > q1)"
    return f"({c} < {one.format('q1 - 3 * (q3 - q1)')} OR {c} > {one.format('q3 + 3 * (q3 - q1)')})"


@query("flag_outliers", with_dirty("SELECT sale_id, revenue, cogs, coalesce(" + _beyond("revenue") + ", false) OR coalesce(" + _beyond("cogs")
                                   + ", false) AS is_outlier FROM dirty_sales", _FENCES))
def flag_outliers(t: Tables) -> DataFrame:
    df = dirty_sales(t).select("sale_id", "revenue", "cogs")
    return C.flag_outliers(df, C.outlier_fences(df, ["revenue", "cogs"]))


@query("outlier_summary", with_dirty(union([f"SELECT sale_id, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM dirty_sales WHERE {_beyond(c)}"
                                            for c in METRICS]), _FENCES))
def outlier_summary(t: Tables) -> DataFrame:
    df = stored_sales(t)
    return C.outlier_summary(df, C.outlier_fences(df, METRICS), ["sale_id"])


@query("impute_unknown", with_dirty("SELECT sale_id, coalesce(region, 'Unknown') AS region, coalesce(promo_active, 'Unknown') AS promo_active FROM dirty_sales"))
def impute_unknown(t: Tables) -> DataFrame:
    return C.impute_unknown(dirty_sales(t).select("sale_id", "region", "promo_active"), ["region", "promo_active"])


@query("impute_median", with_dirty("SELECT sale_id, CAST(coalesce(customer_age, (SELECT quantile_cont(CAST(customer_age AS DOUBLE), 0.5) FROM dirty_sales)) AS DOUBLE) "
                                   "AS customer_age FROM dirty_sales"))
def impute_median(t: Tables) -> DataFrame:
    df = dirty_sales(t).select("sale_id", "customer_age")
    filled = C.impute_value(df, C.medians(df, ["customer_age"]))
    return filled.withColumn("customer_age", F.col("customer_age").cast("double"))


@query("impute_mode", with_dirty("SELECT sale_id, coalesce(promo_active, (SELECT promo_active FROM dirty_sales WHERE promo_active IS NOT NULL "
                                 "GROUP BY promo_active ORDER BY count(*) DESC, promo_active LIMIT 1)) AS promo_active FROM dirty_sales"))
def impute_mode(t: Tables) -> DataFrame:
    df = dirty_sales(t).select("sale_id", "promo_active")
    return C.impute_value(df, {"promo_active": C.most_frequent(df, "promo_active")})


@query("merge_categories", with_dirty("SELECT sale_id, coalesce(kept, region) AS region FROM dirty_sales LEFT JOIN merges ON region = replaced "
                                      "AND column_name = 'region'", _variants_sql("dirty_sales", ["region"])))
def merge_categories(t: Tables) -> DataFrame:
    return C.merge_categories(dirty_sales(t).select("sale_id", "region"), ["region"])


RECOVERY_STEPS = [
    "w0 AS (SELECT sale_id, CAST(units_sold AS DOUBLE) AS units_sold, unit_price, revenue, cogs, profit, margin FROM dirty_sales)",
    "w1 AS (SELECT *, coalesce(revenue, units_sold * unit_price) AS revenue1 FROM w0)",
    "w2 AS (SELECT *, coalesce(units_sold, revenue1 / nullif(unit_price, 0)) AS units1 FROM w1)",
    "w3 AS (SELECT *, coalesce(unit_price, round_even(revenue1 / nullif(units1, 0), 4)) AS price1 FROM w2)",
    "w4 AS (SELECT *, coalesce(profit, revenue1 - cogs) AS profit1 FROM w3)",
    "w5 AS (SELECT *, coalesce(cogs, revenue1 - profit1) AS cogs1 FROM w4)",
    "w6 AS (SELECT *, coalesce(margin, round_even(profit1 / nullif(revenue1, 0), 4)) AS margin1 FROM w5)"]
_PAIRS = {"revenue": "revenue1", "units_sold": "units1", "unit_price": "price1", "profit": "profit1", "cogs": "cogs1", "margin": "margin1"}
_METRIC_SELECT = ["sale_id", "units_sold", "unit_price", "revenue", "cogs", "profit", "margin"]


@query("recover_metrics", with_dirty(
    "SELECT sale_id, " + ", ".join(f"round({n}, 6) AS {o}" for o, n in _PAIRS.items()) + ", "
    + " OR ".join(f"({o} IS NULL AND {n} IS NOT NULL)" for o, n in _PAIRS.items()) + " AS is_derived FROM w6", *RECOVERY_STEPS))
def recover_metrics(t: Tables) -> DataFrame:
    out = C.recover_metrics(dirty_sales(t).select(_METRIC_SELECT))
    return out.withColumns({c: F.round(c, 6) for c in _PAIRS})


@query("recovery_log", with_dirty(union([f"SELECT sale_id, '{o}' AS column_name, round({n}, 6) AS recovered_value FROM w6 WHERE {o} IS NULL AND {n} IS NOT NULL"
                                         for o, n in _PAIRS.items()]), *RECOVERY_STEPS))
def recovery_log(t: Tables) -> DataFrame:
    log = C.recovery_log(dirty_sales(t).select(_METRIC_SELECT), ["sale_id"])
    return log.select("sale_id", "column_name", F.round("recovered_value", 6).alias("recovered_value"))


@query("coerce_numeric_all_or_none", with_dirty(
    "SELECT sale_id, amount_text, units_sold AS units_total, unit_price AS price_text FROM dirty_sales"))
def coerce_numeric_all_or_none(t: Tables) -> DataFrame:
    """One column with text that does not parse, one of whole numbers, one of decimals."""
    return C.coerce_numeric(dirty_sales(t).select("sale_id", "amount_text", F.col("units_sold").cast("string").alias("units_total"),
                                                  F.col("unit_price").cast("string").alias("price_text")))


# --- the whole flow -----------------------------------------------------------------------

_BOOL = ("CASE WHEN lower(trim(promo_active)) IN ('yes', 'true') THEN true WHEN lower(trim(promo_active)) IN ('no', 'f') THEN false END")
STANDARD_SQL = [
    "unique_sales AS (SELECT DISTINCT * FROM dirty_sales)",
    "standard AS (SELECT sale_id, CAST(try_strptime(sale_date, '%Y-%m-%d') AS DATE) AS sale_date, "
    f"CASE WHEN region IS NOT NULL THEN {title_sql('region')} END AS region, {title_sql('channel')} AS channel, units_sold, unit_price, "
    f"revenue, cogs, profit, margin, {_BOOL} AS promo_active, CASE WHEN lower(trim(customer_gender)) IN ('f', 'female') THEN 'Female' "
    "WHEN lower(trim(customer_gender)) IN ('m', 'male') THEN 'Male' WHEN customer_gender = 'gender-fluid' THEN 'Gender-fluid' ELSE 'Non Binary' END AS customer_gender, customer_age, "
    f"{_MONEY} AS amount_text, {title_sql('product_type')} AS product_type, false AS is_outlier FROM unique_sales)"]


@query("clean_standard", with_dirty("SELECT * FROM standard", *STANDARD_SQL))
def clean_standard(t: Tables) -> DataFrame:
    return C.clean(dirty_sales(t)).data


_STD_METRICS = [*METRICS, "amount_text"]
_WITHOUT = ", ".join(c for c in ALL if c not in ("units_sold", "customer_age", "empty_col"))
APPROVED_SQL = [
    *STANDARD_SQL,
    f"valid AS (SELECT {_WITHOUT}, CASE WHEN units_sold >= 0 THEN units_sold END AS units_sold, "
    "CASE WHEN customer_age BETWEEN 0 AND 120 THEN customer_age END AS customer_age FROM standard)",
    f"fence AS ({fence_sql('valid', ['revenue'], 3.0)})",
    f"flagged AS (SELECT *, coalesce({_beyond('revenue')}, false) AS is_outlier FROM valid)",
    "imputed AS (SELECT * REPLACE (coalesce(region, 'Unknown') AS region, coalesce(CAST(promo_active AS STRING), 'Unknown') AS promo_active, "
    "coalesce(customer_age, (SELECT quantile_cont(CAST(customer_age AS DOUBLE), 0.5) FROM flagged)) AS customer_age) FROM flagged)",
    _variants_sql("imputed", ["region"]),
    "merged AS (SELECT imputed.* REPLACE (coalesce(kept, region) AS region) FROM imputed LEFT JOIN merges ON region = replaced)",
    *[s.replace("FROM dirty_sales", "FROM merged").replace("SELECT sale_id, CAST(units_sold AS DOUBLE) AS units_sold, unit_price, revenue, cogs, profit, margin",
                                                           "SELECT * REPLACE (CAST(units_sold AS DOUBLE) AS units_sold)") for s in RECOVERY_STEPS]]
_REST = [c for c in ALL if c not in _PAIRS and c != "empty_col"]
_FINAL = (", ".join(_REST) + ", is_outlier, " + ", ".join(f"round({n}, 6) AS {o}" for o, n in _PAIRS.items()) + ", "
          + " OR ".join(f"({o} IS NULL AND {n} IS NOT NULL)" for o, n in _PAIRS.items()) + " AS is_derived")


@query("clean_approved", with_dirty(f"SELECT {_FINAL} FROM w6", *APPROVED_SQL).replace(
    "customer_age, amount_text, product_type, is_outlier", "CAST(customer_age AS DOUBLE) AS customer_age, amount_text, product_type, is_outlier"))
def clean_approved(t: Tables) -> DataFrame:
    out = C.clean(dirty_sales(t), ACTIONS, keys=["sale_id"]).data
    return out.withColumns({c: F.round(c, 6) for c in _PAIRS} | {"customer_age": F.col("customer_age").cast("double")})


@query("cleaning_report", with_dirty(
    union(["SELECT 'remove_exact_duplicates' AS action_type, '' AS column_name, (SELECT count(*) FROM dirty_sales) - (SELECT count(*) FROM unique_sales) AS affected_rows",
           "SELECT 'standardize_boolean', 'promo_active', count(promo_active) FROM unique_sales",
           "SELECT 'standardize_gender', 'customer_gender', count(customer_gender) FROM unique_sales",
           *[f"SELECT 'standardize_casing_title_case', '{c}', count({c}) FROM unique_sales" for c in ("region", "channel", "customer_gender", "product_type")],
           "SELECT 'values_lost_in_conversion', 'sale_date', count(*) FROM unique_sales WHERE sale_date = 'not a date' HAVING count(*) > 0",
           "SELECT 'values_lost_in_conversion', 'amount_text', count(*) FROM unique_sales WHERE amount_text = 'n/a' HAVING count(*) > 0",
           "SELECT 'null_invalid_values', 'units_sold', count(*) FROM standard WHERE units_sold < 0",
           "SELECT 'null_invalid_values', 'customer_age', count(*) FROM standard WHERE customer_age < 0 OR customer_age > 120",
           "SELECT 'flag_outliers', 'revenue', count(*) FROM flagged WHERE is_outlier",
           "SELECT 'impute_dimension_unknown', 'region', count(*) FROM flagged WHERE region IS NULL",
           "SELECT 'impute_dimension_unknown', 'promo_active', count(*) FROM flagged WHERE promo_active IS NULL",
           "SELECT 'impute_attribute_median', 'customer_age', count(*) FROM flagged WHERE customer_age IS NULL",
           "SELECT 'merge_similar_categories', 'region', CAST(sum(n) AS BIGINT) FROM merges HAVING count(*) > 0"]), *APPROVED_SQL))
def cleaning_report(t: Tables) -> DataFrame:
    return C.clean(dirty_sales(t), ACTIONS).action_log().drop("step")


@query("missing_summary", with_dirty(union([f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_before FROM dirty_sales" for c in ALL])))
def missing_summary(t: Tables) -> DataFrame:
    return C.clean(dirty_sales(t)).missing_summary()


@query("auto_clean", with_dirty(
    f"SELECT {_FINAL} FROM w6", *APPROVED_SQL).replace(
    "customer_age, amount_text, product_type, is_outlier", "CAST(customer_age AS DOUBLE) AS customer_age, amount_text, product_type, is_outlier"))
def auto_clean(t: Tables) -> DataFrame:
    out = C.auto_clean(stored_sales(t), keys=["sale_id"]).data
    return out.withColumns({c: F.round(c, 6) for c in _PAIRS} | {"customer_age": F.col("customer_age").cast("double")})


# --- score and integrity ------------------------------------------------------------------


def score_sql(source: str, columns: list[str], numeric: list[str], dates: str, name: str) -> list[str]:
    """Reference SQL for the weighted quality score of a table."""
    parts = []
    for c in columns:
        weight = Q.column_weight(c, ROLES[c])
        outliers, invalid = "0", "0"
        if c in numeric:
            outliers = (f"count(CASE WHEN q3 > q1 AND ({c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) THEN 1 END)")
            if any(w in c for w in L.NEGATIVE_WORDS):
                invalid = f"count(CASE WHEN {c} < 0 THEN 1 END)"
            if "age" in c:
                invalid = f"count(CASE WHEN {c} < 0 OR {c} > 120 THEN 1 END)"
        elif c == dates:
            invalid = f"count(CASE WHEN {c} IS NOT NULL AND try_strptime(CAST({c} AS STRING), '%Y-%m-%d') IS NULL THEN 1 END)"
        stats = (f", (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}) AS st"
                 if c in numeric else "")
        parts.append(f"SELECT '{c}' AS column_name, CAST({weight} AS BIGINT) AS weight, count(*) AS row_count, count(*) - count({c}) AS nulls, "
                     f"CAST({outliers} AS BIGINT) AS outliers, CAST({invalid} AS BIGINT) AS invalid FROM {source}{stats}")
    return [f"{name}_columns AS ({union(parts)})",
            f"{name} AS (SELECT round(sum(greatest(0, 1 - CAST(nulls + outliers + invalid AS DOUBLE) / row_count) * weight) / sum(weight) * 100, 1) "
            f"AS quality_score FROM {name}_columns)"]


_RAW_SCORE = score_sql("dirty_sales", ALL, SALES_NUMERIC, "sale_date", "raw_score")


@query("quality_score", with_dirty("SELECT quality_score FROM raw_score", *_RAW_SCORE))
def quality_score(t: Tables) -> DataFrame:
    return Q.quality_score(stored_sales(t))


@query("column_scores", with_dirty("SELECT column_name, weight, row_count, nulls, outliers, invalid FROM raw_score_columns", *_RAW_SCORE))
def column_scores(t: Tables) -> DataFrame:
    return Q.column_scores(stored_sales(t)).drop("column_score")


_KEPT = [c for c in ALL if c != "empty_col"]


@query("score_before_after", with_dirty("SELECT 'before' AS stage, quality_score FROM raw_score UNION ALL SELECT 'after', quality_score FROM std_score",
                                        *_RAW_SCORE, *STANDARD_SQL, *score_sql("standard", _KEPT, [*SALES_NUMERIC, "amount_text"], "", "std_score")))
def score_before_after(t: Tables) -> DataFrame:
    before = stored_sales(t)
    done = C.clean(before)
    return Q.score_before_after(before, done.data, done.roles)


def _integrity_sql(metrics: dict[str, str], before: str, after: str) -> str:
    rows = [f"SELECT 'row_count' AS metric, CAST((SELECT count(*) FROM {before}) AS DOUBLE) AS b, CAST((SELECT count(*) FROM {after}) AS DOUBLE) AS a"]
    rows += [f"SELECT '{k}', CAST((SELECT sum({c}) FROM {before}) AS DOUBLE), CAST((SELECT sum({c}) FROM {after}) AS DOUBLE)" for k, c in metrics.items()]
    return (f"SELECT metric, round(b, 2) AS before_value, round(a, 2) AS after_value, round(abs(a - b) / abs(b) * 100, 2) AS pct_change, "
            f"abs(a - b) / abs(b) > 0.01 AS warning FROM ({union(rows)})")


@query("integrity_check", with_dirty(
    _integrity_sql({"revenue": "revenue", "units_sold": "units_sold", "profit": "profit"}, "dirty_sales", "recovered"), *APPROVED_SQL,
    "recovered AS (SELECT revenue1 AS revenue, units1 AS units_sold, profit1 AS profit FROM w6)"))
def integrity_check(t: Tables) -> DataFrame:
    before = stored_sales(t)
    check = Q.integrity_check(before, C.clean(before, ACTIONS).data)
    return check.withColumns({c: F.round(c, 2) for c in ("before_value", "after_value")})

