"""Queries: schema, roles, profile, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.catalogue.fixtures import BRANDS_SQL, DIRTY_SALES, ODD_DATES_SQL, brands, dirty_sales, odd_dates, stored_sales, with_dirty
from plumbgauge.catalogue.registry import Tables, query
from plumbgauge.functions import lexicon as L
from plumbgauge.operators import profile as P
from plumbgauge.operators import schema as S
from plumbgauge.operators import shape
from plumbgauge.session import spread

# Columns and types of the supplied tables, for the reference SQL.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
SALES_TYPES = {c: "double" if c in ("unit_price", "revenue", "cogs", "profit", "margin")
               else "bigint" if c in ("sale_id", "units_sold", "customer_age") else "string" for c in DIRTY_SALES}
SALES_NUMERIC = [c for c, t in SALES_TYPES.items() if t != "string"]
SALES_TEXT = [c for c, t in SALES_TYPES.items() if t == "string"]
LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ")) for part in COLUMNS[table].split(",")]


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def _summary_sql() -> str:
    parts = []
    for table in COLUMNS:
        for i, (c, t) in enumerate(columns_of(table)):
            parts.append(f"SELECT '{table}' AS table_name, {i} AS position, '{c}' AS column_name, '{t}' AS dtype, "
                         f"count(*) AS row_count, count(*) - count({c}) AS null_count, "
                         f"count(DISTINCT {c}) AS distinct_count FROM {table}")
    return union(parts)


SUMMARY_SQL = _summary_sql()


def plain_tables(t: Tables) -> dict[str, DataFrame]:
    return {name: getattr(t, name) for name in COLUMNS}


@query("normalized_names", "SELECT o_orderkey AS order_key, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS total_price, "
                           "o_orderdate AS order_date, o_orderpriority AS o_orderpriority FROM orders")
def normalized_names(t: Tables) -> DataFrame:
    names = {"o_orderkey": " Order Key", "o_custkey": "Customer", "o_orderstatus": "STATUS", "o_totalprice": "Total Price ", "o_orderdate": "order Date"}
    return S.normalise_columns(t.orders.withColumnsRenamed(names))


@query("schema_summary", SUMMARY_SQL)
def schema_summary(t: Tables) -> DataFrame:
    large = ("orders", "lineitem", "events", "documents")
    return S.summaries_of({n: spread(df) if n in large else df for n, df in plain_tables(t).items()})


def _metadata_sql() -> str:
    parts = []
    for table in COLUMNS:
        cols = columns_of(table)
        numeric = [c for c, t in cols if t in ("int", "bigint", "double")]
        dates = [c for c, t in cols if t == "timestamp_ntz"]
        rest = [c for c, _ in cols if c not in numeric + dates]
        parts.append(f"SELECT '{table}' AS table_name, count(*) AS row_count, CAST({len(cols)} AS BIGINT) AS column_count, "
                     f"'{','.join(c for c, _ in cols)}' AS columns, '{','.join(numeric)}' AS numeric_columns, "
                     f"'{','.join(rest)}' AS categorical_columns, '{','.join(dates)}' AS date_columns FROM {table}")
    return union(parts)


@query("metadata_summary", _metadata_sql())
def metadata_summary(t: Tables) -> DataFrame:
    parts = [S.metadata_summary(df).select(F.lit(n).alias("table_name"), "*") for n, df in plain_tables(t).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    lists = ["columns", "numeric_columns", "categorical_columns", "date_columns"]
    return out.select("table_name", "row_count", "column_count", *[F.array_join(c, ",").alias(c) for c in lists])


def _any(words: list[str]) -> str:
    return f"regexp_matches(n, '{'|'.join(words)}')"


ROLE_SQL = f"""CASE WHEN dtype LIKE 'timestamp%' OR dtype = 'date' OR {_any(L.DATE_WORDS)} THEN 'DATE'
    WHEN regexp_matches(n, '^(id|sku)$|_(id|uuid|sku)$|^(id|uuid|sku)_') THEN 'IDENTIFIER'
    WHEN {_any(L.ID_WORDS)} AND NOT {_any(L.ID_METRIC_VETO)} AND NOT {_any(L.ID_ATTRIBUTE_VETO)} THEN 'IDENTIFIER'
    WHEN {_any(L.METRIC_WORDS)} THEN 'BUSINESS_METRIC'
    WHEN {_any(L.ATTRIBUTE_WORDS)} THEN CASE WHEN dtype IN ('int', 'bigint', 'double') THEN 'ATTRIBUTE' ELSE 'DIMENSION' END
    WHEN {_any(L.DIMENSION_WORDS)} THEN 'DIMENSION'
    WHEN dtype = 'double' OR (dtype IN ('int', 'bigint') AND distinct_count >= 10) THEN 'BUSINESS_METRIC'
    ELSE 'DIMENSION' END"""


@query("column_roles", f"SELECT table_name, column_name, {ROLE_SQL} AS role FROM "
                       f"(SELECT *, lower(trim(column_name)) AS n FROM ({SUMMARY_SQL}))")
def column_roles(t: Tables) -> DataFrame:
    return S.roles_of_tables(plain_tables(t))


def _type_sql() -> str:
    sums = [f"SELECT table_name, '{name}' AS dataset_type, {i} AS place, "
            f"count(CASE WHEN {_any(words)} THEN 1 END) AS score FROM named GROUP BY table_name"
            for i, (name, words) in enumerate(L.DATASET_TYPES.items())]
    return (f"WITH named AS (SELECT *, lower(trim(column_name)) AS n FROM ({SUMMARY_SQL})), "
            f"scores AS ({union(sums)}), "
            "best AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY score DESC, place) AS r FROM scores) "
            "SELECT table_name, CASE WHEN score > 0 THEN dataset_type ELSE 'General Dataset' END AS dataset_type, "
            "score FROM best WHERE r = 1")


@query("dataset_type", _type_sql())
def dataset_type(t: Tables) -> DataFrame:
    return S.dataset_types(S.summaries_of(plain_tables(t), distinct=False))


@query("type_breakdown", f"SELECT table_name, count(CASE WHEN dtype IN ('int', 'bigint', 'double') THEN 1 END) AS numeric_columns, "
                         f"count(CASE WHEN dtype NOT IN ('int', 'bigint', 'double') THEN 1 END) AS other_columns "
                         f"FROM ({SUMMARY_SQL}) GROUP BY table_name")
def type_breakdown(t: Tables) -> DataFrame:
    return S.type_breakdown(S.summaries_of(plain_tables(t), distinct=False))


def _chart_sql() -> str:
    kinds = ("CASE WHEN dtype IN ('int', 'bigint', 'double') THEN 'n' WHEN dtype = 'timestamp_ntz' OR "
             "regexp_matches(lower(column_name), 'date|time') THEN 'd' ELSE 'c' END")
    return f"""WITH k AS (SELECT *, {kinds} AS kind FROM ({SUMMARY_SQL})),
    o AS (SELECT *, row_number() OVER (PARTITION BY table_name, kind ORDER BY position) AS r FROM k),
    f AS (SELECT table_name, count(*) AS width,
        max(CASE WHEN kind = 'n' AND r = 1 THEN column_name END) AS n1, max(CASE WHEN kind = 'n' AND r = 2 THEN column_name END) AS n2,
        max(CASE WHEN kind = 'd' AND r = 1 THEN column_name END) AS d1, max(CASE WHEN kind = 'c' AND r = 1 THEN column_name END) AS c1,
        max(CASE WHEN position = 0 THEN column_name END) AS e1, max(CASE WHEN position = 1 THEN column_name END) AS e2
        FROM o GROUP BY table_name)
    SELECT table_name,
        CASE WHEN width < 2 THEN 'table' WHEN d1 IS NOT NULL AND n1 IS NOT NULL THEN 'line' WHEN c1 IS NOT NULL AND n1 IS NOT NULL THEN 'bar'
             WHEN n2 IS NOT NULL THEN 'scatter' ELSE 'bar' END AS chart,
        CASE WHEN width < 2 THEN NULL WHEN d1 IS NOT NULL AND n1 IS NOT NULL THEN d1 WHEN c1 IS NOT NULL AND n1 IS NOT NULL THEN c1
             WHEN n2 IS NOT NULL THEN n1 ELSE e1 END AS x,
        CASE WHEN width < 2 THEN NULL WHEN d1 IS NOT NULL AND n1 IS NOT NULL THEN n1 WHEN c1 IS NOT NULL AND n1 IS NOT NULL THEN n1
             WHEN n2 IS NOT NULL THEN n2 ELSE e2 END AS y,
        CASE WHEN width < 2 THEN 'table' WHEN d1 IS NOT NULL AND n1 IS NOT NULL THEN 'line,bar,area,scatter'
             WHEN c1 IS NOT NULL AND n1 IS NOT NULL THEN 'bar,pie,area,scatter,treemap,waterfall'
             WHEN n2 IS NOT NULL THEN 'scatter,line,bar,box' ELSE 'bar,line,pie,scatter,heatmap' END AS alternatives FROM f"""


@query("chart_recommendation", _chart_sql())
def chart_recommendation(t: Tables) -> DataFrame:
    return shape.chart_recommendation(S.summaries_of(plain_tables(t), distinct=False))


@query("dimension_columns", "SELECT table_name, column_name, null_count, dtype = 'string' OR column_name IN "
       f"({', '.join(repr(d) for d in L.KNOWN_DIMENSIONS)}) AS is_dimension FROM ({SUMMARY_SQL})")
def dimension_columns(t: Tables) -> DataFrame:
    summary = S.summaries_of(plain_tables(t), distinct=False)
    return S.with_dimension_flag(summary).select("table_name", "column_name", "null_count", "is_dimension")


# --- profile of the dirty sales rows ------------------------------------------------------

DUPLICATES_SQL = ("d AS (SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_sales)) "
                  "AS duplicate_rows FROM dirty_sales)")


@query("exact_duplicates", with_dirty(
    "SELECT row_count, duplicate_rows, round(CAST(duplicate_rows AS DOUBLE) / row_count, 6) AS duplicate_fraction, "
    "round(least(20.0, CAST(duplicate_rows AS DOUBLE) / row_count * 50), 6) AS penalty FROM d", DUPLICATES_SQL))
def exact_duplicates(t: Tables) -> DataFrame:
    return (P.exact_duplicates(dirty_sales(t))
            .withColumns({c: F.round(c, 6) for c in ("duplicate_fraction", "penalty")}))


COMPARED = [c for c in DIRTY_SALES if not any(w in c for w in L.NEAR_DUPLICATE_SKIP_WORDS)]
# Of 14 compared columns one may differ: a row counts when it meets another one on some 13 of them.
_LEAVE_ONE_OUT = [f"count(*) OVER (PARTITION BY {', '.join(c for c in COMPARED if c != out)}) AS n_{out}" for out in COMPARED]
NEAR_SQL = [f"companions AS (SELECT {', '.join(_LEAVE_ONE_OUT)} FROM dirty_sales)",
            f"near AS (SELECT count(*) AS row_count, count(CASE WHEN greatest({', '.join('n_' + c for c in COMPARED)}) > 1 "
            "THEN 1 END) AS near_duplicate_rows FROM companions)"]


@query("near_duplicate_rows", with_dirty(
    "SELECT row_count, near_duplicate_rows, round(least(15.0, CAST(near_duplicate_rows AS DOUBLE) / row_count * 30), 6) "
    "AS penalty FROM near", *NEAR_SQL))
def near_duplicate_rows(t: Tables) -> DataFrame:
    return P.near_duplicate_rows(dirty_sales(t)).withColumn("penalty", F.round("penalty", 6))


PROFILE_SQL = "profile AS (" + union(
    [f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, count(*) AS row_count, count(*) - count({c}) AS null_count, "
     f"count(DISTINCT {c}) AS distinct_count, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS null_fraction FROM dirty_sales"
     for i, (c, t) in enumerate(SALES_TYPES.items())]) + ")"


@query("column_profile", with_dirty(
    "SELECT position, column_name, dtype, row_count, null_count, distinct_count, round(null_fraction, 6) AS null_fraction "
    "FROM profile", PROFILE_SQL))
def column_profile(t: Tables) -> DataFrame:
    return P.column_profile(dirty_sales(t)).withColumn("null_fraction", F.round("null_fraction", 6))


NULL_AUDIT_SQL = ("null_audit AS (SELECT column_name, null_count, null_fraction, "
                  "CASE WHEN null_count = row_count THEN 'empty_column' ELSE 'missing_values' END AS check_name, "
                  "CASE WHEN null_count = row_count THEN 10.0 ELSE least(15.0, null_fraction * 30) END AS penalty "
                  "FROM profile WHERE null_count > 0)")


@query("null_audit", with_dirty("SELECT column_name, null_count, check_name, round(null_fraction, 6) AS null_fraction, "
                                "round(CAST(penalty AS DOUBLE), 6) AS penalty FROM null_audit", PROFILE_SQL, NULL_AUDIT_SQL))
def null_audit(t: Tables) -> DataFrame:
    return (P.null_audit(P.column_profile(dirty_sales(t)))
            .withColumns({c: F.round(c, 6) for c in ("null_fraction", "penalty")}))


@query("numeric_profile", with_dirty(union(
    [f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, "
     f"round(avg({c}), 4) AS mean_value FROM dirty_sales" for c in SALES_NUMERIC])))
def numeric_profile(t: Tables) -> DataFrame:
    return P.numeric_profile(dirty_sales(t)).withColumn("mean_value", F.round("mean_value", 4))


def outlier_sql(source: str, columns: list[str]) -> str:
    """Reference SQL for interquartile and z-score outliers per column."""
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, any_value(q1) AS q1, any_value(q3) AS q3, "
            f"count(CASE WHEN q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) THEN 1 END) AS iqr_outliers, "
            f"count(CASE WHEN s > 0 AND abs(({c} - m) / s) > 3 THEN 1 END) AS z_outliers, "
            f"count(CASE WHEN (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) "
            f"OR (s > 0 AND abs(({c} - m) / s) > 3) THEN 1 END) AS outliers "
            f"FROM {source}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, "
            f"avg({c}) AS m, stddev_samp({c}) AS s FROM {source}) AS st")
    return union(parts)


LINE_OUTLIERS = f"({outlier_sql('lineitem', LINE_NUMERIC)} UNION ALL {outlier_sql('events', ['value'])})"


def _line_and_event_outliers(t: Tables) -> DataFrame:
    return P.outlier_profile(t.lineitem, LINE_NUMERIC).unionAll(P.outlier_profile(t.events, ["value"]))


@query("outliers_iqr15", f"SELECT column_name, round(q1, 4) AS q1, round(q3, 4) AS q3, iqr_outliers FROM {LINE_OUTLIERS}")
def outliers_iqr15(t: Tables) -> DataFrame:
    return _line_and_event_outliers(t).select("column_name", F.round("q1", 4).alias("q1"),
                                              F.round("q3", 4).alias("q3"), "iqr_outliers")


@query("outliers_zscore", f"SELECT column_name, row_count, z_outliers FROM {LINE_OUTLIERS}")
def outliers_zscore(t: Tables) -> DataFrame:
    return _line_and_event_outliers(t).select("column_name", "row_count", "z_outliers")


SALES_OUTLIERS_SQL = f"outlier AS ({outlier_sql('dirty_sales', SALES_NUMERIC)})"


@query("outliers_combined", with_dirty(
    "SELECT column_name, outliers, round(least(10.0, CAST(outliers AS DOUBLE) / row_count * 20), 6) AS penalty FROM outlier",
    SALES_OUTLIERS_SQL))
def outliers_combined(t: Tables) -> DataFrame:
    return P.outlier_profile(stored_sales(t)).select("column_name", "outliers", F.round("penalty", 6).alias("penalty"))


IMPOSSIBLE_SQL = ("impossible AS (SELECT 'negative' AS check_name, 'unit_price' AS column_name, "
                  "count(CASE WHEN unit_price < 0 THEN 1 END) AS affected FROM dirty_sales UNION ALL "
                  "SELECT 'age_range', 'customer_age', count(CASE WHEN customer_age < 0 OR customer_age > 120 THEN 1 END) "
                  "FROM dirty_sales)")


@query("impossible_values", with_dirty("SELECT * FROM impossible", IMPOSSIBLE_SQL))
def impossible_values(t: Tables) -> DataFrame:
    return P.impossible_values(dirty_sales(t))


def spelled_sql(source: str, columns: list[str]) -> str:
    """Reference SQL: distinct trimmed non-blank values per column."""
    return union([f"SELECT '{c}' AS column_name, v AS value, lower(v) AS low, count(*) AS n FROM "
                  f"(SELECT regexp_replace({c}, '^\\s+|\\s+$', '', 'g') AS v FROM {source}) AS x "
                  f"WHERE v <> '' GROUP BY v" for c in columns])


SPELLED_SQL = f"spelled AS ({spelled_sql('dirty_sales', SALES_TEXT)})"
MIXED_SQL = ("mixed AS (SELECT column_name, count(*) AS mixed_groups, CAST(sum(variants) AS BIGINT) AS variants FROM "
             "(SELECT column_name, low, count(*) AS variants FROM spelled GROUP BY column_name, low HAVING count(*) > 1) "
             "GROUP BY column_name)")


@query("mixed_case_values", with_dirty("SELECT * FROM mixed", SPELLED_SQL, MIXED_SQL))
def mixed_case_values(t: Tables) -> DataFrame:
    return P.mixed_case_values(P.spellings(dirty_sales(t)))


CATEGORY_SQL = [
    f"lows AS (SELECT DISTINCT column_name, low FROM spelled WHERE NOT regexp_matches(column_name, '{'|'.join(L.CATEGORY_SKIP_WORDS)}'))",
    "near_categories AS (SELECT a.column_name, a.low AS left_value, b.low AS right_value FROM lows a JOIN lows b "
    "ON a.column_name = b.column_name AND a.low < b.low "
    "WHERE levenshtein(a.low, b.low) <= 2 AND levenshtein(a.low, b.low) < 0.3 * greatest(length(a.low), length(b.low)))"]


@query("near_duplicate_categories", with_dirty("SELECT * FROM near_categories", SPELLED_SQL, *CATEGORY_SQL))
def near_duplicate_categories(t: Tables) -> DataFrame:
    return P.near_duplicate_categories(P.spellings(dirty_sales(t)))


@query("near_categories_many", f"WITH {BRANDS_SQL} SELECT 'brand' AS column_name, brand AS left_value, concat('x', brand) AS right_value "
                               "FROM brands WHERE item_id % 50 = 7 AND substr(brand, 1, 1) <> 'x'")
def near_categories_many(t: Tables) -> DataFrame:
    """Misspellings among thousands of names; names this far apart have no other near spelling."""
    return P.near_duplicate_categories(P.spellings(brands(t).select("brand")))


# The pattern of formatted numbers in the lexicon, in the dialect of the reference SQL.
FORMATTED = r"^\s*[-$+€£]?\s*[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?\s*%?\s*$"
TEXT_NUMBER_SQL = "text_number AS (" + union(
    [f"SELECT '{c}' AS column_name, count(CASE WHEN regexp_matches({c}, '{FORMATTED}') AND NOT "
     f"regexp_full_match({c}, '[0-9]+\\.?[0-9]*|\\.[0-9]+') THEN 1 END) AS formatted, count({c}) AS filled FROM dirty_sales"
     for c in SALES_TEXT]) + ")"


@query("text_numbers", with_dirty("SELECT *, formatted > filled * 0.5 AS flagged FROM text_number", TEXT_NUMBER_SQL))
def text_numbers(t: Tables) -> DataFrame:
    return P.text_numbers(dirty_sales(t))


BAD_DATE_SQL = ("bad_date AS (SELECT 'sale_date' AS column_name, count(CASE WHEN trim(sale_date) <> '' AND "
                "try_strptime(sale_date, '%Y-%m-%d') IS NULL THEN 1 END) AS affected FROM dirty_sales)")


@query("invalid_dates", with_dirty("SELECT * FROM bad_date", BAD_DATE_SQL))
def invalid_dates(t: Tables) -> DataFrame:
    return P.invalid_dates(dirty_sales(t))


@query("invalid_dates_mixed", f"WITH {ODD_DATES_SQL} SELECT 'order_date' AS column_name, count(CASE WHEN order_date = 'soon' THEN 1 END) AS affected "
                              "FROM odd_dates UNION ALL SELECT 'update_date', 0")
def invalid_dates_mixed(t: Tables) -> DataFrame:
    return P.invalid_dates(odd_dates(t).drop("sentiment"))


ISSUES_SQL = """issue AS (
    SELECT 'exact_duplicates' AS check_name, '' AS column_name, duplicate_rows AS affected,
        least(20.0, CAST(duplicate_rows AS DOUBLE) / row_count * 50) AS penalty FROM d WHERE duplicate_rows > 0
    UNION ALL SELECT 'near_duplicates', '', near_duplicate_rows, least(15.0, CAST(near_duplicate_rows AS DOUBLE) / row_count * 30)
        FROM near WHERE near_duplicate_rows > 0
    UNION ALL SELECT check_name, column_name, null_count, penalty FROM null_audit
    UNION ALL SELECT 'outliers', column_name, outliers, least(10.0, CAST(outliers AS DOUBLE) / row_count * 20) FROM outlier WHERE outliers > 0
    UNION ALL SELECT check_name, column_name, affected, 5.0 FROM impossible WHERE affected > 0
    UNION ALL SELECT 'text_numbers', column_name, formatted, 5.0 FROM text_number WHERE formatted > filled * 0.5
    UNION ALL SELECT 'invalid_dates', column_name, affected, 5.0 FROM bad_date WHERE affected > 0
    UNION ALL SELECT 'mixed_case', column_name, mixed_groups, 2.0 FROM mixed
    UNION ALL SELECT 'near_categories', column_name, count(*), 2.0 FROM near_categories GROUP BY column_name)"""
ALL_CHECKS = [DUPLICATES_SQL, *NEAR_SQL, PROFILE_SQL, NULL_AUDIT_SQL, SALES_OUTLIERS_SQL, IMPOSSIBLE_SQL, SPELLED_SQL, MIXED_SQL,
              *CATEGORY_SQL, TEXT_NUMBER_SQL, BAD_DATE_SQL, ISSUES_SQL]


@query("profile_issues", with_dirty("SELECT check_name, column_name, affected, round(CAST(penalty AS DOUBLE), 6) AS penalty FROM issue",
                                    *ALL_CHECKS))
def profile_issues(t: Tables) -> DataFrame:
    return P.issues(stored_sales(t)).withColumn("penalty", F.round("penalty", 6))


@query("profile_score", with_dirty("SELECT count(*) AS issue_count, greatest(0.0, least(100.0, round(100 - sum(CAST(penalty AS DOUBLE)), 1))) "
                                   "AS score FROM issue", *ALL_CHECKS))
def profile_score(t: Tables) -> DataFrame:
    return P.profile_score(P.issues(stored_sales(t)))


@query("completeness_bars", with_dirty(
    "SELECT column_name, CAST(round((1 - null_fraction) * 100) AS BIGINT) AS fill_pct, "
    "CAST(least(100, round(CAST(distinct_count AS DOUBLE) / row_count * 100)) AS BIGINT) AS cardinality_pct FROM profile", PROFILE_SQL))
def completeness_bars(t: Tables) -> DataFrame:
    return P.completeness_bars(P.column_profile(dirty_sales(t)))


@query("score_band", with_dirty(
    "SELECT column_name, score, CASE WHEN score >= 80 THEN 'Premium' WHEN score >= 50 THEN 'Moderate' ELSE 'Poor' END AS band FROM ("
    "SELECT column_name, round((1 - null_fraction) * 100, 1) AS score FROM profile)", PROFILE_SQL))
def score_band(t: Tables) -> DataFrame:
    scores = P.column_profile(dirty_sales(t)).select("column_name", F.round((1 - F.col("null_fraction")) * 100, 1).alias("score"))
    return scores.withColumn("band", P.score_band(F.col("score")))


@query("fleet_summary", "SELECT count(*) AS datasets, CAST(sum(row_count) AS BIGINT) AS total_rows, "
       "round(coalesce(avg(score), 100.0), 1) AS mean_score FROM (" + union(
           [f"SELECT '{n}' AS table_name, count(*) AS row_count, CAST(count({columns_of(n)[0][0]}) AS DOUBLE) / count(*) * 100 AS score FROM {n}"
            for n in COLUMNS]) + ")")
def fleet_summary(t: Tables) -> DataFrame:
    """Score of each table here: the fill of its key column."""
    parts = [df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"),
                    (F.count(df.columns[0]) / F.count(F.lit(1)) * 100).alias("score")) for n, df in plain_tables(t).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return P.fleet_summary(out)
