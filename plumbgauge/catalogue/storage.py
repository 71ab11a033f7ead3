"""Queries: readers, saved tables, versions, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.catalogue.profiling import COLUMNS, union
from plumbgauge.catalogue.registry import Tables, query
from plumbgauge.plans.ranking import number_few
from plumbgauge.plans.stats import local_rows
from plumbgauge.session import staging_path
from plumbgauge.sources import readers as R
from plumbgauge.sources.sql import run_sql, run_statements
from plumbgauge.sources.tables import Versions, list_tables, newest_first, refresh_report, save_table, table_exists

_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
_CUSTOMER_SCHEMA = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@query("scan_csv_roundtrip", _CUSTOMER)
def scan_csv_roundtrip(t: Tables) -> DataFrame:
    path = staging_path(t.spark, "customer_csv")
    t.customer.write.option("header", True).csv(path)
    return R.load_csv(t.spark, path)


@query("scan_tsv_roundtrip", _CUSTOMER)
def scan_tsv_roundtrip(t: Tables) -> DataFrame:
    path = staging_path(t.spark, "customer_tsv")
    t.customer.write.option("header", True).option("sep", "\t").csv(path)
    return R.load_tsv(t.spark, path, _CUSTOMER_SCHEMA)


@query("scan_json_roundtrip", _CUSTOMER)
def scan_json_roundtrip(t: Tables) -> DataFrame:
    path = staging_path(t.spark, "customer_json")
    t.customer.write.json(path)
    return R.load_json(t.spark, path)


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(t: Tables) -> DataFrame:
    return R.load_table(t.spark, f"{t.folder}/orders.parquet")


@query("scan_txt_sniffed", _CUSTOMER)
def scan_txt_sniffed(t: Tables) -> DataFrame:
    path = staging_path(t.spark, "customer_txt")
    t.customer.write.option("header", True).option("sep", "\t").csv(path)
    return R.load_table(t.spark, path, "txt")


@query("promote_header", "SELECT s_nationkey AS doc_id, 1 AS table_no, s_suppkey + 1 AS row_no, 'name' AS column_name, s_name AS value FROM supplier "
                         "UNION ALL SELECT s_nationkey, 1, s_suppkey + 1, 'balance', CAST(CAST(floor(s_acctbal) AS BIGINT) AS STRING) FROM supplier")
def promote_header(t: Tables) -> DataFrame:
    """Cell grids: one per nation with a header row, and one that has only its header."""
    head = F.array(F.lit("name"), F.lit("balance")).alias("cells")
    rows = t.supplier.select(F.col("s_nationkey").alias("doc_id"), F.lit(1).alias("table_no"), (F.col("s_suppkey") + 1).alias("row_no"),
                             F.array("s_name", F.floor("s_acctbal").cast("bigint").cast("string")).alias("cells"))
    heads = rows.select("doc_id").distinct().unionAll(t.spark.sql("SELECT -1 AS doc_id")).select(
        "doc_id", F.lit(1).alias("table_no"), F.lit(0).cast("bigint").alias("row_no"), head)
    return R.promote_header(heads.unionAll(rows), ["doc_id", "table_no"])


# Documents with a number column in which some values are missing by word.
_NOTES = "SELECT doc_id, text, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS n_chars FROM documents"


def _notes(t: Tables, sep: str) -> str:
    path = staging_path(t.spark, "notes")
    number = F.when(F.col("doc_id") % 7 == 0, F.lit("NA")).otherwise(F.col("n_chars").cast("string"))
    t.documents.select("doc_id", "text", number.alias("n_chars")).write.options(header=True, sep=sep, escape='"').csv(path)
    return path


@query("scan_csv_quoted", _NOTES)
def scan_csv_quoted(t: Tables) -> DataFrame:
    return R.load_csv(t.spark, _notes(t, ","))


@query("scan_tsv_quoted", _NOTES)
def scan_tsv_quoted(t: Tables) -> DataFrame:
    return R.load_tsv(t.spark, _notes(t, "\t"))


@query("save_over_itself", "SELECT * FROM part WHERE p_size > 20")
def save_over_itself(t: Tables) -> DataFrame:
    """A table replaced by a filter of itself."""
    root = staging_path(t.spark, "saved")
    first = save_table(t.part, root, "part_twice")
    save_table(first.filter("p_size > 20"), root, "part_twice")
    return Versions(t.spark, root).latest("part_twice")


@query("saved_tables", "SELECT 'part_listed' AS table_name, true AS found UNION ALL SELECT 'no_such_table', false")
def saved_tables(t: Tables) -> DataFrame:
    save_table(t.part, staging_path(t.spark, "saved"), "part_listed")
    rows = [(n, table_exists(t.spark, n) and (n in list_tables(t.spark))) for n in ("part_listed", "no_such_table")]
    return local_rows(t.spark, "table_name string, found boolean", rows)


@query("save_and_reload", "SELECT * FROM part")
def save_and_reload(t: Tables) -> DataFrame:
    return save_table(t.part, staging_path(t.spark, "saved"), "saved_part")


_SELECT = "SELECT c_mktsegment, count(*) AS customers, 'update of drop' AS note FROM customer GROUP BY c_mktsegment"


@query("run_sql_select", _SELECT)
def run_sql_select(t: Tables) -> DataFrame:
    return run_sql(t.spark, _SELECT, {"customer": t.customer})


@query("run_statements_first", _SELECT)
def run_statements_first(t: Tables) -> DataFrame:
    results, _ = run_statements(t.spark, f"; {_SELECT} ;; DROP TABLE customer; SELECT ';' AS semicolon", {"customer": t.customer})
    return results[0]


_REPORT = "SELECT o_orderstatus, count(*) AS orders, CAST(max(o_totalprice) AS DOUBLE) AS largest FROM orders GROUP BY o_orderstatus"


@query("refresh_report", _REPORT)
def report(t: Tables) -> DataFrame:
    return refresh_report(t.spark, "orders_by_status", _REPORT, staging_path(t.spark, "reports"), {"orders": t.orders})


@query("refresh_report_twice", f"SELECT 1 AS run, * FROM ({_REPORT}) UNION ALL SELECT 2, * FROM ({_REPORT.replace('FROM orders', 'FROM orders WHERE o_orderkey % 2 = 0')})")
def refresh_report_twice(t: Tables) -> DataFrame:
    """Both results of two runs over changing tables, read through the register."""
    out = staging_path(t.spark, "reports")
    first = refresh_report(t.spark, "by_status", _REPORT, out, {"orders": t.orders})
    second = refresh_report(t.spark, "by_status", _REPORT, out, {"orders": t.orders.filter("o_orderkey % 2 = 0")})
    return first.select(F.lit(1).alias("run"), "*").unionAll(second.select(F.lit(2).alias("run"), "*"))


@query("run_sql_closed", "SELECT array_to_string([concat(upper(substr(w, 1, 1)), lower(substr(w, 2))) FOR w IN regexp_split_to_array(p_type, '\\s+') IF w <> ''], ' ') "
                         "AS kind, count(*) AS parts, 'INITCAP(x);' AS note FROM part GROUP BY 1")
def run_sql_closed(t: Tables) -> DataFrame:
    """A closing semicolon, and INITCAP over texts with double blanks."""
    spaced = t.part.withColumn("p_type", F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace("p_type", " ", "  ")).otherwise(F.lower("p_type")))
    return run_sql(t.spark, "SELECT INITCAP(TRIM(p_type)) AS kind, count(*) AS parts, 'INITCAP(x);' AS note FROM spaced_part GROUP BY INITCAP(TRIM(p_type));",
                   {"spaced_part": spaced})


# --- versions -----------------------------------------------------------------------------


def _two_versions(t: Tables) -> Versions:
    store = Versions(t.spark, staging_path(t.spark, "versions"))
    store.create("customer", t.customer, "Initial upload")
    store.create("customer", t.customer.filter("c_acctbal >= 0").drop("c_mktsegment"), "Cleaned")
    return store


_MANIFEST_SQL = ("SELECT 'customer' AS table_name, CAST(1 AS BIGINT) AS version_num, concat('Initial upload [Rows: ', CAST(count(*) AS STRING), ', Columns: 5]') AS description, "
                 "count(*) AS row_count, CAST(5 AS BIGINT) AS column_count FROM customer UNION ALL "
                 "SELECT 'customer', 2, concat('Cleaned [Rows: ', CAST(count(*) AS STRING), ', Columns: 4]'), count(*), 4 FROM customer WHERE c_acctbal >= 0")
_MANIFEST = ["table_name", "version_num", "description", "row_count", "column_count"]


@query("version_manifest", _MANIFEST_SQL)
def version_manifest(t: Tables) -> DataFrame:
    return _two_versions(t).manifest().select(_MANIFEST)


@query("versions_desc", f"SELECT *, row_number() OVER (ORDER BY version_num DESC) AS rank FROM ({_MANIFEST_SQL})")
def versions_desc(t: Tables) -> DataFrame:
    return number_few(_two_versions(t).listing("customer").select(_MANIFEST), [F.desc("version_num")])


@query("rollback_equals_v1", _CUSTOMER)
def rollback_equals_v1(t: Tables) -> DataFrame:
    return _two_versions(t).roll_back("customer", 1)[0]


@query("rollback_lasts", _CUSTOMER)
def rollback_lasts(t: Tables) -> DataFrame:
    """What a later session finds current after a roll-back."""
    store = _two_versions(t)
    store.roll_back("customer", 1)
    return Versions(t.spark, store.root).latest("customer")


@query("duplicate_table", _MANIFEST_SQL.replace("SELECT 'customer'", "SELECT 'customer_copy'"))
def duplicate_table(t: Tables) -> DataFrame:
    store = _two_versions(t)
    store.duplicate("customer", "customer_copy")
    return store.manifest().filter("table_name = 'customer_copy'").select(_MANIFEST)


@query("latest_version", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def latest_version(t: Tables) -> DataFrame:
    return _two_versions(t).latest("customer")


@query("catalog_listing", "SELECT *, row_number() OVER (ORDER BY created_day DESC, table_name) AS rank FROM (" + union(
    [f"SELECT '{n}' AS table_name, count(*) AS row_count, {i % 5} AS created_day FROM {n}" for i, n in enumerate(COLUMNS)]) + ")")
def catalog_listing(t: Tables) -> DataFrame:
    parts = [getattr(t, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.lit(i % 5).alias("created_day"))
             for i, n in enumerate(COLUMNS)]
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionAll(p)
    return newest_first(entries, "created_day", "table_name")
