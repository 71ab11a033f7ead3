"""Queries: KPI templates, null transparency, result shaping, chart series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.catalogue.fixtures import DIRTY_SALES, dirty_sales, with_dirty
from plumbgauge.catalogue.profiling import LINE_NUMERIC, SALES_NUMERIC, union
from plumbgauge.catalogue.registry import Tables, query
from plumbgauge.operators import kpi as K
from plumbgauge.operators import shape as S
from plumbgauge.plans.grouped_quantiles import grouped_quantiles
from plumbgauge.plans.pages import PageDirectory
from plumbgauge.plans.ranking import global_rank, top_n
from plumbgauge.sources.sql import run_sql

MISSING = "({c} IS NULL OR trim(CAST({c} AS STRING)) = '' OR lower(CAST({c} AS STRING)) IN ('none', 'nan', 'unknown'))"


def unassigned(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN ('none', 'nan', 'unknown') OR contains(lower({c}), 'unassigned'))"


# --- templates ----------------------------------------------------------------------------


@query("tmpl_total", with_dirty("SELECT CAST(sum(units_sold) AS BIGINT) AS total_units_sold FROM dirty_sales"))
def tmpl_total(t: Tables) -> DataFrame:
    return K.total(dirty_sales(t), "units_sold")


@query("tmpl_group_total", with_dirty("SELECT region, CAST(sum(sale_id) AS BIGINT) AS total_sale_id, "
                                      "row_number() OVER (ORDER BY sum(sale_id) DESC, region NULLS FIRST) AS rank FROM dirty_sales GROUP BY region"))
def tmpl_group_total(t: Tables) -> DataFrame:
    return K.ranked_groups(K.group_total(dirty_sales(t), "region"), [F.desc("total_sale_id"), F.asc("region")])


@query("tmpl_first_n", "SELECT row_number() OVER (ORDER BY o_orderkey) AS rank, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority "
                       "FROM orders ORDER BY o_orderkey LIMIT 5")
def tmpl_first_n(t: Tables) -> DataFrame:
    return K.first_rows(t.orders.drop("o_orderdate"), 5, ["o_orderkey"])


@query("tmpl_count", "SELECT count(*) AS row_count FROM lineitem")
def tmpl_count(t: Tables) -> DataFrame:
    return K.row_count(t.lineitem)


@query("tmpl_project", "SELECT row_number() OVER (ORDER BY o_orderkey) AS rank, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def tmpl_project(t: Tables) -> DataFrame:
    return K.first_rows(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), 10, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("top_n", "SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer "
                "ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_customers(t: Tables) -> DataFrame:
    return top_n(t.customer.select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 10)


@query("bottom_n", "SELECT c_custkey, c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank FROM customer "
                   "ORDER BY c_acctbal, c_custkey LIMIT 10")
def bottom_customers(t: Tables) -> DataFrame:
    return top_n(t.customer.select("c_custkey", "c_name", "c_acctbal"), [F.asc("c_acctbal"), F.asc("c_custkey")], 10)


@query("agg_basic", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total_quantity, round(avg(l_extendedprice), 4) AS avg_price, "
                    "count(*) AS line_count, count(DISTINCT l_partkey) AS part_count FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_basic(t: Tables) -> DataFrame:
    return (t.lineitem.groupBy("l_returnflag", "l_linestatus")
            .agg(F.round(F.sum("l_quantity"), 2).alias("total_quantity"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
                 F.count(F.lit(1)).alias("line_count"), F.count_distinct("l_partkey").alias("part_count")))


@query("safe_ratio_percentage", with_dirty(
    "SELECT channel, round(sum(profit) / nullif(sum(revenue), 0) * 100, 4) AS profit_percentage, "
    "CAST(sum(CASE WHEN units_sold < 0 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN units_sold > 999 THEN 1 ELSE 0 END), 0) AS impossible_ratio "
    "FROM dirty_sales GROUP BY channel"))
def safe_ratio_percentage(t: Tables) -> DataFrame:
    return dirty_sales(t).groupBy("channel").agg(
        F.round(F.try_divide(F.sum("profit"), F.sum("revenue")) * 100, 4).alias("profit_percentage"),
        F.try_divide(F.count_if(F.col("units_sold") < 0).cast("double"), F.count_if(F.col("units_sold") > 999)).alias("impossible_ratio"))


@query("safe_cast_sum", with_dirty(
    "SELECT count(amount) AS parsed, count(amount_text) - count(amount) AS unparsed, sum(amount) AS total_amount, count(sale_day) AS valid_days "
    "FROM (SELECT amount_text, TRY_CAST(regexp_replace(amount_text, '[$,]', '', 'g') AS DOUBLE) AS amount, "
    "try_strptime(sale_date, '%Y-%m-%d') AS sale_day FROM dirty_sales)"))
def safe_cast_sum(t: Tables) -> DataFrame:
    amount = F.regexp_replace("amount_text", "[$,]", "").try_cast("double")
    day = F.try_to_timestamp("sale_date", F.lit("yyyy-MM-dd"))
    return dirty_sales(t).agg(F.count(amount).alias("parsed"), (F.count("amount_text") - F.count(amount)).alias("unparsed"),
                              F.sum(amount).alias("total_amount"), F.count(day).alias("valid_days"))


_INITCAP = ("array_to_string([concat(upper(substr(w, 1, 1)), lower(substr(w, 2))) FOR w IN regexp_split_to_array({c}, '\\s+') IF w <> ''], ' ')")


@query("group_by_normalized_text", with_dirty(f"SELECT CASE WHEN region IS NOT NULL THEN {_INITCAP.format(c='region')} END AS region, count(*) AS sale_count, "
                                              "sum(revenue) AS total_revenue FROM dirty_sales GROUP BY 1"))
def group_by_normalized_text(t: Tables) -> DataFrame:
    return K.normalised_groups(dirty_sales(t), "region", {"sale_count": F.count(F.lit(1)), "total_revenue": F.sum("revenue")})


@query("filter_ci", with_dirty("SELECT sale_id, region, channel FROM dirty_sales WHERE lower(region) = lower('Africa') OR channel ILIKE 'WHOLE%'"))
def filter_ci(t: Tables) -> DataFrame:
    return dirty_sales(t).filter((F.lower("region") == F.lower(F.lit("Africa"))) | F.col("channel").ilike("WHOLE%")).select("sale_id", "region", "channel")


@query("kpi_excluding_unassigned", with_dirty(
    f"SELECT channel, sum(CASE WHEN NOT {unassigned('region')} THEN revenue END) AS assigned_revenue, sum(revenue) AS total_revenue, "
    f"count(CASE WHEN NOT {unassigned('region')} THEN 1 END) AS assigned_rows, count(*) AS total_rows FROM dirty_sales GROUP BY channel"))
def kpi_excluding_unassigned(t: Tables) -> DataFrame:
    assigned = ~K.is_unassigned(F.col("region"))
    return dirty_sales(t).groupBy("channel").agg(
        F.sum(F.when(assigned, F.col("revenue"))).alias("assigned_revenue"), F.sum("revenue").alias("total_revenue"),
        F.count_if(assigned).alias("assigned_rows"), F.count(F.lit(1)).alias("total_rows"))


def _trend(unit: str) -> None:
    sql = (f"SELECT CAST(date_trunc('{unit}', o_orderdate) AS DATE) AS period, count(*) AS order_count, "
           "round(sum(o_totalprice), 2) AS total_price FROM orders GROUP BY 1")

    @query(f"trend_{unit}", sql)
    def trend(t: Tables) -> DataFrame:
        return K.trend(t.orders, "o_orderdate", unit, {"order_count": F.count(F.lit(1)), "total_price": F.round(F.sum("o_totalprice"), 2)})


for _unit in ("year", "quarter", "month", "week", "day"):
    _trend(_unit)


@query("overview_totals", union([f"SELECT '{c}' AS metric, round(sum({c}), 2) AS total, round(avg({c}), 4) AS average FROM lineitem" for c in LINE_NUMERIC if not c.endswith(("key", "number"))]))
def overview_totals(t: Tables) -> DataFrame:
    return K.overview(t.lineitem)["totals"].select("metric", F.round("total", 2).alias("total"), F.round("average", 4).alias("average"))


@query("overview_category", "SELECT l_returnflag, round(sum(l_quantity), 2) AS total_l_quantity FROM lineitem GROUP BY l_returnflag")
def overview_category(t: Tables) -> DataFrame:
    return K.overview(t.lineitem)["by_l_returnflag"].withColumn("total_l_quantity", F.round("total_l_quantity", 2))


@query("overview_trend", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, round(sum(l_quantity), 2) AS total_l_quantity FROM lineitem GROUP BY 1")
def overview_trend(t: Tables) -> DataFrame:
    return K.overview(t.lineitem)["trend"].withColumn("total_l_quantity", F.round("total_l_quantity", 2))


@query("overview_top", "SELECT p_name, round(sum(p_size), 2)::BIGINT AS total_p_size, row_number() OVER (ORDER BY sum(p_size) DESC, p_name) AS rank "
                       "FROM part GROUP BY p_name ORDER BY 2 DESC, p_name LIMIT 5")
def overview_top(t: Tables) -> DataFrame:
    return K.overview(t.part)["top"]


_ONE_PASS = [("part", "p_name", "p_name", "p_size"), ("part", "p_brand", "p_brand", "p_size"), ("part", "p_type", "p_type", "p_size"),
             ("lineitem", "l_returnflag", "l_returnflag", "l_quantity"), ("lineitem", "l_linestatus", "l_linestatus", "l_quantity"),
             ("lineitem", "month", "strftime(date_trunc('month', l_shipdate), '%Y-%m-%d')", "l_quantity")]


@query("overview_one_pass", union([f"SELECT '{table}' AS table_name, '{d}' AS dimension, {v} AS value, count(*) AS row_count, round(CAST(sum({m}) AS DOUBLE), 2) AS total FROM {table} GROUP BY {v}"
                                   for table, d, v, m in _ONE_PASS]))
def overview_one_pass(t: Tables) -> DataFrame:
    """The groups of every dimension of a table, from one scan of each."""
    parts = [K.overview_groups(getattr(t, n)).select(F.lit(n).alias("table_name"), "dimension", "value", "row_count", F.round(F.col("total").cast("double"), 2).alias("total"))
             for n in ("part", "lineitem")]
    return parts[0].unionAll(parts[1])


@query("overview_one_pass_best", "SELECT * FROM (" + union(
    [f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS row_count, sum(p_size)::BIGINT AS total, row_number() OVER (ORDER BY sum(p_size) DESC, {d}) AS rank FROM part GROUP BY {d}"
     for d in ("p_name", "p_brand", "p_type")]) + ") WHERE rank <= 3")
def overview_one_pass_best(t: Tables) -> DataFrame:
    return K.overview_groups(t.part, best=3)


_TOP_BOTTOM = """(SELECT 'top' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
UNION ALL (SELECT 'bottom' AS side, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5)"""


@query("union_top_bottom", _TOP_BOTTOM)
def union_top_bottom(t: Tables) -> DataFrame:
    return run_sql(t.spark, _TOP_BOTTOM, {"customer": t.customer})


@query("result_summary_numeric", with_dirty(union(
    [f"SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean_value, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM dirty_sales"
     for c in SALES_NUMERIC])))
def result_summary_numeric(t: Tables) -> DataFrame:
    return K.summary_numeric(dirty_sales(t)).withColumn("mean_value", F.round("mean_value", 4))


_SALES_TEXT = [c for c in DIRTY_SALES if c not in SALES_NUMERIC]


@query("result_summary_top3", with_dirty("SELECT column_name, value, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name "
                                         "ORDER BY frequency DESC, value) AS rank FROM counted) WHERE rank <= 3",
                                         "counted AS (" + union([f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS frequency FROM dirty_sales "
                                                                 f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in _SALES_TEXT]) + ")"))
def result_summary_top3(t: Tables) -> DataFrame:
    return K.summary_top(dirty_sales(t))


# --- null transparency --------------------------------------------------------------------

LABEL = "CASE WHEN " + unassigned("{c}") + " THEN '⚠️ Unassigned (Missing {title})' ELSE {c} END"
REGION_LABEL = LABEL.format(c="region", title="Region")
GROUPED_SQL = ("grouped AS (SELECT region, sum(revenue) AS total_revenue, CAST(sum(units_sold) AS BIGINT) AS total_units FROM dirty_sales GROUP BY region), "
               f"labelled AS (SELECT {REGION_LABEL} AS region, total_revenue, total_units FROM grouped)")


def _sales_metrics() -> dict:
    return {"total_revenue": F.sum("revenue"), "total_units": F.sum("units_sold")}


@query("label_unassigned", with_dirty("SELECT * FROM labelled", GROUPED_SQL))
def label_unassigned(t: Tables) -> DataFrame:
    groups = dirty_sales(t).groupBy("region").agg(*[m.alias(n) for n, m in _sales_metrics().items()])
    return K.label_unassigned(groups, ["region"])


@query("unassigned_last", with_dirty("SELECT *, row_number() OVER (ORDER BY contains(region, 'Unassigned'), total_revenue DESC, region) AS rank FROM labelled", GROUPED_SQL))
def unassigned_last(t: Tables) -> DataFrame:
    groups = dirty_sales(t).groupBy("region").agg(*[m.alias(n) for n, m in _sales_metrics().items()])
    labelled = K.label_unassigned(groups, ["region"])
    return K.ranked_groups(labelled, K.unassigned_last(labelled, ["region"], [F.desc("total_revenue"), F.asc("region")]))


@query("grouped_kpi", with_dirty(
    "SELECT labelled.*, (SELECT round(count(CASE WHEN NOT " + MISSING.format(c="region") + " THEN 1 END) * 100.0 / count(*), 1)::DOUBLE FROM dirty_sales) "
    "AS region_completeness_pct FROM labelled", GROUPED_SQL))
def grouped_kpi(t: Tables) -> DataFrame:
    return K.grouped_kpi(dirty_sales(t), ["region"], _sales_metrics())


_ANY_MISSING = f"({MISSING.format(c='region')} OR {MISSING.format(c='promo_active')})"


@query("null_transparency", with_dirty(
    f"SELECT count(*) AS total_rows, count(CASE WHEN {_ANY_MISSING} THEN 1 END) AS rows_without_key, "
    f"round(CAST(coalesce(sum(CASE WHEN {_ANY_MISSING} THEN units_sold END), 0) AS DOUBLE), 2) AS units_without_key, "
    f"round(coalesce(sum(CASE WHEN {_ANY_MISSING} THEN revenue END), 0), 2) AS revenue_without_key, "
    "count(*) - count(units_sold) AS null_units_count, count(*) - count(revenue) AS null_revenue_count FROM dirty_sales"))
def null_transparency(t: Tables) -> DataFrame:
    return K.null_transparency(dirty_sales(t), ["region", "promo_active"])


_DIMS = ["region", "promo_active", "channel"]


@query("dimension_completeness", with_dirty(union(
    [f"SELECT '{d}' AS dimension, count(CASE WHEN NOT {MISSING.format(c=d)} THEN 1 END) AS valid_rows, count(*) AS total_rows, "
     f"round(count(CASE WHEN NOT {MISSING.format(c=d)} THEN 1 END) * 100.0 / count(*), 1)::DOUBLE AS completeness_pct FROM dirty_sales" for d in _DIMS])))
def dimension_completeness(t: Tables) -> DataFrame:
    return K.dimension_completeness(dirty_sales(t), _DIMS)


@query("unattributed_totals", with_dirty(union(
    [f"SELECT '{d}' AS dimension, count(*) AS missing_rows, CAST(coalesce(sum(units_sold), 0) AS DOUBLE) AS units, coalesce(sum(revenue), 0) AS revenue "
     f"FROM dirty_sales WHERE {MISSING.format(c=d)} HAVING count(*) > 0" for d in _DIMS])))
def unattributed_totals(t: Tables) -> DataFrame:
    return K.unattributed_totals(dirty_sales(t), _DIMS)


# --- result shaping -----------------------------------------------------------------------


@query("search_rows", with_dirty("SELECT * FROM dirty_sales WHERE " + " OR ".join(f"contains(lower(coalesce(CAST({c} AS STRING), '')), 'afric')" for c in DIRTY_SALES)))
def search_rows(t: Tables) -> DataFrame:
    return S.search_rows(dirty_sales(t), "AfriC")


@query("search_messages", "SELECT conv_id, turn, role, text FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(role), 'the')")
def search_messages(t: Tables) -> DataFrame:
    return S.search_rows(t.conversations, "THE", ["text", "role"])


_NUMBERED = "numbered AS (SELECT DISTINCT sale_id, " + REGION_LABEL + " AS region, revenue FROM dirty_sales)"


@query("sort_nulls_last", with_dirty("SELECT *, row_number() OVER (ORDER BY contains(region, 'Unassigned'), revenue DESC NULLS LAST, sale_id) AS rank FROM "
                                     "(SELECT DISTINCT sale_id, region, revenue FROM numbered)", _NUMBERED))
def sort_nulls_last(t: Tables) -> DataFrame:
    rows = K.label_unassigned(dirty_sales(t).select("sale_id", "region", "revenue"), ["region"]).distinct()
    order = S.sort_keys("revenue", ["sale_id"], descending=True)
    return global_rank(rows, [K.has_unassigned(["region"]).cast("int").asc(), *order[1:]])


@query("sort_text_ascending", "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS rank FROM orders")
def sort_text_ascending(t: Tables) -> DataFrame:
    return S.sort_rows(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["o_orderkey"])


@query("paginate", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders "
                   "ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paginate(t: Tables) -> DataFrame:
    return S.paginate(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], page=3, size=20)


@query("grouped_percentiles", "WITH o AS (SELECT CASE WHEN o_orderkey % 10 > 0 THEN 'most' ELSE o_orderpriority END AS kind, o_totalprice, o_custkey FROM orders), "
       + "q AS (" + union([f"SELECT kind, '{c}' AS column_name, CAST({p} AS DOUBLE) AS probability, round(quantile_cont({c}::DOUBLE, {p}), 4) AS value FROM o GROUP BY kind"
                           for c in ("o_totalprice", "o_custkey") for p in (0.05, 0.5, 0.999)]) + ") SELECT * FROM q")
def grouped_percentiles(t: Tables) -> DataFrame:
    """Exact percentiles of several groups of which one has nine tenths of the rows."""
    kind = F.when(F.col("o_orderkey") % 10 > 0, F.lit("most")).otherwise(F.col("o_orderpriority"))
    told = grouped_quantiles(t.orders.select(kind.alias("kind"), "o_totalprice", "o_custkey"), ["kind"], ["o_totalprice", "o_custkey"], [0.05, 0.5, 0.999])
    return told.withColumn("value", F.round("value", 4))


@query("paginate_deep", "SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM (SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem) "
                        "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20 OFFSET 4980")
def paginate_deep(t: Tables) -> DataFrame:
    """A page far into a table, through a directory of its sorted files."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return PageDirectory.build(rows, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]).page(250, 20)


@query("report_preview", "SELECT row_number() OVER (ORDER BY doc_id) AS rank, substr(CAST(doc_id AS STRING), 1, 20) AS doc_id, coalesce(substr(text, 1, 20), '') AS text, "
                         "substr(lang, 1, 20) AS lang, substr(source, 1, 20) AS source, substr(CAST(n_chars AS STRING), 1, 20) AS n_chars FROM documents ORDER BY documents.doc_id LIMIT 10")
def report_preview(t: Tables) -> DataFrame:
    return S.preview(t.documents, [F.asc("doc_id")])


@query("pie_shares", with_dirty(f"SELECT region AS label, value, round(value / sum(value) OVER (), 6) AS share FROM (SELECT region, sum(revenue) AS value FROM dirty_sales "
                                f"WHERE NOT {unassigned('region')} GROUP BY region)"))
def pie_shares(t: Tables) -> DataFrame:
    return S.chart_series(dirty_sales(t), "pie", "region", "revenue").withColumn("share", F.round("share", 6))


def _monthly(t: Tables) -> DataFrame:
    return K.trend(t.orders, "o_orderdate", "month", {"total_price": F.round(F.sum("o_totalprice"), 2)})


@query("series_line", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1")
def series_line(t: Tables) -> DataFrame:
    return S.chart_series(_monthly(t), "line")


@query("series_bar", "SELECT substr(p_name, 1, 15) AS x, round(sum(p_retailprice), 2) AS y FROM part GROUP BY p_name")
def series_bar(t: Tables) -> DataFrame:
    return S.chart_series(t.part.groupBy("p_name").agg(F.round(F.sum("p_retailprice"), 2).alias("total")), "bar")


@query("series_scatter", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
def series_scatter(t: Tables) -> DataFrame:
    return S.chart_series(t.lineitem, "scatter", "l_quantity", "l_extendedprice")


@query("histogram", """WITH s AS (SELECT min(value) AS low, max(value) AS high, least(15, count(DISTINCT value)) AS bins FROM events),
  c AS (SELECT CAST(least(floor((value - low) / ((high - low) / bins)), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM events, s GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(low + g.bin * ((high - low) / bins), 6) AS bin_start, round(low + (g.bin + 1) * ((high - low) / bins), 6) AS bin_end,
  coalesce(n, 0) AS frequency FROM s, (SELECT unnest(range(15)) AS bin) g LEFT JOIN c ON c.bin = g.bin WHERE g.bin < bins""")
def histogram(t: Tables) -> DataFrame:
    return S.chart_series(t.events, "histogram", "value").withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


@query("box_stats", union(
    [f"SELECT '{c}' AS column_name, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3, "
     f"min(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) THEN {c} END) AS whisker_low, max(CASE WHEN {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END) AS whisker_high, "
     f"count(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers FROM lineitem, "
     f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.75) AS q3 FROM lineitem) AS st" for c in LINE_NUMERIC]))
def box_stats(t: Tables) -> DataFrame:
    return S.box_stats(t.lineitem, LINE_NUMERIC).withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


def _corr_sql() -> str:
    return union([f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem"
                  for a in LINE_NUMERIC for b in LINE_NUMERIC if a != b]
                 + [f"SELECT '{a}', '{a}', CAST(1.0 AS DOUBLE)" for a in LINE_NUMERIC])


@query("correlation_matrix", _corr_sql())
def correlation_matrix(t: Tables) -> DataFrame:
    return S.chart_series(t.lineitem.select(LINE_NUMERIC), "heatmap").withColumn("r", F.round("r", 6))


@query("correlation_matrix_wide", "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) "
                                  "SELECT concat('c', CAST(a.i AS STRING)) AS x, concat('c', CAST(b.i AS STRING)) AS y, round(corr(a.x, b.x), 6) AS r "
                                  "FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY ALL")
def correlation_matrix_wide(t: Tables) -> DataFrame:
    """The components of vectors as columns."""
    wide = t.embeddings.select(*[F.col("embedding")[i].alias(f"c{i}") for i in range(64)])
    return S.correlation_matrix(wide).withColumn("r", F.round("r", 6))


@query("missing_axes", "SELECT 'no_such_column' AS axis, count(*) AS row_count FROM orders")
def missing_axes(t: Tables) -> DataFrame:
    """Axes asked for that a result does not have, with the result's rows."""
    absent = S.missing_axes(t.orders, "o_orderstatus", "no_such_column")
    return t.orders.agg(F.count(F.lit(1)).alias("row_count")).select(F.explode(F.array(*[F.lit(a) for a in absent])).alias("axis"), "row_count")


_SPECIAL = "CASE l_linenumber WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END"


@query("json_safe_values", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_quantity END AS quantity FROM lineitem")
def json_safe_values(t: Tables) -> DataFrame:
    return S.json_safe(t.lineitem.select("l_orderkey", "l_linenumber", F.expr(_SPECIAL).alias("quantity")))
