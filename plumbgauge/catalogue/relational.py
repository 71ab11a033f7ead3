"""Acceptance queries: relational SQL that passes straight through to Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from plumbgauge.catalogue.registry import TABLES, Tables, query
from plumbgauge.plans.segments import asof_join
from plumbgauge.sources.sql import run_sql


def passthrough(name: str, text: str, sql: str | None = None) -> None:
    """Register a query given as Spark SQL text; ``sql`` is the reference text where the dialects differ."""
    @query(name, sql or text)
    def run(t: Tables) -> DataFrame:
        return run_sql(t.spark, text, {name: getattr(t, name) for name in TABLES if re.search(rf"\b{name}\b", text)})


passthrough("p_filter_project", """SELECT "l_orderkey", l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net_price,
  CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'small' WHEN l_quantity <= 30 THEN 'medium' ELSE 'large' END AS size_class
FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%' AND l_returnflag ILIKE 'a%'""")

passthrough("p_join_inner", """SELECT r_name, n_name, count(*) AS order_count, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")

passthrough("p_join_left", """SELECT c_custkey, count(o_orderkey) AS order_count FROM customer LEFT JOIN orders
ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey""")

passthrough("p_join_right", """SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")

passthrough("p_join_full", """SELECT d.doc_id AS document, l.doc_id AS labelled, l.quality FROM documents d FULL OUTER JOIN
(SELECT doc_id + 7 AS doc_id, quality FROM labels) l ON d.doc_id = l.doc_id""")

passthrough("p_semi", """SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
passthrough("p_anti", """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")

passthrough("p_range_join", """SELECT b.band, count(*) AS parts, round(avg(p_retailprice), 4) AS avg_price FROM part JOIN
(SELECT p_type AS band, min(p_retailprice) AS low, avg(p_retailprice) AS high FROM part GROUP BY p_type) b
ON p_retailprice >= b.low AND p_retailprice < b.high GROUP BY b.band""")

passthrough("p_theta_join", """SELECT a.r_name AS left_region, b.r_name AS right_region FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey""")


@query("p_asof", """SELECT p.event_id, p.user_id, p.ts, c.ts AS asof_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def p_asof(t: Tables) -> DataFrame:
    purchases = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = t.events.filter("event_type = 'click'").select("user_id", "ts")
    return asof_join(purchases, clicks, "user_id", "ts", "ts", [])


passthrough("p_group_having", """SELECT o_orderpriority, count(*) AS order_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished
FROM orders GROUP BY ALL HAVING count(*) > 10""",
            """SELECT o_orderpriority, count(*) AS order_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished
FROM orders GROUP BY o_orderpriority HAVING count(*) > 10""")
passthrough("p_group_ordinal", """SELECT date_trunc('year', o_orderdate) AS year_start, o_orderstatus, count(*) AS order_count FROM orders GROUP BY 1, 2""")
passthrough("p_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")

passthrough("p_rollup", """SELECT l_returnflag, l_linestatus, count(*) AS line_count, round(sum(l_quantity), 2) AS quantity, grouping(l_linestatus) AS is_total
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
            """SELECT l_returnflag, l_linestatus, count(*) AS line_count, round(sum(l_quantity), 2) AS quantity, CAST(grouping(l_linestatus) AS INTEGER) AS is_total
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
passthrough("p_cube", "SELECT l_returnflag, l_linestatus, count(*) AS line_count FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
passthrough("p_grouping_sets", """SELECT o_orderstatus, o_orderpriority, count(*) AS order_count FROM orders
GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")

# Ranking windows run over grouped rows, bounded by the dimensions.
_BRANDS = """(SELECT p_type, p_brand, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type, p_brand)"""
_RANKS = """SELECT p_type, p_brand, quantity, {0}rank() OVER w{1} AS place, {0}dense_rank() OVER w{1} AS dense_place,
  {0}row_number() OVER w{1} AS row_no, {0}ntile(4) OVER w{1} AS quarter FROM """ + _BRANDS + """
WINDOW w AS (PARTITION BY p_type ORDER BY quantity DESC, p_brand)"""
passthrough("p_rank", _RANKS.format("", ""), _RANKS.format("CAST(", " AS INTEGER)"))

_MONTHS = """(SELECT date_trunc('month', o_orderdate) AS month_start, CAST(count(*) AS BIGINT) AS order_count FROM orders GROUP BY 1)"""
passthrough("p_running_total", f"""SELECT month_start, order_count, CAST(sum(order_count) OVER (ORDER BY month_start ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running,
  round(avg(order_count) OVER (ORDER BY month_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_avg FROM {_MONTHS}""")
passthrough("p_lag_growth", f"""SELECT month_start, order_count, lag(order_count) OVER (ORDER BY month_start) AS previous,
  lead(order_count) OVER (ORDER BY month_start) AS following, first_value(order_count) OVER (ORDER BY month_start) AS first_count,
  round(CAST(order_count - lag(order_count) OVER (ORDER BY month_start) AS DOUBLE) * 100 / nullif(lag(order_count) OVER (ORDER BY month_start), 0), 4) AS growth_percentage FROM {_MONTHS}""")
passthrough("p_qualify", f"""SELECT p_type, p_brand, quantity FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY quantity DESC, p_brand) AS r FROM {_BRANDS}) WHERE r <= 2""",
            f"""SELECT p_type, p_brand, quantity FROM {_BRANDS} QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY quantity DESC, p_brand) <= 2""")

passthrough("p_topk", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5""")

passthrough("p_union", """SELECT c_nationkey AS nation_key FROM customer UNION SELECT s_nationkey FROM supplier""")
passthrough("p_union_all", """SELECT 'customer' AS kind, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier""")
passthrough("p_intersect", """SELECT c_nationkey AS nation_key FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier""")
passthrough("p_except", """SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")

passthrough("p_cte", """WITH per_customer AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey),
  average AS (SELECT avg(spent) AS mean_spent FROM per_customer)
SELECT o_custkey, round(spent, 2) AS spent FROM per_customer WHERE spent > (SELECT mean_spent * 2 FROM average)""")
passthrough("p_correlated", """SELECT p_partkey, p_brand, p_retailprice FROM part a WHERE p_retailprice =
(SELECT max(p_retailprice) FROM part b WHERE b.p_brand = a.p_brand)""")
passthrough("p_in_subquery", """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")

passthrough("p_string_fns", """SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, length(c_name) AS len, substr(c_name, 1, 4) AS head,
  replace(c_name, '#', '-') AS replaced, concat(c_name, '/', c_mktsegment) AS joined, lpad(CAST(c_nationkey AS STRING), 3, '0') AS padded, reverse(c_name) AS backwards FROM customer""",
            """SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, CAST(length(c_name) AS INTEGER) AS len, substr(c_name, 1, 4) AS head,
  replace(c_name, '#', '-') AS replaced, concat(c_name, '/', c_mktsegment) AS joined, lpad(CAST(c_nationkey AS STRING), 3, '0') AS padded, reverse(c_name) AS backwards FROM customer""")
passthrough("p_math_fns", """SELECT c_custkey, abs(c_acctbal) AS size, round(sqrt(abs(c_acctbal)), 6) AS root, CAST(floor(c_acctbal) AS BIGINT) AS low, CAST(ceil(c_acctbal) AS BIGINT) AS high,
  c_custkey % 7 AS rest, round(power(c_nationkey, 2), 2) AS squared, sign(c_acctbal) AS direction, round(ln(abs(c_acctbal) + 1), 6) AS logged FROM customer""",
            """SELECT c_custkey, abs(c_acctbal) AS size, round(sqrt(abs(c_acctbal)), 6) AS root, CAST(floor(c_acctbal) AS BIGINT) AS low, CAST(ceil(c_acctbal) AS BIGINT) AS high,
  c_custkey % 7 AS rest, round(power(c_nationkey, 2), 2) AS squared, CAST(sign(c_acctbal) AS DOUBLE) AS direction, round(ln(abs(c_acctbal) + 1), 6) AS logged FROM customer""")
passthrough("p_date_fns", """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(dayofmonth(o_orderdate) AS BIGINT) AS d,
  CAST(quarter(o_orderdate) AS BIGINT) AS q, date_format(o_orderdate, 'yyyy/MM/dd') AS text_date, CAST(o_orderdate + INTERVAL 30 DAYS AS DATE) AS due,
  datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS age_days, CAST(last_day(o_orderdate) AS DATE) AS month_end FROM orders""",
            """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS d, quarter(o_orderdate) AS q,
  strftime(o_orderdate, '%Y/%m/%d') AS text_date, CAST(o_orderdate + INTERVAL 30 DAYS AS DATE) AS due,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS age_days, last_day(o_orderdate) AS month_end FROM orders""")

passthrough("p_json_props", """SELECT event_type, count(*) AS event_count, CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total FROM events GROUP BY event_type""",
            """SELECT event_type, count(*) AS event_count, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_total FROM events GROUP BY event_type""")
passthrough("p_array_fns", """SELECT vec_id, size(embedding) AS width, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE)), 0D, (a, x) -> a + x), 4) AS total,
  size(filter(embedding, x -> x > 0)) AS positives, round(CAST(array_max(embedding) AS DOUBLE), 4) AS largest FROM embeddings""",
            """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width, round(list_sum([x::DOUBLE FOR x IN embedding]), 4) AS total,
  CAST(len([x FOR x IN embedding IF x > 0]) AS INTEGER) AS positives, round(list_max(embedding)::DOUBLE, 4) AS largest FROM embeddings""")
passthrough("p_explode", """SELECT word, count(*) AS frequency FROM (SELECT explode(split(p_name, ' ')) AS word FROM part) GROUP BY word""",
            """SELECT word, count(*) AS frequency FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word""")
passthrough("p_stats", """SELECT l_returnflag, round(percentile(l_quantity, 0.9), 4) AS p90, round(median(l_extendedprice), 4) AS mid, mode() WITHIN GROUP (ORDER BY l_linenumber) AS common,
  round(stddev_samp(l_discount), 6) AS sd, round(var_pop(l_tax), 8) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag""",
            """SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 4) AS p90, round(median(l_extendedprice), 4) AS mid,
  (SELECT x.l_linenumber FROM lineitem x WHERE x.l_returnflag = o.l_returnflag GROUP BY x.l_linenumber ORDER BY count(*) DESC, x.l_linenumber LIMIT 1) AS common,
  round(stddev_samp(l_discount), 6) AS sd, round(var_pop(l_tax), 8) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem o GROUP BY l_returnflag""")
passthrough("p_pivot", """SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(l_quantity) FOR l_linestatus IN ('O' AS open_lines, 'F' AS finished_lines))""",
            """SELECT l_returnflag, nullif(count(CASE WHEN l_linestatus = 'O' THEN 1 END), 0) AS open_lines, nullif(count(CASE WHEN l_linestatus = 'F' THEN 1 END), 0) AS finished_lines
FROM lineitem GROUP BY l_returnflag""")
passthrough("p_unpivot", """SELECT doc_id, measure, CAST(score AS INT) AS score FROM labels UNPIVOT (score FOR measure IN (quality, toxic))""")
passthrough("p_except_columns", """SELECT * EXCEPT (o_orderdate, o_custkey) FROM orders""", """SELECT * EXCLUDE (o_orderdate, o_custkey) FROM orders""")
passthrough("p_collect", """SELECT c_nationkey, concat_ws(',', sort_array(collect_set(c_mktsegment))) AS segments FROM customer GROUP BY c_nationkey""",
            """SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey""")
passthrough("p_approx_distinct", """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, approx_count_distinct(l_partkey) BETWEEN 0.85 * count(DISTINCT l_partkey) AND 1.15 * count(DISTINCT l_partkey) AS near FROM lineitem GROUP BY l_returnflag""",
            "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY l_returnflag")
