"""KPI questions: totals, groups, trends, rankings, and how much could not be attributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgauge.functions import lexicon as L
from plumbgauge.functions.text import initcap_ws
from plumbgauge.operators.schema import roles_of
from plumbgauge.plans.ranking import global_rank, top_n
from plumbgauge.plans.stats import col, columns_to_rows, fields, is_numeric, numeric_columns, text_columns
from plumbgauge.session import materialise


def main_metric(df: DataFrame) -> str:
    """``sales`` if there is one, else the first numeric column."""
    if "sales" in df.columns:
        return "sales"
    numbers = numeric_columns(df)
    if not numbers:
        raise ValueError("the table has no numeric column")
    return numbers[0]


def total(df: DataFrame, metric: str | None = None) -> DataFrame:
    metric = metric or main_metric(df)
    return df.agg(F.sum(col(metric)).alias(f"total_{metric}"))


def group_total(df: DataFrame, dim: str, metric: str | None = None) -> DataFrame:
    """Sum per group, largest first; the group key settles ties."""
    metric = metric or main_metric(df)
    return (df.groupBy(col(dim)).agg(F.sum(col(metric)).alias(f"total_{metric}"))
            .orderBy(F.desc(f"total_{metric}"), F.asc(dim)))


def first_rows(df: DataFrame, n: int, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """First ``n`` rows by a key, with their position; optionally only some columns."""
    ranked = top_n(df, [F.asc(o) for o in order], n)
    return ranked.select("rank", *[col(c) for c in columns or df.columns])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def trend(df: DataFrame, date: str, unit: str, metrics: dict[str, Column]) -> DataFrame:
    """Metrics per year, quarter, month, week or day, in time order."""
    if unit not in ("year", "quarter", "month", "week", "day"):
        raise ValueError(f"unknown time unit: {unit}")
    return (df.groupBy(F.date_trunc(unit, col(date)).cast("date").alias("period"))
            .agg(*[m.alias(n) for n, m in metrics.items()]).orderBy("period"))


def normalised_groups(df: DataFrame, dim: str, metrics: dict[str, Column]) -> DataFrame:
    """Group by the white-space and case normalised text."""
    return df.groupBy(initcap_ws(col(dim)).alias(dim)).agg(*[m.alias(n) for n, m in metrics.items()])


# --- unassigned groups --------------------------------------------------------------------


def unassigned_label(name: str) -> str:
    return f"{L.UNASSIGNED_PREFIX} (Missing {name.replace('_', ' ').title()})"


def is_unassigned(c: Column) -> Column:
    """Missing as a group key: null, none, nan, unknown, or labelled unassigned. Blank is not."""
    text = F.lower(c.cast("string"))
    return (F.coalesce(F.trim(text).isin(L.MISSING_WORDS) | F.contains(text, F.lit("unassigned")), F.lit(True)))


def label_unassigned(df: DataFrame, dims: list[str]) -> DataFrame:
    """Give missing group keys a readable label."""
    return df.withColumns({d: F.when(is_unassigned(col(d)), unassigned_label(d)).otherwise(col(d).cast("string"))
                           for d in dims})


def has_unassigned(dims: list[str]) -> Column:
    out = F.lit(False)
    for d in dims:
        out = out | F.coalesce(F.contains(col(d).cast("string"), F.lit(L.UNASSIGNED_PREFIX)), F.lit(False))
    return out


def unassigned_last(df: DataFrame, dims: list[str], order: list[Column]) -> list[Column]:
    """Sort keys that move labelled rows to the end and keep the order otherwise."""
    return [has_unassigned(dims).cast("int").asc(), *order]


def grouped_kpi(df: DataFrame, dims: list[str], metrics: dict[str, Column], order_by: str | None = None) -> DataFrame:
    """Metrics per group, missing keys labelled and listed last, each dimension's completeness alongside.

    Groups are formed on the keys as they are, so null and ``unknown`` stay two rows. The input is read
    once: completeness comes from the row counts of the groups, which are written for that second use.
    """
    order_by = order_by or next(iter(metrics))
    groups = materialise(df.groupBy(*[col(d) for d in dims]).agg(*[m.alias(n) for n, m in metrics.items()], F.count(F.lit(1)).alias("_rows")), "groups")
    shares = {}
    for d in dims:
        valid = F.coalesce(F.sum(F.when(~is_missing(col(d)), F.col("_rows"))), F.lit(0))
        shares[f"{d}_completeness_pct"] = groups.agg(F.round(F.try_divide(valid * 100.0, F.sum("_rows")), 1)).scalar()
    done = label_unassigned(groups.drop("_rows"), dims).withColumns(shares)
    return done.orderBy(*unassigned_last(done, dims, [F.desc_nulls_last(order_by), *[F.asc(d) for d in dims]]))


# --- null transparency --------------------------------------------------------------------


def is_missing(c: Column) -> Column:
    """Missing as source data: null, blank, none, nan or unknown."""
    text = c.cast("string")
    return c.isNull() | (F.trim(text) == "") | F.lower(text).isin(L.MISSING_WORDS)


def _aliases(df: DataFrame, names: list[str]) -> list[str]:
    return [c for c in df.columns if c.lower() in names]


def _amount(df: DataFrame, columns: list[str], cond: Column) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(F.sum(F.when(cond, col(c).cast("double"))), F.lit(0.0))
    return out


def null_transparency(df: DataFrame, dims: list[str]) -> DataFrame:
    """Total rows, rows without a key in any dimension with their units and revenue, and null metrics.

    A single conditional aggregation.
    """
    units, revenue = _aliases(df, L.UNITS_ALIASES), _aliases(df, L.REVENUE_ALIASES)
    cond = F.lit(False)
    for d in dims:
        cond = cond | is_missing(col(d))
    nulls = {n: sum((F.count_if(col(c).isNull()) for c in cols), F.lit(0).cast("bigint"))
             for n, cols in (("null_units_count", units), ("null_revenue_count", revenue))}
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(cond).alias("rows_without_key"),
                  F.round(_amount(df, units, cond), 2).alias("units_without_key"),
                  F.round(_amount(df, revenue, cond), 2).alias("revenue_without_key"),
                  *[e.alias(n) for n, e in nulls.items()])


def _per_dimension(df: DataFrame, dims: list[str], extra) -> DataFrame:
    aggs, structs = [F.count(F.lit(1)).alias("n")], []
    for i, d in enumerate(dims):
        cond = is_missing(col(d))
        more = extra(cond)
        aggs += [F.count_if(cond).alias(f"missing{i}"), *[e.alias(f"{n}{i}") for n, e in more.items()]]
        structs.append(F.struct(F.lit(d).alias("dimension"), F.col("n").alias("total_rows"),
                                F.col(f"missing{i}").alias("missing_rows"),
                                *[F.col(f"{n}{i}").alias(n) for n in more]))
    return columns_to_rows(df.agg(*aggs), structs)


def dimension_completeness(df: DataFrame, dims: list[str]) -> DataFrame:
    """Rows with a valid key per dimension, and their share with one decimal."""
    valid = F.col("total_rows") - F.col("missing_rows")
    return (_per_dimension(df, dims, lambda _: {})
            .select("dimension", valid.alias("valid_rows"), "total_rows",
                    F.coalesce(F.round(F.try_divide(valid * 100.0, F.col("total_rows")), 1), F.lit(0.0))
                    .alias("completeness_pct")))


def unattributed_totals(df: DataFrame, dims: list[str]) -> DataFrame:
    """Rows, units and revenue that no group of a dimension can claim; dimensions without gaps are left out."""
    units, revenue = _aliases(df, L.UNITS_ALIASES)[:1], _aliases(df, L.REVENUE_ALIASES)[:1]
    return (_per_dimension(df, dims, lambda cond: {"units": _amount(df, units, cond),
                                                   "revenue": _amount(df, revenue, cond)})
            .filter("missing_rows > 0")
            .select("dimension", "missing_rows", "units", "revenue"))


# --- overview and result summary ----------------------------------------------------------


def _overview_columns(df: DataFrame, roles: dict[str, str] | None) -> tuple[list[str], list[str], list[str]]:
    """Metrics, dimensions and dates."""
    roles = roles or roles_of(df)
    return ([c for c in numeric_columns(df) if roles[c] == "BUSINESS_METRIC"], [c for c in text_columns(df) if roles[c] == "DIMENSION"],
            [c for c, t in fields(df).items() if roles[c] == "DATE" and not is_numeric(t)])


def overview_groups(df: DataFrame, roles: dict[str, str] | None = None, best: int | None = None) -> DataFrame:
    """(dimension, value, row_count, total): the first metric by every dimension, and by month of the first date as ``month``, from one scan.

    A row is dealt to all its groups at once and summed in its task, so further dimensions cost no further scan. With ``best``, only the groups with the
    so many largest totals of each dimension, as ``rank`` says; every task forwards no more of a dimension.
    """
    metrics, dims, dates = _overview_columns(df, roles)
    cells = [F.struct(F.lit(d).alias("dimension"), col(d).cast("string").alias("value")) for d in dims]
    cells += [F.struct(F.lit("month").alias("dimension"), F.date_format(F.date_trunc("month", col(d)), "yyyy-MM-dd").alias("value")) for d in dates[:1]]
    if not metrics or not cells:
        return df.sparkSession.createDataFrame([], "dimension string, value string, row_count bigint, total double")
    dealt = df.select(col(metrics[0]).alias("_metric"), F.inline(F.array(*cells)))
    groups = dealt.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("row_count"), F.sum("_metric").alias("total"))
    return groups if best is None else top_per_group(groups, ["dimension"], [F.desc_nulls_last("total"), F.asc("value")], best)


def overview(df: DataFrame, roles: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The analyses a table's columns allow: totals, one per dimension, trend, best and worst groups.

    Each is a frame of its own, so whoever needs them all takes them from :func:`overview_groups`, which scans once.
    """
    roles = roles or roles_of(df)
    metrics, dims, dates = _overview_columns(df, roles)
    if not metrics:
        return {"totals": row_count(df)}
    out = {"totals": overview_totals(df, metrics)}
    for d in dims:
        out[f"by_{d}"] = group_total(df, d, metrics[0])
    if dates:
        out["trend"] = trend(df, dates[0], "month", {f"total_{metrics[0]}": F.sum(col(metrics[0]))})
    if dims:
        name = f"total_{metrics[0]}"
        groups = df.groupBy(col(dims[0])).agg(F.sum(col(metrics[0])).alias(name))
        out["top"] = top_n(groups, [F.desc_nulls_last(name), F.asc(dims[0])], 5)
        out["bottom"] = top_n(groups, [F.asc_nulls_last(name), F.asc(dims[0])], 5)
    return out


def overview_totals(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Total and average of each metric, one row per metric, from one aggregation."""
    aggs, structs = [], []
    for i, m in enumerate(metrics):
        aggs += [F.sum(col(m).cast("double")).alias(f"t{i}"), F.avg(col(m).cast("double")).alias(f"a{i}")]
        structs.append(F.struct(F.lit(m).alias("metric"), F.col(f"t{i}").alias("total"), F.col(f"a{i}").alias("average")))
    return columns_to_rows(df.agg(*aggs), structs)


def summary_numeric(df: DataFrame) -> DataFrame:
    """Mean, minimum and maximum of the numeric columns of a result that hold values."""
    aggs, structs = [], []
    for i, c in enumerate(numeric_columns(df)):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        structs.append(F.struct(F.lit(c).alias("column_name"), F.col(f"mean{i}").alias("mean_value"),
                                F.col(f"min{i}").alias("min_value"), F.col(f"max{i}").alias("max_value")))
    return columns_to_rows(df.agg(*aggs), structs).filter("mean_value IS NOT NULL")


def summary_top(df: DataFrame, n: int = 3) -> DataFrame:
    """Most frequent values of each non-numeric column; the value settles ties.

    Counting is distributed and each task forwards at most ``n`` rows per column to the ranking.
    """
    columns = [c for c, t in fields(df).items() if not is_numeric(t)]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value")) for c in columns])
    counted = (df.select(F.inline(pairs)).filter("value IS NOT NULL")
               .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("frequency")))
    return top_per_group(counted, ["column_name"], [F.desc("frequency"), F.asc("value")], n)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group. Spark keeps ``n`` rows per group in each task before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))


def top_and_bottom(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The ``n`` largest and the ``n`` smallest rows in one result of equal width."""
    top = top_n(df.select(key, value), [F.desc(value), F.asc(key)], n).withColumn("side", F.lit("top"))
    low = top_n(df.select(key, value), [F.asc(value), F.asc(key)], n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def ranked_groups(groups: DataFrame, order: list[Column]) -> DataFrame:
    """Number the rows of a grouped result."""
    return global_rank(groups, order)
