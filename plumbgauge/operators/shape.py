"""Shaping of results and the data series behind charts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgauge.functions import lexicon as L
from plumbgauge.functions import roles as R
from plumbgauge.functions.parsing import finite_or_null
from plumbgauge.operators.kpi import has_unassigned, is_unassigned
from plumbgauge.operators.profile import fences
from plumbgauge.plans.gram import correlations
from plumbgauge.plans.quantiles import exact_quantiles
from plumbgauge.plans.ranking import global_rank, number_few
from plumbgauge.plans.stats import col, columns_to_rows, few_distinct, fields, local_rows, numeric_columns


#: Numeric columns up to which all their pairs are one aggregation.
WIDE = 12


def search_rows(df: DataFrame, term: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the term in any cell, whatever its case."""
    hit = F.lit(False)
    for c in columns or df.columns:
        hit = hit | F.contains(F.lower(F.coalesce(col(c).cast("string"), F.lit(""))), F.lit(term.lower()))
    return df.filter(hit)


def sort_keys(column: str, ties: list[str], descending: bool = False) -> list[Column]:
    """Unassigned rows last, then nulls last, in both directions."""
    c = col(column)
    return [has_unassigned([column]).cast("int").asc(),
            c.desc_nulls_last() if descending else c.asc_nulls_last(), *[col(t).asc() for t in ties]]


def sort_rows(df: DataFrame, column: str, ties: list[str], descending: bool = False) -> DataFrame:
    """Whole table with each row's position in the sorted order."""
    return global_rank(df, sort_keys(column, ties, descending))


def paginate(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page (counted from 1) with positions; empty beyond the end."""
    skip = (page - 1) * size
    rows = df.orderBy(*order).offset(skip).limit(size)
    return number_few(rows, order).withColumn("rank", F.col("rank") + skip)


def preview(df: DataFrame, order: list[Column], rows: int = 10, columns: int = 6, chars: int = 20) -> DataFrame:
    """Small report table: first rows and columns, cells as text cut to ``chars``, nulls as blank."""
    head = df.orderBy(*order).limit(rows)
    cells = [F.coalesce(F.substring(col(c).cast("string"), 1, chars), F.lit("")).alias(c) for c in df.columns[:columns]]
    return number_few(head, order).select("rank", *cells)


def _x_or_y(df: DataFrame, x: str | None, y: str | None) -> tuple[str, str]:
    x = x or df.columns[0]
    return x, y or (df.columns[1] if len(df.columns) > 1 else x)


def pie_shares(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Sum of y per x, or row counts, with shares; unassigned slices are left out."""
    value = F.sum(col(y)) if y and y in df.columns else F.count(F.lit(1))
    slices = (df.filter(~is_unassigned(col(x))).groupBy(col(x).cast("string").alias("label"))
              .agg(value.cast("double").alias("value")))
    whole = slices.agg(F.sum("value")).scalar()
    return slices.select("label", "value", F.try_divide(F.col("value"), whole).alias("share"))


def series(df: DataFrame, x: str, y: str | None = None, label_chars: int | None = None) -> DataFrame:
    """(x, y) in order of x; y is 1 when absent; bar labels are cut to ``label_chars``."""
    label = F.substring(col(x).cast("string"), 1, label_chars) if label_chars else col(x)
    value = col(y) if y and y in df.columns else F.lit(1)
    return df.orderBy(col(x)).select(label.alias("x"), value.alias("y"))


def histogram(df: DataFrame, x: str, max_bins: int = 15) -> DataFrame:
    """Equal-width bins, the last one closed; at most one bin per distinct value.

    Empty bins are listed too.
    """
    v = col(x).cast("double")
    row = df.agg(F.min(v).alias("low"), F.max(v).alias("high")).first()
    spark = df.sparkSession
    if row["low"] is None:
        return local_rows(spark, "bin int, bin_start double, bin_end double, frequency bigint")
    bins = few_distinct(df, [x], max_bins)[x]
    low, high = row["low"], row["high"]
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    start = F.lit(low) + F.col("bin") * F.lit(width)
    return (grid.join(counts, "bin", "left")
            .select("bin", start.alias("bin_start"), (start + F.lit(width)).alias("bin_end"),
                    F.coalesce("n", F.lit(0)).alias("frequency")))


def box_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles, whiskers (last points within 1.5 interquartile ranges) and outliers of the given or all numeric columns."""
    columns = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs, structs = [], []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        q1, median, q3 = quartiles[c]
        if q1 is None:
            continue
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        aggs += [F.min(F.when(v >= low, v)).alias(f"a{i}"), F.max(F.when(v <= high, v)).alias(f"b{i}"),
                 F.count_if((v < low) | (v > high)).alias(f"o{i}")]
        structs.append(F.struct(F.lit(c).alias("column_name"), F.lit(q1).alias("q1"), F.lit(median).alias("median"),
                                F.lit(q3).alias("q3"), F.col(f"a{i}").alias("whisker_low"),
                                F.col(f"b{i}").alias("whisker_high"), F.col(f"o{i}").alias("outliers")))
    return columns_to_rows(df.agg(*aggs), structs)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, over the rows in which both have a value; 1 on the diagonal.

    Few columns are one aggregation in generated code; more than ``WIDE`` are multiplied in blocks (:mod:`plumbgauge.plans.gram`).
    """
    columns = columns or numeric_columns(df)
    if len(columns) > WIDE:
        return correlations(df, columns)
    pairs = list(combinations(range(len(columns)), 2))
    aggs = [F.corr(col(columns[i]).cast("double"), col(columns[j]).cast("double")).alias(f"r{i}_{j}") for i, j in pairs]
    cells = [(i, i, F.lit(1.0)) for i in range(len(columns))]
    for i, j in pairs:
        cells += [(i, j, F.col(f"r{i}_{j}")), (j, i, F.col(f"r{i}_{j}"))]
    structs = [F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), r.alias("r")) for i, j, r in cells]
    return columns_to_rows(df.agg(*aggs), structs)


def chart_recommendation(summary: DataFrame) -> DataFrame:
    """Chart type and axes per table from its schema-summary rows.

    Numeric is tested first (booleans included), then dates by type or name, the rest is category.
    """
    name, dtype = F.col("column_name"), F.col("dtype")
    numeric = R.is_numeric_type(dtype) | (dtype == "boolean")
    dated = ~numeric & (R.is_datetime_type(dtype) | F.lower(name).rlike("date|time"))
    first = F.struct("position", "column_name")

    def ordered(cond: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(cond, first))), lambda s: s["column_name"])

    lists = summary.groupBy("table_name").agg(
        ordered(numeric).alias("numbers"), ordered(dated).alias("dates"),
        ordered(~numeric & ~dated).alias("categories"), ordered(F.lit(True)).alias("every"))
    n, d, c, e = (F.col(k) for k in ("numbers", "dates", "categories", "every"))
    none = F.lit(None).cast("string")
    rules = [(F.size(e) < 2, "table", none, none),
             ((F.size(d) > 0) & (F.size(n) > 0), "date and number", F.get(d, F.lit(0)), F.get(n, F.lit(0))),
             ((F.size(c) > 0) & (F.size(n) > 0), "category and number", F.get(c, F.lit(0)), F.get(n, F.lit(0))),
             (F.size(n) >= 2, "two numbers", F.get(n, F.lit(0)), F.get(n, F.lit(1))),
             (F.lit(True), "other", F.get(e, F.lit(0)), F.get(e, F.lit(1)))]

    def pick(choices: list[Column]) -> Column:
        out = choices[-1]
        for (cond, *_), choice in list(zip(rules, choices))[-2::-1]:
            out = F.when(cond, choice).otherwise(out)
        return out

    offers = [L.CHART_ALTERNATIVES[kind] for _, kind, _, _ in rules]
    return lists.select("table_name", pick([F.lit(o[0]) for o in offers]).alias("chart"),
                        pick([r[2] for r in rules]).alias("x"), pick([r[3] for r in rules]).alias("y"),
                        pick([F.lit(",".join(o)) for o in offers]).alias("alternatives"))


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite values as null, since JSON has no word for them."""
    types = fields(df)
    return df.select(*[finite_or_null(col(c), types[c]).alias(c) for c in df.columns])


def chart_series(df: DataFrame, kind: str, x: str | None = None, y: str | None = None) -> DataFrame:
    """The data of a caller-chosen chart; axes default to the first and second column."""
    kind = (kind or "bar").lower().replace(" plot", "").strip()
    x, y = _x_or_y(df, x, y)
    if kind == "pie":
        return pie_shares(df, x, y)
    if kind == "histogram":
        return histogram(df, x)
    if kind == "box":
        return box_stats(df)
    if kind == "heatmap":
        return correlation_matrix(df)
    if kind in ("line", "area", "scatter"):
        return series(df, x, y)
    return series(df, x, y, label_chars=15)


def missing_axes(df: DataFrame, x: str | None, y: str | None) -> list[str]:
    """Axes of a chart that the result does not have."""
    return [a for a in (x, y) if a and a not in df.columns]

