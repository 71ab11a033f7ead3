"""Ordered, auditable cleaning.

The order is part of the meaning: drop duplicate rows, standardise booleans, genders, white space,
dates, formatted numbers and casing, drop empty rows and columns; then, for approved actions only,
null out invalid values, flag outliers, impute, merge spellings and recover derived metrics; last,
turn all-numeric text columns named like metrics into numbers.

Decisions that need statistics are taken from a few aggregations over all columns; everything else
is one projection. Where a value cannot keep its text next to numbers in the same column, it
becomes null. Dates become DATE values. Numeric columns named like dates are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbgauge.functions import lexicon as L
from plumbgauge.functions import parsing as P
from plumbgauge.functions.text import standard_gender, strip, title_case
from plumbgauge.operators.profile import fences, outside
from plumbgauge.operators.recommend import (category_variants, invalid_rules, near_pairs, recommendations)
from plumbgauge.operators.schema import dataset_type_of, normalise_columns, roles_of
from plumbgauge.plans.quantiles import exact_quantiles, range_aggregates, ranges_from
from plumbgauge.plans.stats import INTEGER, col, fields, is_datetime, is_numeric, is_text, local_rows
from plumbgauge.session import materialise

_COPIES = "_copies"
_NUMERIC_LIKE = r"^-*(\d+\.?\d*|\.\d+)$"
_WHOLE_NUMBER = r"^[+-]?\d+$"


# --- single operators ---------------------------------------------------------------------


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def empty_columns(df: DataFrame) -> list[str]:
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"n{i}"] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns without any value."""
    gone = set(empty_columns(df))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def null_invalid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null out impossible numbers; only the first rule that fits the column's name applies."""
    types = fields(df)
    out = {}
    for c in columns:
        rules = invalid_rules(c) if is_numeric(types[c]) else []
        if rules:
            out[c] = F.when(rules[0], None).otherwise(col(c))
    return df.withColumns(out) if out else df


def outlier_fences(df: DataFrame, columns: list[str], factor: float = 3.0) -> dict[str, tuple[float | None, float | None]]:
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    return {c: fences(quartiles[c], factor) for c in columns}


def flag_outliers(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Set ``is_outlier`` where any column lies beyond its fence. Values stay as they are."""
    flag = col("is_outlier") if "is_outlier" in df.columns else F.lit(False)
    for c, (low, high) in bounds.items():
        flag = flag | F.coalesce(outside(col(c).cast("double"), low, high), F.lit(False))
    return df.withColumn("is_outlier", flag)


def outlier_summary(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]],
                    keys: list[str]) -> DataFrame:
    """One row per outlying cell: the row's key columns, column and value."""
    cells = [F.struct(F.lit(c).alias("column_name"), col(c).cast("double").alias("value"),
                      outside(col(c).cast("double"), low, high).alias("_beyond"))
             for c, (low, high) in bounds.items()]
    return (df.select(*[col(k) for k in keys], F.inline(F.array(*cells)))
            .filter("_beyond").drop("_beyond"))


def impute_unknown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill with ``Unknown``; a column of another type becomes text first."""
    return df.withColumns({c: F.coalesce(col(c).cast("string"), F.lit("Unknown")) for c in columns})


def impute_value(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill each column with its value; an integer column turns double if the value is fractional."""
    types, out = fields(df), {}
    for c, v in values.items():
        whole = isinstance(types[c], INTEGER) and isinstance(v, float) and not v.is_integer()
        c_typed = col(c).cast("double") if whole else col(c)
        out[c] = F.coalesce(c_typed, F.lit(v).cast("double" if whole else types[c]))
    return df.withColumns(out)


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median per column, 0 for a column without values."""
    return {c: q[0] if q[0] is not None else 0.0 for c, q in exact_quantiles(df, columns, [0.5]).items()}


def most_frequent(df: DataFrame, column: str) -> object:
    """Most frequent value, the smallest among equals; ``Unknown`` for an empty column."""
    top = (df.filter(col(column).isNotNull()).groupBy(col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.asc("v")).limit(1).collect())
    return top[0]["v"] if top else "Unknown"


def merge_map(df: DataFrame, columns: list[str]) -> tuple[DataFrame | None, dict[str, int]]:
    """Rewrites (column_name, replaced, kept), and per column with any the number of values they stand for.

    A spelling goes to the most frequent of its near spellings, the smallest among equals.
    """
    if not columns:
        return None, {}
    pairs = materialise(near_pairs(category_variants(df, columns)), "merges")
    counts = {r["column_name"]: r["n"] for r in pairs.groupBy("column_name").agg(F.sum("n_b").alias("n")).collect()}
    best = pairs.groupBy("column_name", "replaced").agg(F.min_by("kept", F.struct(-F.col("n_a"), F.col("kept"))).alias("kept"))
    return best, {c: counts[c] for c in columns if c in counts}


def rewrite(df: DataFrame, merges: DataFrame | None, columns: list[str]) -> DataFrame:
    """Apply the rewrites to ``columns`` by a join on the spelling each."""
    types = fields(df)
    for c in columns:
        mine = merges.filter(F.col("column_name") == c).select(F.col("replaced").alias("_from"), F.col("kept").alias("_to"))
        text = col(c).cast("string")
        df = df.join(mine, text == F.col("_from"), "left").withColumn(c, F.coalesce(F.col("_to"), text).cast(types[c])).drop("_from", "_to")
    return df


def merge_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rewrite rare spellings to the frequent one."""
    merges, counts = merge_map(df, columns)
    return rewrite(df, merges, list(counts))


_RECOVERED = ["revenue", "units_sold", "unit_price", "profit", "cogs", "margin"]
_FORMULAS = {"revenue": "units_sold * unit_price", "units_sold": "revenue / unit_price",
             "unit_price": "revenue / units_sold", "profit": "revenue - cogs",
             "cogs": "revenue - profit", "margin": "profit / revenue"}


def recover_metrics(df: DataFrame, keep_before: bool = False) -> DataFrame:
    """Fill missing business metrics from the others; each step sees the results of the earlier ones.

    Only columns that exist are filled; they come out as doubles. ``is_derived`` marks the rows
    touched. ``keep_before`` leaves ``_was_<column>`` flags for :func:`recovery_log`.
    """
    types = fields(df)
    present = [c for c in _RECOVERED if c in types]
    number = {c: f"_n_{c}" for c in _RECOVERED}
    work = df.withColumns({number[c]: P.as_number(col(c), types[c]) if c in types else F.lit(None).cast("double")
                           for c in _RECOVERED}
                          | {f"_null_{c}": col(c).isNull() for c in present})
    n = {c: F.col(number[c]) for c in _RECOVERED}
    zero_safe = {c: F.nullif(n[c], F.lit(0.0)) for c in _RECOVERED}
    steps = {"revenue": n["units_sold"] * n["unit_price"],
             "units_sold": n["revenue"] / zero_safe["unit_price"],
             "unit_price": F.bround(n["revenue"] / zero_safe["units_sold"], 4),
             "profit": n["revenue"] - n["cogs"],
             "cogs": n["revenue"] - n["profit"],
             "margin": F.bround(n["profit"] / zero_safe["revenue"], 4)}
    for c in present:
        work = work.withColumn(number[c], F.when(F.col(f"_null_{c}"), steps[c]).otherwise(n[c]))
    was = {c: F.col(f"_null_{c}") & n[c].isNotNull() for c in present}
    derived = col("is_derived") if "is_derived" in types else F.lit(False)
    for c in present:
        derived = derived | was[c]
    out = [n[c].alias(c) if c in present else col(c) for c in df.columns if c != "is_derived"]
    out.append(derived.alias("is_derived"))
    if keep_before:
        out += [was[c].alias(f"_was_{c}") for c in present]
    return work.select(*out)


def recovery_log(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per recovered cell: key columns, column, value, formula."""
    traced = recover_metrics(df, keep_before=True)
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("recovered_value"),
                      F.lit(f"{c} = {_FORMULAS[c]}").alias("reason"), F.col(f"_was_{c}").alias("_was"))
             for c in _RECOVERED if c in df.columns]
    return traced.select(*[col(k) for k in keys], F.inline(F.array(*cells))).filter("_was").drop("_was")


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Turn metric-named text columns into numbers if every value of theirs parses, else leave them."""
    columns = [c for c, t in fields(df).items() if is_text(t) and _metric_named(c)]
    if not columns:
        return df
    row = df.agg(*_coercion_counts(columns)).first().asDict()
    return df.withColumns({c: col(c).try_cast(t) for i, c in enumerate(columns)
                           if (t := _coercion_type(row, i)) is not None})


def _metric_named(name: str) -> bool:
    return name not in L.FLAG_COLUMNS and any(w in name.lower() for w in L.NUMERIC_NAME_WORDS)


def _coercion_counts(columns: list[str]) -> list[Column]:
    out = []
    for i, c in enumerate(columns):
        out += [F.count(col(c)).alias(f"all{i}"), F.count(P.number_or_null(strip(col(c)))).alias(f"num{i}"),
                F.count(F.when(strip(col(c)).rlike(_WHOLE_NUMBER), strip(col(c)).try_cast("bigint"))).alias(f"int{i}")]
    return out


def _coercion_type(row: dict, i: int) -> str | None:
    if row[f"all{i}"] == 0 or row[f"num{i}"] < row[f"all{i}"]:
        return None
    return "bigint" if row[f"int{i}"] == row[f"all{i}"] else "double"


# --- the always-on part as a fitted, row-local projection ----------------------------------


@dataclass
class Standardiser:
    """Decisions of the always-on steps. ``apply`` is row-local, so it also runs on a stream."""

    booleans: list[str] = field(default_factory=list)
    genders: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    empty: list[str] = field(default_factory=list)
    formats: list[str] | None = None
    filled: dict[str, int] = field(default_factory=dict)
    lost: dict[str, int] = field(default_factory=dict)
    kept_text: list[str] = field(default_factory=list)

    def column(self, name: str, t: T.DataType) -> Column:
        c = col(name)
        if name in self.booleans:
            return P.parse_boolean(c)
        if name in self.genders:
            c = standard_gender(c.cast("string"))
        if name in self.dates:
            return c.cast("date") if is_datetime(t) else P.parse_date(c, self.formats)
        if not is_text(t):
            return c
        if name in self.numbers:
            return P.parse_number(c)
        return title_case(c) if name in self.titles else strip(c)

    def convert(self, df: DataFrame) -> DataFrame:
        types = fields(df)
        return df.select(*[self.column(c, types[c]).alias(c) if c in types and c != _COPIES else col(c)
                           for c in df.columns])

    def apply(self, df: DataFrame) -> DataFrame:
        """Converted columns without the empty ones and without rows that hold nothing."""
        done = self.convert(df).drop(*self.empty)
        values = [col(c).isNotNull() for c in done.columns if c != _COPIES]
        keep = values[0]
        for v in values[1:]:
            keep = keep | v
        return done.filter(keep).withColumn("is_outlier", F.lit(False))


def fit_standardiser(df: DataFrame, roles: dict[str, str] | None = None,
                     formats: list[str] | None = None) -> Standardiser:
    """Take every always-on decision from one aggregation over the (deduplicated) rows."""
    return _fit(df, roles or roles_of(df), formats)[0]


def _fit(df: DataFrame, roles: dict[str, str], formats: list[str] | None) -> tuple[Standardiser, dict]:
    types = {c: t for c, t in fields(df).items() if c != _COPIES}
    names = list(types)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        x = col(c)
        aggs.append(F.count(x).alias(f"filled{i}"))
        if _COPIES in df.columns:
            aggs.append(F.sum(F.when(x.isNull(), F.col(_COPIES))).alias(f"missing{i}"))
        if is_text(types[c]) or isinstance(types[c], (*INTEGER, T.BooleanType)):
            aggs.append(F.count_if(P.is_boolean_word(x)).alias(f"bool{i}"))
        if is_text(types[c]):
            aggs += [F.count_if(P.is_formatted_number(x)).alias(f"money{i}"),
                     F.count(P.parse_number(x)).alias(f"number{i}"),
                     F.count_if(strip(x).rlike(_NUMERIC_LIKE)).alias(f"like{i}")]
            if roles.get(c) == "DATE":
                aggs.append(F.count(P.parse_date(x, formats)).alias(f"date{i}"))
    if _COPIES in df.columns:
        aggs.append(F.sum(_COPIES).alias("copies"))
    row = df.agg(*aggs).first().asDict()
    plan = Standardiser(formats=formats)
    for i, c in enumerate(names):
        n, text = row[f"filled{i}"], is_text(types[c])
        plan.filled[c] = n
        if n and f"bool{i}" in row and row[f"bool{i}"] >= 0.95 * n:
            plan.booleans.append(c)
            continue
        if roles.get(c) in ("ATTRIBUTE", "DIMENSION") and text and any(w in c.lower() for w in ("gender", "sex")):
            plan.genders.append(c)
        if roles.get(c) == "DATE" and (is_datetime(types[c]) or (text and n and row[f"date{i}"])):
            plan.dates.append(c)
            plan.lost[c] = n - row.get(f"date{i}", n)
        elif text and n and roles.get(c) == "DATE":
            plan.kept_text.append(c)  # a date by its name only
        elif text and n and row[f"money{i}"] > 0.5 * n:
            plan.numbers.append(c)
            plan.lost[c] = n - row[f"number{i}"]
        elif text and n and roles.get(c) not in ("IDENTIFIER", "DATE") and row[f"like{i}"] < n:
            plan.titles.append(c)
        if n == 0:
            plan.empty.append(c)
    return plan, row


# --- the whole flow -----------------------------------------------------------------------


@dataclass
class Cleaned:
    """Cleaned data and the record of what was done to it."""

    data: DataFrame
    before: DataFrame
    roles: dict[str, str]
    dataset_type: str
    counters: dict[str, int]
    log: list[tuple[str, str, int]]
    missing: dict[str, int]
    outliers: DataFrame | None = None
    recovered: DataFrame | None = None

    def action_log(self) -> DataFrame:
        """(step, action_type, column_name, affected_rows)"""
        rows = [(i + 1, *entry) for i, entry in enumerate(self.log)]
        return local_rows(self.data.sparkSession,
                          "step bigint, action_type string, column_name string, affected_rows bigint", rows)

    def missing_summary(self) -> DataFrame:
        return local_rows(self.data.sparkSession, "column_name string, missing_before bigint", list(self.missing.items()))

    def summary(self) -> str:
        parts = [f"{v} {k.replace('_', ' ')}" for k, v in self.counters.items() if v > 0]
        return "Applied actions: " + ", ".join(parts) + "." if parts else "No cleaning changes applied."


def clean(df: DataFrame, actions: list[str] | None = None, *, keys: list[str] | None = None,
          formats: list[str] | None = None, overrides: dict[str, str] | None = None,
          aggressive: bool = False) -> Cleaned:
    """Run the cleaning steps in order. ``actions`` are approved recommendation ids.

    ``keys`` name the row in the outlier and recovery logs. The deduplicated rows are written to
    the staging folder once, because every later statistic reads them.
    """
    actions = list(actions or [])
    aggressive = aggressive or bool(actions)
    df = normalise_columns(df)
    roles, kind = roles_of(df, overrides), dataset_type_of(df)
    staged = materialise(df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(_COPIES)), "deduplicated")
    plan, seen = _fit(staged, roles, formats)
    unique = staged.select(*[col(c) for c in df.columns])
    counters = dict.fromkeys(["duplicates_removed", "empty_rows_removed", "empty_columns_removed",
                              "missing_values_filled", "outliers_flagged", "datatype_conversions",
                              "invalid_values_removed", "categories_merged"], 0)
    log: list[tuple[str, str, int]] = []
    counters["duplicates_removed"] = (seen["copies"] or 0) - seen["rows"]
    if counters["duplicates_removed"]:
        log.append((L.ACTION_NAMES["duplicates"], "", counters["duplicates_removed"]))
    for action, names in ((L.ACTION_NAMES["boolean"], plan.booleans), (L.ACTION_NAMES["gender"], plan.genders),
                          (L.ACTION_NAMES["casing"], plan.titles)):
        log += [(action, c, plan.filled[c]) for c in df.columns if c in names]
    log += [("values_lost_in_conversion", c, plan.lost[c]) for c in df.columns if plan.lost.get(c)]
    log += [("kept_as_text", c, plan.filled[c]) for c in df.columns if c in plan.kept_text]
    counters["datatype_conversions"] = len(plan.numbers)
    counters["empty_columns_removed"] = len(plan.empty)
    data = plan.apply(unique)
    missing = {c: seen[f"missing{i}"] or 0 for i, c in enumerate(df.columns)}
    result = Cleaned(data, df, roles, kind, counters, log, missing)
    if aggressive:
        _approved(result, seen["rows"], actions, keys or [])
    else:
        counters["empty_rows_removed"] = seen["rows"] - data.count()
    result.data = coerce_numeric(result.data)
    return result


def _approved(result: Cleaned, total: int, actions: list[str], keys: list[str]) -> None:
    data, roles, counters, log = result.data, result.roles, result.counters, result.log
    asked = {a: [c for c in data.columns if f"{a}:{c}" in actions]
             for a in ("clean_invalid_values", L.ACTION_NAMES["outliers"], "merge_categories")}
    types = fields(data)
    rules = {c: invalid_rules(c)[0] for c in asked["clean_invalid_values"]
             if is_numeric(types[c]) and invalid_rules(c)}
    after_nulls = null_invalid(data, list(rules))
    flagged = [c for c in asked["flag_outliers"] if is_numeric(types[c])]
    unknowns = [c for c in data.columns if roles.get(c) == "DIMENSION" and f"impute_missing:{c}:Unknown" in actions]
    fills = [c for c in data.columns if roles.get(c) == "ATTRIBUTE" and f"impute_missing:{c}:median" in actions]
    numeric_fills = [c for c in fills if is_numeric(types[c])]
    measured = list(dict.fromkeys(flagged + numeric_fills))
    # One pass for the counts before outliers, and the ranges the quantiles start from.
    marked = after_nulls if not rules else null_invalid(data.withColumns({f"_bad_{c}": rule for c, rule in rules.items()}), list(rules))
    row = marked.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(col(f"_bad_{c}")).alias(f"invalid:{c}") for c in rules],
                     *[F.count_if(col(c).isNull()).alias(f"nulls:{c}") for c in dict.fromkeys(unknowns + fills)], *range_aggregates(measured)).first().asDict()
    quantiles = exact_quantiles(after_nulls, measured, [0.25, 0.5, 0.75], ranges=ranges_from(row, measured))
    bounds = {c: fences(quantiles[c], 3.0) for c in flagged}
    values: dict[str, object] = {c: quantiles[c][1] if quantiles[c][1] is not None else 0.0 for c in numeric_fills}
    values |= {c: most_frequent(after_nulls, c) for c in fills if c not in numeric_fills}
    counters["empty_rows_removed"] = total - row["rows"]
    later = [F.count_if(outside(col(c).cast("double"), *bounds[c])).alias(f"outliers:{c}") for c in flagged]
    if later:
        row |= after_nulls.agg(*later).first().asDict()
    for prefix, action, counter, names in (
            ("invalid", L.ACTION_NAMES["invalid"], "invalid_values_removed", list(rules)),
            ("outliers", L.ACTION_NAMES["outliers"], "outliers_flagged", flagged),
            ("nulls", L.ACTION_NAMES["unknown"], "missing_values_filled", unknowns),
            ("nulls", L.ACTION_NAMES["fill"], "missing_values_filled", fills)):
        for c in names:
            if row[f"{prefix}:{c}"]:
                counters[counter] += row[f"{prefix}:{c}"]
                log.append((action, c, row[f"{prefix}:{c}"]))
    if bounds and keys:
        result.outliers = outlier_summary(after_nulls, bounds, keys)
    data = flag_outliers(after_nulls, bounds)
    data = impute_unknown(data, unknowns) if unknowns else data
    data = impute_value(data, values) if values else data
    merges, merged = merge_map(data, [c for c in asked["merge_categories"] if roles.get(c) == "DIMENSION"])
    for c, n in merged.items():
        counters["categories_merged"] += n
        log.append((L.ACTION_NAMES["merge"], c, n))
    data = rewrite(data, merges, list(merged))
    if keys:
        result.recovered = recovery_log(data, keys) if set(_RECOVERED) & set(data.columns) else None
    result.data = recover_metrics(data)


def auto_clean(df: DataFrame, *, keys: list[str] | None = None, formats: list[str] | None = None,
               overrides: dict[str, str] | None = None) -> Cleaned:
    """Apply every current recommendation to the raw data."""
    named = normalise_columns(df)
    roles = roles_of(named, overrides)
    ids = [r["rec_id"] for r in recommendations(named, roles, formats).select("rec_id").collect()]
    return clean(named, ids, keys=keys, formats=formats, overrides=overrides, aggressive=True)
