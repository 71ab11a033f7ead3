"""Whole-table quality profile: checks, issues, score.

Every row is profiled; nothing is sampled or extrapolated. A check yields issue rows
``(check_name, column_name, affected, penalty)``; the score is 100 minus the penalties.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbgauge.functions import lexicon as L
from plumbgauge.functions.parsing import is_formatted_number, is_plain_number, parse_timestamp
from plumbgauge.functions.text import strip
from plumbgauge.plans.quantiles import exact_quantiles, number, range_aggregates, ranges_from
from plumbgauge.plans.spelling import near_text_pairs
from plumbgauge.plans.stats import (col, column_stats, columns_to_rows, fields, fingerprint, is_datetime,
                                    local_rows, numeric_columns, text_columns)
from plumbgauge.session import materialise, stored

# Offset of the second hash: two independent 64-bit hashes identify a row or signature.
_SECOND = 1_000_003


def named(columns: list[str], words: list[str]) -> list[str]:
    """Columns whose lower-cased name contains one of the words."""
    return [c for c in columns if any(w in c.lower() for w in words)]


# --- duplicates ---------------------------------------------------------------------------


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows, surplus copies, their fraction and penalty; nulls are equal to each other."""
    first, second = fingerprint([col(c) for c in df.columns])
    groups = df.select(first.alias("a"), second.alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_copies"))
    return (groups.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
                       F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"))
            .withColumn("duplicate_fraction", _fraction("duplicate_rows", "row_count"))
            .withColumn("penalty", F.least(F.lit(20.0), F.col("duplicate_fraction") * 50)))


def _fraction(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))


def comparison_columns(df: DataFrame) -> list[str]:
    """Columns that count for near-duplicates: no identifiers, keys, dates or times."""
    skip = set(named(df.columns, L.NEAR_DUPLICATE_SKIP_WORDS))
    return [c for c, t in fields(df).items() if c not in skip and not is_datetime(t)]


def near_duplicate_rows(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Rows that agree with another row in at least ``threshold`` of the comparison columns.

    A row counts when it has any such partner. Rows that differ in at most ``m`` columns agree wholly in one of
    ``m + 1`` blocks of columns. Where one column may differ, no pairs are formed: each row that has company in a block
    is keyed by what remains without each one column outside it, and a key seen twice marks its rows.
    Where more may differ, the number of such choices explodes; then rows of equal blocks are compared,
    neighbours first, so that in a large group of like rows nearly all are settled by one comparison.
    """
    columns = comparison_columns(df)
    allowed = int(len(columns) * (1 - threshold) + 1e-9)
    if len(columns) < 2:
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(
            "row_count", F.lit(0).cast("bigint").alias("near_duplicate_rows"), F.lit(0.0).alias("penalty"))
    first = F.array(*[F.xxhash64(F.lit(i), col(c)) for i, c in enumerate(columns)])
    second = F.array(*[F.xxhash64(F.lit(i + _SECOND), col(c)) for i, c in enumerate(columns)])
    distinct = (df.select(first.alias("a"), second.alias("b"))
                .groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies")))
    if allowed == 0:
        total = distinct.agg(F.sum("copies").alias("row_count"),
                             F.sum(F.when(F.col("copies") > 1, F.col("copies"))).alias("near_duplicate_rows"))
        return _near_penalty(total)
    places = range(len(columns))
    distinct = materialise(distinct.withColumn("ka", _xor([F.get("a", F.lit(i)) for i in places]))
                           .withColumn("kb", _xor([F.get("b", F.lit(i)) for i in places])), "rows")
    company = _rows_with_company if allowed == 1 else _rows_with_company_wide
    marked = company(distinct, len(columns), allowed)
    flagged = (distinct.join(marked.withColumn("_hit", F.lit(1)), ["ka", "kb"], "left")
               .withColumn("_near", (F.col("copies") > 1) | F.col("_hit").isNotNull()))
    total = flagged.agg(F.sum("copies").alias("row_count"),
                        F.sum(F.when(F.col("_near"), F.col("copies"))).alias("near_duplicate_rows"))
    return _near_penalty(total)


def _near_penalty(total: DataFrame) -> DataFrame:
    return (total.select(F.coalesce("row_count", F.lit(0)).alias("row_count"),
                         F.coalesce("near_duplicate_rows", F.lit(0)).alias("near_duplicate_rows"))
            .withColumn("penalty", F.least(F.lit(15.0), _fraction("near_duplicate_rows", "row_count") * 30)))


def _xor(parts: list[Column]) -> Column:
    return reduce(lambda acc, h: acc.bitwiseXOR(h), parts)


def _rows_with_company(rows: DataFrame, width: int, allowed: int) -> DataFrame:
    """Keys (ka, kb) of distinct rows that differ from another distinct row in ``allowed`` columns at most."""
    blocks = [list(range(b, width, allowed + 1)) for b in range(allowed + 1)]
    a, b = F.col("a"), F.col("b")
    block_rows = rows.select("ka", "kb", "a", "b", F.inline(F.array(*[
        F.struct(F.lit(n).alias("block"), _xor([F.get(a, F.lit(i)) for i in block]).alias("sa"),
                 _xor([F.get(b, F.lit(i)) for i in block]).alias("sb")) for n, block in enumerate(blocks)])))
    key = ["block", "sa", "sb"]
    shared = block_rows.groupBy(*key).count().filter("count > 1").select(*key)
    candidates = block_rows.join(shared, key, "left_semi").select("ka", "kb", "a", "b", "block")
    # For each block: every choice of `allowed` columns outside it that may be left out.
    masks = [[list(m) for m in combinations([i for i in range(width) if i not in block], allowed)]
             for block in blocks]
    literal = F.from_json(F.lit(str(masks)), T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType()))))
    signed = candidates.select("ka", "kb", "a", "b", "block",
                               F.posexplode(F.get(literal, F.col("block"))).alias("mask", "out"))
    left_out = [F.get(F.col("out"), F.lit(m)) for m in range(allowed)]
    signed = signed.select("ka", "kb", "block", "mask",
                           _xor([F.col("ka"), *[F.get(a, i) for i in left_out]]).alias("sa"),
                           _xor([F.col("kb"), *[F.get(b, i) for i in left_out]]).alias("sb"))
    key = ["block", "mask", "sa", "sb"]
    shared = signed.groupBy(*key).count().filter("count > 1").select(*key)
    return signed.join(shared, key, "left_semi").select("ka", "kb").distinct()


def _rows_with_company_wide(rows: DataFrame, width: int, allowed: int) -> DataFrame:
    """As :func:`_rows_with_company`, with work that grows with rows and width, not with the choices of columns.

    The columns are dealt to the blocks by number of values, so that every block has some that tell rows apart. There are more
    blocks than needed, and as many must agree as it takes to make groups small: one, two or three.
    """
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.get("a", F.lit(i))).alias(f"d{i}") for i in range(width)]).first()
    values = [max(1, found[f"d{i}"]) for i in range(width)]
    order = sorted(range(width), key=lambda i: -values[i])

    def dealt(blocks: int) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(blocks)]
        for place, i in enumerate(order):
            lap, at = divmod(place, blocks)
            out[at if lap % 2 == 0 else blocks - 1 - at].append(i)
        return out

    for agree in (1, 2, 3):
        blocks = dealt(allowed + agree)
        if prod(sorted(prod(values[i] for i in b) for b in blocks)[:agree]) * 4 >= found["n"]:
            break
    keys = [F.xxhash64(F.lit(n), *[F.get("a", F.lit(i)) for b in chosen for i in blocks[b]])
            for n, chosen in enumerate(combinations(range(len(blocks)), agree))]
    keyed = rows.select("ka", "kb", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    members = materialise(keyed.join(shared, "key", "left_semi").join(rows.select("ka", "kb", "a"), ["ka", "kb"]), "members")

    def near(x: Column, y: Column) -> Column:
        return F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda differs: differs)) <= allowed

    one = Window.partitionBy("key").orderBy("ka", "kb")
    steps = members.withColumn("_p", F.lag(F.struct("ka", "kb", "a")).over(one)).filter(near(F.col("a"), F.col("_p.a")))
    settled = materialise(steps.select(F.inline(F.array(F.struct("ka", "kb"), F.struct(F.col("_p.ka").alias("ka"), F.col("_p.kb").alias("kb"))))).distinct(), "settled")
    rest, others = members.join(settled, ["ka", "kb"], "left_anti").alias("x"), members.alias("y")
    met = rest.join(others, (F.col("x.key") == F.col("y.key")) & ((F.col("x.ka") != F.col("y.ka")) | (F.col("x.kb") != F.col("y.kb")))
                    & near(F.col("x.a"), F.col("y.a")), "left_semi")
    return settled.unionByName(met.select("ka", "kb").distinct())


# --- columns ------------------------------------------------------------------------------


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, null count, null fraction and distinct count per column."""
    return (column_stats(df, approx=approx)
            .withColumn("null_fraction", _fraction("null_count", "row_count")))


def null_audit(profile: DataFrame) -> DataFrame:
    """Penalty for missing values: 10 for an empty column, else up to 15 by fraction."""
    empty = F.col("null_count") == F.col("row_count")
    return profile.filter("null_count > 0").select(
        "column_name", "null_count", "null_fraction",
        F.when(empty, "empty_column").otherwise("missing_values").alias("check_name"),
        F.when(empty, 10.0).otherwise(F.least(F.lit(15.0), F.col("null_fraction") * 30)).alias("penalty"))


def numeric_profile(df: DataFrame) -> DataFrame:
    """Minimum, maximum and mean of each numeric column."""
    return (column_stats(df, numeric_columns(df), distinct=False, numeric=True)
            .select("column_name", "min_value", "max_value", "mean_value"))


def outlier_profile(df: DataFrame, columns: list[str] | None = None, fence: float = 1.5, z: float = 3.0) -> DataFrame:
    """Outliers per numeric column by interquartile fence, by z-score and by either.

    One pass for ranges and moments, the quartile passes, then one conditional count over literals.
    """
    columns = columns if columns is not None else numeric_columns(df)
    if not columns:
        return local_rows(df.sparkSession, _OUTLIER_SCHEMA)
    moments = df.agg(*range_aggregates(columns), *[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(columns)
                                                   for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    quartiles = exact_quantiles(df, columns, [0.25, 0.75], ranges=ranges_from(moments, columns))
    aggs, structs = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        x = number(c)
        beyond = outside(x, *fences(quartiles[c], fence))
        mean, std = moments[f"m{i}"], moments[f"s{i}"]
        far = F.abs((x - F.lit(mean)) / F.lit(std)) > z if std is not None and std > 0 else F.lit(False)
        for label, cond in (("q", beyond), ("z", far), ("b", F.coalesce(beyond, F.lit(False))
                                                        | F.coalesce(far, F.lit(False)))):
            aggs.append(F.count_if(cond).alias(f"{label}{i}"))
        q1, q3 = quartiles[c]
        structs.append(F.struct(
            F.lit(c).alias("column_name"), F.col("n").alias("row_count"),
            F.lit(q1).cast("double").alias("q1"), F.lit(q3).cast("double").alias("q3"),
            F.col(f"q{i}").alias("iqr_outliers"), F.col(f"z{i}").alias("z_outliers"),
            F.col(f"b{i}").alias("outliers")))
    return (columns_to_rows(df.agg(*aggs), structs)
            .withColumn("penalty", F.least(F.lit(10.0), _fraction("outliers", "row_count") * 20)))


_OUTLIER_SCHEMA = ("column_name string, row_count bigint, q1 double, q3 double, iqr_outliers bigint, "
                   "z_outliers bigint, outliers bigint, penalty double")


def fences(quartiles: list[float | None], factor: float) -> tuple[float | None, float | None]:
    """Lower and upper fence, or nothing when the quartiles coincide or are unknown."""
    q1, q3 = quartiles[0], quartiles[-1]
    if q1 is None or q3 is None or not q3 - q1 > 0:
        return None, None
    spread = factor * (q3 - q1)
    return q1 - spread, q3 + spread


def outside(x: Column, low: float | None, high: float | None) -> Column:
    if low is None:
        return F.lit(False)
    return (x < F.lit(low)) | (x > F.lit(high))


def _counts_per_column(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(check_name, column_name, affected, filled) for a list of per-row conditions, in one pass."""
    if not checks:
        return local_rows(df.sparkSession, "check_name string, column_name string, affected bigint, filled bigint")
    aggs, structs = [], []
    for i, (check, c, cond) in enumerate(checks):
        aggs += [F.count_if(cond).alias(f"k{i}"), F.count(col(c)).alias(f"f{i}")]
        structs.append(F.struct(F.lit(check).alias("check_name"), F.lit(c).alias("column_name"),
                                F.col(f"k{i}").alias("affected"), F.col(f"f{i}").alias("filled")))
    return columns_to_rows(df.agg(*aggs), structs)


def _impossible(df: DataFrame) -> list[tuple[str, str, Column]]:
    numbers = numeric_columns(df)
    return ([("negative", c, col(c) < 0) for c in named(numbers, L.PROFILE_NEGATIVE_WORDS)]
            + [("age_range", c, (col(c) < 0) | (col(c) > 120)) for c in named(numbers, ["age"])])


def _formatted(df: DataFrame) -> list[tuple[str, str, Column]]:
    return [("text_numbers", c, is_formatted_number(col(c)) & ~is_plain_number(col(c))) for c in text_columns(df)]


def _bad_dates(df: DataFrame, formats: list[str] | None = None) -> list[tuple[str, str, Column]]:
    return [("invalid_dates", c, (strip(col(c)) != "") & parse_timestamp(col(c), formats).isNull())
            for c in named(text_columns(df), L.PROFILE_DATE_WORDS)]


def impossible_values(df: DataFrame) -> DataFrame:
    """Negative prices, salaries and quantities; ages outside 0 to 120."""
    return _counts_per_column(df, _impossible(df)).select("check_name", "column_name", "affected")


def text_numbers(df: DataFrame) -> DataFrame:
    """Text columns in which more than half of the values are formatted numbers are flagged."""
    return (_counts_per_column(df, _formatted(df))
            .select("column_name", F.col("affected").alias("formatted"), "filled",
                    (F.col("affected") > F.col("filled") * 0.5).alias("flagged")))


def invalid_dates(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Non-blank values in date-named text columns that fit none of the formats."""
    return _counts_per_column(df, _bad_dates(df, formats)).select("column_name", "affected")


# --- categories ---------------------------------------------------------------------------


def spellings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct trimmed non-blank values per text column, with their lower-case form and count."""
    columns = columns if columns is not None else text_columns(df)
    if not columns:
        return local_rows(df.sparkSession, "column_name string, value string, low string, n bigint")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), strip(col(c).cast("string")).alias("value"))
                      for c in columns])
    return (df.select(F.inline(pairs)).filter("value <> ''")
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("low", F.lower("value")).select("column_name", "value", "low", "n"))


def mixed_case_values(spelled: DataFrame) -> DataFrame:
    """Lower-case forms that occur in more than one spelling, per column. Only counts are kept."""
    return (spelled.groupBy("column_name", "low").agg(F.count(F.lit(1)).alias("variants"))
            .filter("variants > 1")
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("mixed_groups"),
                                        F.sum("variants").alias("variants")))


def near_duplicate_categories(spelled: DataFrame) -> DataFrame:
    """Pairs of nearly equal category names, in columns with any number of values."""
    words = "|".join(L.CATEGORY_SKIP_WORDS)
    lows = (spelled.filter(~F.lower("column_name").rlike(words))
            .select("column_name", "low").distinct())
    return near_text_pairs(stored(lows, "lows")).select("column_name", F.col("low_a").alias("left_value"), F.col("low_b").alias("right_value"))


# --- issues and score ---------------------------------------------------------------------


def issues(df: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """All checks over the whole table as rows (check_name, column_name, affected, penalty)."""
    whole = F.lit("").alias("column_name")
    parts = [
        exact_duplicates(df).filter("duplicate_rows > 0")
        .select(F.lit("exact_duplicates").alias("check_name"), whole,
                F.col("duplicate_rows").alias("affected"), "penalty"),
        near_duplicate_rows(df).filter("near_duplicate_rows > 0")
        .select(F.lit("near_duplicates").alias("check_name"), whole,
                F.col("near_duplicate_rows").alias("affected"), "penalty"),
        null_audit(column_stats(df, distinct=False).withColumn("null_fraction", _fraction("null_count", "row_count")))
        .select("check_name", "column_name", F.col("null_count").alias("affected"), "penalty"),
        outlier_profile(df).filter("outliers > 0")
        .select(F.lit("outliers").alias("check_name"), "column_name",
                F.col("outliers").alias("affected"), "penalty"),
    ]
    checks = _counts_per_column(df, _impossible(df) + _formatted(df) + _bad_dates(df, formats))
    hit = (F.when(F.col("check_name") == "text_numbers", F.col("affected") > F.col("filled") * 0.5)
           .otherwise(F.col("affected") > 0))
    parts.append(checks.filter(hit).select("check_name", "column_name", "affected", F.lit(5.0).alias("penalty")))
    spelled = materialise(spellings(df), "spellings")
    parts.append(mixed_case_values(spelled).select(F.lit("mixed_case").alias("check_name"), "column_name",
                                                   F.col("mixed_groups").alias("affected"),
                                                   F.lit(2.0).alias("penalty")))
    parts.append(near_duplicate_categories(spelled).groupBy("column_name").agg(F.count(F.lit(1)).alias("affected"))
                 .select(F.lit("near_categories").alias("check_name"), "column_name", "affected",
                         F.lit(2.0).alias("penalty")))
    return reduce(DataFrame.unionAll, parts)


def profile_score(found: DataFrame) -> DataFrame:
    """100 minus all penalties, kept within 0 to 100, one decimal."""
    score = F.round(F.lit(100.0) - F.coalesce(F.sum("penalty"), F.lit(0.0)), 1)
    return found.agg(F.count(F.lit(1)).alias("issue_count"),
                     F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "Premium").when(score >= 50, "Moderate").otherwise("Poor")


def completeness_bars(profile: DataFrame) -> DataFrame:
    """Fill and cardinality per column as whole percentages."""
    share = _fraction("distinct_count", "row_count")
    return profile.select("column_name",
                          F.round((1 - F.col("null_fraction")) * 100).cast("bigint").alias("fill_pct"),
                          F.least(F.lit(100), F.round(share * 100)).cast("bigint").alias("cardinality_pct"))


def fleet_summary(tables: DataFrame) -> DataFrame:
    """Totals over tables ``(table_name, row_count, score)``; mean score of those that have one, else 100."""
    return tables.agg(F.count(F.lit(1)).alias("datasets"), F.sum("row_count").alias("total_rows"),
                      F.round(F.coalesce(F.avg("score"), F.lit(100.0)), 1).alias("mean_score"))
