"""Known answers for the quirks of profiling and cleaning."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbgauge.functions import parsing as P
from plumbgauge.functions.text import initcap_ws, standard_gender, strip, title_case
from plumbgauge.operators import clean as C
from plumbgauge.operators import profile as Q
from plumbgauge.operators import quality
from plumbgauge.operators import recommend as R
from plumbgauge.operators import schema as S
from plumbgauge.plans.stats import local_rows
from plumbgauge.streaming.rowlocal import standardise_stream


def values(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def text(spark, items):
    return local_rows(spark, "a string", [(i,) for i in items])


def test_strip_removes_tabs(spark):
    assert values(text(spark, ["\ta ", "\n b\t"]), strip(F.col("a"))) == ["a", "b"]


def test_title_case_protects_acronyms_and_collapses_blanks(spark):
    df = text(spark, ["  craft  ipa ", "pale\tALE abv", "", None])
    assert values(df, title_case(F.col("a"))) == ["Craft IPA", "Pale Ale ABV", "", None]
    assert values(df, initcap_ws(F.col("a"))) == ["Craft Ipa", "Pale Ale Abv", "", None]


def test_gender(spark):
    df = text(spark, ["F", " male ", "FEMALE", "other", None])
    assert values(df, standard_gender(F.col("a"))) == ["Female", "Male", "Female", "Other", None]


def test_formatted_number_pattern(spark):
    df = text(spark, ["1,234.50%", "12345", "123", "$5", "abc"])
    assert values(df, P.is_formatted_number(F.col("a"))) == [True, False, True, True, False]
    assert values(text(spark, ["4%", "$1,000.50", "n/a"]), P.parse_number(F.col("a"))) == [4.0, 1000.5, None]


def test_dates_by_ordered_formats(spark):
    df = text(spark, ["2024-01-05", " 2024-01-05 10:11:12", "2024-01-05T10:11:12", "01/05/2024", "05-01-2024", "2024/01/05",
                      "2024-13-05", "soon", "12345", None])
    found = [str(v) for v in values(df, P.parse_date(F.col("a")))]
    assert found == ["2024-01-05"] * 6 + ["None"] * 4
    assert [str(v) for v in values(text(spark, ["5 Jan 2024", "2024-01-05"]), P.parse_date(F.col("a"), ["d MMM yyyy"]))] == ["2024-01-05", "None"]


def test_boolean_needs_95_percent(spark):
    good, bad = ["yes"] * 19 + ["maybe"], ["yes"] * 18 + ["maybe", "perhaps"]
    done = C.fit_standardiser(text(spark, good))
    assert done.booleans == ["a"]
    assert values(done.convert(text(spark, good)), "a") == [True] * 19 + [None]
    assert C.fit_standardiser(text(spark, bad)).booleans == []


def test_zero_one_integers_become_boolean_but_floats_do_not(spark):
    df = local_rows(spark, "i int, d double", [(0, 1.0), (1, 0.0)])
    assert C.fit_standardiser(df).booleans == ["i"]


def test_numeric_coercion_is_all_or_none(spark):
    df = local_rows(spark, "amount string, total string, unit_price string", [("1", "1", "1.5"), ("2", "2", None), ("x", "3", "2")])
    assert [t for _, t in C.coerce_numeric(df).dtypes] == ["string", "bigint", "double"]


def test_recovery_chain(spark):
    df = local_rows(spark, "id bigint, revenue double, units_sold double, unit_price double, cogs double, profit double, margin double",
                    [(1, None, 4.0, 2.5, None, 3.0, None), (2, 10.0, None, 0.0, None, None, None)])
    one, two = C.recover_metrics(df).orderBy("id").collect()
    assert (one["revenue"], one["cogs"], one["margin"], one["is_derived"]) == (10.0, 7.0, 0.3, True)
    assert (two["units_sold"], two["is_derived"]) == (None, False)
    log = {(r["id"], r["column_name"]): r["recovered_value"] for r in C.recovery_log(df, ["id"]).collect()}
    assert log == {(1, "revenue"): 10.0, (1, "cogs"): 7.0, (1, "margin"): 0.3}


def test_recovered_ratio_rounds_half_to_even(spark):
    df = local_rows(spark, "revenue double, profit double, margin double", [(100000.0, 12345.0, None), (1.0, 0.33335, None)])
    assert values(C.recover_metrics(df), "margin") == [0.1234, 0.3334]


@pytest.mark.parametrize("a,b,near", [("africa", "africca", True), ("asia", "asian", True), ("abc", "abd", False)])
def test_near_pair_rule(spark, a, b, near):
    spelled = Q.spellings(local_rows(spark, "place string", [(a,), (b,)]))
    assert (Q.near_duplicate_categories(spelled).count() == 1) is near


@pytest.mark.parametrize("width,values", [(24, 3), (40, 6), (60, 2), (60, 500)])
def test_near_duplicate_rows_of_wide_tables(spark, width, values):
    rng, allowed = random.Random(width + values), int(width * 0.1 + 1e-9)
    rows = []
    for _ in range(40):
        base = [rng.randrange(values) for _ in range(width)]
        rows.append(base)
        for changes in (allowed - 1, allowed, allowed + 1, allowed + 2):
            other = list(base)
            for i in rng.sample(range(width), changes):
                other[i] = values + rng.randrange(1000)
            rows.append(other)
    rows += [[7] * width] * 2 + [[8] * (width - 1) + [n] for n in range(60)]
    expected = sum(any(i != j and sum(x != y for x, y in zip(a, b)) <= allowed for j, b in enumerate(rows)) for i, a in enumerate(rows))
    df = local_rows(spark, ", ".join(f"c{i} bigint" for i in range(width)), [tuple(r) for r in rows])
    got = Q.near_duplicate_rows(df).first()
    assert (got["row_count"], got["near_duplicate_rows"]) == (len(rows), expected)


def test_near_spellings_equal_brute_force_among_many(spark):
    rng, letters = random.Random(4), "abcd"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(700)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    ordered = sorted(words)
    expected = {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:]
                if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2 and d < 0.3 * max(len(a), len(b))}
    found = Q.near_duplicate_categories(Q.spellings(local_rows(spark, "place string", [(w,) for w in ordered]))).collect()
    assert {(r["left_value"], r["right_value"]) for r in found} == expected and len(found) == len(expected) > 50


def test_merge_by_frequency(spark):
    df = local_rows(spark, "place string", [("Africa",)] * 5 + [("Africca",)] + [("Asia",)])
    merges, counts = C.merge_map(df, ["place"])
    assert [tuple(r) for r in merges.collect()] == [("place", "Africca", "Africa")] and counts == {"place": 1}
    assert sorted(values(C.merge_categories(df, ["place"]), "place")) == ["Africa"] * 6 + ["Asia"]


def test_merge_goes_to_the_most_frequent_near_spelling(spark):
    # aaaaaaaa absorbs aaaaaabb; aaaabbbb is near aaaaaabb only, and joins it after it was rewritten itself.
    df = local_rows(spark, "place string", [("aaaaaaaa",)] * 5 + [("aaaaaabb",)] * 3 + [("aaaabbbb",)])
    merges, counts = C.merge_map(df, ["place"])
    assert {r["replaced"]: r["kept"] for r in merges.collect()} == {"aaaaaabb": "aaaaaaaa", "aaaabbbb": "aaaaaabb"} and counts == {"place": 4}


def test_constant_column_has_no_outliers(spark):
    df = local_rows(spark, "v double", [(5.0,)] * 50)
    row = Q.outlier_profile(df).first()
    assert (row["iqr_outliers"], row["z_outliers"], row["outliers"]) == (0, 0, 0)


@pytest.mark.parametrize("after,warned", [(102.0, True), (100.5, False)])
def test_integrity_tolerance(spark, after, warned):
    before_df, after_df = (local_rows(spark, "revenue double", [(x,)]) for x in (100.0, after))
    assert quality.integrity_warning(quality.integrity_check(before_df, after_df)) is warned


def test_integrity_warns_for_negative_totals(spark):
    before_df, after_df = (local_rows(spark, "profit double", [(x,)]) for x in (-100.0, -150.0))
    assert quality.integrity_warning(quality.integrity_check(before_df, after_df))


def test_invalid_counts_add_up_in_detection_but_first_rule_cleans(spark):
    df = local_rows(spark, "price_age double", [(-1.0,), (130.0,), (50.0,)])
    rec = R.rec_invalid(df, {"price_age": "BUSINESS_METRIC"}).first()
    assert rec["affected_rows"] == 3  # one negative, two outside 0 to 120
    assert values(C.null_invalid(df, ["price_age"]), "price_age") == [None, 130.0, 50.0]


def test_auto_approve(spark):
    minor = R.recommendations(local_rows(spark, "region string", [("a",), (None,)]))
    major = R.recommendations(local_rows(spark, "price double", [(-1.0,), (2.0,)]))
    assert R.auto_approve(minor) and not R.auto_approve(major)


def test_score_of_a_published_example(spark):
    """2,000 rows: nulls 80, 75, 363, 94 and 49 outliers give 90.3."""
    found = Q.null_audit(local_rows(spark, "column_name string, null_count bigint, row_count bigint, null_fraction double",
                                    [(c, n, 2000, n / 2000) for c, n in (("a", 80), ("b", 75), ("c", 363), ("d", 94))]))
    outlier = local_rows(spark, "penalty double", [(min(10.0, 49 / 2000 * 20),)])
    assert Q.profile_score(found.select("penalty").unionAll(outlier)).first()["score"] == 90.3


def test_column_names(spark):
    df = local_rows(spark, "a string, b string", [("1", "2")]).toDF(" Sale ID", "sale_id")
    with pytest.raises(ValueError):
        S.normalise_columns(df)
    assert S.normalise_columns(df, "suffix").columns == ["sale_id", "sale_id_2"]


def test_roles(spark):
    df = local_rows(spark, "id bigint, order_date string, sale_price double, customer_age int, city string, quality int, size int, number_sold string",
                    [(i, "2024-01-01", 1.0, 30, "x", i % 3, i, "1") for i in range(20)])
    assert S.roles_of(df) == {"id": "IDENTIFIER", "order_date": "DATE", "sale_price": "BUSINESS_METRIC", "customer_age": "ATTRIBUTE",
                              "city": "DIMENSION", "quality": "DIMENSION", "size": "BUSINESS_METRIC", "number_sold": "IDENTIFIER"}
    assert S.roles_of(df, {"size": "ATTRIBUTE"})["size"] == "ATTRIBUTE"


def test_cleaning_is_idempotent(spark):
    rows = [(i, " north east " if i % 2 else "SOUTH", "$1,%03d.00" % i, "yes" if i % 3 else "no", None) for i in range(40)]
    df = local_rows(spark, "sale_id bigint, region string, amount string, promo string, empty string", rows + rows[:5])
    once = C.clean(df)
    assert once.counters["duplicates_removed"] == 5 and once.counters["empty_columns_removed"] == 1
    twice = C.clean(once.data)
    assert sorted(map(repr, twice.data.collect())) == sorted(map(repr, once.data.collect()))
    assert "5 duplicates removed" in once.summary()


def test_empty_rows_are_dropped_after_conversion(spark):
    df = local_rows(spark, "order_date string, region string", [("garbage", None), ("2024-01-01", "x"), ("2024-01-02", None)])
    done = C.clean(df)
    assert done.data.count() == 2 and done.counters["empty_rows_removed"] == 1


# --- near duplicates ----------------------------------------------------------------------


def _brute_force(rows, allowed):
    hits = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        if sum(x != y for x, y in zip(a, b)) <= allowed:
            hits |= {i, j}
    return len(hits)


@pytest.mark.parametrize("width,cardinality,expected_allowed", [(9, 2, 0), (10, 3, 1), (14, 2, 1), (20, 2, 2), (24, 4, 2), (31, 3, 3)])
def test_near_duplicates_brute_force(spark, width, cardinality, expected_allowed):
    rng = random.Random(width)
    base = [tuple(rng.choice([None, *"abcdef"[:cardinality]]) for _ in range(width)) for _ in range(60)]
    rows = list(base)
    for _ in range(40):  # copies with a few cells changed; one base row is a third of them
        row = list(rng.choice([base[0], rng.choice(base), rng.choice(base)]))
        for place in rng.sample(range(width), rng.randint(0, expected_allowed + 2)):
            row[place] = "z"
        rows.append(tuple(row))
    names = [f"c{i}" for i in range(width)]
    df = local_rows(spark, ", ".join(f"{n} string" for n in names), rows)
    found = Q.near_duplicate_rows(df).first()
    assert found["row_count"] == 100
    assert found["near_duplicate_rows"] == _brute_force(rows, expected_allowed)


def test_near_duplicates_need_ten_columns_for_one_difference(spark):
    for width, near in ((10, 2), (9, 0)):
        df = local_rows(spark, ", ".join(f"c{i} string" for i in range(width)), [("a",) * width, ("a",) * (width - 1) + ("b",)])
        assert Q.near_duplicate_rows(df).first()["near_duplicate_rows"] == near


def test_nulls_in_different_places_are_not_duplicates(spark):
    df = local_rows(spark, "a string, b string", [(None, "x"), ("x", None), (None, "x")])
    assert Q.exact_duplicates(df).first()["duplicate_rows"] == 1


# --- streaming ----------------------------------------------------------------------------


def test_fitted_cleaning_runs_on_a_stream(spark, tmp_path):
    df = local_rows(spark, "sale_id bigint, region string, amount string, promo string",
                    [(i, " north  east", f"${i},000.00", "yes") for i in range(1, 9)])
    fitted = C.fit_standardiser(df)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (standardise_stream(stream, fitted).writeStream.format("memory").queryName("cleaned_stream")
             .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start())
    query.awaitTermination(120)
    assert sorted(map(repr, spark.table("cleaned_stream").collect())) == sorted(map(repr, fitted.apply(df).collect()))
