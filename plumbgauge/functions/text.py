"""Text normalisation as Catalyst expressions (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plumbgauge.functions.lexicon import PROTECTED_UPPERCASE


def strip(c: Column) -> Column:
    """Trim every kind of white space; the built-in ``trim`` removes blanks only."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def contains_any(c: Column, words: list[str]) -> Column:
    """True when the text contains at least one of ``words`` (plain substrings)."""
    return c.rlike("|".join(words))


def _words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def _capitalise(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def initcap_ws(c: Column) -> Column:
    """Capitalise each word and collapse runs of white space to one blank."""
    return F.array_join(F.transform(_words(c), _capitalise), " ")


def title_case(c: Column) -> Column:
    """Like :func:`initcap_ws`, but protected acronyms are written in capitals."""
    def shape(w: Column) -> Column:
        return F.when(F.upper(w).isin(PROTECTED_UPPERCASE), F.upper(w)).otherwise(_capitalise(w))
    return F.array_join(F.transform(_words(c), shape), " ")


def standard_gender(c: Column) -> Column:
    """f/female and m/male in any case become Female and Male, the rest is title-cased."""
    low = F.lower(strip(c))
    return (F.when(c.isNull(), None)
            .when(low.isin("f", "female"), "Female")
            .when(low.isin("m", "male"), "Male")
            .otherwise(title_letters(strip(c))))


def title_letters(c: Column) -> Column:
    """A capital after every character that is no letter, small letters else: ``non-binary`` gives ``Non-Binary``."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), _capitalise), "")


def near_spelling(a: Column, b: Column) -> Column:
    """Two spellings are near when their edit distance is at most 2 and under 30 % of the longer one.

    The threshold form of ``levenshtein`` stops early and returns -1 beyond the threshold, which the remainder makes
    a large number: so it is measured once.
    """
    return F.pmod(F.levenshtein(a, b, 2), F.lit(1000)) < F.lit(0.3) * F.greatest(F.length(a), F.length(b))


def register_text_functions(spark: SparkSession) -> None:
    """Make ``initcap_ws`` callable from SQL text; the body stays visible to Catalyst."""
    if spark.catalog.functionExists("initcap_ws"):
        return
    spark.sql(r"""
        CREATE OR REPLACE TEMPORARY FUNCTION initcap_ws(x STRING) RETURNS STRING RETURN
        array_join(transform(filter(split(x, '\\s+'), w -> w <> ''),
                             w -> concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))), ' ')
    """)
