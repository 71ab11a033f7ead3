"""Transcripts: question and answer pairs, ordering, export counts, scopes, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbgauge.functions.lexicon import ORPHAN_QUESTION
from plumbgauge.plans.ranking import rank_within
from plumbgauge.plans.segments import neighbours
from plumbgauge.plans.stats import col


def qa_pairs(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", segment_size: int = 4096) -> DataFrame:
    """Questions with their answers in turn order.

    A user turn followed by any other role is a pair; followed by a user turn or by nothing it
    stays unanswered; another role without an open question answers a placeholder question.
    """
    rows = neighbours(df.select(conversation, turn, role, text), conversation, turn, [role, text],
                      segment_size=segment_size)
    user = col(role) == "user"
    asked = F.coalesce(F.col(f"prev_{role}") == "user", F.lit(False))
    unanswered = F.coalesce(F.col(f"next_{role}") == "user", F.lit(True))
    question = F.when(user, col(text)).when(asked, F.col(f"prev_{text}")).otherwise(ORPHAN_QUESTION)
    return (rows.filter(~user | unanswered)
            .select(conversation, turn, question.alias("question"),
                    F.when(user, "").otherwise(col(text)).alias("answer")))


def qa_unpair(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair back into a user and an assistant message."""
    messages = F.array(F.struct(F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("text")),
                       F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return pairs.select(*[col(k) for k in keys], F.inline(messages))


def messages_ordered(df: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages with their position in the conversation, which may be of any length."""
    return rank_within(df, [conversation], [col(turn).asc()], "position")


def export_counts(df: DataFrame, role: str, chart: str, table: str) -> DataFrame:
    """Assistant turns, those with a chart, and those with a non-empty table."""
    answer = col(role) == "assistant"
    return df.agg(F.count_if(answer).alias("responses"),
                  F.count_if(answer & col(chart).isNotNull()).alias("charts"),
                  F.count_if(answer & (F.coalesce(col(table), F.lit(0)) > 0)).alias("tables"))


def scope_filter(df: DataFrame, scope: str, owner: str, time: str) -> DataFrame:
    """``session`` keeps all rows, ``current`` the latest one per owner.

    The latest row is an aggregate, combined before the shuffle, not a sorted window.
    """
    if scope == "session":
        return df
    item = F.struct(*[col(c) for c in df.columns])
    return df.groupBy(col(owner).alias("_owner")).agg(F.max_by(item, col(time)).alias("_row")).select("_row.*")


def remove_owned(tables: dict[str, tuple[DataFrame, str]], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows owned by the deleted ids."""
    gone = deleted.select(col(key).alias("_gone")).distinct()
    return {name: df.join(gone, col(owner) == F.col("_gone"), "left_anti") for name, (df, owner) in tables.items()}

