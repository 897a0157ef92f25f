"""Conversation windows: history, budgets, sanitising, regeneration, contexts and incremental memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_messages(messages: DataFrame, n: int = 5, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The last n messages of each conversation that are not blank, with position 1 for the oldest of them."""
    if not 1 <= n <= 50:
        raise ValueError("n must be from 1 to 50")
    late = W.partitionBy(conv).orderBy(F.desc(turn))
    rows = messages.withColumn("_rn", F.row_number().over(late)).filter(F.col("_rn") <= n)
    rows = rows.filter(F.trim(text) != "")
    return rows.withColumn("position", F.row_number().over(W.partitionBy(conv).orderBy(turn))).drop("_rn")


def within_budget(messages: DataFrame, budget: int, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """System messages, and the newest others whose characters fit the budget; the first that does not fit ends it."""
    w = W.partitionBy(conv, F.col(role) == "system").orderBy(F.desc(turn)).rowsBetween(W.unboundedPreceding, 0)
    rows = messages.withColumn("running_chars", F.sum(F.length(text)).over(w))
    return rows.filter((F.col(role) == "system") | (F.col("running_chars") <= budget))


def without_repeats(messages: DataFrame, question: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Without user messages that equal the question now asked, and without the assistant's answers right after them."""
    w = W.partitionBy(conv).orderBy(turn)
    same = (F.col(role) == "user") & (F.trim(text) == F.trim(question))
    rows = messages.withColumn("_same", same)
    rows = rows.withColumn("_pair", F.col("_same") & (F.coalesce(F.lead(role).over(w), F.lit("")) == "assistant"))
    rows = rows.withColumn("_answer", (F.col(role) == "assistant") & F.coalesce(F.lag("_pair").over(w), F.lit(False)))
    return rows.filter(~F.col("_pair") & ~F.col("_answer")).drop("_same", "_pair", "_answer")


def regenerate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Per conversation the message to deactivate (the last, if the assistant's) and the user message to ask again."""
    w = W.partitionBy(conv).orderBy(F.desc(turn))
    two = messages.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2").groupBy(conv).agg(
        F.max(F.when(F.col("_rn") == 1, F.struct(role, turn))).alias("last"), F.max(F.when(F.col("_rn") == 2, F.struct(role, turn))).alias("before")
    )
    fits = (F.col(f"last.{role}") == "assistant") & (F.col(f"before.{role}") == "user")
    return two.filter(fits).select(conv, F.col(f"last.{turn}").alias("deactivate_turn"), F.col(f"before.{turn}").alias("ask_turn"))


def joined_context(messages: DataFrame, n: int = 4, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One line per message, `User: ...` or `Assistant: ...`, of the last n messages in order."""
    who = F.when(F.col(role) == "user", "User").otherwise("Assistant")
    last = last_messages(messages, n, conv, turn, text)
    lines = last.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.concat(who, F.lit(": "), F.col(text)).alias("l")))).alias("x"))
    return lines.select(conv, F.array_join(F.transform("x", lambda m: m["l"]), "\n").alias("context"))


def unindexed(messages: DataFrame, indexed: DataFrame, keys: list[str]) -> DataFrame:
    return messages.join(indexed.select(keys).distinct(), keys, "left_anti")


def index_messages(messages: DataFrame, indexed: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index after the messages that it lacks: what build makes of those is added, all other rows stay as they are.

    build gives rows with the columns of indexed. Run again on the same messages it adds nothing.
    """
    return indexed.unionByName(build(unindexed(messages, indexed, keys)).select(indexed.columns))


def latest_streams(streams: DataFrame, key: str, stamp: str, now: Column, seconds: int = 300) -> DataFrame:
    """One live stream per key, the newest; those older than `seconds` have expired."""
    newest = streams.groupBy(key).agg(F.max_by(F.struct(*streams.columns), F.col(stamp)).alias("s")).select("s.*")
    return newest.filter(F.unix_timestamp(now) - F.unix_timestamp(F.col(stamp)) <= seconds)
