"""Queries over the messages of a chat: the table `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import words
from quarry.operators.grouping import first_of_each, folded_text
from quarry.sources import table


def message_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, conversations and characters by role, without system prompts."""
    return (
        table(spark, sf_dir, "conversations")
        .where(F.col("role") != "system")
        .groupBy("role")
        .agg(
            F.count("*").alias("messages"),
            F.count_distinct("conv_id").alias("conversations"),
            F.sum(F.length("text")).alias("chars"),
            F.max("turn").alias("last_turn"),
        )
    )


def conversation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's size, whether it has a system prompt, and who spoke last."""
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(
            F.count("*").alias("messages"),
            F.bool_or(F.col("role") == "system").alias("has_system"),
            F.count_if(F.col("role") == "user").alias("user_messages"),
            F.max_by("role", "turn").alias("last_role"),
            F.sum(F.length("text")).alias("chars"),
        )
    )


def reply_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant message with the size of what it answers."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    rows = rows.withColumns({"asked_chars": F.lag("chars").over(w), "asked_by": F.lag("role").over(w)})
    return rows.where("role = 'assistant'").select("conv_id", "turn", "asked_by", "asked_chars", "chars")


def role_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each role follows each."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("role", F.lead("role").over(w).alias("next_role"))
    return rows.groupBy("role", "next_role").agg(F.count("*").alias("n"))


def longest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two longest messages of each role and turn."""
    rows = table(spark, sf_dir, "conversations").select("role", "turn", "conv_id", F.length("text").cast("long").alias("chars"))
    return first_of_each(rows, ["role", "turn"], [F.desc("chars"), F.asc("conv_id")], 2).withColumn("rank", F.col("rank").cast("long"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's roles in order, and a digest of its text."""
    return folded_text(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text", "role").withColumnRenamed("labels", "roles")


def vocabulary_of_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by role, and distinct words."""
    rows = table(spark, sf_dir, "conversations").select("role", F.explode(words(F.col("text"))).alias("word"))
    return rows.groupBy("role").agg(F.count("*").alias("words"), F.count_distinct("word").alias("distinct_words"))


def running_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a conversation up to each message, and its share of the whole."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    chars = F.length("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(chars).over(w).alias("so_far"), F.round(F.sum(chars).over(w) / F.sum(chars).over(whole), 6).alias("share"))


QUERIES = {f.__name__: f for f in (message_volume, conversation_summary, reply_lengths, role_transitions, longest_messages, transcript, vocabulary_of_roles, running_size)}

SQL = {
    "message_volume": """
SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS conversations,
       CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) AS last_turn
FROM conversations WHERE role <> 'system' GROUP BY role""",
    "conversation_summary": """
SELECT conv_id, count(*) AS messages, bool_or(role = 'system') AS has_system,
       count(*) FILTER (WHERE role = 'user') AS user_messages,
       arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS chars
FROM conversations GROUP BY conv_id""",
    "reply_lengths": """
SELECT conv_id, turn, asked_by, asked_chars, chars FROM (
  SELECT conv_id, turn, role, length(text) AS chars,
         lag(length(text)) OVER w AS asked_chars, lag(role) OVER w AS asked_by
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant'""",
    "role_transitions": """
SELECT role, next_role, count(*) AS n FROM (
  SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations)
GROUP BY role, next_role""",
    "longest_messages": """
SELECT * FROM (
  SELECT role, turn, conv_id, length(text) AS chars,
         row_number() OVER (PARTITION BY role, turn ORDER BY length(text) DESC, conv_id) AS rank
  FROM conversations) WHERE rank <= 2""",
    "transcript": """
SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest
FROM conversations GROUP BY conv_id""",
    "vocabulary_of_roles": r"""
SELECT role, count(*) AS words, count(DISTINCT word) AS distinct_words FROM (
  SELECT role, unnest(regexp_split_to_array(text, '\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY role""",
    "running_size": """
SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far,
       round(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) / sum(length(text)) OVER (PARTITION BY conv_id), 6) AS share
FROM conversations""",
}
