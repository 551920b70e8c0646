"""D12 + H8-H10: positive feedback folded into stored question/SQL documents.

Votes are an associative fold: a batch is reduced to (question, votes,
latest answer) with partial aggregation, then merged with the stored
documents by a full outer join. Applying batches one by one gives the same
documents as applying their union at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chatlog import one_vote_per_answer, validate_feedback
from tessera.operators.vectors import query_doc_id

VOTES_SCHEMA = ("question string, sql_query string, explanation string, positive_votes bigint, "
                "last_ts timestamp_ntz")


def feedback_from_events(events: DataFrame) -> DataFrame:
    """Driver stand-in: each event is a thumbs-up on an answer.

    question = user + event type; the SQL carries the event's value (so it
    changes over time and the latest wins); error events carry no SQL (they
    are rejected by validation); answer_id groups clicks on one answer (one
    user, one type, one day).
    """
    q = F.concat(F.lit("How many "), F.col("event_type"), F.lit(" events did user "),
                 F.col("user_id").cast("string"), F.lit(" have?"))
    sql = F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.concat(
        F.lit("SELECT count(*) FROM events WHERE user_id = "), F.col("user_id").cast("string"),
        F.lit(" AND event_type = '"), F.col("event_type"), F.lit("' AND value >= "),
        F.col("value").cast("string")))
    answer = F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type"),
                         F.date_format("ts", "yyyy-MM-dd"))
    return events.select(answer.alias("answer_id"), F.concat(F.lit(" "), q).alias("question"),
                         sql.alias("sql_query"), F.col("props").alias("explanation"), "ts", "event_id")


def clean_clicks(feedback: DataFrame) -> DataFrame:
    """Trim, keep valid events, one vote per answer (its first click)."""
    valid = validate_feedback(feedback).where("is_valid").drop("missing", "is_valid")
    return one_vote_per_answer(valid, key="answer_id", ts="ts")


def batch_votes(clicks: DataFrame) -> DataFrame:
    """Per question: number of votes and the latest (by time, then event id) SQL and explanation."""
    latest = F.max_by(F.struct("sql_query", "explanation", "ts"), F.struct("ts", "event_id"))
    return (clicks.groupBy("question")
            .agg(F.count(F.lit(1)).alias("positive_votes"), latest.alias("l"))
            .select("question", F.col("l.sql_query").alias("sql_query"), F.col("l.explanation").alias("explanation"),
                    "positive_votes", F.col("l.ts").alias("last_ts")))


def merge_votes(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Existing question -> votes added, later answer wins; new question -> inserted."""
    s, b = stored.alias("s"), batch.alias("b")
    newer = F.coalesce(F.col("b.last_ts") >= F.col("s.last_ts"), F.col("s.last_ts").isNull())
    return (s.join(b, "question", "full_outer")
            .select("question",
                    F.when(newer, F.col("b.sql_query")).otherwise(F.col("s.sql_query")).alias("sql_query"),
                    F.when(newer, F.col("b.explanation")).otherwise(F.col("s.explanation")).alias("explanation"),
                    (F.coalesce(F.col("s.positive_votes"), F.lit(0)) + F.coalesce(F.col("b.positive_votes"), F.lit(0)))
                    .alias("positive_votes"),
                    F.greatest(F.col("s.last_ts"), F.col("b.last_ts")).alias("last_ts")))


def fold_votes(rows: DataFrame) -> DataFrame:
    """D12 over deltas: votes add up, the answer of the latest click (of the latest version, if as late) stays.

    ``rows`` are votes of single batches with the ``version`` that brought them; the fold of folds is the fold of all.
    """
    latest = F.max_by(F.struct("sql_query", "explanation", "last_ts"), F.struct("last_ts", "version"))
    return (rows.groupBy("question").agg(F.sum("positive_votes").alias("positive_votes"), latest.alias("l"))
            .select("question", "l.sql_query", "l.explanation", "positive_votes", "l.last_ts"))


def as_query_docs(votes: DataFrame) -> DataFrame:
    """Stored query documents (id = UUIDv5 of the question, type 'query')."""
    return votes.select(query_doc_id("question").alias("id"), "question", "sql_query", "explanation",
                        "positive_votes", F.col("last_ts").alias("timestamp"), F.lit("query").alias("type"))
