"""D12 / H8-H10 / K1 queries: the events table as a positive-feedback log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import feedback as FB
from tessera.operators.chatlog import one_vote_per_answer, validate_feedback
from tessera.plans.registry import query
from tessera.sources.tables import read_table
from tessera.streaming.feedback_stream import run_feedback_stream

_WS = r"[\t\n\x0B\f\r ]"

FB_SQL = f"""
fb AS (SELECT CAST(user_id AS VARCHAR) || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d') AS answer_id,
         trim(' How many ' || event_type || ' events did user ' || user_id || ' have?') AS question,
         trim(CASE WHEN event_type = 'error' THEN '  ' ELSE 'SELECT count(*) FROM events WHERE user_id = '
              || user_id || ' AND event_type = ''' || event_type || ''' AND value >= ' || CAST(value AS VARCHAR) END)
           AS sql_query,
         trim(props) AS explanation, ts, event_id FROM events),
chk AS (SELECT *, list_filter([CASE WHEN coalesce(regexp_replace(question, '^{_WS}+|{_WS}+$', '', 'g'), '') = '' THEN 'question' END,
                               CASE WHEN coalesce(regexp_replace(sql_query, '^{_WS}+|{_WS}+$', '', 'g'), '') = '' THEN 'sql_query' END,
                               CASE WHEN coalesce(regexp_replace(explanation, '^{_WS}+|{_WS}+$', '', 'g'), '') = '' THEN 'explanation' END],
                              lambda x: x IS NOT NULL) AS missing FROM fb),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY answer_id
             ORDER BY ts, question, sql_query, explanation, event_id) AS rn FROM chk WHERE len(missing) = 0) WHERE rn = 1)"""


def _feedback(spark, sf):
    return FB.feedback_from_events(read_table(spark, sf, "events"))


@query("feedback_validate", ids="H8 H9", oracle=f"""WITH {FB_SQL}
SELECT event_id, question, sql_query, array_to_string(missing, ',') AS missing, len(missing) = 0 AS is_valid FROM chk""")
def feedback_validate(spark, sf):
    v = validate_feedback(_feedback(spark, sf))
    return v.select("event_id", "question", "sql_query", F.array_join("missing", ",").alias("missing"), "is_valid")


@query("feedback_dedupe", ids="H10", oracle=f"""WITH {FB_SQL}
SELECT answer_id, event_id, ts FROM firsts""")
def feedback_dedupe(spark, sf):
    v = validate_feedback(_feedback(spark, sf)).where("is_valid").drop("missing", "is_valid")
    return one_vote_per_answer(v).select("answer_id", "event_id", "ts")


VOTES_ORACLE = f"""WITH {FB_SQL}
SELECT question, arg_max(sql_query, (ts, event_id)) AS sql_query, arg_max(explanation, (ts, event_id)) AS explanation,
  count(*) AS positive_votes, max(ts) AS last_ts
FROM firsts GROUP BY question"""


@query("feedback_votes", ids="D12 K1", oracle=VOTES_ORACLE)
def feedback_votes(spark, sf):
    """Two batches split at the middle of the log's time range, folded in order."""
    fb = _feedback(spark, sf)
    lo_hi = fb.select(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    mid = lo_hi.select(F.col("lo") + (F.col("hi") - F.col("lo")) / 2).scalar()
    first, second = fb.where(F.col("ts") < mid), fb.where(F.col("ts") >= mid)
    # answers already counted in the first batch do not vote again
    c1 = FB.clean_clicks(first)
    c2 = FB.clean_clicks(second).join(c1.select("answer_id"), "answer_id", "left_anti")
    empty = spark.createDataFrame([], FB.VOTES_SCHEMA)
    state = FB.merge_votes(FB.merge_votes(empty, FB.batch_votes(c1)), FB.batch_votes(c2))
    return state


@query("feedback_votes_stream", ids="K1 D12", oracle=VOTES_ORACLE)
def feedback_votes_stream(spark, sf):
    """The same fold as a Structured Streaming job over the events file(s)."""
    return run_feedback_stream(spark, sf, "events.parquet")
