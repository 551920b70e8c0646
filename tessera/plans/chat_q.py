"""H-queries: chat log analytics over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import chatlog as H
from tessera.plans.registry import query
from tessera.sources.tables import read_table

MSGS_SQL = """SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'bot' ELSE role END AS type,
  text AS content FROM conversations"""


def _msgs(spark, sf):
    return H.messages_from_conversations(read_table(spark, sf, "conversations"))


@query("chat_counts", ids="H1 H2 H5", oracle=f"""
WITH m AS ({MSGS_SQL})
SELECT conv_id, count(*) AS n_messages,
  count(*) FILTER (WHERE type = 'user') AS n_user, count(*) FILTER (WHERE type = 'bot') AS n_bot,
  count(*) FILTER (WHERE type = 'system') AS n_system, count(*) FILTER (WHERE type = 'error') AS n_error,
  count(*) FILTER (WHERE type = 'error') > 0 AS has_error, count(*) = 0 AS is_empty
FROM m GROUP BY conv_id""")
def chat_counts(spark, sf):
    return H.counts_by_type(_msgs(spark, sf))


@query("chat_last", ids="H3", oracle=f"""
WITH m AS ({MSGS_SQL})
SELECT conv_id, max(turn) AS last_turn, arg_max(type, turn) AS last_type, arg_max(content, turn) AS last_content
FROM m GROUP BY conv_id""")
def chat_last(spark, sf):
    return H.last_message(_msgs(spark, sf))


@query("chat_nth", ids="H4", oracle=f"""
WITH m AS ({MSGS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM m)
SELECT c.conv_id, r.turn AS nth_turn, r.type AS nth_type, r.content AS nth_content
FROM (SELECT DISTINCT conv_id FROM m) c LEFT JOIN r ON r.conv_id = c.conv_id AND r.rn = 3""")
def chat_nth(spark, sf):
    return H.nth_message(_msgs(spark, sf), 2)


@query("chat_validate", ids="H6", oracle=f"""
WITH m AS ({MSGS_SQL})
SELECT conv_id, turn, type,
  CASE type
    WHEN 'user' THEN coalesce(regexp_replace(content, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'), '') <> ''
    WHEN 'bot' THEN coalesce(try(json_type(content) = 'OBJECT'
                             AND list_contains(json_keys(content), 'success')), false)
    WHEN 'error' THEN coalesce(try(json_type(content) = 'OBJECT'
                               AND json_type(content, '$.error') = 'VARCHAR'), false)
    ELSE true END AS is_valid
FROM m""")
def chat_validate(spark, sf):
    return H.validate_messages(_msgs(spark, sf)).select("conv_id", "turn", "type", "is_valid")


VARIANTS_SQL = """v AS (SELECT conv_id, turn, x.variant, x.type, x.content FROM (SELECT conv_id, turn, unnest([
    {'variant': 'user', 'type': 'user', 'content': t}, {'variant': 'blank_user', 'type': 'user', 'content': ' ' || chr(10)},
    {'variant': 'bot', 'type': 'bot', 'content': CAST(to_json({'success': true, 'query': t}) AS VARCHAR)},
    {'variant': 'bot_without_success', 'type': 'bot', 'content': CAST(to_json({'query': t}) AS VARCHAR)},
    {'variant': 'error', 'type': 'error', 'content': CAST(to_json({'error': t}) AS VARCHAR)},
    {'variant': 'error_with_number', 'type': 'error', 'content': CAST(to_json({'error': turn}) AS VARCHAR)},
    {'variant': 'error_as_text', 'type': 'error', 'content': 'error ' || t}]) AS x FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)))"""


@query("chat_validate_variants", ids="H6", oracle=f"""WITH {VARIANTS_SQL}
SELECT conv_id, turn, variant, CASE type
    WHEN 'user' THEN coalesce(regexp_replace(content, '^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g'), '') <> ''
    WHEN 'bot' THEN coalesce(try(json_type(content) = 'OBJECT' AND list_contains(json_keys(content), 'success')), false)
    WHEN 'error' THEN coalesce(try(json_type(content) = 'OBJECT' AND json_type(content, '$.error') = 'VARCHAR'), false) END AS is_valid
FROM v""")
def chat_validate_variants(spark, sf):
    """Every message in the forms that validation tells apart: answers with and without success, errors as text, number and object."""
    conv = read_table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")
    forms = {"user": ("user", t), "blank_user": ("user", F.lit(" \n")),
             "bot": ("bot", F.to_json(F.struct(F.lit(True).alias("success"), t.alias("query")))),
             "bot_without_success": ("bot", F.to_json(F.struct(t.alias("query")))),
             "error": ("error", F.to_json(F.struct(t.alias("error")))),
             "error_with_number": ("error", F.to_json(F.struct(F.col("turn").alias("error")))),
             "error_as_text": ("error", F.concat(F.lit("error "), t))}
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(k).alias("type"), c.alias("content")) for v, (k, c) in forms.items()])
    msgs = conv.select("conv_id", "turn", F.explode(each).alias("m")).select("conv_id", "turn", "m.*")
    return H.validate_messages(msgs).select("conv_id", "turn", "variant", "is_valid")
