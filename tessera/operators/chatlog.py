"""H: chat log analytics and feedback handling over message / feedback frames.

Per-conversation questions are aggregates with map-side partial state
(``count``, ``max_by``), or ranked windows whose ``row_number() <= n`` filter
plans a WindowGroupLimit, so a conversation holding a third of all rows is
trimmed on every map partition before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_blank

MESSAGE_TYPES = ("user", "bot", "system", "error")
ROLE_TO_TYPE = {"user": "user", "assistant": "bot", "system": "system", "error": "error"}


def messages_from_conversations(conv: DataFrame) -> DataFrame:
    """Driver table -> messages(conv_id, turn, type, content); assistant maps to bot."""
    mapping = F.create_map(*[x for kv in ROLE_TO_TYPE.items() for x in map(F.lit, kv)])
    return conv.select("conv_id", "turn", F.coalesce(mapping[F.col("role")], F.col("role")).alias("type"),
                       F.col("text").alias("content"))


def filter_type(msgs: DataFrame, type_: str) -> DataFrame:
    """H1."""
    return msgs.where(F.col("type") == type_)


def counts_by_type(msgs: DataFrame) -> DataFrame:
    """H2/H5: per conversation total and per-type counts (one aggregation, no pivot pass)."""
    aggs = [F.count(F.lit(1)).alias("n_messages")]
    aggs += [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in MESSAGE_TYPES]
    out = msgs.groupBy("conv_id").agg(*aggs)
    return out.withColumn("has_error", F.col("n_error") > 0).withColumn("is_empty", F.col("n_messages") == 0)


def last_message(msgs: DataFrame) -> DataFrame:
    """H3: the latest message per conversation (max_by keeps partial state map side)."""
    m = msgs.groupBy("conv_id").agg(F.max_by(F.struct("turn", "type", "content"), "turn").alias("m"))
    return m.select("conv_id", F.col("m.turn").alias("last_turn"), F.col("m.type").alias("last_type"),
                    F.col("m.content").alias("last_content"))


def nth_message(msgs: DataFrame, n: int) -> DataFrame:
    """H4: message at 0-based position n per conversation, null when the log is shorter."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    ranked = msgs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n + 1)
    hit = ranked.where(F.col("_rn") == n + 1).select(
        "conv_id", F.col("turn").alias("nth_turn"), F.col("type").alias("nth_type"),
        F.col("content").alias("nth_content"))
    convs = msgs.select("conv_id").distinct()
    return convs.join(hit, "conv_id", "left")


def _json_has_key(c, key: str):
    keys = F.json_object_keys(c)
    return F.coalesce(F.array_contains(keys, key), F.lit(False))


def validate_messages(msgs: DataFrame) -> DataFrame:
    """H6: user -> non-blank text; bot -> JSON object with `success`; error -> object with string `error`."""
    c = F.col("content")
    valid = (F.when(F.col("type") == "user", ~is_blank(c))
             .when(F.col("type") == "bot", _json_has_key(c, "success"))
             .when(F.col("type") == "error",
                   F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), "$.error", "variant")) == "STRING", F.lit(False)))
             .otherwise(F.lit(True)))
    return msgs.withColumn("is_valid", valid)


# ----------------------------------------------------------- feedback -----

FEEDBACK_FIELDS = ("question", "sql_query", "explanation")


def validate_feedback(fb: DataFrame) -> DataFrame:
    """H8/H9: trim the three fields; list the missing (null or blank) ones."""
    trimmed = fb
    for f in FEEDBACK_FIELDS:
        trimmed = trimmed.withColumn(f, F.trim(F.col(f)))
    missing = F.array_compact(F.array(*[F.when(is_blank(f), F.lit(f)) for f in FEEDBACK_FIELDS]))
    return trimmed.withColumn("missing", missing).withColumn("is_valid", F.size("missing") == 0)


def one_vote_per_answer(fb: DataFrame, key: str = "answer_id", ts: str = "ts") -> DataFrame:
    """The first click on an answer counts, later clicks are ignored (min_by keeps it partial)."""
    cols = [c for c in fb.columns if c != key]
    first = fb.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(ts, *[c for c in cols if c != ts])).alias("f"))
    return first.select(key, "f.*")


def answer_flags(responses: DataFrame) -> DataFrame:
    """H7: hasError, isFromCache, hasQuery, hasResults."""
    return responses.select(
        "*",
        (F.col("error").isNotNull() & (F.col("error") != "")).alias("has_error"),
        F.coalesce(F.col("from_vector_store"), F.lit(False)).alias("is_from_cache"),
        (F.col("query").isNotNull() & (F.col("query") != "")).alias("has_query"),
        (F.coalesce(F.size("preview"), F.lit(0)) > 0).alias("has_results"))
