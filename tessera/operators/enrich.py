"""C: catalog enrichment: importance score, description prompts, completion, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_blank, strip_ws
from tessera.operators import keywords as K
from tessera.operators.answer import CompletionFn, complete

# Enrichment fallbacks.
NO_DESCRIPTION = "No description available"
ENRICH_ERROR = "Error enhancing metadata"
ENRICH_COLUMN_ERROR = "Error enhancing column metadata"
AI_NAME_PLACEHOLDER = "placeholder"


def importance_score(fks: Column, columns: Column, pks: Column) -> Column:
    """round(min(1, 0.2 * #FKs + 0.1 * #columns + 0.3 if any PK), 2)."""
    raw = (F.lit(0.2) * F.size(fks) + F.lit(0.1) * F.size(columns)
           + F.when(F.size(pks) > 0, F.lit(0.3)).otherwise(F.lit(0.0)))
    return F.round(F.least(F.lit(1.0), raw), 2)


def fk_lines(fks: Column) -> Column:
    """'- a, b -> t(c, d)' per FK, or 'No foreign keys'."""
    lines = F.transform(fks, lambda f: F.concat(
        F.lit("- "), F.array_join(f["constrained_columns"], ", "), F.lit(" -> "), f["referred_table"],
        F.lit("("), F.array_join(f["referred_columns"], ", "), F.lit(")")))
    return F.when(F.size(fks) > 0, F.array_join(lines, "\n")).otherwise(F.lit("No foreign keys"))


def table_prompt() -> Column:
    """C2 over catalog_tables columns (name, row_count, columns, primary_keys, foreign_keys)."""
    return F.concat(
        F.lit("[table] "), F.col("name"), F.lit(" ("), F.col("row_count").cast("string"), F.lit(" rows)\n[references]\n"),
        fk_lines(F.col("foreign_keys")),
        F.lit("\n[key] "), F.array_join("primary_keys", ", "), F.lit("\n[fields] "), F.array_join("columns", ", "),
        F.lit("\n\nTask: in at most two sentences, say what one row stands for. Use the facts above and nothing else."))


def column_prompt(sample_n: int = 10) -> Column:
    """C3 over catalog_columns columns; the first ``sample_n`` distinct values when there are any."""
    samples = F.slice(F.coalesce(F.col("distinct_values"), F.array().cast("array<string>")), 1, sample_n)
    marks = F.array_join(F.array_compact(F.array(
        F.when(F.col("is_foreign_key"), "references another table"), F.when(F.col("is_primary_key"), "part of the key"),
        F.when(F.col("nullable"), "may be missing"))), "; ")
    return F.concat(
        F.when(F.size(samples) > 0, F.concat(F.lit("[values] "), F.array_join(samples, " | "), F.lit("\n"))).otherwise(F.lit("")),
        F.lit("[field] "), F.col("table"), F.lit("."), F.col("name"), F.lit(" : "), F.col("data_type"),
        F.lit("\n[marks] "), marks,
        F.lit("\n\nTask: one short sentence on what this field holds. Use the facts above and nothing else."))


def text_keywords(text: Column, n: int = 5) -> Column:
    """C5 on a text inside the row: its best keywords, best first; null (a failure) for a blank text."""
    return F.when(~is_blank(text), F.transform(K.keywords(text, n), lambda k: k["kw"]))


def keywords_or_empty(success: Column, keywords: Column) -> Column:
    """C9."""
    return F.when(success, keywords).otherwise(F.array().cast("array<string>"))


def _described(rows: DataFrame, prompt: Column, fn: CompletionFn, keywords_fn) -> DataFrame:
    """``rows`` with _desc, _failed (the completion of this row's prompt raised) and _kw (null: no keywords could be found)."""
    d = complete(rows.withColumn("_prompt", prompt), "_prompt", "_desc", fn, failed_col="_failed")
    d = d.withColumn("_desc", F.when(~is_blank("_desc"), strip_ws("_desc")))
    return d.withColumn("_kw", keywords_fn(F.col("_desc")))


def enrich_tables(tables: DataFrame, fn: CompletionFn, keywords_fn=text_keywords) -> DataFrame:
    """Description by completion, keywords of the description (C5), importance.

    Fallbacks: without a description the fixed text, no keywords and score 0; without keywords the description stays, score 0;
    a completion that raises gives the error text, no keywords and score 0. An empty list of keywords is a success.
    """
    t = _described(tables, table_prompt(), fn, keywords_fn)
    done = F.col("_kw").isNotNull()
    return t.select(
        *tables.columns,
        F.when(F.col("_failed"), ENRICH_ERROR).otherwise(F.coalesce("_desc", F.lit(NO_DESCRIPTION))).alias("description"),
        keywords_or_empty(done, F.col("_kw")).alias("keywords"),
        F.when(done, importance_score(F.col("foreign_keys"), F.col("columns"), F.col("primary_keys")))
        .otherwise(F.lit(0.0)).alias("importance_score"),
        F.lit("table").alias("type"))


def enrich_columns(columns: DataFrame, fn: CompletionFn, keywords_fn=text_keywords) -> DataFrame:
    """Same shape for columns; ai_name is always the placeholder."""
    c = _described(columns, column_prompt(), fn, keywords_fn)
    return c.select(*columns.columns, F.lit(AI_NAME_PLACEHOLDER).alias("ai_name"),
                    F.when(F.col("_failed"), ENRICH_COLUMN_ERROR).otherwise(F.coalesce("_desc", F.lit(NO_DESCRIPTION))).alias("description"),
                    keywords_or_empty(F.col("_kw").isNotNull(), F.col("_kw")).alias("keywords"),
                    F.lit("column").alias("type"))


KEYWORD_PROMPT = ("Extract up to 5 keywords from the text below. Answer with JSON only: "
                  "{\"keywords\": [\"...\"]}.\n\n")


def model_keywords(df: DataFrame, text_col: str, fn: CompletionFn) -> DataFrame:
    """Keywords from a model's JSON answer; every keyword scores 1.0; failures give []."""
    from tessera.operators.answer import strip_fence

    d = df.withColumn("_kp", F.concat(F.lit(KEYWORD_PROMPT), F.col(text_col)))
    d = complete(d, "_kp", "_ka", fn)
    parsed = F.from_json(strip_fence(F.col("_ka")), "keywords array<string>")
    kws = F.coalesce(parsed["keywords"], F.array().cast("array<string>"))
    return d.withColumn(
        "keywords", F.transform(kws, lambda k: F.struct(k.alias("keyword"), F.lit(1.0).alias("score")))) \
        .drop("_kp", "_ka")
