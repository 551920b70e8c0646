"""Chat-log JSON files and prompt-template text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "conv_id bigint, turn bigint, type string, content string, timestamp string"


def write_chat_log(messages: DataFrame, path: str) -> None:
    """A12 write: one JSON object {conv_id, turn, type, content, timestamp} per line, one folder per run."""
    messages.select("conv_id", "turn", "type", "content",
                    F.coalesce(F.col("timestamp").cast("string") if "timestamp" in messages.columns
                               else F.lit(None).cast("string"), F.lit(None).cast("string")).alias("timestamp")) \
        .write.mode("overwrite").json(path)


def read_chat_log(spark: SparkSession, path: str) -> DataFrame:
    """A12 read: malformed lines are dropped (a corrupt log reads as fewer or no messages)."""
    return spark.read.schema(MESSAGE_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def read_template(spark: SparkSession, path: str | None, inline: str | None, default: str) -> str:
    """Template from a file, else the inline text, else the default.

    The file is read with ``wholetext`` (one row); the template is a literal
    that ``answer.build_prompt`` splits once on the driver.
    """
    if path:
        try:
            row = spark.read.text(path, wholetext=True).first()
            if row and row[0]:
                return row[0]
        except Exception:  # missing file -> next source
            pass
    return inline or default
