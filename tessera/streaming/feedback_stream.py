"""K1-K3: Structured Streaming jobs that fold events into stored state.

Feedback (K1): which answers have been voted on is keyed state in Spark's own state store, one aggregate per answer; a
micro-batch touches the answers it brings. What it adds to the questions' votes is a delta of its own, folded when read,
so what a batch writes does not depend on what is stored. The delta's marker names the batch: ``foreachBatch`` is
at-least-once; the rows of a replayed batch, which the state store answers as it did the first time, are not written again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.feedback import VOTES_SCHEMA, batch_votes, feedback_from_events, fold_votes
from tessera.operators.chatlog import validate_feedback
from tessera.session import checkpoint_dir
from tessera.sources.deltas import Deltas
from tessera.sources.versioned import VersionedState


def first_clicks(feedback: DataFrame) -> DataFrame:
    """Of a stream of clicks the first valid one of every answer, in the micro-batch that brings it.

    An answer's state is its first click and the times of the first and the last micro-batch that held one: they are equal
    only when the answer is new. Later clicks on it come out with differing times and are dropped.
    """
    valid = validate_feedback(feedback).where("is_valid").drop("missing", "is_valid")
    cols = [c for c in valid.columns if c != "answer_id"]
    seen = valid.withColumn("_batch", F.current_timestamp())  # one time per micro-batch, kept in its log for a replay
    state = seen.groupBy("answer_id").agg(F.min_by(F.struct(*cols), F.struct("ts", *[c for c in cols if c != "ts"])).alias("f"),
                                          F.min("_batch").alias("_first"), F.max("_batch").alias("_last"))
    return state.where(F.col("_first") == F.col("_last")).select("answer_id", "f.*")


def votes_table(spark: SparkSession, root: str) -> Deltas:
    return Deltas(spark, root, VOTES_SCHEMA)


def read_votes(votes: Deltas) -> DataFrame:
    """Stored votes per question: the fold of all deltas."""
    return fold_votes(votes.read())


def run_feedback_stream(spark: SparkSession, source_dir: str, file_glob: str = "events*.parquet",
                        root: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """K1: read the event files as a stream until all available files are processed."""
    base = root or f"{checkpoint_dir(spark)}/feedback-stream-{uuid.uuid4().hex}"
    votes = votes_table(spark, f"{base}/votes")
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(source_dir).schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir))
    def apply(clicks: DataFrame, batch_id: int) -> None:
        if not votes.append(batch_votes(clicks), "feedback", batch_id):
            clicks.write.format("noop").mode("overwrite").save()  # a replay: its rows are here, its state must still be

    q = (first_clicks(feedback_from_events(stream)).writeStream.outputMode("update").foreachBatch(apply)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return read_votes(votes)


def run_upsert_stream(spark: SparkSession, source_dir: str, file_glob: str, apply_fn,
                      root: str | None = None) -> str:
    """K2/K3 shape: any ``apply_fn(state, batch_df, batch_id)`` over a file stream; returns the state root."""
    base = root or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    state = VersionedState(spark, f"{base}/state")
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(source_dir).schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
              .option("maxFilesPerTrigger", 1).parquet(source_dir))
    q = (stream.writeStream.foreachBatch(lambda df, bid: apply_fn(state, df, bid))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{base}/state"


def stream_questions(spark: SparkSession, questions: DataFrame, answer_fn, root: str | None = None) -> DataFrame:
    """K3: each micro-batch of questions runs the answer recipe (``answer_fn(batch) -> responses``).

    Every batch's responses are written to a folder of their own (a replayed batch overwrites its own folder); all
    of them are returned.
    """
    base = root or f"{checkpoint_dir(spark)}/questions-{uuid.uuid4().hex}"

    def run(df, bid):
        answer_fn(df).write.mode("overwrite").parquet(f"{base}/responses/batch={bid}")

    (questions.writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    empty = spark.createDataFrame([], questions.schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/responses")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return answer_fn(empty)
    return spark.read.parquet(f"{base}/responses").drop("batch")
