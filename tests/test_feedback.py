"""Feedback fold: FIXTURES cases, and a multi-file stream equals the batch fold."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import feedback as FB
from tessera.streaming.feedback_stream import read_votes, run_feedback_stream, votes_table

T0 = dt.datetime(2024, 1, 1)


def test_votes_fixture_cases(spark):
    rows = [("a1", "q new", "SELECT 1", "e", T0, 1),
            ("a2", "q rep", "SELECT old", "e", T0, 2),
            ("a3", "q rep", "SELECT new", "e", T0 + dt.timedelta(hours=1), 3),
            ("a4", "q blank", "   ", "e", T0, 4),                 # blank field: rejected
            ("a3", "q rep", "SELECT later click", "e", T0 + dt.timedelta(hours=2), 5)]  # duplicate click
    fb = spark.createDataFrame(rows, "answer_id string, question string, sql_query string, explanation string, "
                                     "ts timestamp_ntz, event_id bigint")
    votes = {r["question"]: (r["positive_votes"], r["sql_query"])
             for r in FB.batch_votes(FB.clean_clicks(fb)).collect()}
    assert votes == {"q new": (1, "SELECT 1"), "q rep": (2, "SELECT new")}


def test_fold_is_associative(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    fb = FB.feedback_from_events(ev)
    whole = FB.batch_votes(FB.clean_clicks(fb))
    a, b = fb.where(F.col("event_id") < 400), fb.where(F.col("event_id") >= 400)
    ca = FB.clean_clicks(a)
    cb = FB.clean_clicks(b).join(ca.select("answer_id"), "answer_id", "left_anti")
    empty = spark.createDataFrame([], FB.VOTES_SCHEMA)
    folded = FB.merge_votes(FB.merge_votes(empty, FB.batch_votes(ca)), FB.batch_votes(cb))
    key = ["question", "positive_votes"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, folded.select(key).collect()))


def test_stream_equals_batch(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = tempfile.mkdtemp(prefix="tessera-events-")
    # three files, one per time slice, so the stream sees three micro-batches in time order
    for i, (lo, hi) in enumerate([(0, 300), (300, 700), (700, 10 ** 9)]):
        part = ev.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).toPandas()
        part.to_parquet(os.path.join(src, f"events{i}.parquet"), index=False, coerce_timestamps="us")
    streamed = run_feedback_stream(spark, src, "events*.parquet")
    batch = FB.batch_votes(FB.clean_clicks(FB.feedback_from_events(ev)))
    key = ["question", "positive_votes"]
    assert sorted(map(tuple, streamed.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


def _event_files(spark, src, slices):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i, (lo, hi) in enumerate(slices):
        part = ev.where((F.col("event_id") >= lo) & (F.col("event_id") < hi)).toPandas()
        part.to_parquet(os.path.join(src, f"events{i}.parquet"), index=False, coerce_timestamps="us")


def _bytes(folder, ending=""):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(ending) and not f.startswith("."))


def test_a_batch_writes_what_it_brings(spark):
    """What the last, small batch writes does not grow with what was stored before it."""
    written = []
    for first in (300, 900):
        src, root = tempfile.mkdtemp(prefix="tessera-events-"), tempfile.mkdtemp(prefix="tessera-votes-")
        _event_files(spark, src, [(0, first), (900, 10 ** 9)])
        run_feedback_stream(spark, src, "events*.parquet", root=root)
        state = lambda name: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/checkpoint/state") for f in fs if f == name)
        written.append((state("1.delta"), state("2.delta"), _bytes(f"{root}/votes/v=1/delta")))
    small, large = written
    assert large[0] > 1.5 * small[0] and small[1] > 0
    assert abs(large[1] - small[1]) <= 0.15 * small[1] and abs(large[2] - small[2]) <= 0.15 * small[2]


def test_replayed_batches_and_restarts_change_nothing(spark):
    src, root = tempfile.mkdtemp(prefix="tessera-events-"), tempfile.mkdtemp(prefix="tessera-votes-")
    _event_files(spark, src, [(0, 300), (300, 700)])
    key = ["question", "positive_votes", "sql_query", "last_ts"]
    rows = lambda df: sorted(map(tuple, df.select(key).collect()))
    first = rows(run_feedback_stream(spark, src, "events*.parquet", root=root))
    votes = votes_table(spark, f"{root}/votes")
    assert not votes.append(spark.createDataFrame([("q", "s", "e", 99, T0)], FB.VOTES_SCHEMA), "feedback", 1)  # its marker is there
    # the last commit of the stream is lost: it runs that batch again, from the state before it
    commits = sorted(os.listdir(f"{root}/checkpoint/commits"))
    os.unlink(f"{root}/checkpoint/commits/1")
    if ".1.crc" in commits:
        os.unlink(f"{root}/checkpoint/commits/.1.crc")
    assert rows(run_feedback_stream(spark, src, "events*.parquet", root=root)) == first and votes.state.current() == 1
    # clicks on answers that have a vote already add none
    part = spark.read.parquet(os.path.join(src, "events0.parquet")).toPandas()
    part["event_id"] += 10 ** 6
    part.to_parquet(os.path.join(src, "events2.parquet"), index=False, coerce_timestamps="us")
    assert rows(run_feedback_stream(spark, src, "events*.parquet", root=root)) == first
    votes.compact(FB.fold_votes)
    assert rows(read_votes(votes)) == first and len(votes.paths()) == 1
