"""Streams with state: what a micro-batch leaves open, restarts, late and repeated rows, and queues as lists of events."""

import datetime

from pyspark.sql import functions as F

from captionlake.streaming import state
from captionlake.streaming.files import staged

CHUNK = "media_id long, seq int, chunk string, last boolean"


def in_two_runs(spark, rows, schema, make, out_schema):
    """The rows of a stream that stops after the first half and goes on from its checkpoint."""
    half = len(rows) // 2
    first = spark.createDataFrame(rows[:half], schema)
    stream, folder = staged(spark, first.withColumn("piece", F.monotonically_increasing_id()), 2, "piece")
    state.run_until_taken(make(stream), folder)
    spark.createDataFrame(rows[half:], schema).withColumn("piece", F.lit(0).cast("long")).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    state.run_until_taken(make(stream), folder)
    return spark.read.schema(out_schema).parquet(f"{folder}/out").collect()


def test_lines_go_on_across_chunks_and_restarts(spark):
    chunks = {1: ["a\r", "\nb", "", "c\n\r", "\n\nd"], 2: ["x" * 40, "y" * 30, "\nz"], 3: ["é\r\r", "f\n"], 4: ["ok\n" + "w" * 65, "\nlost\n"]}
    rows = [(m, i, t, i == len(ts) - 1) for m, ts in chunks.items() for i, t in enumerate(ts)]
    rows = rows[::2] + rows[1::2]  # half of the chunks come too early
    got = {}
    for r in in_two_runs(spark, rows, CHUNK, lambda s: state.frame_lines(s, 64), state.LINES):
        got.setdefault(r.media_id, []).append((r.p, r.failed, r.line))
    assert sorted(got[1]) == [(i, False, t) for i, t in enumerate(["a", "bc", "", "", "d"])]
    assert got[2] == [(0, True, None)] and sorted(got[3]) == [(0, False, "é"), (1, False, ""), (2, False, "f")]
    assert sorted(got[4], key=lambda x: x[0]) == [(0, False, "ok"), (1, True, None)]


def test_progress_remembers_what_it_showed(spark):
    fractions = [0.0, 0.001, 0.0025, 0.004, 0.9995, 1.0, 1.0, 1.0]
    rows = [(1, 0, i, f, False) for i, f in enumerate(fractions)] + [(2, 0, 9, 0.5, False), (2, 0, 10, 0.5001, True)]
    got = in_two_runs(spark, rows, f"{state.SHOWN}, final boolean", state.throttle_progress, state.SHOWN)
    assert sorted((r.job_id, r.event_id) for r in got) == [(1, 0), (1, 2), (1, 4), (1, 5), (1, 6), (1, 7), (2, 9), (2, 10)]


def test_stale_late_and_repeated_updates(spark):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    rows = [(1, 1, "audio", at(5), 5, 0.5), (1, 1, "audio", at(5), 5, 0.5), (1, 1, "audio", at(3), 3, 0.3), (1, 2, "check", at(1), 7, 0.1), (1, 1, "audio", at(9), 9, 0.9), (2, 4, "save", at(2), 8, 0.2), (1, 2, "check", at(0), 6, 0.0), (2, 4, "save", at(2), 10, 0.4)]
    frame = spark.createDataFrame(rows, state.TIMINGS).withColumn("piece", F.col("event_id"))
    stream, folder = staged(spark, frame, 4, "piece")
    state.run_until_taken(state.stage_timings(stream), folder, ["job_id", "stage"])
    got = state.newest(spark, folder, state.TIMINGS, ["job_id", "stage"]).collect()
    assert {(r.job_id, r.run_id, r.stage, r.event_id) for r in got if r.run_id == (2 if r.job_id == 1 else 4)} == {(1, 2, "check", 7), (2, 4, "save", 10)}


LOGS = {
    "one fails, the next follows": (["add a", "add b", "inspect a", "inspected a matched", "inspect b", "inspected b matched", "begin", "start a", "fail a", "start b", "finish b saved"], {"a": "failed", "b": "completed"}, False),
    "the active one is cancelled": (["add a", "add b", "inspect a", "inspected a matched", "inspect b", "inspected b matched", "begin", "start a", "cancel", "start b", "finish b partly"], {"a": "cancelled", "b": "completedWithWarnings"}, False),
    "a pause starts anew": (["add a", "inspect a", "inspected a matched", "begin", "start a", "pause", "finish a saved", "begin", "start a", "finish a saved"], {"a": "completed"}, False),
    "one added in a run is inspected after it": (["add a", "inspect a", "inspected a matched", "begin", "start a", "add b", "inspect b", "finish a saved", "inspect b", "inspected b undecided"], {"a": "completed", "b": "needsAttention"}, False),
    "nothing begins undecided": (["add a", "add b", "inspect a", "inspected a undetected", "begin", "start a", "decide a", "begin", "start a"], {"a": "running", "b": "waitingForInspection"}, True),
    "an inspection is broken off, another can't be read": (["add a", "add a", "add b", "inspect a", "inspected a stopped", "inspect b", "inspected b unreadable", "begin", "start a", "nonsense"], {"a": "waitingForInspection", "b": "failed"}, False),
}


def test_queues(spark):
    rows = [(q, i, *(x.split() + [None] * 3)[:3]) for q, (log, _, _) in enumerate(LOGS.values()) for i, x in enumerate(log)]
    schema = "queue long, seq long, event string, job string, detail string"
    whole = state.replay(spark.createDataFrame(rows, schema)).collect()
    for q, (_, want, active) in enumerate(LOGS.values()):
        mine = sorted((r for r in whole if r.queue == q), key=lambda r: r.seq)
        assert {r.job: r.state for r in mine} == want and mine[-1].active == active, list(LOGS)[q]
    told = in_two_runs(spark, rows[::2] + rows[1::2], schema, state.job_states, state.CHANGES)
    assert sorted(map(tuple, told)) == sorted(map(tuple, whole))


def test_many_keys_are_few_calls(spark):
    """A call for each key takes some milliseconds, so that many small keys would take hours."""
    calls = spark.sparkContext.accumulator(0)

    class Counted(state.Throttle):
        def handleInputRows(self, *a):
            calls.add(1)
            yield from super().handleInputRows(*a)

    keep, state.Throttle = state.Throttle, Counted
    try:
        runs = spark.range(3000).select(F.col("id").alias("job_id"), F.lit(1).cast("long").alias("run_id"), F.explode(F.expr("sequence(0L, 3L)")).alias("event_id"))
        rows = runs.repartition(7).withColumns({"fraction": F.col("event_id") * 0.0015, "final": F.col("event_id") == 3, "piece": F.col("event_id")})
        folder = state.run_in_pieces(rows, 2, "piece", lambda s: state.throttle_progress(s, buckets=8))
    finally:
        state.Throttle = keep
    assert 0 < calls.value <= 2 * 8
    # pieces are 0, 2 and 1, 3: an update that comes late counts from what was shown
    got = spark.read.schema(state.SHOWN).parquet(f"{folder}/out").groupBy("event_id").count().collect()
    assert {r.event_id: r["count"] for r in got} == {0: 3000, 2: 3000, 3: 3000}


def test_runs_are_read_as_they_come(spark):
    """Millions of runs of a few updates: no call for each of them."""
    from captionlake.operators.grouping import throttled

    rows = [(j, r, i, ((7 * i + j) % 11) / 1000) for j in range(40) for r in (0, None) for i in range(j % 5 + 1)] + [(None, 1, 0, None), (None, 1, 1, 0.5), (None, 1, 2, 1.0), (None, 1, 3, 0.1)]
    frame = spark.createDataFrame(rows, state.SHOWN).repartition(5)
    want = []
    for key in {x[:2] for x in rows}:
        mine, last = sorted((x for x in rows if x[:2] == key), key=lambda x: x[2]), None
        for x in mine:
            f = float("nan") if x[3] is None else x[3]
            if last is None or x is mine[-1] or f >= 1 or f - last >= 0.002:
                want.append(x)
                last = f
    out = throttled(frame)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
