"""Streams that remember: unfinished lines, the last progress shown, the run that is active, a queue's jobs.

Each rule is told of one key (a source, a run, a job, a queue). Spark deals the keys and keeps their state in its store, so
a stream goes on after a restart from its checkpoint. Sources, runs and jobs are many and small, so that a processor takes
a bucket of them at once, whose state is read and written once a micro-batch; a queue has its own. State of a key is small
by construction: an unfinished line of at most 64 KiB, one fraction, one row for each stage of the active run, one row for
each job of a queue. Rows of a key are taken in their own order within a micro-batch; `seq` keeps what comes too early
until its turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.tables import scratch_dir

LONGEST_LINE, LEAST_STEP = 65_536, 0.002
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


COLUMNS = ["job_id", "run_id", "stage", "ts", "event_id", "fraction"]
#: Keys are dealt into so many buckets, which a checkpoint keeps for good. A call per key would cost milliseconds each.
BUCKETS = 2048


def _lists(**kinds: str) -> str:
    """The schema of a bucket's state: rows of many keys, column by column."""
    return ", ".join(f"{name} array<{kind}>" for name, kind in kinds.items())


def _held(state) -> list[tuple]:
    return list(zip(*state.get())) if state.exists() else []


def _hold(state, rows: list[tuple]) -> None:
    if rows:
        state.update(tuple(map(list, zip(*rows))))
    elif state.exists():
        state.clear()


def _plain(ids: pd.Series) -> list:
    """Whole numbers, None for a null."""
    return ids.astype("Int64").astype(object).where(ids.notna(), None).tolist()


class Lines(StatefulProcessor):
    """Lines of chunks (seq from 0, chunk, last), ended by CR, LF or both, also across chunks. A line of more bytes than
    allowed fails its source: the lines before it stand, one row says so, and what follows is passed over."""

    def __init__(self, longest: int = LONGEST_LINE):
        self.longest = longest

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", _lists(media_id="long", seq="int", n="int", tail="string", cr="boolean", failed="boolean"))
        self.early = handle.getValueState("early", _lists(media_id="long", seq="int", chunk="string", last="boolean"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sources = {m: x for m, *x in _held(self.state)}
        early: dict = {}
        for m, seq, *x in _held(self.early):
            early.setdefault(m, {})[seq] = x
        for frame in rows:
            for m, seq, chunk, last in zip(_plain(frame.media_id), frame.seq.tolist(), frame.chunk.tolist(), frame["last"].tolist()):
                early.setdefault(m, {})[int(seq)] = (chunk or "", bool(last))
        out = []
        for m, chunks in early.items():
            sources[m] = self.taken(m, chunks, *sources.get(m, (0, 0, "", False, False)), out)
        _hold(self.state, [(m, *x) for m, x in sources.items()])
        _hold(self.early, [(m, seq, *x) for m, chunks in early.items() for seq, x in chunks.items()])
        if out:
            yield pd.DataFrame(out, columns=["media_id", "p", "failed", "line"]).astype({"media_id": "Int64"})

    def taken(self, m: int, chunks: dict, seq: int, n: int, tail: str, cr: bool, failed: bool, out: list) -> tuple:
        """The state of a source after those of its chunks whose turn it is, which are taken out; its lines go to out."""
        while seq in chunks:
            chunk, last = chunks.pop(seq)
            seq += 1
            if failed:
                continue
            if cr and chunk[:1] == "\n":
                chunk, cr = chunk[1:], False
            cr = chunk.endswith("\r") if chunk else cr
            *whole, tail = (tail + chunk).replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for line in whole + [tail] * (last and tail != ""):
                if len(line.encode()) > self.longest:
                    failed = True
                    break
                out.append((m, n, False, line))
                n += 1
            failed = failed or len(tail.encode()) > self.longest
            if failed:
                out.append((m, n, True, None))
                tail = ""
        return seq, n, tail, cr, failed

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """Updates (event_id, fraction, final) of a run to show: the first, the final one, whole ones, and each that is `least`
    further than the last shown."""

    def __init__(self, least: float = LEAST_STEP):
        self.least = least

    def init(self, handle) -> None:
        self.shown = handle.getValueState("shown", _lists(job_id="long", run_id="long", fraction="double"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        shown = {(j, r): f for j, r, f in _held(self.shown)}
        every, keep = pd.concat(list(rows)).sort_values("event_id"), []
        for j, r, f, final in zip(_plain(every.job_id), _plain(every.run_id), every.fraction.tolist(), every.final.tolist()):
            last = shown.get((j, r))
            keep.append(bool(last is None or final or f >= 1 or f - last >= self.least))
            if keep[-1]:
                shown[j, r] = f
        _hold(self.shown, [(j, r, f) for (j, r), f in shown.items()])
        yield every[keep][["job_id", "run_id", "event_id", "fraction"]]

    def close(self) -> None:
        pass


class StageTimings(StatefulProcessor):
    """The newest update (ts, event_id, fraction) of each stage of a job's active run, the largest run_id so far. Updates of
    older runs, repeated and late ones change nothing; a new run forgets the stages of the one before."""

    def init(self, handle) -> None:
        self.stages = handle.getValueState("stages", _lists(job_id="long", run_id="long", stage="string", ts="timestamp", event_id="long", fraction="double"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[COLUMNS]
        new["job_id"] = _plain(new.job_id)
        new["new"] = True
        have = pd.DataFrame(_held(self.stages), columns=COLUMNS).assign(new=False)
        have["ts"] = pd.to_datetime(have.ts).astype(new.ts.dtype)
        both = pd.concat([have, new]) if len(have) else new
        both = both[both.run_id == both.groupby("job_id", dropna=False).run_id.transform("max")]
        # of updates with one time and id the one that is held stays
        last = both.sort_values(["ts", "event_id", "new"], ascending=[True, True, False], kind="stable").drop_duplicates(["job_id", "stage"], keep="last")
        _hold(self.stages, [(None if pd.isna(j) else int(j), int(r), stage, ts.to_pydatetime(), int(e), float(f)) for j, r, stage, ts, e, f in last[COLUMNS].itertuples(index=False)])
        changed = last[last.new.astype(bool)]
        if len(changed):
            yield changed[COLUMNS]

    def close(self) -> None:
        pass


# The states of a job, those in which it may be started, and those that stop a queue's begin.
WAITING, INSPECTING, ATTENTION, READY, STARTING, RUNNING = "waitingForInspection", "inspecting", "needsAttention", "ready", "waitingForTranslation", "running"
PAUSED, COMPLETED, PARTLY, FAILED, CANCELLED = "paused", "completed", "completedWithWarnings", "failed", "cancelled"
RUNNABLE = (READY, PAUSED)
#: Where an inspection leads, and how a run may end.
INSPECTED = {"matched": READY, "undecided": ATTENTION, "undetected": ATTENTION, "unreadable": FAILED}
FINISHED = {"saved": COMPLETED, "partly": PARTLY}


def advance(jobs: dict[str, str], active: bool, event: str, job: str | None, detail: str | None) -> tuple[bool, list[tuple[str, str]]]:
    """(active, changes) of a queue after an event; jobs (state by name, in the queue's order) is changed in place.

    add, inspect, inspected (detail: where it leads), decide (the language is settled), begin, start (the next job runs),
    finish (detail: saved or partly), fail, pause, cancel. An event that doesn't fit the state changes nothing. One job of a
    queue is under way at a time; when it ends, but for a pause, the first runnable one follows, and a queue without one
    becomes inactive."""
    changes = []

    def put(name: str, state: str) -> None:
        jobs[name] = state
        changes.append((name, state))

    def follow() -> bool:
        name = next((j for j, s in jobs.items() if s in RUNNABLE), None)
        if name is None:
            return False
        put(name, STARTING)
        return True

    running = next((j for j, s in jobs.items() if s == RUNNING), None)
    state = jobs.get(job)
    if event == "add" and job is not None and job not in jobs:
        put(job, WAITING)
    elif event == "inspect" and state == WAITING and not active:
        put(job, INSPECTING)
    elif event == "inspected" and state == INSPECTING:
        put(job, INSPECTED.get(detail, WAITING))  # an inspection that was broken off is made again
    elif event == "decide" and state == ATTENTION:
        put(job, READY)
    elif event == "begin" and not active and running is None and not {INSPECTING, ATTENTION} & set(jobs.values()):
        active = follow()
    elif event == "start" and active and running is None and state == STARTING:
        put(job, RUNNING)
    elif event in ("finish", "fail") and running is not None and job == running:
        put(job, FAILED if event == "fail" else FINISHED.get(detail, COMPLETED))
        active = active and follow()
    elif event == "pause" and active:
        active = False
        for name in [j for j, s in jobs.items() if s in (RUNNING, STARTING)]:
            put(name, PAUSED)
    elif event == "cancel" and active and running is not None:
        put(running, CANCELLED)
        active = follow()
    return active, changes


CHANGES = "queue long, seq long, job string, state string, active boolean"


class Queue(StatefulProcessor):
    """The changes of a queue's jobs by its events (seq from 0, event, job, detail)."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "seq long, active boolean")
        self.jobs = handle.getMapState("jobs", "place int", "name string, state string")
        self.early = handle.getMapState("early", "seq long", "event string, job string, detail string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples():
                text = lambda v: None if pd.isna(v) else str(v)
                self.early.updateValue((int(r.seq),), (text(r.event), text(r.job), text(r.detail)))
        seq, active = self.state.get() if self.state.exists() else (0, False)
        jobs = dict(v for _, v in sorted((k[0], tuple(v)) for k, v in self.jobs.iterator()))
        out = []
        while self.early.containsKey((seq,)):
            event = self.early.getValue((seq,))
            self.early.removeKey((seq,))
            active, changes = advance(jobs, active, *event)
            out += [(*key, seq, name, state, active) for name, state in changes]
            seq += 1
        self.state.update((seq, active))
        for place, (name, state) in enumerate(jobs.items()):
            self.jobs.updateValue((place,), (name, state))
        if out:
            yield pd.DataFrame(out, columns=["queue", "seq", "job", "state", "active"])

    def close(self) -> None:
        pass


def replay(events: DataFrame, parts: int = 256) -> DataFrame:
    """The same changes for a whole log at once: a queue's events in one fold, as long as the queue's log. Queues are dealt into
    so many parts, each sorted by a task of its own: left to Spark, tasks are as few as the cores, and grow with the table."""

    def fold(key: tuple, log: pd.DataFrame) -> pd.DataFrame:
        jobs, active, out = {}, False, []
        text = lambda v: None if pd.isna(v) else str(v)
        for r in log.sort_values("seq").itertuples():
            active, changes = advance(jobs, active, text(r.event), text(r.job), text(r.detail))
            out += [(int(key[0]), int(r.seq), name, state, active) for name, state in changes]
        return pd.DataFrame(out, columns=["queue", "seq", "job", "state", "active"])

    return events.select("queue", "seq", "event", "job", "detail").repartition(parts, "queue").groupBy("queue").applyInPandas(fold, CHANGES)


LINES = "media_id long, p int, failed boolean, line string"
SHOWN = "job_id long, run_id long, event_id long, fraction double"
TIMINGS = "job_id long, run_id long, stage string, ts timestamp, event_id long, fraction double"


def frame_lines(chunks: DataFrame, longest: int = LONGEST_LINE, buckets: int = BUCKETS) -> DataFrame:
    """A stream of lines of a stream of chunks: media_id, seq, chunk, last (see Lines)."""
    return _with_state(_dealt(chunks, ["media_id"], buckets), ["bucket"], Lines(longest), LINES)


def throttle_progress(updates: DataFrame, least: float = LEAST_STEP, buckets: int = BUCKETS) -> DataFrame:
    """A stream of the updates to show of a stream: job_id, run_id, event_id, fraction, final (see Throttle)."""
    return _with_state(_dealt(updates, ["job_id", "run_id"], buckets), ["bucket"], Throttle(least), SHOWN)


def stage_timings(updates: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of changes of a stream: job_id, run_id, stage, ts, event_id, fraction (see StageTimings)."""
    return _with_state(_dealt(updates, ["job_id"], buckets), ["bucket"], StageTimings(), TIMINGS, "Update")


def job_states(events: DataFrame) -> DataFrame:
    """A stream of changes of a stream: queue, seq, event, job, detail (see advance)."""
    return _with_state(events, ["queue"], Queue(), CHANGES)


def _dealt(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str = "Append") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="None")


def run_until_taken(out: DataFrame, folder: str, keys: list[str] | None = None) -> None:
    """Take what a stream's source has, and stop; called again, it goes on from its checkpoint. keys: out updates rows, so
    that each batch is a folder of its own, which a batch that is done again replaces; see newest."""
    writer = out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if keys is None:
        query = writer.format("parquet").outputMode("append").start(f"{folder}/out")
    else:
        query = writer.outputMode("update").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).start()
    query.awaitTermination()


def run_in_pieces(rows: DataFrame, pieces: int, order: str, make: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> str:
    """The folder of the stream make(rows), of which a piece after the other comes, by order modulo pieces; each is a
    micro-batch of its own, whatever number of files it has, and the stream goes on from its checkpoint."""
    spark, folder = rows.sparkSession, scratch_dir(rows.sparkSession)
    for k in range(pieces):
        rows.where(F.pmod(F.col(order), F.lit(pieces)) == k).write.mode("append").parquet(f"{folder}/in")
        run_until_taken(make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in")), folder, keys)
    return folder


def newest(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """Of rows that batches updated, the last of each key."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/out")
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
