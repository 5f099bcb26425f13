"""Streams with state and timers for each machine: current state with change events, failures with cooldown."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, TimestampType

from fleetlake.operators.failures import COOLDOWN_S, LIMIT, TIMEOUT_S
from fleetlake.operators.fleet import BUSY_LOAD
from fleetlake.storage import load_state, save_state, shared_path, versions

STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that state variables and timers need, for the streams that start inside."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def timed(rows: DataFrame) -> DataFrame:
    """Rows with node, ts and seq; ``ts`` is a timestamp (one without zone counts as UTC) and ``us`` its microseconds."""
    ts = F.col("ts") if rows.schema["ts"].dataType == TimestampType() else F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))")
    return rows.where("node is not null and ts is not null and seq is not null").withColumn("ts", ts).withColumn("us", F.unix_micros("ts"))


def _in_order(rows: Iterator[Row], last: tuple | None) -> list[Row]:
    """The rows of one key and trigger by (us, seq), without those that aren't newer than the last one of an earlier trigger."""
    return sorted((r for r in rows if last is None or (r.us, r.seq) > last), key=lambda r: (r.us, r.seq))


class NodeState(StatefulProcessor):
    """Keeps a machine's last report; tells its new state once a trigger and each change as it comes."""

    def __init__(self, fields: list[str], state: StructType, profile: list[str]):
        self.fields, self.state, self.profile = fields, state, profile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = ["us", "seq", *self.fields]
        kept = self.last.get()  # one call to the store; null if there is nothing yet
        before = None if kept is None else dict(zip(names, kept, strict=True))
        told = []
        reports = [r.asDict() for r in _in_order(rows, (before["us"], before["seq"]) if before else None)]
        for r in reports:
            status = self.status(r)
            if before is None:
                told.append(("Joined", r["seq"], ""))
            else:
                groups = ["hardware"] * any(r[c] != before[c] for c in self.profile) + ["version"] * (r["agent_version"] != before["agent_version"])
                if groups:
                    told.append(("Updated", r["seq"], ",".join(groups)))
                if status != self.status(before):
                    told.append(("StateChanged", r["seq"], f"{self.status(before)}>{status}"))
                if r["verb"] == "heartbeat":
                    told.append(("Updated", r["seq"], "power,temp,load"))
            before = r
        if reports:
            self.last.update(tuple(before[c] for c in names))
            row, none = Row("node", "kind", "seq", "detail", "us", *self.fields), [None] * (len(self.fields) + 1)
            yield from (row(key[0], *t, *none) for t in told)
            yield row(key[0], "State", before["seq"], self.status(before), before["us"], *(before[c] for c in self.fields))

    @staticmethod
    def status(r: dict) -> str:
        return "Working" if (r["load_avg"] or 0) > BUSY_LOAD else "Idle"

    def close(self) -> None:
        pass


def stream_state(reports: DataFrame, fields: list[str], profile: list[str] | None = None) -> DataFrame:
    """Current state and change events of a stream of reports (node, ts, seq, ``fields``), verb, load_avg and agent_version among them.

    Rows of kind State (one a trigger and machine that reported) have all fields, ``us`` and,
    as ``detail``, the status; the others are the events of ``fleet.change_events``, with
    ``profile`` as there. Reports that aren't newer than a machine's last one of an earlier
    trigger are ignored, as are rows without node, ts or seq. The rows of one machine in one trigger are
    held together, so triggers have to be bounded.
    """
    rows = timed(reports).select("node", "us", "seq", *fields)
    kept = StructType([f for f in rows.schema if f.name != "node"])
    out = StructType([rows.schema["node"]]).add("kind", "string").add("seq", "long").add("detail", "string")
    for f in kept:
        if f.name != "seq":
            out = out.add(f.name, f.dataType)
    return rows.groupBy("node").transformWithState(NodeState(fields, kept, profile or []), out, "Append", "None")


class KeyedTable:
    """A table with one row a key: each trigger adds the rows of changed keys only, now and then they are merged.

    A trigger's rows go to a folder of its number, so a trigger that is run again writes
    them in place of the first time. ``merge`` folds what has gathered into a new version of
    the base; what a reader sees is the same before and after.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema

    def add(self, rows: DataFrame, trigger: int) -> None:
        rows.withColumn("trigger", F.lit(trigger).cast("long")).write.mode("overwrite").parquet(f"{self.path}/changes/{trigger:012d}")

    def read(self) -> DataFrame:
        kind = f"{self.schema}, trigger long"
        parts = [load_state(self.spark, f"{self.path}/base", kind).drop("threshold_s")]
        if self._changes():
            parts.append(self.spark.read.schema(kind).parquet(f"{self.path}/changes/*"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy(self.key).agg(F.max_by(F.struct("*"), "trigger").alias("r")).select("r.*")

    def rows(self) -> DataFrame:
        return self.read().drop("trigger")

    def merge(self) -> None:
        """Folds the changes that are there now into the base, in one rewrite, and deletes their folders."""
        fs, done = self._fs(), self._changes()
        save_state(self.read(), f"{self.path}/base")
        for folder in done:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)

    def _fs(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _changes(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/changes")
        return [f.getPath().toString() for f in self._fs().listStatus(at)] if self._fs().exists(at) else []

    def versions(self) -> list[int]:
        return versions(self.spark, f"{self.path}/base")


def keep_state(stream: DataFrame, path: str, merge_every: int = 50) -> tuple[KeyedTable, DataFrame]:
    """Runs ``stream_state`` over all that its source has: (table of current states, events of all triggers).

    Each trigger is written once: its State rows to the keyed table, its events to a folder of its number.
    """
    spark = stream.sparkSession
    rest = [f for f in stream.schema if f.name not in ("node", "kind")]
    kind = f"node {stream.schema['node'].dataType.simpleString()}, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)
    table = KeyedTable(spark, f"{path}/state", "node", kind)
    events = stream.select("node", "seq", "kind", "detail").schema

    def one(rows: DataFrame, trigger: int) -> None:
        rows.persist()
        table.add(rows.where("kind = 'State'").drop("kind"), trigger)
        rows.where("kind <> 'State'").select("node", "seq", "kind", "detail").write.mode("overwrite").parquet(f"{path}/events/{trigger:012d}")
        rows.unpersist()
        if trigger % merge_every == merge_every - 1:
            table.merge()

    with keyed_state(spark):
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/progress").foreachBatch(one).start()
    query.awaitTermination()
    return table, spark.read.schema(events).parquet(f"{path}/events/*")


class Failures(StatefulProcessor):
    """Counts a machine's failures in a row; timers tell when its cooldown ends and when it has timed out."""

    def __init__(self, limit: int, cooldown_s: int, timeout_s: int):
        self.limit = limit
        # In whole seconds since the last failure: cooling below the first, timed out beyond the second.
        self.steps = [("waiting", cooldown_s), ("timed_out", timeout_s + 1)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("failures", "us long, seq long, streak long, failed_s long, change string, timer long")

    def _due(self, failed_s: int | None, change: str, until_us: int) -> Iterator[tuple]:
        """What happens by itself after a failure, before ``until_us``."""
        past = [name for name, _ in self.steps]
        for name, after in self.steps if change != "clear" else []:
            if (failed_s + after) * 1_000_000 < until_us and (change not in past or past.index(name) > past.index(change)):
                yield None, (failed_s + after) * 1_000_000, name

    def _wait(self, failed_s: int | None, change: str, timer: int | None) -> int | None:
        """One timer at most, for the next step, instead of ``timer``, which is told by the state and not by a list of timers."""
        ahead = next(self._due(failed_s, change, 2**63), None)
        wanted = None if ahead is None else ahead[1] // 1000 - 1  # fires when the watermark is past it
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        return wanted

    def _rows(self, node, seen: list[tuple], changes: list[tuple]) -> Iterator[Row]:
        row = Row("node", "seq", "streak", "offline", "at_us", "change")
        yield from (row(node, seq, streak, offline, None, None) for seq, streak, offline in seen)
        yield from (row(node, seq, None, None, at, change) for seq, at, change in changes)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        us, seq, streak, failed, change, timer = self.kept.get() or (None, None, 0, None, "clear", None)
        seen, changes = [], []
        for r in _in_order(rows, None if us is None else (us, seq)):
            us, seq = r.us, r.seq
            for step in self._due(failed, change, us):
                changes.append(step)
                change = step[2]
            bad = r.verb == "failure"
            streak, failed = (streak + 1, us // 1_000_000) if bad else (0, None)
            if change != ("cooling" if bad else "clear"):
                change = "cooling" if bad else "clear"
                changes.append((seq, us, change))
            seen.append((seq, streak, bad and streak >= self.limit))
        if seen:
            self.kept.update((us, seq, streak, failed, change, self._wait(failed, change, timer)))
        yield from self._rows(key[0], seen, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        us, seq, streak, failed, change, timer = self.kept.get()
        timer = None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer  # Spark deletes the one that has expired
        changes = list(self._due(failed, change, timerValues.getCurrentWatermarkInMs() * 1000 + 1))
        change = changes[-1][2] if changes else change
        self.kept.update((us, seq, streak, failed, change, self._wait(failed, change, timer)))
        yield from self._rows(key[0], [], changes)

    def close(self) -> None:
        pass


def stream_failures(reports: DataFrame, limit: int = LIMIT, cooldown_s: int = COOLDOWN_S, timeout_s: int = TIMEOUT_S, delay_s: int = 0) -> DataFrame:
    """Failures in a row and what follows from them, of a stream of reports (node, ts, seq, verb).

    A row for each report: seq, ``streak`` and ``offline`` as in ``failures.failure_streaks``. And
    a row for each change of a machine's standing: ``at_us`` and ``change``, which is cooling (a failure),
    waiting (``cooldown_s`` after the last one), timed_out (more than ``timeout_s`` after it) or clear
    (any other report); seq is the report's, null for what time brings. At any time the last change
    at or before it, by (at_us, seq), is what ``failures.cooldown`` tells. Changes that time brings come when the watermark, ``delay_s`` behind the newest
    report, has reached them, or with the machine's next report; a report cancels what was ahead.
    Reports that aren't newer than the machine's last one of an earlier trigger, or are behind
    the watermark, are ignored.
    """
    rows = timed(reports).select("node", "ts", "us", "seq", "verb").withWatermark("ts", f"{delay_s} seconds")
    out = StructType([rows.schema["node"]]).add("seq", "long").add("streak", "long").add("offline", "boolean").add("at_us", "long").add("change", "string")
    return rows.groupBy("node").transformWithState(Failures(limit, cooldown_s, timeout_s), out, "Append", "eventTime")


def failure_changes(reports: DataFrame, cooldown_s: int = COOLDOWN_S, timeout_s: int = TIMEOUT_S, delay_s: int = 0) -> DataFrame:
    """(node, seq, at_us, change): the changes of ``stream_failures`` for a finished table."""
    second = 1_000_000
    r = timed(reports).select("node", "us", "seq", (F.col("verb") == "failure").alias("bad"), F.expr(f"us div {second} * {second}").alias("s"))
    w = Window.partitionBy("node").orderBy("us", "seq")
    end = r.agg((F.max("us") - delay_s * second).alias("end"))  # one row
    r = r.withColumn("was", F.coalesce(F.lag("bad").over(w), F.lit(False))).withColumn("prev", F.lag("s").over(w)).withColumn("next", F.lead("us").over(w)).crossJoin(F.broadcast(end))
    told = lambda name, at, when, seq: F.when(when, F.struct(seq.alias("seq"), at.alias("at_us"), F.lit(name).alias("change")))
    fresh = F.col("bad") & (~F.col("was") | (F.col("us") > F.col("prev") + cooldown_s * second))
    parts = [told("cooling", F.col("us"), fresh, F.col("seq")), told("clear", F.col("us"), ~F.col("bad") & F.col("was"), F.col("seq"))]
    for name, after in (("waiting", cooldown_s), ("timed_out", timeout_s + 1)):
        at = F.col("s") + after * second
        parts.append(told(name, at, F.col("bad") & F.when(F.col("next").isNull(), at <= F.col("end")).otherwise(at < F.col("next")), F.lit(None).cast("long")))
    return r.select("node", F.explode(F.array_compact(F.array(*parts))).alias("e")).select("node", "e.*")


def drain_keyed(stream: DataFrame, name: str) -> DataFrame:
    """All rows that the stream gives for what its source has now, through the file sink."""
    from fleetlake.streaming.folds import drain

    with keyed_state(stream.sparkSession):
        return drain(stream, name)


def arriving(rows: DataFrame, order: str, n: int, name: str) -> str:
    """Writes a finished table as ``n`` slices by ``order``, one after the other, for streams that take one file a trigger."""
    path = shared_path(rows.sparkSession, name)
    ends = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        part = rows if low is None else rows.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part.coalesce(1).write.mode("append").parquet(path)
    return path
