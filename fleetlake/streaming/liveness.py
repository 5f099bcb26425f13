"""When machines fall silent and come back: a stream with timers, and the same over a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import TimestampType

OUT = "node {}, at_ms long, online boolean"


def _usable(reports: DataFrame) -> DataFrame:
    """(node, ts, ms): rows with both; a time without zone counts as UTC."""
    ts = F.col("ts") if reports.schema["ts"].dataType == TimestampType() else F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))")
    return reports.where("node is not null and ts is not null").select("node", ts.alias("ts")).withColumn("ms", F.unix_millis("ts"))


def stream_liveness(reports: DataFrame, threshold_s: int = 30, delay_s: int = 0) -> DataFrame:
    """(node, at_ms, online): online at a machine's first report and at each after a silence, offline ``threshold_s`` after the last.

    ``reports`` has node and ts. Offline is told as soon as the watermark, which
    lags the newest report of all by ``delay_s``, has passed the time; or with the
    next report of that machine. Reports older than the machine's last in an
    earlier trigger, or not newer than the watermark, are ignored; so are rows
    without node or ts.
    """
    silence = threshold_s * 1000
    kind = reports.schema["node"].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, online = state.get if state.exists else (None, False)
        at: list[int] = []
        up: list[bool] = []
        if not state.hasTimedOut:
            ms = np.sort(np.concatenate([p["ms"].to_numpy(np.int64) for p in parts]))
            ms = ms if last is None else ms[ms >= last]
            if len(ms):
                before = np.concatenate([[ms[0] if last is None else last], ms[:-1]])
                returned = np.flatnonzero(ms - before >= silence)
                went = [int(before[i]) + silence for i in returned if i or online]
                came = [int(ms[i]) for i in returned]
                if last is None:
                    came.insert(0, int(ms[0]))
                at, up = went + came, [False] * len(went) + [True] * len(came)
                online = online or bool(came)
                last = int(ms[-1])
        if online and last + silence <= state.getCurrentWatermarkMs():
            at, up, online = [*at, last + silence], [*up, False], False
        if last is not None:
            state.update((last, online))
            if online:
                state.setTimeoutTimestamp(last + silence - 1)
        yield pd.DataFrame({"node": [key[0]] * len(at), "at_ms": np.array(at, np.int64), "online": np.array(up, bool)})

    keyed = _usable(reports).withWatermark("ts", f"{delay_s} seconds").groupBy("node")
    return keyed.applyInPandasWithState(run, OUT.format(kind), "last long, online boolean", "append", GroupStateTimeout.EventTimeTimeout)


def liveness_changes(reports: DataFrame, threshold_s: int = 30, delay_s: int = 0) -> DataFrame:
    """The rows of ``stream_liveness`` for a finished table."""
    silence = threshold_s * 1000
    usable = _usable(reports).select("node", "ms")
    end = usable.agg((F.max("ms") - 1000 * delay_s).alias("end"))  # one row
    w = Window.partitionBy("node").orderBy("ms")
    r = usable.withColumn("prev", F.lag("ms").over(w)).withColumn("next", F.lead("ms").over(w)).crossJoin(F.broadcast(end))
    came = F.when(F.col("prev").isNull() | (F.col("ms") - F.col("prev") >= silence), F.struct(F.col("ms").alias("at_ms"), F.lit(True).alias("online")))
    silent = F.when(F.col("next").isNull(), F.col("ms") + silence <= F.col("end")).otherwise(F.col("next") - F.col("ms") >= silence)
    went = F.when(silent, F.struct((F.col("ms") + silence).alias("at_ms"), F.lit(False).alias("online")))
    return r.select("node", F.explode(F.array_compact(F.array(came, went))).alias("e")).select("node", "e.*")
