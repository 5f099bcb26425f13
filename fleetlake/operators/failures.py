"""Failure streaks, cooldown and stale nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, COOLDOWN_S, TIMEOUT_S = 3, 30, 300


def failure_streaks(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Adds ``streak`` (failures since the last success) and ``offline`` to (node, ts, seq, verb)."""
    w = Window.partitionBy("node").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = (F.col("verb") == "failure").cast("int")
    island = events.withColumn("bad", bad).withColumn("island", F.sum(1 - F.col("bad")).over(w))
    inside = Window.partitionBy("node", "island").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return island.withColumn("streak", F.sum("bad").over(inside)).select("node", "ts", "seq", "verb", "streak", ((F.col("streak") >= limit) & (F.col("bad") == 1)).alias("offline"))


def cooldown(streaks: DataFrame, now: str) -> DataFrame:
    """By node: is its open streak's last failure under 30 s old, or over 300 s?"""
    last = streaks.groupBy("node").agg(F.max_by(F.struct("ts", "streak"), F.struct("ts", "seq")).alias("r"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("r.ts")
    open_ = F.col("r.streak") > 0
    return last.select("node", F.col("r.streak").alias("streak"), (open_ & (age < COOLDOWN_S)).alias("cooling"), (open_ & (age > TIMEOUT_S)).alias("timed_out"))


def failures_from_events(log: DataFrame) -> DataFrame:
    """Maps change events to failures and successes; ``listed`` tells whether a failure may be reported."""
    off = (F.col("kind") == "StateChanged") & F.col("detail").endswith(">Offline")
    verb = F.when((F.col("kind") == "Left") | off, "failure").when(F.col("kind") == "Joined", "success")
    return log.withColumn("verb", verb).where("verb is not null").select("node", "seq", "verb", (F.col("kind") == "Left").alias("listed"))


def stale_nodes(state: DataFrame) -> DataFrame:
    return state.where("not alive").select("node", "silent_s")


def cleanup(failures: DataFrame, state: DataFrame) -> DataFrame:
    """Tracking of registered nodes only."""
    return failures.join(state.select("node"), "node", "left_semi")


def offline_from_events(log: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(node, seq) of departures that make a node's open streak reach ``limit``; other failures count and are never listed."""
    told = failures_from_events(log).withColumn("ts", F.col("seq"))
    streaks = failure_streaks(told, limit).where("offline").select("node", "seq")
    return streaks.join(told.where("listed").select("node", "seq"), ["node", "seq"], "left_semi")
