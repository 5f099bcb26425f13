"""Streams with state and timers: equal to the batch forms over many triggers, late reports, tables of changed keys."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import failures, fleet
from fleetlake.streaming import state

KIND = "node int, seq long, ts timestamp, verb string, load_avg double, agent_version string, power_watts int"
FIELDS = ["verb", "load_avg", "agent_version", "power_watts"]


@pytest.fixture(scope="module")
def reports(spark):
    rng, at, rows = random.Random(4), 1_700_000_000.0, []
    for seq in range(500):
        at += rng.choice([0, 0.25, 1, 7, 29.75, 40, 150])
        node = rng.choice([1, 1, 1, 1, 2, 3, 4]) if seq < 450 else rng.choice([1, 2])
        rows.append((node, seq, at, rng.choice(["failure", "failure", "heartbeat", "register"]), rng.choice([0.5, 3.0]), rng.choice(["v1", "v1", "v2"]), rng.randrange(90)))
    return spark.createDataFrame([(n, s, None, *rest) for n, s, _, *rest in rows], KIND).drop("ts").join(spark.createDataFrame([(s, t) for _, s, t, *_ in rows], "seq long, t double"), "seq").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t")


def stream_of(spark, reports, n, name):
    path = state.arriving(reports, "seq", n, name)
    return spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def one_core(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df, *columns):
    return sorted((tuple(str(x) for x in r) for r in df.select(*columns).collect()))


def test_state_and_events_over_many_triggers_equal_the_batch_forms(spark, reports, one_core, tmp_path):
    stream = state.stream_state(stream_of(spark, reports, 5, "reports"), FIELDS, ["power_watts"])
    table, events = state.keep_state(stream, str(tmp_path / "out"), merge_every=2)
    assert rows(events, "node", "seq", "kind", "detail") == rows(fleet.change_events(reports, ["power_watts"]), "node", "seq", "kind", "detail")
    last = fleet.derive_status(fleet.latest_state(reports).withColumn("us", F.unix_micros("last_seen")))
    assert rows(table.rows(), "node", "us", *FIELDS, "detail") == rows(last, "node", "us", *FIELDS, "status")
    assert table.versions() == [1, 2]  # merged after the second and the fourth trigger


def test_a_trigger_writes_changed_keys_only_and_late_reports_are_ignored(spark, one_core, tmp_path):
    report = lambda node, seq, at, verb="heartbeat": (node, seq, verb, 0.5, "v1", seq * 10, at)
    kind = "node int, seq long, verb string, load_avg double, agent_version string, power_watts int, ts timestamp"
    for part in ([report(1, 1, 100), report(2, 2, 101)], [report(1, 3, 110), report(2, 0, 50), report(None, 9, 120)]):
        df = spark.createDataFrame([(*r[:-1], None) for r in part], kind).drop("ts").join(spark.createDataFrame([(r[1], r[-1]) for r in part], "seq long, t long"), "seq")
        df.withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table, events = state.keep_state(state.stream_state(source, FIELDS), str(tmp_path / "out"))
    assert rows(table.rows(), "node", "seq", "power_watts") == [("1", "3", "30"), ("2", "2", "20")]
    assert rows(spark.read.parquet(str(tmp_path / "out/state/changes/000000000001")), "node") == [("1",)]
    assert rows(events, "node", "seq", "kind") == [("1", "1", "Joined"), ("1", "3", "Updated"), ("2", "2", "Joined")]
    table.add(table.rows().where("node = 1").withColumn("power_watts", F.lit(7)), 1)  # a trigger that runs again replaces its rows
    assert rows(table.rows(), "node", "power_watts") == [("1", "7"), ("2", "20")]
    table.merge()
    assert rows(table.rows(), "node", "power_watts") == [("1", "7"), ("2", "20")] and table.versions() == [1] and not table._changes()


def test_cooldown_by_timers_equals_the_rule_at_each_time(spark, reports, one_core, tmp_path):
    out = state.drain_keyed(state.stream_failures(stream_of(spark, reports, 4, "failing")), "failing-out").cache()
    streaks = failures.failure_streaks(reports)
    assert rows(out.where("change is null"), "node", "seq", "streak", "offline") == rows(streaks, "node", "seq", "streak", "offline")
    changes = out.where("change is not null")
    assert rows(changes, "node", "seq", "at_us", "change") == rows(state.failure_changes(reports), "node", "seq", "at_us", "change")
    assert {"cooling", "waiting", "timed_out", "clear"} == {r.change for r in changes.select("change").distinct().collect()}
    end = reports.agg(F.unix_seconds(F.max("ts"))).first()[0]
    for now in (end, end - 31, end - 400, end - 1501, end - 4000):
        then = changes.where(F.col("at_us") <= now * 1_000_000).groupBy("node").agg(F.max_by("change", F.struct("at_us", F.coalesce("seq", F.lit(-1)))).alias("c"))
        rule = failures.cooldown(failures.failure_streaks(reports.where(F.unix_micros("ts") <= now * 1_000_000)), str(spark.range(1).select(F.timestamp_seconds(F.lit(now)).cast("string")).first()[0]))
        got = {r.node: (r.c == "cooling", r.c == "timed_out") for r in then.collect()}
        assert {r.node: (r.cooling, r.timed_out) for r in rule.collect() if r.streak} == {n: got[n] for n in got if any(got[n]) or n in {r.node for r in rule.collect() if r.streak}}
    out.unpersist()


class Store:
    """A handle and a value state that count the calls, each of which is a turn over a socket."""

    def __init__(self):
        self.value, self.calls, self.timers = None, [], set()

    def getValueState(self, name, schema):
        return self

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return self.value
            if name == "exists":
                return self.value is not None
            if name == "update":
                self.value = args[0]
            if name == "listTimers":
                return iter(sorted(self.timers))
            if name in ("registerTimer", "deleteTimer"):
                (self.timers.add if name == "registerTimer" else self.timers.remove)(args[0])

        return call


def test_a_key_and_trigger_takes_few_turns_to_the_store_and_no_frames():
    """Before, rows came and went as a DataFrame a key, ``exists`` was a turn of its own and timers were listed."""
    from pyspark.sql import Row

    store, node = Store(), state.NodeState(["verb", "load_avg", "agent_version"], None, [])
    node.init(store)
    reports = [Row(node=1, us=us, seq=us, verb="heartbeat", load_avg=0.5, agent_version="v1") for us in (3, 1, 2)]
    assert [(r.kind, r.seq) for r in node.handleInputRows((1,), iter(reports), None)] == [("Joined", 1), ("Updated", 2), ("Updated", 3), ("State", 3)]
    assert list(node.handleInputRows((1,), iter(reports), None)) == [] and store.calls == ["get", "update", "get"]
    store, failing = Store(), state.Failures(3, 10, 20)
    failing.init(store)
    report = lambda s, verb: Row(node=1, ts=None, us=s * 1_000_000, seq=s, verb=verb)
    out = list(failing.handleInputRows((1,), iter([report(2, "failure"), report(1, "failure")]), None))
    assert [(r.seq, r.streak) for r in out if r.change is None] == [(1, 1), (2, 2)] and store.timers == {11_999}
    list(failing.handleInputRows((1,), iter([report(3, "failure")]), None))
    assert store.timers == {12_999}
    list(failing.handleInputRows((1,), iter([report(4, "heartbeat")]), None))
    assert store.timers == set() and "listTimers" not in store.calls and "exists" not in store.calls
