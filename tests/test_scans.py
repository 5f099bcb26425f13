"""Running values over ranges against plain loops, with keys that hold most rows."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlake.operators import scans


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def reference(rows):
    out, state = {}, {}
    for pool, at, x, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        total, n, last = state.get(pool, (0, 0, None))
        state[pool] = total + (x or 0), n + 1, last if b is None else b
        out[(pool, at)] = state[pool]
    return out


def test_running_values_equal_a_loop_whatever_the_keys_hold(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, 7, 7, 7, 1, 2, None]), i, rng.choice([None, 1, -3, 10]), rng.choice([None, None, None, i])) for i in range(3000)]
    df = spark.createDataFrame(rows, "pool int, at long, x long, b long").repartition(5)
    out = scans.running(df, ["pool"], ["at"], sums={"total": "x"}, lasts={"last": "b"}, rank="k")
    assert out.columns == ["pool", "at", "x", "b", "total", "last", "k"]
    assert {(r.pool, r.at): (r.total, r.k, r["last"]) for r in out.collect()} == reference(rows)


def test_running_values_over_all_rows_and_over_none(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = scans.running(df, [], ["v"], rank="k", sums={"s": "v"}).collect()
    assert {(r.v, r.k, r.s) for r in got} == {(v, v + 1, v * (v + 1) // 2) for v in range(1000)}
    assert scans.running(df.where("false"), [], ["v"], rank="k").count() == 0


def test_one_key_spreads_over_many_tasks(spark):
    df = spark.range(0, 4000, 1, 4).select(F.lit("one").alias("pool"), "id", F.lit(1).alias("x"))
    out = scans.running(df, ["pool"], ["id"], sums={"total": "x"})
    assert out.where("total <> id + 1").isEmpty()
    stored = spark.read.parquet(*{f.rpartition("/")[0] for f in out.inputFiles()})
    assert stored.groupBy("__part").count().where("count < 2000").count() == 4
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastExchange" in plan and "SinglePartition" not in plan


def test_one_pool_day_or_prefix_may_hold_all_rows(spark):
    from fleetlake.operators import fleet

    n = 3000
    rows = spark.range(0, n, 1, 3)
    reports = rows.select(F.lit(1).alias("pool"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    controls = rows.where("id % 500 = 7").select(F.lit(1).alias("pool"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.when(F.col("id") != 507, F.col("id")).alias("budget"))
    got = {r.seq: r.budget for r in fleet.controls_as_of(reports, controls).collect()}
    assert got == {i: None if i < 7 or 507 <= i < 1007 else (i - 7) // 500 * 500 + 7 for i in range(n)}
    known = spark.createDataFrame([("k", "n41"), ("l", "x9")], "key string, id string")
    new = rows.select(F.format_string("%06d", F.col("id") * 7919 % n).alias("key"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    assert {(r.key, r.id) for r in fleet.allocate_ids(new, known).collect()} == {(f"{i * 7919 % n:06d}", f"n{42 + i}") for i in range(n)}
    found = rows.select(F.format_string("host-%05d", "id").alias("hostname"), F.format_string("a%d", "id").alias("address"))
    placed = {r.hostname: r.id for r in fleet.place_discovered(found, spark.createDataFrame([("a5", 77)], "address string, node long")).collect()}
    assert placed["host-00005"] == "n77" and placed["host-00000"] == "n2" and placed["host-02999"] == f"n{n}"
