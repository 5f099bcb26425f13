"""Queries of stored files and of state that is kept over streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake import views as v
from fleetlake.plans import registry as r
from fleetlake.plans.registry import query
from fleetlake.sources import shard_files
from fleetlake.storage import shared_path
from fleetlake.streaming import state

VOLUME = 1 << 20
_VOLUMES = f"""WITH i AS (SELECT coalesce(source, '') AS grp, doc_id AS item, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS bytes FROM documents),
r AS (SELECT *, sum(bytes) OVER w - bytes AS pos, sum(bytes + 64) OVER w - bytes - 64 AS spent FROM i WINDOW w AS (PARTITION BY grp ORDER BY item)),
f AS (SELECT grp, CAST(spent // {VOLUME} AS BIGINT) AS volume, item, t, bytes, pos FROM r)"""


def _written(spark, d) -> str:
    """The texts of all documents as shard files, a group for each source."""
    path = shared_path(spark, "shards")
    docs = v.table(spark, d, "documents")
    shard_files.write_shards(docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("item"), F.col("lang").alias("name"), F.encode("text", "UTF-8").alias("payload")), path, VOLUME)
    return path


@query("s5_write_shards", _VOLUMES + " SELECT grp, volume, item, CAST(pos - min(pos) OVER (PARTITION BY grp, volume) AS BIGINT) AS start, bytes, sha256(t) AS sha256 FROM f")
def _(spark, d):
    """Files are written, their tables scanned and every tensor read from its place."""
    tensors, _ = shard_files.read_shards(spark, _written(spark, d))
    whole = shard_files.read_spans(tensors.withColumn("offset", F.lit(0)).withColumn("length", F.col("bytes"))).select("path", "item", F.sha2("content", 256).alias("sha256"))
    return tensors.join(whole, ["path", "item"]).select("grp", "volume", "item", "start", "bytes", "sha256")


@query("s4_shard_census", _VOLUMES + " SELECT grp, count(DISTINCT volume) AS files, count(*) AS tensors, CAST(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY grp")
def _(spark, d):
    """Counted from headers and tables; no tensor is read."""
    tensors, _ = shard_files.read_shards(spark, _written(spark, d))
    return tensors.groupBy("grp").agg(F.countDistinct("path").alias("files"), F.count("*").alias("tensors"), F.sum("bytes").alias("bytes"))


FIELDS = ["verb", "power_watts", "load_avg", "agent_version"]


def _arriving(spark, d):
    """The reports as a stream of five slices in order of time, one a trigger."""
    rows = state.timed(v.telemetry(spark, d))
    path = state.arriving(rows, "us", 5, "reports")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("x1_stream_state", r.ORACLES["r3_latest_state"])
def _(spark, d):
    """The table of current states after all triggers, each of which wrote the machines that reported."""
    table, _ = state.keep_state(state.stream_state(_arriving(spark, d), FIELDS), shared_path(spark, "stream-state"), merge_every=3)
    seen = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(us / 1e6 as decimal(18, 6)))")
    return table.rows().select("node", seen.alias("last_seen"), "verb", "power_watts", F.round("load_avg", 6).alias("load_avg"), "agent_version")


@query("x1_stream_events", r.ORACLES["r6_change_events"])
def _(spark, d):
    """The change events of all triggers."""
    return state.keep_state(state.stream_state(_arriving(spark, d), FIELDS), shared_path(spark, "stream-state"))[1]


@query("x3_stream_cooldown", """WITH t AS (SELECT user_id AS node, event_id AS seq, epoch_us(ts) AS us, event_type = 'error' AS bad, epoch_us(ts) // 1000000 * 1000000 AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL),
o AS (SELECT *, coalesce(lag(bad) OVER w, false) AS was, lag(s) OVER w AS prev, lead(us) OVER w AS next, max(us) OVER () - 60000000 AS fin FROM t WINDOW w AS (PARTITION BY node ORDER BY us, seq)),
later AS (SELECT node, s + step AS at_us, change, next, fin FROM o, (VALUES (21600000000, 'waiting'), (86401000000, 'timed_out')) x(step, change) WHERE bad)
SELECT node, seq, us AS at_us, 'cooling' AS change FROM o WHERE bad AND (NOT was OR us > prev + 21600000000)
UNION ALL SELECT node, seq, us, 'clear' FROM o WHERE NOT bad AND was
UNION ALL SELECT node, NULL, at_us, change FROM later WHERE at_us < next OR (next IS NULL AND at_us <= fin)""")
def _(spark, d):
    """Machines that cool down, wait and time out, told by timers."""
    out = state.drain_keyed(state.stream_failures(_arriving(spark, d), cooldown_s=21_600, timeout_s=86_400, delay_s=60), "cooldown")
    return out.where("change is not null").select("node", "seq", "at_us", "change")
