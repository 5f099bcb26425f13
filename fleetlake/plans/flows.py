"""Queries of sequential rules, identities, binary sources and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlake import storage
from fleetlake import views as v
from fleetlake.functions import bpe, encodings
from fleetlake.operators import delta, energy, fleet, folds, identity, planning, vectors
from fleetlake.plans import artifacts as a
from fleetlake.plans import registry as r
from fleetlake.plans.registry import query
from fleetlake.sources import frames, shards
from fleetlake.streaming import folds as streams
from fleetlake.streaming import liveness

_RECURSIVE = ("WITH ", "WITH RECURSIVE ")


@query("p5_draw_balance", v.sql("telemetry").replace(*_RECURSIVE) + """, o AS (SELECT node, seq, CASE WHEN seq % 2 = 0 THEN power_watts ELSE -power_watts END AS w, row_number() OVER (PARTITION BY node ORDER BY ts, seq) AS k FROM telemetry),
f(node, k, seq, draw) AS (SELECT node, k, seq, greatest(0, w) FROM o WHERE k = 1 UNION ALL SELECT o.node, o.k, o.seq, greatest(0, f.draw + o.w) FROM f JOIN o ON o.node = f.node AND o.k = f.k + 1)
SELECT node, seq, draw, greatest(0, 100 - draw) AS headroom FROM f""")
def _(spark, d):
    moves = v.telemetry(spark, d).select("node", "ts", "seq", F.when(F.col("seq") % 2 == 0, F.col("power_watts")).otherwise(-F.col("power_watts")).alias("watts"))
    return energy.draw_balance(moves, 100).select("node", "seq", "draw", "headroom")


_ADMIT = """SELECT pool, k, task, CASE WHEN watts <= {0} THEN watts ELSE 0 END, watts <= {0} FROM {1} WHERE k = 1
  UNION ALL SELECT o.pool, o.k, o.task, f.used + CASE WHEN f.used + o.watts <= {0} THEN o.watts ELSE 0 END, f.used + o.watts <= {0} FROM {2} f JOIN {1} o ON o.pool = f.pool AND o.k = f.k + 1"""


@query("p9_reoffer", v.sql("tasks").replace(*_RECURSIVE) + f""", o1 AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY enqueued, task) AS k FROM tasks),
f1(pool, k, task, used, admitted) AS ({_ADMIT.format(300, "o1", "f1")}),
o2 AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY priority DESC, enqueued, task) AS k FROM tasks WHERE task IN (SELECT task FROM f1 WHERE NOT admitted)),
f2(pool, k, task, used, admitted) AS ({_ADMIT.format(200, "o2", "f2")}) SELECT pool, task, admitted FROM f2""")
def _(spark, d):
    tasks = v.tasks(spark, d)
    waiting = planning.admit(tasks, 300).where("not admitted").select("task")
    return planning.reoffer(tasks.join(waiting, "task", "left_semi"), 200)


def _calls(events):
    return events.select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").cast("double").alias("at"), F.floor("value").cast("double").alias("bytes"), (F.col("event_id") % 13 == 0).alias("paused"))


_RATE = """WITH RECURSIVE o AS (SELECT user_id AS node, event_id AS seq, CAST(floor(epoch(ts)) AS DOUBLE) AS clock, floor(value) AS bytes, event_id % 13 = 0 AS paused, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events),
f(node, k, seq, tokens, clock, allowed) AS (
  SELECT node, k, seq, CASE WHEN NOT paused AND 100 >= bytes THEN 100 - bytes ELSE 100.0::DOUBLE END, CASE WHEN paused THEN NULL ELSE clock END, NOT paused AND 100 >= bytes FROM o WHERE k = 1
  UNION ALL SELECT node, k, seq, CASE WHEN NOT paused AND t >= bytes THEN t - bytes ELSE t END, CASE WHEN paused THEN was ELSE clock END, NOT paused AND t >= bytes FROM (
    SELECT o.*, f.clock AS was, CASE WHEN o.paused THEN f.tokens ELSE least(100.0::DOUBLE, f.tokens + (o.clock - coalesce(f.clock, o.clock)) * 0.001::DOUBLE) END AS t FROM f JOIN o ON o.node = f.node AND o.k = f.k + 1))
SELECT node, seq, allowed, round(tokens, 6) AS tokens FROM f"""
BUCKET = folds.TokenBucket(100, 0.001)


@query("p12_rate_limit", _RATE)
def _(spark, d):
    return folds.ordered_fold(_calls(v.table(spark, d, "events")), "node", ["at", "seq"], BUCKET).withColumn("tokens", F.round("tokens", 6))


@query("x4_stream_rate_limit", _RATE)
def _(spark, d):
    calls = _calls(streams.open_table(spark, f"{d}/events.parquet"))
    return streams.drain(streams.stream_fold(calls, "node", ["at", "seq"], BUCKET), "rate").withColumn("tokens", F.round("tokens", 6))


@query("x3_stream_failures", r.ORACLES["f1_failure_streaks"])
def _(spark, d):
    reports = v.telemetry_of(streams.open_table(spark, f"{d}/events.parquet")).select("node", "ts", "seq", "verb")
    return streams.drain(streams.stream_fold(reports, "node", ["ts", "seq"], folds.Streak()), "failures")


def _positions(events):
    """A frame's position in a run of its stream, wrong for each 11th event; each 29th resets."""
    k = F.col("event_id")
    return events.select(F.col("user_id").alias("stream"), k.alias("ord"), F.when(k % 29 == 0, 0).otherwise(k % 3).cast("long").alias("pos"), (k % 29 == 0).alias("reset"))


_STRICT = """WITH RECURSIVE o AS (SELECT user_id AS stream, event_id AS ord, CASE WHEN event_id % 29 = 0 THEN 0 ELSE event_id % 3 END AS pos, event_id % 29 = 0 AS reset, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f(stream, k, ord, expected, accepted, reason) AS (
  SELECT stream, k, ord, CASE WHEN pos = 0 THEN 1 ELSE 0 END, pos = 0, CASE WHEN pos = 0 THEN '' ELSE 'out-of-order: got ' || pos || ', expects 0' END FROM o WHERE k = 1
  UNION ALL SELECT stream, k, ord, CASE WHEN pos = e THEN e + 1 ELSE e END, pos = e, CASE WHEN pos = e THEN '' ELSE 'out-of-order: got ' || pos || ', expects ' || e END FROM (
    SELECT o.*, CASE WHEN o.reset THEN 0 ELSE f.expected END AS e FROM f JOIN o ON o.stream = f.stream AND o.k = f.k + 1))
SELECT stream, ord, accepted, reason FROM f"""


@query("x5_stream_strict_order", _STRICT)
def _(spark, d):
    positions = _positions(streams.open_table(spark, f"{d}/events.parquet"))
    return streams.drain(streams.stream_fold(positions, "stream", ["ord"], folds.StrictOrder()), "order")


def _memory_input(embeddings):
    x = lambda lo: F.transform(F.slice("embedding", lo, 8), lambda c: c.cast("double"))
    return embeddings.select(F.col("label").alias("seq"), F.col("vec_id").alias("pos"), x(1).alias("q"), x(9).alias("k"), x(17).alias("v"), F.lit(-0.1).alias("gate"), F.lit(0.5).alias("beta"))


@query("v9_delta_memory")
def _(spark, d):
    return folds.ordered_fold(_memory_input(v.table(spark, d, "embeddings")), "seq", ["pos"], folds.DeltaMemory(8))


@query("x6_stream_memory")
def _(spark, d):
    rows = _memory_input(streams.open_table(spark, f"{d}/embeddings.parquet"))
    return streams.drain(streams.stream_fold(rows, "seq", ["pos"], folds.DeltaMemory(8)), "memory")


@query("t4_stream_decode", "SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE text <> ''")
def _(spark, d):
    """Texts cut into pieces of five bytes, across characters, and put together again."""
    t = v.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.encode("text", "UTF-8").alias("b")).where(F.octet_length("b") > 0)
    cut = t.select("id", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length("b") - 1) / 5))).alias("pos"))
    pieces = cut.select("id", "pos", F.substring("b", (F.col("pos") * 5 + 1).cast("int"), F.lit(5)).alias("piece"))
    shown = folds.ordered_fold(pieces, "id", ["pos"], folds.Utf8Decoder())
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(2**62)).alias("pos"), "text")))
    return shown.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


_SIGHTED = """WITH RECURSIVE s AS (SELECT event_id AS seq, ts, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'b' || user_id END AS node_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE user_id // 2 || '.' || event_id % 5 END AS ip, 'h' || user_id // 6 AS hostname FROM events),
q AS (SELECT *, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY hostname ORDER BY ts, seq))) >= 43200 AS quiet FROM s),
h AS (SELECT *, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER (PARTITION BY hostname ORDER BY ts, seq) AS run FROM q),
m AS (SELECT *, CASE WHEN node_id <> '' THEN 'n' || node_id ELSE 'h' || hostname END AS machine, node_id <> '' AND row_number() OVER (PARTITION BY node_id ORDER BY ts, seq) > 1 AS known FROM s),
st AS (SELECT *, CASE WHEN ip <> lag(ip) OVER (PARTITION BY machine ORDER BY ts, seq) THEN {'t': ts, 's': seq} END AS start FROM m WHERE ip <> ''),
lf AS (SELECT *, min(start) OVER (PARTITION BY machine ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS gone FROM st),
fr AS (SELECT *, CASE WHEN coalesce(lag(gone) OVER (PARTITION BY ip ORDER BY ts, seq) <= {'t': ts, 's': seq}, false) OR coalesce(known AND lag(node_id) OVER (PARTITION BY ip ORDER BY ts, seq) <> node_id, false) THEN 1 ELSE 0 END AS fresh FROM lf),
ad AS (SELECT seq, sum(fresh) OVER (PARTITION BY ip ORDER BY ts, seq) || ':' || ip AS holding FROM fr),
k AS (SELECT seq, 'n' || node_id AS key FROM h WHERE node_id <> '' UNION SELECT seq, 'a' || holding FROM ad UNION SELECT seq, 'h' || run || ':' || hostname FROM h),
e AS (SELECT DISTINCT x.key AS a, y.key AS b FROM k x JOIN k y USING (seq) WHERE x.key <> y.key),
slot(key, slot) USING KEY (key) AS (
  SELECT key, min(seq) FROM k GROUP BY key
  UNION SELECT e.b, min(x.slot) FROM slot x JOIN e ON e.a = x.key JOIN recurring.slot y ON y.key = e.b WHERE x.slot < y.slot GROUP BY e.b)
SELECT seq, min(slot) AS slot FROM k JOIN slot USING (key) GROUP BY seq"""


@query("r1_resolve_identity", _SIGHTED)
def _(spark, d):
    k, user = F.col("event_id"), F.col("user_id")
    whole = lambda n: F.floor(user / n).cast("string")
    s = v.table(spark, d, "events").select(
        k.alias("seq"), "ts", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("b"), user.cast("string"))).alias("node_id"),
        F.when(k % 4 == 0, "").otherwise(F.concat_ws(".", whole(2), (k % 5).cast("string"))).alias("ip"), F.concat(F.lit("h"), whole(6)).alias("hostname"),
    )
    return identity.resolve_identity(s, 43200)


@query("e5_transfer_bill", f"SELECT id, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS ranges FROM ({r.ORACLES['d5_plan_diff']}) GROUP BY id")
def _(spark, d):
    return energy.transfer_bill(delta.plan_diff(a._local(spark, d), a._remote(spark, d), a.SIZE))


@query("e5_reconciliation_bill", r._PRED + " SELECT site, CAST(n_planned // 8 + 8 * n_drifted AS BIGINT) AS bill FROM s")
def _(spark, d):
    return energy.reconciliation_bill(r._reconciled(spark, d)).select("site", "bill")


@query("e6_resolve_picks", """WITH s AS (SELECT n_regionkey AS set_id, list(n_name ORDER BY n_nationkey) AS options FROM nation GROUP BY 1), p AS (SELECT c_custkey AS id, c_custkey % 6 AS set_id, c_custkey % 4 + c_custkey % 3 AS pick, c_custkey % 7 = 0 AS bad FROM customer)
SELECT id, CASE WHEN bad OR options IS NULL THEN 'full payload' WHEN pick < len(options) THEN 'pick' ELSE 'out of range' END AS status, CASE WHEN bad OR options IS NULL THEN 'p' || id WHEN pick < len(options) THEN options[pick + 1] END AS value FROM p LEFT JOIN s USING (set_id)""")
def _(spark, d):
    n = v.table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("set_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    sets = n.select("set_id", F.transform("l", lambda x: x["n_name"]).alias("options"))
    k = F.col("c_custkey")
    picks = v.table(spark, d, "customer").select(k.alias("id"), (k % 6).cast("long").alias("set_id"), (k % 4 + k % 3).alias("pick"), F.concat(F.lit("p"), k.cast("string")).alias("payload"))
    hashes = sets.select("set_id", energy.set_hash(F.col("options")).alias("h"))
    sent = picks.join(hashes, "set_id", "left").withColumn("set_hash", F.when(F.col("id") % 7 != 0, F.col("h")).otherwise("old")).drop("h")
    return energy.resolve_picks(sent, sets)


@query("d6_rebuild", f"WITH {a._BOTH} SELECT id, CASE WHEN l = r OR id % 19 <> 0 THEN 'published' ELSE 'epoch mismatch' END AS status, CASE WHEN l = r OR id % 19 <> 0 THEN sha256(unhex(r)) END AS epoch FROM l")
def _(spark, d):
    local, remote = a._local(spark, d), a._remote(spark, d)
    size = lambda df, name: df.select("id", F.octet_length("data").cast("long").alias(name))
    changed = delta.plan_diff(local, remote, a.SIZE).select("id", (F.col("idx") * a.SIZE).alias("start"), "length")
    tail = delta.plan_pull(size(local, "local_len").join(size(remote, "remote_len"), "id"), a.SIZE).where("status = 'ok'").select("id", "start", "length")
    pulled = changed.unionByName(tail).where("id % 19 <> 0").join(remote, "id").select("id", "start", F.expr("substring(data, cast(start + 1 as int), cast(length as int))").alias("bytes"))
    return delta.rebuild(local, pulled, remote.select("id", F.sha2("data", 256).alias("expected"))).drop("data")


@query("d6_rebuild_pieces", f"WITH {a._BOTH} SELECT id, CASE WHEN l = r OR id % 19 <> 0 THEN 'published' ELSE 'epoch mismatch' END AS status, CASE WHEN l = r OR id % 19 <> 0 THEN sha256(unhex(r)) END AS epoch, CASE WHEN l = r OR id % 19 <> 0 THEN CAST(length(r) // 2 AS BIGINT) ELSE 0 END AS bytes FROM l")
def _(spark, d):
    """The same files in pieces, which pass through ordered tasks; the bytes that were published are counted."""
    local, remote = a._local(spark, d), a._remote(spark, d)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length("data").cast("long") - 1, F.lit(0)), F.lit(1000).cast("long"))
    pieces = local.select("id", "data", F.explode(starts).alias("start")).select("id", "start", F.expr("substring(data, cast(start + 1 as int), 1000)").alias("bytes"))
    plan = delta.plan_sync(local, remote, a.SIZE).where("status = 'ok' and id % 19 <> 0")
    pulled = plan.join(remote, "id").select("id", "start", F.expr("substring(data, cast(start + 1 as int), cast(length as int))").alias("bytes"))
    status, published = delta.rebuild_pieces(pieces, pulled, remote.select("id", F.sha2("data", 256).alias("expected")))
    size = published.groupBy("id").agg(F.sum(F.octet_length("bytes")).alias("bytes"))
    return status.join(size, "id", "left").select("id", "status", "epoch", F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query("v3_rotate_positions", a._E + """, t AS (SELECT e.*, id % 50 * pow(10000.0, -2.0 * (d % 16) / 32) AS an FROM e)
SELECT t.id, t.d, round(CASE WHEN t.d < 16 THEN t.v * cos(t.an) - o.v * sin(t.an) WHEN t.d < 32 THEN o.v * sin(t.an) + t.v * cos(t.an) ELSE t.v END, 6) + 0.0 AS v
FROM t LEFT JOIN e o ON o.id = t.id AND o.d = CASE WHEN t.d < 16 THEN t.d + 16 WHEN t.d < 32 THEN t.d - 16 END""")
def _(spark, d):
    return a._cells(vectors.rotate_positions(v.vectors(spark, d).select("id", (F.col("id") % 50).alias("pos"), "x"), 32))


_SHAPE = a._E + """, w AS (SELECT id, seq, lag(id) OVER (PARTITION BY seq ORDER BY id) AS pid FROM vectors), c AS (SELECT w.seq, w.id, e.d, e.v, e.v - p.v AS dv, p.v AS pv FROM w JOIN e ON e.id = w.id JOIN e p ON p.id = w.pid AND p.d = e.d),
m AS (SELECT seq, id, sum(v * pv) / (sqrt(sum(v * v)) * sqrt(sum(pv * pv))) AS cosine, sqrt(sum(dv * dv)) / sqrt(sum(v * v)) AS step, min(v) AS l1, max(v) AS h1, min(dv) AS l2, max(dv) AS h2, count(*) AS n FROM c GROUP BY ALL),
b1 AS (SELECT seq, id, n, floor((v - l1) / (h1 - l1) * 255) AS b, count(*) AS k FROM c JOIN m USING (seq, id) GROUP BY ALL), b2 AS (SELECT seq, id, n, floor((dv - l2) / (h2 - l2) * 255) AS b, count(*) AS k FROM c JOIN m USING (seq, id) GROUP BY ALL),
e1 AS (SELECT seq, id, -sum(k / n * log2(k / n)) AS s1 FROM b1 GROUP BY ALL), e2 AS (SELECT seq, id, -sum(k / n * log2(k / n)) AS s2 FROM b2 GROUP BY ALL)
SELECT seq, id AS pos, round(cosine, 5) AS cosine, round(step, 5) AS step, round(s1, 5) AS state_bits, round(s2, 5) AS step_bits FROM m JOIN e1 USING (seq, id) JOIN e2 USING (seq, id)"""


@query("v15_stream_geometry", _SHAPE)
def _(spark, d):
    g = vectors.stream_geometry(v.vectors(spark, d).select("seq", F.col("id").alias("pos"), "x"))
    return g.select("seq", "pos", *[F.round(c, 5).alias(c) for c in ("cosine", "step", "state_bits", "step_bits")])


@query("v16_fingerprint_match", "SELECT vec_id AS id, vec_id % 4 <> 0 AS hit, CASE WHEN vec_id % 4 <> 0 THEN 4 * len(embedding) ELSE 0 END AS saved FROM embeddings")
def _(spark, d):
    x = v.vectors(spark, d)
    theirs = x.select("id", F.transform("x", lambda c, i: c + F.when((F.col("id") % 4 == 0) & (i == 5), 1.0).otherwise(0.0)).alias("x"))
    return vectors.fingerprint_match(theirs.select("id", vectors.fingerprint(F.col("x")).alias("fingerprint")), x)


def _encoded(spark, d):
    sign = F.transform("x", lambda c: F.when(c > 0.1, 1.0).when(c < -0.1, -1.0).otherwise(0.0))
    padded = F.concat(sign, F.array_repeat(F.lit(0.0), 128 - F.size("x")))
    return v.vectors(spark, d).select("id", F.lit(encodings.PTQ1).alias("kind"), encodings.encode_ternary(padded).alias("data"))


_TERNARY = a._E + ", t AS (SELECT id, d, CASE WHEN v > 0.1 THEN 1.0::DOUBLE WHEN v < -0.1 THEN -1 ELSE 0 END AS v FROM e)"


@query("v11_decode_vectors", _TERNARY + " SELECT * FROM t UNION ALL SELECT id, unnest(range(64, 128)), 0 FROM vectors")
def _(spark, d):
    return _encoded(spark, d).select("id", F.posexplode(encodings.decode_vectors("kind", "data")).alias("d", "v")).withColumn("v", F.col("v").cast("double"))


@query("v12_encode_ternary", "SELECT vec_id AS id, 28 AS n_bytes, 1.0::DOUBLE AS scale FROM embeddings")
def _(spark, d):
    scale = F.get(encodings.decode_vectors(F.lit(encodings.F16), F.substring("data", 27, 2)), F.lit(0)).cast("double")
    return _encoded(spark, d).select("id", F.octet_length("data").alias("n_bytes"), scale.alias("scale"))


@query("v13_score_encoded", _TERNARY + " SELECT e.id AS q, t.id, round(sum(e.v * t.v), 6) AS y FROM e JOIN t USING (d) WHERE e.id % 100 = 0 GROUP BY ALL")
def _(spark, d):
    x = v.vectors(spark, d).where("id % 100 = 0").select("id", F.concat("x", F.array_repeat(F.lit(0.0), 128 - F.size("x"))).alias("x"))
    return vectors.score_encoded(x, _encoded(spark, d)).withColumn("y", F.round("y", 6))


_LAYOUT = v.sql("items") + ", l AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY grp ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM items)"


@query("s5_layout_shards", _LAYOUT + " SELECT grp, item, bytes, start FROM l")
def _(spark, d):
    return shards.layout_shards(v.items(spark, d)).select("grp", "item", "bytes", "start")


@query("s4_scan_shards", _LAYOUT + """ SELECT grp, item, name, bytes, start, 'ok' AS reason FROM l WHERE right(grp, 1) NOT IN ('1', '2')
UNION ALL SELECT DISTINCT grp, NULL, NULL, NULL, NULL, CASE right(grp, 1) WHEN '1' THEN 'truncated meta' ELSE 'bad magic' END FROM l WHERE right(grp, 1) IN ('1', '2')""")
def _(spark, d):
    files = shards.shard_heads(shards.layout_shards(v.items(spark, d)))
    end = F.substring("grp", -1, 1)
    broken = F.when(end == "1", F.substring("content", 1, 30)).when(end == "2", F.concat(F.lit(bytearray(b"#")), F.expr("substring(content, 2)"))).otherwise(F.col("content"))
    good, bad = shards.scan_shards(files.withColumn("content", broken))
    return good.select("grp", "item", "name", "bytes", "start", F.lit("ok").alias("reason")).unionByName(bad, allowMissingColumns=True)


@query("s6_decode_frames", "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE label END AS token_pos, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE round(CAST(embedding[64] AS DOUBLE), 6) END AS last, CASE WHEN vec_id % 5 = 0 THEN 'truncated' ELSE 'ok' END AS reason FROM embeddings")
def _(spark, d):
    x = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("sequence"), F.col("label").alias("token_pos"), F.lit(0).alias("layer_start"), F.lit(9).alias("layer_end"), F.col("embedding").alias("x"))
    sent = frames.encode_frames(x).select("id", F.when(F.col("id") % 5 == 0, F.expr("substring(frame, 1, length(frame) - 8)")).otherwise(F.col("frame")).alias("frame"))
    # Written as they were sent, so that they are made once and a task has one Python process at a time.
    good, bad = frames.decode_frames(storage.written(sent, "frames"))
    shown = good.select("id", "token_pos", F.round(F.element_at("x", -1).cast("double"), 6).alias("last"), F.lit("ok").alias("reason"))
    return shown.unionByName(bad, allowMissingColumns=True)


@query("s7_state_snapshot", r.LATEST + " SELECT node, last_seen, verb, power_watts, 30 AS threshold_s FROM state")
def _(spark, d):
    state = fleet.latest_state(v.telemetry(spark, d)).select("node", "last_seen", "verb", "power_watts")
    path = storage.shared_path(spark, "snapshot")
    storage.save_state(state, path)
    return storage.load_state(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema))


@query("s8_parse_probe_logs", """SELECT s_suppkey AS node, CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE s_suppkey % 50 * 1000 + 500 END AS latency_us, CASE WHEN s_suppkey % 6 = 0 THEN 0 ELSE 250 END AS jitter_us,
  CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE -(s_suppkey % 90) END AS signal_dbm, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey % 40 * 8 + 4 ELSE s_suppkey % 40 END AS bw_mbps,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'GPU X' || s_suppkey % 3 END AS model, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 12288 END AS vram, s_suppkey % 3 = 0 AS has_avx2 FROM supplier""")
def _(spark, d):
    """The first columns of what probes print."""
    return _probes(spark, d).select("node", "latency_us", "jitter_us", "signal_dbm", "bw_mbps", "model", "vram", "has_avx2")


def _probes(spark, d):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    log = F.concat_ws(
        "\n", F.concat(F.lit("rtt min/avg/max/mdev = 0.1/"), text(k % 50), F.when(k % 6 == 0, ".5/9.9 ms").otherwise(".5/9.9/0.25 ms")), F.when(k % 4 != 0, F.concat(F.lit("signal: -"), text(k % 90), F.lit(" dBm"))),
        F.concat(F.lit("tx bitrate: "), text(k % 40), F.when(k % 2 == 1, ".5 MB/s").otherwise(".5 MBit/s")), F.concat(F.lit("GPU X"), text(k % 3), F.when(k % 5 == 0, ", N/A").otherwise(", 12288"), F.lit(", 535.1, 8.6")),
        F.when(k % 3 == 0, "flags: avx avx2").when(k % 3 == 1, "flags: avx2x sse4_2").otherwise("flags: avx avx2x"),
    )
    return shards.parse_probe_logs(v.table(spark, d, "supplier").select(k.alias("node"), log.alias("text")))


@query("s8_probe_hardware", """SELECT s_suppkey AS node, CASE WHEN s_suppkey % 5 <> 0 THEN 'GPU X' || s_suppkey % 3 END AS model, CASE WHEN s_suppkey % 5 <> 0 THEN '535.1' END AS driver, CASE WHEN s_suppkey % 5 <> 0 THEN '8.6' END AS compute_cap,
  s_suppkey % 3 <> 1 AS has_avx, s_suppkey % 3 = 0 AS has_avx2, s_suppkey % 3 = 1 AS has_sse42 FROM supplier""")
def _(spark, d):
    return _probes(spark, d).select("node", "model", "driver", "compute_cap", "has_avx", "has_avx2", "has_sse42")


@query("s6_announcements", """SELECT vec_id AS id, CASE WHEN vec_id % 5 < 2 THEN NULL ELSE label END AS token_pos, CASE WHEN vec_id % 5 < 2 THEN NULL ELSE left(md5(CAST(vec_id AS VARCHAR)), 16) END AS hash,
  CASE vec_id % 5 WHEN 0 THEN 'truncated' WHEN 1 THEN 'short' ELSE 'ok' END AS reason FROM embeddings""")
def _(spark, d):
    k = F.col("vec_id")
    x = v.table(spark, d, "embeddings").select(k.alias("id"), k.alias("sequence"), F.col("label").alias("token_pos"), F.lit(0).alias("layer_start"), F.lit(9).alias("layer_end"), F.left(F.md5(k.cast("string").cast("binary")), F.lit(16)).alias("hash"))
    cut = F.when(F.col("id") % 5 == 0, F.expr("left(frame, 66)")).when(F.col("id") % 5 == 1, F.expr("left(frame, 50)")).otherwise(F.col("frame"))
    good, bad = frames.decode_announcements(frames.encode_announcements(x).select("id", cut.alias("frame")))
    return good.select("id", "token_pos", "hash", F.lit("ok").alias("reason")).unionByName(bad, allowMissingColumns=True)


@query("v1_normalize_gated", a._E + " SELECT id, d, round(v / sqrt(avg(v * v) OVER (PARTITION BY id) + 1e-6) * (1 + d % 3) * (v / 2 / (1 + exp(-v / 2))), 6) + 0.0 AS v FROM e")
def _(spark, d):
    x = v.vectors(spark, d).select("id", "x", F.transform("x", lambda _, i: (1 + i % 3).cast("double")).alias("w"), F.transform("x", lambda e: e / 2).alias("g"))
    return a._cells(vectors.normalize(x, "gated", weights="w", gate="g"))


def _vocabulary():
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@query("t2_bpe_encode")
def _(spark, d):
    return bpe.bpe_encode(v.table(spark, d, "documents").select("doc_id", "text"), _vocabulary()).select("doc_id", "ids")


@query("t3_bpe_decode", "SELECT doc_id, text FROM documents")
def _(spark, d):
    words = _vocabulary()
    return bpe.bpe_decode(bpe.bpe_encode(v.table(spark, d, "documents").select("doc_id", "text"), words).select("doc_id", "ids"), words)


@query("x2_stream_liveness", """WITH o AS (SELECT user_id AS node, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER w AS prev, lead(epoch_us(ts) // 1000) OVER w AS next FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000))
SELECT node, ms AS at_ms, true AS online FROM o WHERE prev IS NULL OR ms - prev >= 43200000
UNION ALL SELECT node, ms + 43200000, false FROM o WHERE next - ms >= 43200000 OR (next IS NULL AND ms + 43200000 <= (SELECT max(ms) - 60000 FROM o))""")
def _(spark, d):
    reports = v.telemetry_of(streams.open_table(spark, f"{d}/events.parquet"))
    return streams.drain(liveness.stream_liveness(reports, 43200, 60), "liveness")
