"""All queries of the library over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake import views as v
from fleetlake.operators import energy, failures, fleet, planning

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


LATEST = v.sql("telemetry") + """, state AS (SELECT * EXCLUDE (k, ts, seq), ts AS last_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, seq DESC) AS k FROM telemetry) WHERE k = 1)"""
ALIVE = f"""{LATEST}, live AS (SELECT *, greatest(0, epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(last_seen))) < 86400 AS alive,
  CAST(greatest(0, epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(last_seen))) AS BIGINT) AS silent_s FROM state)"""
DAY = 86400
NOON = "2024-01-30 12:00:00"


def _state(spark, d):
    return fleet.latest_state(v.telemetry(spark, d))


def _live(spark, d):
    return fleet.liveness(_state(spark, d), NOON, DAY)


@query("r3_latest_state", LATEST + " SELECT node, last_seen, verb, power_watts, round(load_avg, 6) AS load_avg, agent_version FROM state")
def _(spark, d):
    return _state(spark, d).select("node", "last_seen", "verb", "power_watts", F.round("load_avg", 6).alias("load_avg"), "agent_version")


@query("r4_liveness", ALIVE + " SELECT node, silent_s, alive FROM live")
def _(spark, d):
    return _live(spark, d).select("node", "silent_s", "alive")


@query("r5_derive_status", v.sql("telemetry") + " SELECT seq, CASE WHEN load_avg > 2.0 THEN 'Working' ELSE 'Idle' END AS status FROM telemetry")
def _(spark, d):
    return fleet.derive_status(v.telemetry(spark, d)).select("seq", "status")


@query("r6_change_events", v.sql("telemetry") + """, s AS (SELECT *, CASE WHEN load_avg > 2.0 THEN 'Working' ELSE 'Idle' END AS status FROM telemetry),
p AS (SELECT *, lag(agent_version) OVER w AS pv, lag(status) OVER w AS ps FROM s WINDOW w AS (PARTITION BY node ORDER BY ts, seq))
SELECT node, seq, 'Joined' AS kind, '' AS detail FROM p WHERE ps IS NULL
UNION ALL SELECT node, seq, 'Updated', 'version' FROM p WHERE ps IS NOT NULL AND agent_version <> pv
UNION ALL SELECT node, seq, 'StateChanged', ps || '>' || status FROM p WHERE ps <> status
UNION ALL SELECT node, seq, 'Updated', 'power,temp,load' FROM p WHERE ps IS NOT NULL AND verb = 'heartbeat'""")
def _(spark, d):
    return fleet.change_events(v.telemetry(spark, d))


@query("r7_merge_lanes", v.sql("lanes") + """, o AS (SELECT * FROM lanes WHERE node % 3 <> 0),
n AS (SELECT node, iface, CASE WHEN node % 2 = 0 THEN bw ELSE bw + 1 END AS bw, latency, jitter FROM lanes WHERE node % 5 <> 0)
SELECT coalesce(n.node, o.node) AS node, coalesce(n.iface, o.iface) AS iface, coalesce(n.bw, o.bw) AS bw, coalesce(n.latency, o.latency) AS latency,
  coalesce(n.jitter, o.jitter) AS jitter, n.node IS NOT NULL AND (o.node IS NULL OR n.bw <> o.bw) AS changed
FROM o FULL JOIN n ON o.node = n.node AND o.iface = n.iface""")
def _(spark, d):
    lanes = v.lanes(spark, d)
    new = lanes.where("node % 5 <> 0").withColumn("bw", F.when(F.col("node") % 2 == 0, F.col("bw")).otherwise(F.col("bw") + 1))
    return fleet.merge_lanes(lanes.where("node % 3 <> 0"), new)


@query("r8_recent_events", v.sql("telemetry") + " SELECT node, seq, verb FROM telemetry ORDER BY seq DESC LIMIT 50")
def _(spark, d):
    return fleet.recent_events(v.telemetry(spark, d), 50).select("node", "seq", "verb")


@query("r9_unregister", LATEST + " SELECT node, 'Left' AS kind, 'retired' AS reason FROM state WHERE node % 7 = 0 UNION ALL SELECT node, 'stays', NULL FROM state WHERE node % 7 <> 0")
def _(spark, d):
    gone = v.table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.lit("retired").alias("reason")).where("node % 7 = 0").unionByName(spark.range(1).select(F.lit(0).cast("long").alias("node"), F.lit("retired").alias("reason"))).distinct()
    kept, left = fleet.unregister(_state(spark, d), gone)
    return left.unionByName(kept.select("node", F.lit("stays").alias("kind"), F.lit(None).cast("string").alias("reason")))


@query("r10_fleet_census", ALIVE + """ SELECT site, count(*) AS total, count(*) FILTER (alive) AS online, CAST(coalesce(sum(power_watts) FILTER (alive), 0) AS BIGINT) AS power,
  count(*) - count(*) FILTER (alive AND load_avg > 2.0) AS idle, CAST(100 - trunc(coalesce(sum(power_watts) FILTER (alive), 0) * 100 / 500) AS BIGINT) AS headroom_pct FROM live GROUP BY site""")
def _(spark, d):
    return fleet.fleet_census(_live(spark, d), 500)


@query("r11_overlay_live", ALIVE + ", " + v.SQL["nodes"] + " SELECT node, power_watts FROM live WHERE alive UNION ALL SELECT node, CAST(tdp AS INTEGER) FROM nodes WHERE node NOT IN (SELECT node FROM live WHERE alive)")
def _(spark, d):
    live = _live(spark, d).where("alive").select("node", "power_watts")
    return fleet.overlay_live(live, v.nodes(spark, d).select("node", F.col("tdp").cast("int").alias("power_watts")))


_PROPERTIES = ALIVE + """, base AS (SELECT *, CASE WHEN load_avg > 2.0 THEN 'Working' ELSE 'Idle' END AS status FROM live),
props AS (SELECT node, 'power' AS property, power_watts || 'W' AS value FROM base UNION ALL SELECT node, 'version', agent_version FROM base
UNION ALL SELECT node, 'seen', strftime(last_seen, '%Y-%m-%d %H:%M:%S') FROM base UNION ALL SELECT node, 'status', status FROM base),
over_ AS (SELECT node, 'power' AS property, power_watts + 1 || 'W' AS o FROM base WHERE node % 4 = 0),
answers AS (SELECT props.node, props.property, coalesce(o || ' (live)', value) AS value FROM props LEFT JOIN over_ USING (node, property))"""


def _properties(spark, d):
    s = fleet.derive_status(_live(spark, d))
    over = s.where("node % 4 = 0").select("node", F.lit("power").alias("property"), F.concat((F.col("power_watts") + 1).cast("string"), F.lit("W")).alias("value"))
    return fleet.node_properties(s, over)


@query("r12_node_properties", _PROPERTIES + " SELECT * FROM answers")
def _(spark, d):
    return _properties(spark, d)


@query("r12_query_paths", _PROPERTIES + """, q AS (SELECT seq, 'n' || node || ['.p','.version','.bogus','..p'][seq % 4 + 1] AS path FROM telemetry),
r AS (SELECT seq, path, CASE seq % 4 WHEN 0 THEN 'power' ELSE 'version' END AS property, CAST(regexp_extract(path, '[0-9]+') AS BIGINT) AS node FROM q)
SELECT path, CASE seq % 4 WHEN 2 THEN 'unknown property: bogus' WHEN 3 THEN 'bad path' ELSE value END AS answer FROM r LEFT JOIN answers USING (node, property)""")
def _(spark, d):
    ends = F.array(*map(F.lit, [".p", ".version", ".bogus", "..p"]))
    paths = v.telemetry(spark, d).select(F.concat(F.lit("n"), F.col("node").cast("string"), F.element_at(ends, (F.col("seq") % 4 + 1).cast("int"))).alias("path"))
    return fleet.query_paths(paths, _properties(spark, d))


@query("r13_version_drift", ALIVE + " SELECT node, agent_version AS version, agent_version = 'v1' AS is_current, NOT alive AS offline FROM live")
def _(spark, d):
    return fleet.version_drift(_live(spark, d), "v1")


@query("r14_dedupe_discovered", """WITH f AS (SELECT c_mktsegment || '-' || c_nationkey AS hostname, c_name AS address FROM customer),
o AS (SELECT hostname, min(address) AS address FROM f GROUP BY hostname)
SELECT hostname, address, c_custkey AS slot FROM o LEFT JOIN (SELECT c_name, c_custkey FROM customer WHERE c_custkey % 2 = 0) ON c_name = address""")
def _(spark, d):
    c = v.table(spark, d, "customer")
    found = c.select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("hostname"), F.col("c_name").alias("address"))
    return fleet.dedupe_discovered(found, c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("address"), F.col("c_custkey").alias("node")))


@query("r15_controls_as_of", v.sql("telemetry", "controls") + """, t AS (SELECT node % 10 AS pool, ts, seq FROM telemetry WHERE verb = 'heartbeat')
SELECT t.pool, t.seq, (SELECT arg_max(struct_pack(b := budget), (c.ts, c.seq)) FROM controls c WHERE c.pool = t.pool AND c.ts <= t.ts).b AS budget FROM t""")
def _(spark, d):
    reports = v.telemetry(spark, d).where("verb = 'heartbeat'").select((F.col("node") % 10).alias("pool"), "ts", "seq")
    return fleet.controls_as_of(reports, v.controls(spark, d))


@query("r16_control_changes", v.sql("controls") + " SELECT pool, seq, row_number() OVER w = 1 OR budget IS DISTINCT FROM lag(budget) OVER w AS applied FROM controls WINDOW w AS (PARTITION BY pool ORDER BY ts, seq)")
def _(spark, d):
    return fleet.control_changes(v.controls(spark, d))


@query("r17_derive_keys", """WITH m AS (SELECT c_name AS hostname, c_custkey AS idx, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'To Be Filled By O.E.M.' ELSE 'u' || c_custkey END AS uuid,
  CASE c_custkey % 3 WHEN 0 THEN NULL ELSE 's' || c_nationkey END AS board_serial, CASE c_custkey % 5 WHEN 0 THEN ' ' ELSE c_mktsegment END AS product_serial FROM customer),
k AS (SELECT *, CASE WHEN idx % 4 > 1 THEN 'uuid' WHEN board_serial IS NOT NULL THEN 'board_serial' WHEN trim(product_serial) <> '' THEN 'product_serial' ELSE 'hostname' END AS source FROM m)
SELECT hostname, source, 'b' || substr(sha256(CASE source WHEN 'uuid' THEN uuid WHEN 'board_serial' THEN board_serial WHEN 'product_serial' THEN product_serial ELSE hostname END), 1, 16) AS key,
  CASE WHEN regexp_matches(hostname, '[0-9]{2}$') THEN 'n' || CAST(regexp_extract(hostname, '([0-9]{2})$', 1) AS INTEGER) ELSE 'n' || (idx + 1) END AS display_id FROM k""")
def _(spark, d):
    k = F.col("c_custkey")
    m = v.table(spark, d, "customer").select(
        F.col("c_name").alias("hostname"), k.alias("idx"), F.when(k % 4 == 0, "").when(k % 4 == 1, "To Be Filled By O.E.M.").otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("uuid"),
        F.when(k % 3 != 0, F.concat(F.lit("s"), F.col("c_nationkey").cast("string"))).alias("board_serial"), F.when(k % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("product_serial"),
    )
    return fleet.derive_keys(m)


@query("r2_allocate_ids", v.sql("telemetry") + " SELECT node_id AS key, 'n' || (100 + row_number() OVER (ORDER BY ts, seq)) AS id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts, seq) AS k FROM telemetry) WHERE k = 1")
def _(spark, d):
    known = v.nodes(spark, d).where("node <= 100").select(F.concat(F.lit("n"), F.lit(100).cast("string")).alias("id"))
    return fleet.allocate_ids(v.telemetry(spark, d).withColumnRenamed("node_id", "key"), known)


STREAKS = v.sql("telemetry") + """, i AS (SELECT *, sum(CASE WHEN verb = 'failure' THEN 0 ELSE 1 END) OVER (PARTITION BY node ORDER BY ts, seq) AS island FROM telemetry),
streaks AS (SELECT node, ts, seq, verb, CAST(sum(CASE WHEN verb = 'failure' THEN 1 ELSE 0 END) OVER (PARTITION BY node, island ORDER BY ts, seq) AS BIGINT) AS streak FROM i)"""


@query("f1_failure_streaks", STREAKS + " SELECT node, seq, streak, streak >= 3 AND verb = 'failure' AS offline FROM streaks")
def _(spark, d):
    return failures.failure_streaks(v.telemetry(spark, d)).select("node", "seq", "streak", "offline")


@query("f2_cooldown", STREAKS + """, l AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, seq DESC) AS k FROM streaks),
a AS (SELECT node, streak, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(ts)) AS age FROM l WHERE k = 1)
SELECT node, streak, streak > 0 AND age < 30 AS cooling, streak > 0 AND age > 300 AS timed_out FROM a""")
def _(spark, d):
    return failures.cooldown(failures.failure_streaks(v.telemetry(spark, d)), v.NOW)


_LOG = v.sql("telemetry") + """, log AS (SELECT node, seq, CASE verb WHEN 'register' THEN 'Joined' WHEN 'failure' THEN CASE WHEN seq % 2 = 0 THEN 'Left' ELSE 'StateChanged' END ELSE 'Updated' END AS kind FROM telemetry)"""


@query("f3_failures_from_events", _LOG + " SELECT node, seq, CASE kind WHEN 'Joined' THEN 'success' ELSE 'failure' END AS verb, kind = 'Left' AS listed FROM log WHERE kind <> 'Updated'")
def _(spark, d):
    kind = F.when(F.col("verb") == "register", "Joined").when(F.col("verb") == "failure", F.when(F.col("seq") % 2 == 0, "Left").otherwise("StateChanged")).otherwise("Updated")
    return failures.failures_from_events(v.telemetry(spark, d).select("node", "seq", kind.alias("kind"), F.when(kind == "StateChanged", "Idle>Offline").otherwise("").alias("detail")))


@query("f4_stale_nodes", ALIVE + " SELECT node, silent_s FROM live WHERE NOT alive")
def _(spark, d):
    return failures.stale_nodes(_live(spark, d))


@query("f5_cleanup", STREAKS + " SELECT node, seq, streak FROM streaks WHERE streak > 0 AND node IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    open_ = failures.failure_streaks(v.telemetry(spark, d)).where("streak > 0").select("node", "seq", "streak")
    return failures.cleanup(open_, v.nodes(spark, d))


_CLASS = """CASE WHEN regexp_matches(name, 'branch|sort') THEN 'BranchHeavy' WHEN regexp_matches(name, 'recurs|tree|travers') THEN 'Recursive' WHEN regexp_matches(name, 'matmul|matrix') THEN 'Simd'
  WHEN regexp_matches(name, 'graph|bfs|dfs') THEN 'Irregular' WHEN regexp_matches(name, 'batch|small') THEN 'SmallBatch' WHEN regexp_matches(name, 'llm|bitnet|inference|generate') THEN 'Llm'
  WHEN regexp_matches(name, 'gpu|cuda|opencl') THEN 'Gpu' ELSE 'Unknown' END AS class"""
_CANDS = v.sql("tasks", "nodes") + f""", c AS (SELECT DISTINCT {_CLASS} FROM tasks),
cands AS (SELECT * FROM nodes JOIN c ON class IN ('BranchHeavy','Recursive','Irregular','Unknown') OR (class IN ('Simd','Llm') AND (has_avx2 OR has_avx)) OR (class = 'SmallBatch' AND has_sse42) OR (class = 'Gpu' AND has_gpu))"""


@query("p1_classify_workloads", v.sql("tasks") + f" SELECT task, {_CLASS} FROM tasks")
def _(spark, d):
    return planning.classify_workloads(v.tasks(spark, d)).select("task", "class")


@query("p2_candidates", _CANDS + " SELECT class, node FROM cands")
def _(spark, d):
    return planning.candidates(planning.classify_workloads(v.tasks(spark, d)), v.nodes(spark, d)).select("class", "node")


@query("p3_rank_nodes", _CANDS + """, s AS (SELECT class, node, CAST((CASE WHEN NOT has_gpu THEN 0 WHEN vram >= 8192 THEN 12 WHEN vram >= 4096 THEN 8 ELSE 4 END) * 65536
  + (CASE WHEN has_avx2 THEN 3 WHEN has_avx THEN 2 WHEN has_sse42 THEN 1 ELSE 0 END) * 256 + 100 - least(tdp, 100) AS BIGINT) AS score FROM cands)
SELECT class, node, score FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, node DESC) AS k FROM s) WHERE k = 1""")
def _(spark, d):
    return planning.rank_nodes(planning.candidates(planning.classify_workloads(v.tasks(spark, d)), v.nodes(spark, d)))


@query("p4_admit", v.sql("tasks").replace("WITH ", "WITH RECURSIVE ") + """, o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY enqueued, task) AS k FROM tasks),
f(pool, k, task, used, admitted) AS (
  SELECT pool, k, task, CASE WHEN watts <= 300 THEN watts ELSE 0 END, watts <= 300 FROM o WHERE k = 1
  UNION ALL SELECT o.pool, o.k, o.task, f.used + CASE WHEN f.used + o.watts <= 300 THEN o.watts ELSE 0 END, f.used + o.watts <= 300 FROM f JOIN o ON o.pool = f.pool AND o.k = f.k + 1)
SELECT pool, task, admitted FROM f""")
def _(spark, d):
    return planning.admit(v.tasks(spark, d), 300)


@query("p6_queue_order", v.sql("tasks") + """, a AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY enqueued, task) AS arrival FROM tasks)
SELECT pool, task, priority, row_number() OVER (PARTITION BY pool ORDER BY priority DESC, enqueued, task) AS place FROM a WHERE arrival <= 20""")
def _(spark, d):
    return planning.queue_order(v.tasks(spark, d), 20)


@query("p7_expire", v.sql("tasks") + " SELECT task, TIMESTAMP '1998-01-01 00:00:00' > deadline AS expired FROM tasks")
def _(spark, d):
    return planning.expire(v.tasks(spark, d), "1998-01-01 00:00:00")


@query("p8_retry_disposition", "SELECT l_orderkey AS task, count(*) AS retries, CASE WHEN count(*) <= 3 THEN 'requeued' ELSE 'dropped' END AS disposition FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def _(spark, d):
    return planning.retry_disposition(v.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task")))


@query("p10_reconcile_desired", """WITH w AS (SELECT DISTINCT l_suppkey AS node, l_orderkey AS task FROM lineitem), a AS (SELECT DISTINCT l_suppkey AS node, l_orderkey AS task FROM lineitem WHERE l_returnflag = 'A')
SELECT w.node, w.task, CASE WHEN s_suppkey IS NULL THEN 'reported' ELSE 'act' END AS action FROM w ANTI JOIN a USING (node, task) LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) ON s_suppkey = w.node""")
def _(spark, d):
    li = v.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("task"), "l_returnflag")
    address = v.table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("address"))
    return planning.reconcile_desired(li.select("node", "task").distinct(), li.where("l_returnflag = 'A'").select("node", "task").distinct(), address)


@query("p11_choose_lanes", v.sql("lanes") + """, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY latency + jitter, iface) AS up, row_number() OVER (PARTITION BY node ORDER BY bw DESC, iface) AS fast, count(*) OVER (PARTITION BY node) AS n FROM lanes)
SELECT node, max(iface) FILTER (up = 1) AS control, max(iface) FILTER (up = 2) AS second, max(iface) FILTER (fast = 5 % n + 1) AS bulk, max(iface) FILTER (up = n) AS reconcile FROM r GROUP BY node""")
def _(spark, d):
    return planning.choose_lanes(v.lanes(spark, d), 5)


@query("p13_proportional_split", v.sql("items") + """, g AS (SELECT grp, item AS ord, bytes AS weight, 1000 AS n FROM items),
s AS (SELECT *, n * weight AS num, sum(weight) OVER (PARTITION BY grp) AS den FROM g), b AS (SELECT *, CAST(num // den AS BIGINT) AS base, num % den AS part FROM s),
k AS (SELECT *, n - sum(base) OVER (PARTITION BY grp) AS l, row_number() OVER (PARTITION BY grp ORDER BY part DESC, ord) AS k FROM b)
SELECT grp, ord, CAST(base + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS amount FROM k""")
def _(spark, d):
    return planning.proportional_split(v.items(spark, d).select("grp", F.col("item").alias("ord"), F.col("bytes").alias("weight"), F.lit(1000).alias("n")))


@query("p14_contiguous_groups", v.sql("items") + """, l AS (SELECT *, CASE WHEN contains(name, 'blk.') THEN TRY_CAST(split_part(split_part(name, 'blk.', 2), '.', 1) AS INTEGER) END AS layer FROM items),
r AS (SELECT layer, row_number() OVER (ORDER BY layer) - 1 AS k FROM (SELECT DISTINCT layer FROM l WHERE layer IS NOT NULL))
SELECT item, CASE WHEN layer IS NOT NULL THEN CASE WHEN k < 20 THEN 0 WHEN k < 45 THEN 1 ELSE 2 END WHEN contains(name, 'token_embd') THEN 0 ELSE 2 END AS stage FROM l LEFT JOIN r USING (layer)""")
def _(spark, d):
    return planning.contiguous_groups(v.items(spark, d), [20, 25, 19])


@query("p15_route_items", v.sql("items") + """, l AS (SELECT *, CASE WHEN starts_with(name, 'blk.') THEN TRY_CAST(split_part(split_part(name, 'blk.', 2), '.', 1) AS INTEGER) END AS layer FROM items)
SELECT item, CASE WHEN starts_with(name, 'v.') OR contains(name, '.v_') OR starts_with(name, 'model.visual') THEN 'dropped'
  WHEN starts_with(name, 'blk.') AND layer IS NULL THEN 'trunk' WHEN layer < 40 THEN 'trunk' WHEN layer < 50 THEN 'draft' WHEN layer IS NOT NULL THEN 'dropped'
  WHEN contains(name, 'nextn') THEN 'draft' ELSE 'trunk' END AS route FROM l""")
def _(spark, d):
    return planning.route_items(v.items(spark, d), 40, 50, True)


@query("p16_shard_census", v.sql("items") + """, l AS (SELECT *, TRY_CAST(regexp_extract(name, 'blk\\.([0-9]+)', 1) AS INTEGER) AS layer FROM items)
SELECT grp, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, min(layer) AS first_layer, max(layer) AS last_layer FROM l GROUP BY grp""")
def _(spark, d):
    return planning.shard_census(v.items(spark, d))


_REQ = """, r AS (SELECT l_orderkey * 10 + l_linenumber AS req, l_partkey AS item, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS start, CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE CAST(l_quantity AS BIGINT) - 5 END AS length, l_linenumber * 2 AS received FROM lineitem)"""


@query("p17_validate_spans", v.sql("items") + _REQ + """, c AS (SELECT *, coalesce(r.start, 0) AS s, coalesce(length, bytes) AS n FROM r LEFT JOIN items USING (item)),
z AS (SELECT *, CASE WHEN bytes IS NULL THEN 'unknown' WHEN start IS NOT NULL AND length IS NULL THEN 'no length' WHEN n <= 0 THEN 'empty' WHEN s + n > bytes THEN 'beyond end' ELSE 'ok' END AS reason FROM c)
SELECT req, reason, CASE WHEN reason = 'ok' AND received < n THEN s + received END AS next_start, CASE WHEN reason = 'ok' AND received < n THEN n - received END AS next_length FROM z""")
def _(spark, d):
    n = F.col("l_linenumber")
    req = v.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("req"), F.col("l_partkey").alias("item"), F.when(n != 1, n).alias("start"), F.when(n % 3 != 1, F.col("l_quantity").cast("long") - 5).alias("length"), (n * 2).alias("received"))
    return planning.validate_spans(req, v.items(spark, d).select("item", "bytes"))


@query("e1_counter_rate", v.sql("counter") + """, l AS (SELECT node, seq, uj - lag(uj) OVER w AS du, floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS dt FROM counter WINDOW w AS (PARTITION BY node ORDER BY ts, seq))
SELECT node, seq, round(CASE WHEN du IS NULL THEN NULL WHEN dt <= 0 THEN 0 ELSE greatest(du, 0) / 1e6 / dt END, 6) AS watts FROM l""")
def _(spark, d):
    return energy.counter_rate(v.counter(spark, d)).withColumn("watts", F.round("watts", 6))


_PRED = v.sql("telemetry") + """, p AS (SELECT node, node % 25 AS site, avg(power_watts) AS predicted, arg_max(power_watts, (ts, seq)) AS actual FROM telemetry GROUP BY node),
q AS (SELECT *, abs(actual - predicted) > 5 AS drifted FROM p),
s AS (SELECT site, count(*) FILTER (NOT drifted) AS n_planned, count(*) FILTER (drifted) AS n_drifted, round(sum(CASE WHEN drifted THEN actual ELSE predicted END), 4) AS effective, CAST(sum(actual) AS DOUBLE) AS actual FROM q GROUP BY site)"""


def _reconciled(spark, d):
    t = v.telemetry(spark, d)
    pred = t.groupBy("node").agg(F.avg("power_watts").alias("predicted")).withColumn("site", F.col("node") % 25)
    actual = t.groupBy("node").agg(F.max_by("power_watts", F.struct("ts", "seq")).cast("double").alias("actual"))
    return energy.reconcile_predictions(pred, actual).withColumn("effective", F.round("effective", 4))


@query("e2_reconcile_predictions", _PRED + " SELECT * FROM s")
def _(spark, d):
    return _reconciled(spark, d)


@query("e3_budget_verdict", _PRED + " SELECT site, effective, CASE WHEN effective <= 200 THEN 'WITHIN' ELSE 'BREACH' END AS verdict FROM s")
def _(spark, d):
    return energy.budget_verdict(_reconciled(spark, d), 200).select("site", "effective", "verdict")


@query("e4_hop_timings", "SELECT event_type AS kind, round(avg(value), 6) AS mean_ms, count(*) AS n, round(count(*) / greatest(sum(value) / 1000, 1e-6), 4) AS per_s FROM events GROUP BY 1")
def _(spark, d):
    t = energy.hop_timings(v.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("value").alias("ms")))
    return t.select("kind", F.round("mean_ms", 6).alias("mean_ms"), "n", F.round("per_s", 4).alias("per_s"))
