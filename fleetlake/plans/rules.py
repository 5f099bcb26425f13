"""Queries of the rules that complete other operators: dispatch, owners, audits, outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake import views as v
from fleetlake.functions import tokens
from fleetlake.operators import delta, energy, failures, fleet, planning, vectors
from fleetlake.plans import artifacts as a
from fleetlake.plans import flows
from fleetlake.plans import registry as r
from fleetlake.plans.registry import query
from fleetlake.sources import logs

_PROFILE = v.sql("telemetry") + """, t AS (SELECT *, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 7 = 0 THEN 8 ELSE 4 END AS cores, seq % 5 = 0 AS has_gpu FROM telemetry),
s AS (SELECT *, CASE WHEN load_avg > 2.0 THEN 'Working' ELSE 'Idle' END AS status FROM t),
p AS (SELECT *, lag(agent_version) OVER w AS pv, lag(status) OVER w AS ps, lag(cores) OVER w AS pc, lag(has_gpu) OVER w AS pg FROM s WINDOW w AS (PARTITION BY node ORDER BY ts, seq))"""


@query("r6_hardware_events", _PROFILE + """ SELECT node, seq, 'Updated' AS kind, concat_ws(',', CASE WHEN pc IS DISTINCT FROM cores OR pg <> has_gpu THEN 'hardware' END, CASE WHEN agent_version <> pv THEN 'version' END) AS detail
FROM p WHERE ps IS NOT NULL AND (pc IS DISTINCT FROM cores OR pg <> has_gpu OR agent_version <> pv)""")
def _(spark, d):
    n = F.col("seq")
    t = v.telemetry(spark, d).withColumn("cores", F.when(n % 11 != 0, F.when(n % 7 == 0, 8).otherwise(4))).withColumn("has_gpu", n % 5 == 0)
    return fleet.change_events(t, ["cores", "has_gpu"]).where("kind = 'Updated' and detail <> 'power,temp,load'")


_RATED = r.ALIVE + ", rated AS (SELECT * REPLACE (CASE WHEN node % 3 = 0 THEN 0 ELSE power_watts END AS power_watts), 15 + node % 90 AS tdp, node % 5 = 0 AS has_gpu, node % 4 * 4096 AS vram FROM live)"


def _rated(spark, d):
    n = F.col("node")
    live = r._live(spark, d).withColumn("power_watts", F.when(n % 3 == 0, 0).otherwise(F.col("power_watts")))
    return live.withColumn("tdp", 15 + n % 90).withColumn("has_gpu", n % 5 == 0).withColumn("vram", n % 4 * 4096).withColumn("gpu_model", F.when(n % 2 == 0, "NVIDIA GeForce RTX 3060").otherwise("Arc A770"))


@query("r10_census_rated", _RATED + """ SELECT site, count(*) AS total, count(*) FILTER (alive) AS online, CAST(coalesce(sum(CASE WHEN power_watts > 0 THEN power_watts ELSE tdp END) FILTER (alive), 0) AS BIGINT) AS power,
  count(*) - count(*) FILTER (alive AND load_avg > 2.0) AS idle, CAST(100 - trunc(coalesce(sum(CASE WHEN power_watts > 0 THEN power_watts ELSE tdp END) FILTER (alive), 0) * 100 / 500) AS BIGINT) AS headroom_pct FROM rated GROUP BY site""")
def _(spark, d):
    return fleet.fleet_census(_rated(spark, d), 500)


@query("r10_accelerators", _RATED + " SELECT site, CASE WHEN node % 2 = 0 THEN 'RTX 3060:' ELSE 'Arc A770:' END || vram AS accelerator, count(*) AS n FROM rated WHERE has_gpu GROUP BY ALL")
def _(spark, d):
    return fleet.accelerators(_rated(spark, d))


@query("r13_drift_summary", r.ALIVE + " SELECT count(*) AS nodes, count(*) FILTER (agent_version <> 'v1') AS stale, count(*) FILTER (NOT alive) AS offline FROM live")
def _(spark, d):
    return fleet.drift_summary(fleet.version_drift(r._live(spark, d), "v1"))


@query("r14_place_discovered", """WITH o AS (SELECT c_mktsegment || '-' || c_nationkey AS hostname, min(c_name) AS address FROM customer GROUP BY 1),
k AS (SELECT c_name, c_custkey FROM customer WHERE c_custkey % 2 = 0), j AS (SELECT * FROM o LEFT JOIN k ON c_name = address)
SELECT hostname, address, 'n' || c_custkey AS id, false AS is_new FROM j WHERE c_custkey IS NOT NULL
UNION ALL SELECT hostname, address, 'n' || ((SELECT count(*) FROM k) + row_number() OVER (ORDER BY hostname)), true FROM j WHERE c_custkey IS NULL""")
def _(spark, d):
    c = v.table(spark, d, "customer")
    found = c.select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("hostname"), F.col("c_name").alias("address"))
    return fleet.place_discovered(found, c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("address"), F.col("c_custkey").alias("node")))


@query("r16_appetite_changes", """WITH f AS (SELECT o_custkey AS pool, o_orderdate AS ts, o_orderkey AS seq, o_orderpriority AS workload, o_custkey % 3 * 100 AS budget, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 5 END AS latency, o_orderstatus AS profile FROM orders),
l AS (SELECT *, row_number() OVER w AS k, lag(workload) OVER w AS pw, lag(latency) OVER w AS pl, lag(profile) OVER w AS pp FROM f WINDOW w AS (PARTITION BY pool ORDER BY ts, seq))
SELECT pool, seq, k = 1 OR pw <> workload OR pl IS DISTINCT FROM latency OR pp <> profile AS applied FROM l""")
def _(spark, d):
    k = F.col("o_orderkey")
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("pool"), F.col("o_orderdate").alias("ts"), k.alias("seq"), F.col("o_orderpriority").alias("workload"), (F.col("o_custkey") % 3 * 100).alias("budget"), F.when(k % 9 != 0, 5).alias("latency"), F.col("o_orderstatus").alias("profile"))
    return fleet.appetite_changes(o)


@query("f3_offline_from_events", r._LOG + """, m AS (SELECT node, seq, kind, CASE WHEN kind = 'Joined' THEN 0 ELSE 1 END AS bad FROM log WHERE kind <> 'Updated'),
i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY node ORDER BY seq) AS island FROM m), s AS (SELECT *, sum(bad) OVER (PARTITION BY node, island ORDER BY seq) AS streak FROM i)
SELECT node, seq FROM s WHERE bad = 1 AND streak >= 2 AND kind = 'Left'""")
def _(spark, d):
    kind = F.when(F.col("verb") == "register", "Joined").when(F.col("verb") == "failure", F.when(F.col("seq") % 2 == 0, "Left").otherwise("StateChanged")).otherwise("Updated")
    return failures.offline_from_events(v.telemetry(spark, d).select("node", "seq", kind.alias("kind"), F.when(kind == "StateChanged", "Idle>Offline").otherwise("").alias("detail")), 2)


def _dispatched(order: str, waiting: str, budget: int) -> str:
    """Recursive SQL of a dispatch over nodes without accelerators."""
    return v.sql("tasks", "nodes").replace(*flows._RECURSIVE) + f""", c AS (SELECT *, {r._CLASS} FROM tasks WHERE {waiting}),
best AS (SELECT class, max(node) AS node FROM (SELECT class, node, rank() OVER (PARTITION BY class ORDER BY score DESC) AS k FROM (SELECT class, node, (CASE WHEN has_avx2 THEN 3 WHEN has_avx THEN 2 WHEN has_sse42 THEN 1 ELSE 0 END) * 256 + 100 - least(tdp, 100) AS score
  FROM nodes JOIN (SELECT DISTINCT class FROM c) ON NOT has_gpu AND (class IN ('BranchHeavy','Recursive','Irregular','Unknown') OR (class IN ('Simd','Llm') AND (has_avx2 OR has_avx)) OR (class = 'SmallBatch' AND has_sse42)))) WHERE k = 1 GROUP BY class),
p AS (SELECT c.*, best.node FROM c LEFT JOIN best USING (class)), o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY {order}) AS k FROM p WHERE node IS NOT NULL),
f(pool, k, task, used, admitted) AS ({flows._ADMIT.format(budget, "o", "f")})
SELECT p.pool, p.task, CASE WHEN admitted THEN node END AS node, CASE WHEN node IS NULL THEN 'no suitable node' WHEN admitted THEN 'dispatched' ELSE 'energy budget exceeded' END AS outcome FROM p LEFT JOIN f USING (task)"""


@query("p4_schedule", _dispatched("enqueued, task", "true", 300))
def _(spark, d):
    return planning.schedule(v.tasks(spark, d), v.nodes(spark, d).where("not has_gpu"), 300)


@query("p9_reschedule", _dispatched("priority DESC, enqueued, task", "watts > 20", 200))
def _(spark, d):
    return planning.reschedule(v.tasks(spark, d).where("watts > 20"), v.nodes(spark, d).where("not has_gpu"), 200)


@query("p6_queue_rejects", v.sql("tasks") + " SELECT pool, task FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY enqueued, task) AS k FROM tasks) WHERE k > 5")
def _(spark, d):
    return planning.queue_rejects(v.tasks(spark, d), 5)


@query("p10_budget_outcome", r.ALIVE + """, m AS (SELECT site, count(*) FILTER (alive AND site <> 3) AS measured, CAST(sum(power_watts) FILTER (alive AND site <> 3) AS BIGINT) AS watts FROM live GROUP BY site)
SELECT site, measured, watts, CASE WHEN measured = 0 THEN 'nothing measured' WHEN watts > 60 THEN 'over' ELSE 'within' END AS outcome, CASE WHEN watts > 60 THEN watts - 60 END AS over_by FROM m""")
def _(spark, d):
    watts = F.when(F.col("alive") & (F.col("site") != 3), F.col("power_watts"))
    return planning.budget_outcome(r._live(spark, d).select("site", watts.alias("watts")), 60)


@query("p16_owner_of", "SELECT p_size AS layer, min(CASE WHEN p_size < 30 THEN p_size // 10 WHEN p_size < 40 THEN NULL ELSE 3 END) AS stage FROM part GROUP BY 1")
def _(spark, d):
    layers = v.table(spark, d, "part").select(F.col("p_size").alias("layer")).distinct()
    cuts = [(0, 0, 10), (1, 9, 20), (2, 20, 30), (3, 40, 60)]  # layer 9 is in two stages, the first one owns it
    stages = layers.agg(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.sequence(F.lit(x), F.lit(y - 1)).alias("layers")) for s, x, y in cuts])).alias("s")).select("s.stage", F.col("s.stage").alias("pos"), "s.layers")
    return planning.owner_of(layers, stages)


@query("p16_locate", v.sql("items") + ", h AS (SELECT name, min(grp) AS shard FROM items WHERE item % 2 = 0 GROUP BY name) SELECT name, shard FROM (SELECT DISTINCT name FROM items) LEFT JOIN h USING (name)")
def _(spark, d):
    items = v.items(spark, d)
    return planning.locate(items.select("name").distinct(), items.where("item % 2 = 0").select("name", F.col("grp").alias("shard"), F.col("grp").alias("pos")))


@query("p16_missing_shards", "SELECT s_nationkey AS plan, s_suppkey AS stage, s_suppkey AS shard FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 40)")
def _(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("plan"), F.col("s_suppkey").alias("stage"), F.col("s_suppkey").alias("shard"))
    return planning.missing_shards(s, v.table(spark, d, "lineitem").where("l_linenumber = 7 and l_quantity > 40").select(F.col("l_suppkey").alias("shard")))


@query("p16_absent_shards", "SELECT s_nationkey AS plan, s_suppkey AS stage, s_suppkey AS shard FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7 AND l_quantity >= 50)")
def _(spark, d):
    """Few shards are there, so most stages miss theirs."""
    s = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("plan"), F.col("s_suppkey").alias("stage"), F.col("s_suppkey").alias("shard"))
    return planning.missing_shards(s, v.table(spark, d, "lineitem").where("l_linenumber = 7 and l_quantity >= 50").select(F.col("l_suppkey").alias("shard")))


@query("p16_compatible_plans", "WITH a AS (SELECT s_nationkey AS plan, count(*) AS n FROM supplier GROUP BY 1), b AS (SELECT s_nationkey AS plan, count(*) AS n FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1) SELECT plan, a.n = b.n AND plan % 4 <> 0 AS compatible FROM a JOIN b USING (plan)")
def _(spark, d):
    k = F.col("s_nationkey")
    plans = v.table(spark, d, "supplier").select(k.alias("plan"), F.lit("m").alias("model"), "s_suppkey")
    return planning.compatible_plans(plans, plans.where("s_suppkey % 5 <> 0").withColumn("model", F.when(F.col("plan") % 4 == 0, "other").otherwise("m")))


@query("d5_plan_sync", f"""WITH {a._BOTH}, e AS (SELECT *, unnest(range(0, (len(r) // 2 + 255) // 256)) AS idx FROM l WHERE len(l) = len(r)),
u AS (SELECT id, len(l) // 2 AS n, len(r) // 2 AS m, unnest(range(len(l) // 2 // 256, (len(r) // 2 + 255) // 256)) AS idx FROM l WHERE len(l) < len(r))
SELECT id, idx, idx * 256 AS start, len(substr(r, idx * 512 + 1, 512)) // 2 AS length, 'ok' AS status FROM e WHERE substr(r, idx * 512 + 1, 512) <> substr(l, idx * 512 + 1, 512)
UNION ALL SELECT id, idx, greatest(n, idx * 256), least(m, (idx + 1) * 256) - greatest(n, idx * 256), 'ok' FROM u""")
def _(spark, d):
    return delta.plan_sync(a._local(spark, d), a._remote(spark, d), a.SIZE)


@query("t7_acceptance_totals", """WITH t AS (SELECT conv_id * 1000 + turn AS id, string_split(text, ' ') AS a FROM conversations),
u AS (SELECT CASE WHEN id % 4 = 0 THEN 0 ELSE least(len(a), 5) END AS n, id % 7 AS k FROM t), s AS (SELECT n, CASE WHEN k BETWEEN 1 AND n THEN k - 1 ELSE n END AS hit FROM u)
SELECT CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(n - hit) AS BIGINT) AS misses, count(*) FILTER (n = 0) AS no_draft FROM s""")
def _(spark, d):
    t = v.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.split("text", " ").alias("actual"))
    drafted = F.transform(F.slice("actual", 1, 5), lambda x, i: F.when(i + 1 == F.col("id") % 7, "~").otherwise(x))
    return tokens.acceptance_totals(t.withColumn("drafted", F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).otherwise(drafted)))


@query("s3_audit_frames", """WITH e AS (SELECT user_id AS stream, event_id AS ord, event_type IN ('click', 'view') AND event_id % 3 = 0 AS is_ack, event_id % 41 = 0 AND NOT (event_type IN ('click', 'view') AND event_id % 3 = 0) AS is_eof FROM events),
x AS (SELECT *, 1 + coalesce(sum(CASE WHEN is_ack OR is_eof THEN 0 ELSE 1 END) OVER w, 0) AS expected FROM e WINDOW w AS (PARTITION BY stream ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, expected + CASE WHEN ord % 97 = 0 THEN 1 ELSE 0 END AS seq, CASE WHEN is_ack THEN CASE WHEN ord % 30 = 0 THEN 0 ELSE expected - 1 END END AS acked FROM x),
h AS (SELECT *, coalesce(max(acked) OVER (PARTITION BY stream ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS highest FROM f),
b AS (SELECT *, CASE WHEN is_ack AND acked < highest THEN 'ack went backwards' WHEN NOT is_ack AND seq <> expected THEN 'out of order' END AS reason FROM h)
SELECT stream, min(ord) FILTER (reason IS NOT NULL) AS first_bad, arg_min(reason, ord) FILTER (reason IS NOT NULL) AS reason,
  CAST(coalesce(arg_min(expected, ord) FILTER (reason IS NOT NULL) - 1, count(*) FILTER (NOT is_ack AND NOT is_eof)) AS BIGINT) AS high_water FROM b GROUP BY stream""")
def _(spark, d):
    from pyspark.sql import Window

    n, w = F.col("event_id"), Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    ack = F.col("event_type").isin("click", "view") & (n % 3 == 0)
    e = v.table(spark, d, "events").withColumn("is_ack", ack).withColumn("is_eof", ~ack & (n % 41 == 0))
    x = e.withColumn("expected", 1 + F.coalesce(F.sum((~F.col("is_ack") & ~F.col("is_eof")).cast("long")).over(w), F.lit(0)))
    acked = F.when(F.col("is_ack"), F.when(n % 30 == 0, 0).otherwise(F.col("expected") - 1))
    return logs.audit_frames(x.select(F.col("user_id").alias("stream"), n.alias("ord"), (F.col("expected") + (n % 97 == 0).cast("long")).alias("seq"), "is_ack", "is_eof", acked.alias("acked")))


@query("p1_cpu_advantage", v.sql("tasks") + f" SELECT task, class, class NOT IN ('Simd', 'Gpu', 'Unknown') AS cpu_advantage FROM (SELECT task, {r._CLASS} FROM tasks)")
def _(spark, d):
    return planning.with_cpu_advantage(planning.classify_workloads(v.tasks(spark, d))).select("task", "class", "cpu_advantage")


@query("p1_model_watts", """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 45 WHEN 1 THEN 45 WHEN 2 THEN 35 WHEN 3 THEN 25 WHEN 4 THEN 25 WHEN 5 THEN 15 ELSE 35 END AS watts FROM customer""")
def _(spark, d):
    models = F.array(*map(F.lit, ["Core(TM) i7-8550U", "CORE I9", "core i5", "Core i3 (not a Pentium)", "Celeron N4000", "Pentium Gold", "Xeon E5"]))
    k = F.col("c_custkey")
    return v.table(spark, d, "customer").select(k.alias("id"), planning.model_watts(F.element_at(models, (k % 7 + 1).cast("int"))).alias("watts"))


_WIRED = v.sql("lanes") + ", wired AS (SELECT *, ['wlan0', 'wlp3s0', 'wifi1', 'ib0', 'rxe_0', 'rdma1', 'enp3s0', 'eth_wl'][node % 8 + 1] AS name FROM lanes)"


@query("p1_lane_kinds", _WIRED + " SELECT node, iface AS lane, name AS iface, CASE WHEN node % 8 < 3 THEN 'air' WHEN node % 8 < 6 THEN 'rdma' ELSE 'tcp' END AS kind, CASE WHEN node % 8 < 3 THEN 2 WHEN node % 8 < 6 THEN 3 ELSE 1 END AS watts FROM wired")
def _(spark, d):
    names = F.array(*map(F.lit, ["wlan0", "wlp3s0", "wifi1", "ib0", "rxe_0", "rdma1", "enp3s0", "eth_wl"]))
    wired = v.lanes(spark, d).select("node", F.col("iface").alias("lane"), F.element_at(names, (F.col("node") % 8 + 1).cast("int")).alias("iface"))
    return planning.price_lanes(wired)


@query("p1_task_profiles", """SELECT o_orderkey AS task, CASE WHEN o_orderkey % 8 < 3 THEN 'Llm' WHEN o_orderkey % 8 = 3 THEN 'Simd' WHEN o_orderkey % 8 = 4 THEN 'BranchHeavy' WHEN o_orderkey % 8 = 5 THEN 'Irregular' ELSE 'Unknown' END AS class,
  CASE WHEN o_orderkey % 8 < 3 OR o_orderkey % 8 = 5 THEN 10 WHEN o_orderkey % 8 < 5 THEN 5 ELSE 1 END AS watts FROM orders""")
def _(spark, d):
    names = F.array(*map(F.lit, ["bitnet_generate", "tokenize", "detok", "acts_echo", "bench_sum", "load_shard", "detokenize", ""]))
    k = F.col("o_orderkey")
    return planning.profile_tasks(v.table(spark, d, "orders").select(k.alias("task"), F.element_at(names, (k % 8 + 1).cast("int")).alias("name"))).select("task", "class", "watts")


@query("p8_requeue", v.sql("tasks") + """, q AS (SELECT pool, task, task % 5 AS retries, row_number() OVER (PARTITION BY pool ORDER BY enqueued, task) AS place FROM tasks),
f AS (SELECT l_orderkey AS task, min(l_shipdate) AS failed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), n AS (SELECT pool, task, retries + CASE WHEN failed IS NULL THEN 0 ELSE 1 END AS retries, place, failed FROM q LEFT JOIN f USING (task)),
w AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY failed NULLS FIRST, CASE WHEN failed IS NULL THEN place END, task) AS k FROM n WHERE failed IS NULL OR retries <= 3)
SELECT pool, task, retries, CASE WHEN failed IS NULL THEN 'waiting' ELSE 'requeued' END AS disposition, k AS place FROM w
UNION ALL SELECT pool, task, retries, 'dropped', NULL FROM n WHERE failed IS NOT NULL AND retries > 3""")
def _(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("pool").orderBy("enqueued", "task"))
    queue = v.tasks(spark, d).select("pool", "task", (F.col("task") % 5).alias("retries"), place.alias("place"))
    failed = v.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task"), F.col("l_shipdate").alias("at"))
    return planning.requeue(queue, failed)


@query("p10_power_states", """WITH w AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 2 = 0 THEN 'sleeping' ELSE 'awake' END AS state FROM customer), a AS (SELECT DISTINCT o_custkey AS node FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 2 = 0)
SELECT w.node, state, CASE WHEN a.node IS NOT NULL THEN 'requested' WHEN s_suppkey IS NULL THEN 'reported' WHEN state = 'sleeping' THEN 'sleep' ELSE 'wake' END AS action FROM w LEFT JOIN a ON a.node = w.node AND state = 'sleeping' LEFT JOIN supplier ON s_suppkey = w.node""")
def _(spark, d):
    k = F.col("c_custkey")
    desired = v.table(spark, d, "customer").select(k.alias("node"), F.when(k % 2 == 0, "sleeping").otherwise("awake").alias("state"))
    acted = v.table(spark, d, "orders").where("o_orderstatus = 'P' and o_custkey % 2 = 0").select(F.col("o_custkey").alias("node"), F.lit("sleeping").alias("state"))
    return planning.reconcile_power(desired, acted, v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("address")))


@query("p17_stripe_binds", v.sql("lanes") + """, l AS (SELECT node, iface, row_number() OVER (PARTITION BY node ORDER BY bw DESC, iface) - 1 AS slot, count(*) OVER (PARTITION BY node) AS n FROM lanes WHERE node % 6 <> 0),
b AS (SELECT ps AS bind, l_suppkey AS node, row_number() OVER (PARTITION BY l_suppkey ORDER BY ps) - 1 AS k FROM (SELECT l_orderkey * 10 + l_linenumber AS ps, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1))
SELECT bind, b.node, iface FROM b LEFT JOIN l ON l.node = b.node AND slot = k % n""")
def _(spark, d):
    binds = v.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bind")).agg(F.min("l_suppkey").alias("node"))
    return planning.stripe_binds(binds, v.lanes(spark, d).where("node % 6 <> 0"))


_CHECKED = v.sql("telemetry") + """, p AS (SELECT node, site, avg(power_watts) AS predicted, CASE WHEN node % 9 <> 0 THEN CAST(arg_max(power_watts, (ts, seq)) AS DOUBLE) END AS actual FROM telemetry GROUP BY node, site),
q AS (SELECT *, coalesce(abs(actual - predicted) <= 25, true) AS planned FROM p)"""


@query("e2_reconcile_checks", _CHECKED + """ SELECT site, count(*) AS n_predicted, count(*) AS n_actual, count(*) FILTER (planned) AS n_planned, count(*) FILTER (NOT planned) AS n_drifted, round(sum(CASE WHEN planned THEN predicted ELSE actual END), 4) AS effective,
  true AS exact, abs(sum(CASE WHEN planned THEN predicted ELSE actual END) - sum(coalesce(actual, predicted))) <= count(*) FILTER (planned) * 25 + 1e-9 AS within_bound FROM q GROUP BY site""")
def _(spark, d):
    t = v.telemetry(spark, d)
    actual = F.when(F.col("node") % 9 != 0, F.max_by("power_watts", F.struct("ts", "seq")).cast("double"))
    both = energy.reconcile_checks(t.groupBy("site", "node").agg(F.avg("power_watts").alias("predicted")), t.groupBy("site", "node").agg(actual.alias("actual")), 25.0)
    return both.withColumn("effective", F.round("effective", 4))


@query("e2_verify_reported", _CHECKED + """, b AS (SELECT site, sum(CASE WHEN planned THEN predicted ELSE actual END) AS eff, sum(predicted) AS pre, sum(coalesce(actual, predicted)) AS act, count(*) AS n FROM q GROUP BY site),
k AS (SELECT *, CASE site % 5 WHEN 0 THEN eff WHEN 1 THEN pre WHEN 2 THEN act WHEN 3 THEN eff + 1 END AS told FROM b)
SELECT site, round(told, 3) AS reported, round(eff, 3) AS effective, n AS n_nodes, CASE WHEN told IS NULL THEN 'not reported' WHEN abs(told - eff) < 1e-6 THEN 'exact' WHEN abs(told - pre) < 1e-6 THEN 'summed predictions' WHEN abs(told - act) < 1e-6 THEN 'summed actuals' ELSE 'off' END AS verdict FROM k""")
def _(spark, d):
    """Totals as five kinds of reporters make them: right, one side only, off by a watt, none."""
    t = v.telemetry(spark, d)
    predicted = t.groupBy("site", "node").agg(F.avg("power_watts").alias("predicted"))
    actual = t.groupBy("site", "node").agg(F.when(F.col("node") % 9 != 0, F.max_by("power_watts", F.struct("ts", "seq")).cast("double")).alias("actual"))
    one = predicted.join(actual, ["site", "node"]).groupBy("site").agg(F.sum("predicted").alias("p"), F.sum(F.coalesce("actual", "predicted")).alias("a"))
    k = F.col("site") % 5
    told = energy.reconcile_checks(predicted, actual, 25.0).join(one, "site")
    reported = told.select("site", F.when(k == 0, F.col("effective")).when(k == 1, F.col("p")).when(k == 2, F.col("a")).when(k == 3, F.col("effective") + 1).alias("reported"))
    out = energy.verify_reported(reported, predicted, actual, 25.0)
    return out.select("site", F.round("reported", 3).alias("reported"), F.round("effective", 3).alias("effective"), "n_nodes", "verdict")


@query("v14_parity_details", a._E + """, w AS (SELECT id, d, v, CASE WHEN id % 2 = 0 AND d = 3 THEN v + 0.5 ELSE v END AS w FROM e),
g AS (SELECT id, round(max(abs(v - w) / greatest(abs(v), abs(w), 1e-30)), 6) AS max_rel, max(v) AS mv, max(w) AS mw FROM w GROUP BY id),
t AS (SELECT w.id, any_value(max_rel) AS max_rel, min(d) FILTER (v = mv) AS top_a, min(d) FILTER (w = mw) AS top_b FROM w JOIN g ON w.id = g.id GROUP BY w.id) SELECT *, top_a = top_b AS top_equal FROM t""")
def _(spark, d):
    x = v.vectors(spark, d).select("id", "x")
    y = x.withColumn("x", F.transform("x", lambda e, i: e + F.when((F.col("id") % 2 == 0) & (i == 3), 0.5).otherwise(0.0)))
    return vectors.parity_details(x, y).withColumn("max_rel", F.round("max_rel", 6))


@query("d11_ranked_neighbors", """WITH n AS (SELECT s_nationkey AS plan, s_suppkey AS pos, list_filter([lag(s_name) OVER w, lead(s_name) OVER w], lambda x: x IS NOT NULL) AS prefetch FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
k AS (SELECT l_suppkey AS pos, list('p' || l_partkey ORDER BY n DESC, l_partkey) AS planned FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_linenumber = 7 AND l_suppkey % 3 = 0 GROUP BY ALL) GROUP BY 1)
SELECT plan, pos, coalesce(planned, prefetch) AS prefetch FROM n LEFT JOIN k USING (pos)""")
def _(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("plan"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("stage"))
    used = v.table(spark, d, "lineitem").where("l_linenumber = 7 and l_suppkey % 3 = 0").groupBy(F.col("l_suppkey").alias("pos"), "l_partkey").agg(F.count("*").alias("n"))
    rank = F.struct((-F.col("n")).alias("n"), "l_partkey")
    ranking = used.join(s.select("plan", "pos"), "pos").select("plan", "pos", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("stage"), rank.alias("rank"))
    return delta.neighbors(s, ranking)


_RECORDS = v.sql("nodes") + """, rec AS (SELECT 'n' || node AS id, *, node % 4 * 20 AS power_watts, node % 90 AS temp_c, node % 997 / 100 AS load_avg, node % 2 = 0 AS alive, node % 8 AS cores FROM nodes JOIN supplier ON s_suppkey = node),
props AS (SELECT id AS node, unnest([
  {'property': 'power', 'value': CASE WHEN power_watts > 0 THEN power_watts ELSE tdp END || 'W'}, {'property': 'temp', 'value': temp_c || 'C'}, {'property': 'load', 'value': printf('%.2f', load_avg)}, {'property': 'status', 'value': 'Idle'},
  {'property': 'state', 'value': CASE WHEN alive THEN 'online' ELSE 'offline' END}, {'property': 'hostname', 'value': s_name}, {'property': 'ip', 'value': '10.0.0.' || s_suppkey}, {'property': 'ram', 'value': vram * 2 || 'MiB'}, {'property': 'cpu', 'value': 'Core i5'},
  {'property': 'cores', 'value': CAST(cores AS VARCHAR)}, {'property': 'threads', 'value': CAST(cores * 2 AS VARCHAR)}, {'property': 'simd', 'value': coalesce(nullif(concat_ws(', ', CASE WHEN has_avx2 THEN 'AVX2' END, CASE WHEN has_avx THEN 'AVX' END, CASE WHEN has_sse42 THEN 'SSE4.2' END), ''), 'none')},
  {'property': 'gpu', 'value': CASE WHEN has_gpu THEN 'RTX 3060 (' || vram || 'MiB)' ELSE 'none' END}], recursive := true) FROM rec),
answers AS (SELECT node, property, CASE WHEN property = 'load' AND CAST(substr(node, 2) AS BIGINT) % 5 = 0 THEN '9.99 (live)' ELSE value END AS value FROM props)"""


def _records(spark, d):
    k = F.col("node")
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("hostname"), F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string")).alias("ip"))
    rec = v.nodes(spark, d).join(s, "node").select(
        F.concat(F.lit("n"), k.cast("string")).alias("node"), (k % 4 * 20).alias("power_watts"), (k % 90).alias("temp_c"), (k % 997 / 100).alias("load_avg"), F.lit("Idle").alias("status"), (k % 2 == 0).alias("alive"), "hostname", "ip",
        (F.col("vram") * 2).alias("ram_mib"), F.lit("Core i5").alias("cpu_model"), (k % 8).alias("cores"), (k % 8 * 2).alias("threads"), "has_avx2", "has_avx", "has_sse42", "has_gpu", F.lit("RTX 3060").alias("gpu_model"), "vram", "tdp",
    )
    live = rec.where("cast(substr(node, 2) as bigint) % 5 = 0").select("node", F.lit("load").alias("property"), F.lit("9.99").alias("value"))
    return fleet.record_properties(rec, live)


@query("r12_record_properties", _RECORDS + " SELECT * FROM answers")
def _(spark, d):
    return _records(spark, d)


_ENDS = ["p", "t", "thermal", "l", "host", "addr", "r", "c", "s", "gpu", "state", "threads", "mac", "a-b", ""]


@query("r12_record_answers", _RECORDS + f""", q AS (SELECT p_partkey AS k, 'n' || p_partkey % 12 AS node, {_ENDS}[p_partkey % 15 + 1] AS e FROM part),
x AS (SELECT node || '.' || e AS path, node, CASE e WHEN 'p' THEN 'power' WHEN 't' THEN 'temp' WHEN 'thermal' THEN 'temp' WHEN 'l' THEN 'load' WHEN 'host' THEN 'hostname' WHEN 'addr' THEN 'ip' WHEN 'r' THEN 'ram' WHEN 'c' THEN 'cpu' WHEN 's' THEN 'simd' ELSE e END AS property FROM q)
SELECT path, CASE WHEN property IN ('a-b', '') THEN 'invalid path' WHEN property = 'mac' THEN 'unknown property: mac' ELSE coalesce(value, 'unknown node') END AS answer FROM x LEFT JOIN answers USING (node, property)""")
def _(spark, d):
    k = F.col("p_partkey")
    ends = F.array(*map(F.lit, _ENDS))
    paths = v.table(spark, d, "part").select(F.concat(F.lit("n"), (k % 12).cast("string"), F.lit("."), F.element_at(ends, (k % 15 + 1).cast("int"))).alias("path"))
    return fleet.record_answers(paths, _records(spark, d))


@query("s1_read_reports", v.sql("telemetry") + """ SELECT seq, 'h' || node AS hostname, CASE WHEN seq % 3 = 0 THEN 'i5' ELSE '' END AS cpu_model, CASE WHEN seq % 4 = 0 THEN 8 ELSE 0 END AS cores, 0 AS threads, seq % 5 = 0 AS has_avx2, false AS has_avx,
  CAST(CASE WHEN seq % 6 = 0 THEN 16384 ELSE 0 END AS BIGINT) AS ram_total_mib, power_watts, agent_version, '' AS image_rev, node_id, CASE WHEN seq % 8 = 0 THEN 1 ELSE 0 END AS n_gpus, CASE WHEN seq % 8 = 0 THEN 'RTX 3060' END AS gpu, 0 AS n_edges FROM telemetry""")
def _(spark, d):
    n = F.col("seq")
    t = v.telemetry(spark, d)
    gpus = F.when(n % 8 == 0, F.array(F.struct(F.lit("RTX 3060").alias("model"), F.lit(12288).alias("vram_mib"))))
    told = F.struct(F.concat(F.lit("h"), F.col("node").cast("string")).alias("hostname"), F.when(n % 3 == 0, "i5").alias("cpu_model"), F.when(n % 4 == 0, 8).alias("cores"), F.when(n % 5 == 0, True).alias("has_avx2"), F.when(n % 6 == 0, 16384).alias("ram_total_mib"), "power_watts", "agent_version", "node_id", gpus.alias("gpus"))
    good, _bad = logs.read_telemetry(t.select("seq", F.to_json(told).alias("line")))
    return good.select("seq", "hostname", "cpu_model", "cores", "threads", "has_avx2", "has_avx", "ram_total_mib", "power_watts", "agent_version", "image_rev", "node_id", F.size("gpus").alias("n_gpus"), F.get("gpus", F.lit(0))["model"].alias("gpu"), F.size("edges").alias("n_edges"))
