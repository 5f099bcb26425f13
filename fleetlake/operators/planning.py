"""Assignment of tasks to nodes, lanes and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.operators.folds import Admission, ordered_fold
from fleetlake.operators.scans import running

# Words that tell a workload's class, the first match wins.
CLASS_RULES = [("branch|sort", "BranchHeavy"), ("recurs|tree|travers", "Recursive"), ("matmul|matrix", "Simd"), ("graph|bfs|dfs", "Irregular"), ("batch|small", "SmallBatch"), ("llm|bitnet|inference|generate", "Llm"), ("gpu|cuda|opencl", "Gpu")]


# Classes that accelerators win, or of which nothing is known.
NO_CPU_ADVANTAGE = ["Simd", "Gpu", "Unknown"]
# Watts by words of a processor's name, kinds of lanes by the start of an interface's name, watts of a kind.
MODEL_WATTS = [("i7|i9", 45), ("i5", 35), ("i3|celeron", 25), ("pentium", 15)]
LANE_KINDS = [("^(wlan|wifi|wl)", "air"), ("^(rxe|rdma|ib)", "rdma")]
LANE_WATTS = [("^(air|modem)$", 2), ("^rdma$", 3), ("^(dma|blk|nvme)$", 5), ("^gpu$", 8)]
# Class and watts of tasks known by name.
TASK_CLASSES = [("^(bitnet_generate|tokenize|detok)$", "Llm"), ("^acts_echo$", "Simd"), ("^bench_sum$", "BranchHeavy"), ("^load_shard$", "Irregular")]
TASK_WATTS = [("^(bitnet_generate|tokenize|detok|load_shard)$", 10), ("^(acts_echo|bench_sum)$", 5)]


def first_match(text, rules: list[tuple], otherwise):
    """The value of the first rule (pattern, value) that ``text`` matches."""
    out = F.lit(None)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), value).otherwise(out)
    return F.coalesce(out, F.lit(otherwise))


def classify_workloads(tasks: DataFrame, rules: list[tuple[str, str]] = CLASS_RULES) -> DataFrame:
    return tasks.withColumn("class", first_match(F.lower("name"), rules, "Unknown"))


def with_cpu_advantage(classified: DataFrame) -> DataFrame:
    """Adds ``cpu_advantage``: whether processors win the row's class over accelerators."""
    return classified.withColumn("cpu_advantage", ~F.col("class").isin(NO_CPU_ADVANTAGE))


def model_watts(model):
    """Watts of a processor by its model name."""
    return first_match(F.lower(model), MODEL_WATTS, 35)


def price_lanes(lanes: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``watts`` of lanes by the name of their interface."""
    return lanes.withColumn("kind", first_match(F.col("iface"), LANE_KINDS, "tcp")).withColumn("watts", first_match(F.col("kind"), LANE_WATTS, 1))


def profile_tasks(tasks: DataFrame) -> DataFrame:
    """Adds ``class`` and ``watts`` of tasks with exactly a known name."""
    return tasks.withColumn("class", first_match(F.col("name"), TASK_CLASSES, "Unknown")).withColumn("watts", first_match(F.col("name"), TASK_WATTS, 1))


def candidates(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Which nodes can take which class; classes are few, so this is classes by nodes."""
    able = (
        F.col("class").isin("BranchHeavy", "Recursive", "Irregular", "Unknown")
        | (F.col("class").isin("Simd", "Llm") & (F.col("has_avx2") | F.col("has_avx")))
        | ((F.col("class") == "SmallBatch") & F.col("has_sse42"))
        | ((F.col("class") == "Gpu") & F.col("has_gpu"))
    )
    return nodes.join(F.broadcast(classes.select("class").distinct()), able)


def rank_nodes(cands: DataFrame) -> DataFrame:
    """The best node of each class; of equal scores the last node."""
    gpu = F.when(~F.col("has_gpu"), 0).when(F.col("vram") >= 8192, 12).when(F.col("vram") >= 4096, 8).otherwise(4)
    simd = F.when(F.col("has_avx2"), 3).when(F.col("has_avx"), 2).when(F.col("has_sse42"), 1).otherwise(0)
    score = gpu * 65536 + simd * 256 + (100 - F.least(F.col("tdp"), F.lit(100)))
    scored = cands.withColumn("score", score.cast("long"))
    return scored.groupBy("class").agg(F.max(F.struct("score", "node")).alias("b")).select("class", F.col("b.node").alias("node"), F.col("b.score").alias("score"))


def admit(tasks: DataFrame, budget: int) -> DataFrame:
    """In each pool, in order of arrival: a task is admitted if it still fits, else it waits and later ones may fit."""
    return ordered_fold(tasks, "pool", ["enqueued", "task"], Admission(budget))


def reoffer(queue: DataFrame, budget: int) -> DataFrame:
    """The waiting tasks once more, by priority and then arrival; those that don't fit wait on."""
    return ordered_fold(queue.withColumn("turn", -F.col("priority")), "pool", ["turn", "enqueued", "task"], Admission(budget))


def queue_order(tasks: DataFrame, cap: int = 1000) -> DataFrame:
    """By pool: the first ``cap`` arrivals, in order of priority and arrival; the others are rejected."""
    arrival = F.row_number().over(Window.partitionBy("pool").orderBy("enqueued", "task"))
    kept = tasks.withColumn("arrival", arrival).where(F.col("arrival") <= cap)
    place = F.row_number().over(Window.partitionBy("pool").orderBy(F.col("priority").desc(), "enqueued", "task"))
    return kept.select("pool", "task", "priority", place.alias("place"))


def expire(tasks: DataFrame, now: str) -> DataFrame:
    return tasks.select("task", (F.col("deadline").isNotNull() & (F.lit(now).cast("timestamp") > F.col("deadline"))).alias("expired"))


def retry_disposition(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """(task, retries, disposition) from failed attempts."""
    n = attempts.groupBy("task").agg(F.count("*").alias("retries"))
    return n.withColumn("disposition", F.when(F.col("retries") <= limit, "requeued").otherwise("dropped"))


def reconcile_desired(desired: DataFrame, acted: DataFrame, addresses: DataFrame) -> DataFrame:
    """Desired (node, task) pairs that weren't acted upon; without an address they are only reported."""
    left = desired.join(acted, ["node", "task"], "left_anti").join(addresses, "node", "left")
    return left.select("node", "task", F.when(F.col("address").isNull(), "reported").otherwise("act").alias("action"))


def choose_lanes(lanes: DataFrame, turn: int) -> DataFrame:
    """Of each node: lanes for control, critical (two), bulk (in turn) and reconciling traffic."""
    cost = F.col("latency") + F.col("jitter")
    w = Window.partitionBy("node")
    r = lanes.withColumn("up", F.row_number().over(w.orderBy(cost, "iface"))).withColumn("fast", F.row_number().over(w.orderBy(F.col("bw").desc(), "iface"))).withColumn("n", F.count("*").over(w))
    pick = lambda cond: F.max(F.when(cond, F.col("iface")))
    return r.groupBy("node").agg(pick(F.col("up") == 1).alias("control"), pick(F.col("up") == 2).alias("second"), pick(F.col("fast") == F.pmod(F.lit(turn), F.col("n")) + 1).alias("bulk"), pick(F.col("up") == F.col("n")).alias("reconcile"))


def proportional_split(groups: DataFrame) -> DataFrame:
    """Splits ``n`` of each group by weight: floors first, the rest one each by the largest fraction, ties in order."""
    w = Window.partitionBy("grp")
    share = groups.withColumn("num", F.col("n") * F.col("weight")).withColumn("den", F.sum("weight").over(w))
    parts = share.withColumn("base", F.floor(F.col("num") / F.col("den"))).withColumn("part", F.col("num") % F.col("den"))
    ranked = parts.withColumn("left", F.col("n") - F.sum("base").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.col("part").desc(), "ord")))
    return ranked.select("grp", "ord", (F.col("base") + (F.col("k") <= F.col("left")).cast("int")).cast("long").alias("amount"))


def _layer():
    """The number between the name's first ``blk.`` and the next dot; null if there is none."""
    n = F.regexp_extract("name", r"^.*?blk\.([^.]*)", 1)
    return F.when(n.rlike("^[0-9]+$"), n.try_cast("int"))


def route_items(items: DataFrame, keep: int, total: int, draft: bool) -> DataFrame:
    """Vision items are dropped; layers go to trunk below ``keep``, then to the draft below ``total``; a ``blk.`` item without a number is trunk."""
    block = F.col("name").startswith("blk.")
    layer = F.when(block, _layer())
    drop = F.col("name").startswith("v.") | F.col("name").contains(".v_") | F.col("name").startswith("model.visual")
    to_draft = F.lit("draft" if draft else "dropped")
    route = F.when(drop, "dropped").when(layer < keep, "trunk").when(layer < total, to_draft).when(layer.isNotNull(), "dropped").when(~block & F.col("name").contains("nextn"), to_draft).otherwise("trunk")
    return items.select("item", route.alias("route"))


def contiguous_groups(items: DataFrame, counts: list[int]) -> DataFrame:
    """Layers in order, cut into runs of the given lengths; of what isn't a layer token embeddings go to the first group, the rest to the last.

    A layer is any item with ``blk.`` and a number in its name. Items without any layer are an error.
    """
    rows = items.withColumn("layer", _layer())
    distinct = rows.where("layer is not null").select("layer").distinct()
    rank = distinct.withColumn("k", F.row_number().over(Window.orderBy("layer")) - 1)  # a row a layer
    group, upto = F.lit(len(counts) - 1), 0
    bounds = []
    for i, c in enumerate(counts):
        bounds.append((upto, upto + c, i))
        upto += c
    for lo, hi, i in reversed(bounds):
        group = F.when((F.col("k") >= lo) & (F.col("k") < hi), i).otherwise(group)
    joined = rows.join(rank, "layer", "left").join(F.broadcast(distinct.agg(F.count("*").alias("layers"))))  # one row
    stage = F.when(F.col("layer").isNotNull(), group).when(F.col("name").contains("token_embd"), 0).otherwise(len(counts) - 1)
    return joined.select("item", F.when(F.col("layers") == 0, F.raise_error(F.lit("no layer among the items")).cast("int")).otherwise(stage).alias("stage"))


def shard_census(items: DataFrame) -> DataFrame:
    n = F.regexp_extract("name", r"blk\.([0-9]+)", 1)
    return items.withColumn("layer", F.when(n != "", n.cast("int"))).groupBy("grp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("layer").alias("first_layer"), F.max("layer").alias("last_layer"))


def validate_spans(requests: DataFrame, tensors: DataFrame) -> DataFrame:
    """Requests for byte ranges: checked against the tensor's length, with what remains after ``received`` bytes."""
    r = requests.join(tensors, "item", "left")
    start, length = F.coalesce("start", F.lit(0)), F.coalesce("length", F.col("bytes"))
    reason = F.when(F.col("bytes").isNull(), "unknown").when(F.col("start").isNotNull() & F.col("length").isNull(), "no length").when(length <= 0, "empty").when(start + length > F.col("bytes"), "beyond end").otherwise("ok")
    done = F.col("received") >= length
    good = reason == "ok"
    return r.select("req", reason.alias("reason"), F.when(good & ~done, start + F.col("received")).alias("next_start"), F.when(good & ~done, length - F.col("received")).alias("next_length"))


def schedule(tasks: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """(pool, task, node, outcome): tasks in order of arrival go to the best node of their class if they fit the pool's budget.

    ``outcome`` is dispatched, ``no suitable node`` or ``energy budget exceeded``; a task without a node takes nothing from the budget.
    """
    return _dispatch(tasks, nodes, budget, ["enqueued", "task"])


def reschedule(queue: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """The waiting tasks once more as in ``schedule``, by priority and then arrival."""
    return _dispatch(queue.withColumn("turn", -F.col("priority")), nodes, budget, ["turn", "enqueued", "task"])


def _dispatch(tasks: DataFrame, nodes: DataFrame, budget: int, order: list[str]) -> DataFrame:
    told = classify_workloads(tasks)
    best = rank_nodes(candidates(told, nodes)).select("class", F.col("node").alias("best"))
    placed = told.join(F.broadcast(best), "class", "left")  # a row a class
    able = placed.where("best is not null")
    admitted = ordered_fold(able.drop("best"), "pool", order, Admission(budget)).select("task", "admitted")
    took = able.select("pool", "task", "best").join(admitted, "task")
    good = took.select("pool", "task", F.when(F.col("admitted"), F.col("best")).alias("node"), F.when(F.col("admitted"), "dispatched").otherwise("energy budget exceeded").alias("outcome"))
    none = placed.where("best is null").select("pool", "task", F.col("best").alias("node"), F.lit("no suitable node").alias("outcome"))
    return good.unionByName(none)


def queue_rejects(tasks: DataFrame, cap: int = 1000) -> DataFrame:
    """(pool, task) of the arrivals beyond ``cap``. A pool of any size spreads over all tasks."""
    return running(tasks.select("pool", "task", "enqueued"), ["pool"], ["enqueued", "task"], rank="arrival").where(F.col("arrival") > cap).select("pool", "task")


def budget_outcome(measured: DataFrame, budget: int) -> DataFrame:
    """(site, measured, watts, outcome, over_by) of (site, watts); null watts are nodes that couldn't be measured."""
    g = measured.groupBy("site").agg(F.count("watts").alias("measured"), F.sum("watts").cast("long").alias("watts"))
    over = F.col("watts") > budget
    outcome = F.when(F.col("measured") == 0, "nothing measured").when(over, "over").otherwise("within")
    return g.select("site", "measured", "watts", outcome.alias("outcome"), F.when(over, F.col("watts") - budget).alias("over_by"))


def owner_of(layers: DataFrame, stages: DataFrame) -> DataFrame:
    """(layer, stage): the first stage (by ``pos``) whose array ``layers`` has the layer, null if none has."""
    owner = stages.select("stage", "pos", F.explode("layers").alias("layer")).groupBy("layer").agg(F.min_by("stage", "pos").alias("stage"))
    return layers.select("layer").join(owner, "layer", "left")


def locate(names: DataFrame, items: DataFrame) -> DataFrame:
    """(name, shard): the first shard (by ``pos``) that holds the tensor, null if none does."""
    first = items.groupBy("name").agg(F.min_by("shard", "pos").alias("shard"))
    return names.select("name").join(first, "name", "left")


def missing_shards(stages: DataFrame, shards: DataFrame) -> DataFrame:
    """Stages of a plan whose shard isn't there."""
    return stages.join(shards.select("shard").distinct(), "shard", "left_anti")


def compatible_plans(a: DataFrame, b: DataFrame) -> DataFrame:
    """(plan, compatible) of plans on both sides: the same model and number of stages."""
    shape = lambda df, m, n: df.groupBy("plan").agg(F.min("model").alias(m), F.count("*").alias(n))
    return shape(a, "ma", "na").join(shape(b, "mb", "nb"), "plan").select("plan", (F.col("ma").eqNullSafe(F.col("mb")) & (F.col("na") == F.col("nb"))).alias("compatible"))


def requeue(queue: DataFrame, failed: DataFrame, limit: int = 3) -> DataFrame:
    """(pool, task, retries, disposition, place) after one failure each of ``failed`` (task, at).

    ``queue`` has (pool, task, retries, place). A task with retries left goes to the
    back of its pool, in order of failure; a dropped one leaves; the others move up.
    A pool of any size spreads over all tasks.
    """
    f = failed.groupBy("task").agg(F.min("at").alias("at"))
    q = queue.join(f, "task", "left").withColumn("retries", F.col("retries") + F.col("at").isNotNull().cast("int"))
    told = F.when(F.col("at").isNull(), "waiting").when(F.col("retries") <= limit, "requeued").otherwise("dropped")
    q = q.withColumn("disposition", told)
    gone = F.col("disposition") == "dropped"
    turn = [gone.alias("gone"), F.col("at").isNotNull().alias("back"), "at", F.when(F.col("at").isNull(), F.col("place")).alias("before")]
    q = running(q.select("pool", "task", "retries", "disposition", *turn), ["pool"], ["gone", "back", "at", "before", "task"], rank="now")
    return q.select("pool", "task", "retries", "disposition", F.when(~F.col("gone"), F.col("now")).alias("place"))


def reconcile_power(desired: DataFrame, acted: DataFrame, addresses: DataFrame) -> DataFrame:
    """(node, state, action) of declared power states ``awake`` or ``sleeping``.

    One that was acted upon stays ``requested``; without an address it is only
    ``reported``; else the node is put to ``sleep`` or gets a ``wake``.
    """
    done = acted.select("node", "state").distinct().withColumn("done", F.lit(True))
    rows = desired.join(done, ["node", "state"], "left").join(addresses.select("node", "address"), "node", "left")
    action = F.when(F.col("done"), "requested").when(F.col("address").isNull(), "reported").when(F.col("state") == "sleeping", "sleep").otherwise("wake")
    return rows.select("node", "state", action.alias("action"))


def stripe_binds(binds: DataFrame, lanes: DataFrame) -> DataFrame:
    """(bind, node, iface): a node's first bind takes its fastest lane, each later one the next, round and round.

    ``binds`` has (bind, node), numbered in order of ``bind``; ``lanes`` (node, iface, bw). Without lanes ``iface`` is null.
    """
    fast = F.row_number().over(Window.partitionBy("node").orderBy(F.col("bw").desc(), "iface")) - 1
    of = lanes.select("node", "iface", fast.alias("slot"))
    n = lanes.groupBy("node").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("node").orderBy("bind")) - 1
    asked = binds.select("bind", "node", k.alias("k")).join(n, "node", "left").withColumn("slot", (F.col("k") % F.col("n")).cast("int"))
    return asked.join(of, ["node", "slot"], "left").select("bind", "node", "iface")
