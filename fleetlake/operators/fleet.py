"""State of a fleet from its reports. Every function takes DataFrames and an explicit ``now``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.operators.scans import running

OFFLINE_AFTER_S = 30
BUSY_LOAD = 2.0


def latest_state(reports: DataFrame) -> DataFrame:
    """The last report of each node wins; ties go to the larger sequence number."""
    rest = [c for c in reports.columns if c not in ("node", "ts", "seq")]
    last = reports.groupBy("node").agg(F.max_by(F.struct("ts", "seq", *rest), F.struct("ts", "seq")).alias("r"))
    return last.select("node", F.col("r.ts").alias("last_seen"), *[F.col(f"r.{c}").alias(c) for c in rest])


def liveness(state: DataFrame, now: str, threshold_s: int = OFFLINE_AFTER_S) -> DataFrame:
    """Adds ``silent_s`` (whole seconds, not below 0) and ``alive``."""
    silent = F.greatest(F.lit(0).cast("long"), F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_seen"))
    return state.withColumn("silent_s", silent).withColumn("alive", F.col("silent_s") < threshold_s)


def derive_status(reports: DataFrame) -> DataFrame:
    return reports.withColumn("status", F.when(F.col("load_avg") > BUSY_LOAD, "Working").otherwise("Idle"))


def change_events(reports: DataFrame, profile: list[str] | None = None) -> DataFrame:
    """(node, seq, kind, detail): joins, updates of hardware, version and measures, changes of status.

    ``profile`` names the columns that describe the hardware; one update tells of both hardware and version.
    """
    w = Window.partitionBy("node").orderBy("ts", "seq")
    r = derive_status(reports).withColumn("prev", F.lag(F.struct("agent_version", "status", *(profile or []))).over(w))
    first = F.col("prev").isNull()
    version = ~F.col("agent_version").eqNullSafe(F.col("prev.agent_version"))
    hardware = F.lit(False)
    for c in profile or []:
        hardware = hardware | ~F.col(c).eqNullSafe(F.col("prev")[c])
    groups = F.concat_ws(",", F.when(hardware, "hardware"), F.when(version, "version"))
    event = lambda kind, detail, when: F.when(when, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    found = F.array_compact(F.array(
        event("Joined", F.lit("").cast("string"), first),
        event("Updated", groups, ~first & (hardware | version)),
        event("StateChanged", F.concat_ws(">", "prev.status", "status"), ~first & (F.col("status") != F.col("prev.status"))),
        event("Updated", F.lit("power,temp,load"), ~first & (F.col("verb") == "heartbeat")),
    ))
    return r.select("node", "seq", F.explode(found).alias("e")).select("node", "seq", "e.kind", "e.detail")


def merge_lanes(existing: DataFrame, reported: DataFrame) -> DataFrame:
    """Lanes by (node, iface): reported ones replace, new ones are added, silent ones stay; ``changed`` marks real differences."""
    values = ["bw", "latency", "jitter"]
    old = existing.select("node", "iface", F.struct(*values).alias("old"))
    new = reported.select("node", "iface", F.struct(*values).alias("new"))
    both = old.join(new, ["node", "iface"], "full")
    kept = F.coalesce("new", "old")
    return both.select("node", "iface", *[kept[v].alias(v) for v in values], (F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))


def recent_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.col("seq").desc()).limit(n)


def unregister(state: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state without the removed nodes, Left events of those that were there)."""
    left = removals.join(state.select("node"), "node", "left_semi").select("node", F.lit("Left").alias("kind"), "reason")
    return state.join(removals, "node", "left_anti"), left


def fleet_census(state: DataFrame, budget: int) -> DataFrame:
    """By site: nodes, online ones, what those draw, idle ones and the share of the budget that is left.

    A node that reports no draw counts its ``tdp``, if there is such a column.
    """
    watts = F.when(F.col("power_watts") > 0, F.col("power_watts")).otherwise(F.col("tdp")) if "tdp" in state.columns else F.col("power_watts")
    g = state.groupBy("site").agg(F.count("*").alias("total"), F.count_if("alive").alias("online"), F.sum(F.when(F.col("alive"), watts).otherwise(0)).alias("power"), F.count_if(F.col("alive") & (F.col("load_avg") > BUSY_LOAD)).alias("active"))
    return g.select("site", "total", "online", "power", (F.col("total") - F.col("active")).alias("idle"), (100 - (F.col("power") * 100 / budget).cast("long")).alias("headroom_pct"))


def overlay_live(live: DataFrame, static: DataFrame, *others: DataFrame) -> DataFrame:
    """Live rows, then of nodes that aren't live the rows of ``static``, then of each further source for nodes that no source before it has."""
    out = live
    for source in (static, *others):
        out = out.unionByName(source.join(out.select("node"), "node", "left_anti"))
    return out


def node_properties(state: DataFrame, overrides: DataFrame) -> DataFrame:
    """Long form (node, property, value); an override (node, property, value) wins and is marked."""
    spelled = {"power": F.concat(F.col("power_watts").cast("string"), F.lit("W")), "version": F.col("agent_version"), "seen": F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"), "status": F.col("status")}
    pairs = F.array(*[F.struct(F.lit(k).alias("property"), v.alias("value")) for k, v in spelled.items()])
    long = state.select("node", F.explode(pairs).alias("p")).select("node", "p.property", "p.value")
    o = overrides.withColumnRenamed("value", "over")
    return long.join(o, ["node", "property"], "left").select("node", "property", F.when(F.col("over").isNotNull(), F.concat("over", F.lit(" (live)"))).otherwise(F.col("value")).alias("value"))


def query_paths(paths: DataFrame, properties: DataFrame) -> DataFrame:
    """Answers ``n3.power`` style paths: segments of letters, digits and underscores, aliases resolved."""
    alias = {"p": "power", "v": "version", "s": "status", "t": "seen"}
    names = F.create_map(*[F.lit(x) for kv in alias.items() for x in kv])
    seg = F.split("path", r"\.")
    q = paths.withColumn("ok", F.col("path").rlike(r"^[A-Za-z0-9_]+\.[A-Za-z0-9_]+$")).withColumn("node", F.regexp_extract("path", r"^n([0-9]+)\.", 1).cast("long")).withColumn("property", F.coalesce(names[F.get(seg, F.lit(1))], F.get(seg, F.lit(1))))
    got = q.join(properties, ["node", "property"], "left")
    known = F.col("property").isin(*alias.values())
    return got.select("path", F.when(~F.col("ok"), "bad path").when(~known, F.concat(F.lit("unknown property: "), "property")).otherwise(F.coalesce("value", F.lit("unknown node"))).alias("answer"))


def version_drift(state: DataFrame, expected: str) -> DataFrame:
    current = F.col("agent_version") == expected
    return state.select("node", F.when(F.coalesce("agent_version", F.lit("")) == "", "-").otherwise(F.col("agent_version")).alias("version"), F.coalesce(current, F.lit(False)).alias("is_current"), (~F.col("alive")).alias("offline"))


def dedupe_discovered(found: DataFrame, known: DataFrame) -> DataFrame:
    """The first address of each hostname; ``slot`` is the known node with that address, else null."""
    w = Window.partitionBy("hostname").orderBy("address")
    one = found.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return one.join(known.select("address", F.col("node").alias("slot")), "address", "left").select("hostname", "address", "slot")


def controls_as_of(reports: DataFrame, controls: DataFrame) -> DataFrame:
    """Each report with the budget last set for its pool; a null budget clears. Controls come before reports at the same time.

    A pool of any size spreads over many tasks.
    """
    cell = F.struct(F.col("budget").alias("b"))
    both = controls.select("pool", "ts", F.lit(0).alias("side"), "seq", cell.alias("c")).unionByName(reports.select("pool", "ts", F.lit(1).alias("side"), "seq", F.lit(None).cast("struct<b:bigint>").alias("c")))
    r = running(both, ["pool"], ["ts", "side", "seq"], lasts={"last": "c"})
    return r.where("side = 1").select("pool", "seq", F.col("last.b").alias("budget"))


def control_changes(controls: DataFrame) -> DataFrame:
    """Marks controls whose content differs from the pool's current one; equal ones are skipped."""
    h = F.xxhash64("budget")
    before = F.lag(h).over(Window.partitionBy("pool").orderBy("ts", "seq"))
    return controls.select("pool", "seq", (before.isNull() | (h != before)).alias("applied"))


def derive_keys(df: DataFrame) -> DataFrame:
    """The first usable of uuid, board and product serial keys a machine, else its hostname; the id is the hostname's trailing number."""
    usable = lambda c: F.when((F.coalesce(F.trim(c), F.lit("")) != "") & ~F.lower(c).contains("to be filled"), F.col(c))
    source = F.coalesce(*[F.when(usable(c).isNotNull(), F.lit(c)) for c in ("uuid", "board_serial", "product_serial")], F.lit("hostname"))
    value = F.coalesce(*[usable(c) for c in ("uuid", "board_serial", "product_serial")], F.col("hostname"))
    digits = F.regexp_extract("hostname", r"([0-9]{2})$", 1)
    return df.select("hostname", source.alias("source"), F.concat(F.lit("b"), F.substring(F.sha2(value, 256), 1, 16)).alias("key"), F.when(digits != "", F.concat(F.lit("n"), digits.cast("int").cast("string"))).otherwise(F.concat(F.lit("n"), (F.col("idx") + 1).cast("string"))).alias("display_id"))


def allocate_ids(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids ``n{max+1}``... for new keys by first sight, however many come at one time."""
    top = existing.agg(F.coalesce(F.max(F.regexp_extract("id", r"^n([0-9]+)$", 1).try_cast("long")), F.lit(0)).alias("top"))  # one row
    first = new.groupBy("key").agg(F.min(F.struct("ts", "seq")).alias("at"))
    ranked = running(first, [], ["at", "key"], rank="rank").join(F.broadcast(top))
    return ranked.select("key", F.concat(F.lit("n"), (F.col("top") + F.col("rank")).cast("string")).alias("id"))


def accelerators(state: DataFrame) -> DataFrame:
    """(site, accelerator, n): models with their memory as ``model:MiB``, without the maker's prefix, and how many nodes have them."""
    short = F.concat_ws(":", F.replace("gpu_model", F.lit("NVIDIA GeForce "), F.lit("")), F.col("vram").cast("string"))
    return state.where("has_gpu").groupBy("site", short.alias("accelerator")).agg(F.count("*").alias("n"))


def drift_summary(drift: DataFrame) -> DataFrame:
    """(nodes, stale, offline) over the rows of ``version_drift``."""
    return drift.agg(F.count("*").alias("nodes"), F.count_if(~F.col("is_current")).alias("stale"), F.count_if("offline").alias("offline"))


def place_discovered(found: DataFrame, known: DataFrame) -> DataFrame:
    """(hostname, address, id, is_new): a known address keeps its node, the others get ``n{known + 1}``... in order of hostname."""
    placed = dedupe_discovered(found, known)
    top = known.agg(F.count("*").alias("top"))  # one row
    fresh = running(placed.where("slot is null"), [], ["hostname"], rank="rank").join(F.broadcast(top))
    told = lambda n: F.concat(F.lit("n"), n.cast("string")).alias("id")
    return placed.where("slot is not null").select("hostname", "address", told(F.col("slot")), F.lit(False).alias("is_new")).unionByName(fresh.select("hostname", "address", told(F.col("top") + F.col("rank")), F.lit(True).alias("is_new")))


def appetite_changes(frames: DataFrame, content: list[str] = ["workload", "budget", "latency", "profile"]) -> DataFrame:
    """(pool, seq, applied): a frame is applied if the hash over its ``content`` differs from the pool's frame before."""
    told = F.xxhash64(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))
    before = F.lag(told).over(Window.partitionBy("pool").orderBy("ts", "seq"))
    return frames.select("pool", "seq", (before.isNull() | (told != before)).alias("applied"))


# Names a property of a record answers to.
ALIASES = {"p": "power", "thermal": "temp", "t": "temp", "l": "load", "host": "hostname", "addr": "ip", "r": "ram", "c": "cpu", "s": "simd"}


def record_properties(records: DataFrame, overrides: DataFrame) -> DataFrame:
    """Long form (node, property, value) of whole records; an override (node, property, value) wins and is marked."""
    c = F.col
    text = lambda name: c(name).cast("string")
    simd = F.concat_ws(", ", F.when(c("has_avx2"), "AVX2"), F.when(c("has_avx"), "AVX"), F.when(c("has_sse42"), "SSE4.2"))
    told = {
        "power": F.concat(F.when(c("power_watts") > 0, c("power_watts")).otherwise(c("tdp")).cast("string"), F.lit("W")), "temp": F.concat(text("temp_c"), F.lit("C")), "load": F.format_string("%.2f", c("load_avg")),
        "status": text("status"), "state": F.when(c("alive"), "online").otherwise("offline"), "hostname": text("hostname"), "ip": text("ip"), "ram": F.concat(text("ram_mib"), F.lit("MiB")),
        "cpu": text("cpu_model"), "cores": text("cores"), "threads": text("threads"), "simd": F.when(simd == "", "none").otherwise(simd),
        "gpu": F.when(c("has_gpu"), F.concat(text("gpu_model"), F.lit(" ("), text("vram"), F.lit("MiB)"))).otherwise("none"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("property"), value.alias("value")) for k, value in told.items()])
    long = records.select("node", F.explode(pairs).alias("p")).select("node", "p.property", "p.value")
    over = overrides.withColumnRenamed("value", "over")
    return long.join(over, ["node", "property"], "left").select("node", "property", F.coalesce(F.concat("over", F.lit(" (live)")), "value").alias("value"))


def record_answers(paths: DataFrame, properties: DataFrame) -> DataFrame:
    """(path, answer) of paths ``node.property``: segments of letters, digits and underscores, blanks around them ignored, aliases resolved."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    seg = F.transform(F.split("path", r"\."), lambda s: F.trim(s))
    ok = (F.size(seg) == 2) & F.forall(seg, lambda s: s.rlike(r"^[\p{L}\p{N}_]+$"))
    asked = F.get(seg, F.lit(1))
    q = paths.select("path", ok.alias("ok"), F.get(seg, F.lit(0)).alias("node"), F.coalesce(names[asked], asked).alias("property"))
    known = F.col("property").isin(*["power", "temp", "load", "status", "state", "hostname", "ip", "ram", "cpu", "cores", "threads", "simd", "gpu"])
    got = q.join(properties, ["node", "property"], "left")
    return got.select("path", F.when(~F.col("ok"), "invalid path").when(~known, F.concat(F.lit("unknown property: "), "property")).otherwise(F.coalesce("value", F.lit("unknown node"))).alias("answer"))
