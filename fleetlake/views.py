"""Views that give the star-schema test tables the shapes of fleet tables.

Each view exists as a DataFrame and, in ``SQL``, as the same projection for the
oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of machines: one row an event."""
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_of(events: DataFrame) -> DataFrame:
    """Reports from events, be they a table or a stream."""
    return events.select(
        F.col("user_id").alias("node"), F.concat(F.lit("b"), "user_id").alias("node_id"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "register").when(F.col("event_type") == "error", "failure").otherwise("heartbeat").alias("verb"),
        F.floor("value").cast("int").alias("power_watts"), (F.col("value") / 100).alias("load_avg"),
        F.concat(F.lit("v"), F.floor(F.regexp_extract("props", r"([0-9]+)", 1).cast("int") / 50).cast("string")).alias("agent_version"),
        (F.col("user_id") % 25).alias("site"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("node"), (k % 3 == 0).alias("has_avx2"), (k % 3 < 2).alias("has_avx"), (k % 7 != 0).alias("has_sse42"), (k % 5 == 0).alias("has_gpu"), (k % 4 * 4096).alias("vram"), (15 + k % 90).alias("tdp"), F.col("s_nationkey").alias("site"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ["branch_sort", "recursive_tree", "matrix_multiply", "irregular_graph", "small_batch", "llm_inference", "gpu_render", "other"]))
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("task"), F.concat("o_orderpriority", F.date_format("o_orderdate", "yyyyMM")).alias("pool"), F.col("o_orderdate").alias("enqueued"), (10 + F.col("o_custkey") % 50).alias("watts"),
        (k % 4).alias("priority"), F.element_at(words, (k % 8 + 1).cast("int")).alias("name"), F.timestamp_add("DAY", (k % 30).cast("int"), F.col("o_orderdate")).alias("deadline"),
    )


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest report of each interface."""
    li = table(spark, sf_dir, "lineitem")
    report = F.struct("l_shipdate", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    last = li.groupBy(F.col("l_suppkey").alias("node"), F.concat(F.lit("if"), "l_linenumber").alias("iface")).agg(F.max(report).alias("r"))
    return last.select("node", "iface", (F.col("r.l_quantity") * 20).alias("bw"), (F.col("r.l_extendedprice").cast("long") % 1000).alias("latency"), F.round(F.col("r.l_discount") * 1000).cast("int").alias("jitter"))


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control settings by pool; a null budget clears."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select((F.col("user_id") % 10).alias("pool"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 != 0, F.floor("value")).alias("budget"))


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), "ts", F.col("event_id").alias("seq"), F.round(F.col("value") * 1e6 * (1 + F.col("event_id") % 7)).cast("long").alias("uj"))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("shard"), F.col("l_linenumber").alias("start"), F.col("l_shipdate").alias("staged_at"), F.col("l_quantity").alias("bytes"), F.col("l_returnflag").alias("epoch"), F.col("l_orderkey").alias("seq"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    name = F.when(p == 7, "token_embd.w").when(p == 8, "output_norm.w").when(p % 31 == 0, F.concat(F.lit("v.blk."), (p % 64).cast("string"))).otherwise(F.concat(F.lit("blk."), (p % 64).cast("string"), F.lit(".w")))
    return table(spark, sf_dir, "part").select(p.alias("item"), name.alias("name"), F.col("p_size").cast("long").alias("bytes"), F.col("p_brand").alias("grp"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("seq"), F.col("embedding").cast("array<double>").alias("x"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "token"))
    return c.select("conv_id", "turn", "i", "token")


#: The same views as common table expressions.
SQL = {
    "telemetry": """telemetry AS (SELECT user_id AS node, concat('b', user_id) AS node_id, ts, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'failure' ELSE 'heartbeat' END AS verb,
  CAST(floor(value) AS INTEGER) AS power_watts, value / 100 AS load_avg,
  concat('v', CAST(regexp_extract(props, '[0-9]+') AS INTEGER) // 50) AS agent_version, user_id % 25 AS site FROM events)""",
    "nodes": """nodes AS (SELECT s_suppkey AS node, s_suppkey % 3 = 0 AS has_avx2, s_suppkey % 3 < 2 AS has_avx, s_suppkey % 7 <> 0 AS has_sse42,
  s_suppkey % 5 = 0 AS has_gpu, s_suppkey % 4 * 4096 AS vram, 15 + s_suppkey % 90 AS tdp, s_nationkey AS site FROM supplier)""",
    "tasks": """tasks AS (SELECT o_orderkey AS task, concat(o_orderpriority, strftime(o_orderdate, '%Y%m')) AS pool, o_orderdate AS enqueued,
  10 + o_custkey % 50 AS watts, o_orderkey % 4 AS priority,
  ['branch_sort','recursive_tree','matrix_multiply','irregular_graph','small_batch','llm_inference','gpu_render','other'][o_orderkey % 8 + 1] AS name,
  o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS deadline FROM orders)""",
    "lanes": """lanes AS (SELECT node, iface, q * 20 AS bw, CAST(trunc(e) AS BIGINT) % 1000 AS latency, CAST(round(d * 1000) AS INTEGER) AS jitter FROM (
  SELECT l_suppkey AS node, concat('if', l_linenumber) AS iface, l_quantity AS q, l_extendedprice AS e, l_discount AS d,
  row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC) AS k FROM lineitem) WHERE k = 1)""",
    "controls": """controls AS (SELECT user_id % 10 AS pool, ts, event_id AS seq, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS BIGINT) END AS budget FROM events WHERE event_type = 'purchase')""",
    "counter": """counter AS (SELECT user_id AS node, ts, event_id AS seq, CAST(round(value * 1e6 * (1 + event_id % 7)) AS BIGINT) AS uj FROM events)""",
    "staged": """staged AS (SELECT l_suppkey AS shard, l_linenumber AS start, l_shipdate AS staged_at, l_quantity AS bytes, l_returnflag AS epoch, l_orderkey AS seq FROM lineitem)""",
    "items": """items AS (SELECT p_partkey AS item, CASE WHEN p_partkey = 7 THEN 'token_embd.w' WHEN p_partkey = 8 THEN 'output_norm.w'
  WHEN p_partkey % 31 = 0 THEN concat('v.blk.', p_partkey % 64) ELSE concat('blk.', p_partkey % 64, '.w') END AS name, CAST(p_size AS BIGINT) AS bytes, p_brand AS grp FROM part)""",
    "vectors": """vectors AS (SELECT vec_id AS id, label AS seq, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)""",
    "words": """words AS (SELECT conv_id, turn, i - 1 AS i, w[i] AS token FROM (SELECT conv_id, turn, string_split(text, ' ') AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations))""",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
