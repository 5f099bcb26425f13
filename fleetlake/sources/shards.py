"""Shard files: a header, a JSON table of tensors and their bytes; and text that probes print."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.operators.scans import running

# The header is magic, version, node (two bytes each), tensors and length of the table, all little-endian.
MAGIC, VERSION, HEADER = 0x4F55524F, 1, 16


def turned(b, n: int):
    """The first ``n`` bytes in the other order."""
    return F.concat(*[F.substring(b, i, 1) for i in range(n, 0, -1)])


def le_bytes(col, n: int):
    return turned(F.unhex(F.lpad(F.hex(col.cast("long")), 2 * n, "0")), n)


def le_number(data, at: int, n: int):
    return F.conv(F.hex(turned(F.substring(data, at + 1, n), n)), 16, 10).cast("long")


def layout_shards(items: DataFrame) -> DataFrame:
    """Adds ``start``, where the bytes of an item begin in its group's file (items in order); a group of any size spreads over many tasks."""
    r = running(items, ["grp"], ["item"], sums={"start": "bytes"})
    return r.withColumn("start", (F.col("start") - F.coalesce("bytes", F.lit(0))).cast("long"))


def shard_heads(layout: DataFrame, node: int = 1) -> DataFrame:
    """(grp, content): header and table of each group's file; the tensors' bytes follow them at their places."""
    meta = F.to_json(F.array_sort(F.collect_list(F.struct("start", "bytes", "name", "item"))))
    t = layout.groupBy("grp").agg(F.count("*").alias("n"), meta.alias("meta"))
    table = F.encode("meta", "UTF-8")
    head = F.concat(le_bytes(F.lit(MAGIC), 4), le_bytes(F.lit(VERSION), 2), le_bytes(F.lit(node), 2), le_bytes(F.col("n"), 4), le_bytes(F.octet_length(table), 4))
    return t.select("grp", F.concat(head, table).alias("content"))


def scan_shards(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tensors, errors with a reason) of binary files in ``content``; other columns stay."""
    c = F.col("content")
    keep = [x for x in files.columns if x != "content"]
    size = le_number(c, 12, 4)
    body = F.decode(F.substring(c, HEADER + 1, size.cast("int")), "UTF-8")
    parsed = F.from_json(body, "array<struct<start:long,bytes:long,name:string,item:long>>")
    r = files.select(*keep, F.octet_length(c).alias("length"), le_number(c, 0, 4).alias("magic"), le_number(c, 4, 2).alias("version"), le_number(c, 8, 4).alias("n"), size.alias("size"), parsed.alias("t"))
    reason = (
        F.when(F.col("length") < HEADER, "too short").when(F.col("magic") != MAGIC, "bad magic").when(F.col("length") < HEADER + F.col("size"), "truncated meta")
        .when(F.col("version") != VERSION, "unsupported version").when(F.col("t").isNull() | (F.size("t") != F.col("n")), "count mismatch")
    )
    judged = r.withColumn("reason", reason)
    good = judged.where("reason is null").select(*keep, F.explode("t").alias("x")).select(*keep, "x.*")
    return good, judged.where("reason is not null").select(*keep, "reason")


# How processors name what the columns tell.
CPU_FLAGS = {"has_avx": "avx", "has_avx2": "avx2", "has_sse42": "sse4_2"}


def parse_probe_logs(logs: DataFrame) -> DataFrame:
    """Numbers out of what ping, radio and GPU tools print in ``text``; what is missing is 0 or null."""
    number = r"[0-9]+(?:\.[0-9]+)?"
    ping = F.split(F.regexp_extract("text", rf"= ({number}(?:/{number})*) ms", 1), "/")
    part = lambda i: F.when(F.size(ping) == 4, (F.get(ping, F.lit(i)).cast("double") * 1000).cast("int")).otherwise(0)
    found = lambda pattern: F.regexp_extract("text", pattern, 1)
    rate, unit = found(rf"tx bitrate: ({number})"), found(rf"tx bitrate: {number} (\S+)")
    gpu = F.split(found(r"(?m)^([^,\n]+, [^,\n]+, [^,\n]+, [^,\n]+)$"), ", ")
    vram = F.expr("try_cast(x as int)")
    r = logs.select(
        *[c for c in logs.columns if c != "text"], part(1).alias("latency_us"), part(3).alias("jitter_us"),
        F.when(found(r"signal: (-?[0-9]+)") != "", found(r"signal: (-?[0-9]+)").cast("int")).otherwise(0).alias("signal_dbm"),
        F.when(rate == "", 0).otherwise(F.when(unit == "MB/s", F.expr("8.0")).otherwise(1.0) * F.when(rate != "", rate.cast("double"))).cast("int").alias("bw_mbps"),
        F.get(gpu, F.lit(0)).alias("model"), F.get(gpu, F.lit(1)).alias("x"), F.get(gpu, F.lit(2)).alias("driver"), F.get(gpu, F.lit(3)).alias("compute_cap"),
        *[F.col("text").rlike(rf"\b{flag}\b").alias(name) for name, flag in CPU_FLAGS.items()],
    )
    r = r.withColumn("vram", vram).drop("x")
    return r.withColumns({c: F.when(F.col("vram").isNotNull(), F.col(c)) for c in ("model", "driver", "compute_cap")})
