"""Telemetry lines, signed logs, sequence audits and device names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fields of a report and what stands for a missing one; the hostname has no default.
DEFAULTS = {
    "cpu_model": ("string", ""), "cores": ("int", 0), "threads": ("int", 0), "has_avx": ("boolean", False), "has_avx2": ("boolean", False), "has_sse42": ("boolean", False),
    "ram_total_mib": ("long", 0), "power_watts": ("int", 0), "temp_c": ("int", 0), "load_avg": ("double", 0.0), "agent_version": ("string", ""), "image_rev": ("string", ""), "node_id": ("string", ""),
}
LISTS = {"gpus": "array<struct<vendor:string,model:string,vram_mib:long,driver:string,compute_cap:string,vulkan_api:string>>", "edges": "array<struct<iface:string,kind:string,bw_mbps:long,latency_us:long,jitter_us:long,watts:long,signal_dbm:int>>"}
SCHEMA = ", ".join(["hostname string", *[f"{c} {kind}" for c, (kind, _) in DEFAULTS.items()], *[f"{c} {kind}" for c, kind in LISTS.items()], "_bad string"])


def read_telemetry(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows with defaults, bad lines with a reason); the hostname has no default."""
    parsed = lines.select("*", F.from_json("line", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    ok = F.col("j").isNotNull() & F.col("j._bad").isNull() & F.col("j.hostname").isNotNull()
    keep = [c for c in lines.columns if c != "line"]
    plain = [F.coalesce(f"j.{c}", F.lit(value).cast(kind)).alias(c) for c, (kind, value) in DEFAULTS.items()]
    lists = [F.coalesce(f"j.{c}", F.array().cast(kind)).alias(c) for c, kind in LISTS.items()]
    good = parsed.where(ok).select(*keep, "j.hostname", *plain, *lists)
    return good, parsed.where(~F.coalesce(ok, F.lit(False))).select(*keep, F.lit("bad-json").alias("reason"))


def _hmac(key: bytes, message):
    """HMAC-SHA256 as hex from two hashes."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def sign(seq, body, key: bytes):
    """Tag over the sequence number as eight big-endian bytes and the body."""
    return _hmac(key, F.concat(F.unhex(F.lpad(F.hex(seq), 16, "0")), F.encode(body, "UTF-8")))


def verify_signed_log(lines: DataFrame, key: bytes) -> DataFrame:
    """(…, seq, body, valid) of lines ``seq tag body``; any failure is the same."""
    part = F.split("line", " ", 3)
    seq = F.expr("try_cast(get(split(line, ' ', 3), 0) as bigint)")
    body, tag = F.get(part, F.lit(2)), F.get(part, F.lit(1))
    valid = F.coalesce(sign(seq, body, key) == tag, F.lit(False))
    return lines.select(*[c for c in lines.columns if c != "line"], seq.alias("line_seq"), body.alias("body"), valid.alias("valid"))


def audit_sequence(frames: DataFrame) -> DataFrame:
    """By stream: the first frame out of order (expected 1, 2, ...) and the last good number. Needs arrival order ``ord``."""
    w = Window.partitionBy("stream").orderBy("ord")
    r = frames.withColumn("expected", F.row_number().over(w)).withColumn("bad", F.col("seq") != F.col("expected"))
    first = F.min(F.when(F.col("bad"), F.col("expected")))
    return r.groupBy("stream").agg(first.alias("first_bad"), F.count("*").alias("n")).select("stream", "first_bad", F.coalesce(F.col("first_bad") - 1, F.col("n")).cast("long").alias("high_water"))


def _grams(name: str, q: int):
    """The different runs of ``q`` characters."""
    n = F.char_length(name)
    return F.array_distinct(F.transform(F.when(n >= q, F.sequence(F.lit(1), n - q + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col(name), i, F.lit(q))))


def containing(short: DataFrame, long: DataFrame, q: int = 3) -> DataFrame:
    """(s, l): names ``s`` of ``short`` that stand in names ``l`` of ``long``, both not empty and each once.

    A short name is looked up by its rarest run of ``q`` characters, a name shorter than
    that by all of itself; the other side has a row for each of its runs that some name is
    looked up by. Containment is then checked in full.
    """
    s, t = short.where("s <> ''").distinct(), long.where("l <> ''").distinct()
    runs = t.select("l", F.explode(_grams("l", q)).alias("g"))
    often = runs.groupBy("g").count()
    asked = s.where(F.char_length("s") >= q).select("s", F.explode(_grams("s", q)).alias("g")).join(often, "g", "left")
    # A run that no long name has, comes first and finds nothing.
    rarest = asked.groupBy("s").agg(F.min_by("g", F.struct(F.coalesce("count", F.lit(0)), "g")).alias("g"))
    found = rarest.join(runs, "g").where(F.col("l").contains(F.col("s"))).select("s", "l")
    for n in range(1, q):
        whole = s.where(F.char_length("s") == n)
        found = found.unionByName(whole.join(t.select("l", F.explode(_grams("l", n)).alias("s")), "s").select("s", "l"))
    return found


def match_devices(a: DataFrame, b: DataFrame, q: int = 3) -> DataFrame:
    """(name, device): each name of ``a`` with the first of ``b``, by ``ord``, that equals, contains or is contained in it.

    Either side may be large. Null names match nothing; an empty one is contained in every name.
    """
    names = a.select("name").distinct()
    listed = b.where("name is not null").groupBy(F.col("name").alias("other")).agg(F.min("ord").alias("ord"))
    theirs = listed.select(F.col("other").alias("s"))
    inside = containing(theirs, names.select(F.col("name").alias("l")), q).select(F.col("l").alias("name"), F.col("s").alias("other"))
    around = containing(names.select(F.col("name").alias("s")), theirs.select(F.col("s").alias("l")), q).select(F.col("s").alias("name"), F.col("l").alias("other"))
    best = F.min(F.struct("ord", "other")).alias("m")
    pairs = inside.unionByName(around).distinct().join(listed, "other").groupBy("name").agg(best)
    blank, any_ = listed.where("other = ''").agg(best).select(F.col("m").alias("blank")), listed.agg(best).select(F.col("m").alias("first"))  # a row each
    r = names.join(pairs, "name", "left").join(F.broadcast(blank)).join(F.broadcast(any_))
    m = F.when(F.col("name") == "", F.col("first")).when(F.col("name").isNotNull(), F.when(F.col("m").isNull() | (F.col("blank") < F.col("m")), F.coalesce("blank", "m")).otherwise(F.col("m")))
    return r.select("name", m["other"].alias("device"))


def audit_frames(frames: DataFrame) -> DataFrame:
    """(stream, first_bad, reason, high_water) of frames (stream, ord, seq, is_ack, is_eof, acked).

    Data frames count up from 1; an end frame carries the number expected next and
    doesn't take it. Acknowledgements have no number of their own, but what they
    acknowledge must not fall. Nothing after a stream's first bad frame counts.
    """
    w = Window.partitionBy("stream").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    data = (~F.col("is_ack") & ~F.col("is_eof")).cast("long")
    r = frames.withColumn("expected", F.coalesce(F.sum(data).over(w), F.lit(0)) + 1).withColumn("highest", F.coalesce(F.max(F.when(F.col("is_ack"), F.col("acked"))).over(w), F.lit(0)))
    back, off = F.col("is_ack") & (F.col("acked") < F.col("highest")), ~F.col("is_ack") & ~F.col("seq").eqNullSafe(F.col("expected"))
    r = r.withColumn("reason", F.when(back, "ack went backwards").when(off, "out of order"))
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("ord", "reason", "expected")))
    g = r.groupBy("stream").agg(first.alias("b"), F.sum(data).alias("n"))
    return g.select("stream", F.col("b.ord").alias("first_bad"), F.col("b.reason").alias("reason"), F.coalesce(F.col("b.expected") - 1, F.col("n")).cast("long").alias("high_water"))
