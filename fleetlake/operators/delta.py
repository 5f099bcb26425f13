"""Content identity and delta sync of large binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fleetlake.storage import written


def epoch(df: DataFrame, col: str = "data") -> DataFrame:
    """Adds ``epoch``, the SHA-256 of the bytes."""
    return df.withColumn("epoch", F.sha2(col, 256))


def chunk_index(df: DataFrame, size: int = 65536, col: str = "data") -> DataFrame:
    """(id, idx, length, hash, chunk): fixed-size chunks, the last one short; no bytes, no chunk."""
    n = F.octet_length(col)
    cut = df.where(n > 0).select("id", F.col(col).alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size))).alias("idx"))
    piece = F.substring("d", (F.col("idx") * size + 1).cast("int"), F.lit(size))
    return cut.select("id", "idx", piece.alias("chunk")).select("id", "idx", F.octet_length("chunk").cast("long").alias("length"), F.sha2("chunk", 256).alias("hash"), "chunk")


def verify_epoch(df: DataFrame, col: str = "data") -> DataFrame:
    """An empty declaration holds for anything."""
    return df.select("id", ((F.col("declared") == "") | (F.sha2(col, 256) == F.col("declared"))).alias("verified"))


def plan_pull(lengths: DataFrame, size: int = 65536) -> DataFrame:
    """Ranges from the local end to the remote end, cut at chunk borders; a shorter remote is an error row."""
    bad = F.col("remote_len") < F.col("local_len")
    first, last = F.floor(F.col("local_len") / size), F.floor((F.col("remote_len") - 1) / size)
    at = F.when(bad, F.array(F.lit(-1).cast("long"))).when(F.col("remote_len") == F.col("local_len"), F.array().cast("array<bigint>")).otherwise(F.sequence(first, last))
    r = lengths.select("id", "local_len", "remote_len", F.explode(at).alias("idx"))
    start = F.greatest(F.col("local_len"), F.col("idx") * size)
    end = F.least(F.col("remote_len"), (F.col("idx") + 1) * size)
    ok = F.col("idx") >= 0
    return r.select("id", "idx", F.when(ok, start).alias("start"), F.when(ok, end - start).alias("length"), F.when(ok, "ok").otherwise("remote shorter").alias("status"))


def plan_diff(local: DataFrame, remote: DataFrame, size: int = 65536) -> DataFrame:
    """(id, idx, length) of chunks that differ between equally long binaries; only hashes meet."""
    lengths = lambda df: df.select("id", F.octet_length("data").alias("n"))
    same = lengths(local).join(lengths(remote), ["id", "n"]).select("id")
    a = chunk_index(local, size).select("id", "idx", F.col("hash").alias("h"))
    b = chunk_index(remote, size).select("id", "idx", "length", "hash")
    return b.join(a, ["id", "idx"]).where("h <> hash").join(same, "id", "left_semi").select("id", "idx", "length")


def stage_retention(staged: DataFrame, max_bytes: float, ttl_days: int, now: str) -> DataFrame:
    """By shard: the latest write of each place, not too old, the newest up to ``max_bytes``."""
    last = staged.groupBy("shard", "start").agg(F.max(F.struct("staged_at", "seq", "bytes", "epoch")).alias("r")).select("shard", "start", "r.*")
    fresh = last.where(F.col("staged_at") > F.timestamp_add("DAY", F.lit(-ttl_days), F.lit(now).cast("timestamp")))
    w = Window.partitionBy("shard").orderBy(F.col("staged_at").desc(), F.col("seq").desc(), "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return fresh.withColumn("held", F.sum("bytes").over(w)).where(F.col("held") <= max_bytes).select("shard", "start", "epoch", "bytes")


def claim(staged: DataFrame, plan: DataFrame) -> DataFrame:
    """Staged chunks with the plan's shard, place and epoch."""
    return staged.join(plan, ["shard", "start", "epoch"], "left_semi")


def stale_adverts(adverts: DataFrame, local: DataFrame) -> DataFrame:
    have = local.select("shard", F.col("epoch").alias("have"))
    return adverts.join(have, "shard", "left").select("shard", "epoch", (~F.col("epoch").eqNullSafe(F.col("have"))).alias("need_pull"))


def check_artifacts(manifests: DataFrame, artifacts: DataFrame, kind: str, protocol: int) -> DataFrame:
    """The first reason against each artifact, or ok."""
    both = manifests.join(artifacts, "name", "left")
    reason = F.when(F.col("kind") != kind, "kind").when(F.col("min_protocol") > protocol, "protocol").when(F.col("real_size").isNull(), "missing").when(F.col("real_size") != F.col("size"), "size").when(F.col("real_sha") != F.col("sha"), "sha256").otherwise("ok")
    return both.select("name", reason.alias("reason"))


def neighbors(stages: DataFrame, ranking: DataFrame | None = None) -> DataFrame:
    """(plan, pos, prefetch): the stages to fetch ahead, the one before and the one after.

    Where ``ranking`` (plan, pos, stage, rank) has rows for a place, its stages take their place, best rank first.
    """
    w = Window.partitionBy("plan").orderBy("pos")
    if ranking is not None:
        planned = ranking.groupBy("plan", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "stage"))), lambda r: r["stage"]).alias("planned"))
        return neighbors(stages).join(planned, ["plan", "pos"], "left").select("plan", "pos", F.coalesce("planned", "prefetch").alias("prefetch"))
    return stages.select("plan", "pos", F.array_compact(F.array(F.lag("stage").over(w), F.lead("stage").over(w))).alias("prefetch"))


def rebuild(local: DataFrame, overlays: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, status, epoch, data): local bytes with (id, start, bytes) laid over them, published only if the epoch is the expected one.

    Overlays don't overlap. Each brings the local bytes between the one before and
    itself, zeros beyond the local end, so one ordered join of pieces does.
    """
    w = Window.partitionBy("id").orderBy("start")
    held = overlays.join(local.select("id", "data"), "id").withColumn("end", F.col("start") + F.octet_length("bytes")).withColumn("prev", F.coalesce(F.lag("end").over(w), F.lit(0)))
    n = (F.col("start") - F.col("prev")).cast("int")
    gap = F.expr("rpad(substring(data, cast(prev + 1 as int), cast(start - prev as int)), cast(start - prev as int), X'00')")
    piece = F.concat(F.when(n > 0, F.hex(gap)).otherwise(""), F.hex("bytes"))
    whole = held.select("id", "start", "end", piece.alias("h")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "h"))).alias("parts"), F.max("end").alias("end"))
    joined = local.select("id", "data").join(whole, "id", "left").join(expected.select("id", "expected"), "id")
    laid = F.concat(F.unhex(F.array_join(F.transform("parts", lambda x: x["h"]), "")), F.expr("substring(data, cast(end + 1 as int))"))
    made = joined.select("id", "expected", F.when(F.col("parts").isNull(), F.col("data")).otherwise(laid).alias("data"))
    good = F.sha2("data", 256) == F.col("expected")
    return made.select("id", F.when(good, "published").otherwise("epoch mismatch").alias("status"), F.when(good, F.col("expected")).alias("epoch"), F.when(good, F.col("data")).alias("data"))


def _laid(batches, key_type):
    """Pieces in order with overlays over them, and at the end of each file a row with its digest. Keeps one piece at a time."""
    import hashlib

    import pyarrow as pa

    key, sha, at, rest, covered = None, None, 0, None, 0
    out: list[tuple] = []

    def emit(b: bytes) -> None:
        nonlocal at
        if b:
            sha.update(b)
            out.append((key, at, b, None))
            at += len(b)

    def up_to(end: int) -> None:
        """What is left of the last local piece, then zeros."""
        nonlocal rest
        if rest:
            start, b = rest
            emit(b[at - start : max(at, end) - start])
            rest = rest if at < start + len(b) else None
        while at < end:
            emit(bytes(min(end - at, 1 << 20)))

    def close() -> None:
        up_to(rest[0] + len(rest[1]) if rest else 0)
        out.append((key, None, None, sha.hexdigest()))

    def batch():
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((key_type, pa.int64(), pa.binary(), pa.string()))]
        out.clear()
        return pa.record_batch(columns, names=["id", "start", "bytes", "epoch"])

    for b in batches:
        for k, start, over, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if sha is None or k != key:
                if sha is not None:
                    close()
                key, sha, at, rest, covered = k, hashlib.sha256(), 0, None, 0
            piece = piece or b""
            if over and start < covered:
                raise ValueError(f"overlays of {k} overlap at {start}")
            if start >= at:
                up_to(start)
            if over:
                emit(piece)
                covered = start + len(piece)
            elif start + len(piece) > at:
                rest = (start, piece)
        yield batch()
    if sha is not None:
        close()
        yield batch()


def rebuild_pieces(local: DataFrame, overlays: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, status, epoch), published pieces (id, start, bytes)) of files in pieces (id, start, bytes) with overlays laid over them.

    A file's pieces pass in order through one task, which carries the digest and keeps
    one piece; no row ever holds a file. Gaps are zeros. Local pieces don't overlap, nor
    do overlays. Pieces of a file are published only if its epoch is the ``expected`` (id, expected) one.
    """
    kind = local.schema["id"].dataType
    rows = local.select("id", "start", F.lit(False).alias("over"), "bytes").unionByName(overlays.select("id", "start", F.lit(True).alias("over"), "bytes"))
    dealt = rows.repartition("id").sortWithinPartitions("id", "start", "over")
    key_type = to_arrow_type(kind)
    laid = written(dealt.mapInArrow(lambda it: _laid(it, key_type), f"id {kind.simpleString()}, start long, bytes binary, epoch string"), "pieces")
    told = laid.where("epoch is not null").select("id", "epoch").join(expected, "id")
    good = F.col("epoch") == F.col("expected")
    status = told.select("id", F.when(good, "published").otherwise("epoch mismatch").alias("status"), F.when(good, F.col("epoch")).alias("epoch"))
    return status, laid.where("epoch is null").join(status.where("status = 'published'").select("id"), "id", "left_semi").select("id", "start", "bytes")


def plan_sync(local: DataFrame, remote: DataFrame, size: int = 65536) -> DataFrame:
    """(id, idx, start, length, status): chunks that differ if both are equally long, else the ranges of ``plan_pull``."""
    n = lambda df, c: df.select("id", F.octet_length("data").cast("long").alias(c))
    uneven = n(local, "local_len").join(n(remote, "remote_len"), "id").where("local_len <> remote_len")
    even = plan_diff(local, remote, size).select("id", "idx", (F.col("idx") * size).alias("start"), "length", F.lit("ok").alias("status"))
    return even.unionByName(plan_pull(uneven, size))
