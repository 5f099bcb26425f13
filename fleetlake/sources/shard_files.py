"""Shard files as a data source of Spark: a sink whose driver commits, and a scan of headers and tables only.

A group's tensors lie in order in files of bounded size, ``<group>-<volume>.shard``, each
with header, JSON table and bytes as in ``sources.shards``. Paths are of any file
system that pyarrow knows; on a cluster they have to be shared.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from fleetlake.operators.scans import running
from fleetlake.sources.shards import HEADER, MAGIC, VERSION
from fleetlake.storage import bounded_batches, written

FORMAT = "fleetlake_shards"
#: What an item takes of a volume beside its bytes: about its entry in the table, so that a table is bounded too.
ENTRY = 64
HEAD = "path string, grp string, volume long, node int, item long, name string, start long, bytes long, reason string"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def full_path(folder: str, path: str) -> str:
    """A file's path with the scheme and host that its folder was given with."""
    _, root = file_system(folder)
    return folder.rstrip("/")[: -len(root)] + path if folder.rstrip("/").endswith(root) else path


def file_name(grp: str, volume: int) -> str:
    return f"{quote(grp, safe='')}-{volume}.shard"


def file_key(path: str) -> tuple[str, int]:
    """(group, volume) of a file's name."""
    grp, _, volume = posixpath.basename(path).removesuffix(".shard").rpartition("-")
    return unquote(grp), int(volume) if volume.isdecimal() else -1


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where they are now."""

    files: list[str]


class ShardWriter(DataSourceArrowWriter):
    """Each attempt of a task writes into a folder of its own; only the driver's commit moves files to their names.

    Rows come sorted by (grp, volume, start), a volume in one task. A null start is where the item before ends. A task that dies or
    runs twice leaves files that no message names; commit and abort delete them.
    """

    def __init__(self, path: str, node: int, overwrite: bool):
        self.path, self.node, self.overwrite = path, node, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        fs, root = file_system(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        done: list[str] = []
        key, table, parts, end, before = None, [], [], 0, None

        def close() -> None:
            meta = json.dumps(table, separators=(",", ":"), ensure_ascii=False).encode()
            with fs.open_output_stream(f"{folder}/{file_name(*key)}") as out:
                out.write(struct.pack("<IHHII", MAGIC, VERSION, self.node, len(table), len(meta)))
                for b in (meta, *parts):
                    out.write(b)
            done.append(f"{folder}/{file_name(*key)}")

        for batch in iterator:
            for grp, volume, start, item, name, payload in zip(*(batch.column(c).to_pylist() for c in ("grp", "volume", "start", "item", "name", "payload")), strict=True):
                if key != (grp, volume):
                    if key is not None:
                        close()
                    key, table, parts, end, before = (grp, volume), [], [], 0, None
                again = (item, start, len(payload)) == before
                if start is not None and start != end and not again:
                    raise ValueError(f"item {item} of {grp} starts at {start} and not at {end}")
                before = (item, start, len(payload))
                table.append({"start": end, "bytes": len(payload), "name": name, "item": item})
                parts.append(payload)
                end += len(payload)
        if key is not None:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        new = {posixpath.basename(f): f for m in messages if m for f in m.files}
        old = {posixpath.basename(f.path) for f in _files(self.path)}
        if not self.overwrite and old & set(new):
            self.abort(messages)
            raise FileExistsError(f"{min(old & set(new))} exists in {self.path}")
        for name, staged in new.items():
            fs.move(staged, f"{root}/{name}")
        for name in (old - set(new)) if self.overwrite else ():
            fs.delete_file(f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs as kinds

        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/{self.staging}").type == kinds.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


def _files(path: str) -> list:
    from pyarrow import fs as kinds

    fs, root = file_system(path)
    found = fs.get_file_info(kinds.FileSelector(root, allow_not_found=True))
    return sorted((f for f in found if f.type == kinds.FileType.File and f.path.endswith(".shard")), key=lambda f: f.path)


def read_head(fs, path: str) -> tuple[int | None, list[tuple] | str]:
    """(node, [(item, name, start, bytes)] or what is wrong): reads a file's header and table and nothing behind them."""
    try:
        stream = fs.open_input_file(path)
    except FileNotFoundError:
        return None, "missing"
    with stream:
        size = stream.size()
        if size < HEADER:
            return None, "too short"
        magic, version, node, n, length = struct.unpack("<IHHII", stream.read_at(HEADER, 0))
        if magic != MAGIC:
            return None, "bad magic"
        if size < HEADER + length:
            return None, "truncated meta"
        if version != VERSION:
            return None, "unsupported version"
        try:
            table = [(x["item"], x["name"], int(x["start"]), int(x["bytes"])) for x in json.loads(stream.read_at(length, HEADER))]
        except (ValueError, TypeError, KeyError):
            return None, "count mismatch"
        return (node, table) if len(table) == n else (None, "count mismatch")


@dataclass
class Heads(InputPartition):
    files: list[str]


class HeadReader(DataSourceReader):
    """Headers and tables of the files of a folder; filters on ``grp`` leave out files by their names."""

    def __init__(self, path: str, files_a_task: int):
        self.path, self.files_a_task = path, files_a_task
        self.groups: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("grp",):
                self.groups = wanted if self.groups is None else self.groups & wanted
            yield f  # Spark looks at the rows once more

    def partitions(self):
        files = [f.path for f in _files(self.path) if self.groups is None or file_key(f.path)[0] in self.groups]
        return [Heads(files[i : i + self.files_a_task]) for i in range(0, len(files), self.files_a_task)] or [Heads([])]

    def read(self, partition: Heads):
        fs, _ = file_system(self.path)
        for path in partition.files:
            grp, volume = file_key(path)
            node, table = read_head(fs, path)
            path = full_path(self.path, path)
            if isinstance(table, str):
                yield path, grp, volume, None, None, None, None, None, table
            else:
                for item, name, start, size in table:
                    yield path, grp, volume, node, item, name, start, size, None


class ShardFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return HEAD

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options["path"], int(self.options.get("files_a_task", 64)))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options.get("node", 1)), overwrite)


def _item_rows(items: DataFrame) -> DataFrame:
    """Null groups and payloads are empty; ``h`` puts items that repeat one in order."""
    payload = F.coalesce("payload", F.lit(b""))
    return items.select(F.coalesce("grp", F.lit("")).alias("grp"), F.col("item").cast("long").alias("item"), "name", payload.alias("payload"), F.xxhash64(payload).alias("h"))


def _places(rows: DataFrame, max_bytes: int) -> DataFrame:
    """(grp, item, h, bytes, volume, start in the group) from lengths alone; equal items of a group are one row."""
    sizes = rows.groupBy("grp", "item", "h").agg(F.max(F.octet_length("payload")).cast("long").alias("bytes"), F.count("*").alias("n"))
    sizes = sizes.withColumn("all", F.col("bytes") * F.col("n")).withColumn("cost", F.col("all") + ENTRY * F.col("n"))
    r = running(sizes, ["grp"], ["item", "h"], sums={"end": "all", "spent": "cost"})
    return r.withColumn("volume", F.floor((F.col("spent") - F.col("cost")) / max_bytes)).withColumn("start", F.col("end") - F.col("all"))


def layout_volumes(items: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """(grp, volume, start, item, name, payload) of items (grp, item, name, payload): where each one lies.

    Items go in order of ``item``, those that repeat one by a hash of their payload; equal rows
    have one start here and follow each other in the file. A volume takes ``max_bytes`` and
    what the items that begin in it have beyond. Null groups and payloads are empty.
    """
    rows = _item_rows(items)
    return _laid_out(rows, _places(rows, max_bytes)).drop("h")


def _laid_out(rows: DataFrame, places: DataFrame) -> DataFrame:
    first = places.groupBy("grp", "volume").agg(F.min("start").alias("first"))
    placed = places.join(first, ["grp", "volume"]).select(*[F.col(c).alias(f"p_{c}") for c in ("grp", "item", "h")], "volume", "bytes", (F.col("start") - F.col("first")).alias("start"))
    same = (F.col("grp") == F.col("p_grp")) & F.col("item").eqNullSafe(F.col("p_item")) & (F.col("h") == F.col("p_h"))
    return rows.join(placed, same).select("grp", "volume", "start", "item", "name", "payload", "bytes", "h")


@dataclass
class Bounds:
    """Of a group's volumes the first (item, h), in order; ``nulls`` of them begin with an item without a number."""

    nulls: int
    item: np.ndarray
    h: np.ndarray
    volume: np.ndarray

    def find(self, item: np.ndarray, null: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The volumes that items lie in: those with the last bound not beyond them."""
        numbers = self.item[self.nulls :]
        low = np.where(null, 0, self.nulls + np.searchsorted(numbers, item, side="left"))
        high = np.where(null, self.nulls, self.nulls + np.searchsorted(numbers, item, side="right"))
        for i in np.flatnonzero(low < high):  # items with which volumes begin: their hash decides
            low[i] += np.searchsorted(self.h[low[i] : high[i]], h[i], side="right")
        return self.volume[low - 1]


def _in_volumes(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``rows`` with the volume they lie in and no start; ``firsts`` (grp, volume, item, h) go to all tasks."""
    number = lambda: (F.coalesce("item", F.lit(0).cast("long")).alias("item"), F.col("item").isNull().alias("null"))
    table = firsts.select("grp", "volume", *number(), "h").toPandas().sort_values("volume")
    bounds = {g: Bounds(int(t["null"].sum()), t["item"].to_numpy(), t["h"].to_numpy(), t["volume"].to_numpy()) for g, t in table.groupby("grp")}
    known = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("long")
    def volume(grp: pd.Series, item: pd.Series, null: pd.Series, h: pd.Series) -> pd.Series:
        out = np.empty(len(grp), np.int64)
        for g, at in grp.groupby(grp, sort=False).indices.items():
            out[at] = known.value[g].find(item.to_numpy()[at], null.to_numpy()[at], h.to_numpy()[at])
        return pd.Series(out)

    own = volume("grp", *number(), "h")
    return rows.withColumn("volume", own).select("grp", "volume", F.lit(None).cast("long").alias("start"), "item", "name", "payload", F.octet_length("payload").cast("long").alias("bytes"), "h")


def write_shards(items: DataFrame, path: str, max_bytes: int = 64 << 20, node: int = 1, mode: str = "append", broadcast_rows: int = 1_000_000) -> None:
    """Writes items (grp, item, name, payload) as shard files under ``path``, as ``layout_volumes`` places them.

    A task holds one volume at a time. ``append`` refuses files that exist, ``overwrite``
    replaces all. Repeated runs of a task leave nothing behind. Payloads are shuffled
    once, to their volumes: up to ``broadcast_rows`` volumes are found by their first items,
    which go to all tasks (about 30 bytes each); with more, payloads meet their places in a join first.
    """
    spark = items.sparkSession
    spark.dataSource.register(ShardFiles)
    bounded_batches(spark)
    rows = _item_rows(items)
    places = _places(rows, max_bytes)
    firsts = written(places.groupBy("grp", "volume").agg(F.min(F.struct("item", "h")).alias("f")).select("grp", "volume", "f.*"), "volumes")
    few = firsts.count() <= broadcast_rows
    dealt = (_in_volumes(rows, firsts) if few else _laid_out(rows, places)).repartition("grp", "volume")
    ordered = dealt.sortWithinPartitions("grp", "volume", *(("item", "h") if few else ("start", "bytes", "item")))
    ordered.drop("bytes", "h").write.format(FORMAT).option("node", node).mode(mode).save(path)


def read_shards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tensors, errors with a reason) of the files under ``path`` by header and table; filters on ``grp`` prune files."""
    spark.dataSource.register(ShardFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format(FORMAT).load(path)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("path", "grp", "volume", "reason")


#: Bytes of spans that are read before they are handed on (one span at least).
READ_BYTES = 4 << 20


def _span_runs(batches):
    """Batches of spans, cut into runs of about ``READ_BYTES`` that are to be read."""
    for b in batches:
        ends = np.cumsum(np.maximum(b.column(5).to_numpy(), 0))
        cuts = [0, *(np.flatnonzero(np.diff(ends // READ_BYTES)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)


def _span_batches(batches):
    import pyarrow as pa

    path, stream, length = None, None, 0
    for b in _span_runs(batches):
        content, reason = [], []
        for r in b.to_pylist():
            end = r["offset"] + r["length"]
            if r["offset"] < 0 or r["length"] < 0 or end > r["bytes"]:
                content.append(None)
                reason.append(f"span [{r['offset']}, {end}) exceeds tensor of {r['bytes']} bytes")
                continue
            if path != r["path"]:  # rows of a file mostly come together
                if stream is not None:
                    stream.close()
                fs, at = file_system(r["path"])
                path, stream = r["path"], fs.open_input_file(at)
                *_, length = struct.unpack("<IHHII", stream.read_at(HEADER, 0))
            got = stream.read_at(r["length"], HEADER + length + r["start"] + r["offset"])
            whole = len(got) == r["length"]
            content.append(got if whole else None)
            reason.append(None if whole else f"{len(got)} of {r['length']} bytes are there")
        keep = [b.column(n) for n in ("path", "item", "offset", "length")]
        yield pa.record_batch([*keep, pa.array(content, pa.binary()), pa.array(reason, pa.string())], names=["path", "item", "offset", "length", "content", "reason"])


def read_spans(spans: DataFrame) -> DataFrame:
    """(path, item, offset, length, content, reason): byte ranges of tensors, read from their places.

    ``spans`` are rows of ``read_shards`` with ``offset`` and ``length`` inside the tensor; one that
    exceeds it is refused with a reason, never cut.
    """
    rows = spans.select("path", F.col("item").cast("long"), F.col("start").cast("long"), F.col("bytes").cast("long"), F.col("offset").cast("long"), F.col("length").cast("long"))
    return rows.mapInArrow(_span_batches, "path string, item long, offset long, length long, content binary, reason string")
