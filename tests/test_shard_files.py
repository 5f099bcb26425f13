"""The sink and the scan of shard files: what is written, pruned, refused and left out of reads."""

import os
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlake.sources import shard_files as sf


@pytest.fixture
def items(spark):
    rows = [("a/b", i, f"t{i}", bytes([i % 256]) * (i % 50)) for i in range(200)] + [("hot", i, "ö", b"x" * 10) for i in range(2000)] + [(None, 1, None, None), ("a/b", 7, "again", b"77")]
    return spark.createDataFrame(rows, "grp string, item long, name string, payload binary").repartition(6)


def test_files_hold_what_was_laid_out(spark, items, tmp_path):
    path = str(tmp_path / "out")
    sf.write_shards(items, path, max_bytes=4000)
    tensors, errors = sf.read_shards(spark, path)
    assert errors.count() == 0 and not [f for f in os.listdir(path) if not f.endswith(".shard")]
    want = sf.layout_volumes(items, 4000).select("grp", "volume", "start", "item", "name", "bytes")
    assert want.groupBy("grp", "volume").agg(F.sum("bytes").alias("n"), F.max_by("bytes", "start").alias("last")).where("n - last >= 4000").isEmpty()
    got = tensors.select("grp", "volume", "start", "item", "name", "bytes")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 2202
    assert tensors.where("grp = 'hot'").select("volume").distinct().count() == 37  # 2000 * (10 + 64) / 4000
    whole = sf.read_spans(tensors.withColumn("offset", F.lit(0)).withColumn("length", F.col("bytes")))
    read = sorted((r.item, bytes(r.content)) for r in whole.collect())
    assert read == sorted((r.item, bytes(r.payload or b"")) for r in items.collect())


def test_places_by_bounds_and_by_a_join_give_the_same_files(spark, tmp_path):
    rows = [("g", i % 7 if i % 7 else None, str(i % 3), bytes([i % 11]) * (i % 90)) for i in range(700)] + [(None, 2**53 + 1, "far", b"z"), (None, 2**53, "near", b"y"), ("g", -(2**63), "least", b"m")]
    items = spark.createDataFrame(rows, "grp string, item long, name string, payload binary").repartition(5)
    for limit in (10**6, 0):
        sf.write_shards(items, str(tmp_path / str(limit)), max_bytes=300, broadcast_rows=limit)
    names = sorted(os.listdir(tmp_path / "0"))
    assert len(names) > 50 and names == sorted(os.listdir(tmp_path / "1000000"))
    tensors = [sorted(map(str, sf.read_shards(spark, str(tmp_path / n))[0].select("grp", "volume", "item", "name", "start", "bytes").collect())) for n in ("0", "1000000")]
    assert tensors[0] == tensors[1] and len(tensors[0]) == 703
    bodies = [[(tmp_path / n / f).read_bytes()[-1:] + str((tmp_path / n / f).stat().st_size).encode() for f in names] for n in ("0", "1000000")]
    assert bodies[0] == bodies[1]


def test_payloads_are_shuffled_once(spark, items):
    rows = sf._item_rows(items)
    firsts = sf._places(rows, 4000).groupBy("grp", "volume").agg(F.min(F.struct("item", "h")).alias("f")).select("grp", "volume", "f.*")
    plan = sf._in_volumes(rows, firsts)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 0


def test_spans_beyond_a_tensor_are_refused(spark, items, tmp_path):
    path = str(tmp_path / "out")
    sf.write_shards(items.where("grp = 'hot' and item < 3"), path)
    spans = sf.read_shards(spark, path)[0].withColumn("offset", F.col("item") * 4).withColumn("length", F.lit(6))
    assert [(r.item, r.content, r.reason) for r in sf.read_spans(spans).orderBy("item").collect()] == [(0, b"x" * 6, None), (1, b"x" * 6, None), (2, None, "span [8, 14) exceeds tensor of 10 bytes")]


def test_existing_files_are_refused_or_replaced(spark, items, tmp_path):
    path = str(tmp_path / "out")
    sf.write_shards(items, path, max_bytes=4000)
    with pytest.raises(Exception, match="exists"):
        sf.write_shards(items.where("grp = 'hot'"), path, max_bytes=4000)
    assert not [f for f in os.listdir(path) if f.startswith("_")]
    sf.write_shards(items.where("grp = 'a/b'"), path, mode="overwrite")
    assert os.listdir(path) == ["a%2Fb-0.shard"]


def test_attempts_that_died_or_ran_twice_leave_nothing(tmp_path):
    writer = sf.ShardWriter(str(tmp_path / "out"), 1, False)
    batch = pa.table({"grp": ["g", "g"], "volume": [0, 0], "start": [0, 2], "item": [1, 2], "name": ["a", "b"], "payload": [b"xx", b"y"]}).to_batches()

    def dying():
        yield batch[0]
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(dying())
    writer.write(iter(batch))  # its message is lost
    writer.commit([writer.write(iter(batch)), None])
    assert os.listdir(tmp_path / "out") == ["g-0.shard"]
    assert (tmp_path / "out" / "g-0.shard").read_bytes().endswith(b"xxy")
    failed = sf.ShardWriter(str(tmp_path / "out"), 1, False)
    failed.write(iter(batch))
    failed.abort([None])
    assert os.listdir(tmp_path / "out") == ["g-0.shard"]
    with pytest.raises(ValueError, match="starts at"):
        failed.write(iter(pa.table({"grp": ["g"], "volume": [0], "start": [5], "item": [1], "name": ["a"], "payload": [b"xx"]}).to_batches()))


def test_only_heads_are_read_and_bad_files_are_told(spark, tmp_path):
    meta = b'[{"start":0,"bytes":99,"name":"w","item":5}]'
    head = struct.pack("<IHHII", sf.MAGIC, sf.VERSION, 3, 1, len(meta)) + meta
    with open(tmp_path / "big-0.shard", "wb") as f:
        f.write(head)
        f.truncate(1 << 42)  # four terabytes of nothing behind the table
    bad = {"short": head[:9], "magic": b"#" + head[1:], "cut": head[:40], "newer": head[:4] + b"\x09" + head[5:], "count": head.replace(b"\x01\x00\x00\x00", b"\x02\x00\x00\x00", 1), "json": head[:16] + b"?" + head[17:]}
    for name, content in bad.items():
        (tmp_path / f"{name}-0.shard").write_bytes(content)
    tensors, errors = sf.read_shards(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in tensors.collect()] == [("big", 0, 3, 5, "w", 0, 99)]
    assert {r.grp: r.reason for r in errors.collect()} == {"short": "too short", "magic": "bad magic", "cut": "truncated meta", "newer": "unsupported version", "count": "count mismatch", "json": "count mismatch"}
    assert sf.read_head(sf.file_system(str(tmp_path))[0], str(tmp_path / "no")) == (None, "missing")


def test_a_filter_on_groups_prunes_files(tmp_path):
    from pyspark.sql.datasource import EqualTo, In

    for name in ("a-0", "a-1", "b%2F-0", "c-0"):
        (tmp_path / f"{name}.shard").write_bytes(b"")
    reader = sf.HeadReader(str(tmp_path), 2)
    assert [len(p.files) for p in reader.partitions()] == [2, 2]
    assert list(reader.pushFilters([In(("grp",), ("a", "b/")), EqualTo(("name",), "x")]))
    assert [os.path.basename(f) for p in reader.partitions() for f in p.files] == ["a-0.shard", "a-1.shard", "b%2F-0.shard"]
    list(reader.pushFilters([EqualTo(("grp",), "b/")]))
    assert [os.path.basename(f) for p in reader.partitions() for f in p.files] == ["b%2F-0.shard"]


def test_pruning_reaches_the_scan(spark, items, tmp_path):
    sf.write_shards(items, str(tmp_path / "out"))
    (tmp_path / "out" / "other-0.shard").write_bytes(b"broken")
    tensors, errors = sf.read_shards(spark, str(tmp_path / "out"))
    assert tensors.where("grp = 'hot'").count() == 2000
    assert errors.where("grp in ('hot', 'a/b')").count() == 0 and errors.count() == 1


def test_equal_items_follow_each_other(spark, tmp_path):
    rows = [("g", 1, "a", b"xyz")] * 3 + [("g", 1, "a", b"q"), ("g", None, "n", b"null"), ("g", 2, "b", b"end")]
    sf.write_shards(spark.createDataFrame(rows, "grp string, item long, name string, payload binary"), str(tmp_path / "out"))
    tensors, _ = sf.read_shards(spark, str(tmp_path / "out"))
    spans = sf.read_spans(tensors.withColumn("offset", F.lit(0)).withColumn("length", F.col("bytes"))).collect()
    assert sorted((r.item or 0, bytes(r.content)) for r in spans) == sorted((i or 0, b) for _, i, _, b in rows)
    assert sorted((r.start, r.start + r.bytes) for r in tensors.collect())[-1][1] == 17 == sum(r.bytes for r in tensors.collect())
