"""Blocked products, looked-up names, files in pieces and late payloads against plain Python."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlake.operators import delta, fleet, vectors
from fleetlake.sources import logs


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (300, 6)).astype(float)  # small integers: many ties
    x[5, 0] = x[9, 1] = np.nan
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(5)


def ranked(x, q, k, others):
    y = x @ x[q]
    order = sorted((i for i in range(len(x)) if not (others and i == q)), key=lambda i: (np.isnan(y[i]), -np.nan_to_num(y[i]), i))[:k]
    return [(q, r, i, None if np.isnan(y[i]) else float(y[i])) for r, i in enumerate(order, 1)]


@pytest.mark.parametrize(("k", "others", "values"), [(1, False, 10**6), (4, True, 30), (40, False, 7), (500, True, 10**6)])
def test_the_k_best_of_each_query(spark, table, k, others, values):
    x, items = table
    queries = items.where("id % 23 = 0 or id = 5")
    got = sorted(tuple(r) for r in vectors.best_items(queries, items, k, others, values).collect())
    assert got == sorted(r for q in sorted({*range(0, 300, 23), 5}) for r in ranked(x, q, k, others))
    assert "Cartesian" not in (plan := vectors.best_items(queries, items, k)._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def test_products_in_blocks_are_all_products(spark, table):
    x, items = table
    queries = items.where("id < 40 and id <> 5 and id <> 9")
    for values in (10**6, 20):
        got = {(r.q, r.id): r.y for r in vectors.score(queries, items.where("id <> 5 and id <> 9"), values).collect()}
        assert got == {(q, i): float(x[q] @ x[i]) for q in range(40) if q not in (5, 9) for i in range(300) if i not in (5, 9)}
    assert vectors.score(queries.where("false"), items).count() == vectors.best_items(queries, items.where("false")).count() == 0
    with pytest.raises(Exception, match="different length"):
        vectors.score(queries, spark.createDataFrame([(1, [1.0])], "id long, x array<double>")).collect()


@pytest.mark.parametrize("q", [1, 2, 3, 4])
def test_names_that_contain_each_other(spark, q):
    rng = random.Random(q)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 5, 8])))
    a = [word() for _ in range(60)] + ["", None, "zz", "GPU X1", "GPU X"]
    for b in ([(word() or "x", rng.randrange(50)) for _ in range(40)] + [("GPU X1 Ti", 3), ("GPU", 2), (None, 0)], [("", 7), ("abc", 9), ("zz", 1), ("b", 8)], []):
        got = logs.match_devices(spark.createDataFrame([(x,) for x in a], "name string"), spark.createDataFrame(b, "name string, ord int"), q)
        want = {x: min(((o, n) for n, o in b if n is not None and x is not None and (n in x or x in n)), default=(None, None))[1] for x in a}
        assert {r.name: r.device for r in got.collect()} == want
    assert "NestedLoopJoin BuildRight, LeftOuter" not in got._jdf.queryExecution().toString()


def laid(local, overlays):
    end = max([s + len(b) for s, b in local + overlays], default=0)
    out = bytearray(end)
    for s, b in local + overlays:
        out[s : s + len(b)] = b
    return bytes(out)


@pytest.mark.parametrize("seed", range(4))
def test_files_in_pieces_are_rebuilt(spark, seed):
    rng = random.Random(seed)
    files, local, over, want = {}, [], [], []
    for f in range(30):
        n, at, own, top = rng.choice([0, 1, 50, 400]), 0, [], []
        while at < n:
            size = min(rng.choice([1, 7, 60]), n - at)
            own.append((at, rng.randbytes(size)))
            at += size
        at = 0
        while at < 500 and rng.random() < 0.8:
            at += rng.choice([0, 3, 90])
            b = rng.randbytes(rng.choice([1, 5, 130]))
            top.append((at, b))
            at += len(b)
        files[f] = laid(own, top)
        local += [(f, s, b) for s, b in own] or [(f, 0, b"")]
        over += [(f, s, b) for s, b in top]
        want.append((f, hashlib.sha256(files[f] if f % 5 else b"other").hexdigest()))
    kind = "id int, start long, bytes binary"
    status, pieces = delta.rebuild_pieces(spark.createDataFrame(local, kind).repartition(3), spark.createDataFrame(over, kind), spark.createDataFrame(want, "id int, expected string"))
    assert {r.id: (r.status, r.epoch) for r in status.collect()} == {f: ("published", e) if f % 5 else ("epoch mismatch", None) for f, e in want}
    made = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.id, r.start)):
        assert r.start == len(made.setdefault(r.id, b""))
        made[r.id] += bytes(r.bytes)
    assert made == {f: b for f, b in files.items() if f % 5 and b}


def test_a_file_larger_than_a_tasks_memory_keeps_one_piece():
    """Two gigabytes of pieces pass; what stands at once is a batch."""
    import resource

    import pyarrow as pa

    piece = bytes(1 << 20)
    n, seen = 2_000, 0

    def batches():
        for i in range(n):
            yield pa.record_batch([pa.array([1]), pa.array([i << 20]), pa.array([False]), pa.array([piece])], names=["id", "start", "over", "bytes"])

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for b in delta._laid(batches(), pa.int64()):
        seen += sum(len(x) for x in b.column(2).to_pylist() if x)
    assert seen == n << 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kB


def test_overlays_that_overlap_are_refused(spark):
    kind = "id int, start long, bytes binary"
    over = spark.createDataFrame([(1, 0, b"abc"), (1, 2, b"x")], kind)
    with pytest.raises(Exception, match="overlap"):
        delta.rebuild_pieces(spark.createDataFrame([(1, 0, b"")], kind), over, spark.createDataFrame([(1, "e")], "id int, expected string"))


def test_payload_is_asked_for_after_the_hashes_met(spark):
    mine = spark.createDataFrame([(i, [i * 0.1, 1.0]) for i in range(20)], "id long, x array<double>")
    theirs = mine.where("id < 15").union(spark.createDataFrame([(30, [9.0, 9.0])], mine.schema)).select("id", F.when(F.col("id") % 3 == 0, F.transform("x", lambda c: c + 1e-15 + c * 2e-16)).otherwise(F.col("x")).alias("x"))
    announced = theirs.select("id", vectors.fingerprint(F.col("x")).alias("fingerprint"))
    verdicts = vectors.match_stream(announced, mine)
    out = vectors.exact_stream(verdicts, mine, theirs)
    assert {r.id: r.x for r in out.collect()} == {r.id: r.x for r in theirs.collect()}
    assert {r.id for r in out.where("hit").collect()} == {i for i in range(15) if i % 3}
    totals = vectors.match_totals(verdicts).first()
    assert (totals.hits, totals.misses, totals.saved) == (10, 6, 80)
    joined = [line for line in verdicts._jdf.queryExecution().toString().split("\n") if "FileScan" in line]
    assert joined and all("x#" not in line for line in joined)  # the verdicts hold no payload


def test_softmax_of_arrays_and_a_chain_of_sources(spark):
    x = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1000.0, 0.0]), (3, [])], "id int, x array<double>")
    assert {r.id: r.p for r in vectors.softmax_arrays(x).collect()} == {1: [0.5, 0.5], 2: [1.0, 0.0], 3: []}
    table = lambda *rows: spark.createDataFrame(rows, "node int, power_watts int")
    got = fleet.overlay_live(table((1, 10)), table((1, 11), (2, 12)), table((2, 13), (3, 14)))
    assert {(r.node, r.power_watts) for r in got.collect()} == {(1, 10), (2, 12), (3, 14)}


def test_rows_go_to_python_in_batches_of_bounded_bytes(spark):
    """Before, a batch had 10,000 rows of any length, and 4 million pieces or all ids of it were looked up at a time."""
    from fleetlake import storage
    from fleetlake.functions import bpe

    assert bpe.PIECES_AT_ONCE <= 1 << 18
    spark.conf.unset(storage.BATCH_BYTES)
    words = bpe.Vocabulary({0: "a", 1: "\u0120a"}, {}, [("\u0120", "a")])
    long = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("a a "), 20_000).alias("text"))
    bpe.bpe_decode(bpe.bpe_encode(long.select("id", F.rtrim("text").alias("text")), words), words)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 8 << 20
    spark.conf.set(storage.BATCH_BYTES, "1000000")
    storage.bounded_batches(spark)
    assert spark.conf.get(storage.BATCH_BYTES) == "1000000"
    spark.conf.unset(storage.BATCH_BYTES)


def test_spans_are_read_in_runs_of_bounded_bytes(monkeypatch):
    from fleetlake.sources import shard_files

    monkeypatch.setattr(shard_files, "READ_BYTES", 100)
    lengths = [60, 60, -5, 0, 250, 10, 60]
    b = pa.record_batch([pa.array(lengths, pa.int64())] * 6, names=list("abcdef"))
    runs = [x.column(5).to_pylist() for x in shard_files._span_runs([b])]
    assert [n for r in runs for n in r] == lengths and len(runs) > 2 and all(sum(r) - max(r) <= 100 for r in runs)
