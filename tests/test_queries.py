"""Every fleet query against its SQL on the smallest tables, and cases with known results."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlake import storage
from fleetlake.functions import bpe, encodings, tokens
from fleetlake.operators import delta, energy, failures, folds, identity, planning, vectors
from fleetlake.plans import artifacts, flows, registry, rules, stores  # noqa: F401
from fleetlake.sources import frames, logs
from fleetlake.streaming import liveness

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list:
    def cell(v):
        if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
            return str([str(x) for x in v])
        if v is None or pd.isna(v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if hasattr(v, "__float__") and not isinstance(v, str) and abs(v) >= 10**9 and v == int(v):
            return str(int(v))  # large integers have to be equal to the last digit
        return f"{float(v):.9g}" if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    df = df[sorted(df.columns)]
    return [list(df.columns), *sorted([cell(v) for v in row] for row in df.itertuples(index=False))]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    assert plain(registry.QUERIES[name](spark, SMALL).toPandas()) == plain(db.execute(registry.ORACLES[name]).df())


def test_admission_skips_what_does_not_fit(spark):
    t = spark.createDataFrame([("p", 1, i, w) for i, w in enumerate([60, 50, 30, 20])], "pool string, enqueued int, task long, watts int")
    assert [r.admitted for r in planning.admit(t, 100).orderBy("task").collect()] == [True, False, True, False]


def test_lanes_by_class_of_traffic(spark):
    t = spark.createDataFrame([(1, "enp3s0", 1000, 300, 10), (1, "wlan0", 60, 2000, 500), (1, "rdma0", 10000, 5, 2)], "node int, iface string, bw int, latency int, jitter int")
    picks = [planning.choose_lanes(t, i).first() for i in range(4)]
    assert [p.bulk for p in picks] == ["rdma0", "enp3s0", "wlan0", "rdma0"]
    assert (picks[0].control, picks[0].second, picks[0].reconcile) == ("rdma0", "enp3s0", "wlan0")


def test_three_failures_take_a_node_offline(spark):
    t = spark.createDataFrame([(1, i, i, x) for i, x in enumerate(["failure"] * 3 + ["register", "failure"])], "node int, ts int, seq int, verb string")
    assert [(r.streak, r.offline) for r in failures.failure_streaks(t).orderBy("seq").collect()] == [(1, False), (2, False), (3, True), (0, False), (1, False)]


def test_hadamard_is_its_own_inverse(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "id int, x array<double>")
    once = vectors.hadamard(t, 4)
    assert once.first().x == [5.0, -1.0, -2.0, 0.0]
    assert vectors.hadamard(once, 4).first().x == [1.0, 2.0, 3.0, 4.0]


def test_drafts_follow_what_was_seen_first(spark):
    seq = [1, 2, 3, 4, 5, 6, 2, 3, 7, 1, 2, 3, 9, 1, 2, 3, 8]
    w = spark.createDataFrame([(1 if i < 9 else 2, i, str(x)) for i, x in enumerate(seq)], "seq int, pos int, token string")
    h = spark.createDataFrame([(1, ["5", "6", "2"]), (2, ["7", "8", "9"]), (3, ["1"])], "id int, tokens array<string>")
    got = {r.id: r.tokens for r in tokens.draft(h, tokens.ngram_continuations(w), 3).collect()}
    assert got == {1: ["3", "7"], 2: [], 3: []}


def test_pieces_cover_the_text(spark):
    text = "I'm a  student\n¿Qué tal? 12 日本"
    pieces = [r.piece for r in tokens.pretokenize(spark.createDataFrame([(text,)], "text string")).orderBy("i").collect()]
    assert "".join(pieces) == text and pieces[:6] == ["I", "'m", " a", " ", " student", "\n"]


def test_signed_lines_equal_the_standard_hmac(spark):
    import hashlib
    import hmac

    key, body = b"k" * 32, "hello world"
    tag = hmac.new(key, (7).to_bytes(8, "big") + body.encode(), hashlib.sha256).hexdigest()
    lines = spark.createDataFrame([(f"7 {tag} {body}",), (f"8 {tag} {body}",), ("junk",)], "line string")
    assert [r.valid for r in logs.verify_signed_log(lines, key).collect()] == [True, False, False]


def test_one_changed_chunk_is_found(spark):
    a, b = b"x" * 1000, b"x" * 300 + b"y" + b"x" * 699
    make = lambda d: spark.createDataFrame([(1, bytearray(d))], "id int, data binary")
    assert [(r.idx, r.length) for r in delta.plan_diff(make(a), make(b), 256).collect()] == [(1, 256)]
    assert delta.plan_diff(make(a), make(a), 256).count() == 0


def test_results_do_not_depend_on_partitions(spark):
    t = spark.range(500).select((F.col("id") % 7).alias("node"), (F.col("id") % 50).alias("ts"), F.col("id").alias("seq"), F.when(F.rand(3) < 0.6, "failure").otherwise("register").alias("verb")).cache()
    one, many = (failures.failure_streaks(x).orderBy("seq").collect() for x in (t.coalesce(1), t.repartition(9, F.rand(1))))
    assert one == many


def test_batch_and_stream_memory_agree(spark):
    batch, stream = (registry.QUERIES[n](spark, SMALL).orderBy("seq", "pos").collect() for n in ("v9_delta_memory", "x6_stream_memory"))
    assert batch == stream and batch


def test_memory_recalls_what_it_was_told(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0], [1.0, 0.0], [3.0, 4.0], 0.0, 1.0), (1, 1, [1.0, 0.0], [0.0, 1.0], [9.0, 9.0], 0.0, 1.0)], "seq int, pos long, q array<double>, k array<double>, v array<double>, gate double, beta double")
    assert [r.y for r in folds.ordered_fold(rows, "seq", ["pos"], folds.DeltaMemory(2)).orderBy("pos").collect()] == [[3.0, 4.0], [3.0, 4.0]]


def test_a_paused_bucket_is_credited_later(spark):
    calls = spark.createDataFrame([("a", 1, 0.0, 10.0, False), ("a", 2, 5.0, 1.0, True), ("a", 3, 5.0, 5.0, False), ("a", 4, 5.0, 1.0, False)], "node string, seq long, at double, bytes double, paused boolean")
    got = folds.ordered_fold(calls, "node", ["at", "seq"], folds.TokenBucket(10, 1)).orderBy("seq").collect()
    assert [r.allowed for r in got] == [True, False, True, False]


def test_a_cut_character_at_the_end_is_shown_as_such(spark):
    rows = spark.createDataFrame([(1, 0, bytearray(b"a\xe2\x82")), (2, 0, bytearray(b"\xe2\x82")), (2, 1, bytearray(b"\xac"))], "id int, pos long, piece binary")
    got = folds.ordered_fold(rows, "id", ["pos"], folds.Utf8Decoder()).orderBy("id", F.col("pos").asc_nulls_last()).collect()
    assert [(r.id, r.text, r.waiting) for r in got] == [(1, "a", 2), (1, "�", 0), (2, "", 2), (2, "€", 0)]


def test_a_fold_carries_its_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).select(F.lit("k").alias("node"), F.col("id").alias("seq"), F.lit("failure").alias("verb"))
        assert [r.streak for r in folds.ordered_fold(rows, "node", ["seq"], folds.Streak()).orderBy("seq").collect()] == list(range(1, 101))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_encodings_decode_what_they_encode():
    import numpy as np

    x = np.random.default_rng(1).integers(-1, 2, 64 * 128)
    assert (encodings.decode_bytes(encodings.PTQ1, encodings.encode_groups(x)) == x).all()
    halves = np.array([0.5, -2.0], "<f2")
    assert encodings.decode_bytes(encodings.F16, halves.tobytes()).tolist() == [0.5, -2.0]
    assert encodings.decode_bytes(encodings.Q8_0, halves[:1].tobytes() + bytes(range(32))).tolist() == [i / 2 for i in range(32)]
    assert encodings.decode_bytes(encodings.BF16, b"\x80\x3f").tolist() == [1.0] and encodings.decode_bytes(99, b"") is None
    with pytest.raises(ValueError):
        encodings.decode_bytes(encodings.F32, b"123")


def test_overlays_grow_a_file_with_zeros(spark):
    local = spark.createDataFrame([(1, bytearray(b"abcdef"))], "id int, data binary")
    over = spark.createDataFrame([(1, 2, bytearray(b"XY")), (1, 8, bytearray(b"Z"))], "id int, start long, bytes binary")
    want = spark.createDataFrame([(1, b"abXYef\0\0Z")], "id int, b binary").select("id", F.sha2("b", 256).alias("expected"))
    got = delta.rebuild(local, over, want).first()
    assert got.status == "published" and bytes(got.data) == b"abXYef\0\0Z"


def test_identities_follow_chains(spark):
    rows = [(1, 0, "a", "", ""), (2, 1, "a", "x", ""), (3, 2, "", "x", ""), (4, 3, "b", "", "h"), (5, 100, "", "y", "h"), (6, 101, "", "", "h"), (7, 9, "", "", None)]
    s = spark.createDataFrame(rows, "seq long, ts long, node_id string, ip string, hostname string").withColumn("ts", F.timestamp_seconds("ts"))
    assert {r.seq: r.slot for r in identity.resolve_identity(s, 30).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_a_missing_snapshot_is_an_empty_state(spark, tmp_path):
    assert storage.load_state(spark, f"{tmp_path}/none", "node long").collect() == []


def bits(block: bytes, first: int, n: int = 1) -> int:
    return int.from_bytes(block, "little") >> first & (1 << n) - 1


def plain_block(kind: int, b: bytes) -> list[float]:
    """One block, element by element, in exact arithmetic."""
    import struct

    half = lambda at: struct.unpack_from("<e", b, at)[0]
    out = []
    for i in range(256):
        part, pos = i // 32, i % 32
        if kind == encodings.TQ1_0:
            run, size, start = (0, 32, 0) if i < 160 else (32, 16, 160) if i < 240 else (48, 4, 240)
            digit, byte = divmod(i - start, size)
            out.append((b[run + byte] * 3**digit % 256 * 3 // 256 - 1) * half(52))
        elif kind == encodings.Q3_K:
            q = bits(b[32 + 32 * (i // 128) + pos : 97], 2 * (part % 4), 2) - (0 if bits(b[pos : pos + 1], part) else 4)
            at = i // 16
            scale = bits(b[96 + at % 8 : 97 + at % 8], 4 * (at // 8), 4) + 16 * bits(b[104 + at % 4 : 105 + at % 4], 2 * (at // 4), 2)
            out.append(half(108) * (scale - 32) * q)
        elif kind == encodings.Q6_K:
            half_no, quarter = i // 128, i % 128 // 32
            low = bits(b[64 * half_no + 32 * (quarter % 2) + pos :][:1], 4 * (quarter // 2), 4)
            high = bits(b[128 + 32 * half_no + pos :][:1], 2 * quarter, 2)
            out.append(half(208) * struct.unpack_from("<b", b, 192 + i // 16)[0] * (low + 16 * high - 32))
        else:
            s = b[4:16]
            scale, offset = (s[part] % 64, s[part + 4] % 64) if part < 4 else (s[part + 4] % 16 + s[part - 4] // 64 * 16, s[part + 4] // 16 + s[part] // 64 * 16)
            q = bits(b[-128 + 32 * (part // 2) + pos :][:1], 4 * (part % 2), 4) + (16 * bits(b[16 + pos : 17 + pos], part) if kind == encodings.Q5_K else 0)
            out.append(half(0) * scale * q - half(2) * offset)
    return out


@pytest.mark.parametrize("kind", [encodings.Q3_K, encodings.Q4_K, encodings.Q5_K, encodings.Q6_K, encodings.TQ1_0])
def test_blocks_decode_as_element_by_element(kind):
    import numpy as np

    size, r = encodings.BLOCKS[kind][1], np.random.default_rng(kind)
    blocks = r.integers(0, 256, (5, size), np.uint8)
    for at in {encodings.Q3_K: [108], encodings.Q6_K: [208], encodings.TQ1_0: [52]}.get(kind, [0, 2]):
        blocks[:, at : at + 2] = r.normal(size=(5, 1)).astype("<f2").view(np.uint8)
    want = [x for b in blocks for x in plain_block(kind, b.tobytes())]
    assert np.allclose(encodings.decode_bytes(kind, blocks.tobytes()), want, rtol=1e-5, atol=1e-5)
    assert len(encodings.decode_bytes(kind, b"")) == 0


HELLO = bpe.Vocabulary(dict(enumerate(["H", "e", "l", "o", "He", "Hel", "lo", "Hello"])), {}, [("H", "e"), ("He", "l"), ("l", "o"), ("Hel", "lo")])


def test_pairs_merge_by_rank(spark):
    t = spark.createDataFrame([(1, "Hello"), (2, "o"), (3, ""), (4, None), (5, "Help")], "id int, text string")
    got = bpe.bpe_encode(t, HELLO).orderBy("id").collect()
    assert [(r.ids, r.unknown) for r in got] == [([7], False), ([3], False), ([], False), (None, False), (None, True)]


def test_merging_equals_the_plain_loop():
    import random

    r = random.Random(5)
    for _ in range(200):
        ranks = {}
        for n in range(r.randrange(1, 12)):
            ranks.setdefault(("".join(r.choices("ab", k=r.randrange(1, 3))), "".join(r.choices("ab", k=r.randrange(1, 3)))), n)
        parts = want = r.choices("ab", k=r.randrange(0, 30))
        while best := min(((ranks[p], i) for i, p in enumerate(zip(want, want[1:])) if p in ranks), default=None):
            i = best[1]
            want = [*want[:i], want[i] + want[i + 1], *want[i + 2 :]]
        assert bpe.merge_pairs(parts, ranks) == want


def test_long_pieces_merge_as_short_ones(monkeypatch):
    import random

    r = random.Random(6)
    ranks = {("a", "b"): 3, ("b", "a"): 1, ("ab", "ab"): 0, ("ba", "ba"): 7, ("a", "a"): 2, ("aa", "b"): 9}
    texts = [r.choices("abc", k=n) for n in range(200)]
    want = [bpe.merge_pairs(t, ranks) for t in texts]
    monkeypatch.setattr(bpe, "FEW", 0)
    assert [bpe.merge_pairs(t, ranks) for t in texts] == want


def test_batches_encode_like_single_texts(spark):
    import pyarrow as pa

    texts = [["Hello", "o"], None, [], ["e", "x", "l"], ["o"], ["Hello"] * 3, ["x"], ["lo", "He"]]
    whole = bpe._Encoder(HELLO).batch(pa.array(texts, pa.list_(pa.string())))
    assert whole.to_pylist() == [[7, 3], None, [], None, [3], [7, 7, 7], None, [6, 4]]
    assert bpe._Encoder(HELLO).batch(pa.array(texts, pa.list_(pa.string())).slice(2, 4)).to_pylist() == [[], None, [3], [7, 7, 7]]
    assert bpe._Encoder(HELLO).batch(pa.array([], pa.list_(pa.string()))).to_pylist() == []
    assert bpe._Encoder(HELLO).batch(pa.array([None, []], pa.list_(pa.string()))).to_pylist() == [None, []]


def test_few_pieces_at_once_give_the_same(spark):
    import pyarrow as pa

    texts = [[], ["Hello"], ["lo"] * 5, None, [], ["o", "x"], ["He"] * 3, []]
    array = pa.array(texts, pa.list_(pa.string()))
    assert bpe.encode_slices(bpe._Encoder(HELLO), array, 2).to_pylist() == [[], [7], [6] * 5, None, [], None, [4] * 3, []]


def test_encoding_equals_the_tokenizer_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    theirs = Tokenizer.from_file(path)
    theirs.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    t = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null").select("doc_id", "text").limit(60)
    cut = {}
    for r in tokens.pretokenize(t).orderBy("doc_id", "i").collect():
        cut.setdefault(r.doc_id, []).append(r.piece)
    ours = {r.doc_id: r.ids for r in bpe.bpe_encode(t, bpe.read_vocabulary(path)).collect()}
    assert ours and all(ours[k] == [i for p in v for i in theirs.encode(p, add_special_tokens=False).ids] for k, v in cut.items())


def test_tokens_without_text_decode_empty(spark):
    words = bpe.Vocabulary({0: "a", 1: "Ġb", 2: "x", 3: "y", 4: "â"}, {2: bpe.CONTROL, 3: bpe.UNUSED}, [])
    t = spark.createDataFrame([(1, [0, 2, 1, 3, 99]), (2, [4]), (3, []), (4, None)], "id int, ids array<int>")
    assert [r.text for r in bpe.bpe_decode(t, words).orderBy("id").collect()] == ["a b", "�", "", None]


def test_liveness_of_a_table_equals_the_stream(spark):
    from fleetlake import views

    rows = liveness.liveness_changes(views.telemetry(spark, SMALL), 43200, 60).collect()
    assert sorted(rows) == sorted(registry.QUERIES["x2_stream_liveness"](spark, SMALL).collect())


def test_silence_is_told_once_over_many_triggers(spark, tmp_path):
    from fleetlake.streaming import folds as streams

    for i, part in enumerate([[("a", 0), ("b", 5)], [("a", 20)], [("b", 100)], [("a", 101), ("c", 200), (None, 1)]]):
        df = spark.createDataFrame(part, "node string, s long").select("node", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("node string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = sorted((r.node, r.at_ms // 1000 - 1000, r.online) for r in streams.drain(liveness.stream_liveness(stream, 30), "silence").collect())
    whole = sorted((r.node, r.at_ms // 1000 - 1000, r.online) for r in liveness.liveness_changes(spark.read.parquet(f"{tmp_path}/in"), 30).collect())
    assert got == whole == [("a", 0, True), ("a", 50, False), ("a", 101, True), ("a", 131, False), ("b", 5, True), ("b", 35, False), ("b", 100, True), ("b", 130, False), ("c", 200, True)]


def test_frames_of_the_other_type_are_errors(spark):
    t = spark.createDataFrame([(1, 2, 3, 4, "00000000000000ff", [1.0])], "sequence long, token_pos long, layer_start long, layer_end long, hash string, x array<float>")
    announced, plain_ones = frames.encode_announcements(t).select("frame"), frames.encode_frames(t).select("frame")
    assert frames.decode_announcements(announced)[0].first().hash == "00000000000000ff"
    assert frames.decode_frames(announced)[1].first().reason == frames.decode_announcements(plain_ones)[1].first().reason == "type"


def test_marks_stay_with_their_letters(spark):
    t = "cafe\u0301 हिन्दी I'LL x1"
    assert [r.piece for r in tokens.pretokenize(spark.createDataFrame([(t,)], "text string")).orderBy("i").collect()] == ["cafe\u0301", " हिन्दी", " I", "'LL", " x", "1"]


def test_items_are_routed_and_grouped_by_name(spark):
    names = ["blk.0.v_proj", "v_head", "v.blk.3", "model.visual.x", "blk.x.w", "blk.nextn.w", "nextn.w", "blk.7.w", "blk.45.w", "blk.99.w", "token_embd.w", "output_embd.w", "enc.blk.2.w"]
    items = spark.createDataFrame(list(enumerate(names)), "item int, name string")
    route = {names[r.item]: r.route for r in planning.route_items(items, 40, 50, True).collect()}
    assert [route[n] for n in names] == ["dropped", "trunk", "dropped", "dropped", "trunk", "trunk", "draft", "trunk", "draft", "dropped", "trunk", "trunk", "trunk"]
    stage = {names[r.item]: r.stage for r in planning.contiguous_groups(items, [2, 2, 2]).collect()}
    assert [stage[n] for n in ("blk.0.v_proj", "enc.blk.2.w", "v.blk.3", "blk.7.w", "blk.99.w", "token_embd.w", "output_embd.w", "v_head")] == [0, 0, 1, 1, 2, 0, 2, 2]
    with pytest.raises(Exception, match="no layer"):
        planning.contiguous_groups(items.where("name = 'v_head'"), [1]).collect()


def test_one_bit_makes_another_fingerprint(spark):
    t = spark.createDataFrame([(1, [0.1234561, 2.0]), (2, [1e20, 1.0]), (3, [0.5, 0.25])], "id int, x array<double>")
    theirs = spark.createDataFrame([(1, [0.1234561000000001, 2.0]), (2, [1e20, 1.0000000000000002]), (3, [0.5, 0.25])], "id int, x array<double>")
    got = vectors.fingerprint_match(theirs.select("id", vectors.fingerprint(F.col("x")).alias("fingerprint")), t)
    assert [(r.hit, r.saved) for r in got.orderBy("id").collect()] == [(False, 0), (False, 0), (True, 8)]


def test_vectors_that_are_no_whole_blocks_are_refused(spark):
    with pytest.raises(Exception, match="multiple"):
        vectors.hadamard(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id int, x array<double>"), 2).collect()


def test_reconciling_needs_a_row_of_each_node_on_both_sides(spark):
    p = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "site int, node int, predicted double")
    good = energy.reconcile_checks(p, spark.createDataFrame([(1, 1, 12.0), (1, 2, None)], "site int, node int, actual double"))
    assert good.collect() == [(1, 2, 2, 2, 0, 30.0, True, True)]
    with pytest.raises(Exception, match="arity mismatch"):
        energy.reconcile_checks(p, spark.createDataFrame([(1, 1, 12.0)], "site int, node int, actual double")).collect()


def test_paths_are_trimmed_and_letters_may_be_of_any_script(spark):
    from fleetlake.operators import fleet

    properties = spark.createDataFrame([("n10", "load", "0.50"), ("né", "load", "1.00")], "node string, property string, value string")
    paths = spark.createDataFrame([(" n10 .l",), ("né.load",), ("n10",), ("n10.l.x",), ("n7.l",), (".l",)], "path string")
    got = dict(fleet.record_answers(paths, properties).collect())
    assert got == {" n10 .l": "0.50", "né.load": "1.00", "n10": "invalid path", "n10.l.x": "invalid path", "n7.l": "unknown node", ".l": "invalid path"}


def test_a_reports_missing_fields_have_defaults(spark):
    lines = spark.createDataFrame([('{"hostname":"a"}',), ('{"cores":4}',), ("{",)], "line string")
    good, bad = logs.read_telemetry(lines)
    assert [tuple(r) for r in good.collect()] == [("a", "", 0, 0, False, False, False, 0, 0, 0, 0.0, "", "", "", [], [])]
    assert bad.count() == 2


def test_one_pool_of_all_tasks_keeps_its_order(spark):
    q = spark.range(3000).selectExpr("'p' as pool", "id as task", "cast((id * 7919) % 3000 as int) as enqueued", "0 as retries", "id as place")
    want = {r.task for r in q.collect() if r.enqueued >= 1000}
    assert {r.task for r in planning.queue_rejects(q, 1000).collect()} == want
    failed = spark.createDataFrame([(5, 9), (5, 8), (7, 3)], "task long, at int")
    dropped = q.withColumn("retries", F.when(F.col("task") == 7, 3).otherwise(0))
    got = {r.task: r for r in planning.requeue(dropped, failed).collect()}
    assert (got[5].place, got[5].disposition, got[7].place, got[7].disposition) == (2999, "requeued", None, "dropped")
    assert [got[k].place for k in (0, 4, 6, 8, 2999)] == [1, 5, 6, 7, 2998]


def test_reported_totals_are_verified(spark):
    p = spark.createDataFrame([(s, n, 10.0) for s in range(6) for n in range(2)], "site int, node int, predicted double")
    a = spark.createDataFrame([(s, n, 30.0 if n else 12.0) for s in range(5) for n in range(2)], "site int, node int, actual double")
    told = spark.createDataFrame([(0, 40.0), (1, 20.0), (2, 42.0), (3, 41.0), (4, None), (9, 1.0)], "site int, reported double")
    got = {r.site: (r.effective, r.n_nodes, r.verdict) for r in energy.verify_reported(told, p, a).collect()}
    assert got == {0: (40.0, 2, "exact"), 1: (40.0, 2, "summed predictions"), 2: (40.0, 2, "summed actuals"), 3: (40.0, 2, "off"), 4: (40.0, 2, "not reported"), 5: (20.0, 2, "not reported"), 9: (None, 0, "unknown site")}
