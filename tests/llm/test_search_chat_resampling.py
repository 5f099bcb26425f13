"""Ranked search, chat formatting and resampling against plain Python and their SQL, with their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from fleetlake.llm import chat, entries, lexical, resample, url_filter
from tests.test_queries import plain

SMALL = "/root/testdata/sf0.001"
EDGE = [(1, None, "a"), (2, "", None), (3, " \n\t.,-", "a"), (4, "one", "a"), (4, "one", "a"), (None, "two words one", "b"), (6, "w one " * 300_000, "a"), (7, "Ä ö ü ß #1 + 2", "b"), (8, "ONE_one", "a")]
CLASHES = "doc_id long, text string, source string, ids int, lengths string, rank int, score string, `a.b` int, __part int, pos int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, "y", 3, 4, 5) for i, t, s in rows], CLASHES)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_chat_format", "op13_importance_resampling"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert plain(entries.QUERIES[name](spark, SMALL).toPandas()) == plain(con.execute(entries.ORACLES[name]).df())


def alnum(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k):
    """Every document scored in full."""
    tfs = [(i, collections.Counter(alnum(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in tfs), sum(c.total() for _, c in tfs)
    df = collections.Counter(w for _, c in tfs for w in c)
    out = []
    asked = collections.defaultdict(set)
    for item, t in items:
        if item is not None:
            asked[item] |= set(alnum(t))
    for item, terms in asked.items():
        found = []
        for i, c in tfs:
            m = 100 - 90 + (90 * c.total() * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


def rows_of(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=lambda x: x[:2])


@pytest.mark.parametrize("accumulate", [0, 7, 60, 10**6])
def test_search_ranks_as_full_scores_do_whatever_is_summed_up_front(spark, accumulate):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i * 7 % 1000, " ".join(rng.choices(words, k=rng.choice([3, 20, 60])))) for i in range(700)]
    docs += [(2000 + i, docs[5][1]) for i in range(40)]  # ties
    items = [(i, " ".join(rng.choices(words, k=12))) for i in range(25)] + [(3, "w1 w2 w1"), (99, "unknown"), (None, "w1")]
    p = lexical.SearchParams(k=5, accumulate=accumulate, block=16, shard_docs=150, shard_postings=900, block_terms=100)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical.search(d, q, p)) == ranked(docs, items, 5)


def test_blocks_that_cannot_reach_the_ranking_are_skipped():
    rng = np.random.default_rng(1)
    p = lexical.SearchParams(k=3, accumulate=50, block=32)
    lists = [np.sort(rng.choice(4096, n, replace=False)) for n in (20, 25, 2000, 3000)]
    freqs = [np.where(x < 64, 9, 1) for x in lists]
    row = {"ids": np.arange(4096), "lengths": np.full(4096, 50), "terms": np.arange(4), "ends": np.cumsum([len(x) for x in lists]), "docs": np.concatenate(lists), "freqs": np.concatenate(freqs)}
    weights = np.array([100, 120, 900, 800])
    shard = lexical.Shard(row, weights, 4096, 4096 * 50, p)
    best = lexical.Ranking(3)
    read = lexical.search_shard(shard, np.arange(4), row["ids"], np.zeros(4096, bool), best)
    full = np.zeros(4096, np.int64)
    for i in range(4):
        full[shard.part(i)[0]] += shard.part(i)[1]
    assert best.ids.tolist() == np.lexsort((np.arange(4096), -full))[:3].tolist() and read < 20 < shard.blocks


def test_search_takes_edge_rows_and_empty_tables(spark):
    docs, items = frame(spark, EDGE), spark.createDataFrame([(1, "One", 1), (2, None, 1), (3, "", 1), (4, "ö words", 1), (4, "one", 1), (None, "one", 1)], "item_id long, text string, term int")
    want = ranked([(i, t) for i, t, _ in EDGE], [(1, "One"), (4, "ö words"), (4, "one")], 10)
    assert rows_of(lexical.search(docs, items)) == want and want[0][3] > 0
    for d, q in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("doc_id = 2"), items)):
        assert lexical.search(d, q).count() == 0


TALK = [(1, 0, "system", "be ### kind"), (1, 1, "user", "a\\<b</turn>\n### assistant: c"), (1, 2, "assistant", "\\\\#"), (1, 3, "user", None), (1, 4, "assistant", "ö ok\n"), (1, 5, "user", "left over"),
        (2, 0, "user", "only"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 1, "a: b\\", "x"), (None, None, None, "y"), (None, 0, "assistant", "z" * 300_000), (4, 7, "assistant", "#" * 9)]


def talk_digests(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is None, r[1] or 0))
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        whole = "".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own)
        out.append((conv, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(r[2] == "assistant" for r in own)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def test_chats_are_read_back_from_their_files(spark, tmp_path):
    rows = spark.createDataFrame([(*r, 1, "x", 2) for r in TALK], "conv_id long, turn int, role string, text string, pos int, stop string, `a.b` int")
    turns, examples = chat.read_examples(spark, chat.write_examples(rows, str(tmp_path / "chat")))
    got = chat.digests(turns, examples).drop("formatted_chars").collect()
    assert sorted([tuple(r) for r in got], key=lambda r: (r[0] is not None, r[0] or 0)) == talk_digests(TALK)
    assert {r.conv_id: r.formatted_chars for r in chat.digests(turns, examples).collect()} == {c: sum(len(r.piece) for r in turns.collect() if r.conv_id == c) for c in {r[0] for r in TALK}}


def test_every_assistant_turn_is_an_example_with_all_before_it(spark):
    turns, examples = chat.format_conversations(spark.createDataFrame(TALK, "conv_id long, turn int, role string, text string"))
    texts = {(r.conv_id, r.example): r for r in chat.example_texts(turns, examples).collect()}
    assert set(texts) == {(1, 1), (1, 2), (3, 1), (3, 2), (None, 1), (4, 1)}
    one = texts[(1, 2)]
    assert [chat.read_turn(x + "</turn>\n") for x in one.text.split("</turn>\n")[:-1]] == [(r[2], r[3] or "") for r in TALK[:5]]
    for (conv, k), r in texts.items():
        assert r.text.count("### ") == r.text.count("</turn>") == len(r.text.split("</turn>\n")) - 1
        reply = [x for x in TALK if x[0] == conv and x[2] == "assistant"][k - 1][3]
        assert chat.unescaped(r.text[r.loss_start : r.loss_stop]) == reply and r.text.endswith(r.text[r.loss_start : r.loss_stop] + "</turn>\n")
    none = chat.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert none[0].count() == none[1].count() == chat.digests(*none).count() == 0


def test_a_piece_without_marks_is_refused():
    with pytest.raises(ValueError, match="marks"):
        chat.read_turn("### user: x")
    assert chat.read_turn("### a\\c b\\\\: x: \\l</turn>\n") == ("a: b\\", "x: <")


def drawn_reference(docs, target, p):
    def feats(t):
        w = [x.encode() for x in alnum(t)]
        return len(w), collections.Counter(zlib.crc32(b" ".join(w[i : i + k])) % p.buckets for k in range(1, p.runs + 1) for i in range(len(w) - k + 1))

    own, want = [(i, *feats(t)) for i, t in docs], sum((feats(t)[1] for t in target), collections.Counter())
    have = sum((f for _, _, f in own), collections.Counter())
    s, t = have.total(), want.total()
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s + p.buckets) / ((have[b] + 1) * (t + p.buckets)))) for b in have}
    rows = []
    for i, n, f in own:
        weight = sum(c * gain[b] for b, c in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    apt = sorted((r for r in rows if r[1] >= p.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = collections.defaultdict(list)
    for k, r in enumerate(apt[: p.percent * len(apt) // 100], 1):
        rank[r].append(k)
    return collections.Counter((i, n, w, sc, rank[r].pop(0) if rank[r] else None) for r in rows for i, _, n, w, sc in [r])


@pytest.mark.parametrize(("accuracy", "percent", "runs"), [(10_000, 10, 1), (3, 37, 2), (1, 90, 1), (50, 100, 3), (10, 1, 1)])
def test_the_bracket_draws_what_a_full_sort_draws(spark, accuracy, percent, runs):
    rng = random.Random(percent)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(rng.choice([i, i, i, 5, None]), " ".join(rng.choices(words, k=rng.choice([2, 6, 25])))) for i in range(600)]
    docs += [(1000, "w1 w2 w3 w4 w5 w6")] * 30  # equal rows, equal scores
    target = [" ".join(rng.choices(words[:50], k=30)) for _ in range(5)] + [None]
    p = resample.ResampleParams(runs=runs, buckets=97, min_words=5, percent=percent, accuracy=accuracy)
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), p)
    assert collections.Counter(map(tuple, got.collect())) == drawn_reference(docs, target, p)


def test_a_bracket_that_misses_the_cutoff_is_widened(spark):
    scores = spark.range(1000).selectExpr("id * 3 as score")
    assert resample.bracket(scores, 100, 1000, 10_000)[2] < 100
    for k in (1, 500, 1000):
        low, high, above = resample.bracket(spark.range(1000).selectExpr("case when id < 990 then 0 else id end as score"), k, 1000, 2)
        assert above < k <= above + sum(low <= s <= high for s in [0] * 990 + list(range(990, 1000)))


def test_resampling_takes_edge_rows_and_empty_tables(spark):
    docs, target = frame(spark, EDGE), spark.createDataFrame([("one two",), (None,)], "text string")
    p = resample.ResampleParams(min_words=1, percent=50)
    got = resample.resample(docs, target, p)
    assert collections.Counter(map(tuple, got.collect())) == drawn_reference([(i, t) for i, t, _ in EDGE], ["one two", None], p)
    assert resample.resample(docs.where("false"), target).count() == 0
    assert resample.resample(docs, target.where("false"), p).count() == len(EDGE)
    kept = resample.drawn(docs, got)
    assert kept.columns == docs.columns and 0 < kept.count() < len(EDGE)


def test_a_host_of_very_many_labels_costs_no_more_than_its_length(spark):
    deep = "a." * 50_000
    rules = spark.createDataFrame([("b.example.com", "/x", "block"), ("com", "", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, f"http://{deep}b.example.com/xy"), (2, f"http://{deep}example.com/xy"), (3, f"http://{deep}org/"), (4, "http://com/"), (5, "http://.com")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: ("b.example.com/x", "block"), 2: ("com", "allow"), 3: (None, "allow"), 4: ("com", "allow"), 5: ("com", "allow")}
