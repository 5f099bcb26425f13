"""Text operators against plain Python on small inputs, with their edge cases."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlake.llm import decontaminate, language_id, license_scan, lm_score, ngram_join, packing, pii, quality, token_store, url_filter

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def frame(spark, rows):
    """(doc_id, text, source, clashing columns)"""
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, n int, id string")


EDGE = [(1, None, "a"), (2, "", None), (3, "  \n\t", "a"), (4, "one", "a"), (4, "one", "a"), (None, "two words", "b"), (6, "w " * 3000, "a"), (7, "ä ö ü ß #1 + 2", "b")]


def test_every_operator_takes_edge_rows_and_empty_tables(spark):
    docs = frame(spark, EDGE)
    none = docs.where("false")
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, "short")], "item_id long, text string")
    for d, n in ((docs, len(EDGE)), (none, 0)):
        assert license_scan.scan_licenses(d).count() == 0
        assert pii.find_pii(d).count() == n
        assert pii.mask_pii(d).columns == d.columns
        assert pii.mask_pii(d).count() == n
        assert quality.line_quality(d).count() == n
        assert quality.without_shared_lines(d).count() == n
        assert ngram_join.jaccard_components(d).count() == n
        assert packing.pack(d).select("doc_id").count() == n + (n > 0)  # the long text needs two bins
        assert decontaminate.contained_items(d, items).count() == 0
        assert decontaminate.contained_items(d, items.where("false")).count() == 0
        learned = language_id.fit_ppm(d.selectExpr("doc_id key", "text", "source lang"))
        assert language_id.identify(d, learned).count() == n
        scored = lm_score.score_texts(d.selectExpr("*", "doc_id > 3 as train"))
        assert scored.count() == n
        assert token_store.read_digests(token_store.write_store(d)).count() == n


def test_license_notices_are_found_whole_and_changed(spark):
    mit = dict(license_scan.TEMPLATES)["mit"]
    words = mit.split()
    changed = " ".join(words[:30] + ["hereby"] + words[31:])
    rows = [(1, "x y z " + mit + " tail", "a"), (2, changed, "a"), (3, "Released under the MIT licence", "a"), (4, "foo. RELEASED under the MIT License, bar", "a"), (5, " ".join(words[:40]), "a")]
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got == {(1, "mit"), (2, "mit"), (4, "mit-short")}


def test_license_query_equals_plain_containment(spark, texts):
    got = {(r.doc_id, r.license) for r in entry.queries()["op1_license_scan"](spark, SMALL).collect()}
    plain = lambda t: t.encode().translate(decontaminate.PLAIN).split()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = set()
    for d, r in texts.items():
        have = grams(plain(r.text or ""))
        want |= {(d, n) for n, t in license_scan.TEMPLATES if 100 * len(have & grams(plain(t))) >= 80 * len(grams(plain(t)))}
    assert got == want


def reference_spans(t):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y z@@q.r.s .@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 12", "+1 (464) 555-9887 + 1 +12345678 +1-2", "é a@b.co ü 1.2.3.4"])
def test_seed_spans_equal_the_patterns(text):
    assert [(pii.KINDS[k], s, e) for k, s, e in pii.seed_spans(text)] == reference_spans(text)


def test_pii_query_equals_the_patterns(spark, texts):
    for r in entry.queries()["op2_pii"](spark, SMALL).collect():
        spans = reference_spans(texts[r.doc_id].text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in spans) for x in pii.KINDS)
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r.spans.split(","))  if spans else True


def test_patterns_discover_what_the_seeds_missed(spark):
    rows = [(i, f"blah {i} your hotline number: +1 555 0{i:02d} 99{i:02d} thanks", "a") for i in range(10, 30)]
    rows += [(90, "so your hotline number: 555.123.4567 then", "a"), (91, "a value 555.123.9999 then", "a")]
    spans = {r.doc_id: [(pii.KINDS[x.k], x.s, x.e) for x in r.spans] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert spans[90] == [("phone", 24, 36)]
    assert spans[91] == []
    masked = {r.doc_id: r.text for r in pii.mask_pii(frame(spark, rows)).collect()}
    assert masked[90] == "so your hotline number: [PHONE] then"
    assert masked[10] == "blah 10 your hotline number: [PHONE] thanks"


def test_shared_lines_go_and_depleted_documents_too(spark):
    p = quality.LineParams(max_docs=2, min_words=5)
    body = [" ".join("abcd"[i] * (1 + j % 9) + "xyz"[j % 3] * (1 + j // 9) for j in range(60)) for i in range(4)]
    rows = [(i, f"Subscribe 20{i} now\n{body[i]}", "h") for i in range(4)] + [(9, "Subscribe 777 now\nsubscribe   111 NOW\nfine words here", "h"), (10, "Subscribe 333 now\n" + body[0], "other")]
    rows += [(20 + i, body[3] + " same", "h") for i in range(5)] + [(30 + i, body[2] + " twice", "h") for i in range(2)] * 3
    rows += [(40, None, "h"), (40, "Subscribe 140 now\nother text", "h")]
    out = quality.line_quality(frame(spark, rows), p).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert [got[i].cut_words for i in (0, 3, 9, 10, 30)] == [3, 3, 6, 0, 0]
    assert got[0].kept and got[9].kept  # a third of its words is left
    # A text in more documents of a host than the limit is shared lines only; repeated rows are one document.
    assert [(r.cut_words, r.kept, r.base_failed) for r in out if 20 <= r.doc_id < 25] == [(61, False, False)] * 5
    assert all(r.kept for r in out if 30 <= r.doc_id < 32)
    clean = collections.defaultdict(set)
    for r in quality.without_shared_lines(frame(spark, rows), p).collect():
        clean[r.doc_id].add(r.text)
    assert clean[0] == {body[0]} and clean[9] == {"fine words here"} and next(iter(clean[10])).startswith("Subscribe")
    assert clean[20] == {""} and clean[40] == {None, "other text"}


def jaccard_reference(rows, k=3, percent=90):
    sets, parent = [], {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            c = len(s & t)
            if c and 100 * c >= percent * (len(s) + len(t) - c):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(i, len(s), find(i)) for i, s in sets]


@pytest.mark.parametrize("often", [24, 1])
def test_jaccard_components_on_groups_of_copies(spark, often):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size, copies, edits in ((200, 60, 2), (40, 30, 1), (12, 20, 1), (9, 6, 1), (500, 10, 6), (3, 4, 0), (2, 4, 0), (1, 3, 0)):
        base = [f"g{size}w{int(x)}" for x in rng.integers(0, 400, size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(int(rng.integers(0, edits + 1))):
                w[int(rng.integers(0, len(w)))] = f"e{int(rng.integers(0, 10**6))}"
            rows.append((int(n * 7 % 1009), " ".join(w) if n % 2 else " ".join(w).upper()))
            n += 1
    params = ngram_join.JoinParams(frequent_above=often, small_bucket=max(2, often), broadcast_rows=10**6 if often > 1 else 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, params).collect())
    assert got == sorted(jaccard_reference(rows))


def test_packing_respects_conflicts_and_capacity(spark):
    rows = [(i, " ".join(f"a{i}b{j}" for j in range(5 + i * 37 % 400)) if i % 5 else "same text here", f"s{i % 3}" if i % 2 else "hot") for i in range(300)]
    p = packing.PackParams(capacity=128, shard_rows=100)
    out = packing.pack(frame(spark, rows), p).collect()
    source, text = {i: s for i, _, s in rows}, {i: t for i, t, _ in rows}
    bins = collections.defaultdict(list)
    total = collections.Counter()
    for r in out:
        bins[r.bin_id].append(r)
        total[r.doc_id] += r.n_tokens
    assert total == {i: len(t.split()) + 1 for i, t in text.items()}
    for members in bins.values():
        members.sort(key=lambda r: r.bin_start)
        assert [r.bin_start for r in members] == [sum(x.n_tokens for x in members[:i]) for i in range(len(members))]
        assert sum(r.n_tokens for r in members) <= 128
        assert len({source[r.doc_id] for r in members}) == len(members) == len({text[r.doc_id] for r in members})


def test_equal_rows_spread_over_shards_and_clusters_may_be_given(spark):
    rows = [(1, "a b c d", None)] * 500 + [(2 + i, f"w{i} x y z", None) for i in range(100)]
    out = packing.pack(frame(spark, rows), packing.PackParams(capacity=20, shard_rows=100)).collect()
    assert len(out) == 600 and len({(r.bin_id, r.bin_start) for r in out}) == 600
    shards = collections.Counter(r.bin_id >> 32 for r in out if r.doc_id == 1)
    assert len(shards) == 6 and max(shards.values()) < 160
    given = frame(spark, rows).withColumn("component_id", F.when(F.col("doc_id") > 50, F.lit(7)))
    members = collections.defaultdict(list)
    for r in packing.pack(given, packing.PackParams(capacity=20, shard_rows=1000), cluster_col="component_id").collect():
        members[r.bin_id].append(r.doc_id)
    assert all(sum(d > 50 for d in m) <= 1 for m in members.values()) and any(m.count(1) > 1 for m in members.values())


def test_long_rule_paths_count(spark):
    path = "/" + "p" * 9000
    rules = spark.createDataFrame([("a.com", path, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, f"http://x.a.com{path}/q"), (2, f"http://x.a.com{path[:-1]}"), (3, None)], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(pages, rules).orderBy("page_id").collect()] == ["block", "allow", "allow"]


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(5)
    sizes = sorted((int(x) for x in rng.integers(1, 60, 400)), reverse=True)
    src, clu = rng.integers(-1, 6, 400).tolist(), rng.integers(-1, 50, 400).tolist()
    bins, _ = packing.best_fit(sizes, src, clu, 100)
    left, ss, cs = [], [], []
    for size, s, c, b in zip(sizes, src, clu, bins, strict=True):
        fits = [left[i] for i in range(len(left)) if left[i] >= size and (s < 0 or s not in ss[i]) and (c < 0 or c not in cs[i])]
        if b == len(left):
            assert not fits
            left.append(100), ss.append(set()), cs.append(set())
        else:
            assert left[b] == min(fits)
        left[b] -= size
        ss[b].add(s), cs[b].add(c)


def test_language_of_held_out_documents(spark, texts):
    out = [r for r in entry.queries()["op6_language_id"](spark, SMALL).collect()]
    assert len(out) == len(texts)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    assert np.mean([r.lang_pred == texts[r.doc_id].lang for r in held]) > 0.95


def plain_ppm_bits(train, text, order):
    """Code length of a text, byte by byte, from counts of contexts that are looked up as they come."""
    after = collections.defaultdict(collections.Counter)
    for t in train:
        for i, byte in enumerate(t):
            for size in range(min(order, i) + 1):
                after[t[i - size : i]][byte] += 1

    @functools.cache
    def share(context, byte):
        c = after.get(context)
        if not c:
            return share(context[1:], byte) if context else 1 / 256
        whole, kinds = sum(c.values()), len(c)
        if byte in c:
            return c[byte] / (whole + kinds)
        lower = (lambda x: share(context[1:], x)) if context else (lambda x: 1 / 256)
        return kinds / (whole + kinds) * lower(byte) / sum(lower(x) for x in range(256) if x not in c)

    return -sum(math.log2(share(text[max(0, i - order) : i], byte)) for i, byte in enumerate(text))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_equal_plain_ppm(spark, order):
    train = {"x": ["abracadabra", "abba cab"], "y": ["zzz yzzy z", "häuser über häuser"], "z": ["a"]}
    rows = [(i, t, g) for g, ts in train.items() for i, t in enumerate(ts)]
    p = language_id.PpmParams(order=order)
    model = language_id.fit_ppm(spark.createDataFrame(rows, "key long, text string, lang string"), p)
    texts = [x.encode() for x in ("abraz", "cab cab", "", "über 12", "zyzzy häu", "q" * 9 + "ab")]
    buffer = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    want = [[plain_ppm_bits([t.encode() for t in train[g]], text, order) for g in model.languages] for text in texts]
    for piece in (language_id.PIECE, 7, 2):  # borders of pieces change nothing
        assert np.allclose(model.code_lengths(buffer, starts, order, piece), want, rtol=1e-4)
    single = language_id.identify(spark.createDataFrame([(1, "123"), (2, None), (3, "zz")], "doc_id long, text string"), model, p)
    assert [r.lang_pred for r in single.orderBy("doc_id").collect()] == ["und", "und", "y"]


def test_trees_and_bounds_come_from_all_labelled_texts(spark, monkeypatch):
    """Before, both came from a sample of about 1,500 texts a language."""
    rng = np.random.default_rng(6)
    texts = {g: ["".join(rng.choice(list(letters), 3)) for _ in range(1900)] + ["".join(rng.choice(list(letters), 120 + i)) for i in range(25)] for g, letters in (("x", "abcde "), ("y", "efghi "))}
    rows = spark.createDataFrame([(i, t, g) for g, ts in texts.items() for i, t in enumerate(ts)], "key long, text string, lang string")
    asked = [b"abba cede", b"hi fee", b"zzz"]
    buffer = np.frombuffer(b"".join(t + b"\0" for t in asked), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in asked)])[:-1]
    for most in (language_id.GRAMS_AT_ONCE, 10):
        monkeypatch.setattr(language_id, "GRAMS_AT_ONCE", most)
        model = language_id.fit_ppm(rows)
        want = [[plain_ppm_bits([t.encode() for t in texts[g]], text, 3) for g in model.languages] for text in asked]
        assert np.allclose(model.code_lengths(buffer, starts, 3), want, rtol=1e-4)
    bounds = language_id.bits_bounds(rows, model)
    for g, ts in texts.items():
        long = [t.encode() for t in ts if len(t) >= 100]
        bits = model.code_lengths(np.frombuffer(b"".join(t + b"\0" for t in long), np.uint8), np.cumsum([0, *(len(t) + 1 for t in long)])[:-1], 3)[:, model.languages.index(g)]
        assert abs(bounds[g] / 1.25 - np.quantile(bits / [len(t) for t in long], 0.95)) < 0.002


def test_rare_languages_keep_their_contexts_and_many_languages_are_learned(spark):
    rng = np.random.default_rng(4)
    words = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    alphabets = {f"l{i:03d}": "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(4)) + chr(0x400 + i) for i in range(240)}
    rows = [(i, words("abcdefghijklmnopqrstuvwxyz", 400), "big") for i in range(60)] + [(1000 + i, words(x, 30), g) for i, (g, x) in enumerate(alphabets.items())]
    model = language_id.fit_ppm(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert len(model.languages) == 241
    asked = [(i, words(x, 12)) for i, x in enumerate(alphabets.values())]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert np.mean([got[i] == g for i, g in enumerate(alphabets)]) > 0.95


def test_lm_scores_equal_plain_backoff(spark, texts):
    p = lm_score.LmParams(block_tokens=3000, bucket_keys=20_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "text", "coalesce(pmod(crc32(cast(doc_id as string)), 10), 0) <> 0 as train")
    got = {r.doc_id: r for r in lm_score.score_texts(docs, p).collect()}
    toks = {d: [*(r.text or "").encode().lower().split(), None] for d, r in texts.items()}
    train = [t for d, t in toks.items() if zlib.crc32(str(d).encode()) % 10]
    uni = collections.Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    state = {w for w, c in uni.items() if c >= p.least_count}
    kept = [{(w,): uni[w] for w in state}]
    counts = {("<s>",): len(train), **kept[0]}
    for size in (2, 3):
        c = collections.Counter()
        for t in train:
            s = ["<s>", *t]
            for i in range(len(s) - size + 1):
                g = tuple(s[i : i + size])
                if all(w in state for w in g[1:]) and (g[0] == "<s>" or g[0] in state) and (size == 2 or (g[:-1] in counts and g[1:] in counts)):
                    c[g] += 1
        kept.append({g: k for g, k in c.items() if k >= p.least_count})
        counts.update(kept[-1])
    one = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    after = collections.defaultdict(list)
    for g in (*kept[1], *kept[2]):
        after[g[:-1]].append(g[-1])

    def prob(h, w):
        if not h:
            return one(w)
        if (*h, w) in counts and w is not None or (*h, w) in counts:
            return (counts[(*h, w)] - p.discount) / counts[h]
        weight = 1.0
        if h in after:
            left = 1 - sum((counts[(*h, x)] - p.discount) / counts[h] for x in after[h])
            weight = left / (1 - sum(prob(h[1:], x) for x in after[h]))
        return weight * prob(h[1:], w)

    for d, t in list(toks.items())[:60]:
        total, s = 0.0, ["<s>", *t]
        for i in range(1, len(s)):
            h = tuple(s[max(0, i - 2) : i])
            while h and h not in counts:
                h = h[1:]
            total += math.log10(prob(h, s[i]))
        r = got[d]
        assert r.train_tokens == n and r.n_tokens == len(t) and r.n_known == sum(uni[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10(one(w)) for w in t), rel=1e-9)
        assert r.score == pytest.approx(total, rel=1e-6)


def test_lm_keeps_rare_sequences_of_a_large_corpus(spark):
    """A sequence counts from its second occurrence on, however many other tokens there are."""
    rare = "zeta eta theta iota"
    rows = [(i, " ".join(f"w{(i * 7919 + j * j) % 50}" for j in range(3000)), True) for i in range(1000)]
    rows += [(5001, rare, True), (5002, rare, True), (5003, rare, False), (5004, "eta zeta iota theta", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(4)
    got = {r.doc_id: r for r in lm_score.score_texts(docs).where("doc_id > 5000").collect()}
    assert got[5003].base_score == pytest.approx(got[5004].base_score)
    # <s> zeta: 1.25 of 1002; four arcs of 1.25 of 2 follow.
    assert got[5003].score == pytest.approx(math.log10(1.25 / 1002) + 4 * math.log10(1.25 / 2), rel=1e-6)
    assert got[5003].score > got[5004].score + 5


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.com/en/x", "https://WWW.Example.COM/en/77?q", "http://example.net/de/8", "http://sub.example.net/de/9", "http://x.org/es", "http://notcom/en/", "http://com/en/", "ftp://x.org/es/?a#b", "http:///en/", "http://a.com/en/x"]
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, rule int")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).orderBy("page_id").collect()]
    assert [g[2] for g in got] == [None, None, None, "com/en/", "example.com/en/7", "example.net/de/8", "net/de/", None, None, "com/en/", "org/es/", None, "com/en/"]
    assert got[4] == ("www.example.com", "/en/77", "example.com/en/7", "allow")
    assert url_filter.filter_urls(pages, rules.where("false")).where("verdict = 'allow' and rule is null").count() == len(urls)
    assert url_filter.filter_urls(pages.where("false"), rules).count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_benchmark_items_in_documents(spark, limit):
    rng = np.random.default_rng(1)
    word = lambda k: " ".join(f"v{int(x)}" for x in rng.integers(0, 3000, k))
    items = [(i, word(6 + i * 3)) for i in range(30)] + [(99, "four words are few")]
    docs, want = [], set()
    for d in range(60):
        i, t = items[d % 30]
        w = t.split()
        if d % 3 == 1:
            w[len(w) // 2] = "changed"
        if d % 3 == 2:
            w = w[: len(w) // 2]
        t = word(int(rng.integers(5, 3000))) + " " + " ".join(w).upper() + ", " + word(50)
        docs.append((d, t, "s"))
    grams = lambda t: {tuple(w[j : j + 5]) for w in [t.encode().translate(decontaminate.PLAIN).split()] for j in range(len(w) - 4)}
    for d, t, _ in docs:
        g = grams(t)
        want |= {(d, i, len(grams(x)), len(grams(x) & g)) for i, x in items if grams(x) and 100 * len(grams(x) & g) >= 80 * len(grams(x))}
    p = decontaminate.ContainmentParams(broadcast_rows=limit)
    got = {tuple(r) for r in decontaminate.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), p).collect()}
    assert got == want and len(got) >= 20


@pytest.mark.parametrize("limit", [10**6, 0])
def test_short_and_equal_items_are_found(spark, limit):
    items = [(1, "the red fox"), (2, "The RED fox!"), (3, "one"), (4, ""), (5, "a b c d e f"), (6, "a b c d e f")]
    docs = [(1, "see the red, fox run", "s"), (2, "red fox the", "s"), (3, "one", "s"), (4, None, "s"), (5, "x a b c d e f y", "s"), (5, "x a b c d e", "s"), (6, "", "s")]
    got = decontaminate.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), decontaminate.ContainmentParams(broadcast_rows=limit)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, 1), (1, 2, 1, 1), (3, 3, 1, 1), (5, 5, 2, 2), (5, 6, 2, 2)]


def test_short_templates_and_scattered_edits(spark):
    mit = dict(license_scan.TEMPLATES)["mit"].split()
    # An edit every 26 words leaves a little over four fifths of the five-word shingles and few whole windows.
    edited = [("new" if i % 26 == 13 else w) for i, w in enumerate(mit)]
    docs = [(1, "under MIT License here, MIT license", "a"), (2, "MIT", "a"), (3, "pad " * 7 + " ".join(edited) + " pad", "a"), (4, None, "a")]
    got = {(r.doc_id, r.license, r.first_word, r.end_word) for r in license_scan.scan_licenses(frame(spark, docs), [("mit-name", "MIT License"), ("mit", " ".join(mit)), ("none", "")]).collect()}
    assert {g[:2] for g in got} == {(1, "mit-name"), (3, "mit")} and (1, "mit-name", 1, 6) in got


def test_wavelet_matrix_round_trip():
    rng = np.random.default_rng(2)
    for values in ([], [0], [5], rng.integers(0, 50, 3000).tolist(), rng.integers(0, 49408, 2000).tolist(), [70000, 3, 70000]):
        m = token_store.WaveletMatrix.from_bytes(token_store.WaveletMatrix.build(np.array(values, np.int64)).to_bytes())
        assert m.values().tolist() == values
        for i in range(0, len(values), 97):
            assert m.access(i) == values[i]
            assert m.rank(values[i], i) == values[:i].count(values[i])
        for x in values[:5]:
            assert m.locate(x) == [i for i, y in enumerate(values) if y == x]
        assert m.rank(1 << 20, len(values)) == 0


def test_token_store_equals_encoding_whole_texts(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    got = {r.doc_id: r for r in entry.queries()["op10_token_store"](spark, SMALL).collect()}
    start = 0
    for d in sorted(texts):
        ids = [*t.encode(texts[d].text or "", add_special_tokens=False).ids, 2]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = ["a b c  d\r\ne\x1cf <|endoftext|> ΑΣ Σ é don't 12 34", "\n\n", "İ ǅ"]
    mine = token_store.Encoder(None).encode([x.encode() for x in odd])
    assert [m.tolist() for m in mine] == [t.encode(x, add_special_tokens=False).ids for x in odd]
    r = random.Random(4)
    odd = ["".join(r.choices("ab éßñÿÀÉ÷×Σςσ'.,12 \n\t\r\u0301ǅİ<|>가漢ि", k=r.randrange(30))) for _ in range(3000)] + ["x<|startoftext|>y", "<|ENDOFTEXT|> z"]
    assert [m.tolist() for m in token_store.Encoder(None).encode([x.encode() for x in odd])] == [t.encode(x, add_special_tokens=False).ids for x in odd]


def test_other_tokenizers_encode_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(path)
    rows = [(1, "Hello World", "a"), (2, None, "a"), (3, "Two  spaces\n\nand <|endoftext|> inside", "a")]
    p = token_store.StoreParams(tokenizer=path, end_id=50256)
    got = {r.doc_id: r for r in token_store.read_digests(token_store.write_store(frame(spark, rows), p)).collect()}
    for d, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 50256]
        assert (got[d].n_tokens, got[d].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_token_store_gives_added_tokens_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = [(1, "plain words", "a"), (2, "one<|endoftext|>Two <|startoftext|> three", "a"), (3, "Up <|EndOfText|> case", "a"), (4, "after <|end", "a")]
    got = {r.doc_id: r for r in token_store.read_digests(token_store.write_store(frame(spark, rows))).collect()}
    start = 0
    for d, text, _ in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {49407, 49406} <= set(t.encode(rows[1][1], add_special_tokens=False).ids)


def test_discovered_instances_lead_to_further_patterns(spark):
    rows = [(i, f"blah {i} your hotline number: +1 555 0{i:02d} 99{i:02d} thanks", "a") for i in range(10, 30)]
    for i in range(40, 46):
        rows += [(i, f"so your hotline number: 555.123.45{i} then", "a"), (i + 100, f"or ring desk: 555.123.45{i} then", "a")]
    rows += [(90, "or ring desk: 030 123 4567 then", "a"), (91, "a value 030 123 9999 then", "a"), (92, "or ring desk: " + "7-" * 40 + "7 then", "a")]
    spans = {r.doc_id: [(pii.KINDS[x.k], x.s, x.e) for x in r.spans] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert spans[90] == [("phone", 14, 26)] and spans[91] == [] and spans[92] == []
    assert spans[140] == [("phone", 14, 26)]
    long = "a" * 90 + "@host"
    assert pii.candidate_spans(f"mail {long} or 4111 1111 1111 1112.", []) == [(0, 5, 100), (2, 104, 123)]


def plain_graph(rows, p):
    """Discovered (row, kind, start, end) by the same rules over dictionaries."""
    edges, places, total = collections.Counter(), [], collections.Counter()
    beside = lambda w, v: [("l", *w[-1:])] * bool(w) + [("l", *w)] * (len(w) == 2) + [("r", *v)] * (len(v) == 2)
    for n, (_, t, _) in enumerate(rows):
        seeds = pii.seed_spans(t)
        for spans, is_seed in ((seeds, True), (pii.candidate_spans(t, seeds), False)):
            for k, s, e in spans:
                words = [x.encode().translate(decontaminate.PLAIN).split() for x in (t[:s], t[e:])]
                i = t[s:e].lower()
                places += [] if is_seed else [(n, k, i, s, e)]
                for q in beside(words[0][-2:], words[1][:2]):
                    edges[q, k, i, is_seed] += 1
        w = t.encode().translate(decontaminate.PLAIN).split()
        total.update([("l", x) for x in w] + [(d, *x) for x in zip(w, w[1:]) for d in "lr"])
    seeds = {(k, i): 1.0 for _, k, i, s in edges if s}
    scores, open_ = dict(seeds), {(q, k) for q, k, _, s in edges if not s}
    while True:
        found, hits = collections.defaultdict(set), collections.Counter()
        for (q, form, i, _), n in edges.items():
            for k in range(4):
                if (k, i) in scores and form in (-1, k):
                    found[q, k].add(i)
                    hits[q, k] += n * scores[k, i]
        weight = {x: min(hits[x] / total[x[0]], 0.999999) for x, members in found.items() if len(members) >= p.least_seeds and {(x[0], -1), (x[0], x[1])} & open_}
        miss = collections.defaultdict(dict)
        for q, form, i, s in edges:
            for k in range(4):
                if not s and form in (-1, k) and (q, k) in weight:
                    miss[k, i][q] = 1 - weight[q, k]
        new = {x: 1 - math.prod(m.values()) for x, m in miss.items() if 1 - math.prod(m.values()) >= p.accept} | seeds
        done = len(new) == len(scores)
        scores = new
        if done:
            break
    out = set()
    for n, form, i, s, e in places:
        kinds = [k for k in range(4) if (k, i) in scores]
        if kinds and form in (-1, *kinds):
            out.add((n, form if form >= 0 else max(kinds, key=lambda k: (scores[k, i], -k)), s, e))
    return out


def test_the_pattern_graph_equals_plain_dictionaries(spark):
    rng = np.random.default_rng(12)
    pick = lambda x: x[int(rng.integers(0, len(x)))]
    digits = lambda k: "".join(str(int(x)) for x in rng.integers(0, 10, k))
    forms = [lambda: f"+1 555 {digits(7)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"acct-{digits(5)}x", lambda: f"u{digits(3)}@home", lambda: f"ann{digits(2)}@mail.org", lambda: f"10.{digits(1)}.{digits(1)}.7", lambda: digits(4)]
    rows = []
    for i in range(400):
        lead = pick(["my phone number", "call", "write to", "host", "the", "reach desk", "so"])
        form = forms[0] if lead == "my phone number" and rng.random() < 0.8 else forms[4] if lead == "write to" and rng.random() < 0.9 else pick(forms)
        rows.append((i, f"{pick(['hello', 'well then', 'note'])} {lead}: {form()} {pick(['thanks a lot', 'or not', 'ok'])}", "a"))
    p = pii.PiiParams()
    got = {(r.doc_id, x.k, x.s, x.e) for r in pii.find_pii(frame(spark, rows), p).collect() for x in set(r.spans) - set(r.base)}
    want = plain_graph(rows, p)
    assert got == want
    found = {rows[n][1][s:e] for n, _, s, e in want}
    assert any(x.startswith("acct-") for x in found) and any(x.endswith("@home") for x in found)


def test_long_words_beside_an_instance_count(spark):
    long = "w" * 5000
    rows = [(i, f"see {long} code: +1 555 0{i:02d} 99{i:02d} stop", "a") for i in range(10, 20)] + [(90, f"see {long} code: zx-81q stop", "a")]
    spans = {r.doc_id: [(pii.KINDS[x.k], r_text[x.s : x.e]) for x in r.spans] for r in pii.find_pii(frame(spark, rows)).collect() for r_text in [dict((a, b) for a, b, _ in rows)[r.doc_id]]}
    assert spans[90] == [("phone", "zx-81q")]
    assert pii.words_beside(f"a {long} ", 5003, 5003)[0] == [b"a", long.encode()]
