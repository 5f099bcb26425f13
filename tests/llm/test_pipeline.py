"""The pipeline's stages against plain Python on the smallest tables."""

import numpy as np

import corpus_pipeline
from fleetlake.llm import decontaminate
from tests.llm.test_text_operators import SMALL, jaccard_reference, reference_spans


def grams(t):
    w = t.encode().translate(decontaminate.PLAIN).split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL)
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            docs = docs.cache()
        rows, old = docs.collect(), before.collect()
        kept[name] = rows
        if name == "language_id":
            assert len(rows) >= 0.98 * sum(any(c.isalpha() for c in r.text or "") for r in old)
        elif name == "ngram_jaccard":
            groups = jaccard_reference([(r.doc_id, r.text) for r in old], 5, 80)
            assert sorted(r.doc_id for r in rows) == sorted(i for i, _, c in groups if i == c)
        elif name == "decontamination":
            items = [grams(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            leaks = {r.doc_id for r in old for g in items if g and 100 * len(g & grams(r.text)) >= 80 * len(g)}
            assert {r.doc_id for r in rows} == {r.doc_id for r in old} - leaks and leaks
        elif name == "pii":
            texts = {r.doc_id: r.text for r in rows}
            assert len(texts) == len(old)
            for r in old:
                for _, s, e in reference_spans(r.text):
                    assert r.text[s:e] not in texts[r.doc_id] or len(r.text[s:e]) < 8
        else:
            assert {r.doc_id for r in rows} == {r.doc_id for r in old}


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "piece", "n_tokens", "bin_id", "bin_start"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
    rows = out.collect()
    assert len(rows) > 100 and sorted(rows) == sorted(docs.collect())


def test_every_stage_takes_edge_rows_and_empty_tables(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "house", "river"], n)) + " end"
    long = text(60_000)
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, text(40), "en"), (None, text(30), "en"), (6, long, "en"), (6, text(50), "en"), (7, long, None), (8, text(45) + " mail a.b@c.de", "en"), (9, "123 456", "en")]
    rows += [rows[3]] * 2
    docs = spark.createDataFrame([(i, t, g, None, 5, "x", 7) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars int, row string, id int")
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    out = {name: stage(spark, docs, SMALL) for name, stage in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), SMALL)
        assert none.count() == 0 and none.columns == out[name].columns
        if name != "packing":
            assert out[name].columns == docs.columns and out[name].dtypes == docs.dtypes
    assert ids(out["language_id"]) == [0, 4, 4, 4, 6, 6, 7, 8]
    assert {r.lang for r in out["language_id"].collect()} == {"en"} and {r.row for r in out["language_id"].collect()} == {"x"}
    assert ids(out["ngram_jaccard"]) == [0, 1, 2, 3, 4, 6, 6, 8, 9]
    assert ids(out["decontamination"]) == sorted(i or 0 for i, *_ in rows)
    masked = {r.doc_id: r for r in out["pii"].collect() if r.doc_id not in (4, 6)}
    assert masked[1].text is None and masked[8].text.endswith(" mail [EMAIL]") and masked[8].n_chars == len(masked[8].text) and out["pii"].count() == len(rows)
    total = {}
    for r in out["packing"].collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {d: sum(len((t or "").split()) + 1 for i, t, _ in rows if i == d) for d in {i for i, *_ in rows}}


def test_language_stage_rejects_gibberish_and_unlearned_languages(spark):
    rng = np.random.default_rng(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    text = lambda make, n: " ".join(make(int(rng.integers(2, 10))) for _ in range(n))
    noise = lambda k: "".join(chr(int(c)) for c in rng.integers(97, 123, k))
    symbols = lambda k: "".join("#*$%&|<>{}=~^a"[int(c)] for c in rng.integers(0, 14, k))
    greek = lambda k: "".join(chr(int(c)) for c in rng.integers(945, 970, k))
    bad = [(10**7 + i, text(make, 80), None, "s") for i, make in enumerate([noise, symbols, greek] * 3)]
    clean = [r for r in docs.where("text is not null and length(text) between 300 and 3000 and doc_id is not null").orderBy("doc_id").limit(200).collect()]
    mixed = docs.union(spark.createDataFrame(bad, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, mixed, "").select("doc_id").collect()}
    assert not kept & {b[0] for b in bad}
    assert len({r.doc_id for r in clean} & kept) >= 0.97 * len({r.doc_id for r in clean})
    print("kept", len(kept), docs.where(r"text rlike '\\p{L}'").count())


def test_copies_stage_links_five_words_from_four_fifths_on(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = [f"g{g}w{int(x)}" for x in rng.integers(0, 10**6, 60 + 20 * g)]
        for c in range(6):
            w = list(base)
            for at in rng.integers(0, len(w), c):
                w[int(at)] = f"e{g}c{c}at{int(at)}"
            rows.append((len(rows), " ".join(w)))
    base = [f"pair{i}" for i in range(100)]
    rows += [(900, " ".join(base)), (901, " ".join([*base[:30], "x", *base[31:70], "y", *base[71:]]))]
    kept = sorted(r.doc_id for r in corpus_pipeline.copies_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "", corpus_pipeline.NEAR).collect())
    assert kept == sorted(i for i, _, c in jaccard_reference(rows, 5, 80) if i == c)
    assert 900 in kept and 901 not in kept and 901 in {i for i, _, c in jaccard_reference(rows) if i == c}


def test_stages_hand_on_columns_of_any_name_and_know_rows_without_an_id(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "house", "river", "stone", "cloud"], n)) + " end"
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    plain, copied = text(60), text(70)
    rows = [(1, plain), (None, plain), (None, copied), (None, copied), (None, f"{text(30)} {item} {text(30)}"), (5, f"{text(20)} {item}"), (7, f"{text(40)} mail a.b@c.de"), (None, f"{text(40)} mail d.e@f.org"), (None, None), (8, None)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "__text", "aid", "ath", "added", "rest", "__rest", "a.b", "row", "th", "c0", "did", "back`tick"]
    kinds = ["long", "string", "string", "string", "int"] + ["string"] * 12
    extra = [f"{c}!" for c in names[5:]]
    docs = spark.createDataFrame([(i, t, "en", "s", 5, *extra) for i, t in rows], ", ".join("`" + n.replace("`", "``") + "` " + k for n, k in zip(names, kinds, strict=True)))
    kept = {"language_id": rows[:8], "ngram_jaccard": [r for k, r in enumerate(rows) if k not in (1, 3)], "decontamination": [r for r in rows if not r[1] or item not in r[1]], "pii": [(i, t and t.replace("a.b@c.de", "[EMAIL]").replace("d.e@f.org", "[EMAIL]")) for i, t in rows]}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = [tuple(r) for r in out.collect()]
        assert sorted([r[:2] for r in got], key=key) == sorted(kept[name], key=key), name
        assert all(list(r[5:]) == extra and r[3] == "s" for r in got)
        assert name != "pii" or all(r[4] == (r[1] and len(r[1])) for r in got)
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()} == {r[0] for r in rows}
