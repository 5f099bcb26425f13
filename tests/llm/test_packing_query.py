"""The packing query over whole tables against a search through all bins; the graph of patterns without broadcasts."""

import collections

import pytest

from fleetlake.llm import entries, packing, pii

SMALL = "/root/testdata/sf0.001"


def pieces_of(rows, capacity):
    out = []
    for r in rows:
        words = tuple((r.text or "").encode().lower().split())
        for piece in range(len(words) // capacity + 1):
            out.append((min(len(words) + 1 - piece * capacity, capacity), r.doc_id, piece, words, r.source))
    return sorted(out, key=lambda p: (-p[0], p[1], p[2]))


def plain_best_fit(pieces, capacity):
    """(doc_id, piece) to (bin, start): every bin is looked at for every piece; of equally tight ones the first that became so."""
    bins, out = [], {}
    for moment, (size, doc, piece, words, source) in enumerate(pieces):
        fit = [b for b in bins if size <= b["left"] and (source is None or source not in b["sources"]) and words not in b["clusters"]]
        if fit:
            chosen = min(fit, key=lambda b: (b["left"], b["since"]))
        else:
            chosen = {"no": len(bins), "left": capacity, "sources": set(), "clusters": set()}
            bins.append(chosen)
        out[(doc, piece)] = (chosen["no"], capacity - chosen["left"])
        chosen["left"] -= size
        chosen["sources"].add(source)
        chosen["clusters"].add(words)
        chosen["since"] = moment
    return out


@pytest.mark.parametrize(("capacity", "shard_rows"), [(2048, 8192), (512, 70)])
def test_every_shard_of_the_query_is_packed_as_a_full_search_packs_it(spark, capacity, shard_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    p = packing.PackParams(capacity, shard_rows)
    got = (entries.QUERIES["op5_best_fit_packing"](spark, SMALL) if p == packing.PackParams() else packing.pack(docs, p)).collect()
    pieces = pieces_of(docs.collect(), capacity)
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got) == sorted((d, k, n) for n, d, k, _, _ in pieces)
    shard = {(r.doc_id, r.piece): r.bin_id >> 32 for r in got}
    own = collections.defaultdict(list)
    for x in pieces:
        own[shard[x[1:3]]].append(x)
    assert (len(own) > 3) == (shard_rows < 100)
    for number, part in own.items():
        assert {(r.doc_id, r.piece): (r.bin_id & 0xFFFFFFFF, r.bin_start) for r in got if r.bin_id >> 32 == number} == plain_best_fit(part, capacity)


def test_patterns_that_are_joined_find_what_broadcast_ones_find(spark):
    names = [f"user{i}x" for i in range(30)]
    texts = [f"write to the contact address {n}@example.org or else call" for n in names[:20]] + [f"write to the contact address {n} or else call" for n in names[20:]] + ["nothing here", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = [{r.doc_id: [tuple(x) for x in r.spans] for r in pii.find_pii(docs, pii.PiiParams(broadcast_rows=n)).collect()} for n in (10**6, 0)]
    assert spans[0] == spans[1]
    added = {d: s for d, s in spans[0].items() if 20 <= d < 30}
    assert len(added) == 10 and all(added.values())
