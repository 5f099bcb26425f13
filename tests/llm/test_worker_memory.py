"""What Python workers hold at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from fleetlake.llm import lm_score


def test_lm_blocks_are_dealt_one_at_a_time_in_small_batches():
    """Of several blocks in a batch one is worked on, and its sequences leave in parts."""
    rng, tokens = np.random.default_rng(0), 200_000
    words = rng.integers(1, 2**63, 20_000).astype(np.uint64)
    local = np.minimum(rng.zipf(1.3, tokens) - 1, len(words) - 1).astype(np.int32)
    row = {"block": 0, "doc_ids": [0, 1], "train": [True, False], "lengths": [tokens // 2, tokens // 2], "words": words.tobytes(), "tokens": lm_score._pack(local)}
    batch = pa.RecordBatch.from_pylist([{**row, "block": i} for i in range(4)])
    next(lm_score._deal_counts(iter([batch.slice(0, 1)]), 3, 50))  # what is loaded once
    tracemalloc.start()
    found = [(b.num_rows, b.nbytes, b["block"].to_pylist()) for b in lm_score._deal_counts(iter([batch]), 3, 50)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n for n, *_ in found) == 4 * 50 and all(len(set(blocks)) == 1 for *_, blocks in found)
    assert max(size for _, size, _ in found) < 2 << 20
    assert peak < 110 * tokens, peak / tokens


def test_near_copies_keep_no_table_that_is_not_read_any_more(spark, monkeypatch):
    """Sets and prefixes are gone from the shared folder before signatures meet, which takes the most disk."""
    import os

    from fleetlake.llm import ngram_join
    from fleetlake.llm.common import shared_dir

    write, there = ngram_join.materialize, {}

    def seen(df, name):
        there.setdefault(name, os.listdir(shared_dir(spark).removeprefix("file:")))
        return write(df, name)

    folder = shared_dir(spark).removeprefix("file:")
    old = set(os.listdir(folder))
    monkeypatch.setattr(ngram_join, "materialize", seen)
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words stand here")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    kinds = {name: {x.split("-")[1] for x in set(names) - old} for name, names in there.items()}
    assert "digests" not in kinds["frequent"] and not {"digests", "vertices"} & kinds["members"]
