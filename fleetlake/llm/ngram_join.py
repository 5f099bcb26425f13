"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of word shingles; the tokens are hashes of shingles in hash
order. Tokens below a hash bound are counted over all documents: *rare* ones are
signatures of their own. A document's prefix is as many of its rare tokens as it
needs for one at least to survive in any set that reaches the threshold. Where
the prefix runs out of rare tokens, as in large groups of near copies, it extends
over the whole set: its tokens are dealt into more sub-classes than the threshold
allows differences, so that in one sub-class two linked sets have the very same
combination of tokens, and each combination is a signature. Two sets that reach
the threshold share a signature; shared ones are verified exactly on the whole
sets.

Equal sets are one vertex. In large buckets and in those of combinations each
member first meets pivots only and components are contracted. Small buckets then
give all their pairs of different components. What is still in different
components of a large bucket's group is compared in blocks, which give only the
links that join components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import drop_old_shuffles, materialize, mix, pieces, release, shingle_hashes, texts_of, word_hashes

def counted_below(percent: int) -> int:
    """Tokens below this hash have their frequency counted: nearly twice as many as a prefix needs (3/16 of all at 90 %)."""
    return -(2**63) + min(160, 3 * (100 - percent)) * 2**64 // 160 - (3 * (100 - percent) >= 160)


@dataclass(frozen=True)
class JoinParams:
    shingle: int = 3
    percent: int = 90  # links: 100 * intersection >= percent * union
    frequent_above: int = 24  # documents with a token beyond which it is frequent
    small_bucket: int = 24  # buckets up to this size give all their pairs of different components; no less than frequent_above
    block_rows: int = 1024  # sets of a group that are compared with as many others in one task
    block_tokens: int = 2_000_000  # that these sets hold, about
    broadcast_rows: int = 1_000_000  # 8 MB of ids or tokens; larger ones are joined by a shuffle


def token_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes as int64; a text of fewer than k words is one shingle."""
    h = word_hashes(text.lower().split())
    if not len(h):
        return np.empty(0, np.int64)
    if len(h) < k:
        return mix(shingle_hashes(h, len(h)) + np.uint64(len(h))).view(np.int64)
    return np.unique(shingle_hashes(h, k).view(np.int64))


def _digest_batches(batches, k: int, below: int):
    import pyarrow as pa

    for b in pieces(batches):
        n, d1, d2, toks = [], [], [], []
        for t in texts_of(b.column(1)):
            s = token_set(t, k)
            u = s.view(np.uint64)
            n.append(len(s))
            d1.append(int(mix(u + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)))
            d2.append(int(np.bitwise_xor.reduce(mix(u + np.uint64(2)), initial=np.uint64(0)).astype(np.int64)))
            toks.append(s[: int(np.searchsorted(s, below))])
        offsets = np.cumsum([0, *map(len, toks)]).astype(np.int32)
        flat = np.concatenate(toks) if toks else np.empty(0, np.int64)
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n", "d1", "d2", "toks"])


def bands(percent: int) -> list[int]:
    """Bounds of size bands so wide that two sets that reach the threshold are in one or in neighbours."""
    b = [1]
    while b[-1] < 2**40:
        b.append(max(b[-1] + 1, -(-b[-1] * 101 // percent)))
    return b


def needed(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` of which one at least is in any set that reaches the threshold."""
    return n - -(-percent * n // 100) + 1


def combinations(s: np.ndarray, percent: int, bounds: list[int]) -> np.ndarray:
    """Signatures of a whole set: the tokens of each sub-class, in its own band and the next one."""
    import bisect

    u = s.view(np.uint64)
    where, what = mix(u + np.uint64(3)), mix(u + np.uint64(4))
    band = bisect.bisect_right(bounds, len(s)) - 1
    out = []
    for level in (band, band + 1):
        most = 2 * (bounds[level + 1] - 1) * (100 - percent) // (100 + percent)  # tokens that only one of two linked sets has
        m = most + 1 + (most > 2)
        group = (where % np.uint64(m)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.diff(group[order], prepend=-1))
        full, content = group[order][first], np.add.reduceat(what[order], first)
        out.append(mix(content ^ mix((full * 64 + level % 64).astype(np.uint64))))
        if len(full) <= most:  # empty sub-classes may be the only equal ones
            empty = np.setdiff1d(np.arange(m), full)
            out.append(mix(mix((empty * 64 + level % 64).astype(np.uint64)) + np.uint64(5)))
    return np.unique(np.concatenate(out)).view(np.int64)


def _sign_batches(batches, percent: int, table):
    """``table``: a broadcast sorted array of frequent tokens, or None if the rows carry theirs."""
    import pyarrow as pa

    known = None if table is None else table.value
    for b in pieces(batches):
        ids, ns, toks = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        toks = toks if not toks.offset else pa.concat_arrays([toks])
        flat, off = toks.values.to_numpy(zero_copy_only=False), toks.offsets.to_numpy()
        own = b.column(3).to_pylist() if known is None else None
        if known is not None:
            at = np.searchsorted(known, flat)
            mask = known[np.minimum(at, len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
        sig, who, size, plain = [], [], [], []
        for i, (d, n) in enumerate(zip(ids, ns, strict=True)):
            t = flat[off[i] : off[i + 1]]
            often = mask[off[i] : off[i + 1]] if own is None else np.isin(t, np.array(own[i] or [], np.int64))
            need = needed(n, percent)
            rare = t[~often][:need]
            s = rare if len(rare) == need else np.concatenate([rare, [0]])  # 0 asks for combinations
            sig.append(s)
            who.append(np.full(len(s), d, np.int64))
            size.append(np.full(len(s), n, np.int64))
            plain.append(np.full(len(s), len(rare) == need))
        if sig:
            yield pa.record_batch([np.concatenate(x) for x in (sig, who, size, plain)], names=["sig", "id", "n", "plain"])


def _combination_batches(batches, k: int, percent: int):
    import pyarrow as pa

    bounds = bands(percent)
    for b in pieces(batches):
        sets = [token_set(t, k) for t in texts_of(b.column(1))]
        found = [combinations(s, percent, bounds) for s in sets]
        ids, lengths = b.column(0).to_numpy(), [len(f) for f in found]
        yield pa.record_batch([np.concatenate(found), np.repeat(ids, lengths), np.repeat([len(s) for s in sets], lengths).astype(np.int64), np.zeros(sum(lengths), bool)], names=["sig", "id", "n", "plain"])


def _set_batches(batches, k: int):
    import pyarrow as pa

    for b in pieces(batches):
        sets = [token_set(t, k) for t in texts_of(b.column(1))]
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "s"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable from each endpoint of ``edges`` (a, b).

    Minimum-label propagation with pointer jumping; each round is written to the
    shared folder. Labels move with aggregates and joins only.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = materialize(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("c"))
        up = labels.select(F.col("id").alias("uid"), F.col("comp").alias("up"))
        jumped = step.join(up, step.c == up.uid, "left").select("id", "old", F.coalesce(F.least("c", "up"), "c").alias("comp"))
        new = materialize(jumped, "labels")
        if not new.where("comp != old").limit(1).count():
            return new.select("id", "comp")
        labels = new.select("id", "comp")


def merge_components(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp) after ``edges`` (a, b) joined components; an end that ``comps`` doesn't have is its own.

    The components are contracted first, so rounds run over links between them only.
    """
    label = lambda i: comps.select(F.col("id").alias(i), F.col("comp").alias("c" + i))
    ends = edges.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = connected_components(ends)
    up = joined.select(F.col("id").alias("uid"), F.col("comp").alias("up"))
    old = comps.join(up, F.col("comp") == F.col("uid"), "left").select("id", F.coalesce("up", "comp").alias("comp"))
    return materialize(old.union(joined.join(comps.select("id"), "id", "left_anti")), "labels")


def _mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with ``comp``; a member without links is its own."""
    rows = members.join(comps, "id", "left").select("sig", "id", "n", "plain", F.coalesce("comp", "id").alias("comp"))
    several = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    return materialize(rows.join(several, "sig"), "mixed")


def _close_sizes(a, b, percent: int):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def _verify(pairs: DataFrame, base: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold. Only their texts are made into sets again."""
    k = p.shingle
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = pairs.count() * 2 <= p.broadcast_rows
    wanted = base.join(F.broadcast(ids) if few else ids, base.doc_id == ids.id, "left_semi")
    sets = materialize(wanted.mapInArrow(lambda it: _set_batches(it, k), "id long, s array<long>"), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    good = pairs.select("a", "b").join(left, "a").join(right, "b").where(100 * both >= p.percent * (F.size("sa") + F.size("sb") - both))
    links = materialize(good.select("a", "b").distinct(), "links")
    release(sets)
    return links


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each array of ``x`` shares with each of ``y``, by products of 0/1 matrices."""
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), np.float64)

    def matrix(arrays, part):
        flat = np.concatenate(arrays)
        at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
        hit, m = part[at] == flat, np.zeros((len(arrays), len(part)), np.float32)
        m[np.repeat(np.arange(len(arrays)), [len(v) for v in arrays])[hit], at[hit]] = 1
        return m

    for i in range(0, len(both), 2048):
        part = both[i : i + 2048]
        out += matrix(x, part) @ matrix(y, part).T
    return out


def _forest(good: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Pairs (row, column) of ``good`` that join all components it joins, and no more; components are numbers from 0."""
    label = np.arange(max(left.max(initial=-1), right.max(initial=-1)) + 1)
    for x in np.flatnonzero(good.any(1)):
        columns = np.flatnonzero(good[x])
        others, first = np.unique(label[right[columns]], return_index=True)
        own = label[left[x]]
        for other, y in zip(others.tolist(), columns[first].tolist(), strict=True):
            if other != own:
                yield x, y
                label[label == other] = own


def _unlike(open_: DataFrame, base: DataFrame, p: JoinParams) -> DataFrame:
    """Links (a, b) that join different components of a group: components that share a large bucket, directly or over others.

    Of two such sets one at least is outside the group's largest component, so those
    outside it are compared with all, in blocks: work grows with their number times
    that of all, and a group in which few are outside takes a row each. A task
    holds a block of either side, counts what their whole sets share, and returns
    no more links than it takes to join the components it has seen to belong
    together, so there are at most as many as rows.
    """
    k, size, percent = p.shingle, p.block_rows, p.percent
    groups = connected_components(open_.select(F.col("head").alias("a"), F.col("comp").alias("b")).where("a <> b").distinct())
    members = open_.select("id", "n", "comp").distinct().join(groups.select(F.col("id").alias("comp"), F.col("comp").alias("grp")), "comp")
    ids = materialize(members, "groups")
    few = ids.count() <= p.broadcast_rows
    wanted = ids.select("id").distinct()
    texts = base.join(F.broadcast(wanted) if few else wanted, base.doc_id == wanted.id, "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(lambda it: _set_batches(it, k), "id long, s array<long>").withColumnRenamed("id", "sid")
    sizes = ids.groupBy("grp", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    largest = sizes.groupBy("grp").agg(F.max_by(F.struct("comp", "c", "w"), F.struct("c", (-F.col("comp")).alias("first"))).alias("main"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    parts = lambda c, w: F.greatest(F.ceil(c / size), F.ceil(w / p.block_tokens), F.lit(1))
    blocks = largest.select("grp", F.col("main.comp").alias("main"), parts(F.col("c"), F.col("w")).alias("blocks"), parts(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w")).alias("few"))
    rows = ids.join(blocks, "grp").join(sets, F.col("id") == F.col("sid"))
    number = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    cells = ["grp", "id", "n", "comp", "s"]
    asking = rows.where("comp <> main").select(*cells, F.lit(True).alias("asks"), own("few").alias("i"), F.explode(number("blocks")).alias("j"))
    asked = rows.select(*cells, F.lit(False).alias("asks"), F.explode(number("few")).alias("i"), own("blocks").alias("j"))
    meet = asking.unionByName(asked)

    def compare(table):
        import pyarrow as pa

        ids, n, comp, asks = (table[c].to_numpy() for c in ("id", "n", "comp", "asks"))
        lists = table["s"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        t = [flat[a:z] for a, z in zip(off[:-1], off[1:], strict=True)]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            both = _common([t[q] for q in left], [t[q] for q in right])
            good = both * (100 + percent) >= percent * (n[left][:, None] + n[right][None, :])
            good &= comp[left][:, None] != comp[right][None, :]
            code = np.unique(comp, return_inverse=True)[1]
            found = [tuple(sorted((int(ids[left[x]]), int(ids[right[y]])))) for x, y in _forest(good, code[left], code[right])]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return materialize(meet.groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "joined")


def jaccard_components(docs: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, copies_id).

    ``component_id`` is the smallest id reachable over links, ``copies_id`` the
    smallest id with the same set. Null, empty and blank texts have empty sets and
    stand alone. Rows that repeat an id are one document: the links of any of its
    texts count. An empty table gives an empty result. Other columns of ``docs``
    are not read. A null id is kept and stands alone.
    """
    p, k = params, params.shingle
    below = counted_below(p.percent)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    full = materialize(base.mapInArrow(lambda it: _digest_batches(it, k, below), "doc_id long, n long, d1 long, d2 long, toks array<long>"), "digests")
    rows = materialize(full.select("doc_id", "n", "d1", "d2"), "rows")
    known = rows.where("n > 0 and doc_id is not null")
    reps = known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    heads = reps.select(F.col("rep").alias("doc_id"))
    few = reps.count() <= p.broadcast_rows
    heads = F.broadcast(heads) if few else heads
    vertices = materialize(full.where("n > 0").join(heads, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", "toks"), "vertices")
    release(full)
    drop_old_shuffles(spark)

    often = vertices.select(F.explode("toks").alias("t")).where(F.col("t") < below).groupBy("t").agg(F.count("*").alias("df")).where(F.col("df") > p.frequent_above).select("t")
    often = materialize(often, "frequent")
    if often.count() <= p.broadcast_rows:
        table = spark.sparkContext.broadcast(np.sort(np.array(often.toPandas()["t"], np.int64)))
        source = vertices
    else:
        table = None
        carried = vertices.select("id", F.explode("toks").alias("t")).join(often, "t").groupBy("id").agg(F.collect_set("t").alias("own"))
        source = vertices.join(carried, "id", "left").select("id", "n", "toks", "own")
    schema = "sig long, id long, n long, plain boolean"
    drop_old_shuffles(spark)
    rare = materialize(source.mapInArrow(lambda it: _sign_batches(it, p.percent, table), schema), "signatures")
    release(vertices)
    short_of_rare = rare.where("sig = 0").select("id")
    few = short_of_rare.count() <= p.broadcast_rows
    whole = base.where("text is not null").join(F.broadcast(short_of_rare) if few else short_of_rare, base.doc_id == short_of_rare.id, "left_semi")
    combined = materialize(whole.mapInArrow(lambda it: _combination_batches(it, k, p.percent), schema).where("n > 0").distinct(), "combinations")
    sigs = rare.where("sig <> 0").union(combined)

    buckets = sigs.groupBy("sig").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("pivot")).where("c > 1")
    members = materialize(sigs.join(buckets, "sig").select("sig", "id", "n", "plain", "c", F.col("pivot.id").alias("p"), F.col("pivot.n").alias("pn")), "members")
    release(rare, combined)
    drop_old_shuffles(spark)
    large = members.where(F.col("c") > p.small_bucket)
    # Large buckets and those of combinations: members meet pivots first, so that groups of near copies become one component.
    star = members.where(~(F.col("plain") & (F.col("c") <= p.small_bucket)) & (F.col("p") < F.col("id")) & _close_sizes(F.col("n"), F.col("pn"), p.percent)).select(F.col("p").alias("a"), F.col("id").alias("b"))
    # Of a member's pivots the one it meets in most buckets and the first one.
    met = star.groupBy("b", "a").agg(F.count("*").alias("met"))
    star = met.groupBy("b").agg(F.array_distinct(F.array(F.min("a"), F.max_by("a", F.struct("met", (-F.col("a")).alias("first"))))).alias("as")).select(F.explode("as").alias("a"), "b")
    edges = _verify(materialize(star, "stars"), base, p)

    twice = known.join(reps, ["d1", "d2", "n"]).select("doc_id", F.col("rep"))
    least = twice.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    same_id = materialize(least.join(twice, "doc_id").where("rep > a").select("a", F.col("rep").alias("b")).distinct(), "same")
    comps = connected_components(edges.union(same_id))
    drop_old_shuffles(spark)

    # Small buckets with several components: all pairs of different ones, but for what a bound rules out.
    small = _mixed(members.where(F.col("c") <= p.small_bucket), comps)
    side = lambda i, z: small.select("sig", F.col("id").alias(i), F.col("n").alias("n" + z), F.col("plain").alias("p" + z), F.col("comp").alias("c" + z))
    near = side("a", "a").join(side("b", "b"), "sig").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _close_sizes(F.col("na"), F.col("nb"), p.percent))
    near = near.groupBy("a", "b", "na", "nb", "pa", "pb").agg(F.count("*").alias("common"))
    # Prefixes of rare tokens only: what they have in common and all that follows bound the overlap.
    after = [F.col(c) - (F.col(c) - F.ceil(p.percent * F.col(c) / 100) + 1) for c in ("na", "nb")]
    enough = (100 + p.percent) * (F.col("common") + F.greatest(*after)) >= p.percent * (F.col("na") + F.col("nb"))
    near = near.where(~(F.col("pa") & F.col("pb")) | enough).select("a", "b")
    comps = merge_components(comps, _verify(materialize(near, "pairs"), base, p))
    drop_old_shuffles(spark)

    # Members of large buckets that hold several components still.
    open_ = _mixed(large, comps)
    heads = open_.groupBy("sig").agg(F.min("comp").alias("head"))
    open_ = materialize(open_.join(heads, "sig").select("id", "n", "comp", "head").distinct(), "open")
    if open_.limit(1).count():
        comps = merge_components(comps, _unlike(open_, base, p))

    out = rows.join(reps, ["d1", "d2", "n"], "left").join(comps, F.col("rep") == F.col("id"), "left")
    own = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("comp")), own).alias("component_id"), own.alias("copies_id"))
