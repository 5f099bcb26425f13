"""Queries of content identity, vectors, tokens and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlake import views as v
from fleetlake.functions import tokens
from fleetlake.operators import delta, vectors
from fleetlake.plans.registry import query
from fleetlake.sources import logs

SIZE = 256


def _remote(spark, d):
    return v.table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("data"))


def _local(spark, d):
    r, n, k = _remote(spark, d), F.octet_length("data"), F.col("id") % 3
    changed = F.concat(F.substring("data", 1, 299), F.lit(bytearray(b"#")), F.expr("substring(data, 301)"))
    half = F.expr("substring(data, 1, octet_length(data) div 2)")
    return r.withColumn("data", F.when(k == 0, F.col("data")).when(k == 1, half).when(n > 300, changed).otherwise(F.col("data")))


# Bytes as hexadecimal text: two characters a byte.
_BYTES = "b AS (SELECT doc_id AS id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL)"
_BOTH = _BYTES + """, l AS (SELECT id, h AS r, CASE WHEN id % 3 = 0 THEN h WHEN id % 3 = 1 THEN substr(h, 1, len(h) // 4 * 2) WHEN len(h) > 600 THEN substr(h, 1, 598) || '23' || substr(h, 601) ELSE h END AS l FROM b)"""


@query("d1_epoch", "SELECT doc_id AS id, sha256(text) AS epoch FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return delta.epoch(_remote(spark, d)).select("id", "epoch")


@query("d2_chunk_index", f"WITH {_BYTES}, i AS (SELECT id, h, unnest(range(0, (len(h) // 2 + 255) // 256)) AS idx FROM b), c AS (SELECT id, idx, substr(h, idx * 512 + 1, 512) AS c FROM i) SELECT id, idx, len(c) // 2 AS length, sha256(unhex(c)) AS hash FROM c")
def _(spark, d):
    return delta.chunk_index(_remote(spark, d), SIZE).drop("chunk")


@query("d3_verify_epoch", "SELECT doc_id AS id, doc_id % 4 <> 0 AS verified FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    k = F.col("id") % 4
    return delta.verify_epoch(_remote(spark, d).withColumn("declared", F.when(k == 0, "00").when(k == 1, "").otherwise(F.sha2("data", 256))))


@query("d4_plan_pull", f"""WITH {_BOTH}, n AS (SELECT id, len(l) // 2 AS a, len(r) // 2 + CASE WHEN id % 17 = 0 THEN -1000000 ELSE 0 END AS z FROM l),
i AS (SELECT id, a, z, unnest(CASE WHEN z < a THEN [-1] WHEN a = z THEN [] ELSE range(a // 256, (z - 1) // 256 + 1) END) AS idx FROM n)
SELECT id, idx, CASE WHEN idx >= 0 THEN greatest(a, idx * 256) END AS start, CASE WHEN idx >= 0 THEN least(z, idx * 256 + 256) - greatest(a, idx * 256) END AS length, CASE WHEN idx >= 0 THEN 'ok' ELSE 'remote shorter' END AS status FROM i""")
def _(spark, d):
    n = _local(spark, d).select("id", F.octet_length("data").cast("long").alias("local_len"))
    m = _remote(spark, d).select("id", (F.octet_length("data") - F.when(F.col("id") % 17 == 0, 1000000).otherwise(0)).cast("long").alias("remote_len"))
    return delta.plan_pull(n.join(m, "id"), SIZE)


@query("d5_plan_diff", f"WITH {_BOTH}, i AS (SELECT *, unnest(range(0, (len(r) // 2 + 255) // 256)) AS idx FROM l WHERE len(l) = len(r)) SELECT id, idx, len(substr(r, idx * 512 + 1, 512)) // 2 AS length FROM i WHERE substr(r, idx * 512 + 1, 512) <> substr(l, idx * 512 + 1, 512)")
def _(spark, d):
    return delta.plan_diff(_local(spark, d), _remote(spark, d), SIZE)


_STAGED = v.sql("staged") + """, l AS (SELECT *, row_number() OVER (PARTITION BY shard, start ORDER BY staged_at DESC, seq DESC, bytes DESC, epoch DESC) AS k FROM staged),
f AS (SELECT *, sum(bytes) OVER (PARTITION BY shard ORDER BY staged_at DESC, seq DESC, start ROWS UNBOUNDED PRECEDING) AS held FROM l WHERE k = 1 AND staged_at > TIMESTAMP '1997-01-01'), kept AS (SELECT shard, start, epoch, bytes FROM f WHERE held <= 120)"""


def _kept(spark, d):
    return delta.stage_retention(v.staged(spark, d), 120, 365, "1998-01-01 00:00:00")


@query("d7_stage_retention", _STAGED + " SELECT * FROM kept")
def _(spark, d):
    return _kept(spark, d)


@query("d8_claim", _STAGED + " SELECT * FROM kept WHERE epoch = 'N' AND start % 2 = 1")
def _(spark, d):
    plan = v.staged(spark, d).where("epoch = 'N' and start % 2 = 1").select("shard", "start", "epoch").distinct()
    return delta.claim(_kept(spark, d), plan)


@query("d9_stale_adverts", "SELECT s_suppkey AS shard, 'e' || s_nationkey AS epoch, NOT (s_suppkey % 3 = 0 AND s_nationkey % 2 = 0) AS need_pull FROM supplier")
def _(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("shard"), "s_nationkey", F.concat(F.lit("e"), F.col("s_nationkey").cast("string")).alias("epoch"))
    return delta.stale_adverts(s.select("shard", "epoch"), s.where("shard % 3 = 0").select("shard", F.when(F.col("s_nationkey") % 2 == 0, F.col("epoch")).otherwise("old").alias("epoch")))


@query("d10_check_artifacts", "SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'kind' WHEN p_size > 40 THEN 'protocol' WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 11 = 0 THEN 'size' WHEN p_partkey % 13 = 0 THEN 'sha256' ELSE 'ok' END AS reason FROM part")
def _(spark, d):
    p, k = v.table(spark, d, "part"), F.col("p_partkey")
    name, sha = F.concat("p_name", k.cast("string")), F.sha2("p_name", 256)
    manifests = p.select(name.alias("name"), F.when(k % 5 == 0, "os").otherwise("agent").alias("kind"), F.col("p_size").alias("min_protocol"), k.alias("size"), sha.alias("sha"))
    real = p.where(k % 7 != 0).select(name.alias("name"), F.when(k % 11 == 0, k + 1).otherwise(k).alias("real_size"), F.when(k % 13 == 0, "x").otherwise(sha).alias("real_sha"))
    return delta.check_artifacts(manifests, real, "agent", 40)


@query("d11_neighbors", "SELECT s_nationkey AS plan, s_suppkey AS pos, list_filter([lag(s_name) OVER w, lead(s_name) OVER w], lambda x: x IS NOT NULL) AS prefetch FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)")
def _(spark, d):
    return delta.neighbors(v.table(spark, d, "supplier").select(F.col("s_nationkey").alias("plan"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("stage")))


_E = v.sql("vectors") + ", e AS (SELECT id, seq, unnest(x) AS v, unnest(range(0, len(x))) AS d FROM vectors)"


def _cells(df, value="x"):
    return df.select("id", F.posexplode(value).alias("d", "v")).select("id", "d", (F.round("v", 6) + 0.0).alias("v"))


@query("v1_normalize", _E + " SELECT id, d, round(v / sqrt(avg(v * v) OVER (PARTITION BY id) + 1e-6), 6) + 0.0 AS v FROM e")
def _(spark, d):
    return _cells(vectors.normalize(v.vectors(spark, d).select("id", "x")))


@query("v2_softmax", _E + " SELECT id, seq, round(exp(v) / sum(exp(v)) OVER (PARTITION BY seq), 6) AS p FROM e WHERE d = 0")
def _(spark, d):
    x = v.vectors(spark, d).select("id", "seq", F.get("x", F.lit(0)).alias("v"))
    return vectors.softmax(x, "seq", "v").select("id", "seq", F.round("p", 6).alias("p"))


_SCORES = _E + ", s AS (SELECT a.id AS q, b.id, sum(a.v * b.v) AS y FROM e a JOIN e b USING (d) WHERE a.id % 100 = 0 GROUP BY ALL)"


@query("v4_score", _SCORES + " SELECT q, id, round(y, 6) AS y FROM s")
def _(spark, d):
    x = v.vectors(spark, d)
    return vectors.score(x.where("id % 100 = 0"), x).withColumn("y", F.round("y", 6))


@query("v5_best_item", _SCORES + " SELECT q, id, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY y DESC, id) AS k FROM s WHERE q <> id) WHERE k = 1")
def _(spark, d):
    x = v.vectors(spark, d)
    return vectors.best_items(x.where("id % 100 = 0"), x, 1, others=True).select("q", "id", F.round("y", 6).alias("y"))


@query("v5_top_items", _SCORES + " SELECT * FROM (SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY y DESC, id) AS INTEGER) AS rank, id, round(y, 6) AS y FROM s WHERE q <> id) WHERE rank <= 7")
def _(spark, d):
    x = v.vectors(spark, d)
    return vectors.best_items(x.where("id % 100 = 0"), x, 7, others=True).withColumn("y", F.round("y", 6))


@query("v2_softmax_arrays", _E + " SELECT id, d, round(exp(v) / sum(exp(v)) OVER (PARTITION BY id), 6) AS v FROM e")
def _(spark, d):
    return _cells(vectors.softmax_arrays(v.vectors(spark, d)).select("id", F.col("p").alias("x")))


@query("v16_exact_stream", """SELECT vec_id AS id, vec_id % 4 <> 0 AS hit, CAST(list_sum(list_transform(embedding, lambda c, i:
  i * CAST(floor((CAST(c AS DOUBLE) + CASE WHEN vec_id % 4 = 0 AND i = 6 THEN 1.0::DOUBLE ELSE 0 END) * 10000) AS BIGINT))) AS BIGINT) AS check_sum FROM embeddings""")
def _(spark, d):
    """The stream of announced vectors, a quarter of which differ from the local ones."""
    mine = v.vectors(spark, d).select("id", "x")
    theirs = mine.select("id", F.transform("x", lambda c, i: c + F.when((F.col("id") % 4 == 0) & (i == 5), 1.0).otherwise(0.0)).alias("x"))
    verdicts = vectors.match_stream(theirs.select("id", vectors.fingerprint(F.col("x")).alias("fingerprint")), mine)
    total = F.aggregate(F.transform("x", lambda c, i: F.floor(c * 10000) * (i + 1)), F.lit(0).cast("long"), lambda t, c: t + c)
    return vectors.exact_stream(verdicts, mine, theirs).select("id", "hit", total.alias("check_sum"))


@query("v16_match_totals", "SELECT count(*) FILTER (vec_id % 4 <> 0) AS hits, count(*) FILTER (vec_id % 4 = 0) AS misses, CAST(sum(CASE WHEN vec_id % 4 <> 0 THEN 4 * len(embedding) ELSE 0 END) AS BIGINT) AS saved FROM embeddings")
def _(spark, d):
    mine = v.vectors(spark, d)
    theirs = mine.select("id", F.transform("x", lambda c, i: c + F.when((F.col("id") % 4 == 0) & (i == 5), 1.0).otherwise(0.0)).alias("x"))
    return vectors.match_totals(vectors.match_stream(theirs.select("id", vectors.fingerprint(F.col("x")).alias("fingerprint")), mine))


@query("v6_lookup_rows", "SELECT l_partkey AS id, l_orderkey, l_linenumber, CASE WHEN vec_id IS NULL THEN 'out of vocabulary' ELSE 'ok' END AS status, round(CAST(embedding[1] AS DOUBLE), 6) AS x0 FROM lineitem LEFT JOIN embeddings ON vec_id = l_partkey")
def _(spark, d):
    ids = v.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber")
    got = ids.select("id").distinct()
    found = vectors.lookup_rows(got, v.vectors(spark, d)).select("id", "status", F.round(F.get("x", F.lit(0)), 6).alias("x0"))
    return ids.join(found, "id")


@query("v8_causal_conv", _E + ", c AS (SELECT seq, id AS pos, v FROM e WHERE d = 1) SELECT seq, pos, round(0.1 * coalesce(lag(v, 3) OVER w, 0) + 0.2 * coalesce(lag(v, 2) OVER w, 0) + 0.3 * coalesce(lag(v, 1) OVER w, 0) + 0.4 * v, 6) AS y FROM c WINDOW w AS (PARTITION BY seq ORDER BY pos)")
def _(spark, d):
    x = v.vectors(spark, d).select("seq", F.col("id").alias("pos"), F.get("x", F.lit(1)).alias("v"))
    return vectors.causal_conv(x, [0.1, 0.2, 0.3, 0.4]).withColumn("y", F.round("y", 6))


@query("v10_hadamard", _E + " SELECT a.id, a.d, round(sum(CASE WHEN bit_count((a.d % 16) & (b.d % 16)) % 2 = 0 THEN b.v ELSE -b.v END) / 4, 6) + 0.0 AS v FROM e a JOIN e b ON a.id = b.id AND a.d // 16 = b.d // 16 GROUP BY a.id, a.d")
def _(spark, d):
    return _cells(vectors.hadamard(v.vectors(spark, d).select("id", "x"), 16))


@query("v14_parity_report", _E + """, p AS (SELECT id, sum(v * w) / greatest(sqrt(sum(v * v)) * sqrt(sum(w * w)), 1e-30) AS c, max(abs(v - w)) AS m FROM (SELECT id, v, CASE WHEN id % 2 = 0 AND d = 3 THEN v + 0.5 ELSE v END AS w FROM e) GROUP BY id)
SELECT id, round(c, 6) AS cosine, round(m, 6) AS max_abs, m = 0 AS equal, CASE WHEN round(c, 6) >= 0.999 THEN 'pass' ELSE 'fail' END AS verdict FROM p""")
def _(spark, d):
    x = v.vectors(spark, d).select("id", "x")
    y = x.withColumn("x", F.transform("x", lambda a, i: a + F.when((F.col("id") % 2 == 0) & (i == 3), 0.5).otherwise(0.0)))
    return vectors.parity_report(x, y).withColumn("cosine", F.round("cosine", 6)).withColumn("max_abs", F.round("max_abs", 6))


@query("v7_causal_attention", _E + """, r AS (SELECT id, row_number() OVER (PARTITION BY seq ORDER BY id) AS pos FROM vectors), c AS (SELECT seq, pos, d, v FROM e JOIN r USING (id)),
w AS (SELECT a.seq, a.pos, b.pos AS kp, exp(sum(a.v * b.v) / 8) AS w FROM c a JOIN c b ON a.seq = b.seq AND a.d = b.d AND b.pos BETWEEN a.pos - 3 AND a.pos GROUP BY ALL)
SELECT w.seq, w.pos, c.d, round(sum(w * v) / sum(w), 5) AS y FROM w JOIN c ON c.seq = w.seq AND c.pos = w.kp WHERE c.d < 4 GROUP BY ALL""")
def _(spark, d):
    from pyspark.sql import Window

    x = v.vectors(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("seq").orderBy("id")))
    return vectors.causal_attention(x.select("seq", "pos", "x"), 3).where("d < 4").withColumn("y", F.round("y", 5))


@query("v7_full_attention", _E + """, c AS (SELECT seq, id AS pos, d, v FROM e), w AS (SELECT a.seq, a.pos, b.pos AS kp, exp(sum(a.v * b.v) / 8) AS w FROM c a JOIN c b ON a.seq = b.seq AND a.d = b.d AND b.pos <= a.pos GROUP BY ALL)
SELECT w.seq, w.pos, c.d, round(sum(w * v) / sum(w), 5) + 0.0 AS y FROM w JOIN c ON c.seq = w.seq AND c.pos = w.kp GROUP BY ALL""")
def _(spark, d):
    x = v.vectors(spark, d).select("seq", F.col("id").alias("pos"), "x")
    return vectors.causal_attention(x).withColumn("y", F.round("y", 5) + 0.0)


@query("v8_full_conv", _E + " SELECT seq * 64 + d AS seq, id AS pos, round(0.1 * coalesce(lag(v, 3) OVER w, 0) + 0.2 * coalesce(lag(v, 2) OVER w, 0) + 0.3 * coalesce(lag(v, 1) OVER w, 0) + 0.4 * v, 6) + 0.0 AS y FROM e WINDOW w AS (PARTITION BY seq, d ORDER BY id)")
def _(spark, d):
    x = v.vectors(spark, d).select("seq", F.col("id").alias("pos"), F.posexplode("x").alias("d", "v"))
    return vectors.causal_conv(x.select((F.col("seq") * 64 + F.col("d")).alias("seq"), "pos", "v"), [0.1, 0.2, 0.3, 0.4]).withColumn("y", F.round("y", 6) + 0.0)


_W = v.sql("words") + ", o AS (SELECT conv_id AS seq, turn * 100000 + i AS pos, token FROM words)"


def _words(spark, d):
    return v.words(spark, d).select(F.col("conv_id").alias("seq"), (F.col("turn") * 100000 + F.col("i")).alias("pos"), "token")


_CONT = _W + """, t AS (SELECT seq, pos, token AS a, lead(token, 1) OVER w AS b, lead(token, 2) OVER w AS c, lead(token, 3) OVER w AS d FROM o WINDOW w AS (PARTITION BY seq ORDER BY pos)),
f AS (SELECT a, b, c, d, min((seq, pos)) AS seen FROM t WHERE d IS NOT NULL GROUP BY ALL), n AS (SELECT a, b, c, list(d ORDER BY seen) AS next FROM f GROUP BY ALL)"""


@query("t5_ngram_continuations", _CONT + " SELECT a, b, c, array_to_string(next, ' ') AS next FROM n")
def _(spark, d):
    return tokens.ngram_continuations(_words(spark, d)).withColumn("next", F.array_join("next", " "))


@query("t6_draft", _CONT + """, h AS (SELECT seq, list(token ORDER BY pos)[1:3] AS h FROM o GROUP BY seq),
s1 AS (SELECT seq, h, next[1] AS x FROM h LEFT JOIN n ON len(h) = 3 AND a = h[1] AND b = h[2] AND c = h[3]),
s2 AS (SELECT s1.*, next[1] AS y FROM s1 LEFT JOIN n ON a = h[2] AND b = h[3] AND c = x) SELECT seq AS id, concat_ws(' ', x, y) AS tokens FROM s2""")
def _(spark, d):
    w = _words(spark, d)
    start = w.groupBy(F.col("seq").alias("id")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), 1, 3).alias("tokens"))
    return tokens.draft(start, tokens.ngram_continuations(w), 2).withColumn("tokens", F.array_join("tokens", " "))


@query("t6_full_draft", _CONT + """, h AS (SELECT seq, list(token ORDER BY pos) AS a FROM o GROUP BY seq), g AS (SELECT seq, len(a) AS n, a[len(a) - 2:len(a)] AS h FROM h),
s1 AS (SELECT seq, h, next[1] AS x FROM g LEFT JOIN n ON g.n >= 3 AND a = h[1] AND b = h[2] AND c = h[3]),
s2 AS (SELECT s1.*, next[1] AS y FROM s1 LEFT JOIN n ON a = h[2] AND b = h[3] AND c = x) SELECT seq AS id, concat_ws(' ', x, y) AS tokens FROM s2""")
def _(spark, d):
    w = _words(spark, d)
    whole = w.groupBy(F.col("seq").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    return tokens.draft(whole, tokens.ngram_continuations(w), 2).withColumn("tokens", F.array_join("tokens", " "))


@query("t7_acceptance", """WITH t AS (SELECT conv_id * 1000 + turn AS id, string_split(text, ' ') AS a FROM conversations), u AS (SELECT id, a, list_transform(a[1:5], lambda x, i: CASE WHEN i = id % 7 THEN '~' ELSE x END) AS d FROM t)
SELECT id, CASE WHEN id % 7 BETWEEN 1 AND len(d) THEN id % 7 - 1 ELSE len(d) END AS accepted, len(d) - CASE WHEN id % 7 BETWEEN 1 AND len(d) THEN id % 7 - 1 ELSE len(d) END AS missed FROM u""")
def _(spark, d):
    t = v.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.split("text", " ").alias("actual"))
    return tokens.acceptance(t.withColumn("drafted", F.transform(F.slice("actual", 1, 5), lambda x, i: F.when(i + 1 == F.col("id") % 7, "~").otherwise(x))))


@query("t1_pretokenize")
def _(spark, d):
    return tokens.pretokenize(v.table(spark, d, "documents").select("doc_id", "text"))


@query("s1_read_telemetry", v.sql("telemetry") + """ SELECT seq, CASE WHEN seq % 101 = 0 THEN NULL ELSE 'h' || node END AS hostname, CASE WHEN seq % 101 = 0 THEN NULL ELSE power_watts END AS power_watts,
  CASE WHEN seq % 101 = 0 THEN NULL WHEN seq % 7 = 0 THEN 0 ELSE round(load_avg, 6) END AS load_avg, CASE WHEN seq % 101 = 0 THEN 'bad-json' ELSE 'ok' END AS reason FROM telemetry""")
def _(spark, d):
    t = v.telemetry(spark, d)
    body = F.to_json(F.struct(F.concat(F.lit("h"), F.col("node").cast("string")).alias("hostname"), "power_watts", F.when(F.col("seq") % 7 != 0, F.round("load_avg", 6)).alias("load_avg"), "agent_version"))
    good, bad = logs.read_telemetry(t.select("seq", F.when(F.col("seq") % 101 == 0, F.substring(body, 1, 20)).otherwise(body).alias("line")))
    return good.select("seq", "hostname", "power_watts", "load_avg", F.lit("ok").alias("reason")).unionByName(bad, allowMissingColumns=True)


@query("s2_verify_signed_log", "SELECT event_id AS seq, event_type || ' ' || props AS body, event_id % 10 <> 0 AS valid FROM events")
def _(spark, d):
    key = b"0123456789abcdef0123456789abcdef"
    e = v.table(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", "props").alias("body"))
    tag = logs.sign(F.col("event_id"), F.col("body"), key)
    wrong = F.concat(F.when(F.substring(tag, 1, 1) == "0", "1").otherwise("0"), F.substring(tag, 2, 63))
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.when(F.col("event_id") % 10 == 0, wrong).otherwise(tag), "body")
    return logs.verify_signed_log(e.select(line.alias("line")), key).select(F.col("line_seq").alias("seq"), "body", "valid")


@query("s3_audit_sequence", """WITH f AS (SELECT user_id AS stream, event_id, row_number() OVER w AS k, max(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS off FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT stream, min(k) FILTER (off = 1) AS first_bad, count(*) AS n FROM f GROUP BY stream) SELECT stream, first_bad, coalesce(first_bad - 1, n) AS high_water FROM b""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = v.table(spark, d, "events")
    return logs.audit_sequence(e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), (F.row_number().over(w) + F.max((F.col("event_id") % 97 == 0).cast("int")).over(w)).alias("seq")))


@query("s9_match_devices", "WITH b AS (SELECT n_name AS other, n_nationkey AS ord FROM nation), a AS (SELECT DISTINCT n_name || '-' || r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name FROM region) SELECT name, (SELECT arg_min(other, ord) FROM b WHERE contains(name, other) OR contains(other, name)) AS device FROM a")
def _(spark, d):
    n, r = v.table(spark, d, "nation"), v.table(spark, d, "region")
    a = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("-", "n_name", "r_name").alias("name")).union(r.select("r_name")).distinct()
    return logs.match_devices(a, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord")))
