"""URL rules by expression hashes, in DataFrame operations only.

A rule is a host and the beginning of a path. Every URL is expanded into the
expressions that could be rules: each suffix of its host, on label borders,
followed by each beginning of its path as long as that of a rule for this suffix. The
expressions meet the rules in an equi-join on a short prefix of their SHA-256;
the whole digest confirms a hit and the longest confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import lower_ascii

#: Hex digits of the digest that the join compares first.
PREFIX_DIGITS = 8


def url_parts(url):
    """(host, path) columns of a URL column; both empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(expression):
    return F.sha2(expression, 256)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``.

    ``rules`` has host, path, verdict. A rule fits its host and subdomains where
    the path starts with the rule's. The longest rule (host and path together)
    wins, of equally long ones the one that blocks, then the larger text. Rules
    without a host fit nothing. URLs are judged once each, however often they
    repeat. Null, empty and malformed URLs have empty parts and get ``default``,
    and so does everything if there are no rules. Other columns aren't read.
    """
    rules = rules.select(lower_ascii(F.col("host")).alias("rhost"), F.coalesce("path", F.lit("")).alias("rpath"), F.col("verdict").alias("rverdict"))
    rules = rules.where("rhost <> '' and rverdict is not null")
    expression = F.concat_ws("\u0000", "rhost", "rpath")
    rules = rules.withColumns({"digest": _digest(expression), "rule": F.concat("rhost", "rpath")}).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    lengths = rules.groupBy("rhost").agg(F.array_sort(F.collect_set(F.length("rpath"))).alias("lengths"))

    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = rows.select("host", "path").where("host <> ''").distinct()
    # No suffix has more labels than the longest host of a rule, so a long host has no more suffixes than a short one.
    most = rules.agg(F.max(F.size(F.split("rhost", r"\.")))).first()[0] or 1
    last = urls.select("host", "path", F.split("host", r"\.").alias("l")).select("host", "path", F.slice("l", F.greatest(F.size("l") - most, F.lit(0)) + 1, F.lit(most)).alias("l"))
    suffixes = last.select("host", "path", "l", F.posexplode("l").alias("i", "_label")).select("host", "path", F.array_join(F.slice("l", F.col("i") + 1, F.lit(most)), ".").alias("suffix"))
    # A suffix is only spelled with beginnings as long as some rule of that host.
    known = suffixes.join(lengths, F.col("suffix") == F.col("rhost")).select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    spelled = known.withColumn("d", _digest(F.concat_ws("\u0000", "suffix", F.substring("path", F.lit(1), F.col("n"))))).withColumn("short", F.substring("d", 1, PREFIX_DIGITS))
    hits = spelled.join(rules, "short").where(F.col("d") == F.col("digest"))
    order = F.struct(F.length("rule"), (F.col("rverdict") == "block").cast("int"), F.col("rule"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rverdict"), order).alias("best"))
    # Rows without a host would all meet in one task of the join and can't be hit.
    none = rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    out = rows.where("host <> ''").join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rverdict", F.lit(default)).alias("verdict")).unionByName(none)
