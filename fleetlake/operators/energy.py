"""Energy counters, predictions against actuals, timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counter_rate(df: DataFrame) -> DataFrame:
    """Watts from a microjoule counter: 0 on wrap or no time, null for the first sample."""
    w = Window.partitionBy("node").orderBy("ts", "seq")
    du, dt = F.col("uj") - F.lag("uj").over(w), F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    return df.select("node", "seq", F.when(du.isNotNull(), F.when(dt <= 0, 0.0).otherwise(F.greatest(du, F.lit(0)) / 1e6 / dt)).alias("watts"))


def reconcile_predictions(predicted: DataFrame, actual: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """By site: planned and drifted nodes and the sum of what counts (the prediction within tolerance, else the actual)."""
    both = predicted.join(actual, "node", "left")
    drift = F.coalesce(F.abs(F.col("actual") - F.col("predicted")) > tolerance, F.lit(False))
    rows = both.withColumn("drifted", drift).withColumn("effective", F.when(F.col("drifted"), F.col("actual")).otherwise(F.col("predicted")))
    return rows.groupBy("site").agg(F.count_if(~F.col("drifted")).alias("n_planned"), F.count_if("drifted").alias("n_drifted"), F.sum("effective").alias("effective"), F.sum(F.coalesce("actual", "predicted")).alias("actual"))


def reconcile_checks(predicted: DataFrame, actual: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """By site, as ``reconcile_predictions``, with its contract: (site, n_predicted, n_actual, n_planned, n_drifted, effective, exact, within_bound).

    Both sides are (site, node, predicted or actual), and every node must have a row
    on either, or the query fails; a null actual counts as planned. ``exact``: the sum is that of the
    effective values; ``within_bound``: it is no further from the sum of actuals
    than a tolerance for each node as planned.
    """
    rows = predicted.select("site", "node", "predicted", F.lit(1).alias("p")).join(actual.select("site", "node", "actual", F.lit(1).alias("a")), ["site", "node"], "full")
    planned = F.coalesce(F.abs(F.col("actual") - F.col("predicted")) <= tolerance, F.lit(True))
    rows = rows.withColumn("planned", planned).withColumn("value", F.when(F.col("planned"), F.col("predicted")).otherwise(F.col("actual")))
    count = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    g = rows.groupBy("site").agg(
        count("p").alias("n_predicted"), count("a").alias("n_actual"), F.count_if("planned").alias("n_planned"), F.count_if(~F.col("planned")).alias("n_drifted"),
        F.sum("value").alias("effective"), F.sum(F.when(F.col("planned"), F.col("predicted"))).alias("of_planned"), F.sum(F.when(~F.col("planned"), F.col("actual"))).alias("of_drifted"), F.sum(F.coalesce("actual", "predicted")).alias("truth"), F.count("*").alias("n"),
    )
    parts = F.coalesce("of_planned", F.lit(0.0)) + F.coalesce("of_drifted", F.lit(0.0))
    same = F.when((F.col("n_predicted") == F.col("n")) & (F.col("n_actual") == F.col("n")), F.col("n_predicted")).otherwise(F.raise_error(F.concat(F.lit("arity mismatch at site "), F.col("site").cast("string"))).cast("long"))
    bound = F.abs(F.col("effective") - F.col("truth")) <= F.col("n_planned") * tolerance + 1e-9
    return g.select("site", same.alias("n_predicted"), "n_actual", "n_planned", "n_drifted", "effective", (F.abs(F.col("effective") - parts) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(parts))).alias("exact"), bound.alias("within_bound"))


def verify_reported(reported: DataFrame, predicted: DataFrame, actual: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(site, reported, effective, n_nodes, verdict) of (site, reported) totals that somebody else added up.

    ``exact``: the total is the sum of the effective values of ``reconcile_checks``, but
    for rounding; ``summed predictions`` and ``summed actuals``: it is the sum of one
    side instead; ``off``: neither; ``unknown site`` and ``not reported``: a side is missing. A null total isn't reported, nor is that of a null site.
    """
    drift = F.abs(F.col("actual") - F.col("predicted")) > tolerance
    rows = predicted.select("site", "node", "predicted").join(actual.select("site", "node", "actual"), ["site", "node"], "left")
    value = F.when(drift, F.col("actual")).otherwise(F.col("predicted"))
    sums = rows.groupBy("site").agg(F.sum(value).alias("effective"), F.sum("predicted").alias("planned"), F.sum(F.coalesce("actual", "predicted")).alias("truth"), F.count("*").alias("n_nodes"))
    both = reported.select("site", "reported").join(sums, "site", "full")
    like = lambda c: F.abs(F.col("reported") - F.col(c)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col(c)))
    told = F.when(F.col("n_nodes").isNull(), "unknown site").when(F.col("reported").isNull(), "not reported").when(like("effective"), "exact")
    told = told.when(like("planned"), "summed predictions").when(like("truth"), "summed actuals").otherwise("off")
    return both.select("site", "reported", "effective", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), told.alias("verdict"))


def budget_verdict(draw: DataFrame, budget: float) -> DataFrame:
    return draw.withColumn("verdict", F.when(F.col("effective") <= budget, "WITHIN").otherwise("BREACH"))


def hop_timings(spans: DataFrame) -> DataFrame:
    """Mean milliseconds and rows a second by kind of hop."""
    return spans.groupBy("kind").agg(F.avg("ms").alias("mean_ms"), F.count("*").alias("n"), (F.count("*") / F.greatest(F.sum("ms") / 1000, F.lit(1e-6))).alias("per_s"))


def transfer_bill(plan: DataFrame) -> DataFrame:
    return plan.groupBy("id").agg(F.sum("length").alias("bytes"), F.count("*").alias("ranges"))


def reconciliation_bill(draw: DataFrame) -> DataFrame:
    """Bytes that reconciling costs: a bit for each node as planned, eight bytes for each that drifted."""
    return draw.withColumn("bill", F.floor(F.col("n_planned") / 8) + 8 * F.col("n_drifted"))


def draw_balance(moves: DataFrame, budget: int) -> DataFrame:
    """Adds ``draw`` after each commit (+) or release (-) of ``watts``, never below 0, and ``headroom``.

    A sum that stops at 0 is the running sum less its lowest value below 0, so
    two windows over one sort do.
    """
    w = Window.partitionBy("node").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = moves.withColumn("total", F.sum("watts").over(w))
    level = total.withColumn("draw", F.col("total") - F.least(F.lit(0), F.min("total").over(w)))
    return level.drop("total").withColumn("headroom", F.greatest(F.lit(0), budget - F.col("draw")))


def set_hash(options):
    """Content hash of an ordered candidate set."""
    return F.sha2(F.to_json(F.struct(options.alias("o"))), 256)


def resolve_picks(picks: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, status, value): the option an index points to if both sides know the same set, else the full payload."""
    known = sets.select("set_id", "options", set_hash(F.col("options")).alias("have"))
    both = picks.join(known, "set_id", "left")
    same = F.coalesce(F.col("have") == F.col("set_hash"), F.lit(False))
    inside = F.col("pick").between(0, F.size("options") - 1)
    status = F.when(~same, "full payload").when(inside, "pick").otherwise("out of range")
    return both.select("id", status.alias("status"), F.when(~same, F.col("payload")).when(inside, F.get("options", F.col("pick").cast("int"))).alias("value"))
