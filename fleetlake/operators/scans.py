"""Running totals, ranks and last values over sorted rows, spread over all tasks however hot a key is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.storage import written


def running(df: DataFrame, key: list[str], order: list[str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, rank: str | None = None) -> DataFrame:
    """``df`` with running values inside each ``key`` (none: over all rows) in the order of ``order``.

    ``sums`` names a column for the sum of another one up to and with the row (null counts as 0),
    ``lasts`` one for another's last value that isn't null, ``rank`` one for the row's number
    from 1. ``order`` should tell all rows apart; equal rows come in any order. Null keys are one key.

    Rows are dealt in ranges of (key, order), so a key of many rows spreads over many
    ranges. A window runs inside each range and key; the first key of a range may have
    begun in an earlier one, and what it brings along is one row a range, which is
    broadcast.
    """
    sums, lasts = sums or {}, lasts or {}
    rows = written(df.repartitionByRange(*key, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seq = [F.col(c) for c in order]
    whole = {f"__s_{n}": F.sum(c) for n, c in sums.items()} | {f"__l_{n}": F.max_by(_kept(c), F.struct(F.col(c).isNotNull(), *seq)) for n, c in lasts.items()} | {"__rows": F.count("*")}
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__part", *key).agg(*[v.alias(n) for n, v in whole.items()])
    brought = {f"__s_{n}": F.sum(f"__s_{n}") for n in sums} | {f"__l_{n}": F.last(f"__l_{n}", ignorenulls=True) for n in lasts} | {"__rows": F.sum("__rows")}
    carry = totals.select("__part", *key, *[v.over(earlier).alias(n) for n, v in brought.items()]).where("__rows is not null")
    named = carry.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], *brought)
    own = rows.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()], *[F.last(_kept(c), ignorenulls=True).over(inside).alias(n) for n, c in lasts.items()], *([F.row_number().over(inside).alias(rank)] if rank else []))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    joined = own.join(F.broadcast(named), same, "left")  # a row a range at most
    none = F.lit(0)
    out: list[Column] = [F.col(c) for c in df.columns]
    out += [(F.coalesce(n, none) + F.coalesce(f"__s_{n}", none)).alias(n) for n in sums]
    out += [F.coalesce(n, f"__l_{n}")["v"].alias(n) for n in lasts]
    if rank:
        out.append((F.col(rank) + F.coalesce("__rows", none)).cast("long").alias(rank))
    return joined.select(*out)


def _kept(c: str) -> Column:
    """A value in a struct, so that null stands for no value only."""
    return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v")))
