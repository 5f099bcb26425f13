"""Streams: the steps of ``operators.folds`` with Spark's state by key, and the current state of a fleet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupStateTimeout

from fleetlake.storage import shared_path


def stream_fold(stream: DataFrame, key: str, order: list[str], step) -> DataFrame:
    """The step over each key's rows as they come.

    Rows of one key in one trigger are put in order first, so a trigger should be
    bounded (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``). Rows that come in a
    later trigger count as later, as steps go by arrival.
    """
    kind = stream.schema[key].dataType.simpleString()

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        new, out = step.advance(state.get if state.exists else step.start(), rows)
        state.update(new)
        out.insert(0, key, k[0])
        yield out

    grouped = stream.where(f"{key} is not null").groupBy(key)
    return grouped.applyInPandasWithState(run, f"{key} {kind}, {step.out}", step.state, "append", GroupStateTimeout.NoTimeout)


def open_table(spark: SparkSession, path: str, files_a_trigger: int = 16) -> DataFrame:
    """The files of a table as a stream, so many a trigger; the path is given as a pattern, as Spark takes a plain one for a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything the source has now, as a table in the shared folder.

    ``append`` adds each trigger's rows through the file sink, which commits them
    once; ``complete`` replaces the table by the current result.
    """
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)
    out = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-progress").outputMode(mode)
    if mode == "append":
        out = out.format("parquet").option("path", path)
    else:
        out = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    query = out.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
