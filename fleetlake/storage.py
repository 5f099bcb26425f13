"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only sessions on one machine that set none get a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="fleetlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/fleetlake-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of 4 MB, whatever their length, unless the session names a size itself.

    Without it a batch has 10,000 rows, so that a worker's memory grows with the rows' lengths.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))


class SaveConflict(Exception):
    """Another writer saved a version since the one that was read."""


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))
    return at().getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the saved versions, ascending."""
    fs, at = _hadoop(spark, path)
    if not fs.exists(at("versions")):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at("versions")) if f.getPath().getName().isdecimal())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path.rstrip('/')}/versions/{version}", wholetext=True).first()[0])


def save_state(state: DataFrame, path: str, after: int | None = None) -> int:
    """Saves a full snapshot as a new version and returns its number.

    The rows go to a folder of their own first. Then the version's manifest, which names
    that folder, is created under the number after ``after`` (the latest, if not given);
    the file system lets one writer create it, any other gets ``SaveConflict``. A save that fails
    before leaves the versions as they were; its folder goes with ``clean_versions``.
    """
    spark = state.sparkSession
    after = max(versions(spark, path), default=0) if after is None else after
    data = f"data-{uuid.uuid4().hex}"
    state.write.parquet(f"{path.rstrip('/')}/{data}")
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at("versions"))
    manifest = at("versions", str(after + 1))
    try:
        out = fs.create(manifest, False)
    except Exception as e:
        if not fs.exists(manifest):
            raise
        raise SaveConflict(f"version {after + 1} of {path} exists") from e
    out.write(json.dumps({"data": data, "after": after}).encode())
    out.close()
    return after + 1


def load_state(spark: SparkSession, path: str, schema: str, threshold_s: int = 30, version: int | None = None) -> DataFrame:
    """The latest snapshot at ``path``, or an older ``version``; an empty table if there is none. The threshold isn't stored but set anew."""
    version = max(versions(spark, path), default=0) if version is None else version
    if version:
        state = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{_manifest(spark, path, version)['data']}")
    else:
        state = spark.createDataFrame([], schema)
    return state.withColumn("threshold_s", F.lit(threshold_s))


def clean_versions(spark: SparkSession, path: str, keep: int = 2, unused_s: int = 86_400) -> None:
    """Deletes all but the last ``keep`` versions, and folders that no version names and nobody wrote to for ``unused_s`` seconds."""
    fs, at = _hadoop(spark, path)
    known = versions(spark, path)
    for version in known[: -keep or None]:
        fs.delete(at("versions", str(version)), False)
    used = {_manifest(spark, path, version)["data"] for version in known[-keep:]} if keep else set()
    for f in fs.listStatus(at()):
        name = f.getPath().getName()
        if name.startswith("data-") and name not in used and f.getModificationTime() <= (time.time() - unused_s) * 1000:
            fs.delete(f.getPath(), True)
