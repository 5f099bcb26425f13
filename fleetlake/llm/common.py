"""Helpers shared by the text operators: shared storage, words and hashes."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.storage import shared_path

#: Entries kept by a worker's word cache; beyond them hashes are computed anew.
CACHE_ENTRIES = 150_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests) is a temporary folder made
    and remembered in the session; on a cluster that is an error.
    """
    return shared_path(spark, "").rpartition("/")[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read only, and gives the
    planner the true size of what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fleetlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_old_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver (its Python, then its JVM) collects garbage, which may
    come after several steps have each left their files on the executors' disks. The
    second round takes what the first let go of.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def pieces(batches, most_bytes: int = 4 << 20):
    """Arrow batches cut into runs of rows of about ``most_bytes`` (one row at least).

    What a batch leaves unused goes back to the system, so that workers stay small.
    """
    import pyarrow as pa

    for b in batches:
        step = max(1, int(b.num_rows * most_bytes / max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
        pa.default_memory_pool().release_unused()


def quoted(name: str):
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(columns: list[str]):
    """The columns in one struct, by place, so that their names meet no others."""
    return F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)])


def unpacked(columns: list[str], struct: str, **instead) -> list:
    """The columns of ``packed`` under their names again, or what stands ``instead``."""
    return [instead.get(c, F.col(struct)[f"c{i}"]).alias(c) for i, c in enumerate(columns)]


#: Ids that stand for missing ones begin here.
NO_ID = 1 << 62


def id_or_text(id_col: str, text_col: str):
    """The id; for rows without one a number from their text's hash, so that equal texts are one document."""
    return F.coalesce(quoted(id_col).cast("long"), F.lit(NO_ID) + F.xxhash64(quoted(text_col)).bitwiseAND(NO_ID - 1))


def lower_ascii(col):
    """A-Z to a-z, all other characters as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: A-Z to a-z, ASCII other than letters and digits to spaces; bytes of other characters stay.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def alnum_runs(text: bytes, most_bytes: int = 1 << 20):
    """The words of letters, digits and characters beyond ASCII, lower-cased (A-Z), in lists of about ``most_bytes`` of text."""
    text, at = text.translate(ALNUM), 0
    while at < len(text):
        end = text.find(b" ", at + most_bytes)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def int_lists(parts: list[np.ndarray], kind=np.int32):
    """An Arrow column of integer lists."""
    import pyarrow as pa

    flat = np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(flat))


class WordHash(dict):
    """Word (bytes) to a 64-bit hash; remembers up to ``CACHE_ENTRIES`` words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_ENTRIES:
            self[word] = value
        return value


_WORDS = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that hash order is a random order."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k-word window of the word hashes ``h``, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(acc)


def texts_of(column) -> list[bytes]:
    """The texts of an Arrow column as bytes, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
