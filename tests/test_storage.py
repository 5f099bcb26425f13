"""Versions of a saved state: failed saves, two writers, older versions, what is cleaned."""

import os

import pytest
from pyspark.sql import functions as F

from fleetlake import storage

KIND = "node long, draw int"


@pytest.fixture
def state(spark):
    return spark.createDataFrame([(1, 10), (2, 20)], KIND)


def loaded(spark, path, **kw):
    return sorted((r.node, r.draw) for r in storage.load_state(spark, path, KIND, **kw).collect())


def test_no_version_is_an_empty_table(spark, tmp_path):
    assert loaded(spark, str(tmp_path / "none")) == [] and storage.versions(spark, str(tmp_path / "none")) == []


def test_each_save_is_a_version_and_older_ones_stay_readable(spark, state, tmp_path):
    path = str(tmp_path / "s")
    assert storage.save_state(state, path) == 1
    assert storage.save_state(storage.load_state(spark, path, KIND).select("node", (F.col("draw") + 1).alias("draw")), path) == 2  # from the state it replaces
    assert loaded(spark, path) == [(1, 11), (2, 21)] and loaded(spark, path, version=1) == [(1, 10), (2, 20)]
    assert storage.load_state(spark, path, KIND, threshold_s=5).first().threshold_s == 5


def test_a_save_that_fails_leaves_the_last_state(spark, state, tmp_path):
    path = str(tmp_path / "s")
    storage.save_state(state, path)
    with pytest.raises(Exception, match="lost"):
        storage.save_state(state.withColumn("draw", F.when(F.col("node") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(1)), path)
    assert loaded(spark, path) == [(1, 10), (2, 20)] and storage.versions(spark, path) == [1]


def test_two_writers_cannot_both_win(spark, state, tmp_path):
    path = str(tmp_path / "s")
    read = storage.save_state(state, path)
    assert storage.save_state(state.where("node = 1"), path, after=read) == 2
    with pytest.raises(storage.SaveConflict):
        storage.save_state(state.where("node = 2"), path, after=read)
    assert loaded(spark, path) == [(1, 10)]


def test_old_versions_and_unused_folders_are_cleaned(spark, state, tmp_path):
    path = str(tmp_path / "s")
    for n in range(4):
        storage.save_state(state.withColumn("draw", F.lit(n)), path)
    with pytest.raises(storage.SaveConflict):
        storage.save_state(state, path, after=1)  # its folder is named by none
    storage.clean_versions(spark, path, keep=2)
    assert storage.versions(spark, path) == [3, 4] and len([f for f in os.listdir(path) if f.startswith("data-")]) == 5  # too young
    storage.clean_versions(spark, path, keep=2, unused_s=0)
    assert len([f for f in os.listdir(path) if f.startswith("data-")]) == 2
    assert loaded(spark, path, version=3) == [(1, 2), (2, 2)] and loaded(spark, path) == [(1, 3), (2, 3)]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    kept = {}
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: kept.get(k, d), set=kept.__setitem__), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            storage.shared_path(session(master), "x")
    assert storage.shared_path(session("local[4]"), "x").startswith(kept["spark.checkpoint.dir"])
