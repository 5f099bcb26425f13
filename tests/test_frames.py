"""Decoding of frames keeps few Python processes."""

from __spark_entry__ import queries

SMALL = "/root/testdata/sf0.001"


def test_frames_are_decoded_by_one_process_a_task(spark):
    df = queries()["s6_decode_frames"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert df.count() == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
