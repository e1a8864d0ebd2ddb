"""The shared scratch folder, checked broadcasts and batch sizes."""

import time
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quarry import runtime


def test_materialized_tables_are_read_back_and_discarded(spark):
    made = runtime.materialize(spark.range(10).selectExpr("id", "cast(null as string) as s"), "t")
    assert made.schema.simpleString() == "struct<id:bigint,s:string>" and made.count() == 10
    folder = Path(made.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert folder.exists()
    runtime.discard(made, None)
    assert not folder.exists()
    empty = runtime.materialize(spark.range(0), "t")
    assert empty.count() == 0
    runtime.discard(empty)


def test_the_sessions_own_checkpoint_folder_is_used(spark):
    own = spark.conf.get("spark.checkpoint.dir", None)
    root = runtime.scratch_root(spark)
    assert root == own.rstrip("/") if own else root.startswith("file:/")


def test_a_cluster_needs_a_shared_folder():
    unset = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="local-cluster[3,2,1024]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.scratch_root(cluster)


def test_only_small_sides_are_broadcast(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(runtime.broadcast_if_small(spark.range(10), 10))
    assert not hinted(runtime.broadcast_if_small(spark.range(11), 10))


def test_batch_size_comes_back_after_an_error(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), runtime.arrow_batches(spark, 7):
        assert spark.conf.get(name) == "7"
        raise ValueError
    assert spark.conf.get(name) == before


def test_a_materialized_job_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {p for p in disk.getAllBlocks().mkString(" ").split() if p.startswith("shuffle_")}
    before = shuffled()
    df = runtime.materialize(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert sorted(map(tuple, df.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
