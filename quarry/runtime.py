"""Session defaults, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its row count was checked against this bound.
BROADCAST_ROWS = 200_000

_own_scratch: list[str] = []


def session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query here assumes: UTC, ANSI, AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run in one process.

    Raises ``ValueError`` on a cluster without that setting, as executors would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share, as the master is {master}")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="quarry-"))
        atexit.register(shutil.rmtree, _own_scratch[0], ignore_errors=True)
    return f"file://{_own_scratch[0]}"


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the files of an existing path deleted when the driver's JVM ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage without depending on any executor staying alive, gives the planner true sizes and makes
    non-deterministic columns (row ids, partition ids) final. The files go when the driver's JVM ends; those of the job's own
    shuffles go with the job, as nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quarry-{label}-{uuid.uuid4().hex}"
    with conf_set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that no later query reads."""
    for table in tables:
        if table is None:
            continue
        spark = table.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def conf_set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within this context, a setting of the session has another value; its own comes back afterwards."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_batches(spark: SparkSession, rows: int):
    """Within this context, jobs pass at most ``rows`` rows to Python at once."""
    return conf_set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if a bounded count shows at most ``rows`` rows; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
