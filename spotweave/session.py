"""Session helpers: shared scratch space, durable lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows a side may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000
#: Rows that one task of a narrow table takes, and the tasks that a table is left with however few rows it has.
TASK_ROWS, LEAST_TASKS = 100_000, 8


def local_session(app: str = "spotweave", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _require_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        configured = tempfile.mkdtemp(prefix="spotweave-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so that a lost executor cannot change what was read."""
    _require_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder for a table that is written and read back."""
    return f"{_require_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the *counted* rows stay under the limit; else leave it to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grew by an ``explode``, or that grows with the input: joined by shuffle.

    Spark estimates an exploded table at the size of what it was made from, so it would broadcast it however large it is. Others it
    broadcasts from the driver up to its threshold, join by join and round by round.
    """
    return df.hint("merge")


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """A table of (about) the *counted* narrow rows in as many tasks as they need.

    Each map task of a shuffle leaves files whatever its rows, so a small table in many partitions takes more disk by its tasks than by its rows.
    """
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def one_row(df: DataFrame) -> dict:
    """The single row of a global aggregate as Python scalars (they become literals in later plans)."""
    return df.first().asDict()


def release(spark: SparkSession, path: str) -> None:
    """Delete a folder that the caller has written and no longer needs, on whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
