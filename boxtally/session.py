"""Session construction and lineage control."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("boxtally")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; we choose one ourselves only in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="boxtally-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    """An unused path below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/boxtally-{uuid.uuid4().hex}"


#: Paths of the tables that the work under ``settled`` has written so far; None outside of it.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and go on from the written copy.

    Iterative operators call this once per round, so a lost executor costs a re-read of the last
    round rather than a replay of the loop. Unlike a checkpoint this computes ``df`` once, and the
    copy is columnar, so what follows still prunes columns and knows its size.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``cut_lineage`` of what ``make`` returns; the tables it wrote on the way are then deleted.

    So a long job holds the tables of one step and not of all. Nothing else that ``make`` built may be read afterwards.
    """
    outer, own = _WRITTEN.get(), []
    token = _WRITTEN.set(own)
    try:
        df = make()
    finally:
        _WRITTEN.reset(token)
        if outer is not None:
            outer += own
    done = cut_lineage(df)
    sc = done.sparkSession.sparkContext
    for path in own:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    return done
