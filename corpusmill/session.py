"""Session defaults and helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were planned for.

    Sides of joins are broadcast only when Spark has measured them below
    ``autoBroadcastJoinThreshold``, or hold a row per scope; what was written
    and read back is not (``shuffled``). Hot keys of the remaining sort-merge
    joins are split by AQE.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # the compressors are large expressions; recording a call site for every
        # function call would take most of the time to build them
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs on one machine (tests) a temporary
    one is made, once for a context.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        configured = context.getCheckpointDir()
    return configured.rstrip("/")


#: Whether Spark drops the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and what follows reads it often.

    What was shuffled for it is dropped at once, or it would stay on disk until
    the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """For a join with a table of ``written``, or a part of it, that grows with the input: no side is broadcast.

    Spark takes the size of files for that of their rows. Sorted or repeating
    rows can be a hundred times their files, and the driver holds what is broadcast.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def as_time(now: Column | str) -> Column:
    """``now`` is always an explicit argument, a Column or 'yyyy-MM-dd HH:mm:ss'."""
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
