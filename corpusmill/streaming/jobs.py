"""Structured Streaming forms of the stateful behaviours.

Routing, analysis and compression (S6) are stateless projections: call
``route``, ``analyze`` or ``compress`` on a streaming DataFrame unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from corpusmill.operators.analyze import HIGH_RETRIEVE_COUNT
from corpusmill.operators.memory import remember
from corpusmill.plans.reports import token_stats_columns
from corpusmill.plans.safety import reuse_cache


def running_token_stats(receipts: DataFrame) -> DataFrame:
    """D1 kept up to date; write in update mode. State is one row per scope."""
    return receipts.groupBy("scope_id").agg(*token_stats_columns())


def recent_failures(
    failures: DataFrame, late_by: str = "1 hour", length: str = "24 hours", slide: str = "1 hour"
) -> DataFrame:
    """S3: failures per scope in sliding 24-hour windows; later than ``late_by`` is dropped."""
    timed = failures.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return (
        timed.withWatermark("created_at", late_by)
        .groupBy(F.window("created_at", length, slide).alias("w"), "scope_id")
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(
            "scope_id",
            F.col("w.start").cast("timestamp_ntz").alias("from_time"),
            F.col("w.end").cast("timestamp_ntz").alias("to_time"),
            "failures",
        )
    )


ALERT = "scope_id string, ccr_id string, retrieve_count long"


def _alert(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, told = state.get if state.exists else (0, False)
    for rows in batches:
        count += len(rows)
    fires = count >= HIGH_RETRIEVE_COUNT and not told
    state.update((count, told or fires))
    if fires:
        yield pd.DataFrame({"scope_id": [key[0]], "ccr_id": [key[1]], "retrieve_count": [count]})


def high_retrieve_alerts(retrievals: DataFrame) -> DataFrame:
    """One alert per compressed row, when its retrievals reach five.

    State is a count and a flag per (scope_id, ccr_id). Retrievals carry
    scope_id and ccr_id.
    """
    return retrievals.select("scope_id", "ccr_id").groupBy("scope_id", "ccr_id").applyInPandasWithState(
        _alert, ALERT, "count long, told boolean", "append", GroupStateTimeout.NoTimeout
    )


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a table kept as numbered snapshots, None before the first."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException:
        return None
    newest = versions.agg(F.max("version")).scalar()
    return versions.filter(F.col("version") == newest).drop("version")


def remember_stream(
    requests: DataFrame, memories: DataFrame, path: str, checkpoint: str, now: str
):
    """Deduplicate and store arriving requests batch by batch.

    Every batch runs the M1/M2 job against the newest snapshot under ``path``
    and writes the next one; a batch that is run again overwrites its own
    version with the same rows.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = _before(spark, path, batch_id)
        change = remember(memories if earlier is None else earlier, batch, now)
        change.table.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    if batch_id == 0:
        return None
    return spark.read.parquet(f"{path}/version={batch_id - 1}")


def resolve_cache_stream(
    requests: DataFrame,
    tables: Callable[[SparkSession], tuple[DataFrame, DataFrame]],
    path: str,
    checkpoint: str,
    now: str,
):
    """Split arriving requests into cache hits and misses.

    ``tables`` gives the current (compressed, originals); hits and misses are
    written under ``path``, a repeated batch overwrites its own folder.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        compressed, originals = tables(batch.sparkSession)
        found = reuse_cache(batch, compressed, originals, now)
        found.hits.select("request_id", "scope_id", "ccr_id").write.mode("overwrite").parquet(
            f"{path}/hits/batch={batch_id}"
        )
        found.misses.write.mode("overwrite").parquet(f"{path}/misses/batch={batch_id}")

    return requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop, as parquet files under ``sink``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", sink).outputMode("append").start()
    else:

        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

        query = writer.foreachBatch(save).outputMode(mode).start()
    query.awaitTermination()
