"""Reading the corpus and preparing rows for the append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill import schemas
from corpusmill.functions import text as T
from corpusmill.session import as_time


def conform(df: DataFrame, ddl: str, **defaults: Column) -> DataFrame:
    """Project to a table schema; a default fills a missing column or nulls."""
    columns = []
    for field in StructType.fromDDL(ddl).fields:
        have = F.col(field.name) if field.name in df.columns else None
        default = defaults.get(field.name)
        if have is None:
            value = default if default is not None else F.lit(None)
        else:
            value = have if default is None else F.coalesce(have, default)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``; combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_first"))
    return best.select(*keys, "_first.*").select(*df.columns)


def resolve_scopes(directories: DataFrame) -> DataFrame:
    """A1: scope id and strategy from cwd, git_root and remote."""
    root, remote, cwd = F.col("git_root"), F.col("remote"), F.col("cwd")
    has_root = root.isNotNull()
    has_remote = has_root & (F.coalesce(F.length(remote), F.lit(0)) > 0)
    scope_id = (
        F.when(has_remote, F.concat(F.lit("repo_"), T.short_hash(F.concat(remote, root))))
        .when(has_root, F.concat(F.lit("repo_"), T.short_hash(root)))
        .otherwise(F.concat(F.lit("cwd_"), T.short_hash(cwd)))
    )
    strategy = (
        F.when(has_remote, "gitRemote+gitRoot")
        .when(has_root, "gitRootOnly")
        .otherwise("cwdFallback")
    )
    return directories.withColumns(
        {
            "scope_id": scope_id,
            "scope_strategy": strategy,
            "remote": F.when(has_remote, remote),
            "branch": F.when(has_root, F.col("branch")),
        }
    )


def new_scopes(scopes: DataFrame, resolved: DataFrame, now: Column | str) -> DataFrame:
    """A2: scope rows still absent from the table, one per id."""
    at = as_time(now)
    rows = conform(resolved, schemas.SCOPES, created_at=at, updated_at=at)
    one = first_per_key(rows, ["scope_id"], ["cwd"])
    return one.join(scopes.select("scope_id"), "scope_id", "left_anti")


def read_corpus(spark: SparkSession, path: str, source_format: str = "parquet") -> DataFrame:
    """A3: parquet, orc or json tables, or a folder of whole text files."""
    if source_format == "text":
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        return files.select(
            F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("content")
        )
    return spark.read.format(source_format).load(path)


def append(df: DataFrame, path: str, partition_by: str | None = "scope_id") -> None:
    """Append rows as parquet. A hot partition value is written by many tasks."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def new_compressed(rows: DataFrame, now: Column | str) -> DataFrame:
    """A4: rows of the compressed table with their defaults."""
    at = as_time(now)
    return conform(
        rows,
        schemas.COMPRESSED,
        can_retrieve_original=F.lit(True),
        retrieve_count=F.lit(0),
        failed=F.lit(False),
        cache_hit_count=F.lit(0),
        created_at=at,
        updated_at=at,
    )


def new_originals(rows: DataFrame, existing: DataFrame, now: Column | str) -> DataFrame:
    """A5: originals not stored yet, one per id, with hash and token count."""
    fresh = rows.join(existing.select("original_id"), "original_id", "left_anti")
    filled = fresh.withColumns(
        {
            "content_hash": T.content_hash(F.col("content")),
            "tokens": T.token_count(F.col("content")),
        }
    )
    shaped = conform(filled, schemas.ORIGINALS, created_at=as_time(now))
    order = ["scope_id", "ccr_id", "content_hash"]
    # a map cannot be part of min_by's ordering but may be part of its value
    return first_per_key(shaped, ["original_id"], order)


def flag_retrievable(compressed: DataFrame, originals: DataFrame) -> DataFrame:
    """A5, second half: a row with a stored original can be retrieved."""
    stored = originals.select("ccr_id", F.lit(True).alias("_stored")).distinct()
    return (
        compressed.join(stored, "ccr_id", "left")
        .withColumn(
            "can_retrieve_original",
            F.coalesce(F.col("_stored"), F.col("can_retrieve_original")),
        )
        .drop("_stored")
    )


def new_receipts(
    rows: DataFrame, operation: str, now: Column | str, id_from: Sequence[str]
) -> DataFrame:
    """Audit rows; the id is a hash of the operation and ``id_from``."""
    key = F.concat_ws("|", F.lit(operation), *[F.col(c).cast("string") for c in id_from])
    return conform(
        rows.withColumns({"receipt_id": F.concat(F.lit("rcp_"), F.sha2(key, 256)),
                          "operation": F.lit(operation)}),
        schemas.RECEIPTS,
        failed=F.lit(False),
        cache_hit=F.lit(False),
        timestamp=as_time(now),
    )


def new_failures(
    rows: DataFrame,
    operation: str,
    event_type: Column | str,
    now: Column | str,
    id_from: Sequence[str],
) -> DataFrame:
    """Failure rows. Rows that cannot be placed are what ``rejected_failures`` returns."""
    event = event_type if isinstance(event_type, Column) else F.lit(event_type)
    key = F.concat_ws("|", event, *[F.col(c).cast("string") for c in id_from])
    shaped = rows.withColumns(
        {
            "failure_id": F.concat(F.lit("fev_"), F.sha2(key, 256)),
            "operation": F.lit(operation),
            "event_type": event,
        }
    )
    return conform(shaped, schemas.FAILURES, created_at=as_time(now)).filter(
        F.col("scope_id").isNotNull() & F.col("event_type").isin(*schemas.FAILURE_TYPES)
    )


def rejected_failures(rows: DataFrame, event_type: Column | str) -> DataFrame:
    """The rows that ``new_failures`` cannot place, with the reason."""
    event = event_type if isinstance(event_type, Column) else F.lit(event_type)
    unknown = ~F.coalesce(event.isin(*schemas.FAILURE_TYPES), F.lit(False))
    reason = F.when(F.col("scope_id").isNull(), "scope_missing").when(unknown, "event_type_unknown")
    return rows.withColumn("reject_reason", reason).filter("reject_reason IS NOT NULL")


def new_profile_facts(remembered: DataFrame, now: Column | str) -> DataFrame:
    """A fact per remembered row that names a profile layer."""
    at = as_time(now)
    facts = remembered.filter(F.col("profile_target").isNotNull()).select(
        F.concat(F.lit("pf_"), F.sha2(F.col("memory_id"), 256)).alias("fact_id"),
        "scope_id",
        F.col("profile_target").alias("layer"),
        F.coalesce("summary", "content").alias("content"),
        F.col("memory_id").alias("source_memory_id"),
        "source_ref",
        "confidence",
        "expires_at",
    )
    return conform(
        facts, schemas.PROFILE_FACTS, confidence=F.lit(0.8), created_at=at, updated_at=at
    )


def link_originals(compressed: DataFrame, links: DataFrame) -> DataFrame:
    """A10: set original_ref (and retrievability) from (ccr_id, original_id) links.

    Several links of one row resolve to the largest original id.
    """
    one = links.groupBy("ccr_id").agg(F.max("original_id").alias("_linked"))
    return (
        compressed.join(one, "ccr_id", "left")
        .withColumns(
            {
                "original_ref": F.coalesce("_linked", "original_ref"),
                "can_retrieve_original": F.col("_linked").isNotNull()
                | F.col("can_retrieve_original"),
            }
        )
        .drop("_linked")
    )
