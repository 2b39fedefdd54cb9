"""Pages, top-k and exact ranks that never sort one whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every key.

    Spark limits each map partition to k rows per key before the shuffle
    (WindowGroupLimit), so a hot key costs k rows per input partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def page(
    df: DataFrame,
    row_id: str,
    order: Sequence[tuple[str, bool]],
    limit: int = 20,
    offset: int = 0,
    keys: Sequence[str] = ("scope_id",),
) -> DataFrame:
    """One page per key with ``rank`` and the key's ``total``.

    ``order`` lists (column, descending); nulls go last either way and the row
    id breaks ties. Only the id and the order columns are ranked; the wide
    columns are joined back to the few rows of the page.
    """
    columns = [name for name, _ in order]
    by = [
        F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()
        for name, descending in order
    ]
    narrow = df.select(*dict.fromkeys([*keys, row_id, *columns]))
    ranked = top_per_key(narrow, keys, [*by, F.col(row_id)], offset + limit)
    wanted = ranked.filter(F.col("rank") > offset).select(*keys, row_id, "rank")
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return df.join(wanted, [*keys, row_id]).join(totals, list(keys))


def rank_in_buckets(
    df: DataFrame,
    keys: Sequence[str],
    buckets: dict[str, Column],
    order: Sequence[Column],
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Exact ``row_number`` per key when a key may hold a large share of all rows.

    ``buckets`` are expressions that do not decrease along the wanted order.
    Rows are counted per bucket, a running sum over those counts gives every
    bucket its first rank, and only the rows inside one bucket are sorted.
    """
    named = df.withColumns(buckets)
    by = [*keys, *buckets]
    counts = named.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        starts = starts.withColumn(total, F.sum("_n").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*by).orderBy(*order)
    ranked = named.withColumn("_inside", F.row_number().over(inside)).join(
        starts.drop("_n"), by
    )
    return ranked.withColumn(rank, F.col("_before") + F.col("_inside")).drop(
        "_before", "_inside", *buckets
    )


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int], bins: int = 4096
) -> DataFrame:
    """Exact nearest-rank percentiles plus max and count, one row per key.

    A histogram between the key's extremes finds the bin that holds each
    wanted rank; only the distinct values of that bin are put in order.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull())
    ends = rows.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_rows")
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_of = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / width))
    binned = rows.join(ends, list(keys)).withColumn("_bin", F.coalesce(bin_of, F.lit(0)))
    values = binned.groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_n"))

    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_in_bin"))
    running = Window.partitionBy(*keys).orderBy("_bin")
    upto = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_in_bin").over(upto))
    wanted = ends.select(
        *keys, F.explode(F.array(*[F.lit(p) for p in percents])).alias("_percent"), "_rows"
    ).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("_rows") * F.col("_percent") / 100)))
    holding = (
        wanted.join(counts, list(keys))
        .filter(
            (F.col("_upto") >= F.col("_rank"))
            & (F.col("_upto") - F.col("_in_bin") < F.col("_rank"))
        )
        .select(*keys, "_percent", "_bin", (F.col("_rank") - F.col("_upto") + F.col("_in_bin")).alias("_local"))
    )
    inside = Window.partitionBy(*keys, "_percent").orderBy("_v")
    found = (
        values.join(holding, [*keys, "_bin"])
        .withColumn("_run", F.sum("_n").over(inside))
        .filter(F.col("_run") >= F.col("_local"))
        .groupBy(*keys, "_percent")
        .agg(F.min("_v").alias("_v"))
    )
    chosen = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_percent") == p, F.col("_v"))).alias(f"p{p}") for p in percents]
    )
    tops = ends.select(*keys, F.col("_hi").alias("max"), F.col("_rows").alias("runs"))
    return chosen.join(tops, list(keys))
