"""Helpers of the operators: shared folder, document keys, bounded slices, numpy mixing."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python step holds as word lists or arrays at a time.
SLICE_BYTES = 2 << 20
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; only where that is unset (tests on one
    machine) a temporary folder is made, once for the application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return "file://" + _LOCAL[app]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _copy, _text), dealt by _id. Null text is empty, a null id counts as the smallest.

    Rows that share an id are told apart by ``_copy``, the rank of their text;
    rows equal in both share it and count as one document.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
    ).repartition(width(docs.sparkSession), "_id")
    rank = F.dense_rank().over(Window.partitionBy("_id").orderBy("_text"))
    return rows.select("_id", rank.alias("_copy"), "_text")


def back_id(column: str = "_id"):
    """The id that ``keyed`` was given."""
    return F.when(F.col(column) == -(2**63), F.lit(None).cast("long")).otherwise(F.col(column))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of at most ``limit`` bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def per_process(name: str, make: Callable):
    """One object for each Python worker process, kept for its next tasks: vocabularies and known words."""
    held = sys.modules.setdefault("_corpusmill_worker", types.ModuleType("_corpusmill_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def mix(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """64-bit identifiers of pairs of 64-bit identifiers."""
    with np.errstate(over="ignore"):
        return mix_on(mix_head(a), np.asarray(b, dtype=np.uint64))


def mix_head(a: np.ndarray) -> np.ndarray:
    """The part of ``mix`` that needs ``a`` alone."""
    h = np.asarray(a, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    return h


def mix_on(head: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``mix`` from its ``mix_head``."""
    h = head + b
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: sums of letters times a random number of their place in the span.

    Spans ascend, and one byte or more lies between two. Places have numbers of
    their own, not powers of one: those would make some words equal whatever
    the base is.
    """
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    sizes = end - start
    factors = mix(np.arange(1, int(sizes.max()) + 2, dtype=np.uint64), 0xC0FFEE)
    place = np.arange(start[0], end[-1] + 1) - np.repeat(start, np.append(np.diff(start), sizes[-1] + 1))
    # the bytes after a span count nothing
    term = data[start[0] : end[-1] + 1].astype(np.uint64) + np.uint64(1)
    inside = place < np.repeat(sizes, np.append(np.diff(start), sizes[-1] + 1))
    term = np.where(inside, term * factors[np.minimum(place, len(factors) - 1)], np.uint64(0))
    return mix(np.add.reduceat(term, start - start[0]), sizes.astype(np.uint64))


def word_ids(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same on every executor."""
    import pandas as pd

    if not words:
        return np.zeros(0, dtype=np.uint64)
    box = np.empty(len(words), dtype=object)
    box[:] = words
    return pd.util.hash_array(box, categorize=False)


def window_argmin(ids: np.ndarray, span: int) -> np.ndarray:
    """For each start, where the smallest of the next ``span`` ids stands (the leftmost of equals).

    Ids are compared by their upper 40 bits, so the choice depends on content only.
    """
    starts = len(ids) - span + 1
    if starts <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.empty(starts, dtype=np.int64)
    step = (1 << 23) - span
    for lo in range(0, starts, step):
        part = ids[lo : min(lo + step + span - 1, len(ids))]
        n = len(part)
        padded = np.full(-(-n // span) * span, np.uint64(2**64 - 1), dtype=np.uint64)
        padded[:n] = (part >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        rows = padded.reshape(-1, span)
        prefix = np.minimum.accumulate(rows, axis=1).ravel()
        suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - span + 1
        least = np.minimum(suffix[:m], prefix[span - 1 : span - 1 + m])
        out[lo : lo + m] = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
    return out


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from concatenated values and the length of each row's list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
