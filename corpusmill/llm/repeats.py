"""Repeats of a fixed length across all documents, found from content-chosen seeds.

A *string* is ``length`` consecutive units (words or bytes) of one document.
Each string owns one seed inside it, chosen by content, and consecutive strings
that own the same seed form a *run*. Equal strings own equal seeds, so all
comparing happens among occurrences of one seed, in three steps of growing
resolution, each dropping what is settled:

1. whole runs: two equal runs settle all their strings at once;
2. blocks of a run (optional), for one run of each kind;
3. single strings of what is left.

Every step is an aggregate or window keyed by seed and content; nothing is
compared pairwise and no group is gathered in memory. Occurrences of one run
inside a slice of documents travel in one row, so a passage that a third of
all documents share costs a row for each slice and seed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import list_column, mix, signed, slices, width, window_argmin

#: ids of a slice's texts: (seed grams, strings, unit count of each document)
Ids = Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]

SEEDS = "anchor long, ext long, _id long, _copy int, lo int, n int, d int, rest array<struct<_id: long, _copy: int, lo: int>>"
STRINGS = "anchor long, _id long, _copy int, lo int, d int, ids array<long>"
BLOCK = 16


def runs(seed_ids: np.ndarray, string_ids: np.ndarray, sizes: np.ndarray, length: int, gram: int):
    """Runs of a slice: document, first string, string count, seed position (all in slice units)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = len(owner)
    if total < length:
        return (np.zeros(0, dtype=np.int64),) * 4
    seed = window_argmin(seed_ids, length - gram + 1)[: total - length + 1]
    starts = np.nonzero(owner[: total - length + 1] == owner[length - 1 :])[0]
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 4
    seed = seed[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (seed[1:] != seed[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, len(starts)))
    return owner[starts[first]], starts[first], count, seed[first]


def run_ids(string_ids: np.ndarray, lo: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """What a run holds: its first and last string (they overlap or touch) and where the seed stands."""
    return mix(mix(string_ids[lo], string_ids[lo + n - 1]), (seed - lo).astype(np.uint64) << np.uint64(32) | n.astype(np.uint64))


def _seed_rows(ids: Ids, length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            grams, strings, sizes = ids(batch.column("_text").to_pylist())
            doc, lo, n, seed = runs(grams, strings, sizes, length, gram)
            if not len(doc):
                continue
            begin = np.cumsum(sizes) - sizes
            anchor, ext = grams[seed], run_ids(strings, lo, n, seed)
            key = batch.column("_id").to_numpy()[doc]
            copy = batch.column("_copy").to_numpy()[doc]
            at, d = lo - begin[doc], seed - lo
            order = np.lexsort((at, copy, key, ext, anchor))
            anchor, ext, key, copy, at, n, d = (x[order] for x in (anchor, ext, key, copy, at, n, d))
            new = np.ones(len(key), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (ext[1:] != ext[:-1])
            first = np.nonzero(new)[0]
            others = np.nonzero(~new)[0]
            more = np.diff(np.append(first, len(key))) - 1
            offsets = np.zeros(len(first) + 1, dtype=np.int32)
            np.cumsum(more, out=offsets[1:])
            members = pa.StructArray.from_arrays(
                [pa.array(key[others], pa.int64()), pa.array(copy[others], pa.int32()), pa.array(at[others], pa.int32())],
                ["_id", "_copy", "lo"],
            )
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members)
            rest = pa.compute.if_else(pa.array(more > 0), rest, pa.scalar(None, rest.type)) if len(others) else pa.nulls(len(first), rest.type)
            columns = [
                pa.array(signed(anchor[first])), pa.array(signed(ext[first])), pa.array(key[first], pa.int64()),
                pa.array(copy[first], pa.int32()), pa.array(at[first], pa.int32()), pa.array(n[first], pa.int32()),
                pa.array(d[first], pa.int32()), rest,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "ext", "_id", "_copy", "lo", "n", "d", "rest"])

    return rows


def _string_rows(ids: Ids, length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            _, strings, sizes = ids(batch.column("_text").to_pylist())
            begin = np.cumsum(sizes) - sizes
            wanted = batch.column("open")
            counts = pa.compute.list_value_length(wanted).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), counts)
            flat = wanted.flatten()
            anchor, lo, n, d = (flat.field(k).to_numpy() for k in range(4))
            n = n.astype(np.int64)
            if not len(doc):
                continue
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(begin[doc] + lo, n) + step
            columns = [
                pa.array(anchor, pa.int64()), pa.array(batch.column("_id").to_numpy()[doc], pa.int64()),
                pa.array(batch.column("_copy").to_numpy()[doc], pa.int32()), pa.array(lo, pa.int32()),
                pa.array(d, pa.int32()), list_column(signed(strings[at]), n, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "_id", "_copy", "lo", "d", "ids"])

    return rows


def _where():
    return F.struct("_id", "_copy", "lo")


def find(docs: DataFrame, ids: Ids, length: int, gram: int, later_only: bool, blocks: bool) -> DataFrame:
    """(_id, _copy, spans): spans are (lo, n), n consecutive strings from lo that also start elsewhere.

    ``docs`` is what ``common.keyed`` returns. With ``later_only`` the first
    start of a string, by (_id, _copy, position), is not counted as a repeat.
    """
    parts = width(docs.sparkSession)
    seeds = docs.mapInArrow(_seed_rows(ids, length, gram), SEEDS).repartition(parts, "anchor")

    of_run, of_seed = Window.partitionBy("anchor", "ext"), Window.partitionBy("anchor")
    last = F.greatest(_where(), F.coalesce(F.array_max("rest"), _where()))
    judged = (
        seeds.withColumn("first", F.min(_where()).over(of_run))
        .withColumn("repeated", F.max(last).over(of_run) != F.col("first"))
        .withColumn("kinds", F.min("ext").over(of_seed) != F.max("ext").over(of_seed))
        .filter("repeated OR kinds")
    )
    members = F.concat(F.array(_where()), F.coalesce("rest", F.array().cast("array<struct<_id: long, _copy: int, lo: int>>")))
    facts = judged.select(
        "anchor", "n", "d", "repeated", "kinds", "first", F.explode(members).alias("m")
    ).select(
        F.col("m._id").alias("_id"), F.col("m._copy").alias("_copy"), F.col("m.lo").alias("lo"), "n", "d", "anchor",
        (F.col("repeated") & ((F.col("m") != F.col("first")) | F.lit(not later_only))).alias("settled"),
        (F.col("kinds") & (F.col("m") == F.col("first"))).alias("open"),
    ).filter("settled OR open")
    # one list of whole facts: both uses below then read the same shuffle
    by_doc = (
        facts.repartition(parts, "_id")
        .groupBy("_id", "_copy")
        .agg(F.collect_set(F.struct("anchor", "lo", "n", "d", "settled", "open")).alias("facts"))
    )
    opened = F.transform(F.filter("facts", lambda f: f["open"]), lambda f: F.struct(*(f[c].alias(c) for c in ("anchor", "lo", "n", "d"))))
    settled_runs = F.transform(F.filter("facts", lambda f: f["settled"]), lambda f: F.struct(f["lo"].alias("lo"), f["n"].alias("n")))
    asked = of_documents(docs, by_doc.select("_id", "_copy", opened.alias("open")).filter(F.size("open") > 0), "inner")
    strings = asked.dropDuplicates(["_id", "_copy"]).mapInArrow(_string_rows(ids, length), STRINGS).repartition(parts, "anchor")
    kept = F.transform("ids", lambda h, k: F.struct(h.alias("string"), (F.col("lo") + k).alias("lo"), F.lit(1).alias("n")))
    if blocks:
        # blocks end where the distance to the seed is a multiple of BLOCK, alike in all runs of a seed
        cut = F.expr(
            f"transform(sequence(0, cast(ceil(greatest(size(ids) - d % {BLOCK} - 1, 0) / {BLOCK}) as int)), "
            f"k -> struct(if(k = 0, 0, d % {BLOCK} + 1 + {BLOCK} * (k - 1)) as off, if(k = 0, slice(ids, 1, d % {BLOCK} + 1), "
            f"slice(ids, d % {BLOCK} + 2 + {BLOCK} * (k - 1), {BLOCK})) as ids))"
        )
        pieces = strings.select("anchor", "_id", "_copy", "lo", F.explode(cut).alias("b")).select(
            "anchor", "_id", "_copy", (F.col("lo") + F.col("b.off")).alias("lo"), F.col("b.ids").alias("ids"),
            F.xxhash64(F.element_at("b.ids", 1), F.element_at("b.ids", -1), F.size("b.ids")).alias("ext"),
        )
        of_piece = Window.partitionBy("anchor", "ext")
        strings = pieces.withColumn("first", F.min(_where()).over(of_piece)).withColumn("last", F.max(_where()).over(of_piece))
        settled = (F.col("first") != F.col("last")) & ((F.col("first") != _where()) | F.lit(not later_only))
        # a settled block gives one row without a string, the first block of its kind one for each string
        whole = F.array(F.struct(F.lit(None).cast("long").alias("string"), F.col("lo"), F.size("ids").alias("n")))
        none = F.array().cast("array<struct<string: long, lo: int, n: int>>")
        kept = F.concat(F.when(settled, whole).otherwise(none), F.when(F.col("first") == _where(), kept).otherwise(none))
    single = strings.select("anchor", "_id", "_copy", F.explode(kept).alias("s")).select("anchor", "_id", "_copy", "s.*")
    of_string = Window.partitionBy("anchor", "string")
    repeat = F.min(_where()).over(of_string) != (_where() if later_only else F.max(_where()).over(of_string))
    found = (
        single.withColumn("repeat", repeat)
        .filter("repeat OR string IS NULL")
        .groupBy("anchor", "_id", "_copy")
        .agg(F.collect_list(F.struct("lo", "n")).alias("spans"))
        .select("_id", "_copy", "spans")
    )
    union = found.unionByName(by_doc.select("_id", "_copy", settled_runs.alias("spans")).filter(F.size("spans") > 0))
    return union.repartition(parts, "_id").groupBy("_id", "_copy").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def of_documents(docs: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """Join facts to their documents; both are dealt by _id and stay so.

    The copy is compared as a difference: as an equality it would become a key,
    and Spark would deal both sides anew by the pair.
    """
    facts = facts.withColumnsRenamed({"_id": "_fid", "_copy": "_fcopy"})
    same = (docs["_id"] == facts["_fid"]) & ((docs["_copy"] - facts["_fcopy"]) == 0)
    return docs.join(facts, same, how).drop("_fid", "_fcopy")


def covered(lo: np.ndarray, n: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which units of one document stand in a string that starts in a span."""
    depth = np.zeros(size + 1, dtype=np.int32)
    np.add.at(depth, lo, 1)
    np.add.at(depth, np.minimum(lo + n - 1 + length, size), -1)
    return np.cumsum(depth[:-1]) > 0
