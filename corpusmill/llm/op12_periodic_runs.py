"""Periodic runs by a dictionary of basic factors.

For each power of two the dictionary names every stretch of that many words, so
that equal stretches of one document share a name; a name of the next power is
the pair of names of its halves. Only stretches that occur again need a name at
the next power. On each level an occurrence, its successor and the successor of
that one, equally far apart and at most twice the stretch away, are an
arithmetic progression and propose their distance as a period. Proposals that
stand side by side are one; each is extended word by word to both ends, and
equal runs are kept once.

A run of period q over at least 4q words is proposed on the level whose
stretches have q to 2q - 1 words: such a stretch recurs within the run at
multiples of q only, and from the run's start three times.

Documents are independent: no shuffle, and a task holds a few of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpusmill.llm.common import slices

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_TYPE = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
RESULT = StructType([StructField("n_words", LongType()), StructField("runs", ArrayType(RUN_TYPE)), StructField("collapsed", StringType())])


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of two equally long arrays agree, looked at in growing pieces."""
    at, step = 0, 16
    while at < len(a):
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return len(a)


def _proposals(names: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """(first, last, period) rows: places side by side from which progressions of one distance start.

    ``names`` of the stretches of ``size`` words at ``places``, which ascend.
    """
    order = np.argsort(names, kind="stable")
    name, place = names[order], places[order]
    step = np.full(len(order), -1, dtype=np.int64)
    step[:-1] = np.where(name[1:] == name[:-1], place[1:] - place[:-1], -1)
    good = np.zeros(len(order), dtype=bool)
    good[:-1] = (step[:-1] > 0) & (step[:-1] <= 2 * size) & (step[1:] == step[:-1])
    first, period = place[good], step[good]
    by_place = np.argsort(first)
    first, period = first[by_place], period[by_place]
    if not len(first):
        return np.zeros((0, 3), dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, (np.diff(first) != 1) | (np.diff(period) != 0)])
    ends = np.r_[starts[1:] - 1, len(first) - 1]
    return np.stack([first[starts], first[ends], period[starts]], axis=1)


def runs_of(words: np.ndarray, sizes: np.ndarray, min_length: int = 6, min_periods: int = 4) -> np.ndarray:
    """(document, start, length, period) of every run, by document, start and period.

    ``words``: numbers of the words of all documents, one after the other;
    ``sizes``: words of each document. Starts count from the document's first word.
    """
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    base = np.r_[0, np.cumsum(sizes)]
    if not len(words):
        return np.zeros((0, 4), dtype=np.int64)
    # words of different documents have different names, so nothing matches across a border
    _, names, counts = np.unique(doc_of * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    places = np.flatnonzero(counts[names] > 1)
    names = names[places]
    found: set[tuple[int, int, int]] = set()
    size, longest = 1, int(sizes.max()) // min_periods
    while len(places):
        reached: dict[int, int] = {}  # period -> end of its last stretch, as proposals ascend
        for a, b, q in _proposals(names, places, size).tolist():
            # stretches longer apart than they are long say nothing of the words between: extension does
            end = b + size + q
            if end <= reached.get(q, 0):
                continue
            doc = doc_of[a]
            lo, hi = base[doc], base[doc + 1]
            start = a - _agreeing(words[lo:a][::-1], words[lo + q : a + q][::-1])
            end += _agreeing(words[end:hi], words[end - q : hi - q])
            reached[q] = end
            if end - start >= max(min_length, min_periods * q):
                found.add((start, q, end - start))
        if size >= longest:
            break
        # names of twice the length: pairs of names, at places whose two halves both have one
        half = np.searchsorted(places, places + size)
        half[half == len(places)] = 0
        both = places[half] == places + size
        places, pairs = places[both], names[both] * (int(names.max()) + 1) + names[half[both]]
        _, names, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        again = counts[names] > 1
        places, names, size = places[again], names[again], size * 2
    if not found:
        return np.zeros((0, 4), dtype=np.int64)
    runs = np.array(sorted(found), dtype=np.int64)
    # of one stretch only its smallest period counts
    _, first = np.unique(runs[:, [0, 2]], axis=0, return_index=True)
    runs = runs[np.sort(first)]
    docs = doc_of[runs[:, 0]]
    return np.stack([docs, runs[:, 0] - base[docs], runs[:, 2], runs[:, 1]], axis=1)


def _rows(min_length: int, min_periods: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            split = [text.encode().split() for text in batch.column("_text").to_pylist()]
            sizes = np.array([len(w) for w in split], dtype=np.int64)
            box = np.empty(int(sizes.sum()), dtype=object)
            box[:] = [w for words in split for w in words]
            words = pd.factorize(box)[0].astype(np.int64)
            runs = runs_of(words, sizes, min_length, min_periods)
            at = np.r_[0, np.cumsum(sizes)]
            depth = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(depth, at[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
            np.add.at(depth, at[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
            keep = np.cumsum(depth)[:-1] == 0
            texts = []
            for k, words_of in enumerate(split):
                kept = keep[at[k] : at[k + 1]]
                texts.append(b" ".join(words_of if kept.all() else [w for w, stay in zip(words_of, kept.tolist(), strict=True) if stay]).decode())
            counts = np.bincount(runs[:, 0], minlength=len(sizes))
            values = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(RUN))
            listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), values)
            found = pa.StructArray.from_arrays([pa.array(sizes), listed, pa.array(texts, pa.string())], names=["n_words", "runs", "collapsed"])
            yield pa.RecordBatch.from_arrays([batch.column("_in"), found], names=["_in", "_found"])

    return rows


def with_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, min_periods: int = 4, result: str = "periodic") -> DataFrame:
    """All columns of ``docs`` but the text, and a struct ``result``, a row for each input row.

    result: n_words, runs (start, length, period, by start then period) and
    collapsed: the words, joined by one space, without those that a run holds
    after its first period. A run is a stretch of at least ``min_length`` words
    and ``min_periods`` (4 or more) of its smallest period that no neighbouring
    word extends. Null, empty and blank texts have no words, no runs and an
    empty ``collapsed``. Repeated rows get equal results; other columns may have
    any name, one named ``result`` is replaced. An empty table gives no rows.
    """
    if min_periods < 4:
        raise ValueError("min_periods must be at least 4")
    rest = [c for c in docs.columns if c not in (text_col, result)]
    carried = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1).alias("_"))
    rows = docs.select(carried.alias("_in"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = StructType([rows.schema["_in"], StructField("_found", RESULT)])
    done = rows.mapInArrow(_rows(min_length, min_periods), schema)
    return done.select(*[F.col("_in").getField(c).alias(c) for c in rest], F.col("_found").alias(result))


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a tail of known period in every tenth text (by crc32 of the id), its words joined by one space.

    With h the crc32 and g = h / 10: from word a = g mod n on, the words of a
    stretch of 1 + (n - a) / (3 + g mod 8) are repeated. Other texts, texts
    without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.withColumn("_w", F.when(h % 10 == 0, words))
    n = F.size("_w")
    a = (g % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice("_w", a + 1, period)
    # the stretch as often as it takes, cut to length
    tails = F.slice(F.flatten(F.array_repeat(tail, F.ceil((n - a) / period).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), a), tails), " ")
    return rows.withColumn(text_col, F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col(text_col))).drop("_w")


def digest(result: str) -> list:
    """Columns that stand for a row's runs: counts, the longest run (ties: smallest start, then period) and hashes."""
    runs = F.col(f"{result}.runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return [
        F.size(runs).cast("long").alias("n_runs"), (-longest["start"]).alias("start"), longest["length"].alias("length"), (-longest["period"]).alias("period"),
        F.floor(1000 * longest["length"] / -longest["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2(f"{result}.collapsed", 256).alias("collapsed_sha256"),
    ]
