"""MinHash near-dedup by fast similarity sketching.

Dahlgaard, Knudsen and Thorup (2017): in each of the first t rounds every
element throws one ball, its hashed value, into a hashed bin; from round t on
round t + i throws all elements into bin i. A bin keeps its least value, where
earlier rounds win, and a set stops once its t bins are full. So every
coordinate fills, and a set of n elements costs about max(n, t log t) steps
instead of n * t. Sketches are cut into bands; sets that agree in a band are
compared exactly, on their full shingle sets.

Documents of equal sets form one class and only classes are compared. In a
bucket, one class, the hub, is compared with all others. Classes of buckets that
are then still in several components go on to an exact set-similarity join
(prefix filter, Bayardo et al. 2007, Xiao et al. 2008): sets are sorted by the
rarity of their shingles, and two sets that overlap enough share one of their
first few. A shared one makes a pair only if its places leave enough overlap and
if the sets' parity maps, one bit flipped for each shingle, differ in no more
bits than sets so alike can differ in shingles. All these bounds are exact: no
two classes of a bucket stay both linked and unfound, no bucket is capped, and a
large group of copies, being one component by then, costs no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusmill.llm.common import list_column, mix, saved, signed, slices, word_ids
from corpusmill.llm.components import components

#: Bands of six values: sets that overlap by 80 % agree in none of them with a chance of 5e-6.
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
NONE = np.uint64(2**64 - 1)
#: Bins of the histogram that orders shingles by rarity (two longs a bin, 4 MB on the driver at most), and longs of a parity map.
RARITY, MAP = 1 << 18, 8


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle ids of each text, concatenated, and their number for each text."""
    split = [text.encode().lower().split() for text in texts]  # bytes.lower() changes A-Z only
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    of_word = mix(word_ids([w for doc in split for w in doc]))
    n = np.where(sizes == 0, 0, np.maximum(sizes - words + 1, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    start = np.cumsum(sizes)[owner] - sizes[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids = np.zeros(len(owner), dtype=np.uint64)
    for k in range(words):
        inside = k < sizes[owner]
        ids[inside] = mix(ids[inside], of_word[start[inside] + k])
    short = sizes[owner] < words
    ids[short] = mix(ids[short], sizes[owner][short].astype(np.uint64))
    order = np.lexsort((ids, owner))
    ids, owner = ids[order], owner[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
    return ids[new], np.bincount(owner[new], minlength=len(texts))


def sketches(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BINS values for each set; empty sets keep NONE."""
    low = (np.uint64(1) << np.uint64(55)) - np.uint64(1)
    out = np.full((len(counts), BINS), NONE, dtype=np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for turn in range(2 * BINS):
        if not len(ids):
            break
        ball = mix(ids, turn * 2 + 1)
        value = (np.uint64(turn) << np.uint64(55)) | (mix(ball, 7) & low)
        into = ((ball >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64) if turn < BINS else turn - BINS
        np.minimum.at(out.reshape(-1), owner * BINS + into, value)
        if turn in (0, 1, 3) or turn % 8 == 7:
            part = np.zeros(len(counts), dtype=bool)
            left = np.unique(owner)
            part[left] = (out[left] == NONE).any(axis=1)
            keep = part[owner]
            ids, owner = ids[keep], owner[keep]
    return out


def set_keys(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart."""
    owner, out = np.repeat(np.arange(len(counts)), counts), np.zeros((2, len(counts)), dtype=np.uint64)
    for k in (0, 1):
        np.add.at(out[k], owner, mix(ids, k + 11))
    return signed(out[0]), signed(out[1])


DESCRIBED = "_id long, n int, a long, b long, bands array<long>"


def _describe(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            ids, counts = shingle_sets(batch.column("_text").to_pylist(), words)
            bands = sketches(ids, counts).reshape(-1, BANDS, ROWS)
            keys = mix(np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]), 3)
            for k in range(ROWS):
                keys = mix(keys, bands[:, :, k])
            a, b = set_keys(ids, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), pa.array(counts, pa.int32()), pa.array(a), pa.array(b),
                    list_column(signed(keys).reshape(-1), np.full(batch.num_rows, BANDS), pa.int64()),
                ],
                ["_id", "n", "a", "b", "bands"],
            )

    return rows


def _bins(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(64 - 18)).astype(np.int64)


def _histogram(words: int):
    """How many shingles of all sets fall into each bin; one table for each task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY, dtype=np.int64)
        for batch in slices(batches, "text"):
            ids, _ = shingle_sets(batch.column("text").to_pylist(), words)
            total += np.bincount(_bins(ids), minlength=RARITY)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bin", "c"])

    return rows


def parity_maps(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MAP longs a set; each shingle flips one bit, so two maps differ in at most as many bits as the sets in shingles."""
    owner = np.repeat(np.arange(len(counts)), counts)
    bit = (ids >> np.uint64(20)).astype(np.int64) % (MAP * 64)
    odd = np.bincount(owner * MAP * 64 + bit, minlength=len(counts) * MAP * 64).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(counts), MAP * 64), axis=1).view(np.int64)


PREFIXES = "key long, node long, n int, root long, k int, low boolean, " + ", ".join(f"m{i} long" for i in range(MAP))


def _prefixes(words: int, threshold: int, common: np.ndarray):
    """The rarest shingles of each set: its place ``k``, and ``low`` where it is of use with partners no smaller."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, counts = shingle_sets(batch.column("text").to_pylist(), words)
            maps = parity_maps(ids, counts)
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((ids, common[_bins(ids)], owner))
            place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = place <= (counts - -(-threshold * counts // 100))[owner]
            low = place <= (counts + -2 * threshold * counts // (100 + threshold))[owner]
            key, owner, place, low = ids[order][first], owner[first], place[first], low[first]
            node, root = (batch.column(c).to_numpy()[owner] for c in ("node", "root"))
            columns = [signed(key), node, counts[owner].astype(np.int32), root, place.astype(np.int32), low, *maps[owner].T]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "node", "n", "root", "k", "low", *(f"m{i}" for i in range(MAP))]
            )

    return rows


def likely_pairs(sets: DataFrame, words: int, threshold: int) -> DataFrame:
    """(a, b): pairs of (node, root, text) of different roots, among them all that overlap by ``threshold`` percent."""
    total = sets.select("text").mapInArrow(_histogram(words), "bin long, c long").groupBy("bin").agg(F.sum("c").alias("c")).toArrow()
    common = np.zeros(RARITY, dtype=np.int64)  # at most RARITY rows came, whatever the input
    common[total.column("bin").to_numpy()] = total.column("c").to_numpy()
    prefixes = saved(sets.select("node", "root", "text").mapInArrow(_prefixes(words, threshold, common), PREFIXES), "prefixes")
    less = prefixes.filter("low").select("key", *(F.col(c).alias(f"p_{c}") for c in prefixes.columns if c not in ("key", "low")))
    both, apart = F.col("n") + F.col("p_n"), sum(F.bit_count(F.col(f"m{i}").bitwiseXOR(F.col(f"p_m{i}"))) for i in range(MAP))
    possible = F.least(F.col("n") - F.col("k"), F.col("p_n") - F.col("p_k"))
    pairs = prefixes.join(less, "key").filter(
        (F.struct("p_n", "p_node") < F.struct(F.col("n").alias("p_n"), F.col("node").alias("p_node"))) & (F.col("root") != F.col("p_root"))
        & (100 * F.col("p_n") >= threshold * F.col("n"))
        & (possible * (100 + threshold) >= threshold * both) & (apart * (100 + threshold) <= (100 - threshold) * both)
    )
    return pairs.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()


def _compare(words: int, threshold: int):
    """Keeps the pairs whose full shingle sets overlap enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            for part in slices(iter([batch]), "text_b"):
                # each distinct text of the part once: a hub meets many others
                place: dict[str, int] = {}
                ends = [[place.setdefault(t, len(place)) for t in part.column(c).to_pylist()] for c in ("text_a", "text_b")]
                ids, counts = shingle_sets(list(place), words)
                sets = np.split(ids, np.cumsum(counts)[:-1])
                keep = []
                for x, y in zip(*ends, strict=True):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(both > 0 and 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each input row.

    Two documents are linked if their shingle sets overlap by ``threshold``
    percent or more; component_id is the least id reachable by links. Null and
    wordless texts have an empty set and stand alone. A text of fewer than
    ``words`` words is one shingle. A null id counts as the least and stays
    null. Rows equal in id and text get equal results. Ids are meant to be
    unique: sets that share their least id are taken for linked. Extra columns
    are not looked at, whatever their names. An empty table gives no rows.
    """
    if not 70 <= threshold <= 100:
        raise ValueError("bands are laid out for thresholds from 70")
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    )
    rows = saved(source.mapInArrow(_describe(words), DESCRIBED), "sketches")
    # a class: documents of one set; its node is the least id
    classes = rows.filter("n > 0").groupBy("a", "b").agg(F.min("_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    banded = classes.select(F.explode("bands").alias("key"), "node")
    # ids in another order, so that hubs are not the least ids; combined before the shuffle, so a hot bucket is not gathered
    turned = F.col("node").bitwiseXOR(F.lit(0x2545F4914F6CDD1D))
    hubs = banded.groupBy("key").agg(F.min(turned).alias("hub"), F.max(turned).alias("last")).filter("hub <> last")
    hubs = hubs.select("key", F.col("hub").bitwiseXOR(F.lit(0x2545F4914F6CDD1D)).alias("hub"))
    entries = saved(banded.join(hubs, "key"), "buckets")
    near = lambda a, b: F.lit(100) * F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)
    met = entries.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    size_of = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    stars = saved(met.join(size_of("a"), "a").join(size_of("b"), "b").filter(near(F.col("n_a"), F.col("n_b"))).select("a", "b"), "stars")
    nodes = entries.select(F.col("node").alias("_id")).distinct()
    texts = saved(source.join(nodes, "_id").select(F.col("_id").alias("node"), F.col("_text").alias("text")), "texts")

    def compared(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
        with_b = with_a.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
        return with_b.select("a", "b", "text_a", "text_b").mapInArrow(_compare(words, threshold), "a long, b long")

    roots = saved(components(compared(stars)), "roots")
    # what buckets still hold apart; their hubs have been compared with all others
    rest = entries.filter("hub <> node").select("key", "node")
    labelled = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    loose = labelled.join(several.select("key"), "key").select("node", "root").distinct()
    sets = saved(loose.join(texts, "node").dropDuplicates(["node", "text"]), "loose")
    seen = Observation()
    fresh = compared(likely_pairs(sets, words, threshold))
    fresh = saved(fresh.observe(seen, F.count(F.lit(1)).alias("n")), "links")
    if seen.get["n"]:
        # a star for each known component and the new links
        roots = saved(components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(fresh)), "roots")
    labels = classes.select("a", "b", "node").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
    done = rows.select("_id", "n", "a", "b").join(labels.select("a", "b", "component"), ["a", "b"], "left")
    id_of = lambda c: F.when(c == -(2**63), F.lit(None).cast("long")).otherwise(c)
    component = F.coalesce("component", "_id")
    return done.select(
        id_of(F.col("_id")).alias(id_col), F.col("n").cast("long").alias("n_shingles"), id_of(component).alias("component_id"),
        (F.col("_id") == component).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, all columns; of rows equal in id and text one stays.

    Ids that go or repeat are written first: rows meet a narrow table of a known
    size, and only rows whose id repeats are compared by their text.
    """
    fresh, seen = "_kept_id", Observation()
    while fresh in {c.lower() for c in docs.columns}:
        fresh = "_" + fresh
    judged = near_duplicates(docs, id_col, text_col, words, threshold)
    ids = judged.groupBy(F.col(id_col).alias(fresh)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marked = ids.filter("NOT kept OR n > 1").select(fresh, "kept")
    marked = saved(marked.observe(seen, F.count_if("kept").alias("n")), "marked")
    plain = docs.join(marked, docs[id_col].eqNullSafe(marked[fresh]), "left_anti")
    if not seen.get["n"]:
        return plain
    again = marked.filter("kept").select(F.col(fresh))
    return plain.union(docs.join(again, docs[id_col].eqNullSafe(again[fresh]), "left_semi").dropDuplicates([id_col, text_col]))
