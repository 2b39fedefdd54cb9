"""Merkle manifest of a dataset in van Emde Boas layout.

A tree has eight children a node. Leaves of one group (language) ascend by id;
their places come from a range sort and counts of its partitions, so no group is
sorted in one task. Every 4,096 aligned nodes (four levels) are one block, built
by one call from at most that many rows. Within a block the nodes stand in van
Emde Boas order: the upper half of the levels first, then the subtrees below it
one after the other, each laid out alike. A node's address follows from its
level and place by arithmetic alone (``address``), for building and for finding
siblings. The roots of blocks are the nodes of the next tier, and so on until
each group has one node; the subroots of all groups are the leaves of one more
tree of the same kind.

Siblings are read from the top down: the path above a block's root is worked out
once for the block and handed to the blocks, in the end the leaves, below it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import per_process, saved, width

ARITY = 8
#: Levels of a block; it has ARITY ** LEVELS nodes at most below its root.
LEVELS = 4
NO_ID = -(2**63)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree_size(levels: int) -> int:
    """Nodes of a full tree of so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(depth: int, place: int, levels: int) -> int:
    """Where the node ``place`` of depth ``depth`` (root: 0) stands in a tree of ``levels`` levels of nodes.

    The upper half of the levels comes first; a node below it belongs to the
    subtree of its ancestor there, and is looked for in that one's own layout.
    """
    at = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower, down = levels - upper, ARITY ** (depth - upper)
        at += tree_size(upper) + (place // down) * tree_size(lower)
        depth, place, levels = depth - upper, place % down, lower
    return at


def _height(nodes: int) -> int:
    """Levels above so many nodes, until one remains, or those of a whole block."""
    height = 0
    while nodes > 1 and height < LEVELS:
        nodes, height = -(-nodes // ARITY), height + 1
    return height


def layout(height: int) -> list[list[int]]:
    """The addresses of a block's nodes, by depth and place; worked out once for a worker process."""
    return per_process(f"layout{height}", lambda: [[address(depth, place, height + 1) for place in range(ARITY**depth)] for depth in range(height + 1)])


def build_block(nodes: list[str], height: int) -> list[str | None]:
    """The block over ``nodes``: digests by address, the root first; places of absent nodes are null, none at the end."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest("".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])
    placed_at = [(at, node) for where, row in zip(layout(height), reversed(levels), strict=True) for at, node in zip(where, row, strict=False)]
    out: list[str | None] = [None] * (max(placed_at)[0] + 1)
    for at, node in placed_at:
        out[at] = node
    return out


def siblings(block: list[str | None], place: int, height: int) -> list[tuple[list[str], int]]:
    """For the block's leaf ``place``, from below: the other nodes of its run, left to right, and how many stand before it."""
    path, where = [], layout(height)
    for depth in range(height, 0, -1):
        first, own = place // ARITY * ARITY, place % ARITY
        run = [block[at] for at in where[depth][first : first + ARITY] if at < len(block) and block[at]]
        path.append((run[:own] + run[own + 1 :], own))
        place //= ARITY
    return path


def fold(leaf: str, path: list[tuple[list[str], int]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for others, own in path:
        leaf = digest("".join(others[:own]) + leaf + "".join(others[own:]))
    return leaf


def leaf_digest(columns: list[Column]) -> Column:
    """H of the values: ``-`` for null, else UTF-8 byte count, colon, value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def placed(nodes: DataFrame, group: str, *order: str) -> DataFrame:
    """``nodes`` with ``place``, their rank from 0 within ``group`` by ``order``, and ``size``, the rows of the group.

    Rows are range-partitioned and written in order; a row's rank is its number
    in its partition and the rows of the group in the partitions before. Nulls
    of ``group`` and ``order`` come first, strings bytewise.
    """
    ranged = nodes.repartitionByRange(width(nodes.sparkSession), group, *order).sortWithinPartitions(group, *order)
    ranged = saved(ranged.withColumn("_n", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_n", 33))
    # a group has one row here for each partition that holds some of it
    parts = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_n").alias("_first"))
    own = Window.partitionBy(group)
    before = F.sum("_rows").over(own.orderBy("_part")) - F.col("_rows")
    parts = parts.withColumn("_before", before).withColumn("size", F.sum("_rows").over(own))
    parts = parts.select(F.col(group).alias("_group"), F.col("_part").alias("_in"), "_first", "_before", "size")
    joined = ranged.join(parts, (F.col("_part") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("place", F.col("_n") - F.col("_first") + F.col("_before")).drop("_n", "_part", "_in", "_group", "_first", "_before", "_rows")


BLOCKS = "tree string, block long, size long, nodes array<string>"


def _build(rows: pa.Table) -> pa.Table:
    tree, block, size = (rows.column(c)[0].as_py() for c in ("tree", "block", "size"))
    nodes = rows.sort_by("place").column("digest").to_pylist()
    found = build_block(nodes, _height(size))
    return pa.table(
        {"tree": [tree], "block": [block], "size": [size], "nodes": [found]},
        schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("nodes", pa.list_(pa.string()))]),
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks over (tree, place, size, digest): at most ARITY ** LEVELS rows meet in one call."""
    cut = nodes.withColumn("block", F.floor(F.col("place") / F.lit(ARITY**LEVELS)).cast("long"))
    return saved(cut.select("tree", "block", "size", "place", "digest").groupBy("tree", "block").applyInArrow(_build, BLOCKS), "blocks")


def tiers(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Blocks of every tier over (tree, place, size, digest), the lowest first; ``largest`` is the greatest size."""
    out = []
    while True:
        out.append(_blocks(nodes))
        if largest <= ARITY**LEVELS:
            return out
        largest = -(-largest // ARITY**LEVELS)
        # a tree that has come to its root goes no further
        above = out[-1].filter(F.col("size") > ARITY**LEVELS)
        size = F.ceil(F.col("size") / F.lit(ARITY**LEVELS)).cast("long")
        nodes = above.select("tree", F.col("block").alias("place"), size.alias("size"), F.col("nodes")[0].alias("digest"))


PATH = "array<struct<others:array<string>,own:int>>"
PATH_TYPE = pa.list_(pa.struct([("others", pa.list_(pa.string())), ("own", pa.int32())]))


def _as_path(path: list[tuple[list[str], int]]) -> list[dict]:
    return [{"others": others, "own": own} for others, own in path]


def _as_pairs(path: list[dict]) -> list[tuple[list[str], int]]:
    return [(step["others"], step["own"]) for step in path]


def _paths(batches):
    """For each node below a block's root: its siblings up to the top."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("path", PATH_TYPE)])
    for batch in batches:
        for k in range(batch.num_rows):
            tree, block, size, nodes, above = (batch.column(c)[k].as_py() for c in ("tree", "block", "size", "nodes", "path"))
            height, first = _height(size), block * ARITY**LEVELS
            count = min(ARITY**LEVELS, size - first)
            paths = [_as_path(siblings(nodes, place, height)) + above for place in range(count)]
            yield pa.RecordBatch.from_pydict({"tree": [tree] * count, "place": list(range(first, first + count)), "path": paths}, schema=schema)


def descend(blocks: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, block, size, nodes, path) of the lowest blocks, with the path above their roots.

    ``above``: (tree, path), the path above each tree's root.
    """
    known = above.select("tree", F.lit(0).cast("long").alias("place"), "path")
    for tier in range(len(blocks) - 1, -1, -1):
        here = blocks[tier]
        if tier + 1 < len(blocks):
            # roots of blocks that are trees of their own have their path from above
            known = known.unionByName(above.select("tree", F.lit(0).cast("long").alias("place"), "path").join(here.filter(F.col("size") <= ARITY**LEVELS).select("tree"), "tree", "left_semi"))
        joined = here.join(known.withColumnRenamed("place", "block"), ["tree", "block"])
        if tier == 0:
            return joined
        known = saved(joined.mapInArrow(_paths, f"tree string, place long, path {PATH}"), "paths")
    raise ValueError("no blocks")


@dataclass
class Manifest:
    """``leaves``: tree, place, size, digest and the carried columns; ``blocks`` and ``top`` in van Emde Boas layout, tier by tier."""

    leaves: DataFrame
    blocks: list[DataFrame]
    top: list[DataFrame]
    roots: DataFrame  # tree, subroot, root, path (above the subroot)


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("size")).first()[0] or 0


def _subroots(blocks: list[DataFrame]) -> DataFrame:
    """(tree, digest): the node that remains of each tree."""
    whole = [b.filter(F.col("size") <= ARITY**LEVELS).select("tree", F.col("nodes")[0].alias("digest")) for b in blocks]
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return out


def build(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest over a table: a leaf for each row, from ``columns``; ``carry`` names further columns of the leaves.

    Leaves ascend by id, a null id first; rows that share an id by their
    digests, so repeated rows are leaves of their own. A null group is a group
    of its own and comes first. The table may have other columns of any name.
    An empty table has no leaves, no blocks and no root.
    """
    carry = carry or {}
    # groups by name; a null one needs a name of its own, as nulls do not join
    tree = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf_digest([F.col(c) for c in columns]).alias("digest"), *[c.alias(n) for n, c in carry.items()])
    # written first: the range sort reads its input twice, which need not be the texts
    leaves = saved(placed(saved(leaves, "digests"), "tree", "id", "digest"), "leaves")
    blocks = tiers(leaves, _largest(leaves))
    subroots = _subroots(blocks)
    top = placed(subroots.withColumn("all", F.lit("top")).select("all", F.col("tree").alias("name"), "digest"), "all", "name")
    top = saved(top.withColumnRenamed("all", "tree"), "subroots")
    above = tiers(top, _largest(top))
    root = _subroots(above).select(F.col("tree"), F.col("digest").alias("root"))
    empty = root.select("tree", F.array().cast(PATH).alias("path"))
    lowest = descend(above, empty).mapInArrow(_paths, f"tree string, place long, path {PATH}")
    roots = lowest.join(top, ["tree", "place"]).join(root, "tree").select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return Manifest(leaves, blocks, above, saved(roots, "roots"))


PROOF = "id long, leaf string, subroot string, root string, proof array<string>, folded_root string"
_FIELDS = [("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.string())), ("folded_root", pa.string())]


def _prove(leaves: pa.Table, block: pa.Table) -> pa.Table:
    size, nodes, above, subroot, root = (block.column(c)[0].as_py() for c in ("size", "nodes", "path", "subroot", "root"))
    height, above = _height(size), _as_pairs(above)
    out = []
    rows = zip(*(leaves.column(c).to_pylist() for c in ("id", "place", "digest", "changed")), strict=True)
    for key, place, leaf, changed in rows:
        path = siblings(nodes, place % ARITY**LEVELS, height) + above
        out.append((key, leaf, subroot, root, [x for others, _ in path for x in others], fold(changed or leaf, path)))
    return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def prove(manifest: Manifest, changed: str | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root), a row for each leaf.

    proof: the siblings' digests, level by level up to the root, left to right.
    folded_root: the root that follows from them and the leaf, or the digest in
    the carried column ``changed`` where that is not null.
    """
    above = saved(descend(manifest.blocks, manifest.roots.select("tree", "path")).join(manifest.roots.drop("path"), "tree"), "below")
    block = F.floor(F.col("place") / F.lit(ARITY**LEVELS)).cast("long")
    other = F.col(changed) if changed else F.lit(None).cast("string")
    leaves = manifest.leaves.select("tree", block.alias("block"), "id", "place", "digest", other.alias("changed"))
    pair = leaves.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    return pair.applyInArrow(_prove, PROOF)
