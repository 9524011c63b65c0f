"""A Merkle manifest of a dataset: one tree for each group of rows, one tree over the groups, stored in blocks.

A tree joins every ``ARITY`` consecutive nodes (the last run may be shorter, even one node) until one is left. It is
stored as aligned blocks of ``BLOCK_HEIGHT`` levels of edges. Inside a block the nodes lie in van Emde Boas order: the
block is split at half its height into a top tree and the trees that hang on it, each laid out by the same rule and
stored one after the other. A node's place follows from its depth and index by arithmetic, and a path crosses few
stretches of memory whatever the size of a cache line. The roots of blocks are the leaves of the next level's blocks.

Leaves are hashed, ordered and numbered by Spark; a task builds or reads whole blocks, so it holds at most
``ARITY ** BLOCK_HEIGHT`` leaves, however many a group has.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from panelyst.llm.batches import temporary
from panelyst.session import written

ARITY, BLOCK_HEIGHT = 8, 4
#: Leaf records that one task orders; the number of tasks follows from the number of rows.
TASK_ROWS = 500_000
NULL_TREE = "-"

Nodes = np.ndarray


def size(levels: int) -> int:
    """Nodes of a complete tree with so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index):
    """The place of a node in a tree of ``levels`` levels in van Emde Boas order; ``index`` may be an array.

    >>> [address(2, 1, i) for i in range(3)], address(4, 2, 9)
    ([1, 2, 3], 18)
    """
    if levels == 1:
        return index * 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    width = ARITY ** (depth - top)
    return size(top) + index // width * size(levels - top) + address(levels - top, depth - top, index % width)


def height(leaves: int) -> int:
    """Levels of edges of a tree over so many leaves."""
    edges = 0
    while ARITY**edges < leaves:
        edges += 1
    return edges


def joined(digests: str) -> bytes:
    """The parent of children whose hexadecimal digests follow each other in ``digests``."""
    return hashlib.sha256(digests.encode()).digest()


def _depths(leaves: int, edges: int) -> list[int]:
    """Nodes at each depth of a block, from its root down to its leaves."""
    counts = [leaves]
    for _ in range(edges):
        counts.append(-(-counts[-1] // ARITY))
    return counts[::-1]


def build_block(leaves: Nodes, edges: int) -> Nodes:
    """All nodes over ``leaves`` (one digest a row), ``edges`` levels up, in van Emde Boas order; unused places are 0."""
    nodes = np.zeros((size(edges + 1), 32), np.uint8)
    row = leaves
    for depth in range(edges, -1, -1):
        nodes[address(edges + 1, depth, np.arange(len(row)))] = row
        if depth:
            digits, step = row.tobytes().hex(), 64 * ARITY
            parents = b"".join(joined(digits[at : at + step]) for at in range(0, len(digits), step))
            row = np.frombuffer(parents, np.uint8).reshape(-1, 32)
    return nodes


def siblings(nodes: Nodes, leaves: int, edges: int) -> list[tuple[list[str], list[str]]]:
    """For each level, leaves first: the digests left and right of every leaf's ancestor in its run, as joined text."""
    out, of = [], np.arange(leaves)
    counts = _depths(leaves, edges)
    for depth in range(edges, 0, -1):
        digits = nodes[address(edges + 1, depth, np.arange(counts[depth]))].tobytes().hex()
        first = of // ARITY * ARITY
        last = np.minimum(first + ARITY, counts[depth])
        bounds = (64 * np.stack([first, of, of + 1, last])).T.tolist()
        out.append(([digits[a:b] for a, b, _, _ in bounds], [digits[c:d] for _, _, c, d in bounds]))
        of = of // ARITY
    return out


@dataclass(frozen=True)
class Manifest:
    """``leaves``: ``tree, i, n, block, leaf`` and what was carried; ``levels``: the blocks of the groups' trees, lowest
    first, as ``tree, block, n, leaves, edges, nodes``; ``subroots``: ``tree, i, n, block, leaf``, a leaf for each group's root;
    ``over``: the blocks of the tree over the groups; ``root``: the one digest of it all, None without rows."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    over: list[DataFrame]
    root: str | None


def record(*columns: str | Column) -> Column:
    """A row as unambiguous text: ``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    def part(c):
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.concat(*[part(c) for c in columns])


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a written table) with ``i`` (from 0 within ``tree``, by ``order``, nulls first), ``n`` and ``block``.

    One range partitioning by tree and order; rows that are alike are told apart by a number, so no tree and no
    repeated row is gathered. Offsets come from one small row for each tree and partition.
    """
    part, row, tie = (temporary(c) for c in ("part", "row", "tie"))
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    keys = ["tree", *order, tie]
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    # A task's rows get consecutive numbers in their sorted order, above 33 bits for the task.
    numbered = F.monotonically_increasing_id()
    placed = written(ranged.select("*", F.spark_partition_id().alias(part), numbered.alias(row)).drop(tie))
    runs = placed.groupBy("tree", part).agg(F.min(row).alias("least"), F.count("*").alias("many"))
    before = Window.partitionBy("tree").orderBy(part)
    runs = runs.select(
        F.col("tree").alias(f"{part}t"), F.col(part).alias(f"{part}p"),
        (F.sum("many").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("many") - F.col("least")).alias(f"{part}o"),
        F.sum("many").over(Window.partitionBy("tree")).alias("n"),
    )
    out = placed.join(runs, (F.col("tree") == F.col(f"{part}t")) & (F.col(part) == F.col(f"{part}p")))
    out = out.withColumn("i", F.col(row) + F.col(f"{part}o"))
    return out.withColumn("block", F.floor(F.col("i") / ARITY**BLOCK_HEIGHT)).drop(part, row, f"{part}t", f"{part}p", f"{part}o")


_BLOCK = "tree string, block long, n long, leaves long, edges int, nodes binary, root string"


def _block(table: pa.Table) -> pa.Table:
    """One block from its leaves: ``tree, block, n, i, leaf``."""
    table = table.sort_by("i")
    leaves = np.frombuffer(bytes.fromhex("".join(table.column("leaf").to_pylist())), np.uint8).reshape(-1, 32)
    tree, block, n = (table.column(c)[0].as_py() for c in ("tree", "block", "n"))
    edges = min(height(n), BLOCK_HEIGHT)
    nodes = build_block(leaves, edges)
    row = {"tree": tree, "block": block, "n": n, "leaves": len(leaves), "edges": edges, "nodes": nodes.tobytes(), "root": nodes[0].tobytes().hex()}
    return pa.Table.from_pylist([row], pa.schema(
        [("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("leaves", pa.int64()), ("edges", pa.int32()),
         ("nodes", pa.binary()), ("root", pa.string())]
    ))


def _blocks(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of blocks over numbered ``leaves``, and ``tree, root``."""
    levels, many = [], ARITY**BLOCK_HEIGHT
    rows = leaves
    while True:
        made = rows.select("tree", "block", "n", "i", "leaf").groupBy("tree", "block").applyInArrow(_block, _BLOCK)
        levels.append(written(made))
        # Roots of the trees that have more than this one block are the leaves of the next level.
        up = levels[-1].where(F.col("n") > many).select(
            "tree", F.floor(F.col("block") / many).alias("block"), F.ceil(F.col("n") / many).alias("n"),
            F.col("block").alias("i"), F.col("root").alias("leaf"),
        )
        if up.isEmpty():
            break
        rows = up
    roots = None
    for level in levels:
        top = level.where(F.col("n") <= many).select("tree", "root")
        roots = top if roots is None else roots.unionByName(top)
    return levels, roots


def manifest(docs: DataFrame, leaf: Column, group: str, order: str, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``: a tree for each ``group`` (null is one, before all others; then by UTF-8 bytes).

    ``leaf`` is a row's hexadecimal digest; rows ascend by ``order`` (null first) and, where that is equal, by leaf, so
    the root does not depend on how rows are stored. ``order`` and the ``carry`` columns are kept beside the leaves.
    Repeated rows are a leaf each; other columns are not read; an empty table has no root.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(NULL_TREE))
    kept = [c.alias(name) for name, c in (carry or {}).items()]
    leaves = written(_numbered(written(docs.select(tree.alias("tree"), order, leaf.alias("leaf"), *kept)), [order, "leaf"]))
    levels, roots = _blocks(leaves)
    top = written(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("leaf")))
    subroots = written(_numbered(top, ["of"]))
    over, last = _blocks(subroots)
    found = last.first()
    return Manifest(leaves, levels, subroots, over, found["root"] if found else None)


_PATH = "array<struct<left string, right string>>"
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _paths(leaves: pa.Table, block: pa.Table, keep: list[str]) -> pa.Table:
    """The leaves of one block with their paths: inside the block, and from its root upwards."""
    leaves = leaves.sort_by("i")
    n, edges = block.column("leaves")[0].as_py(), block.column("edges")[0].as_py()
    nodes = np.frombuffer(block.column("nodes")[0].as_py(), np.uint8).reshape(-1, 32)
    above = block.column("path")[0].as_py() or []
    levels = siblings(nodes, n, edges) + [([s["left"]] * n, [s["right"]] * n) for s in above]
    if len(levels):
        left, right = ([s for row in zip(*(level[side] for level in levels), strict=True) for s in row] for side in (0, 1))
    else:
        left, right = [], []
    offsets = pa.array(np.arange(n + 1) * len(levels), pa.int32())
    pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], names=["left", "right"])
    path = pa.ListArray.from_arrays(offsets, pairs).cast(_PATH_TYPE)
    subroot = pa.array([block.column("subroot")[0].as_py()] * n, pa.string())
    return leaves.select(keep).append_column("subroot", subroot).append_column("path", path)


def _descend(rows: DataFrame, blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """``rows`` (numbered leaves) with ``subroot, path``, read from ``blocks`` and the paths ``above`` of the blocks' roots."""
    keep = [c for c in rows.columns if c not in ("tree", "block", "i", "n")]
    keep = ["tree", "block", "i", *keep]
    own = blocks.select("tree", "block", "leaves", "edges", "nodes")
    if above is None:
        own = own.select("*", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(_PATH).alias("path"))
    else:
        found = above.select(F.col("tree").alias("t"), F.col("i").alias("b"), "subroot", "path")
        own = own.join(found, (F.col("tree") == F.col("t")) & (F.col("block") == F.col("b")), "left").drop("t", "b")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (rows.schema[c] for c in keep))
    return rows.groupBy("tree", "block").cogroup(own.groupBy("tree", "block")).applyInArrow(
        lambda a, b: _paths(a, b, keep), f"{schema}, subroot string, path {_PATH}"
    )


def _all_paths(leaves: DataFrame, levels: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """Paths of ``leaves``, from the highest blocks down; ``above``: paths of whole trees' roots, as ``tree, subroot, path``."""
    many = ARITY**BLOCK_HEIGHT
    found = None if above is None else above.select("tree", F.lit(0).cast("long").alias("i"), "subroot", "path")
    for at in range(len(levels) - 1, 0, -1):
        # This level's leaves are the roots of the blocks below; single blocks are roots of their trees already.
        rows = levels[at - 1].where(F.col("n") > many).select(
            "tree", F.floor(F.col("block") / many).alias("block"), F.col("block").alias("i"), F.ceil(F.col("n") / many).alias("n")
        )
        inner = _descend(rows, levels[at], found).select("tree", "i", "subroot", "path")
        whole = None if found is None else found.join(levels[at - 1].where(F.col("n") > many).select("tree").distinct(), "tree", "left_anti")
        found = written(inner if whole is None else inner.unionByName(whole))
    return _descend(leaves, levels[0], found)


def proofs(made: Manifest) -> DataFrame:
    """Every leaf of a manifest with ``subroot`` and ``path``: what stands left and right of it, level by level up to the root.

    Columns: ``tree``, the leaf, the order and carried columns, ``subroot``, ``path``. Hashing a leaf up its path gives
    the root (``folded``). A manifest of no rows gives none.
    """
    tops = _all_paths(made.subroots, made.over, None).select(F.col("of").alias("tree"), F.col("leaf").alias("subroot"), "path")
    return _all_paths(made.leaves, made.levels, written(tops)).drop("block", "i")


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(F.col(path), F.col(leaf), lambda own, at: F.sha2(F.concat(at["left"], own, at["right"]), 256))


def proof_digest(path: str = "path") -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(F.col(path), lambda at: F.concat(at["left"], at["right"])), ""), 256)
