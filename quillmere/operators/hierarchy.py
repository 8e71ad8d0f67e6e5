"""Parent-child links to full hierarchies by contraction of partition-local chains.

A level of the recursion holds a forest as rows (node, parent, weight), cut into fragments. The first
level takes ranges of the nodes, as related rows are often near each other; on later levels a node
joins its parent's fragment by a coin that makes stars of neighbours, unless the parent has more
children than a fragment shall hold. Each fragment follows its parent chains as far as they stay
inside and gives every node its exit, the first ancestor outside, with the distance. Only nodes that
are exits of others are needed outside; they are the nodes of the next level, their exits its parents.
Leaves are never exits and every node with its only child in its own fragment is none, so each level
is smaller by a constant share until one fragment holds it. Going back, a node's root and depth are
its exit's, plus the distance; the nodes of an exit that very many have are spread.

Cycles inside a fragment are seen there. A cycle over fragments becomes a cycle of exits in a smaller
level; going back, the chains between its exits are marked as lying on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators.skew import hot_keys, salted
from quillmere.session import stage, unstage

#: Nodes of one fragment, about: what a task contracts in memory, and the size at which the recursion ends.
FRAGMENT_NODES = 50_000

_LEVEL = "node long, parent long, weight long, root long, depth long, cyclic boolean, trail array<long>"
_LOCAL = "node long, parent long, fragment long, exit long, distance long, root long, depth long, cyclic boolean, on_cycle boolean, trail array<long>"


def _positions(nodes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index in sorted ``nodes`` of each wanted one, -1 where there is none."""
    if not len(nodes):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(nodes, wanted)
    at[at == len(nodes)] = 0
    return np.where(nodes[at] == wanted, at, -1)


def _column(batch: pa.Table, name: str, null: int = 0) -> np.ndarray:
    return batch.column(name).combine_chunks().fill_null(null).to_numpy(zero_copy_only=False)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fragment's rows to exits, by pointer doubling over arrays."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).sort_by("node")
    node, weight = _column(rows, "node"), _column(rows, "weight")
    has_parent = rows.column("parent").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    parent = np.where(has_parent, _positions(node, _column(rows, "parent")), -1)
    parent[~has_parent] = -1
    inside = parent >= 0
    jump = np.where(inside, parent, np.arange(len(node)))
    distance = np.where(inside, weight, 0)
    for _ in range(int(len(node)).bit_length() + 1):
        further = jump[jump]
        distance = distance + distance[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    looping = inside[jump]  # the chain still has a parent inside after as many steps as there are nodes
    on_cycle = np.zeros(len(node), bool)
    on_cycle[jump[looping]] = True
    leaves = has_parent[jump] & ~looping
    original = rows.column("parent").combine_chunks()
    exits = pa.array(np.where(leaves, original.fill_null(0).to_numpy(zero_copy_only=False)[jump], 0), mask=~leaves)
    distance = np.where(leaves, distance + weight[jump], distance)
    base_cyclic = rows.column("cyclic").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)[jump]
    cyclic = looping | (base_cyclic & ~leaves)
    settled = ~leaves & ~cyclic
    root = pa.array(_column(rows, "root")[jump], mask=~settled)
    depth = pa.array(_column(rows, "depth")[jump] + distance, mask=~settled)
    trails = _trails(rows, parent, jump, looping)
    yield from pa.Table.from_arrays(
        [pa.array(node), original, rows.column("fragment"), exits, pa.array(distance), root, depth, pa.array(cyclic), pa.array(on_cycle), trails],
        names=["node", "parent", "fragment", "exit", "distance", "root", "depth", "cyclic", "on_cycle", "trail"],
    ).to_batches(max_chunksize=10_000)


def _trails(rows: pa.Table, parent: np.ndarray, jump: np.ndarray, looping: np.ndarray) -> pa.Array:
    """The nodes below the exit, or from the root, down to each node; none where trails aren't kept or there is a loop."""
    links = rows.column("trail").combine_chunks()
    if not any(links.is_valid().to_pylist()):
        return pa.nulls(len(parent), pa.list_(pa.int64()))
    own = links.to_pylist()
    full: list[list[int] | None] = [None] * len(own)
    for i in range(len(own)):
        if looping[i]:
            full[i] = []
            continue
        chain = [i]
        while full[chain[-1]] is None and parent[chain[-1]] >= 0:
            chain.append(int(parent[chain[-1]]))
        above = full[chain[-1]]
        if above is None:
            above = full[chain[-1]] = own[chain[-1]] or []
        for k in reversed(chain[:-1]):
            above = full[k] = above + (own[k] or [])
    return pa.array(full, pa.list_(pa.int64()))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fragment's nodes that reach a cycle; those on it: all from an exit on the cycle up to where the chain leaves."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).sort_by("node")
    node = _column(rows, "node")
    parent = _positions(node, _column(rows, "parent"))
    marked = rows.column("on_cycle").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False).copy()
    front = np.flatnonzero(marked)
    while len(front):
        up = parent[front]
        up = np.unique(up[up >= 0])
        front = up[~marked[up]]
        marked[front] = True
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(marked)], names=["node", "on_cycle"])


def _fragments(level_rows: DataFrame, level: int, parts: int, fragment_nodes: int) -> DataFrame:
    """The rows in partitions, one for each fragment or for several, with the fragment's number."""
    if not level:
        return level_rows.repartitionByRange(parts, "node").withColumn("fragment", F.spark_partition_id().cast("long"))
    # at most 8 for each part
    crowded = level_rows.where(F.col("parent").isNotNull()).groupBy("parent").count().where(F.col("count") > max(1, fragment_nodes // 8)).select("parent", F.lit(True).alias("crowded"))
    goes = F.pmod(F.xxhash64(F.lit(2 * level), "node"), F.lit(2)) == 1
    stays = F.pmod(F.xxhash64(F.lit(2 * level), "parent"), F.lit(2)) == 0
    joins = F.col("parent").isNotNull() & goes & stays & F.col("crowded").isNull()
    placed = level_rows.join(F.broadcast(crowded), "parent", "left").withColumn("fragment", F.xxhash64(F.lit(2 * level + 1), F.when(joins, F.col("parent")).otherwise(F.col("node"))))
    return placed.drop("crowded").repartition(parts, "fragment")


#: Levels halve at worst every few; far more can't be needed.
MOST_LEVELS = 200


def _solve(level_rows: DataFrame, level: int, fragment_nodes: int) -> DataFrame:
    """``(node, root, depth, cyclic, on_cycle, trail)`` of a level."""
    n = level_rows.count()
    if n <= fragment_nodes:
        local = level_rows.withColumn("fragment", F.lit(0).cast("long")).coalesce(1).mapInArrow(_contract, _LOCAL)
        return local.select("node", "root", "depth", "cyclic", "on_cycle", "trail")
    if level > MOST_LEVELS:
        raise RuntimeError(f"the hierarchy is not contracted after {MOST_LEVELS} levels")
    parts = -(-n // fragment_nodes)
    local = stage(_fragments(level_rows, level, parts, fragment_nodes).mapInArrow(_contract, _LOCAL), f"hierarchy-{level}")
    leaving = local.where(F.col("exit").isNotNull())
    outer = leaving.select(F.col("exit").alias("node")).distinct()
    quotient = stage(
        local.join(outer.hint("merge"), "node").select("node", F.col("exit").alias("parent"), F.col("distance").alias("weight"), "root", "depth", "cyclic", "trail"),
        f"quotient-{level}",
    )
    above = stage(_solve(quotient, level + 1, fragment_nodes), f"solved-{level}")
    unstage(quotient)
    inner = local.where(F.col("exit").isNull())
    known = above.select(F.col("node").alias("exit"), F.col("root").alias("r"), F.col("depth").alias("d"), F.col("cyclic").alias("c"), F.col("trail").alias("t"))
    left, right = salted(leaving, known, "exit", "node", hot_keys(leaving, "exit"))
    lifted = left.join(right.hint("merge"), ["exit", "__salt"])
    straight = lifted.where(~F.col("c")).select(
        "node", F.col("r").alias("root"), (F.col("d") + F.col("distance")).alias("depth"), F.lit(False).alias("cyclic"), F.lit(False).alias("on_cycle"), F.concat("t", "trail").alias("trail")
    )
    # the nodes that reach a cycle over fragments meet in their fragments once more
    looping = lifted.where("c").select("node", "parent", "fragment").join(above.select("node", F.col("on_cycle").alias("looped")).hint("merge"), "node", "left")
    marked = looping.repartition(parts, "fragment").select("node", "parent", F.coalesce("looped", F.lit(False)).alias("on_cycle")).mapInArrow(_mark, "node long, on_cycle boolean")
    loops = marked.select(
        "node", F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(True).alias("cyclic"), "on_cycle", F.lit(None).cast("array<long>").alias("trail")
    )
    return inner.select("node", "root", "depth", "cyclic", "on_cycle", "trail").unionByName(straight).unionByName(loops)


def hierarchy(edges: DataFrame, with_paths: bool = False, fragment_nodes: int = FRAGMENT_NODES) -> DataFrame:
    """``(node, root, depth, state, path)`` for every node of the edges ``(child long, parent long)``.

    state 'tree': depth is 0 at the root and, with ``with_paths``, path holds the nodes from the root to
    the node. state 'cycle' on a cycle, a node that is its own parent included, and 'below_cycle' under
    one; both have null root and depth and no path. Rows with a null end don't count, repeated rows
    count once; of several parents of a child the smallest holds. An empty table gives no rows.
    """
    links = edges.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
    links = stage(links, "links")
    roots = links.select(F.col("parent").alias("node")).distinct().join(links.select("node").hint("merge"), "node", "left_anti")
    trail = F.array("node") if with_paths else F.lit(None).cast("array<long>")
    first = links.select("node", "parent", F.lit(1).cast("long").alias("weight"), F.lit(None).cast("long").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("cyclic"), trail.alias("trail"))
    tops = roots.select("node", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("weight"), F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("cyclic"), trail.alias("trail"))
    solved = _solve(stage(first.unionByName(tops), "forest"), 0, fragment_nodes)
    state = F.when(F.col("on_cycle"), "cycle").when(F.col("cyclic"), "below_cycle").otherwise("tree")
    return solved.select("node", "root", "depth", state.alias("state"), F.when(state == "tree", F.col("trail")).alias("path"))


def descendants(solved: DataFrame) -> DataFrame:
    """``(node, descendant, distance)`` of all proper descendants in trees, from rows with paths."""
    places = solved.where("state = 'tree'").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return places.where(F.col("at") < F.col("depth")).select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
