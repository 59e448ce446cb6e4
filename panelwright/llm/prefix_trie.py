"""The trie of conversation prefixes, with totals over subtrees by centroid decomposition.

A node is a distinct sequence of first turns. Two 64-bit hashes of (position, turn) are joined by XOR along a
conversation, so a prefix has its name after one running total, and equal prefixes meet in one aggregate.

Totals over subtrees are rolled up on the forest of parent edges. Each component gives up its centroid: the
lowest node whose subtree holds half of the component's turns or more. What hangs below it becomes components
of their own, whose totals, summed together with the centroid's values, are added to the nodes on the path from the
centroid to the component's top. A component halves in every round, so a chain of any length takes as many
rounds as its logarithm, and a node is added to no more often than that. Rounds are joins and aggregates of
all components at once; components of up to ``local_nodes`` nodes are finished side by side inside tasks, by the
same steps in numpy.

No conversation, node or component is gathered: turns are put in order by range, so that one long conversation
lies in many tasks, whose running totals are joined by a small table; ids that end in a node are hashed
as a stream of pieces in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.store import Workspace
from panelwright.session import ship_package, tasks_for

BORROWED = 6
CENTURY = 100
LOCAL_NODES = 4096
PIECE = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt_turns(ws: Workspace, df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(conv, ``len``) for each rebuilt conversation, and its turns as (conv, part, d from 1, len, two hashes, chars).

    Within a conversation, ``part`` rises with ``d``; a conversation has one part for each task that holds
    some of it, and part -1 for the turns it has borrowed.
    """
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    turns = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    ordered = ws.table(
        turns.withColumn("head", F.substring("text", 1, 32))
        .repartitionByRange(parts, "conv", "turn", "role", "head")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .select(
            "conv", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("turn"), "text", "role").alias("h2"),
            F.length("text").cast("long").alias("chars"),
            F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part"),
        )
    )
    sizes = ws.table(ordered.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("size")))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first conversation of a task can have begun before it.
    begun = ws.table(sizes.withColumn("before", F.sum("size").over(earlier)).where("before IS NOT NULL").drop("size"))
    nth = F.row_number().over(Window.partitionBy("conv", "part").orderBy("place")) - 1
    placed = ws.table(
        ordered.withColumn("nth", nth).join(begun, ["conv", "part"], "left")
        .select("conv", "part", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("pos"), "h1", "h2", "chars")
    )

    own = sizes.groupBy("conv").agg(F.sum("size").alias("n"))
    own = ws.table(own.withColumn("h", F.crc32(F.col("conv").cast("string")) % BORROWED).withColumn("base", F.col("conv") - F.col("conv") % CENTURY))
    lent = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = ws.table(
        own.join(own.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
        .select("conv", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    )
    kept = placed.join(convs, "conv").where("pos >= h")
    kept = kept.select("conv", "part", (F.col("pos") - F.col("h") + F.col("lent") + 1).alias("d"), "len", "h1", "h2", "chars")
    first = placed.where(F.col("pos") < BORROWED).select(F.col("conv").alias("base"), "pos", "h1", "h2", "chars")
    borrowed = convs.join(first, "base").where("pos < h")
    borrowed = borrowed.select("conv", F.lit(-1).alias("part"), (F.col("pos") + 1).alias("d"), "len", "h1", "h2", "chars")
    return convs.select("conv", "len"), ws.table(kept.union(borrowed))


def named_prefixes(ws: Workspace, turns: DataFrame) -> DataFrame:
    """Each rebuilt turn with the name (k1, k2) of the prefix that it ends, and (q1, q2) of the one before."""
    turns = turns.withColumn("g1", F.xxhash64("d", "h1", "h2")).withColumn("g2", F.xxhash64("h2", F.lit("place"), "d", "h1"))
    totals = turns.groupBy("conv", "part").agg(F.bit_xor("g1").alias("g1"), F.bit_xor("g2").alias("g2"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ws.table(totals.select("conv", "part", *(F.bit_xor(g).over(earlier).alias(c) for g, c in (("g1", "c1"), ("g2", "c2")))).where("c1 IS NOT NULL"))
    so_far = Window.partitionBy("conv", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = turns.withColumns({"k1": F.bit_xor("g1").over(so_far), "k2": F.bit_xor("g2").over(so_far)}).join(carry, ["conv", "part"], "left")

    def carried(k: str, c: str) -> Column:
        return F.col(k).bitwiseXOR(F.coalesce(c, F.lit(0)))

    rows = rows.withColumns({"k1": carried("k1", "c1"), "k2": carried("k2", "c2")})
    return ws.table(rows.select("conv", "d", "len", "chars", "k1", "k2", F.col("k1").bitwiseXOR(F.col("g1")).alias("q1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("q2")))


def _in_order(comp: np.ndarray, node: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the parent or -1, index of the top, place in depth-first order, size of the subtree)."""
    n = len(node)
    by_node = np.argsort(node)
    at = np.minimum(np.searchsorted(node, parent, sorter=by_node), n - 1)
    up = by_node[at]
    up[(node[up] != parent) | (comp[up] != comp)] = -1
    top = by_node[np.searchsorted(node, comp, sorter=by_node)]
    level = depth - depth[top]
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(1, level.max() + 2))
    levels = np.split(by_level, cuts[:-1])
    size = np.ones(n, np.int64)
    for rows in levels[:0:-1]:
        np.add.at(size, up[rows], size[rows])
    siblings = np.argsort(up, kind="stable")
    ahead = np.cumsum(size[siblings]) - size[siblings]
    opens = np.r_[True, up[siblings][1:] != up[siblings][:-1]]
    offset = np.empty(n, np.int64)
    offset[siblings] = ahead - np.maximum.accumulate(np.where(opens, ahead, 0))
    pre = offset.copy()  # tops have no parent and lie one behind the other
    for rows in levels[1:]:
        pre[rows] += pre[up[rows]] + 1
    return up, top, pre, size


def decompose(comp: np.ndarray, node: np.ndarray, parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of each column of ``values`` over the subtree of each node, for whole components.

    ``comp`` is the top's node; ``weight`` is the whole subtree's and is at least one more than any child's.
    """
    up, top, pre, size = _in_order(comp, node, parent, depth)
    weight, total = weight.copy(), np.zeros_like(values)
    rows = np.arange(len(node))
    while rows.size:
        own = top[rows]
        heavy = rows[2 * weight[rows] >= weight[own]]
        heavy = heavy[np.lexsort((weight[heavy], top[heavy]))]
        heavy = heavy[np.r_[True, top[heavy][1:] != top[heavy][:-1]]]
        centre = np.empty(len(node), np.int64)
        centre[top[heavy]] = heavy
        c = centre[own]
        under = (pre[c] <= pre[rows]) & (pre[rows] < pre[c] + size[c])
        over = (pre[rows] <= pre[c]) & (pre[c] < pre[rows] + size[rows])
        below = np.zeros_like(values)
        np.add.at(below, own[under], values[rows[under]])
        total[rows[over]] += below[own[over]]
        above = over & (rows != c)
        weight[rows[above]] -= weight[c[above]]
        inner = np.flatnonzero(under & (rows != c))
        inner = inner[np.lexsort((pre[rows[inner]], own[inner]))]
        child = up[rows[inner]] == c[inner]
        last = np.maximum.accumulate(np.where(child, np.arange(len(inner)), 0))
        top[rows[inner]] = rows[inner][last]
        rows = rows[rows != c]
    return total


def _finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of whole components, which come one after another, split over batches anywhere."""
    names = ["comp", "node", "parent", "d", "weight", "leaves", "saved", "more_leaves", "more_saved"]
    held: list[np.ndarray] = []

    def done(rows: np.ndarray) -> pa.RecordBatch:
        total = decompose(*rows.T[:5], rows[:, 5:7]) + rows[:, 7:9]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (rows[:, 1], total[:, 0], total[:, 1])], ["node", "all_leaves", "all_saved"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.column_stack([batch.column(c).to_numpy() for c in names]))
        if held[0][0, 0] == held[-1][-1, 0]:
            continue
        rows = np.concatenate(held)
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        held = [rows[cut:]]
        yield done(rows[:cut])
    if held:
        yield done(np.concatenate(held))


def subtree_totals(ws: Workspace, tree: DataFrame, paths: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(node, ``all_leaves``, ``all_saved``) over subtrees of ``tree`` (node, parent, conv, d, weight, leaves, saved).

    ``paths`` (conv, d, node, parent) names the node at each depth of each conversation; a node's ``conv`` is one that
    passes through it. The root is node 0.
    """
    state = tree.select("node", "parent", "conv", "d", "weight", "leaves", "saved", F.lit(0).cast("long").alias("comp"))
    state = state.withColumn("more_leaves", F.lit(0).cast("long")).withColumn("more_saved", F.lit(0).cast("long"))
    columns = state.columns
    small, out = [], []
    while True:
        sizes = state.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.max("weight").alias("total"))
        large = ws.table(sizes.where(F.col("size") > local_nodes).drop("size"))
        if large.isEmpty():
            small.append(state)
            break
        small.append(state.join(large, "comp", "left_anti").select(columns))
        work = state.join(large, "comp")
        centres = ws.table(
            work.where("2 * weight >= total").groupBy("comp")
            .agg(F.min(F.struct("weight", "node", "conv", "d")).alias("c"))
            .select("comp", F.col("c.node").alias("c"), F.col("c.conv").alias("c_conv"), F.col("c.d").alias("c_d"), F.col("c.weight").alias("c_weight"))
        )
        at = paths.select("conv", (F.col("d") - 1).alias("c_d"), F.col("node").alias("branch"), F.col("parent").alias("branch_parent"))
        work = ws.table(
            state.join(centres.drop("c_conv"), "comp").join(at, ["conv", "c_d"], "left")
            .withColumn("under", F.coalesce((F.col("d") > F.col("c_d")) & (F.col("branch_parent") == F.col("c")), F.lit(False)))
            .select(*columns, "c", "c_weight", "under", "branch")
        )
        below = work.where("under OR node = c").groupBy("comp").agg(F.sum("leaves").alias("below_leaves"), F.sum("saved").alias("below_saved"))
        above = centres.join(below, "comp").join(paths.select(F.col("conv").alias("c_conv"), "node", "d"), "c_conv").where("d <= c_d")
        above = above.select("comp", "node", "below_leaves", "below_saved", F.lit(True).alias("over"))
        added = {f"more_{v}": F.col(f"more_{v}") + F.coalesce(f"below_{v}", F.lit(0)) for v in ("leaves", "saved")}
        added["weight"] = F.when(F.col("over"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight"))
        added["comp"] = F.when(F.col("under"), F.col("branch")).otherwise(F.col("comp"))
        work = ws.table(work.join(above, ["comp", "node"], "left").withColumns(added).select(*columns, (F.col("node") == F.col("c")).alias("is_c")))
        out.append(work.where("is_c").select("node", F.col("more_leaves").alias("all_leaves"), F.col("more_saved").alias("all_saved")))
        state = work.where("NOT is_c").select(columns)
    rest = small[0]
    for more in small[1:]:
        rest = rest.union(more)
    rest = rest.repartition(tasks_for(ws.spark), "comp").sortWithinPartitions("comp")
    rest = rest.select("comp", "node", "parent", "d", "weight", "leaves", "saved", "more_leaves", "more_saved")
    totals = rest.mapInArrow(_finished, "node long, all_leaves long, all_saved long")
    for more in out:
        totals = totals.union(more)
    return totals


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv) in order as rows (node, first conv, the ids between commas)."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            part = batch.slice(at, PIECE)
            node, conv = part.column("node").to_numpy(), part.column("conv").to_numpy()
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            texts = list(map(str, conv.tolist()))
            ids = [",".join(texts[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
            yield pa.RecordBatch.from_arrays([pa.array(node[cuts[:-1]]), pa.array(conv[cuts[:-1]]), pa.array(ids)], ["node", "first", "ids"])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node from its pieces in order; only the hash's state is held."""
    now, digest = None, None
    for batch in batches:
        nodes, found = [], []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == now:
                digest.update(b",")
            else:
                if digest:
                    nodes.append(now)
                    found.append(digest.hexdigest())
                now, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.string())], ["node", "ends"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["node", "ends"])


def prefix_trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    local_nodes: int = LOCAL_NODES,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, named by its smallest member and its depth.

    Conversation ids are whole numbers. A conversation's turns are ordered by turn (NULL first), then by role
    and text; repeated rows are turns each. NULL roles and texts are empty. Rows without a conversation are no
    turns. ``c - c % 100`` is cut towards zero for negative ids. An empty table has no nodes, not even a root.
    Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship_package(spark)
    ws = Workspace(spark, "trie")
    convs, turns = rebuilt_turns(ws, df, conv_col, turn_col, role_col, text_col)
    members = named_prefixes(ws, turns)
    nodes = members.groupBy("d", "k1", "k2").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"),
        F.sum(F.col("len") - F.col("d") + 1).alias("weight"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
    )
    nodes = ws.table(nodes.withColumn("node", F.monotonically_increasing_id() + 1))
    top = convs.agg(F.min("conv"), F.count(F.lit(1)), F.sum(F.col("len") + 1)).first()

    def number(value: int | None, name: str) -> Column:
        return F.lit(value).cast("long").alias(name)

    root = spark.range(1 if top[1] else 0).select(
        number(0, "node"), number(-1, "parent"), number(top[0], "conv"), number(None, "parent_conv"), number(0, "d"),
        number(top[1], "n"), number(0, "chars"), number(top[2], "weight"), number(0, "k1"), number(0, "k2"),
    )
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    deep = nodes.where("d > 1").join(above, ["d", "q1", "q2"])
    shallow = nodes.where("d = 1").withColumns({"parent": number(0, "parent"), "parent_conv": number(top[0], "parent_conv")})
    tree = ws.table(root.unionByName(deep.select(root.columns)).unionByName(shallow.select(root.columns)))
    children = tree.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    tree = ws.table(
        tree.join(children, "node", "left").fillna(0, ["n_children"])
        .withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("chars"))
    )
    every = members.select("conv", "d", "len", "k1", "k2").join(tree.select("d", "k1", "k2", "node", "parent"), ["d", "k1", "k2"])
    at_root = convs.select("conv", F.lit(0).cast("long").alias("d"), "len", F.lit(0).cast("long").alias("node"), F.lit(-1).cast("long").alias("parent"))
    paths = ws.table(every.select("conv", "d", "len", "node", "parent").union(at_root))
    totals = subtree_totals(ws, tree, paths, local_nodes)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = paths.where("d = len").select("node", "conv")
    ends = ends.repartitionByRange(parts, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_pieces, "node long, first long, ids string")
    ends = ends.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node long, ends string")
    out = tree.join(totals, "node").join(ends, "node", "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        "n_children", F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )
