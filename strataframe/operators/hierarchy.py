"""Parent-child links to full hierarchies, by deterministic splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions.ids import known
from strataframe.functions.latest import checkpointed

#: One node in so many is a splitter, chosen by hash.
SPLIT = 8
#: Parts of finished rows that a round reads at most.
PARTS = 5


def tree_nodes(rows: DataFrame, tree: str, node: str, parent: str, by: str = "recorded_at") -> DataFrame:
    """One row per node: tree, node, parent (null for a root).

    Blanks around ids don't count. A parent given in one row holds for all rows of the node; of several the
    latest recorded counts, then the greatest. A root has no known parent or one without a row in the tree.
    Rows without a node are no nodes; a null tree is a tree of its own named ``''``.
    """
    own = rows.select(
        F.coalesce(known(F.col(tree)), F.lit("")).alias("tree"), known(F.col(node)).alias("node"), known(F.col(parent)).alias("parent"), F.col(by).alias("at")
    ).where("node is not null")
    nodes = own.groupBy("tree", "node").agg(
        F.max(F.when(F.col("parent").isNotNull(), F.struct("at", "parent"))).alias("_p")
    ).select("tree", "node", F.col("_p.parent").alias("parent"))
    present = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    return nodes.join(present, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_there"), F.col("parent")).alias("parent"))


def _most_active(state: DataFrame) -> tuple[int, int]:
    """Unfinished rows, and the most of them in one tree."""
    per_tree = state.where("not done").groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    row = per_tree.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    return row["all"] or 0, row["most"] or 0


def _walk(state: DataFrame, paths: bool) -> DataFrame:
    """Follows every pointer until it ends at a row that is done at the start, doubling the stride each round.

    ``state``: tree, node, ptr, dist, done, stop (a walk ends at this node), seg (nodes passed, the last is ptr).
    A walk that is unfinished after r rounds is longer than 2^r; an acyclic one then has passed more than
    2^(r-1) nodes that were unfinished a round before. Once no tree has that many, what is left is cyclic.
    """
    state = checkpointed(state)
    span, (left, most) = 1, _most_active(state)
    bound = None
    ended, active, parts = state.where("done"), state.where("not done"), 1
    while left and (bound is None or most_before > bound):
        # Rows that are done stay where they were written, and are put together every ``PARTS`` rounds; only the others are moved and written again.
        target = ended.unionByName(active).select(
            "tree", F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"),
            *([F.col("seg").alias("seg2")] if paths else []),
        )
        moved = checkpointed(active.join(target, ["tree", "ptr"]).select(
            "tree", "node", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), "stop",
            *([F.concat("seg", "seg2").alias("seg")] if paths else []),
        ))
        most_before, bound = most, span
        ended, active, parts = ended.unionByName(moved.where("done")), moved.where("not done"), parts + 1
        if parts == PARTS:
            ended, parts = checkpointed(ended.repartition("tree", "node")), 1
        span *= 2
        left, most = _most_active(moved)
    return ended.unionByName(active)


def resolve(nodes: DataFrame, paths: bool = False, split: int = SPLIT) -> DataFrame:
    """Per node of ``nodes`` (see tree_nodes): tree, node, root, depth and, with ``paths``, path (array, root first).

    Depth 0 at the root; root ``''``, depth -1 and a null path for nodes on a cycle or below one; a node that is
    its own parent is a cycle. No rows for an empty input.

    Splitters are the roots and one node in ``split`` by hash. Every node walks to its next splitter, the much
    smaller graph of splitters is solved the same way, and a node's answer is its own walk and its splitter's.
    Walks that meet no splitter are short cycles, or hang below one, and are answered apart. Each round is an
    equi-join on (tree, node) and is checkpointed; no tree is ever gathered in a task.
    """
    chosen: Column = F.pmod(F.xxhash64("tree", "node"), F.lit(split)) == 0
    base = checkpointed(nodes.select("tree", "node", "parent", (F.col("parent").isNull() | chosen).alias("stop"), F.col("parent").isNull().alias("is_root")))
    stops = base.where("stop").select("tree", F.col("node").alias("parent"), F.lit(True).alias("_at_stop"))
    seg = [F.array("ptr").alias("seg")] if paths else []
    first = (
        base.where("parent is not null").join(stops, ["tree", "parent"], "left")
        .select("tree", "node", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("dist"), F.coalesce("_at_stop", F.lit(False)).alias("done"), "stop")
        .select("*", *seg)
    )
    walked = _walk(first, paths)
    roots = base.where("is_root").select("tree", F.col("node"))
    # The reduced graph: one pointer per splitter, to its next splitter.
    ends = roots.select("tree", F.col("node").alias("ptr"), F.lit(True).alias("_at_root"))
    reduced = walked.where("done and stop").drop("done").join(ends, ["tree", "ptr"], "left").select(
        "tree", "node", "ptr", "dist", F.coalesce("_at_root", F.lit(False)).alias("done"), "stop", *(["seg"] if paths else [])
    )
    solved = _walk(reduced, paths).where("done")
    of_root = roots.select(
        "tree", F.col("node").alias("splitter"), F.col("node").alias("root"), F.lit(0).cast("bigint").alias("far"), *([F.array().cast("array<string>").alias("on")] if paths else [])
    )
    answers = of_root.unionByName(
        solved.select("tree", F.col("node").alias("splitter"), F.col("ptr").alias("root"), F.col("dist").alias("far"), *([F.col("seg").alias("on")] if paths else []))
    )
    walks = walked.where("done").select(
        "tree", "node", F.col("ptr").alias("splitter"), "dist", *(["seg"] if paths else [])
    ).unionByName(roots.select("tree", "node", F.col("node").alias("splitter"), F.lit(0).cast("bigint").alias("dist"), *([F.array().cast("array<string>").alias("seg")] if paths else [])))
    path = [F.when(F.col("root").isNotNull(), F.reverse(F.concat(F.array("node"), "seg", "on"))).alias("path")] if paths else []
    hit = walks.join(answers, ["tree", "splitter"], "left").select(
        "tree", "node", F.coalesce("root", F.lit("")).alias("root"), F.when(F.col("root").isNull(), -1).otherwise(F.col("dist") + F.col("far")).cast("int").alias("depth"), *path
    )
    missed = walked.where("not done").select(
        "tree", "node", F.lit("").alias("root"), F.lit(-1).alias("depth"), *([F.lit(None).cast("array<string>").alias("path")] if paths else [])
    )
    return hit.unionByName(missed)


def descendants(resolved: DataFrame) -> DataFrame:
    """Every (ancestor, descendant, distance) of trees resolved with paths; a node isn't its own descendant."""
    return resolved.where("depth > 0").select(
        "tree", F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor")
    ).select("tree", "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def with_descendant_counts(resolved: DataFrame) -> DataFrame:
    """``resolved`` with the number of descendants of each node (0 on cycles), combined before the shuffle."""
    counts = descendants(resolved).groupBy("tree", F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    return resolved.join(counts, ["tree", "node"], "left").withColumn("n_descendants", F.coalesce("n_descendants", F.lit(0)))
