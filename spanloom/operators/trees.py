"""Tree walks by pointer doubling.

Every row points at its parent; one round of self-join replaces the pointer by
the pointer of the row it points at, so depth ``d`` needs about ``log2(d)``
rounds and a chain of ten thousand needs fourteen.  A recursive CTE would need
one round per level and is limited to shallow trees.  The walks of all slices or
tracks ask for sort-merge joins: their columns compress so well that the planner
would collect millions of rows for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.session import cut_lineage

#: Doubling rounds between two looks at what is left, and between two checkpoints of descendant sums.  The walks
#: write every round: a round reads the one before it two or three times, so three in one plan read the nodes
#: up to 27 times.  They look for rounds that resolve nothing only here, since with repeated ids the number of
#: rounds shows in the rows.
ROUNDS_PER_CUT = 3


def nearest_ancestor(
    nodes: DataFrame,
    *,
    is_stop: Column,
    carry: dict[str, tuple[str, Column]] | None = None,
    node: str = "id",
    parent: str = "parent_id",
) -> DataFrame:
    """For each node the nearest ancestor (or itself) where ``is_stop`` holds.

    Returns ``node, ancestor_id, <carry>`` for the nodes that reach a stop.
    ``carry`` combines a value over the path from the node up to, and without,
    the stop: ``{"name": ("min" | "max", column)}``.  A pointer to a missing row
    and a cycle reach no stop.
    """
    carry = carry or {}
    pick = {"min": F.least, "max": F.greatest}  # both skip nulls
    names = list(carry)
    base = nodes.select(
        F.col(node).alias("_id"),
        F.when(is_stop, F.col(node)).otherwise(F.col(parent)).alias("_ptr"),
        F.coalesce(is_stop, F.lit(False)).alias("_done"),
        *[F.when(~F.coalesce(is_stop, F.lit(False)), value).alias(n) for n, (_, value) in carry.items()],
    ).filter(F.col("_ptr").isNotNull())
    state = cut_lineage(base)
    finished, active = state.filter("_done"), state.filter("NOT _done")
    left, before = active.count(), None
    # every round resolves the next deeper nodes, so a round that resolves none
    # has only cycles left
    while left and left != before:
        before = left
        for _ in range(ROUNDS_PER_CUT):
            ahead = state.select(
                F.col("_id").alias("_ptr"),
                F.col("_ptr").alias("_next"),
                F.col("_done").alias("_next_done"),
                *[F.col(n).alias(f"_next_{n}") for n in names],
            )
            # inner join: a pointer that leads nowhere can reach no stop
            stepped = active.join(ahead.hint("merge"), "_ptr").select(
                "_id",
                F.col("_next").alias("_ptr"),
                F.col("_next_done").alias("_done"),
                *[pick[kind](F.col(n), F.col(f"_next_{n}")).alias(n) for n, (kind, _) in carry.items()],
            )
            state = cut_lineage(finished.unionByName(stepped))
            finished, active = state.filter("_done"), state.filter("NOT _done")
            left = active.count()
            if not left:
                break
    return finished.select(F.col("_id").alias(node), F.col("_ptr").alias("ancestor_id"), *names)


def path_totals(
    nodes: DataFrame, totals: dict[str, Column], *, node: str = "id", parent: str = "parent_id"
) -> DataFrame:
    """Maximum of each value over a node and all its ancestors.

    Returns one row per node: ``node, <totals>``.  The walk ends when only rows
    on or below a cycle are left; those keep what they have met so far.
    """
    names = list(totals)
    state = cut_lineage(
        nodes.select(F.col(node).alias("_id"), F.col(parent).alias("_ptr"), *[v.alias(n) for n, v in totals.items()])
    )
    left, before = state.filter("_ptr IS NOT NULL").count(), None
    while left and left != before:
        before = left
        for _ in range(ROUNDS_PER_CUT):
            ahead = state.select(
                F.col("_id").alias("_ptr"), F.col("_ptr").alias("_next"), *[F.col(n).alias(f"_next_{n}") for n in names]
            )
            climbed = state.filter("_ptr IS NOT NULL").join(ahead.hint("merge"), "_ptr", "left")
            state = state.filter("_ptr IS NULL").unionByName(
                climbed.select(
                    "_id", F.col("_next").alias("_ptr"), *[F.greatest(n, f"_next_{n}").alias(n) for n in names]
                )
            )
            state = cut_lineage(state)
            left = state.filter("_ptr IS NOT NULL").count()
            if not left:
                break
    return state.select(F.col("_id").alias(node), *names)


def roots(nodes: DataFrame, *, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """``node, root``: the parentless ancestor; nodes on or below a cycle, or
    below a missing parent, are their own root."""
    found = nearest_ancestor(nodes, is_stop=F.col(parent).isNull(), node=node, parent=parent)
    return nodes.select(node).join(found, node, "left").select(node, F.coalesce("ancestor_id", node).alias("root"))


def expand_edges(edges: DataFrame, seeds: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """All nodes reached from each seed: ``seed, id, depth`` (shortest depth).

    ``edges`` has ``parent_id, id``; ``seeds`` has ``seed``.  A node reached
    before is not expanded again, so cycles end.
    """
    edges = cut_lineage(edges.select("parent_id", "id").distinct())
    reached = cut_lineage(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("depth")).distinct())
    frontier, depth = reached, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (
            frontier.select("seed", F.col("id").alias("parent_id"))
            .join(edges, "parent_id")
            .select("seed", "id")
            .distinct()
            .join(reached.select("seed", "id"), ["seed", "id"], "left_anti")
        )
        frontier = cut_lineage(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def descendant_totals(nodes: DataFrame, totals: dict[str, Column], *, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Sum of each value over a node and all that lies below it: ``node, <totals>``, one row per node.

    Every node has one parent at most; a pointer to a missing row is none.  The
    nodes of a cycle lie below each other, so each gets the sum of the cycle and
    of all that hangs on it.  Sums travel by doubling: what a node has gathered
    from below up to a distance of 2^t goes to its ancestor at that distance, so a
    chain or a ring of ``n`` nodes takes ``log2(n)`` rounds of ``n`` rows.
    """
    names = list(totals)
    rows = nodes.select(F.col(node).alias("_id"), F.col(parent).alias("_ptr"), *[F.coalesce(v, F.lit(0)).cast("bigint").alias(n) for n, v in totals.items()])
    known = rows.select(F.col("_id").alias("_ptr"), F.lit(True).alias("_known"))
    rows = cut_lineage(rows.join(known, "_ptr", "left").withColumn("_ptr", F.expr("if(_known, _ptr, null)")).select("_id", "_ptr", *names))

    # cycles are where pointers that never end come to lie: the set only shrinks, and when it stays it is closed
    ptr = rows.select("_id", "_ptr").filter("_ptr is not null")
    left, before = ptr.select("_ptr").distinct().count(), None
    while left and left != before:
        for _ in range(ROUNDS_PER_CUT):
            ptr = ptr.join(ptr.select(F.col("_id").alias("_ptr"), F.col("_ptr").alias("_next")), "_ptr").select("_id", F.col("_next").alias("_ptr"))
        ptr = cut_lineage(ptr)
        left, before = ptr.select("_ptr").distinct().count(), left
    on_cycle = cut_lineage(ptr.select(F.col("_ptr").alias("_id")).distinct().withColumn("_cycle", F.lit(True)))

    state = cut_lineage(rows.join(on_cycle, "_id", "left").withColumn("_ptr", F.expr("if(_cycle, null, _ptr)")).drop("_cycle"))
    while state.filter("_ptr is not null").limit(1).count():
        for _ in range(ROUNDS_PER_CUT):
            given = state.filter("_ptr is not null").groupBy(F.col("_ptr").alias("_id")).agg(*[F.sum(n).alias(f"_more_{n}") for n in names])
            ahead = state.select(F.col("_id").alias("_ptr"), F.col("_ptr").alias("_next"))
            state = state.join(given, "_id", "left").join(ahead, "_ptr", "left").select(
                "_id", F.col("_next").alias("_ptr"), *[(F.col(n) + F.coalesce(f"_more_{n}", F.lit(0))).alias(n) for n in names]
            )
        state = cut_lineage(state)
    if not left:
        return state.select(F.col("_id").alias(node), *names)

    # one label per cycle: the smallest id, by doubling along the ring
    ring = cut_lineage(rows.select("_id", "_ptr").join(on_cycle.select("_id"), "_id", "left_semi").withColumn("_label", F.col("_id")))
    changed = True
    while changed:
        old = ring
        for _ in range(ROUNDS_PER_CUT):
            ahead = ring.select(F.col("_id").alias("_ptr"), F.col("_ptr").alias("_next"), F.col("_label").alias("_seen"))
            ring = ring.join(ahead, "_ptr").select("_id", F.col("_next").alias("_ptr"), F.least("_label", "_seen").alias("_label"))
        ring = cut_lineage(ring)
        changed = ring.join(old.select("_id", F.col("_label").alias("_old")), "_id").filter("_label <> _old").limit(1).count() > 0
    whole = state.join(ring.select("_id", "_label"), "_id").groupBy("_label").agg(*[F.sum(n).alias(f"_all_{n}") for n in names])
    out = state.join(ring.select("_id", "_label").join(whole, "_label"), "_id", "left")
    return out.select(F.col("_id").alias(node), *[F.coalesce(f"_all_{n}", n).alias(n) for n in names])
