"""The operational log and graphs of artifacts and stages: closures, levels, transitions, latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def _steps(edges: DataFrame, parent: str, child: str, direction: str) -> DataFrame:
    """``(__a, __b)``: the steps that a walk may take, as texts; to children (descendants), to parents (ancestors) or both."""
    step = lambda a, b: edges.select(F.col(a).cast("string").alias("__a"), F.col(b).cast("string").alias("__b"))
    ways = {"descendants": [(parent, child)], "ancestors": [(child, parent)], "both": [(parent, child), (child, parent)]}[direction]
    out = step(*ways[0])
    for w in ways[1:]:
        out = out.unionByName(step(*w))
    return out.where("__a is not null and __b is not null").distinct()


def closure(edges: DataFrame, roots: Sequence[object], parent: str, child: str, depth: int | None, direction: str = "descendants") -> DataFrame:
    """``(root, node, distance)`` of all nodes within ``depth`` steps of the given roots, the shortest distance each.

    Level by level: the neighbours of the last level's nodes that no earlier level reached, so a node is
    met once however many paths lead to it, and a cycle ends.  Without ``depth`` the walk ends where nothing new is reached.
    """
    spark = edges.sparkSession
    steps = staged(_steps(edges, parent, child, direction))
    last = spark.createDataFrame([(str(r),) for r in dict.fromkeys(roots)], "root string").select("root", F.col("root").alias("node"), F.lit(0).alias("distance"))
    reached = last = staged(last.distinct())
    distance = 0
    while depth is None or distance < depth:
        distance += 1
        met = last.join(steps, F.col("node") == F.col("__a")).select("root", F.col("__b").alias("node")).distinct()
        old = reached.select(F.col("root").alias("__root"), F.col("node").alias("__node"))
        new = met.join(old, (F.col("root") == F.col("__root")) & (F.col("node") == F.col("__node")), "left_anti")
        last = staged(new.withColumn("distance", F.lit(distance)))
        if last.isEmpty():
            break
        # one table again after a while, so that the plan doesn't grow with the depth
        reached = staged(reached.unionByName(last)) if distance % 10 == 0 else reached.unionByName(last)
    return reached


def lineage(edges: DataFrame, root: object, parent: str, child: str, direction: str = "both", depth: int = 5, max_nodes: int = 200) -> tuple[DataFrame, DataFrame, bool]:
    """The graph around one artifact: ``(node, distance, place)``, the edges between these nodes, and whether ``max_nodes`` cut it.

    Breadth first: neighbours of a level are met in the order of the nodes before them, then by name, and the
    walk stops when a further node would be more than ``max_nodes``, the root included.  The page of a graph is what
    this bounds; :func:`closure` has no bound.
    """
    from pyspark.sql import Window as W

    spark = edges.sparkSession
    steps = staged(_steps(edges, parent, child, direction))
    reached = last = staged(spark.createDataFrame([(str(root), 0, 1)], "node string, distance int, place int"))
    n, truncated = 1, False
    for distance in range(1, depth + 1):
        met = last.join(steps, F.col("node") == F.col("__a")).groupBy(F.col("__b").alias("node")).agg(F.min("place").alias("__by"))
        met = met.join(reached.select(F.col("node").alias("__node")), F.col("node") == F.col("__node"), "left_anti")
        new = met.orderBy("__by", "node").limit(max_nodes - n + 1)
        # max_nodes rows at most
        place = F.row_number().over(W.orderBy("__by", "node")).cast("int") + n
        last = staged(new.select("node", F.lit(distance).alias("distance"), place.alias("place")))
        found = last.count()
        if not found:
            break
        truncated = n + found > max_nodes
        n = min(max_nodes, n + found)
        reached = reached.unionByName(last).where(F.col("place") <= max_nodes)
        if truncated:
            break
    names = reached.select(F.col("node").alias("__n"))
    inside = edges.join(names, F.col(parent).cast("string") == F.col("__n"), "left_semi").join(names, F.col(child).cast("string") == F.col("__n"), "left_semi")
    return reached, inside, truncated


def levels(nodes: DataFrame, edges: DataFrame, node: str, before: str, after: str) -> DataFrame:
    """``(node, level)`` by Kahn's order: 0 for nodes that nothing precedes, else one more than the last before them.

    Each round takes, by anti-joins, the nodes left that no node left precedes, stores them with their level,
    and goes on with the rest; only whether a round found any comes to the driver.  Edges from unknown nodes
    don't count; a cycle, an edge of a node to itself too, raises an error.
    """
    left = staged(nodes.select(node).where(F.col(node).isNotNull()).distinct())
    e = edges.select(F.col(before).alias("__b"), F.col(after).alias("__a")).distinct()
    e = staged(e.join(left, F.col("__b") == F.col(node), "left_semi"))
    done, level = nodes.select(node, F.lit(0).alias("level")).limit(0), 0
    while not left.isEmpty():
        ready = staged(left.join(e.select("__a").distinct(), F.col(node) == F.col("__a"), "left_anti"))
        if ready.isEmpty():
            raise ValueError(f"a cycle among nodes such as {[r[0] for r in left.limit(5).collect()]}")
        done = done.unionByName(ready.withColumn("level", F.lit(level)))
        done = staged(done) if level % 10 == 9 else done
        left = staged(left.join(ready.select(F.col(node).alias("__n")), F.col(node) == F.col("__n"), "left_anti"))
        e = staged(e.join(ready, F.col("__b") == F.col(node), "left_anti"))
        level += 1
    return done


def closes_cycle(edges: DataFrame, parent: str, child: str, new_parent: object, new_child: object) -> bool:
    """Whether an edge from ``new_parent`` to ``new_child`` would make a cycle, however long."""
    if str(new_parent) == str(new_child):
        return True
    return not closure(edges, [new_child], parent, child, None).where(F.col("node") == str(new_parent)).isEmpty()


def bad_transitions(log: DataFrame, key: str, state: str, order: Sequence[str], allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """Consecutive states of a key that the table does not allow."""
    from pyspark.sql import Window as W

    t = log.sparkSession.createDataFrame(list(allowed), "__from string, __to string")
    w = W.partitionBy(key).orderBy(*order)
    steps = log.withColumn("previous", F.lag(state).over(w)).where("previous is not null")
    return steps.join(F.broadcast(t), (F.col("previous") == F.col("__from")) & (F.col(state) == F.col("__to")), "left_anti")


def latest_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in ``order``, by aggregate."""
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__b"))
    return g.select(key, *[F.col("__b")[c].alias(c) for c in rest])


def blocking(gates: DataFrame, waivers: DataFrame, now: str) -> DataFrame:
    """Failed gates whose latest waiver is missing, revoked or past."""
    w = latest_by(waivers, "gate_id", ["created_at"]).where((F.col("status") == "ACTIVE") & (F.col("expires_at") > F.lit(now).cast("timestamp")))
    return gates.where(F.col("status") == "FAILED").join(w.select("gate_id"), "gate_id", "left_anti")


def run_detail(runs: DataFrame, events: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each run with its number of events, its last event and its outputs' ids in order."""
    e = events.groupBy("pipeline_run_id").agg(F.count("*").alias("events"), F.max_by("event_type", F.struct("occurred_at", "id")).alias("last_event"))
    o = outputs.groupBy("pipeline_run_id").agg(F.array_sort(F.collect_list("artifact_id")).alias("outputs"))
    return runs.join(e, runs["id"] == e["pipeline_run_id"], "left").drop("pipeline_run_id").join(o, runs["id"] == o["pipeline_run_id"], "left").drop("pipeline_run_id")
