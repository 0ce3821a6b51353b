"""Session ancestry: parent edges, roots and enrichment of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.storage import freeze, freeze_counted


def parent_edges(metadata: DataFrame, headers: DataFrame) -> DataFrame:
    """One parent per session; a parent from a log header overrides one from metadata."""
    ranked = metadata.select("session_id", "parent_session_id", F.lit(0).alias("rank"), F.lit("").alias("path"))
    ranked = ranked.unionByName(
        headers.select("session_id", "parent_session_id", F.lit(1).alias("rank"), "path")
    ).filter("session_id is not null and parent_session_id is not null")
    return ranked.groupBy("session_id").agg(
        F.max_by("parent_session_id", F.struct("rank", "path")).alias("parent_session_id")
    )


def resolve_roots(edges: DataFrame) -> DataFrame:
    """Root of every session that has a parent; null when its ancestry has a cycle.

    Each round doubles how far a pointer reaches, so a chain of depth d takes
    about log2(d) rounds.  When a round settles nothing, only cycles are left:
    a session of finite depth always has ancestors of every smaller depth.
    """
    live = edges.filter("parent_session_id <> ''").select(
        F.col("session_id").alias("node"), F.col("parent_session_id").alias("pointer")
    )
    inner = live.select(F.col("node").alias("pointer"), F.lit(True).alias("_has_parent"))
    start = live.join(inner, "pointer", "left").select(
        "node", "pointer", F.col("_has_parent").isNull().alias("done")
    )
    moving = freeze(start, "roots")
    settled = moving.filter("done")
    moving = moving.filter("not done")
    while not moving.isEmpty():
        targets = settled.unionByName(moving).select(
            F.col("node").alias("pointer"),
            F.col("pointer").alias("next_pointer"),
            F.col("done").alias("next_done"),
        )
        step = freeze(
            moving.drop("done")
            .join(targets, "pointer")
            .select("node", F.col("next_pointer").alias("pointer"), F.col("next_done").alias("done")),
            "roots",
        )
        reached = step.filter("done")
        moving = step.filter("not done")
        if reached.isEmpty():
            break
        settled = settled.unionByName(reached)
    return settled.select(
        F.col("node").alias("session_id"), F.col("pointer").alias("root_session_id")
    ).unionByName(
        moving.select(
            F.col("node").alias("session_id"), F.lit(None).cast("string").alias("root_session_id")
        )
    )


def ancestor_tables(edges: DataFrame) -> list[DataFrame]:
    """Binary lifting: table k holds (node, above) with the ancestor 2 ** k steps up, where there is one.

    ``edges`` is (node, above), one row per node and without cycles, so about log2(depth) tables.
    """
    tables: list[DataFrame] = []
    step, rows = freeze_counted(edges.select("node", "above"), "ancestors-0")
    while rows:
        tables.append(step)
        further = step.select(F.col("node").alias("above"), F.col("above").alias("_further"))
        step, rows = freeze_counted(
            step.join(further, "above").select("node", F.col("_further").alias("above")), f"ancestors-{len(tables)}"
        )
    return tables


def with_depth(nodes: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(node, depth): steps from each node to its root, by the longest jumps first."""
    walked = nodes.select("node").distinct().select("node", F.col("node").alias("at"), F.lit(0).cast("bigint").alias("depth"))
    for k in reversed(range(len(tables))):
        up = tables[k].select(F.col("node").alias("at"), F.col("above").alias("_up"))
        walked = walked.join(up, "at", "left").select(
            "node", F.coalesce("_up", "at").alias("at"),
            (F.col("depth") + F.when(F.col("_up").isNotNull(), F.lit(1 << k)).otherwise(F.lit(0))).alias("depth"),
        )
    return walked.select("node", "depth")


def _passes_itself(pairs: DataFrame, edges: DataFrame, finite: DataFrame) -> DataFrame:
    """Pairs whose session is its own parent's ancestor, or the parent itself.

    ``finite`` holds the nodes whose ancestry has an end; the parents of the pairs are
    among them.  The parent's ancestor at the session's depth is found by jumps along
    the bits of the difference in depth.
    """
    graph = edges.filter("parent_session_id <> ''").join(finite, "session_id", "left_semi").select(
        F.col("session_id").alias("node"), F.col("parent_session_id").alias("above")
    )
    tables = ancestor_tables(graph)
    ends = pairs.select(F.col("session_id").alias("node")).unionByName(pairs.select(F.col("parent_session_id").alias("node")))
    depths = freeze(with_depth(ends, tables), "pair-depths")
    jumping = (
        pairs.join(depths.select(F.col("node").alias("session_id"), F.col("depth").alias("_d")), "session_id")
        .join(depths.select(F.col("node").alias("parent_session_id"), F.col("depth").alias("_p")), "parent_session_id")
        .filter("_p >= _d")
        .select("session_id", "parent_session_id", F.col("parent_session_id").alias("at"), (F.col("_p") - F.col("_d")).alias("left"))
    )
    for k, table in enumerate(tables):
        up = table.select(F.col("node").alias("at"), F.col("above").alias("_up"))
        jump = F.shiftright("left", k).bitwiseAND(F.lit(1)) == 1
        jumping = jumping.join(up, "at", "left").withColumn("at", F.when(jump, F.col("_up")).otherwise(F.col("at"))).drop("_up")
    return jumping.filter("at = session_id").select("session_id", "parent_session_id")


def roots_of_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Root for each distinct (session, own parent): own parent first, then the graph."""
    roots = freeze(resolve_roots(edges), "graph-roots")
    above = roots.select(
        F.col("session_id").alias("_parent"),
        F.col("root_session_id").alias("_parent_root"),
        F.lit(True).alias("_in_graph"),
    )
    graph = edges.select("session_id", F.col("parent_session_id").alias("_graph_parent"))
    own = F.nullif(F.col("parent_session_id"), F.lit(""))
    looked = freeze(
        pairs.withColumn("_parent", own)
        .join(above, "_parent", "left")
        .join(graph, "session_id", "left"),
        "pair-roots",
    )
    unusual = looked.filter(
        "_parent is not null and _in_graph and _parent_root is not null "
        "and not (_graph_parent <=> _parent)"
    ).select("session_id", F.col("_parent").alias("parent_session_id"))
    unusual, rows = freeze_counted(unusual.distinct(), "own-parents")
    finite = roots.filter("root_session_id is not null").select("session_id")
    looping = (_passes_itself(unusual, edges, finite) if rows else unusual).select(
        "session_id", F.col("parent_session_id").alias("_parent"), F.lit(True).alias("_loops")
    )
    own_root = F.when(
        F.col("_parent").isNull(), F.col("session_id")
    ).when(
        F.coalesce("_loops", F.lit(False)) | (F.col("_parent") == F.col("session_id")),
        F.lit(None).cast("string"),
    ).when(F.col("_in_graph"), F.col("_parent_root")).otherwise(F.col("_parent"))
    return looked.join(looping.distinct(), ["session_id", "_parent"], "left").select(
        "session_id", "parent_session_id", own_root.alias("root_session_id")
    )


def _with_roots(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Add ``_root`` to rows that have a session."""
    pairs = rows.select("session_id", "parent_session_id").distinct()
    roots = freeze(roots_of_pairs(pairs, edges), "record-roots").select(
        F.col("session_id").alias("_s"),
        F.col("parent_session_id").alias("_p"),
        F.col("root_session_id").alias("_root"),
    )
    same = (rows["session_id"] == roots["_s"]) & rows["parent_session_id"].eqNullSafe(roots["_p"])
    return rows.join(roots, same, "left")


def enrich(records: DataFrame, metadata: DataFrame, edges: DataFrame) -> DataFrame:
    """Fill title, parent, effort and root from metadata and the parent graph.

    Rows without a session, such as all quota rows, take no part in the joins:
    their null key would meet in one task.
    """
    meta = metadata.select(
        "session_id",
        F.col("title").alias("_title"),
        F.col("parent_session_id").alias("_meta_parent"),
        F.col("reasoning_effort").alias("_effort"),
    )
    graph = edges.select("session_id", F.col("parent_session_id").alias("_graph_parent"))
    title = F.when(F.col("kind") == "session", F.coalesce("title", "_title"))
    filled = (
        records.filter("session_id is not null")
        .join(meta, "session_id", "left")
        .join(graph, "session_id", "left")
        .withColumns(
            {
                "title": title.otherwise(F.col("title")),
                "reasoning_effort": F.coalesce("reasoning_effort", "_effort"),
                "parent_session_id": F.coalesce(
                    "parent_session_id", "_meta_parent", "_graph_parent"
                ),
            }
        )
        .select(*records.columns)
    )
    child = F.col("parent_session_id").isNotNull() & (F.col("relation") == "main")
    unresolved = quality.append(F.col("quality"), "root_unresolved")
    return (
        _with_roots(filled, edges)
        .withColumns(
            {
                "root_session_id": F.col("_root"),
                "quality": F.when(F.col("_root").isNull(), unresolved).otherwise(F.col("quality")),
                "relation": F.when(child, F.lit("child")).otherwise(F.col("relation")),
            }
        )
        .select(*records.columns)
        .unionByName(records.filter("session_id is null"))
    )


def repair_roots(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """Resolve the root of every stored row again with the complete parent graph."""
    return (
        _with_roots(stored.filter("session_id is not null"), edges)
        .withColumn("root_session_id", F.col("_root"))
        .select(*stored.columns)
        .unionByName(stored.filter("session_id is null"))
    )
