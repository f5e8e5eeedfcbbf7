"""Forests of metrics: hierarchy, ordered depth, and cycles of single-parent maps."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cell_row
from ..plans.hold import hold as held
from ..plans.model_db import ModelDb

Hold = Callable[[DataFrame], DataFrame]


def forest(edges: DataFrame, nodes: DataFrame, hold: Hold = held) -> DataFrame:
    """(id, parent_id, root_id, depth, path) of each node that a root reaches; edges: (id, parent_id), nodes: (id[, rank, weight]).

    Parents outside ``nodes`` do not count. depth adds up the weights (default 1) of the ancestors; path has the ranks from the root
    down, so ordering by it puts each node before its children and siblings by rank. One join for each level; a node
    that is met again below itself is an error.
    """
    nodes = nodes.select("id", *(F.col(c) if c in nodes.columns else F.lit(d).alias(c) for c, d in (("rank", 0), ("weight", 1))))
    inner = hold(edges.join(nodes.select("id", "rank", "weight"), "id").join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id", "parent_id", "rank", "weight"))
    none = F.lit(None).cast(nodes.schema["id"].dataType)
    level = hold(nodes.join(inner, "id", "left_anti").select("id", none.alias("parent_id"), F.col("id").alias("root_id"), F.lit(0).alias("depth"), F.array("rank").alias("path"), F.array("id").alias("_seen"), F.col("weight").alias("_weight")))
    out = level
    while True:
        up = level.select(F.col("id").alias("parent_id"), "root_id", F.col("depth").alias("_depth"), F.col("path").alias("_path"), "_seen", F.col("_weight").alias("_up"))
        again = F.when(F.array_contains("_seen", F.col("id")), F.raise_error(F.concat(F.lit("a cycle at "), F.col("id").cast("string"))).cast("int")).otherwise(F.col("_depth") + F.col("_up"))
        level = hold(inner.join(up, "parent_id").select("id", "parent_id", "root_id", again.alias("depth"), F.concat("_path", F.array("rank")).alias("path"), F.concat("_seen", F.array("id")).alias("_seen"), F.col("weight").alias("_weight")))
        if level.isEmpty():
            return out.drop("_seen", "_weight")
        out = out.unionByName(level)


def metric_ranks(db: ModelDb) -> DataFrame:
    """(metric_id, rank): metrics by their first source place (sheet, then row, those with a row first), then by name.

    The order is that of metrics, a small table, so one window over all of them is bounded by their number.
    """
    first = db.provenance_records.filter("sheet is not null or cell is not null").groupBy(F.col("target_id").alias("id")).agg(F.min_by(F.struct("sheet", "cell"), "ord").alias("p"))
    place = db.metrics.join(first, "id", "left").select(F.col("id").alias("metric_id"), "name", "ord", F.coalesce("p.sheet", F.lit("")).alias("_sheet"), cell_row(F.col("p.cell")).alias("_row"))
    w = Window.orderBy(F.collate("_sheet", "UNICODE"), F.col("_row").asc_nulls_last(), F.collate("name", "UNICODE"), "ord")
    return place.select("metric_id", F.row_number().over(w).alias("rank"))


def metric_hierarchy(db: ModelDb, model_id: str | None = None, root_metric_id: str | None = None, shown: DataFrame | None = None, hold: Hold = held) -> DataFrame:
    """The ``component_of`` forest among the metrics that each model has data of: (model_id, metric_id, parent_id, depth, path).

    With a root metric only what hangs below it, its depth 0. Siblings are in the order of their source places. ``shown`` (model_id,
    metric_id): metrics that have a row; others do not indent what hangs below them.
    """
    seen = db.observations.select("model_id", "metric_id").distinct()
    if model_id is not None:
        seen = seen.filter(F.col("model_id") == model_id)
    seen = hold(seen.join(metric_ranks(db), "metric_id") if "provenance_records" in db.frames else seen.join(db.metrics.select(F.col("id").alias("metric_id"), F.col("ord").alias("rank")), "metric_id"))
    key = F.struct("model_id", "metric_id")
    nodes = seen.withColumn("id", key)
    if shown is not None:
        nodes = nodes.join(shown.select("model_id", "metric_id", F.lit(1).alias("weight")).distinct(), ["model_id", "metric_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    parents = db.relationships.filter("type = 'component_of'").select(F.col("from_id").alias("metric_id"), F.col("to_id").alias("to_id"))
    edges = seen.join(parents, "metric_id").select(key.alias("id"), F.struct("model_id", F.col("to_id").alias("metric_id")).alias("parent_id"))
    if root_metric_id is not None:
        edges = edges.filter(F.col("id.metric_id") != root_metric_id)
    found = forest(edges, nodes, hold)
    if root_metric_id is not None:
        found = found.filter(F.col("root_id.metric_id") == root_metric_id)
    return found.select("id.model_id", "id.metric_id", F.col("parent_id.metric_id").alias("parent_id"), "depth", "path")


def ordered_depths(items: DataFrame, hold: Hold = held) -> DataFrame:
    """(group, id, depth): depth below the parent if it stands earlier in the group, else 0. items: (group, pos, id, parent_id).

    Pointer doubling: each round doubles the ancestors that are counted, so a deep list needs few joins.
    """
    at = items.select("group", F.col("id").alias("parent_id"), F.col("pos").alias("parent_pos"))
    now = items.join(at, ["group", "parent_id"], "left").select("group", "id", F.when(F.col("parent_pos") < F.col("pos"), F.col("parent_id")).alias("up"), F.when(F.col("parent_pos") < F.col("pos"), 1).otherwise(0).alias("depth"))
    now = hold(now)
    while not now.filter("up is not null").isEmpty():
        above = now.select("group", F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        now = hold(now.join(above, ["group", "up"], "left").select("group", "id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return now.select("group", "id", "depth")


def parent_cycles(parents: DataFrame, hold: Hold = held) -> DataFrame:
    """(cycle, size): smallest member and size of each cycle of a single-parent map (id, parent_id).

    After ``n`` steps along parents every survivor stands on a cycle; steps are doubled, so it takes log2(n) joins.
    """
    n = max(2, parents.count())
    now = parents.filter("parent_id is not null").select("id", F.col("parent_id").alias("to"), F.least("id", "parent_id").alias("low"))
    for _ in range(math.ceil(math.log2(n)) + 1):
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        now = hold(now.join(ahead, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
    on = now.select(F.col("to").alias("id")).distinct()
    return now.join(on, "id", "left_semi").groupBy(F.col("low").alias("cycle")).agg(F.count(F.lit(1)).alias("size"))


def parent_issues(items: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """(group, id, issue): unknown_child, unknown_parent, and parent_order where the parent does not stand earlier.

    items: (group, pos, id[, parent_id]). ``parents`` (group, id, parent_id) may name children that no item is.
    """
    named = (items if parents is None else parents).select("group", "id", "parent_id").distinct()
    at = lambda c: items.groupBy("group", F.col("id").alias(c)).agg(F.max("pos").alias(f"_{c}"))
    j = named.filter("parent_id is not null").join(at("id"), ["group", "id"], "left").join(at("parent_id"), ["group", "parent_id"], "left")
    gone = F.when(F.col("_id").isNull(), "unknown_child")
    late = F.when(F.col("_parent_id").isNull(), "unknown_parent").when(F.col("_parent_id") >= F.col("_id"), "parent_order")
    return j.select("group", "id", F.explode(F.array_compact(F.array(gone, late))).alias("issue"))


def consecutive_ranges(df: DataFrame, group: str, number: str) -> DataFrame:
    """(group, first, last): runs of consecutive numbers."""
    w = Window.partitionBy(group).orderBy(number)
    runs = df.select(group, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w))
    return runs.groupBy(group, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")
