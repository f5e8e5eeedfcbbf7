"""Small relational operators over model records: dedup, histograms, positional zips, searches over logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.hold import numbered


def unique_lookup(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) of the keys that have exactly one distinct value; two bounded aggregates, no collected set."""
    found = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_high"))
    return found.filter(F.col(value) == F.col("_high")).drop("_high")


def dedup_transformations(cells: DataFrame) -> DataFrame:
    """(id, output_metric_id, expression, n_periods, conflict, sources) of (output_metric_id, status, expression, period_id, formula) rows.

    Equal formulas of a metric are one transformation, named by a digest of its key. sources: its source formula by period; the least,
    where a period has two, which is a conflict (``checked_transformations`` refuses it).
    """
    digest = F.substring(F.sha2(F.concat_ws("\0", "output_metric_id", "status", "expression"), 256), 1, 8)
    by_period = cells.groupBy("output_metric_id", "status", "expression", "period_id").agg((F.min("formula") != F.max("formula")).alias("c"), F.min("formula").alias("formula"))
    # as many entries as periods
    sources = F.map_from_entries(F.array_sort(F.collect_list(F.struct("period_id", "formula"))))
    whole = by_period.groupBy("output_metric_id", "status", "expression").agg(F.count(F.lit(1)).alias("n_periods"), F.max("c").alias("conflict"), sources.alias("sources"))
    return whole.select(F.concat(F.lit("transformation_"), digest).alias("id"), "output_metric_id", "expression", "n_periods", "conflict", "sources")


def checked_transformations(cells: DataFrame) -> DataFrame:
    """``dedup_transformations`` without the flag: a period with two source formulas for one transformation is an error, raised when the rows are read."""
    found = dedup_transformations(cells)
    wrong = F.raise_error(F.concat(F.lit("two source formulas for one period: "), "id")).cast("string")
    return found.withColumn("id", F.when(F.col("conflict"), wrong).otherwise(F.col("id"))).drop("conflict")


def context_ids(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct contexts numbered by first sight, without gaps: (keys, first, number). Ties are broken by the keys."""
    first = records.groupBy(*keys).agg(F.min(order).alias("first"))
    return numbered(first, ["first", *keys]).withColumn("number", F.col("number").cast("int"))


def distinct_records(records: DataFrame, order: str, *, without: tuple[str, ...] = ()) -> DataFrame:
    """Records that differ in any column but ``order`` and ``without``, the first of each, numbered by first sight (``record``).

    Rows are compared by their canonical JSON: columns in the order of their names, nulls left out.
    """
    columns = sorted(c for c in records.columns if c != order and c not in without)
    text = F.to_json(F.struct(*columns))
    first = records.groupBy(text.alias("_json")).agg(F.min_by(F.struct(*records.columns), order).alias("_row"))
    return numbered(first.select("_row.*", "_json"), [order, "_json"], "record").drop("_json")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): style uses, statuses, roles by kind and the like; most common first where it is shown in order."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def grouped_counts(df: DataFrame, role: str, kind: str) -> DataFrame:
    """(role, kind, n) for each pair and, with a null kind, for each role: two levels of one aggregation."""
    named = df.select(F.coalesce(F.col(role), F.lit("none")).alias("role"), F.coalesce(F.col(kind), F.lit("none")).alias("kind"))
    return named.groupingSets([["role", "kind"], ["role"]], "role", "kind").agg(F.count(F.lit(1)).alias("n"))


def blockers(cells: DataFrame) -> DataFrame:
    """(output_metric_id, reason, n, n_inputs, first_inputs): what keeps formulas of a metric opaque; n_inputs counts distinct unresolved references.

    cells: (output_metric_id, reason, input). The twelve smallest references are listed, as a report shows them.
    """
    by_input = cells.groupBy("output_metric_id", "reason", "input").agg(F.count(F.lit(1)).alias("n"))
    ranked = by_input.withColumn("_n", F.row_number().over(Window.partitionBy("output_metric_id", "reason").orderBy(F.col("input").asc_nulls_last())))
    listed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_n") <= 12, F.col("input")))), ",")
    return ranked.groupBy("output_metric_id", "reason").agg(F.sum("n").alias("n"), F.count("input").alias("n_inputs"), listed.alias("first_inputs"))


def in_several(items: DataFrame, group: str, item: str) -> DataFrame:
    """(item, n): items that more than one group has."""
    return items.select(group, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_covered(wanted: DataFrame, have: DataFrame, column: str) -> DataFrame:
    """Distinct values that are wanted and not there: sections without a presentation, sheets missing from a workbook, unmapped comments."""
    return wanted.select(column).filter(F.col(column).isNotNull()).distinct().join(have.select(column).distinct(), column, "left_anti")


def match_tasks(tasks: DataFrame, opaque: DataFrame) -> DataFrame:
    """(transformation_id, period_id, issue): opaque formulas without a task, tasks without an opaque formula, and tasks given twice."""
    keys = ["transformation_id", "period_id"]
    given = tasks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_tasks"))
    j = given.join(opaque.select(*keys, F.lit(True).alias("_opaque")).distinct(), keys, "full")
    issue = F.when(F.col("_tasks").isNull(), "missing_task").when(F.col("_opaque").isNull(), "unknown_task").when(F.col("_tasks") > 1, "repeated_task")
    return j.select(*keys, issue.alias("issue")).filter("issue is not null")


def function_histogram(formulas: DataFrame, column: str) -> DataFrame:
    """(name, n): how often each function is called."""
    names = F.explode(F.regexp_extract_all(F.upper(column), F.lit(r"([A-Z][A-Z0-9.]*)\("), F.lit(1)))
    return formulas.select(names.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def sum_if(criteria: DataFrame, values: DataFrame, wanted: str, average: bool = False) -> DataFrame:
    """(group, total): sum (or average) of the values whose criterion at the same position equals ``wanted``.

    criteria: (group, position, criteria, wanted), values: (group, position, value); positions count from the start of each range. A
    criterion equals if both read as the same number, or else as the same text whatever the case. An average of nothing is null.
    """
    c, w = F.col("criteria").try_cast("double"), F.col(wanted).try_cast("double")
    same = F.when(c.isNotNull() & w.isNotNull(), c == w).otherwise(F.lower("criteria") == F.lower(F.col(wanted)))
    rows = criteria.join(values, ["group", "position"])
    picked = F.when(same, F.col("value"))
    total = F.avg(picked) if average else F.coalesce(F.sum(picked), F.lit(0))
    return rows.groupBy("group").agg(total.alias("total"))


Stacks = tuple[list, object, list]


def history_step(state: Stacks, action: str, value: object, cap: int) -> Stacks:
    """(past, present, future) after one action: commits beyond ``cap`` forget the oldest, and an equal commit changes nothing."""
    past, present, future = state
    if action == "commit" and value != present:
        return [*past, present][-cap:], value, []
    if action == "undo" and past:
        return past[:-1], past[-1], [present, *future]
    if action == "redo" and future:
        return [*past, present], future[0], future[1:]
    if action == "reset":
        return [], 0, []
    return state


def _folded(log: DataFrame, step: Callable[[object, str, object], object], start: object, result: Callable[[object], list], schema: str) -> DataFrame:
    """One row for each user: a fold over the log in (ts, event_id) order.

    Spark deals the log by user and sorts it; a task goes through a user's events in batches, so a long log is never held.
    """
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = start
        for rows in batches:
            for action, value in zip(rows["action"], rows["value"], strict=True):
                state = step(state, action, value)
        yield pd.DataFrame([[key[0], *result(state)]], columns=names)

    ordered = log.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").select("user_id", "ts", "event_id", "action", "value")
    return ordered.groupBy("user_id").applyInPandas(fold, schema)


def history(log: DataFrame, cap: int = 20) -> DataFrame:
    """(user_id, present, n_past, n_future) of (user_id, ts, event_id, action, value) rows: undo and redo of each user's edits."""
    return _folded(log, lambda s, a, v: history_step(s, a, v, cap), ([], 0, []), lambda s: [s[1], len(s[0]), len(s[2])], "user_id long, present long, n_past int, n_future int")


def navigation_step(state: tuple[list, object], action: str, target: object, cap: int) -> tuple[list, object]:
    """(history, target) after one action: inspecting another target remembers the one before, if there was one."""
    past, now = state
    if action == "inspect":
        return ([*past, now][-cap:] if now is not None and now != target else past), target
    if action == "replace":
        return [], target
    if action == "back" and past:
        return past[:-1], past[-1]
    if action == "close":
        return [], None
    return state


def navigation(log: DataFrame, cap: int = 24) -> DataFrame:
    """(user_id, target, n_history) of (user_id, ts, event_id, action, value) rows: where each viewer is, and how far back it can go."""
    return _folded(log, lambda s, a, v: navigation_step(s, a, v, cap), ([], None), lambda s: [s[1], len(s[0])], "user_id long, target long, n_history int")


def edit_actions(events: DataFrame) -> DataFrame:
    """The driver's events as an edit log."""
    action = F.when(F.col("event_type").isin("purchase", "click"), "commit").when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "redo").otherwise("reset")
    return events.select("user_id", "ts", "event_id", action.alias("action"), F.col("event_id").alias("value"))


def viewer_actions(events: DataFrame) -> DataFrame:
    """The driver's events as a navigation log."""
    action = F.when(F.col("event_type").isin("purchase", "click", "view"), "inspect").when(F.col("event_type") == "error", "back").when(F.col("event_id") % 5 == 0, "close").otherwise("replace")
    return events.select("user_id", "ts", "event_id", action.alias("action"), (F.col("event_id") % 3).alias("value"))


def shift_formulas(df: DataFrame, formula: str, rows: str, columns: str, out: str) -> DataFrame:
    """``df`` with relative A1 references of a formula moved by (columns, rows).

    Each distinct formula and shift is moved once: cells of a shared formula are many, their shifts few.
    """
    from ..sources.xlsx import shift_formula

    keys = [formula, rows, columns]
    distinct = df.select(F.col(formula).alias("_f"), F.col(rows).alias("_r"), F.col(columns).alias("_c")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_out=[shift_formula(f, int(r), int(c)) for f, r, c in zip(pdf["_f"], pdf["_r"], pdf["_c"], strict=True)])

    moved = distinct.mapInPandas(run, ", ".join([*(f"{c} {distinct.schema[c].dataType.simpleString()}" for c in distinct.columns), "_out string"]))
    same = [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, ("_f", "_r", "_c"), strict=True)]
    return df.join(moved, same, "left").select(*df.columns, F.col("_out").alias(out))
