"""Diagnostics of a model database: each rule is one query, and the validator is their union.

A diagnostic is (code, object_id, field). References are anti-joins, duplicates a window that names the later row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions
from ..plans.hold import hold as held
from ..plans.model_db import CONTEXT, ModelDb, period_key, value_matches
from .contract import contract
from .graphs import formula_strata, shortest_cycles, small_cycles, strong_components
from .hierarchy import parent_cycles, parent_issues
from .lineage import transformation_refs

#: References up to which a graph of metrics is looked through on the driver.
SMALL = 10_000


def _found(df: DataFrame, code: str, field: str, object_id: str | Column = "id") -> DataFrame:
    return df.select(F.lit(code).alias("code"), (F.col(object_id) if isinstance(object_id, str) else object_id).alias("object_id"), F.lit(field).alias("field"))


def _repeated(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n > 1")


#: Collections whose ids are canonical objects, in the order in which ids are declared.
CANONICAL = ["models", "entities", "metrics", "periods", "scenarios", "observations", "transformations", "relationships", "source_artifacts", "provenance_contexts", "evidence", "assumptions", "decisions", "decision_changes", "extraction_runs", "unresolved_items"]
#: Collections whose objects need provenance.
TRACED = ["observations", "models", "entities", "metrics", "periods", "scenarios", "transformations", "relationships", "evidence", "assumptions", "decisions", "decision_changes", "unresolved_items"]
#: References: collection, the column that names the object, and (column, where it must be found, field) of each.
REFERENCES = [
    ("dataset", "id", [("default_model_id", ["models"], "defaultModelId")]),
    ("models", "id", [("primary_entity_id", ["entities"], "primaryEntityId"), ("default_scenario_id", ["scenarios"], "defaultScenarioId")]),
    ("entities", "id", [("parent_entity_id", ["entities"], "parentEntityId")]),
    ("periods", "id", [("parent_period_id", ["periods"], "parentPeriodId")]),
    ("observations", "id", [("model_id", ["models"], "modelId"), ("metric_id", ["metrics"], "metricId"), ("entity_id", ["entities"], "entityId"), ("period_id", ["periods"], "periodId"), ("scenario_id", ["scenarios"], "scenarioId"), ("transformation_id", ["transformations"], "transformationId")]),
    ("transformations", "id", [("output_metric_id", ["metrics"], "outputMetricId")]),
    ("transformation_sources", "transformation_id", [("period_id", ["periods"], "sourceExpressions.*")]),
    ("presentations", "model_id", [("model_id", ["models"], "modelId"), ("source_artifact_id", ["source_artifacts"], "sourceArtifactId")]),
    ("presentation_metrics", "section_id", [("metric_id", ["metrics"], "metricIds")]),
    ("relationships", "id", [("from_id", CANONICAL, "fromId"), ("to_id", CANONICAL, "toId")]),
    ("extraction_runs", "id", [("source_artifact_ids", ["source_artifacts"], "sourceArtifactIds"), ("model_version_id", ["model_versions"], "modelVersionId")]),
    ("provenance_contexts", "id", [("source_artifact_id", ["source_artifacts"], "sourceArtifactId"), ("extraction_run_id", ["extraction_runs"], "extractionRunId")]),
    ("provenance_records", "target_id", [("target_id", TRACED, "targetId"), ("context_id", ["provenance_contexts"], "contextId")]),
    ("evidence", "id", [("source_artifact_id", ["source_artifacts"], "sourceArtifactId")]),
    ("assumptions", "id", [("model_id", ["models"], "modelId"), ("entity_id", ["entities"], "entityId"), ("scenario_id", ["scenarios"], "scenarioId"), ("effective_period_ids", ["periods"], "effectivePeriodIds")]),
    ("decisions", "id", [("model_id", ["models"], "modelId"), ("rationale_artifact_id", ["source_artifacts"], "rationaleArtifactId")]),
    ("decision_changes", "id", [("decision_id", ["decisions"], "decisionId"), ("observation_id", ["observations"], "observationId"), ("metric_id", ["metrics"], "metricId"), ("period_id", ["periods"], "periodId"), ("scenario_id", ["scenarios"], "scenarioId")]),
    ("unresolved_items", "id", [("model_id", ["models"], "modelId"), ("target_id", CANONICAL, "targetId"), ("affected_target_ids", CANONICAL, "affectedTargetIds"), ("source_artifact_id", ["source_artifacts"], "sourceArtifactId")]),
]


def _ids(db: ModelDb, collections: list[str]) -> DataFrame | None:
    parts = [db.frames[c].select(F.col("version_id" if c == "model_versions" else "id").alias("_id")) for c in collections if c in db.frames]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return None if out is None else out.distinct()


def references(db: ModelDb) -> DataFrame:
    """References to what does not exist, and formulas' references to metrics and periods.

    A collection is gone through once: its references are joined with the ids of their targets, and the failures of a row
    are exploded. Elements of a list are checked by position; a field that ends with ``*`` names the value itself. A site is
    skipped where a database lacks either collection.
    """
    out = None
    for name, key, sites in REFERENCES:
        df = db.frames.get(name)
        if df is None:
            continue
        failures, lists = [], []
        base = df
        for i, (column, targets, field) in enumerate(sites):
            ids = _ids(db, targets)
            if column not in df.columns or ids is None:
                continue
            if df.schema[column].dataType.typeName() == "array":
                items = df.select(F.col(key).alias("object_id"), F.posexplode(column).alias("_pos", "_id"))
                lists.append(items.join(ids, "_id", "left_anti").select("object_id", F.concat(F.lit(f"{field}."), "_pos").alias("field")))
            else:
                base = base.join(ids.withColumnRenamed("_id", f"_id{i}"), F.col(column) == F.col(f"_id{i}"), "left")
                named = F.concat(F.lit(field[:-1]), column) if field.endswith("*") else F.lit(field)
                failures.append(F.when(F.col(column).isNotNull() & F.col(f"_id{i}").isNull(), named))
        parts = lists + ([base.select(F.col(key).alias("object_id"), F.explode(F.array_compact(F.array(*failures))).alias("field"))] if failures else [])
        for part in parts:
            out = part if out is None else out.unionByName(part)
    if {"transformations", "metrics", "periods"} <= db.frames.keys():
        refs = transformation_refs(db)
        metrics, periods = _ids(db, ["metrics"]), _ids(db, ["periods"])
        gone = refs.join(metrics, F.col("metric_id") == F.col("_id"), "left_anti").select(F.col("transformation_id").alias("object_id"), F.concat(F.lit("expression.dependencies."), "dependency").alias("field")).distinct()
        late = refs.filter("target_period is not null").join(periods, F.col("target_period") == F.col("_id"), "left_anti").select(F.col("transformation_id").alias("object_id"), F.lit("expression.periodId").alias("field"))
        out = gone.unionByName(late) if out is None else out.unionByName(gone).unionByName(late)
    return out.select(F.lit("reference.missing").alias("code"), "object_id", "field")


def observation_version(db: ModelDb) -> DataFrame:
    versions = db.model_versions.select("model_id", "version_id")
    return _found(db.observations.join(versions, ["model_id", "version_id"], "left_anti"), "observation.version", "versionId")


def observation_value_type(db: ModelDb) -> DataFrame:
    j = db.observations.join(db.metrics.select(F.col("id").alias("metric_id"), "data_type"), "metric_id")
    return _found(j.filter(~F.coalesce(value_matches(F.col("data_type"), F.col("kind"), F.col("num")), F.lit(False))), "observation.value_type", "value")


def observation_transformation(db: ModelDb) -> DataFrame:
    return _found(db.observations.filter("value_type = 'derived' and transformation_id is null"), "observation.transformation", "transformationId")


def series_duplicate(db: ModelDb) -> DataFrame:
    """A context that is declared as two series."""
    return _found(_repeated(db.series, CONTEXT, "series_ord"), "observation_series.duplicate", "observationSeries", F.concat_ws("/", *CONTEXT))


def duplicate_point(db: ModelDb) -> DataFrame:
    obs = db.observations.withColumn("_scenario", F.coalesce("scenario_id", F.lit("none")))
    return _found(_repeated(obs, [*CONTEXT, "period_id", "_scenario"]), "observation.duplicate_point", "points")


def id_duplicate(db: ModelDb) -> DataFrame:
    """Ids that an object declared earlier has, in any canonical collection."""
    union = None
    for k, name in enumerate(CANONICAL):
        df = db.frames.get(name)
        if df is not None and "id" in df.columns:
            part = df.select("id", F.lit(k).alias("rank"), (F.col("ord") if "ord" in df.columns else F.lit(0)).cast("long").alias("ord"))
            union = part if union is None else union.unionByName(part)
    w = Window.partitionBy("id").orderBy("rank", "ord")
    return _found(union.withColumn("_n", F.row_number().over(w)).filter("_n > 1"), "id.duplicate", "id")


def transformation_duplicate(db: ModelDb) -> DataFrame:
    return _found(_repeated(db.transformations, ["output_metric_id", "status", "expression"]), "transformation.duplicate", "expression")


def transformation_unused(db: ModelDb) -> DataFrame:
    used = db.observations.select(F.col("transformation_id").alias("id")).filter("id is not null").distinct()
    return _found(db.transformations.join(used, "id", "left_anti"), "transformation.unused", "id")


def transformation_output_metric(db: ModelDb) -> DataFrame:
    outs = db.transformations.select(F.col("id").alias("transformation_id"), "output_metric_id")
    return _found(db.observations.join(outs, "transformation_id").filter("metric_id <> output_metric_id"), "transformation.output_metric", "transformationId")


def transformation_source_expression(db: ModelDb) -> DataFrame:
    return _found(db.transformation_sources.filter("not ltrim(formula) like '=%'"), "transformation.source_expression", "sourceExpressions", "transformation_id")


def transformation_source_period(db: ModelDb) -> DataFrame:
    """Linked observations whose period has no source formula."""
    sources = db.transformation_sources.select("transformation_id", "period_id")
    return _found(db.observations.filter("transformation_id is not null").join(sources, ["transformation_id", "period_id"], "left_anti"), "transformation.source_period", "periodId")


def transformation_source_without_output(db: ModelDb) -> DataFrame:
    linked = db.observations.select("transformation_id", "period_id").filter("transformation_id is not null").distinct()
    return _found(db.transformation_sources.join(linked, ["transformation_id", "period_id"], "left_anti"), "transformation.source_without_output", "sourceExpressions", F.concat_ws("/", "transformation_id", "period_id"))


def transformation_expression(db: ModelDb) -> DataFrame:
    """One diagnostic for each issue of a supported expression (distinct expressions are analysed on the driver)."""
    rows = db.transformations.filter("status = 'supported'").select("id", "expression").collect()
    found = [("transformation.expression", r["id"], "expression") for r in rows for _ in expressions.analyze(r["expression"]).issues]
    return db.transformations.sparkSession.createDataFrame(found, "code string, object_id string, field string")


def component_metric(db: ModelDb) -> DataFrame:
    ends = db.relationships.filter("type = 'component_of'").select("id", F.explode(F.array("from_id", "to_id")).alias("end"))
    return _found(ends.join(db.metrics.select(F.col("id").alias("end")), "end", "left_anti").select("id").distinct(), "relationship.component_metric", "type")


def component_multiple_parents(db: ModelDb) -> DataFrame:
    """Later edges of a metric to another parent than its first; edges between other things than metrics do not count."""
    w = Window.partitionBy("from_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    metrics = lambda c: db.metrics.select(F.col("id").alias(c)).distinct()
    edges = db.relationships.filter("type = 'component_of'").join(metrics("from_id"), "from_id", "left_semi").join(metrics("to_id"), "to_id", "left_semi")
    return _found(edges.withColumn("_first", F.first("to_id").over(w)).filter("to_id <> _first"), "relationship.component_multiple_parents", "fromId")


def artifact_content_hash(db: ModelDb) -> DataFrame:
    return _found(db.source_artifacts.filter(F.col("content_hash").isNotNull() & ~F.col("content_hash").rlike("^[A-Za-z0-9]+:[0-9a-fA-F]+$")), "artifact.content_hash", "contentHash")


def provenance_missing(db: ModelDb) -> DataFrame:
    """Objects of the traced collections without a provenance record."""
    have = db.provenance_records.select(F.col("target_id").alias("_id")).distinct()
    return _found(_ids(db, TRACED).join(have, "_id", "left_anti"), "provenance.missing", "provenanceRecords", "_id")


def provenance_context_duplicate(db: ModelDb) -> DataFrame:
    return _found(_repeated(db.provenance_contexts, ["source_artifact_id", "extraction_run_id", "confidence", "review_status"]), "provenance_context.duplicate", "provenanceContexts")


def provenance_duplicate(db: ModelDb) -> DataFrame:
    return _found(_repeated(db.provenance_records, ["target_id", "context_id", "sheet", "cell"]), "provenance.duplicate", "provenanceRecords", "target_id")


def unresolved_repair_required(db: ModelDb) -> DataFrame:
    return _found(db.unresolved_items.filter("status = 'open' and category in ('source_error', 'source_update', 'model_inconsistency') and attention_level <> 'action_required'"), "unresolved.repair_required", "attentionLevel")


def model_current_version(db: ModelDb) -> DataFrame:
    have = db.model_versions.select(F.col("model_id").alias("id"), F.col("version_id").alias("current_version_id"))
    return _found(db.models.join(have, ["id", "current_version_id"], "left_anti"), "model.current_version", "currentVersionId")


def presentation_metric_missing(db: ModelDb) -> DataFrame:
    """Metrics with data that no presentation of a model that has some shows."""
    seen = db.observations.select("model_id", "metric_id").distinct()
    have = db.presentations.select("model_id").distinct()
    shown = db.presentation_metrics.join(db.presentations.select(F.col("id").alias("presentation_id"), "model_id"), "presentation_id").select("model_id", "metric_id").distinct()
    bad = seen.join(have, "model_id", "left_semi").join(shown, ["model_id", "metric_id"], "left_anti")
    return _found(bad, "presentation.metric_missing", "sections", F.concat_ws("/", "model_id", "metric_id"))


def presentation_duplicate_metric(db: ModelDb) -> DataFrame:
    return _found(_repeated(db.presentation_metrics, ["presentation_id", "metric_id"]), "presentation.duplicate_metric", "metricIds", F.concat_ws("/", "presentation_id", "metric_id"))


def presentation_metric_not_visible(db: ModelDb) -> DataFrame:
    seen = db.observations.select("model_id", "metric_id").distinct()
    shown = db.presentation_metrics.join(db.presentations.select(F.col("id").alias("presentation_id"), "model_id"), "presentation_id").join(db.metrics.select(F.col("id").alias("metric_id")), "metric_id")
    return _found(shown.join(seen, ["model_id", "metric_id"], "left_anti"), "presentation.metric_not_visible", "metricIds", F.concat_ws("/", "presentation_id", "metric_id"))


def presentation_duplicate_id(db: ModelDb) -> DataFrame:
    return _found(_repeated(db.presentations, ["id"]), "presentation.duplicate_id", "id")


def presentation_duplicate_section(db: ModelDb) -> DataFrame:
    """Section ids are global: each section but the first of its id, in whatever presentation it stands."""
    return _found(_repeated(db.sections, ["id"]), "presentation.duplicate_section", "id")


def presentation_parents(db: ModelDb) -> DataFrame:
    """Display parents that are not in the section, or do not stand before their child, and parents of metrics that the section does not have."""
    items = db.presentation_metrics.select(F.concat_ws("/", "presentation_id", "section_id").alias("group"), F.col("ord").alias("pos"), F.col("metric_id").alias("id"), "parent_id")
    named = db.presentation_parents.select(F.concat_ws("/", "presentation_id", "section_id").alias("group"), F.col("metric_id").alias("id"), "parent_id") if "presentation_parents" in db.frames else None
    issues = parent_issues(items, named)
    code = F.when(F.col("issue") == "unknown_parent", "presentation.parent_unknown").when(F.col("issue") == "unknown_child", "presentation.parent_metric_unknown").otherwise("presentation.parent_order")
    return issues.select(code.alias("code"), F.concat_ws("/", "group", "id").alias("object_id"), F.lit("metricParentIds").alias("field"))


def presentation_names(db: ModelDb) -> DataFrame:
    """Where a model has several presentations, each needs an id and a title. Unnamed ones have an id made from their place."""
    several = db.presentations.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("model_id"))).filter("_n > 1")
    no_id = _found(several.filter(F.col("id") == F.concat(F.lit("unnamed_presentation_"), "ord")), "presentation.id_required", "id")
    return no_id.unionByName(_found(several.filter("title is null"), "presentation.title_required", "title"))


def _first_item(items: DataFrame, key: str) -> DataFrame:
    """(key, item_id): the open item declared first for each key."""
    return items.groupBy(key).agg(F.min_by("id", "ord").alias("item_id"))


def bare_models(db: ModelDb) -> DataFrame:
    """(id, item_id): models without a presentation, and the first open presentation item of each, if it has one. An item without a model speaks for none."""
    said = _first_item(db.unresolved_items.filter("status = 'open' and category = 'presentation' and model_id is not null"), "model_id")
    bare = db.models.select("id").join(db.presentations.select(F.col("model_id").alias("id")), "id", "left_anti")
    return bare.join(said.withColumnRenamed("model_id", "id"), "id", "left")


def presentation_missing(db: ModelDb) -> DataFrame:
    """Models without a presentation: a fallback if an open item of theirs says so, else missing."""
    code = F.when(F.col("item_id").isNotNull(), "presentation.fallback").otherwise("presentation.missing")
    return bare_models(db).select(code.alias("code"), F.col("id").alias("object_id"), F.lit("tablePresentations").alias("field"))


def opaque_formulas(db: ModelDb) -> DataFrame:
    """(id, item_id): opaque formulas, and the first open formula action that points at each or at its metric, if there is one.

    Actions are gathered by target first, so a metric of many formulas and items is joined once for each formula.
    """
    actions = db.unresolved_items.filter("status = 'open' and category = 'formula' and attention_level = 'action_required'")
    affected = F.coalesce("affected_target_ids", F.array().cast("array<string>")) if "affected_target_ids" in actions.columns else F.array().cast("array<string>")
    by_target = actions.select("id", "ord", F.explode(F.array_distinct(F.concat(F.array("target_id"), affected))).alias("target")).filter("target is not null")
    first = by_target.groupBy("target").agg(F.min(F.struct("ord", "id")).alias("item"))
    opaque = db.transformations.filter("status = 'opaque'").select("id", F.explode(F.array("id", "output_metric_id")).alias("target"))
    return opaque.join(first, "target", "left").groupBy("id").agg(F.min("item")["id"].alias("item_id"))


def transformation_opaque(db: ModelDb) -> DataFrame:
    """Opaque formulas: a warning if an open formula action names them or their metric, as target or among what is affected, else an error."""
    code = F.when(F.col("item_id").isNotNull(), "transformation.opaque").otherwise("transformation.opaque_action_required")
    return opaque_formulas(db).select(code.alias("code"), F.col("id").alias("object_id"), F.lit("status").alias("field"))


def formula_edges(db: ModelDb, table: DataFrame) -> DataFrame:
    """(model_id, from_metric, from_period, to_metric, to_period): cells and the cells they read, on each model's own axis of periods by type.

    table: (transformation_id, from_metric, to_metric, offset, named).
    """
    seen = db.observations.select("model_id", "period_id").distinct().join(db.periods.select(F.col("id").alias("period_id"), "type", period_key().alias("key")), "period_id")
    axis = seen.withColumn("pos", F.row_number().over(Window.partitionBy("model_id", "type").orderBy("key", "period_id")))
    cells = db.observations.filter("transformation_id is not null").select("model_id", "transformation_id", F.col("period_id").alias("from_period")).distinct().join(table, "transformation_id")
    here = axis.select("model_id", "type", F.col("period_id").alias("from_period"), "pos")
    there = axis.select("model_id", "type", F.col("period_id").alias("moved"), F.col("pos").alias("target"))
    placed = cells.join(here, ["model_id", "from_period"], "left").withColumn("target", F.col("pos") + F.col("offset")).join(there, ["model_id", "type", "target"], "left")
    moved = F.when((F.col("offset") == 0), F.col("from_period")).otherwise(F.col("moved"))
    return placed.select("model_id", "from_metric", "from_period", "to_metric", F.coalesce("named", moved).alias("to_period")).filter("to_period is not null").distinct()


def _read_metrics(db: ModelDb) -> DataFrame:
    """(transformation_id, from_metric, to_metric, offset, named): the references of each supported formula, parsed in tasks."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, metrics, texts = (batch.column(c).to_pylist() for c in ("id", "output_metric_id", "expression"))
            rows = [(name, metric, r.metric_id, r.offset, r.period_id) for name, metric, text in zip(names, metrics, texts, strict=True) for r in expressions.analyze(text or "").references]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["transformation_id", "from_metric", "to_metric", "offset", "named"])

    formulas = db.transformations.filter("status = 'supported' and output_metric_id is not null").select("id", "output_metric_id", "expression")
    return formulas.repartition("id").mapInArrow(parse, "transformation_id string, from_metric string, to_metric string, offset int, named string")


def _metric_cycles(reads: DataFrame, hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(metric_id, path) of the cycles of a graph of metrics; up to ``SMALL`` references it is looked through on the driver, else as tables."""
    edges = hold(reads.select(F.col("from_metric").alias("a"), F.col("to_metric").alias("b")).distinct())
    if edges.count() <= SMALL:
        graph: dict[str, list[str]] = {}
        for r in edges.collect():
            graph.setdefault(r["a"], []).append(r["b"])
        return edges.sparkSession.createDataFrame([(path[0], " -> ".join(path)) for path in small_cycles(graph)], "metric_id string, path string")
    paths = shortest_cycles(edges, strong_components(edges, hold), hold)
    return paths.select(F.col("path")[0].alias("metric_id"), F.array_join("path", " -> ").alias("path"))


def _loose(reads: DataFrame, hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``reads`` among metrics of whose formulas only cells tell what comes first, as ``formula_strata`` has it."""
    if reads.count() <= SMALL:
        graph: dict[str, list[tuple[str, int, bool]]] = {}
        for r in reads.collect():
            graph.setdefault(r["from_metric"], []).append((r["to_metric"], r["offset"], r["named"] is not None))
            graph.setdefault(r["to_metric"], [])
        loose = reads.sparkSession.createDataFrame([(m,) for m, (_, mode, _) in formula_strata(graph).items() if mode == "cells"], "id string")
    else:
        edges = lambda df: df.select(F.col("from_metric").alias("a"), F.col("to_metric").alias("b"))
        found = hold(strong_components(edges(reads), hold))
        of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
        inner = hold(reads.join(of("from_metric"), "from_metric").join(of("to_metric"), "to_metric").filter("of_from_metric = of_to_metric"))
        both = inner.groupBy(F.col("of_from_metric").alias("component")).agg(F.max(F.col("named").isNotNull()).alias("named"), F.countDistinct(F.when(F.col("offset") != 0, F.col("offset") > 0)).alias("signs")).filter("named or signs <> 1").select("component")
        still = strong_components(edges(inner.filter("offset = 0 and named is null")), hold).select("id").join(found, "id").select("component")
        loose = hold(found.join(both.unionByName(still).distinct(), "component", "left_semi").select("id"))
    kept = lambda c: loose.select(F.col("id").alias(c))
    return reads.join(kept("from_metric"), "from_metric", "left_semi").join(kept("to_metric"), "to_metric", "left_semi")


def formula_cycles(db: ModelDb, hold: Callable[[DataFrame], DataFrame] = held) -> DataFrame:
    """(model_id, metric_id, path): a shortest cycle of each strong component of the formulas' cells, as ``metric[period] -> ...``.

    Formulas are parsed in tasks. Those without an output are nodes of their metrics, without periods. Cells are looked at only where metrics refer to
    each other in one period, by named periods or both ways in time; all others are in the order of their periods.
    """
    refs = hold(_read_metrics(db))
    used = db.observations.select("transformation_id").filter("transformation_id is not null").distinct()
    bare = _metric_cycles(refs.join(used, "transformation_id", "left_anti"), hold)
    out = bare.select(F.lit(None).cast("string").alias("model_id"), "metric_id", "path")
    table = hold(_loose(hold(refs.join(used, "transformation_id", "left_semi")), hold))
    if table.isEmpty():
        return out
    cell = lambda a: F.struct("model_id", F.col(f"{a}_metric").alias("metric_id"), F.col(f"{a}_period").alias("period_id"))
    edges = hold(formula_edges(db, table).select(cell("from").alias("a"), cell("to").alias("b")))
    paths = shortest_cycles(edges, strong_components(edges, hold), hold)
    text = F.array_join(F.transform("path", lambda c: F.concat(c["metric_id"], F.lit("["), c["period_id"], F.lit("]"))), " -> ")
    return out.unionByName(paths.select(F.col("path")[0]["model_id"].alias("model_id"), F.col("path")[0]["metric_id"].alias("metric_id"), text.alias("path")))


def transformation_cycle(db: ModelDb) -> DataFrame:
    """One diagnostic for each cycle of formulas, at the metric where its path begins."""
    return _found(formula_cycles(db), "transformation.cycle", "expression", "metric_id")


def component_cycle(db: ModelDb) -> DataFrame:
    parents = db.relationships.filter("type = 'component_of'").groupBy(F.col("from_id").alias("id")).agg(F.min_by("to_id", "ord").alias("parent_id"))
    return _found(parent_cycles(parents), "relationship.component_cycle", "relationships", "cycle")


def decision_change_value_type(db: ModelDb) -> DataFrame:
    return _found(db.decision_changes.filter("before_kind <> after_kind"), "decision_change.value_type", "before/after")


def extraction_run_open_attention(db: ModelDb) -> DataFrame:
    """Runs reported as completed while an open item is traced to them: by the item's own provenance, not by that of its target."""
    traced = db.unresolved_items.filter("status = 'open'").select(F.col("id").alias("target_id"))
    runs = db.provenance_records.join(traced, "target_id", "left_semi").join(db.provenance_contexts.select(F.col("id").alias("context_id"), "extraction_run_id"), "context_id").select(F.col("extraction_run_id").alias("id")).distinct()
    return _found(db.extraction_runs.filter("status = 'completed'").join(runs, "id", "left_semi"), "extraction_run.open_attention", "status")


def open_items(db: ModelDb) -> DataFrame:
    """A warning for each open item but those that ``bare_models`` and ``opaque_formulas`` name: these rules report them."""
    said = bare_models(db).select("item_id").unionByName(opaque_formulas(db).select("item_id")).filter("item_id is not null").select(F.col("item_id").alias("id")).distinct()
    rest = db.unresolved_items.filter("status = 'open'").join(said, "id", "left_anti")
    return rest.select(F.concat(F.lit("unresolved."), "attention_level").alias("code"), F.col("id").alias("object_id"), F.lit("status").alias("field"))


#: Each rule with the collections it needs.
RULES: list[tuple[Callable[[ModelDb], DataFrame], set[str]]] = [
    (contract, {"observations"}),
    (references, {"observations", "metrics", "models", "entities", "periods", "transformations"}),
    (observation_version, {"observations", "model_versions"}),
    (observation_value_type, {"observations", "metrics"}),
    (observation_transformation, {"observations"}),
    (series_duplicate, {"series"}),
    (duplicate_point, {"observations"}),
    (id_duplicate, {"observations", "metrics"}),
    (model_current_version, {"models", "model_versions"}),
    (transformation_duplicate, {"transformations"}),
    (transformation_unused, {"observations", "transformations"}),
    (transformation_output_metric, {"observations", "transformations"}),
    (transformation_source_expression, {"transformation_sources"}),
    (transformation_source_period, {"observations", "transformation_sources"}),
    (transformation_source_without_output, {"observations", "transformation_sources"}),
    (transformation_expression, {"transformations"}),
    (component_metric, {"relationships", "metrics"}),
    (component_multiple_parents, {"relationships"}),
    (artifact_content_hash, {"source_artifacts"}),
    (provenance_missing, {"observations", "provenance_records"}),
    (provenance_context_duplicate, {"provenance_contexts"}),
    (provenance_duplicate, {"provenance_records"}),
    (presentation_metric_missing, {"observations", "presentations", "presentation_metrics"}),
    (presentation_duplicate_metric, {"presentation_metrics"}),
    (presentation_metric_not_visible, {"observations", "presentations", "presentation_metrics", "metrics"}),
    (unresolved_repair_required, {"unresolved_items"}),
    (presentation_duplicate_id, {"presentations"}),
    (presentation_duplicate_section, {"sections"}),
    (presentation_parents, {"sections"}),
    (presentation_names, {"sections"}),
    (presentation_missing, {"sections", "models", "unresolved_items"}),
    (transformation_opaque, {"sections", "transformations", "unresolved_items"}),
    (transformation_cycle, {"observations", "transformations", "periods"}),
    (component_cycle, {"relationships"}),
    (decision_change_value_type, {"decision_changes"}),
    (extraction_run_open_attention, {"extraction_runs", "unresolved_items", "provenance_records", "provenance_contexts"}),
    (open_items, {"sections", "models", "transformations", "unresolved_items"}),
]


def validate(db: ModelDb) -> DataFrame:
    """All diagnostics of the rules whose collections the database has."""
    out = None
    for rule, needs in RULES:
        if needs <= set(db.frames):
            out = rule(db) if out is None else out.unionByName(rule(db))
    return out
