"""The document contract as diagnostics: a row for each field of an object that breaks it.

A collection is gone through once; its failing fields are exploded. Fields of a collection that the database was loaded without are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model_db import ModelDb

#: The contract. Kinds are id, text (not empty), date, time, share (0 to 1), a tuple of allowed values, or list (not empty); ``?`` marks an optional field.
STATUS = ("unreviewed", "confirmed", "corrected", "rejected")
CONTRACT: dict[str, tuple[str, dict[str, tuple[str, object]]]] = {
    "dataset": ("id", {"id": ("id", "id"), "name": ("name", "text"), "created_at": ("createdAt", "time"), "updated_at": ("updatedAt", "time"), "default_model_id": ("defaultModelId?", "id")}),
    "models": ("id", {"id": ("id", "id"), "name": ("name", "text"), "primary_entity_id": ("primaryEntityId", "id"), "base_currency": ("baseCurrency", "currency"), "as_of": ("asOf", "date"), "current_version_id": ("currentVersionId", "id"), "version_ids": ("versionIds", "list"), "default_scenario_id": ("defaultScenarioId?", "id")}),
    "entities": ("id", {"id": ("id", "id"), "type": ("type", ("company", "segment", "product", "geography", "other")), "name": ("name", "text"), "parent_entity_id": ("parentEntityId?", "id")}),
    "metrics": ("id", {"id": ("id", "id"), "name": ("name", "text"), "data_type": ("dataType", ("number", "percentage", "currency", "count", "boolean", "text")), "aggregation": ("aggregation?", ("sum", "average", "last", "none"))}),
    "periods": ("id", {"id": ("id", "id"), "label": ("label", "text"), "type": ("type", ("fiscal_quarter", "fiscal_year", "calendar_quarter", "calendar_year", "date", "other")), "start_date": ("startDate?", "date"), "end_date": ("endDate?", "date"), "parent_period_id": ("parentPeriodId?", "id")}),
    "scenarios": ("id", {"id": ("id", "id"), "name": ("name", "text"), "type": ("type", ("actual", "base", "bull", "bear", "custom"))}),
    "observations": ("id", {"id": ("id", "id"), "model_id": ("modelId", "id"), "metric_id": ("metricId", "id"), "entity_id": ("entityId", "id"), "as_of": ("asOf", "date"), "version_id": ("versionId", "id"), "period_id": ("periodId", "id"), "scenario_id": ("scenarioId?", "id"), "actuality": ("actuality", ("actual", "estimate")), "value_type": ("valueType", ("reported", "assumption", "derived", "external_estimate")), "transformation_id": ("transformationId?", "id")}),
    "transformations": ("id", {"id": ("id", "id"), "output_metric_id": ("outputMetricId", "id"), "status": ("status", ("supported", "opaque", "unresolved"))}),
    "relationships": ("id", {"id": ("id", "id"), "from_id": ("fromId", "id"), "to_id": ("toId", "id"), "type": ("type", ("component_of", "driven_by", "affects", "supports", "contradicts", "supersedes", "related_to"))}),
    "source_artifacts": ("id", {"id": ("id", "id"), "title": ("title", "text"), "type": ("type", ("workbook", "filing", "news", "transcript", "voice_memo", "document", "other"))}),
    "provenance_contexts": ("id", {"id": ("id", "id"), "source_artifact_id": ("sourceArtifactId", "id"), "extraction_run_id": ("extractionRunId", "id"), "confidence": ("confidence", "share"), "review_status": ("reviewStatus", STATUS)}),
    "provenance_records": ("target_id", {"target_id": ("targetId", "id"), "context_id": ("contextId", "id"), "confidence": ("confidence?", "share"), "review_status": ("reviewStatus?", STATUS)}),
    "extraction_runs": ("id", {"id": ("id", "id"), "source_artifact_ids": ("sourceArtifactIds", "list"), "extractor": ("extractor", "text"), "model_version_id": ("modelVersionId", "id"), "status": ("status", ("running", "completed", "completed_with_issues", "failed"))}),
    "evidence": ("id", {"id": ("id", "id"), "source_artifact_id": ("sourceArtifactId", "id"), "observed_at": ("observedAt?", "time")}),
    "assumptions": ("id", {"id": ("id", "id"), "model_id": ("modelId", "id"), "statement": ("statement", "text"), "confidence": ("confidence?", "share"), "status": ("status", ("active", "superseded", "invalidated", "unresolved"))}),
    "decisions": ("id", {"id": ("id", "id"), "model_id": ("modelId", "id"), "created_at": ("createdAt", "time")}),
    "decision_changes": ("id", {"id": ("id", "id"), "decision_id": ("decisionId", "id"), "metric_id": ("metricId", "id"), "period_id": ("periodId", "id")}),
    "unresolved_items": ("id", {"id": ("id", "id"), "category": ("category", ("metric_mapping", "formula", "hierarchy", "lineage", "actuality_boundary", "presentation", "source_error", "source_update", "model_inconsistency", "other")), "description": ("description", "text"), "current_treatment": ("currentTreatment", "text"), "impact": ("impact", "text"), "next_action": ("nextAction", "text"), "attention_level": ("attentionLevel", ("needs_review", "action_required")), "action_owner": ("actionOwner?", ("extraction_agent", "model_owner", "source_owner")), "status": ("status", ("open", "resolved", "dismissed"))}),
}
ID = "^[a-z][a-z0-9]*(_[a-z0-9]+)*$"
TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$"


def fits(column: str, kind: object) -> Column:
    """Whether a value that is there is of the kind."""
    c = F.col(column)
    if isinstance(kind, tuple):
        return c.isin(*kind)
    return {
        "id": lambda: c.rlike(ID) & (F.length(c) >= 3),
        "text": lambda: c != "",
        "currency": lambda: F.length(c) == 3,
        "date": lambda: c.cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(),
        "time": lambda: c.rlike(TIME) & c.try_cast("timestamp").isNotNull(),
        "share": lambda: (c >= 0) & (c <= 1),
        "list": lambda: F.size(c) > 0,
    }[kind]()


def contract(db: ModelDb) -> DataFrame:
    """(code, object_id, field) of each field that is missing, of another form or not among the allowed values.

    Values must be finite numbers, texts, booleans or null, supported transformations have an expression, and open or closed, an item that needs action has an owner.
    """
    out = None
    for name, (key, fields) in CONTRACT.items():
        df = db.frames.get(name)
        if df is None:
            continue
        failures = []
        for column, (field, kind) in fields.items():
            if column in df.columns:
                bad = F.coalesce(~fits(column, kind), F.lit(not field.endswith("?")))
                failures.append(F.when(bad, F.lit(field.rstrip("?"))))
        if name == "observations":
            failures.append(F.when((F.col("kind") == "number") & ~F.coalesce(~F.isnan("num") & (F.abs("num") != float("inf")), F.lit(False)), F.lit("value")))
        if name == "transformations":
            failures.append(F.when((F.col("status") == "supported") & (F.coalesce("expression", F.lit("")) == ""), F.lit("expression")))
        if name == "unresolved_items":
            failures.append(F.when((F.col("attention_level") == "action_required") & F.col("action_owner").isNull(), F.lit("actionOwner")))
        part = df.select(F.coalesce(F.col(key), F.lit("dataset")).alias("object_id"), F.explode(F.array_compact(F.array(*failures))).alias("field"))
        out = part if out is None else out.unionByName(part)
    return out.select(F.lit("schema.invalid").alias("code"), "object_id", "field")
