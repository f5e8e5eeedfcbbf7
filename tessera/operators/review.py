"""Provenance, the attention queue, relationships and navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cell_column, cell_row
from ..plans.model_db import ModelDb, period_key


def provenance(db: ModelDb, strict: bool = True) -> DataFrame:
    """Records with their context: a record's own confidence and review status override the context's.

    A record without its context is an error, or, if not ``strict``, stays with nulls.
    """
    contexts = db.provenance_contexts.select(F.col("id").alias("context_id"), "source_artifact_id", "extraction_run_id", F.col("confidence").alias("_c"), F.col("review_status").alias("_r"), F.lit(True).alias("_found"))
    joined = db.provenance_records.join(contexts, "context_id", "left")
    status = F.coalesce("review_status", "_r")
    if strict:
        status = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no context of provenance of "), "target_id")).cast("string")).otherwise(status)
    return joined.withColumn("confidence", F.coalesce("confidence", "_c")).withColumn("review_status", status).drop("_c", "_r", "_found")


def provenance_sources(db: ModelDb) -> DataFrame:
    """(target_id, source_artifact_id, artifact, extraction_run_id, run_status, sheet, cell, confidence, review_status) of each record.

    A record whose artifact or run does not exist is an error.
    """
    artifacts = db.source_artifacts.select(F.col("id").alias("source_artifact_id"), F.coalesce("title", "id").alias("artifact"))
    runs = db.extraction_runs.select(F.col("id").alias("extraction_run_id"), F.col("status").alias("run_status"))
    joined = provenance(db).join(artifacts, "source_artifact_id", "left").join(runs, "extraction_run_id", "left")
    broken = F.raise_error(F.concat(F.lit("broken provenance of "), "target_id")).cast("string")
    status = F.when(F.col("artifact").isNull() | F.col("run_status").isNull(), broken).otherwise(F.col("review_status"))
    return joined.select("target_id", "source_artifact_id", "artifact", "extraction_run_id", "run_status", "sheet", "cell", "confidence", status.alias("review_status"), "ord")


def observation_detail(db: ModelDb, inputs: DataFrame) -> DataFrame:
    """What an inspector shows of each observation: context labels, inputs with their provenance, dependents, open items, own provenance.

    inputs: ``lineage.resolve_inputs``. Lists are in order: inputs by reference, dependents by metric, period and id, items and
    provenance as declared. Open items are those on the observation or its metric that name its model or none.
    """
    sources = provenance_sources(db)
    records = sources.groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("ord", "artifact", "sheet", "cell", "review_status"))).alias("provenance"))
    given = inputs.filter("in_id is not null").select("out_id", "in_id").distinct().join(records.withColumnRenamed("target_id", "in_id"), "in_id", "left")
    with_records = inputs.select("out_id", "ref", "in_period", "in_id", "num").join(given.select("out_id", "in_id", F.coalesce(F.size("provenance"), F.lit(0)).alias("n")), ["out_id", "in_id"], "left")
    reads = with_records.groupBy(F.col("out_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ref", "in_id", "in_period", "num", F.coalesce("n", F.lit(0)).alias("n_provenance")))).alias("inputs"))
    periods = db.periods.select(F.col("id").alias("period_id"), F.col("label").alias("period_label"), period_key().alias("_key"))
    places = db.observations.select(F.col("id").alias("dependent_id"), "metric_id", "period_id").join(periods.drop("period_label"), "period_id")
    named = inputs.filter("in_id is not null").select(F.col("in_id").alias("id"), F.col("out_id").alias("dependent_id")).distinct().join(places, "dependent_id")
    order = Window.partitionBy("id").orderBy(F.collate("metric_id", "UNICODE"), "_key", F.collate("dependent_id", "UNICODE"))
    used = named.withColumn("n", F.row_number().over(order)).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "dependent_id"))).alias("dependents"))
    # gathered by target and model first: a metric with many items and observations is joined once for each observation
    items = db.unresolved_items.filter("status = 'open' and target_id is not null").groupBy("target_id", F.coalesce("model_id", F.lit("")).alias("_model")).agg(F.collect_set(F.struct(F.col("id").alias("item_id"), F.col("attention_level").alias("level"))).alias("found"))
    keys = db.observations.select("id", F.explode(F.array(F.struct(F.col("id").alias("target_id"), F.col("model_id").alias("_model")), F.struct(F.col("id").alias("target_id"), F.lit("").alias("_model")), F.struct(F.col("metric_id").alias("target_id"), F.col("model_id").alias("_model")), F.struct(F.col("metric_id").alias("target_id"), F.lit("").alias("_model")))).alias("k")).select("id", "k.*")
    opened = keys.join(items, ["target_id", "_model"]).groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("found")))).alias("open_items"))
    names = [(db.metrics, "metric_id", "metric_name"), (db.models, "model_id", "model_name"), (db.entities, "entity_id", "entity_name")]
    out = db.observations.join(periods.drop("_key"), "period_id")
    for frame, key, name in names:
        out = out.join(frame.select(F.col("id").alias(key), F.col("name").alias(name)), key)
    out = out.join(records.withColumnRenamed("target_id", "id"), "id", "left")
    for more in (reads, used, opened):
        out = out.join(more, "id", "left")
    return out.select("id", "model_name", "entity_name", "metric_name", "period_label", "scenario_id", "transformation_id", "kind", "num", "provenance", "inputs", "dependents", "open_items")


def unreviewed_counts(db: ModelDb) -> DataFrame:
    """(model_id, n_unreviewed): records of a model's observations whose inherited status is unreviewed."""
    targets = db.observations.select(F.col("id").alias("target_id"), "model_id")
    return provenance(db).filter("review_status = 'unreviewed'").join(targets, "target_id").groupBy("model_id").agg(F.count(F.lit(1)).alias("n_unreviewed"))


def unique_periods(db: ModelDb, by: str) -> DataFrame:
    """(model_id, sheet, place, period_id) where all provenance of a model's observations in a cell (``by`` = cell) or column of a sheet agrees on one period."""
    place = plain_cell("cell") if by == "cell" else cell_column(F.col("cell"))
    rows = db.provenance_records.filter(cell_column(F.col("cell")).isNotNull()).join(db.observations.select(F.col("id").alias("target_id"), "model_id", "period_id"), "target_id").select("model_id", "sheet", place.alias("place"), "period_id").filter("sheet is not null and place is not null")
    return rows.groupBy("model_id", "sheet", "place").agg(F.min("period_id").alias("period_id"), F.max("period_id").alias("_high")).filter("period_id = _high").drop("_high")


def plain_cell(column: str) -> F.Column:
    return F.upper(F.replace(column, F.lit("$"), F.lit("")))


def attention_queue(db: ModelDb) -> DataFrame:
    """Open items with model, metric, period and place filled in from what they point at.

    (id, attention_level, action_owner, model_id, model_name, metric_id, sheet, cell, row, period_id, label)

    The metric is that of the target (observation, metric or transformation's output); the model the item's own, the observation's, the target
    itself or the model of the metric's first observation; the place the item's own, that of the item's or else of the target's provenance; the
    period the observation's, else the one that the cell, else the column of that place stands for in the model. The label is metric and period,
    else metric, else the target's name, else the model's.
    """
    obs = db.observations.select(F.col("id").alias("target_id"), F.col("model_id").alias("o_model"), F.col("metric_id").alias("o_metric"), F.col("period_id").alias("o_period"))
    place = db.provenance_records.filter("sheet is not null or cell is not null").groupBy("target_id").agg(F.min_by(F.struct("sheet", "cell"), "ord").alias("p"))
    first_model = db.observations.groupBy(F.col("metric_id").alias("f_metric")).agg(F.min_by("model_id", "ord").alias("f_model"))
    metrics = db.metrics.select(F.col("id").alias("m_id"), F.col("name").alias("m_name"))
    models = db.models.select(F.col("id").alias("n_id"), F.col("name").alias("n_name"))
    outs = db.transformations.select(F.col("id").alias("t_id"), F.col("output_metric_id").alias("t_metric"))
    df = db.unresolved_items.filter("status = 'open'").join(obs, "target_id", "left")
    df = df.join(place.select(F.col("target_id").alias("i_id"), F.col("p").alias("i_place")), F.col("id") == F.col("i_id"), "left")
    df = df.join(place.withColumnRenamed("p", "t_place"), "target_id", "left")
    df = df.join(metrics, F.col("target_id") == F.col("m_id"), "left").join(outs, F.col("target_id") == F.col("t_id"), "left")
    df = df.withColumn("metric_id", F.coalesce("o_metric", "m_id", "t_metric")).drop("m_id", "m_name")
    df = df.join(metrics, F.col("metric_id") == F.col("m_id"), "left").withColumn("metric_id", F.col("m_id"))
    df = df.join(first_model, F.col("metric_id") == F.col("f_metric"), "left").join(models.withColumnsRenamed({"n_id": "own_id", "n_name": "own_name"}), F.col("target_id") == F.col("own_id"), "left")
    df = df.withColumn("model_id", F.coalesce("model_id", "o_model", "own_id", "f_model")).join(models, F.col("model_id") == F.col("n_id"), "left")
    own = F.when(F.col("sheet").isNotNull() | F.col("cell").isNotNull(), F.struct("sheet", "cell"))
    df = df.withColumn("_place", F.coalesce(own, "i_place", "t_place")).withColumns({"sheet": F.col("_place.sheet"), "cell": F.col("_place.cell")})
    df = df.withColumns({"_cell": plain_cell("cell"), "_column": cell_column(F.col("cell"))})
    for by, key in (("cell", "_cell"), ("column", "_column")):
        known = unique_periods(db, by).select(F.col("model_id").alias(f"{by}_model"), F.col("sheet").alias(f"{by}_sheet"), F.col("place").alias(f"{by}_place"), F.col("period_id").alias(f"{by}_period"))
        df = df.join(known, (F.col("n_id") == F.col(f"{by}_model")) & (F.col("sheet") == F.col(f"{by}_sheet")) & (F.col(key) == F.col(f"{by}_place")), "left")
    df = df.withColumn("period_id", F.coalesce("o_period", "cell_period", "column_period"))
    df = df.join(db.periods.select(F.col("id").alias("l_id"), F.col("label").alias("l_label")), F.col("o_period") == F.col("l_id"), "left")
    names = None
    for frame, column in (("models", "name"), ("entities", "name"), ("scenarios", "name"), ("source_artifacts", "title"), ("assumptions", "statement")):
        if frame in db.frames and column in db.frames[frame].columns:
            part = db.frames[frame].select(F.col("id").alias("x_id"), F.col(column).alias("x_label"))
            names = part if names is None else names.unionByName(part)
    df = df.join(names.groupBy("x_id").agg(F.max("x_label").alias("x_label")), F.col("target_id") == F.col("x_id"), "left")
    label = F.coalesce(F.when(F.col("l_label").isNotNull() & F.col("m_name").isNotNull(), F.concat(F.col("m_name"), F.lit(" · "), F.col("l_label"))), "m_name", "x_label", F.concat(F.col("n_name"), F.lit(" model")), F.lit("Workbook-level issue"))
    return df.select("id", "attention_level", "action_owner", "model_id", F.col("n_name").alias("model_name"), "metric_id", "sheet", "cell", cell_row(F.col("cell")).alias("row"), "period_id", label.alias("label"))


def order_queue(queue: DataFrame) -> DataFrame:
    """Action first, then model, sheet, row (missing last) and id."""
    return queue.orderBy(*_queue_order())


def queue_places(queue: DataFrame) -> DataFrame:
    """(model_id, id, n): each item's place in its model's part of the ordered queue."""
    return queue.withColumn("n", F.row_number().over(Window.partitionBy("model_id").orderBy(*_queue_order()))).select("model_id", "id", "n")


def _queue_order() -> list[F.Column]:
    text = lambda c: F.collate(F.coalesce(c, F.lit("")), "UNICODE")
    return [F.when(F.col("attention_level") == "action_required", 0).otherwise(1), text("model_name"), text("sheet"), F.col("row").asc_nulls_last(), text("id")]


def attention_filter(queue: DataFrame, bucket: str) -> DataFrame:
    """Items of a bucket: an owner, ``unassigned``, ``needs_review``, ``action_required`` or ``all``."""
    if bucket == "all":
        return queue
    if bucket in ("needs_review", "action_required"):
        return queue.filter(F.col("attention_level") == bucket)
    return queue.filter((F.col("attention_level") == "action_required") & (F.coalesce("action_owner", F.lit("unassigned")) == bucket))


def attention_by_owner(queue: DataFrame) -> DataFrame:
    """(bucket, n): needs_review items, and action items by owner (or unassigned)."""
    bucket = F.when(F.col("attention_level") == "needs_review", "needs_review").otherwise(F.coalesce("action_owner", F.lit("unassigned")))
    return queue.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def relationships_of(db: ModelDb, labels: DataFrame | None = None) -> DataFrame:
    """(target_id, relationship_id, type, direction, other_id[, other_label]) in both directions; an edge to itself counts as outgoing.

    labels: (id, label) of objects, as of ``plans.model_db.object_index``.
    """
    r = db.relationships
    out = r.select(F.col("from_id").alias("target_id"), F.col("id").alias("relationship_id"), "type", F.lit("outgoing").alias("direction"), F.col("to_id").alias("other_id"))
    back = r.filter("from_id <> to_id").select(F.col("to_id").alias("target_id"), F.col("id").alias("relationship_id"), "type", F.lit("incoming").alias("direction"), F.col("from_id").alias("other_id"))
    both = out.unionByName(back)
    return both if labels is None else both.join(labels.select(F.col("id").alias("other_id"), F.col("label").alias("other_label")), "other_id", "left")


def complete_guidance() -> F.Column:
    """Whether an item says how it is treated now, what it affects and what comes next."""
    return F.expr(" and ".join(f"trim(coalesce({c}, '')) <> ''" for c in ("current_treatment", "impact", "next_action")))


def navigation_targets(db: ModelDb, preferred: str | None = None) -> DataFrame:
    """(id, presentation_id): for each observation the presentation of its metric, by source sheet, then the preferred, then the first."""
    place = db.provenance_records.groupBy(F.col("target_id").alias("id")).agg(F.min_by("sheet", "ord").alias("sheet"))
    shown = db.presentation_metrics.join(db.presentations.select(F.col("id").alias("presentation_id"), "model_id", F.col("sheet").alias("p_sheet"), F.col("ord").alias("p_ord")), "presentation_id").select("presentation_id", "model_id", "metric_id", "p_sheet", "p_ord").distinct()
    j = db.observations.select("id", "model_id", "metric_id").join(place, "id", "left").join(shown, ["model_id", "metric_id"])
    w = Window.partitionBy("id").orderBy(F.coalesce(F.col("sheet") == F.col("p_sheet"), F.lit(False)).desc(), (F.col("presentation_id") == F.lit(preferred)).desc_nulls_last(), "p_ord")
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("id", "presentation_id")


def confirm_item(db: ModelDb, item_id: str) -> ModelDb:
    """The database with an open needs_review item of complete guidance resolved, and the item's own records confirmed."""
    item = db.unresolved_items.filter((F.col("id") == item_id) & F.expr("status = 'open' and attention_level = 'needs_review'") & complete_guidance()).select("id").head()
    if item is None:
        raise ValueError(f"{item_id} cannot be confirmed")
    items = db.unresolved_items.withColumn("status", F.when(F.col("id") == item_id, "resolved").otherwise(F.col("status")))
    records = db.provenance_records.withColumn("review_status", F.when(F.col("target_id") == item_id, "confirmed").otherwise(F.col("review_status")))
    return db.replace(unresolved_items=items, provenance_records=records)
