"""Point-in-time series, financial tables, period types and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.hold import hold as held
from ..plans.model_db import ModelDb, matches_scenario, period_key
from .hierarchy import metric_hierarchy, metric_ranks, ordered_depths
from .lineage import transformation_refs
from .review import provenance


def metric_series(db: ModelDb, as_of: str | None = None, scenario: str | None = None, model_id: str | None = None, metric_id: str | None = None, entity_id: str | None = None) -> DataFrame:
    """The latest observation of each (model, metric, entity, period) known at ``as_of``, of a scenario.

    Of equal dates the first in declaration order wins. Filters reach the scan; one shuffle ranks.
    """
    obs = db.observations
    for column, value in (("model_id", model_id), ("metric_id", metric_id), ("entity_id", entity_id)):
        if value is not None:
            obs = obs.filter(F.col(column) == value)
    if as_of is not None:
        obs = obs.filter(F.col("as_of") <= as_of)
    obs = obs.filter(matches_scenario(F.lit(scenario)))
    w = Window.partitionBy("model_id", "metric_id", "entity_id", "period_id").orderBy(F.col("as_of").desc(), "ord")
    return obs.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def with_period_order(db: ModelDb, df: DataFrame) -> DataFrame:
    return df.join(db.periods.select(F.col("id").alias("period_id"), F.col("label").alias("period_label"), F.col("type").alias("period_type"), period_key().alias("period_key")), "period_id")


def financial_table(db: ModelDb, as_of: str | None = None, scenario: str | None = None, period_type: str | None = None) -> DataFrame:
    """Long form: a row for each (model, entity, metric, period) that has data, with the metric's place and the period's key."""
    rows = with_period_order(db, metric_series(db, as_of, scenario))
    if period_type:
        rows = rows.filter(F.col("period_type") == period_type)
    metrics = db.metrics.select(F.col("id").alias("metric_id"), F.col("name").alias("metric_name"), "data_type", F.col("ord").alias("metric_ord"))
    return rows.join(metrics, "metric_id").select("model_id", "entity_id", "metric_id", "metric_name", "metric_ord", "period_id", "period_label", "period_key", "actuality", "num")


def financial_table_wide(table: DataFrame, periods: list[str]) -> DataFrame:
    """Wide form: a column for each period of the list."""
    return table.groupBy("model_id", "entity_id", "metric_id").pivot("period_id", periods).agg(F.first("num"))


def series_of_models(db: ModelDb, as_of: str | None = None, scenario: str | None = None, entity_id: str | None = None, period_type: str | None = None) -> DataFrame:
    """Latest observations of each model's primary entity (or ``entity_id``), known at the model's own date (or ``as_of``), with the periods' keys."""
    # a small table of models: Spark broadcasts it while it is under the threshold
    own = db.models.select(F.col("id").alias("model_id"), F.col("primary_entity_id").alias("_entity"), F.col("as_of").alias("_cut"))
    obs = db.observations.join(own, "model_id").filter(F.col("as_of") <= (F.lit(as_of) if as_of else F.col("_cut")))
    obs = obs.filter(F.col("entity_id") == (F.lit(entity_id) if entity_id else F.col("_entity"))).drop("_entity", "_cut")
    rows = with_period_order(db, metric_series(db.replace(observations=obs), None, scenario))
    return rows.filter(F.col("period_type") == period_type) if period_type else rows


def sections(db: ModelDb, series: DataFrame, presentation_id: str | None = None) -> DataFrame:
    """(model_id, presentation_id, section_id, section_title, section_ord, pos, metric_id, depth): the rows that each model's table shows.

    A model's first presentation (or the one of ``presentation_id``) gives its sections and display parents; a model without one has one
    section of the metric hierarchy, in which only metrics with data indent what hangs below them. Metrics without data are left out.
    """
    shown = held(series.select("model_id", "metric_id").distinct())
    w = Window.partitionBy("model_id").orderBy("ord")
    named = db.presentations.select(F.col("id").alias("presentation_id"), "model_id", "ord")
    chosen = named.filter(F.col("presentation_id") == presentation_id) if presentation_id else named.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    rows = db.presentation_metrics.join(chosen.select("presentation_id", "model_id"), "presentation_id")
    items = rows.select(F.concat_ws("/", "presentation_id", "section_id").alias("group"), F.col("ord").alias("pos"), F.col("metric_id").alias("id"), "parent_id")
    depths = ordered_depths(items).withColumnsRenamed({"id": "metric_id"})
    titles = db.sections.select(F.col("id").alias("section_id"), F.col("title").alias("section_title"), F.col("ord").alias("section_ord")) if "sections" in db.frames else None
    kept = rows.withColumn("group", F.concat_ws("/", "presentation_id", "section_id")).join(depths, ["group", "metric_id"]).withColumn("pos", F.col("ord"))
    kept = kept.join(titles, "section_id", "left") if titles is not None else kept.withColumns({"section_title": F.lit(None).cast("string"), "section_ord": F.lit(0).cast("long")})
    columns = ["model_id", "presentation_id", "section_id", "section_title", F.col("section_ord").cast("long").alias("section_ord"), "pos", "metric_id", F.col("depth").cast("int").alias("depth")]
    kept = kept.join(shown, ["model_id", "metric_id"], "left_semi").select(*columns)
    flat = metric_hierarchy(db, shown=shown).join(chosen.select("model_id"), "model_id", "left_anti").join(shown, ["model_id", "metric_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy("model_id").orderBy("path")).cast("long")
    fallback = flat.select("model_id", F.lit(None).cast("string").alias("presentation_id"), F.concat(F.lit("section_"), F.regexp_replace("model_id", "^model_", ""), F.lit("_metrics")).alias("section_id"), F.lit("Model metrics").alias("section_title"), F.lit(0).cast("long").alias("section_ord"), place.alias("pos"), "metric_id", F.col("depth").cast("int").alias("depth"))
    return kept.unionByName(fallback)


def first_locators(db: ModelDb) -> DataFrame:
    """(target_id, sheet, cell): the first place in a source that the provenance of an object names."""
    named = db.provenance_records.filter("sheet is not null or cell is not null")
    return named.groupBy("target_id").agg(F.min_by(F.struct("sheet", "cell"), "ord").alias("p")).select("target_id", "p.sheet", "p.cell")


def open_by_target(db: ModelDb) -> DataFrame:
    """(target_id, id, model_id, attention_level): open items by what they point at."""
    return db.unresolved_items.filter("status = 'open' and target_id is not null").select("target_id", "id", "model_id", "attention_level")


def sectioned_table(db: ModelDb, as_of: str | None = None, scenario: str | None = None, entity_id: str | None = None, period_type: str | None = None, presentation_id: str | None = None, query: str | None = None) -> DataFrame:
    """Rows of every model's financial table: sections' columns, metric, place, open items, attention, and a map of period to value.

    n_open counts the open items on the metric that name this model or none; attention is the most urgent of their levels.
    derived tells that a shown observation is. A section's place is its first row's that has one (only where there is no presentation).
    ``query`` keeps rows whose metric's name, id or tags hold it; sections without rows are then no longer there.
    """
    series = held(series_of_models(db, as_of, scenario, entity_id, period_type).select("model_id", "entity_id", "metric_id", "period_id", "period_key", "id", "actuality", "kind", "num", "value_type"))
    cells = series.groupBy("model_id", "entity_id", "metric_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("period_id", F.struct("id", "actuality", "kind", "num").alias("v"))))).alias("cells"), F.bool_or(F.col("value_type") == "derived").alias("derived"))
    table = sections(db, series, presentation_id).join(cells, ["model_id", "metric_id"])
    metrics = search_metrics(db, query) if query else db.metrics
    table = table.join(metrics.select(F.col("id").alias("metric_id"), F.col("name").alias("metric_name"), "data_type"), "metric_id")
    table = table.join(first_locators(db).withColumnRenamed("target_id", "metric_id"), "metric_id", "left")
    items = open_by_target(db).select(F.col("target_id").alias("metric_id"), F.col("model_id").alias("_model"), "id", "attention_level")
    mine = table.select("model_id", "metric_id").distinct().join(items, "metric_id").filter("_model is null or _model = model_id")
    level = F.when(F.bool_or(F.col("attention_level") == "action_required"), "action_required").otherwise("needs_review")
    table = table.join(mine.groupBy("model_id", "metric_id").agg(F.count_distinct("id").alias("n_open"), level.alias("attention")), ["model_id", "metric_id"], "left").withColumn("n_open", F.coalesce("n_open", F.lit(0)))
    place = F.min_by(F.struct("sheet", "cell"), F.when(F.col("sheet").isNotNull() | F.col("cell").isNotNull(), F.col("pos"))).over(Window.partitionBy("model_id", "section_id"))
    return table.withColumn("section_place", F.when(F.col("presentation_id").isNull(), place))


def table_periods(db: ModelDb, as_of: str | None = None, scenario: str | None = None, period_type: str | None = None) -> DataFrame:
    """(model_id, period_id, n): the periods of each model's table, in order: the union over its metrics."""
    seen = series_of_models(db, as_of, scenario, period_type=period_type).select("model_id", "period_id", "period_key").distinct()
    return seen.select("model_id", "period_id", F.row_number().over(Window.partitionBy("model_id").orderBy("period_key", "period_id")).alias("n"))


def initial_view(db: ModelDb, default_model: str | None = None, period_type: str | None = None) -> DataFrame:
    """One row (model_id, presentation_id, entity_id, period_type): what a viewer opens with.

    The default model or else the first; its first presentation and primary entity; the configured period type if the model has it,
    or else its earliest.
    """
    models = db.models.select(F.col("id").alias("model_id"), F.col("primary_entity_id").alias("entity_id"), "ord")
    model = models.orderBy((F.col("model_id") == F.lit(default_model)).desc_nulls_last(), "ord").limit(1)
    shown = db.presentations.groupBy("model_id").agg(F.min_by("id", "ord").alias("presentation_id"))
    types = period_types(db).groupBy("model_id").agg(F.min_by("type", F.struct((F.coalesce(F.col("type") != F.lit(period_type), F.lit(True))).cast("int"), "first_key")).alias("period_type"))
    return model.join(shown, "model_id", "left").join(types, "model_id", "left").select("model_id", "presentation_id", "entity_id", "period_type")


def highlighted(inputs: DataFrame, series: DataFrame) -> DataFrame:
    """(out_id, n_shown, n_total): how many of an observation's resolved inputs stand in the shown series."""
    total = inputs.filter("in_id is not null").select("out_id", "in_id").distinct()
    there = series.select(F.col("id").alias("in_id"), F.lit(1).alias("_here")).distinct()
    return total.join(there, "in_id", "left").groupBy("out_id").agg(F.count("_here").alias("n_shown"), F.count(F.lit(1)).alias("n_total"))


def period_types(db: ModelDb, presentation_id: str | None = None, entity_id: str | None = None) -> DataFrame:
    """(model_id, type, first_key): period types that a model (an entity, the metrics of a presentation) has data of, by their earliest period."""
    obs = db.observations if entity_id is None else db.observations.filter(F.col("entity_id") == entity_id)
    if presentation_id is not None:
        model = db.presentations.filter(F.col("id") == presentation_id).select("model_id")
        metrics = db.presentation_metrics.filter(F.col("presentation_id") == presentation_id).select("metric_id").distinct()
        obs = obs.join(model, "model_id", "left_semi").join(metrics, "metric_id", "left_semi")
    seen = obs.select("model_id", "period_id").distinct()
    return with_period_order(db, seen).groupBy("model_id", F.col("period_type").alias("type")).agg(F.min("period_key").alias("first_key"))


def model_overview(db: ModelDb) -> DataFrame:
    """Counts of each model: metrics, observations, actual and estimated ones, transformations, open items by level, unreviewed provenance.

    A transformation counts where its output or a metric that it reads is visible; provenance counts where its target is the
    model, its primary entity, one of its observations, visible metrics or counted transformations.
    """
    obs = db.observations.groupBy("model_id").agg(
        F.count_distinct("metric_id").alias("n_metrics"),
        F.count(F.lit(1)).alias("n_observations"),
        F.count_if(F.col("actuality") == "actual").alias("n_actual"),
        F.count_if(F.col("actuality") == "estimate").alias("n_estimate"),
        F.count_distinct("entity_id").alias("n_entities"),
    )
    visible = db.observations.select("model_id", "metric_id").distinct()
    reads = transformation_refs(db).select("transformation_id", "metric_id").union(db.transformations.select("id", "output_metric_id"))
    used = held(visible.join(reads, "metric_id").select("model_id", "transformation_id").distinct())
    out = db.models.select(F.col("id").alias("model_id"), "primary_entity_id").join(obs, "model_id", "left").join(used.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_transformations")), "model_id", "left")
    counts = ["n_metrics", "n_observations", "n_actual", "n_estimate", "n_entities", "n_transformations"]
    if "unresolved_items" in db.frames:
        items = db.unresolved_items.filter("status = 'open'").groupBy("model_id").agg(F.count(F.lit(1)).alias("n_open"), F.count_if(F.col("attention_level") == "needs_review").alias("n_needs_review"), F.count_if(F.col("attention_level") == "action_required").alias("n_action_required"))
        out, counts = out.join(items, "model_id", "left"), [*counts, "n_open", "n_needs_review", "n_action_required"]
    if "provenance_records" in db.frames:
        targets = db.observations.select("model_id", F.col("id").alias("target_id"))
        for more in (visible, used, db.models.select("id", "id"), db.models.select("id", "primary_entity_id")):
            targets = targets.union(more)
        late = provenance(db).filter("review_status = 'unreviewed'").join(targets.distinct(), "target_id").groupBy("model_id").agg(F.count(F.lit(1)).alias("n_unreviewed"))
        out, counts = out.join(late, "model_id", "left"), [*counts, "n_unreviewed"]
    return out.select("model_id", "primary_entity_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def database_stats(db: ModelDb) -> DataFrame:
    """One row of counts over the whole database: collections, open items by level, unreviewed provenance (inherited status)."""
    counts = [db.frames[t].agg(F.count(F.lit(1)).alias(f"n_{t}")) for t in ("models", "metrics", "observations", "transformations")]
    counts.append(db.unresolved_items.filter("status = 'open'").agg(F.count(F.lit(1)).alias("n_open"), F.count_if(F.col("attention_level") == "needs_review").alias("n_needs_review"), F.count_if(F.col("attention_level") == "action_required").alias("n_action_required")))
    counts.append(provenance(db).agg(F.count_if(F.col("review_status") == "unreviewed").alias("n_unreviewed")))
    out = counts[0]
    for more in counts[1:]:
        out = out.crossJoin(more)  # one row each
    return out


def metrics_by_source(db: ModelDb) -> DataFrame:
    """(id, name, rank): metrics in the order of their first source places."""
    return metric_ranks(db).join(db.metrics.select(F.col("id").alias("metric_id"), "name"), "metric_id").select(F.col("metric_id").alias("id"), "name", "rank")


def period_modes(table: DataFrame) -> DataFrame:
    """(model_id, entity_id, period_id, mode, boundary): actuality of the first metric with an observation (else estimate), and whether it differs from the period before."""
    first = table.groupBy("model_id", "entity_id", "period_id", "period_key").agg(F.coalesce(F.min_by("actuality", "metric_ord"), F.lit("estimate")).alias("mode"))
    before = F.lag("mode").over(Window.partitionBy("model_id", "entity_id").orderBy("period_key"))
    return first.withColumn("boundary", F.coalesce(before != F.col("mode"), F.lit(False)))


def search_metrics(db: ModelDb, query: str) -> DataFrame:
    """Metrics whose name, id or tags hold the query, whatever the case."""
    text = F.lower(F.concat_ws(" ", "name", "id", F.array_join("tags", " ")))
    return db.metrics.filter(text.contains(query.strip().lower()))
