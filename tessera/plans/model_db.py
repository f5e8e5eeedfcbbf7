"""The model database as typed DataFrames.

``ModelDb`` holds one DataFrame for each collection. ``observations`` is flat: the context of a series (model, metric,
entity, as_of, version) beside each point, with ``ord`` for declaration order. Scalar values are tagged:
``kind`` is number, string, boolean or null, and ``num``, ``str`` or ``bool`` holds the payload.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = ["model_id", "metric_id", "entity_id", "as_of", "version_id"]
POINT = ["id", "period_id", "scenario_id", "actuality", "kind", "num", "str", "bool", "value_type", "transformation_id"]


@dataclass
class ModelDb:
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["frames"][name]
        except KeyError:
            raise AttributeError(name) from None

    def replace(self, **frames: DataFrame) -> ModelDb:
        """A new database with some collections exchanged; this one stays as it is."""
        return ModelDb(self.frames | frames)


def period_key(start: str = "start_date", end: str = "end_date", label: str = "label") -> Column:
    """Order key of periods: start date, else end date, else label."""
    return F.coalesce(F.col(start).cast("string"), F.col(end).cast("string"), F.col(label))


def matches_scenario(scenario: Column, actuality: str = "actuality", scenario_id: str = "scenario_id") -> Column:
    """No scenario matches all; actual values match every scenario; else equality."""
    return scenario.isNull() | (F.col(actuality) == "actual") | F.coalesce(F.col(scenario_id) == scenario, F.lit(False))


def value_matches(data_type: Column, kind: Column, num: Column) -> Column:
    """Whether a tagged value fits a metric's data type: null always, count only whole numbers."""
    finite = ~F.isnan(num) & (F.abs(num) != float("inf"))
    whole = F.when(F.abs(num) >= 2.0**53, F.lit(True)).otherwise(num == F.floor(num))
    return (
        F.when(kind == "null", F.lit(True))
        .when(data_type == "text", kind == "string")
        .when(data_type == "boolean", kind == "boolean")
        .when(data_type == "count", (kind == "number") & finite & whole)
        .otherwise((kind == "number") & F.coalesce(finite, F.lit(False)))
    )


def group_series(observations: DataFrame) -> DataFrame:
    """Series with their points in order, first-seen series first (``series_ord``)."""
    points = F.sort_array(F.collect_list(F.struct("ord", *POINT)))
    return observations.groupBy(*CONTEXT).agg(F.min("ord").alias("series_ord"), points.alias("points"))


def flatten_series(series: DataFrame) -> DataFrame:
    """Observations of grouped series: the inverse of ``group_series``."""
    point = series.select(*CONTEXT, F.explode("points").alias("p"))
    return point.select("p.ord", *CONTEXT, *(F.col(f"p.{c}").alias(c) for c in POINT))


def only(df: DataFrame, object_id: str, kind: str) -> DataFrame:
    """The row of one object; an unknown id is an error."""
    found = df.filter(F.col("id") == object_id)
    if found.isEmpty():
        raise KeyError(f"unknown {kind} {object_id}")
    return found


def get_models(db: ModelDb) -> DataFrame:
    return db.models.orderBy("ord")


def get_model(db: ModelDb, model_id: str) -> DataFrame:
    return only(db.models, model_id, "model")


def get_metric(db: ModelDb, metric_id: str) -> DataFrame:
    return only(db.metrics, metric_id, "metric")


def get_observation(db: ModelDb, observation_id: str) -> DataFrame:
    """The observation with its series' context; no row for an unknown id."""
    return db.observations.filter(F.col("id") == observation_id)


def get_object(db: ModelDb, object_id: str, collections: list[str]) -> DataFrame:
    """(id, collection, label) of any object; no row for an unknown id."""
    return object_index(db, collections).filter(F.col("id") == object_id)


def table_presentations(db: ModelDb, model_id: str) -> DataFrame:
    return db.presentations.filter(F.col("model_id") == model_id).orderBy("ord")


def source_expression(db: ModelDb, transformation_id: str, period_id: str) -> DataFrame:
    """(formula) of a transformation in a period of its source; no row where there is none."""
    return db.transformation_sources.filter((F.col("transformation_id") == transformation_id) & (F.col("period_id") == period_id)).select("formula")


def editable(db: ModelDb) -> DataFrame:
    """(id, editable): numbers and nulls of numeric metrics that no formula makes."""
    numeric = db.metrics.select(F.col("id").alias("metric_id"), F.col("data_type").isin("number", "percentage", "currency", "count").alias("_numeric"))
    free = (F.col("value_type") != "derived") & F.col("transformation_id").isNull() & F.col("kind").isin("number", "null")
    return db.observations.join(numeric, "metric_id").select("id", (F.col("_numeric") & free).alias("editable"))


def models_entities(db: ModelDb) -> DataFrame:
    """(model_id, entity_id, ord) of entities with an observation, in declaration order."""
    seen = db.observations.select("model_id", F.col("entity_id").alias("id")).distinct()
    return db.entities.join(seen, "id").select("model_id", F.col("id").alias("entity_id"), "name", "ord")


def object_index(db: ModelDb, collections: list[str]) -> DataFrame:
    """(id, collection, label): one row for each id; of ids in several collections the later collection wins."""
    parts = []
    for rank, name in enumerate(collections):
        df = db.frames[name]
        label = next((c for c in ("name", "title", "statement", "label") if c in df.columns), None)
        parts.append(df.select("id", F.lit(name).alias("collection"), (F.col(label) if label else F.col("id")).alias("label"), F.lit(rank).alias("rank")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("id").agg(F.max_by(F.struct("collection", "label"), "rank").alias("x")).select("id", "x.collection", "x.label")
