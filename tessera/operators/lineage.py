"""Period axes, reference resolution, lineage both ways, evaluation and recalculation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..plans.hold import hold as held
from ..plans.hold import hold_by, new_folder
from ..plans.model_db import ModelDb, period_key, value_matches
from .graphs import formula_strata

Hold = Callable[[DataFrame], DataFrame]
VALUE = ["kind", "num", "str", "bool"]
#: Formulas that one projection evaluates.
FORMULAS = 64
OUT = ["model_id", "entity_id", "version_id", "out_as_of", "out_scenario"]


def transformation_refs(db: ModelDb) -> DataFrame:
    """(transformation_id, ref, metric_id, offset, target_period, dependency): references of each supported transformation that can be parsed.

    dependency: place of the metric among those the formula reads, in order of their ids. Distinct expressions are parsed on the driver;
    their number is that of formulas, not of cells.
    """
    rows = db.transformations.filter("status = 'supported'").select("id", "expression").collect()
    refs = []
    for r in rows:
        found = X.analyze(r["expression"])
        place = {m: i for i, m in enumerate(found.dependencies)}
        refs.extend((r["id"], ref.key, ref.metric_id, ref.offset, ref.period_id, place[ref.metric_id]) for ref in found.references)
    return db.transformations.sparkSession.createDataFrame(refs, "transformation_id string, ref string, metric_id string, offset int, target_period string, dependency int")


def outputs(db: ModelDb) -> DataFrame:
    """Observations of supported transformations, as outputs."""
    return db.observations.filter(F.col("transformation_id").isNotNull()).select(F.col("id").alias("out_id"), "model_id", "entity_id", "version_id", F.col("as_of").alias("out_as_of"), F.col("scenario_id").alias("out_scenario"), F.col("period_id").alias("out_period"), "transformation_id")


def _known(out_scenario: str = "out_scenario") -> F.Column:
    return (F.col("as_of") <= F.col("out_as_of")) & (F.col(out_scenario).isNull() | (F.col("actuality") == "actual") | F.coalesce(F.col("scenario_id") == F.col(out_scenario), F.lit(False)))


def period_axis(db: ModelDb, contexts: DataFrame) -> DataFrame:
    """Positions of the periods that each context (``OUT`` columns) has observed, by period type.

    Any metric counts: a gap in one metric does not shift the axis.
    """
    obs = db.observations.select("model_id", "entity_id", "version_id", "as_of", "actuality", "scenario_id", "period_id").distinct()
    seen = contexts.select(*OUT).distinct().join(obs, ["model_id", "entity_id", "version_id"]).filter(_known()).select(*OUT, "period_id").distinct()
    keyed = seen.join(db.periods.select(F.col("id").alias("period_id"), F.col("type").alias("period_type"), period_key().alias("period_key")), "period_id")
    w = Window.partitionBy(*OUT, "period_type").orderBy("period_key", "period_id")
    return keyed.withColumn("pos", F.row_number().over(w)).select(*OUT, "period_type", "period_id", "pos")


def resolve_inputs(db: ModelDb, refs: DataFrame | None = None) -> DataFrame:
    """A row for each output and distinct reference: the observation it resolves to, or nulls.

    Candidates share model, metric, entity, version and target period, are known at the output's date and match
    its scenario; the exact scenario, then the latest date, then the first declared wins. All are equi-joins on the key.
    """
    refs = (transformation_refs(db) if refs is None else refs).drop("dependency")
    wanted = outputs(db).join(refs, "transformation_id")
    axis = period_axis(db, wanted.filter("offset <> 0"))
    here = axis.select(*OUT, "period_type", F.col("period_id").alias("out_period"), "pos")
    there = axis.select(*OUT, "period_type", F.col("period_id").alias("moved_period"), F.col("pos").alias("target_pos"))
    moved = wanted.filter("offset <> 0")
    m = moved.alias("m").join(here.alias("h"), [F.col(f"m.{c}").eqNullSafe(F.col(f"h.{c}")) for c in OUT] + [F.col("m.out_period") == F.col("h.out_period")]).select("m.*", "h.period_type", (F.col("h.pos") + F.col("m.offset")).alias("target_pos"))
    m = m.alias("m").join(there.alias("t"), [F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in OUT] + [F.col("m.period_type") == F.col("t.period_type"), F.col("m.target_pos") == F.col("t.target_pos")], "left").select("m.*", "t.moved_period")
    m = m.select(*wanted.columns, F.col("moved_period").alias("in_period"))
    still = wanted.filter("offset = 0").withColumn("in_period", F.coalesce("target_period", "out_period"))
    targets = still.select(*wanted.columns, "in_period").unionByName(m)
    candidates = db.observations.select("model_id", "metric_id", "entity_id", "version_id", F.col("period_id").alias("in_period"), F.col("id").alias("in_id"), "as_of", "actuality", "scenario_id", "ord", "kind", "num", "str", "bool")
    found = targets.join(candidates, ["model_id", "metric_id", "entity_id", "version_id", "in_period"], "left")
    fits = F.col("in_id").isNotNull() & _known()
    exact = F.col("scenario_id").eqNullSafe(F.col("out_scenario")).cast("int")
    best = F.max_by(F.struct("in_id", "kind", "num", "str", "bool"), F.when(fits, F.struct(exact, "as_of", -F.col("ord"))))
    return found.groupBy("out_id", "transformation_id", "ref", "metric_id").agg(F.first("in_period").alias("in_period"), F.when(F.max(fits), best).alias("b")).select("out_id", "transformation_id", "ref", "metric_id", "in_period", "b.*")


def direct_dependents(inputs: DataFrame) -> DataFrame:
    """(id, dependent_id): outputs that resolve to an observation."""
    return inputs.filter("in_id is not null").select(F.col("in_id").alias("id"), F.col("out_id").alias("dependent_id")).distinct()


def layers(nodes: DataFrame, edges: DataFrame, hold: Hold = held) -> Iterator[DataFrame]:
    """Frames of (id) of ``nodes``, each after all from which ``edges`` (id, dependent_id) among the nodes lead to it.

    As many rounds as the longest chain has links; an edge is looked at until its first end is done. A cycle is an error.
    """
    pending = hold(nodes.select("id").distinct())
    ends = lambda c: pending.select(F.col("id").alias(c))
    edges = hold(edges.select("id", "dependent_id").distinct().join(ends("id"), "id", "left_semi").join(ends("dependent_id"), "dependent_id", "left_semi"))
    while True:
        ready = hold(pending.join(edges.select(F.col("dependent_id").alias("id")).distinct(), "id", "left_anti"))
        if ready.isEmpty():
            if not pending.isEmpty():
                raise ValueError(f"formulas depend on each other in a cycle: {pending.agg(F.min('id')).first()[0]}")
            return
        yield ready
        pending, edges = hold(pending.join(ready, "id", "left_anti")), hold(edges.join(ready, "id", "left_anti"))


def reached(dependents: DataFrame, start: DataFrame, hold: Hold = held) -> DataFrame:
    """(id): ``start`` and all that it reaches. A frontier loop; what was found is not followed again."""
    spark, folder, schema = start.sparkSession, new_folder(start.sparkSession, "reached"), start.select("id").schema
    start.select("id").distinct().write.parquet(f"{folder}/0")
    found, n = spark.read.schema(schema).parquet(f"{folder}/0"), 0
    frontier = found
    while not frontier.isEmpty():
        n += 1
        frontier.join(dependents, "id").select(F.col("dependent_id").alias("id")).distinct().join(found, "id", "left_anti").write.parquet(f"{folder}/{n}")
        frontier = spark.read.schema(schema).parquet(f"{folder}/{n}")
        found = spark.read.schema(schema).parquet(*(f"{folder}/{k}" for k in range(n + 1)))
    return found


def closure(dependents: DataFrame, start: DataFrame, hold: Hold = held) -> DataFrame:
    """(id, level): all observations that the ids of ``start`` reach, with their longest distance from one."""
    dependents = hold(dependents)
    out = None
    for level, ready in enumerate(layers(reached(dependents, start, hold), dependents, hold)):
        part = ready.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return start.select("id", F.lit(0).alias("level")).limit(0) if out is None else out


def evaluate(db: ModelDb, inputs: DataFrame, hold: Hold = held) -> DataFrame:
    """(out_id, kind, num, str, bool, error): each output's expression over its resolved inputs.

    Inputs are gathered once by output (one shuffle); a projection picks the expression by the output's formula, so values stay in
    generated code. Only beyond ``FORMULAS`` formulas the gathered rows are held and gone through once for each so many.
    """
    labels = db.periods.select(F.col("id").alias("in_period"), F.col("label").alias("in_label"))
    value = F.struct("in_id", *VALUE, "in_label")
    gathered = inputs.join(labels, "in_period", "left").groupBy("out_id", "transformation_id").agg(F.map_from_entries(F.collect_list(F.struct("ref", value))).alias("in"))
    rows = sorted(db.transformations.filter("status = 'supported'").select("id", "expression").collect(), key=lambda r: r["id"])
    if len(rows) > FORMULAS:
        gathered = hold(gathered)
    out = None
    for at in range(0, max(len(rows), 1), FORMULAS):
        chunk = {r["id"]: r["expression"] for r in rows[at : at + FORMULAS]}
        mine = gathered.filter(F.col("transformation_id").isin(list(chunk)))
        part = X.with_values(mine, chunk, lambda key: X.input_value(F.col("in")[key], key), by="transformation_id").select("out_id", *VALUE, "error")
        out = part if out is None else out.unionByName(part)
    return out


def steps(db: ModelDb, inputs: DataFrame, hold: Hold = held) -> DataFrame:
    """(id, step): for each output of ``inputs`` the step (text, in order) in which it is computed, after all that it reads.

    Steps follow from formulas and the order of periods (``graphs.formula_strata``). Only cells of formulas that refer to each other
    by named periods, both ways in time, or in the same period, are layered by their edges; a cycle among them is an error.
    """
    metrics = db.observations.select(F.col("id"), "metric_id", "period_id")
    made = inputs.select(F.col("out_id").alias("id"), "transformation_id").distinct().join(metrics, "id")
    produced: dict[str, list[str]] = {}
    for r in made.select("transformation_id", "metric_id").distinct().collect():  # formulas and their metrics, not cells
        produced.setdefault(r["metric_id"], []).append(r["transformation_id"])
    reads: dict[str, list[tuple[str, int, bool]]] = {t: [] for made_by in produced.values() for t in made_by}
    for r in transformation_refs(db).collect():
        if r["transformation_id"] in reads:
            reads[r["transformation_id"]] += [(t, r["offset"], r["target_period"] is not None) for t in produced.get(r["metric_id"], ())]
    rows = [(t, level, mode, place) for t, (level, mode, place) in formula_strata(reads).items()]
    strata = db.observations.sparkSession.createDataFrame(rows, "transformation_id string, level int, mode string, place int")
    rank = F.row_number().over(Window.partitionBy("type").orderBy(period_key(), "id"))
    periods = db.periods.select("id", F.col("id").alias("period_id"), rank.alias("rank")).select("period_id", "rank")
    placed = made.join(strata, "transformation_id").join(periods, "period_id", "left")
    loose = [t for t, _, mode, _ in rows if mode == "cells"]
    layer = None
    if loose:
        cells = hold(made.filter(F.col("transformation_id").isin(loose)).select("id"))
        for n, ready in enumerate(layers(cells, direct_dependents(inputs), hold)):
            part = ready.select("id", F.lit(n).alias("layer"))
            layer = part if layer is None else layer.unionByName(part)
    placed = placed.withColumn("layer", F.lit(None).cast("int")) if layer is None else placed.join(layer, "id", "left")
    turn = F.when(F.col("mode") == "forward", F.coalesce("rank", F.lit(0))).when(F.col("mode") == "backward", 1_000_000 - F.coalesce("rank", F.lit(0))).otherwise(0)
    kind = F.when(F.col("mode") == "once", 0).when(F.col("mode") == "cells", 3).when(F.col("mode") == "forward", 1).otherwise(2)
    return placed.select("id", F.format_string("%05d-%d-%07d-%05d-%07d", "level", kind, turn, "place", F.coalesce("layer", F.lit(0))).alias("step"))


def recalculate(db: ModelDb, only: DataFrame | None = None, hold: Hold = held, strict: bool = False, inputs: DataFrame | None = None) -> ModelDb:
    """The database with derived observations evaluated, each after all that it reads, however long the chains are.

    ``only`` (ids) limits it to the observations that an edit reaches. Failed evaluations keep their value, or are an error
    if ``strict``. Inputs are resolved once, as no value decides which observation a reference means, and stored by step; a step
    reads its own and the results of the steps that it refers to. inputs: ``resolve_inputs`` of a database with the same
    observations and formulas, whatever their values, if the caller has them.
    """
    spark = db.observations.sparkSession
    given = inputs is not None
    inputs = (inputs if given else resolve_inputs(db)).select("out_id", "transformation_id", "ref", "in_period", "in_id", *VALUE)
    if only is not None:
        inputs = inputs.join(only.select(F.col("id").alias("out_id")), "out_id", "left_semi")
    if given:
        inputs = inputs.drop(*VALUE).join(db.observations.select(F.col("id").alias("in_id"), *VALUE), "in_id", "left")
    inputs = hold(inputs)
    step_of = hold(steps(db, inputs, hold))
    own = step_of.select(F.col("id").alias("out_id"), "step")
    theirs = step_of.select(F.col("id").alias("in_id"), F.col("step").alias("in_step"))
    staged = hold_by(inputs.join(own, "out_id").join(theirs, "in_id", "left").select(*inputs.columns, "in_step", "step"), "step")
    order = staged.groupBy("step").agg(F.collect_set("in_step").alias("reads"), F.collect_set("transformation_id").alias("formulas")).orderBy("step").collect()
    if not order:
        return db
    folder = new_folder(spark, "steps")
    schema = "id string, kind string, num double, str string, bool boolean"
    results = lambda names: spark.read.schema(schema).parquet(*(f"{folder}/{n}" for n in names))
    for r in order:
        mine = staged.filter(F.col("step") == r["step"])
        if r["reads"]:
            fresh = results(sorted(r["reads"])).select(F.col("id").alias("in_id"), F.struct(*VALUE).alias("_v"))
            mine = mine.join(fresh, "in_id", "left").withColumns({c: F.when(F.col("_v").isNotNull(), F.col("_v")[c]).otherwise(F.col(c)) for c in VALUE})
        one = db.replace(transformations=db.transformations.filter(F.col("id").isin(r["formulas"])))
        done = evaluate(one, mine, hold).withColumnRenamed("out_id", "id")
        if strict:
            done = hold(done)
            if failed := done.filter("error is not null").select("id", "error").orderBy("id").first():
                raise ValueError(f"{failed['id']} {failed['error']}")
        done.filter("error is null").select("id", *VALUE).write.parquet(f"{folder}/{r['step']}")
    new = results([r["step"] for r in order])
    joined = db.observations.join(new.select("id", F.struct(*VALUE).alias("_v")), "id", "left")
    obs = joined.select(*(F.when(F.col("_v").isNotNull(), F.col("_v")[c]).otherwise(F.col(c)).alias(c) if c in VALUE else F.col(c) for c in db.observations.columns))
    return db.replace(observations=hold(obs))


def same_value(a: str, b: str) -> Column:
    """Whether two structs hold the same tagged value."""
    return F.col(f"{a}.kind").eqNullSafe(F.col(f"{b}.kind")) & F.col(f"{a}.num").eqNullSafe(F.col(f"{b}.num")) & F.col(f"{a}.str").eqNullSafe(F.col(f"{b}.str")) & F.col(f"{a}.bool").eqNullSafe(F.col(f"{b}.bool"))


def edit_values(db: ModelDb, edits: DataFrame, hold: Hold = held, inputs: DataFrame | None = None) -> tuple[ModelDb, DataFrame]:
    """(new database, changes): base values replaced by ``edits`` (id, num, or id and a tagged value), and what follows from them.

    An unknown id, a derived observation, an equal value or one of another type than the metric's is an error, and so is a formula
    that fails, a cycle, or a result that does not fit its metric. changes: (id, before, after, direct); the provenance
    of what changed is marked as corrected. inputs: ``resolve_inputs`` of the database, of whatever values, if the caller has them.
    """
    if "kind" not in edits.columns:
        edits = edits.select("id", F.when(F.col("num").isNull(), "null").otherwise("number").alias("kind"), "num", F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool"))
    wanted = hold(edits.select("id", F.struct(*VALUE).alias("_new")))
    types = db.metrics.select(F.col("id").alias("metric_id"), "data_type")
    checked = wanted.join(db.observations.withColumn("_old", F.struct(*VALUE)), "id", "left").join(types, "metric_id", "left")
    fits = F.coalesce(value_matches(F.col("data_type"), F.col("_new.kind"), F.col("_new.num")), F.lit(False))
    bad = checked.filter(F.col("_old").isNull() | F.col("transformation_id").isNotNull() | (F.col("value_type") == "derived") | same_value("_new", "_old") | ~fits).select("id").orderBy("id").limit(5).collect()
    if bad:
        raise ValueError(f"cannot edit {', '.join(r['id'] for r in bad)}: unknown, derived, unchanged or of another type")
    joined = db.observations.join(wanted, "id", "left")
    edited = joined.select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in VALUE else F.col(c) for c in db.observations.columns))
    now = db.replace(observations=edited)
    inputs = hold(resolve_inputs(now)) if inputs is None else inputs
    affected = reached(hold(direct_dependents(inputs)), wanted, hold)
    after = recalculate(now, affected.join(wanted, "id", "left_anti"), hold, strict=True, inputs=inputs)
    value = F.struct(*VALUE)
    both = db.observations.select("id", value.alias("_before")).join(after.observations.select("id", "metric_id", value.alias("_after")), "id").filter(~same_value("_before", "_after"))
    changes = hold(both.join(wanted.select("id", F.lit(True).alias("direct")), "id", "left").withColumn("direct", F.coalesce("direct", F.lit(False))))
    wrong = changes.join(types, "metric_id", "left").filter(~F.coalesce(value_matches(F.col("data_type"), F.col("_after.kind"), F.col("_after.num")), F.lit(False))).select("id").first()
    if wrong:
        raise ValueError(f"{wrong['id']}: the new value does not fit its metric")
    if "provenance_records" in db.frames:
        mark = changes.select(F.col("id").alias("target_id"), F.lit("corrected").alias("_status"))
        marked = db.provenance_records.join(mark, "target_id", "left").withColumn("review_status", F.coalesce("_status", "review_status"))
        after = after.replace(provenance_records=marked.select(*db.provenance_records.columns))
    return after, changes.select("id", F.col("_before.num").alias("before"), F.col("_after.num").alias("after"), "direct")
