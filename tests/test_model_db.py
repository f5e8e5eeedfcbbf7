import copy
import gzip
import io
import json
import math
import zipfile

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from model_fixture import FORMULAS, VALUES, document
from tessera.functions import expressions as X
from tessera.functions import scalars as S
from tessera.operators import hierarchy, lineage, records, review, series, validate
from tessera.plans import model_db as M
from tessera.sources import model_json, xlsx


@pytest.fixture(scope="module")
def db(spark):
    return model_json.from_document(spark, document())


def value_of(spark, text, **inputs):
    def lookup(key):
        v = inputs.get(key.split("|")[0], "missing")
        if v == "missing":
            return X._value("null", error=F.lit("missing input"))
        return X._literal(float(v) if isinstance(v, int) and not isinstance(v, bool) else v)

    row = X.with_values(spark.range(1), {None: text}, lookup).head()
    return f"error: {row['error']}" if row["error"] else {"number": row["num"], "string": row["str"], "boolean": row["bool"], "null": None}[row["kind"]]


@pytest.mark.parametrize(
    "text, want",
    [
        ("1 + 2 * 3 - -4 / 2", 9.0),
        ("mod(0-3, 2)", 1.0),
        ("mod(3, 0-2)", -1.0),
        ("mod(3, 0)", "error: mod() divisor must not be zero"),
        ("when(mod(2024, 4) != 0, 365, 366)", 366.0),
        ("round(0 - 2.5)", -2.0),
        ("round(2.345, 2)", 2.35),
        ("round(12.345, 1 + 1)", 12.35),
        ("round(1234.5, 0 - ref('t'))", 1200.0),
        ("round(2.5, 'x')", "error: round() requires a finite number"),
        ("ref('a') == 0 ? null : 10 / ref('a')", None),
        ("when(ref('a') == 0, null, 1 / ref('a') + 1)", "error: + requires a finite number"),
        ("1 / ref('a')", math.inf),
        ("coalesce(ref('n'), 'x')", "x"),
        ("coalesce(1, ref('gone'))", "error: missing input"),
        ("true ? 1 : ref('gone')", 1.0),
        ("null == null", True),
        ("'1' == 1", False),
        ("!true", False),
        ("min(3, 1, 2) + max(3, 1, 2) + average(1, 2, 3) + sum(1, 2) + abs(0 - 4)", 13.0),
        ("min(1, ref('n'))", "error: min() requires a finite number"),
        ("1 < 2 == true", True),
    ],
)
def test_expression_values(spark, text, want):
    assert value_of(spark, text, a=0, n=None, t=2) == want


def plan_length(spark, text):
    lookup = lambda key: X._value("number", num=X.F.col("id").cast("double"))
    return len(X.with_values(spark.range(1), {None: text}, lookup)._jdf.queryExecution().analyzed().toString())


@pytest.mark.parametrize("step", ["round(@ / 3, 2)", "@ / 7", "mod(@, 5)", "round(@, mod(@, 3))", "@ > 2 ? @ - 1 : 0 - @", "coalesce(@, 1) + when(@ == 1, 2, @)"])
def test_plans_grow_with_the_formula_alone(spark, step):
    nested = lambda k: "ref('x')" if not k else step.replace("@", f"({nested(k - 1)})")
    assert plan_length(spark, nested(6)) < 2.5 * plan_length(spark, nested(3))


def test_equal_parts_are_one_node():
    dag = X._Dag(X.parse("(ref('a') - ref('b')) / 2 + round((ref('a') - ref('b')) / 2) * (ref('a') - ref('b'))"))
    assert [n.kind for n, _ in dag.nodes].count("binary") == 4 and [n.kind for n, _ in dag.nodes].count("call") == 3
    assert X._Dag(X.parse("true ? 1 : 1.0")).nodes[-1][1] == (0, 1, 1)


def test_formulas_by_key_share_one_pass(spark):
    df = spark.createDataFrame([("p", 3.0, "x"), ("q", 3.0, "y"), ("r", 3.0, "z"), (None, 1.0, "w"), ("s", 0.0, "v"), ("t", 2.0, "u")], "formula string, x double, kind0 string")
    formulas = {"p": "round(ref('x') / 2) + 1", "q": "ref('x') == 3 ? 'three' : null", "s": "1 / ref('x') + 1", "t": "!(ref('x') > 1)"}
    got = X.with_values(df, formulas, lambda key: X._value("number", num=X.F.col("x")), by="formula")
    assert got.columns == ["formula", "x", "kind0", *X.FIELDS]
    assert {r["kind0"]: (r["kind"], r["num"], r["str"], r["bool"], r["error"]) for r in got.collect()} == {
        "x": ("number", 3.0, None, None, None), "y": ("string", None, "three", None, None), "z": (None,) * 5, "w": (None,) * 5, "v": (None, None, None, None, "+ requires a finite number"), "u": ("boolean", None, None, False, None),
    }
    assert X.with_values(df, {}, None, by="formula").filter("kind is not null").count() == 0


@pytest.mark.parametrize(
    "text, paths",
    [
        ("ref('a') + b", ["$.right"]),
        ("1 +", ["$"]),
        ("ref(x)", ["$.arguments[0]", "$.arguments[0]"]),
        ("sum(1, foo(2, y))", ["$.arguments[1].callee", "$.arguments[1].arguments[1]"]),
        ("true ? lag('m', 0) : 5 % z", ["$.consequent.arguments[1]", "$.alternate", "$.alternate.right"]),
        ("(1 && b) * -x.y", ["$.left", "$.right.argument"]),
        ("round()", ["$.arguments"]),
    ],
)
def test_issue_paths(text, paths):
    issues = X.analyze(text).issues
    assert [i.path for i in issues] == paths and all(i.reason and i.suggestion for i in issues)
    assert X.analyze("lag('m', 0)").dependencies == ["m"]


@pytest.mark.parametrize("text", ["", "1 +", "a + 1", "x.y", "[1]", "1 && 2", "5 % 2", "foo(1)", "sum()", "ref(1)", "ref('a', 'b')", "lag('m', 0)", "lag('m', 1.5)", "lag('m', ref('n'))", "period_ref('m')", "(ref)('a')('b')", "1; 2"])
def test_expression_issues(text):
    assert not X.analyze(text).valid


def test_references_in_order():
    found = X.analyze("lag('m') + lead('m', 2) + ref('k') + period_ref('m', 'p') + ref('k')")
    assert [r.key for r in found.references] == ["m|-1", "m|2", "k|0", "m|period:p"] and found.dependencies == ["k", "m"]


@given(st.recursive(st.integers(-9, 9).map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=8))
@settings(max_examples=15, deadline=None)
def test_arithmetic_agrees_with_python(spark, text):
    assert value_of(spark, text) == float(eval(text))


def test_round_trip(db):
    grouped = M.group_series(db.observations)
    assert grouped.count() == 12
    flat = M.flatten_series(grouped)
    assert sorted(map(tuple, flat.select(db.observations.columns).collect()), key=repr) == sorted(map(tuple, db.observations.collect()), key=repr)


def test_files(spark, tmp_path):
    text = json.dumps(document())
    (tmp_path / "a.bin").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "b.json").write_text(text)
    for name in ("a.bin", "b.json"):
        assert model_json.read_model(spark, f"file://{tmp_path}/{name}").observations.count() == 60
    assert model_json.parse_document(model_json.decode(model_json.encode_gzip(document()))) == document()
    with pytest.raises(model_json.MalformedJson):
        model_json.parse_document("{")
    with pytest.raises(model_json.InvalidDocument):
        model_json.parse_document('{"schemaVersion": "0.2.0"}')
    with pytest.raises(model_json.InvalidDocument):
        model_json.decode(gzip.compress(b"x" * 1000), cap=100)


def test_observation_lines_round_trip(spark, db, tmp_path):
    more = db.observations.filter("ord < 3").withColumns({"id": F.concat("id", F.lit("_"), "ord"), "kind": F.element_at(F.array(F.lit("string"), F.lit("boolean"), F.lit("null")), (F.col("ord") + 1).cast("int")), "num": F.lit(None).cast("double"), "str": F.when(F.col("ord") == 0, "12"), "bool": F.when(F.col("ord") == 1, True)})
    both = db.observations.unionByName(more)
    model_json.write_observations(both, f"file://{tmp_path}/lines")
    names = [c for c in both.columns if c != "ord"]
    back = model_json.read_observations(spark, f"file://{tmp_path}/lines")
    assert sorted(map(tuple, back.select(names).collect()), key=repr) == sorted(map(tuple, both.select(names).collect()), key=repr)


def test_gzip_in_parts(tmp_path):
    raw = json.dumps(document()).encode()
    assert model_json.decode(gzip.compress(raw[:100]) + gzip.compress(raw[100:])) == raw.decode()
    with pytest.raises(model_json.MalformedJson):
        model_json.decode(gzip.compress(raw)[:-20])


def test_sections_and_detail(spark, db):
    table = series.sectioned_table(db.replace(presentations=db.presentations.limit(0)), scenario="scenario_base").filter("model_id = 'model_alder'").orderBy("pos").collect()
    assert {r["section_title"] for r in table} == {"Model metrics"} and {r["section_id"] for r in table} == {"section_alder_metrics"}
    assert [(r["metric_id"], r["depth"]) for r in table] == [("metric_outlay", 0), ("metric_surplus", 0), ("metric_surplus_rate", 0), ("metric_turnover", 0), ("metric_licences", 1), ("metric_support", 1)]
    assert table[0]["cells"]["period_y23"]["num"] == 410
    shown = series.sectioned_table(db, scenario="scenario_base", query="SUPPORT").collect()
    assert [(r["section_id"], r["metric_id"]) for r in shown] == [("section_1", "metric_support")]
    detail = {r["id"]: r for r in review.observation_detail(db, lineage.resolve_inputs(db)).collect()}
    mine = detail["obs_turnover_y24"]
    assert [(x["in_id"], x["n_provenance"]) for x in mine["inputs"]] == [("obs_licences_y24", 1), ("obs_support_y24", 1)]
    assert [x["dependent_id"] for x in mine["dependents"]] == ["obs_surplus_y24", "obs_surplus_rate_y24"] and [x["item_id"] for x in mine["open_items"]] == ["item_1"]
    assert len(detail) == 60 and detail["obs_wages_y21"]["inputs"] is None
    over = {r["model_id"]: r for r in series.model_overview(db).collect()}
    assert (over["model_alder"]["n_transformations"], over["model_alder"]["n_unreviewed"], over["model_birch"]["n_open"]) == (3, 25, 0)
    view = series.initial_view(db, period_type="fiscal_year").head()
    assert tuple(view) == ("model_alder", "presentation_1", "entity_alder", "fiscal_year")


def test_broken_provenance_is_an_error(spark, db):
    stray = db.replace(provenance_contexts=db.provenance_contexts.limit(0))
    with pytest.raises(Exception, match="no context of provenance"):
        review.provenance(stray).collect()
    assert review.provenance(stray, strict=False).count() == 60
    with pytest.raises(Exception, match="broken provenance"):
        review.provenance_sources(db.replace(extraction_runs=db.extraction_runs.limit(0))).collect()


def test_lookups(db):
    with pytest.raises(KeyError):
        M.get_model(db, "model_none")
    assert M.get_metric(db, "metric_wages").head()["name"] == "wages" and M.get_observation(db, "obs_none").count() == 0
    assert M.source_expression(db, "transformation_turnover", "period_y21").head()["formula"] == "=B1"
    assert M.editable(db).filter("editable").count() == 35


def test_cells_name_periods_of_their_own_model(spark, db):
    """Two models with one sheet name: a cell stands for the period of the item's model alone."""
    place = db.provenance_records.withColumn("cell", F.when(F.col("target_id") == "obs_wages_y21", "B11").otherwise(F.col("cell")))
    item = db.unresolved_items.withColumns({"target_id": F.lit("model_birch"), "sheet": F.lit("Model"), "cell": F.lit("$B$11")})
    row = review.attention_queue(db.replace(provenance_records=place, unresolved_items=item)).head()
    assert (row["model_id"], row["period_id"], row["label"]) == ("model_birch", "period_y21", "model_birch")


def test_series_and_table(db):
    rows = series.metric_series(db, metric_id="metric_turnover").orderBy("period_id").collect()
    assert [r["num"] for r in rows] == VALUES["metric_turnover"]
    table = series.financial_table(db)
    assert table.count() == 60
    modes = {r["period_id"]: (r["mode"], r["boundary"]) for r in series.period_modes(table).filter("entity_id = 'entity_birch'").collect()}
    assert modes["period_y23"] == ("actual", False) and modes["period_y24"] == ("estimate", True)
    assert [r["type"] for r in series.period_types(db).filter("model_id = 'model_birch'").collect()] == ["fiscal_year"]


def test_latest_known_value_wins_and_first_breaks_ties(spark, db):
    later = db.observations.filter("id = 'obs_outlay_y21'").withColumn("as_of", F.lit("2025-04-01")).withColumn("num", F.lit(1.0)).withColumn("ord", F.lit(100).cast("long"))
    same = later.withColumn("num", F.lit(2.0)).withColumn("ord", F.lit(101).cast("long"))
    more = db.replace(observations=db.observations.unionByName(later).unionByName(same))
    pick = lambda d: series.metric_series(more, d, metric_id="metric_outlay").filter("period_id = 'period_y21'").head()["num"]
    assert (pick("2025-03-31"), pick("2025-04-30")) == (300, 1.0)


def test_lineage_both_ways(db):
    inputs = lineage.resolve_inputs(db)
    found = {(r["out_id"], r["in_id"]) for r in inputs.collect()}
    assert ("obs_turnover_y24", "obs_licences_y24") in found and len(found) == sum(2 if "sum" in e or "?" in e else e.count("ref(") for e in FORMULAS.values()) * 5
    dependents = lineage.direct_dependents(inputs)
    assert [r["dependent_id"] for r in dependents.filter("id = 'obs_licences_y24'").collect()] == ["obs_turnover_y24"]
    start = db.observations.filter("id = 'obs_licences_y24'").select("id")
    levels = {r["id"]: r["level"] for r in lineage.closure(dependents, start).collect()}
    assert levels == {"obs_licences_y24": 0, "obs_turnover_y24": 1, "obs_surplus_y24": 2, "obs_surplus_rate_y24": 3}
    assert {r["id"] for r in lineage.reached(dependents, start).collect()} == set(levels)


def test_edit_propagates(spark, db):
    edits = spark.createDataFrame([("obs_licences_y24", 1000.0)], "id string, num double")
    after, changes = lineage.edit_values(db, edits)
    got = {r["id"]: (r["before"], r["after"], r["direct"]) for r in changes.collect()}
    assert got == {"obs_licences_y24": (905, 1000, True), "obs_turnover_y24": (1095, 1190, False), "obs_surplus_y24": (700, 795, False), "obs_surplus_rate_y24": (round(700 / 1095, 6), 795 / 1190, False)}
    assert after.observations.count() == 60
    status = {r["target_id"]: r["review_status"] for r in after.provenance_records.collect()}
    assert {k for k, v in status.items() if v == "corrected"} == set(got) and db.provenance_records.filter("review_status = 'corrected'").count() == 0
    for bad in (("obs_turnover_y24", 1.0), ("obs_nowhere", 1.0), ("obs_licences_y24", 905.0)):
        with pytest.raises(ValueError):
            lineage.edit_values(db, spark.createDataFrame([bad], "id string, num double"))
    for bad in ({"kind": "string", "str": "x"}, {"kind": "number", "num": float("inf")}):
        row = {"id": "obs_licences_y24", "kind": None, "num": None, "str": None, "bool": None} | bad
        with pytest.raises(ValueError):
            lineage.edit_values(db, spark.createDataFrame([row], "id string, kind string, num double, str string, bool boolean"))


def test_edits_that_break_a_formula_are_refused(spark, db):
    t = db.transformations.withColumn("expression", F.when(F.col("id") == "transformation_surplus_rate", "ref('metric_turnover') / ref('metric_outlay')").otherwise(F.col("expression")))
    with pytest.raises(ValueError, match="does not fit"):
        lineage.edit_values(db.replace(transformations=t), spark.createDataFrame([("obs_outlay_y24", 0.0)], "id string, num double"))
    t = db.transformations.withColumn("expression", F.when(F.col("id") == "transformation_surplus", "lead('metric_turnover') - ref('metric_outlay')").otherwise(F.col("expression")))
    with pytest.raises(ValueError, match="cannot resolve metric_turnover for the requested period"):
        lineage.edit_values(db.replace(transformations=t), spark.createDataFrame([("obs_outlay_y25", 1.0)], "id string, num double"))
    t = db.transformations.withColumn("expression", F.when(F.col("id") == "transformation_turnover", "ref('metric_surplus_rate') + ref('metric_licences')").otherwise(F.col("expression")))
    with pytest.raises(ValueError, match="cycle"):
        lineage.edit_values(db.replace(transformations=t), spark.createDataFrame([("obs_licences_y24", 1.0)], "id string, num double"))


def test_recalculation_follows_long_chains(spark, db):
    """Every level is computed from the levels below it, in whatever order the formulas are declared."""
    blank = db.observations.withColumn("num", F.when(F.col("transformation_id").isNull(), F.col("num"))).withColumn("kind", F.when(F.col("num").isNull(), "null").otherwise(F.col("kind")))
    got = {r["id"]: r["num"] for r in lineage.recalculate(db.replace(observations=blank)).observations.collect()}
    assert all(abs(got[r["id"]] - r["num"]) < 1e-6 for r in db.observations.collect())


def test_many_formulas_in_chunks(db, monkeypatch):
    want = sorted(map(tuple, lineage.evaluate(db, lineage.resolve_inputs(db)).collect()))
    monkeypatch.setattr(lineage, "FORMULAS", 2)
    assert sorted(map(tuple, lineage.evaluate(db, lineage.resolve_inputs(db)).collect())) == want and len(want) == 25


def test_lag_walks_the_axis_of_all_metrics(spark, db):
    t = db.transformations.filter("id = 'transformation_turnover'").withColumn("expression", F.lit("lag('metric_outlay') + lead('metric_outlay')"))
    gap = db.replace(transformations=t, observations=db.observations.filter("id <> 'obs_outlay_y22'"))
    got = {r["out_id"]: (r["error"], r["num"]) for r in lineage.evaluate(gap, lineage.resolve_inputs(gap)).collect()}
    assert got["obs_turnover_y23"][0] == "cannot resolve metric_outlay for Y22"
    assert got["obs_turnover_y25"][0] == "cannot resolve metric_outlay for the requested period"
    assert got["obs_turnover_y24"] == (None, 410 + 420)


def test_later_rules(spark):
    d = copy.deepcopy(document())
    d["tablePresentations"].append({"modelId": "model_alder", "sections": [{"id": "section_1", "title": "t", "metricIds": ["metric_outlay", "metric_support"], "metricParentIds": {"metric_outlay": "metric_support", "metric_support": "metric_gone"}}]})
    d["transformations"][0] |= {"expression": "ref('metric_surplus')"}
    d["transformations"][3] |= {"status": "opaque", "expression": None}
    d["extractionRuns"][0]["status"] = "completed"
    # the item's own provenance counts, not that of its target
    d["provenanceRecords"].append({"targetId": next(i["id"] for i in d["unresolvedItems"] if i["status"] == "open"), "contextId": d["provenanceContexts"][0]["id"]})
    d["decisionChanges"] = [{"id": "change_1", "before": 1, "after": "x"}, {"id": "change_2", "before": 1, "after": 2}]
    d["relationships"] += [{"id": "relationship_3", "fromId": "metric_turnover", "type": "component_of", "toId": "metric_support"}]
    found = {(r["code"], r["object_id"]) for r in validate.validate(model_json.from_document(spark, d)).collect()}
    codes = {c for c, _ in found}
    assert {"presentation.duplicate_section", "presentation.parent_unknown", "presentation.parent_order", "presentation.id_required", "presentation.title_required", "presentation.missing", "transformation.opaque_action_required", "transformation.cycle", "relationship.component_cycle", "decision_change.value_type", "extraction_run.open_attention", "unresolved.needs_review"} <= codes
    assert ("decision_change.value_type", "change_2") not in found
    cyclic = {o for c, o in found if c == "transformation.cycle"}
    assert cyclic == {"metric_surplus"}


def test_contract(spark, db):
    codes = lambda d: sorted((r["object_id"], r["field"]) for r in validate.contract(model_json.from_document(spark, d)).collect())
    assert codes(document()) == []
    d = document()
    d["models"][0]["baseCurrency"] = "US"
    d["models"][1]["versionIds"] = []
    d["entities"][0]["type"] = "planet"
    d["metrics"][0] |= {"name": "", "aggregation": "mode"}
    d["periods"][0]["startDate"] = "2021-02-30"
    d["observationSeries"][0]["points"][0] |= {"id": "Obs-1", "actuality": "guess"}
    d["observationSeries"][0]["points"][1]["value"] = float("inf")
    d["transformations"][0]["expression"] = ""
    d["provenanceContexts"][0]["confidence"] = 1.5
    d["unresolvedItems"][0] |= {"attentionLevel": "action_required", "impact": None}
    d["dataset"]["createdAt"] = "yesterday"
    d["relationships"][0]["type"] = None
    wrong = {("model_alder", "baseCurrency"), ("model_birch", "versionIds"), ("entity_alder", "type"), ("metric_turnover", "name"), ("metric_turnover", "aggregation"), ("period_y21", "startDate"), ("Obs-1", "id"), ("Obs-1", "actuality"), ("obs_turnover_y22", "value"), ("transformation_turnover", "expression"), ("context_1", "confidence"), ("item_1", "actionOwner"), ("item_1", "impact"), ("dataset_one", "createdAt"), ("relationship_1", "type")}
    assert codes(d) == sorted(wrong)


def test_parents_of_metrics_that_are_not_shown(spark):
    d = document()
    d["tablePresentations"][0]["sections"][0]["metricParentIds"] = {"metric_gone": "metric_turnover", "metric_support": "metric_turnover"}
    found = {(r["code"], r["object_id"]) for r in validate.presentation_parents(model_json.from_document(spark, d)).collect()}
    assert found == {("presentation.parent_metric_unknown", "presentation_1/section_1/metric_gone")}


def test_person_keys_are_left_out():
    value = {"author": "a", "x": [{"Last_Modified_By": "b", "y": 1}], "z": {"creator": "c", "Authors": []}}
    assert model_json.without_persons(value) == {"x": [{"y": 1}], "z": {}}


def test_validator(spark, db):
    assert {r["code"] for r in validate.validate(db).collect()} == {"presentation.missing", "unresolved.needs_review", "provenance.missing"}
    broken = copy.deepcopy(document())
    broken["observationSeries"][0]["points"][0]["periodId"] = "period_gone"
    broken["observationSeries"][1]["points"][0]["value"] = "text"
    broken["observationSeries"][2]["points"].append(broken["observationSeries"][2]["points"][0])
    broken["observationSeries"].append(broken["observationSeries"][3] | {"points": []})
    broken["transformations"][0]["expression"] = "a +"
    broken["unresolvedItems"][0]["category"] = "source_error"
    broken["models"][0]["currentVersionId"] = "version_9"
    broken["relationships"][0]["toId"] = "model_birch"
    codes = {r["code"] for r in validate.validate(model_json.from_document(spark, broken)).collect()}
    assert {"reference.missing", "observation.value_type", "observation.duplicate_point", "observation_series.duplicate", "transformation.expression", "unresolved.repair_required", "model.current_version", "relationship.component_metric", "id.duplicate", "transformation.source_without_output"} <= codes


def test_review(db):
    queue = review.attention_queue(db).collect()
    assert [(r["model_id"], r["metric_id"], r["cell"], r["row"], r["label"]) for r in queue] == [("model_alder", "metric_turnover", "E10", 10, "turnover · Y24")]
    done = review.confirm_item(db, "item_1")
    assert review.attention_queue(done).count() == 0 and review.attention_queue(db).count() == 1
    with pytest.raises(ValueError):
        review.confirm_item(done, "item_1")
    status = {r["target_id"]: r["review_status"] for r in review.provenance(db).collect()}
    assert status["obs_turnover_y21"] == "confirmed" and status["obs_outlay_y21"] == "unreviewed"
    assert {r["review_status"] for r in done.provenance_records.filter("target_id = 'obs_turnover_y24'").collect()} == {"confirmed"}
    assert {r["presentation_id"] for r in review.navigation_targets(db).collect()} == {"presentation_1"}


def test_hierarchy(spark, db):
    got = {r["metric_id"]: (r["parent_id"], r["depth"]) for r in hierarchy.metric_hierarchy(db).collect()}
    assert got["metric_support"] == ("metric_turnover", 1) and got["metric_outlay"] == (None, 0) and len(got) == 12
    items = spark.createDataFrame([("g", 1, "a", None), ("g", 2, "b", "a"), ("g", 3, "c", "b"), ("g", 4, "d", "e"), ("g", 5, "e", "x")], "group string, pos int, id string, parent_id string")
    assert {r["id"]: r["depth"] for r in hierarchy.ordered_depths(items).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0}
    assert {(r["id"], r["issue"]) for r in hierarchy.parent_issues(items).collect()} == {("d", "parent_order"), ("e", "unknown_parent")}
    stray = spark.createDataFrame([("g", "z", "a"), ("g", "y", "x")], "group string, id string, parent_id string")
    assert sorted((r["id"], r["issue"]) for r in hierarchy.parent_issues(items, stray).collect()) == [("y", "unknown_child"), ("y", "unknown_parent"), ("z", "unknown_child")]
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None), ("f", "f")], "id string, parent_id string")
    assert {(r["cycle"], r["size"]) for r in hierarchy.parent_cycles(parents).collect()} == {("a", 3), ("f", 1)}


def test_formats(spark):
    rows = [("null", None, None, None, "number"), ("number", -1234.56, None, None, "currency"), ("number", 0.1234, None, None, "percentage"), ("number", 12.0, None, None, "count"), ("number", 0.25, None, None, "number"), ("number", 2.5, None, None, "count"), ("number", -0.0315, None, None, "percentage"), ("number", 1.005, None, None, "number"), ("boolean", None, None, True, "boolean"), ("string", None, "x", None, "text"), ("number", 1e24, None, None, "number")]
    df = spark.createDataFrame(rows, "kind string, num double, str string, bool boolean, type string")
    show = lambda inspector: [r[0] for r in df.select(S.format_value(F.col("kind"), F.col("num"), F.col("str"), F.col("bool"), F.col("type"), inspector)).collect()]
    assert show(False)[:-1] == ["—", "(1,234.6)", "12.3%", "12", "0.3", "3", "-3.2%", "1.0", "Yes", "x"]
    assert show(True)[:-1] == ["—", "-1,234.56", "12.34%", "12", "0.25", "3", "-3.15%", "1.01", "Yes", "x"]
    assert show(True)[-1].startswith("1,000,000")


@given(st.lists(st.sampled_from(["commit", "undo", "redo", "reset"]), max_size=60))
@settings(max_examples=100, deadline=None)
def test_history_steps(actions):
    """Undo and redo walk a list of versions of which at most twenty lie behind."""
    state, versions, at = ([], 0, []), [0], 0
    for i, action in enumerate(actions, 1):
        state = records.history_step(state, action, i, 20)
        if action == "commit":
            versions = versions[: at + 1] + [i]
            versions, at = versions[-21:], min(at + 1, 20)
        elif action == "undo":
            at = max(at - 1, 0)
        elif action == "redo":
            at = min(at + 1, len(versions) - 1)
        else:
            versions, at = [0], 0
        assert state[1] == versions[at] and state[0] == versions[:at] and state[2] == versions[at + 1 :]


def test_navigation_steps():
    state = ([], None)
    for action, target in [("inspect", "a"), ("inspect", "a"), ("inspect", "b"), ("inspect", "c"), ("back", None)]:
        state = records.navigation_step(state, action, target, 24)
    assert state == (["a"], "b") and records.navigation_step(state, "close", None, 24) == ([], None) and records.navigation_step(state, "replace", "z", 24) == ([], "z")
    for i in range(40):
        state = records.navigation_step(state, "inspect", i, 24)
    assert len(state[0]) == 24 and records.navigation_step(([], "q"), "back", None, 24) == ([], "q")


def test_history_stream(spark, tmp_path):
    from tessera.streaming.edit_log import history_stream

    rows = [(1, i, i + 1, a, i + 1) for i, a in enumerate(["commit", "commit", "undo", "redo"])]
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, action string, value long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = history_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").format("memory").queryName("edits").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("edits").collect()[-1].asDict() == {"user_id": 1, "present": 2, "n_past": 1, "n_future": 0} | {"n_past": 2}


@pytest.mark.parametrize("formula, rows, cols, want", [("=B1*2", 1, 0, "=B2*2"), ("=$B$1+C$2+$D3", 2, 1, "=$B$1+D$2+$D5"), ('=SUM(A1:B2)&"A1"', 1, 1, '=SUM(B2:C3)&"A1"'), ("='A1 x'!A1+LOG10(A1)", 0, 1, "='A1 x'!B1+LOG10(B1)"), ("=Z9", 0, 1, "=AA9")])
def test_formula_shift(formula, rows, cols, want):
    assert xlsx.shift_formula(formula, rows, cols) == want


def test_formula_shift_off_the_sheet():
    with pytest.raises(ValueError):
        xlsx.shift_formula("=A1", -1, 0)


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    inline = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    sheet = f'<worksheet {main}><sheetData><row r="1">{inline("A1", "Trips")}<c r="B1" s="1"><v>7</v></c><c r="C1" s="2"><v>9</v></c></row><row r="2">{inline("A2", "Fuel")}<c r="B2"><f t="shared" si="0" ref="B2:B3">B1+5</f><v>12</v></c><c r="C2"><f>C1-$B$1</f><v>2</v></c></row><row r="3">{inline("A3", "Reserve")}<c r="B3"><f t="shared" si="0"/><v>17</v></c></row></sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Model" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="c1" Type="http://x/comments" Target="../comments1.xml"/></Relationships>')
        z.writestr("xl/comments1.xml", f'<comments {main}><authors><author>Ann</author></authors><commentList><comment ref="B2" authorId="0"><text><r><t>Ann: check</t></r></text></comment></commentList></comments>')
    (tmp_path / "m.xlsx").write_bytes(out.getvalue())
    cells = xlsx.read_cells(spark, f"file://{tmp_path}/m.xlsx")
    got = {r["cell"]: (r["value"], r["formula"]) for r in cells.collect()}
    assert len(got) == 8 and got["B3"] == ("17", "=B2+5") and got["A1"] == ("Trips", None)
    row = xlsx.inventory(cells).head()
    assert (row["stored"], row["formulas"], row["external"]) == (8, 3, 0)
    assert [tuple(r)[1:] for r in xlsx.read_comments(spark, f"file://{tmp_path}/m.xlsx").collect()] == [("Model", "B2", "check")]
    assert xlsx.read_cells(spark, f"file://{tmp_path}/m.xlsx", sheets=["Other"]).count() == 0
    assert [r["number_format"] for r in xlsx.read_styles(spark, f"file://{tmp_path}/m.xlsx").collect()] == ["General"]


def test_styles_sheets_and_parts(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet {main}><dimension ref="A1:C9"/><sheetViews><sheetView><pane topLeftCell="B2"/></sheetView></sheetViews><cols><col min="3" max="5" hidden="1"/></cols><sheetData><row r="1"><c r="A1" s="1"><v>1</v></c><c r="B1" s="9"><v>2</v></c></row><row r="4" hidden="1"/><row r="5" hidden="true"/><row r="8" hidden="1"/></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells><conditionalFormatting sqref="A1"><cfRule type="x"/><cfRule type="y"/></conditionalFormatting></worksheet>'
    styles = f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="0.0x"/></numFmts><fonts><font><name val="Serif"/></font><font><b/><i val="0"/><color rgb="FF0000CC"/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor theme="4" tint="0.5"/></patternFill></fill></fills><borders><border><left/></border><border><left style="thin"/><top style="thin"/></border></borders><cellXfs><xf numFmtId="9"/><xf numFmtId="170" fontId="1" fillId="1" borderId="1"/></cellXfs></styleSheet>'
    theme = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:clrScheme><a:accent1><a:srgbClr val="4466AA"/></a:accent1></a:clrScheme></a:themeElements></a:theme>'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Plan" sheetId="1" state="hidden" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        for part, text in (("worksheets/sheet1.xml", sheet), ("styles.xml", styles), ("theme/theme1.xml", theme), ("vbaProject.bin", ""), ("externalLinks/a.xml", ""), ("media/p.EMF", "")):
            z.writestr(f"xl/{part}", text)
    path = f"file://{tmp_path}/s.xlsx"
    shown = xlsx.with_styles(xlsx.read_cells(spark, path), xlsx.read_styles(spark, path)).collect()
    got = {r["cell"]: (r["number_format"], r["bold"], r["italic"], r["font_colour"], r["fill"], r["fill_colour"], r["n_borders"]) for r in shown}
    assert got == {"A1": ("0.0x", True, False, "0000CC", "solid", "4466AA 0.5", 2), "B1": ("0%", False, False, None, "none", None, 0)}
    row = xlsx.read_sheets(spark, path).head()
    assert tuple(row)[1:] == ("Plan", "hidden", "A1:C9", "B2", ["A1:B1"], [4, 5, 8], [3, 4, 5], 2, 0)
    hidden = xlsx.read_sheets(spark, path).select("sheet", F.explode("hidden_rows").alias("n"))
    assert {tuple(r)[1:] for r in hierarchy.consecutive_ranges(hidden, "sheet", "n").collect()} == {(4, 5), (8, 8)}
    assert {r["part"]: r["risk"] for r in xlsx.read_parts(spark, path).filter("risk is not null").collect()} == {"xl/vbaProject.bin": "macros", "xl/externalLinks/a.xml": "external_links", "xl/media/p.EMF": "media"}


def test_entry_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k[:2] == 'op' and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
