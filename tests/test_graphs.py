"""Strong components, cycles and strata, recalculation by steps, and the rules of the validator that lean on them."""

import copy
import random

import pytest
from pyspark.sql import functions as F

from model_fixture import document
from tessera.operators import graphs, lineage, records, validate
from tessera.plans.hold import numbered
from tessera.plans.model_db import ModelDb
from tessera.sources import model_json, xlsx


def as_dict(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    return out


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    for a, b in edges:
        reach[a].add(b)
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    return {frozenset(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_and_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(18), rng.randrange(18)) for _ in range(22)] + [(30, 31), (31, 30), (31, 40), (40, 50), (50, 51), (51, 50), (60, 60)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = graphs.strong_components(df)
    groups = {}
    for r in found.collect():
        groups.setdefault(r["component"], set()).add(r["id"])
    want = brute_components(edges)
    assert {frozenset(g) for g in groups.values()} == want and all(max(g) == c for c, g in groups.items())
    assert not any(40 in g for g in want)  # between two cycles, on none
    small = [c for c in graphs.small_components(as_dict(edges)) if frozenset(c) in want]
    assert {frozenset(c) for c in small} == want
    paths = sorted(r["path"] for r in graphs.shortest_cycles(df, found).collect())
    assert paths == sorted(graphs.small_cycles(as_dict(edges))) and len(paths) == len(want)
    assert all((a, b) in edges for p in paths for a, b in zip(p, p[1:], strict=False))


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert graphs.strong_components(df).count() == 0
    assert graphs.shortest_cycles(df, graphs.strong_components(df)).count() == 0


def test_strata():
    s = graphs.formula_strata({"a": [], "b": [("a", 0, False)], "c": [("b", 0, False), ("c", -1, False)], "d": [("e", -2, False), ("c", 3, False)], "e": [("d", 0, False)], "f": [("f", 1, False), ("f", -1, False)], "g": [("h", 0, False)], "h": [("g", 0, False)], "i": [("i", 0, True)], "j": [("i", 5, False)], "k": [("k", 1, False)]})
    assert (s["a"], s["b"], s["c"]) == ((0, "once", 0), (1, "once", 0), (2, "forward", 0))
    assert s["d"] == (3, "forward", 0) and s["e"] == (3, "forward", 1)
    assert {s[x][1] for x in "fghi"} == {"cells"} and s["j"] == (1, "once", 0) and s["k"][1] == "backward"


def chain_db(spark, n, expression, first):
    """A base metric of ones, and a metric that ``expression`` chains over n quarters; quarter ``first`` is given."""
    q = spark.range(n).select(F.format_string("p%04d", "id").alias("id"), F.format_string("Q%d", "id").alias("label"), F.lit("fiscal_quarter").alias("type"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") * 91).cast("int")).alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    cell = lambda metric, derived: q.select(
        F.lit("m").alias("model_id"), F.lit(metric).alias("metric_id"), F.lit("e").alias("entity_id"), F.lit("2020-01-01").alias("as_of"), F.lit("v").alias("version_id"), F.concat(F.lit(f"{metric}_"), "id").alias("id"), F.col("id").alias("period_id"),
        F.lit(None).cast("string").alias("scenario_id"), F.lit("actual").alias("actuality"), F.lit("number").alias("kind"), F.lit(1.0).alias("num"), F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool"),
        F.lit("derived" if derived else "reported").alias("value_type"), (F.when(F.col("id") != f"p{first:04d}", "t") if derived else F.lit(None).cast("string")).alias("transformation_id"), F.substring("id", 2, 9).cast("long").alias("ord"),
    )
    t = spark.createDataFrame([("t", "chain", "supported", expression, 0)], "id string, output_metric_id string, status string, expression string, ord long")
    return ModelDb({"observations": cell("base", False).unionByName(cell("chain", True)), "periods": q, "transformations": t})


@pytest.mark.parametrize("expression, first, last", [("lag('chain') + ref('base')", 0, 11), ("lead('chain') + ref('base')", 11, 0)])
def test_chains_over_periods_go_step_by_step(spark, expression, first, last):
    db = chain_db(spark, 12, expression, first)
    inputs = lineage.resolve_inputs(db)
    assert lineage.steps(db, inputs).select("step").distinct().count() == 11
    got = {r["period_id"]: r["num"] for r in lineage.recalculate(db).observations.filter("metric_id = 'chain'").collect()}
    assert got[f"p{last:04d}"] == 12.0 and sorted(got.values()) == [float(k) for k in range(1, 13)]


def test_chains_by_cells_agree(spark):
    """A formula that looks both ways in time has no order but that of its cells; at one end nothing is to be found."""
    db = chain_db(spark, 6, "ref('base') == 1 ? lag('chain') * 2 : lead('chain')", 0)
    mixed = graphs.formula_strata({"t": [("t", -1, False), ("t", 1, False)]})
    assert mixed["t"][1] == "cells"
    with pytest.raises(ValueError, match="cycle"):
        lineage.recalculate(db)
    named = chain_db(spark, 4, "period_ref('chain', 'p0000') + 1", 0)
    got = {r["period_id"]: r["num"] for r in lineage.recalculate(named).observations.filter("metric_id = 'chain'").collect()}
    assert got == {"p0000": 1.0, "p0001": 2.0, "p0002": 2.0, "p0003": 2.0}


def test_cycle_paths(spark):
    d = copy.deepcopy(document())
    d["transformations"][0] |= {"expression": "ref('metric_surplus')"}
    d["transformations"] += [{"id": f"transformation_x{i}", "outputMetricId": m, "status": "supported", "expression": e} for i, (m, e) in enumerate([("metric_p", "ref('metric_q') + ref('metric_r')"), ("metric_q", "lag('metric_p')"), ("metric_r", "ref('metric_r')"), ("metric_s", "ref('metric_p')")])]
    found = [(r["metric_id"], r["path"]) for r in validate.formula_cycles(model_json.from_document(spark, d)).collect()]
    cells = [p for m, p in found if "[" in p]
    assert {p for m, p in found if "[" not in p} == {"metric_p -> metric_q -> metric_p", "metric_r -> metric_r"}
    assert cells and all(p.startswith("metric_surplus[") and p.split(" -> ")[0] == p.split(" -> ")[-1] and len(p.split(" -> ")) == 3 for p in cells)


@pytest.mark.parametrize("small", [0, 10_000])
def test_formulas_are_not_parsed_on_the_driver(spark, monkeypatch, small):
    """Cycles as tables and on the driver are the same; formulas are parsed in tasks either way."""
    monkeypatch.setattr(validate.expressions, "analyze", lambda text: pytest.fail("parsed on the driver"))
    monkeypatch.setattr(validate, "SMALL", small, raising=False)
    test_cycle_paths(spark)


def test_loose_metrics_as_tables_and_on_the_driver(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"t{k}", f"m{g}_{rng.randrange(4)}", f"m{g}_{rng.randrange(4)}", 0 if named else rng.choice(offsets), named) for g in range(16) for offsets in [rng.choice([[-1], [1, 0], [-1, 0], [-1, 1], [0]])] for k in range(6) for named in ["p" if rng.random() < 0.04 else None]]
    reads = spark.createDataFrame(rows, "transformation_id string, from_metric string, to_metric string, offset int, named string")
    found = []
    for small in (0, 10_000):
        monkeypatch.setattr(validate, "SMALL", small)
        found.append(sorted(map(str, validate._loose(reads, validate.held).collect())))
    assert found[0] == found[1] and 0 < len(found[0]) < len(rows)


def test_items_speak_for_what_they_name(spark):
    """Planted differences: an item of no model, one of a model that has a presentation, affected targets, provenance of a target."""
    d = copy.deepcopy(document())
    item = {"category": "presentation", "description": "d", "attentionLevel": "needs_review", "status": "open"}
    d["models"].append(d["models"][0] | {"id": "model_bare"})
    d["models"].append(d["models"][0] | {"id": "model_told"})
    d["transformations"][3] |= {"status": "opaque", "expression": None}
    d["unresolvedItems"] = [
        item | {"id": "item_none"}, item | {"id": "item_shown", "modelId": "model_alder"}, item | {"id": "item_told", "modelId": "model_told"}, item | {"id": "item_again", "modelId": "model_told"},
        item | {"id": "item_act", "category": "formula", "attentionLevel": "action_required", "targetId": "metric_outlay", "affectedTargetIds": [d["transformations"][3]["id"]]},
        item | {"id": "item_idle", "category": "formula", "attentionLevel": "action_required", "targetId": d["transformations"][3]["id"]},
    ]
    d["extractionRuns"][0]["status"] = "completed"
    d["provenanceRecords"] = [{"targetId": "metric_outlay", "contextId": d["provenanceContexts"][0]["id"]}]
    shown = d["tablePresentations"][0]
    shown["sections"].append(copy.deepcopy(shown["sections"][0]))
    db = model_json.from_document(spark, d)
    rows = lambda rule: sorted((r["code"], r["object_id"]) for r in rule(db).collect())
    bare = [m["id"] for m in d["models"] if m["id"] not in {p["modelId"] for p in d["tablePresentations"]}]
    assert rows(validate.presentation_missing) == sorted(("presentation.fallback" if m == "model_told" else "presentation.missing", m) for m in bare)
    assert rows(validate.transformation_opaque) == [("transformation.opaque", d["transformations"][3]["id"])]
    assert rows(validate.open_items) == [("unresolved.action_required", "item_idle"), ("unresolved.needs_review", "item_again"), ("unresolved.needs_review", "item_none"), ("unresolved.needs_review", "item_shown")]
    assert rows(validate.extraction_run_open_attention) == []
    d["provenanceRecords"] += [{"targetId": "item_none", "contextId": d["provenanceContexts"][0]["id"]}]
    db = model_json.from_document(spark, d)
    assert rows(validate.extraction_run_open_attention) == [("extraction_run.open_attention", d["extractionRuns"][0]["id"])]
    assert ("presentation.duplicate_section", shown["sections"][0]["id"]) in rows(validate.presentation_duplicate_section)


def test_numbers_without_one_task(spark):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("v"), (F.col("id") % 3).alias("w"))
    assert all(r["number"] == r["v"] + 1 for r in numbered(df, ["v"]).collect())
    rows = [(5, "a", None, 1), (3, "a", None, 2), (4, "b", 1.5, 3), (1, "b", 1.5, 4), (2, None, None, 5)]
    found = records.distinct_records(spark.createDataFrame(rows, "seen int, x string, y double, note int"), "seen", without=("note",))
    assert sorted(map(tuple, found.collect())) == [(1, "b", 1.5, 4, 1), (2, None, None, 5, 2), (3, "a", None, 2, 3)]
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_two_source_formulas_for_a_period_are_an_error(spark):
    cells = spark.createDataFrame([("m", "s", "e", "p1", "=A"), ("m", "s", "e", "p2", "=B"), ("m", "s", "e", "p1", "=A")], "output_metric_id string, status string, expression string, period_id string, formula string")
    assert records.checked_transformations(cells).first()["sources"] == {"p1": "=A", "p2": "=B"}
    twice = cells.unionByName(cells.withColumn("formula", F.lit("=C")))
    assert records.dedup_transformations(twice).first()["conflict"]
    with pytest.raises(Exception, match="two source formulas"):
        records.checked_transformations(twice).collect()


def test_one_file_of_at_most_the_size(spark, tmp_path):
    import json

    text = json.dumps(document())
    (tmp_path / "small.json").write_text(text)
    (tmp_path / "large.json").write_text(text + " " * 5000)
    with pytest.raises(model_json.InvalidDocument, match="several"):
        model_json.read_model(spark, f"file://{tmp_path}/*.json", cap=len(text.encode()) + 10)
    with pytest.raises(model_json.InvalidDocument, match="more than"):
        model_json.read_model(spark, f"file://{tmp_path}/large.json", cap=len(text.encode()) + 10)


def test_theme_colours_are_dark_first():
    from xml.etree import ElementTree as ET

    assert xlsx.THEME[:4] == ["dk1", "lt1", "dk2", "lt2"]
    assert [xlsx._colour(ET.fromstring(f'<c theme="{i}"/>'), ["000000", "FFFFFF"]) for i in (0, 1, 9)] == ["000000", "FFFFFF", "theme9"]
