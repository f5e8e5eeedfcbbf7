"""Registered queries of the model-database operators over the driver's tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import expressions as X
from .functions import scalars as S
from .operators import extraction, graphs, hierarchy, lineage, packages, records, review, series, validate
from .plans import model_db as M
from .plans.hold import hold
from .plans.model_db import ModelDb
from .plans.synth import model_db

AS_OF, SCENARIO = "2001-12-31", "scenario_base"
OBJECTS = ["models", "entities", "metrics", "periods", "scenarios", "transformations", "relationships"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derived_db(spark: SparkSession, sf_dir: str) -> ModelDb:
    """The database with derived metrics; its observations are computed once, as its queries read them several times."""
    db = model_db(spark, sf_dir, with_derived=True)
    return db.replace(observations=hold(db.observations, "observations"))


def observations_flatten(spark, sf_dir):
    return M.flatten_series(M.group_series(model_db(spark, sf_dir).observations)).select("ord", *M.CONTEXT, "id", "period_id", "scenario_id", "num")


def series_regroup(spark, sf_dir):
    grouped = M.group_series(model_db(spark, sf_dir).observations)
    return grouped.select(*M.CONTEXT, "series_ord", F.size("points").alias("n_points"), F.array_join(F.transform("points", lambda p: p["id"]), ",").alias("point_ids"))


def metric_series_asof(spark, sf_dir):
    return series.metric_series(model_db(spark, sf_dir), AS_OF, SCENARIO).select("model_id", "metric_id", "entity_id", "period_id", "as_of", "id", "num")


def metric_series_early(spark, sf_dir):
    return series.metric_series(model_db(spark, sf_dir), "2000-12-31", "scenario_bear", metric_id="metric_gross_revenue").select("model_id", "metric_id", "entity_id", "period_id", "as_of", "id", "num")


def financial_table_long(spark, sf_dir):
    return series.financial_table(model_db(spark, sf_dir), AS_OF, SCENARIO, "fiscal_quarter").select("model_id", "entity_id", "metric_id", "metric_name", "period_id", "period_label", "actuality", "num")


WIDE = [f"period_{y}q{q}" for y in (1998, 1999, 2000) for q in (1, 2, 3, 4)]


def financial_table_wide(spark, sf_dir):
    return series.financial_table_wide(series.financial_table(model_db(spark, sf_dir), AS_OF, SCENARIO), WIDE)


def period_types(spark, sf_dir):
    return series.period_types(model_db(spark, sf_dir))


def model_overview(spark, sf_dir):
    return series.model_overview(reviewed_db(spark, sf_dir))


def database_stats(spark, sf_dir):
    return series.database_stats(reviewed_db(spark, sf_dir))


def sectioned_table(spark, sf_dir):
    table = series.sectioned_table(reviewed_db(spark, sf_dir), scenario=SCENARIO)
    cells = F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["id"])), ",")
    return table.select("model_id", "entity_id", "presentation_id", "section_id", "section_title", "pos", "metric_id", "metric_name", "depth", "sheet", "cell", "n_open", "attention", "derived", F.col("section_place.cell").alias("section_cell"), cells.alias("cells"))


def table_periods(spark, sf_dir):
    return series.table_periods(reviewed_db(spark, sf_dir), scenario=SCENARIO)


def table_search(spark, sf_dir):
    return series.sectioned_table(reviewed_db(spark, sf_dir), scenario=SCENARIO, query="sales").select("model_id", "section_id", "metric_id", "depth")


def initial_view(spark, sf_dir):
    return series.initial_view(reviewed_db(spark, sf_dir), "model_asia", "fiscal_year")


def lineage_highlight(spark, sf_dir):
    db = derived_db(spark, sf_dir)
    return series.highlighted(lineage.resolve_inputs(db), series.series_of_models(db, scenario=SCENARIO))


def metrics_by_source(spark, sf_dir):
    return series.metrics_by_source(reviewed_db(spark, sf_dir))


def observation_detail(spark, sf_dir):
    db = reviewed_db(spark, sf_dir)
    detail = review.observation_detail(db, hold(lineage.resolve_inputs(db)))
    text = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), ","), F.lit(""))
    inputs = text("inputs", lambda x: F.concat_ws("=", x["ref"], x["in_id"], x["n_provenance"]))
    used, items = text("dependents", lambda x: x["dependent_id"]), text("open_items", lambda x: x["item_id"])
    return detail.select("id", "model_name", "entity_name", "metric_name", "period_label", F.coalesce(F.size("provenance"), F.lit(0)).alias("n_provenance"), inputs.alias("inputs"), used.alias("dependents"), items.alias("open_items"))


def provenance_sources(spark, sf_dir):
    return review.provenance_sources(reviewed_db(spark, sf_dir)).select("target_id", "source_artifact_id", "artifact", "run_status", "review_status", "cell")


def attention_by_target(spark, sf_dir):
    return series.open_by_target(reviewed_db(spark, sf_dir))


def editable_cells(spark, sf_dir):
    return M.editable(derived_db(spark, sf_dir))


def presentations_of_model(spark, sf_dir):
    return M.table_presentations(reviewed_db(spark, sf_dir), "model_asia").select("id", "ord")


def object_lookup(spark, sf_dir):
    db = model_db(spark, sf_dir)
    found = M.get_object(db, "metric_growth", OBJECTS).unionByName(M.get_object(db, "model_asia", OBJECTS)).unionByName(M.get_object(db, "nothing", OBJECTS))
    named = M.get_metric(db, "metric_quantity").select("id", F.lit("metric").alias("collection"), F.col("name").alias("label"))
    return found.unionByName(named).unionByName(M.get_model(db, "model_europe").select("id", F.lit("model").alias("collection"), F.col("name").alias("label")))


def observation_lookup(spark, sf_dir):
    return M.get_observation(model_db(spark, sf_dir), "obs_7_quantity_1997q3_actual_2").select("id", "model_id", "metric_id", "as_of", "num")


def queue_order(spark, sf_dir):
    return review.queue_places(review.attention_queue(reviewed_db(spark, sf_dir)))


def attention_unassigned(spark, sf_dir):
    return review.attention_filter(review.attention_queue(reviewed_db(spark, sf_dir)), "unassigned").select("id", "model_id")


def confirmed_item(spark, sf_dir):
    db = reviewed_db(spark, sf_dir)
    items = db.unresolved_items.withColumns({c: F.lit(" x ") for c in ("current_treatment", "impact", "next_action")})
    chosen = items.filter("status = 'open' and attention_level = 'needs_review'").agg(F.min("id")).first()[0]
    after = review.confirm_item(db.replace(unresolved_items=items), chosen)
    return after.unresolved_items.groupBy("status", "attention_level").agg(F.count(F.lit(1)).alias("n"))


def navigation_fold(spark, sf_dir):
    return records.navigation(records.viewer_actions(_read(spark, sf_dir, "events")))


def entities_with_data(spark, sf_dir):
    return M.models_entities(model_db(spark, sf_dir))


def period_modes(spark, sf_dir):
    return series.period_modes(series.financial_table(model_db(spark, sf_dir), AS_OF, SCENARIO)).select("model_id", "entity_id", "period_id", "mode", "boundary")


def object_index(spark, sf_dir):
    return M.object_index(model_db(spark, sf_dir), OBJECTS)


def relationships_both_ways(spark, sf_dir):
    db = model_db(spark, sf_dir)
    return review.relationships_of(db, M.object_index(db, OBJECTS))


def period_axis(spark, sf_dir):
    db = derived_db(spark, sf_dir)
    return lineage.period_axis(db, lineage.outputs(db))


def resolve_inputs(spark, sf_dir):
    return lineage.resolve_inputs(derived_db(spark, sf_dir)).select("out_id", "ref", "in_period", "in_id", "num")


def direct_dependents(spark, sf_dir):
    return lineage.direct_dependents(lineage.resolve_inputs(derived_db(spark, sf_dir)))


def transitive_dependents(spark, sf_dir):
    db = derived_db(spark, sf_dir)
    return lineage.closure(lineage.direct_dependents(lineage.resolve_inputs(db)), db.observations.filter("metric_id = 'metric_gross_revenue'").select("id"))


def dependent_reach(spark, sf_dir):
    db = derived_db(spark, sf_dir)
    start = db.observations.filter("metric_id = 'metric_discount_amount'").select("id")
    return lineage.reached(hold(lineage.direct_dependents(lineage.resolve_inputs(db))), start)


def eval_net_revenue(spark, sf_dir):
    db = derived_db(spark, sf_dir)
    one = db.replace(transformations=db.transformations.filter("id = 'transformation_net_revenue'"))
    return lineage.evaluate(one, lineage.resolve_inputs(one)).select("out_id", "kind", "num", "error")


def eval_errors(spark, sf_dir):
    db = derived_db(spark, sf_dir)
    one = db.replace(transformations=db.transformations.filter("id = 'transformation_growth'"))
    return lineage.evaluate(one, lineage.resolve_inputs(one)).filter("error is not null").select("out_id", "error")


def eval_all(spark, sf_dir):
    return lineage.recalculate(derived_db(spark, sf_dir)).observations.filter("transformation_id is not null").select("id", "kind", "num")


def edit_propagation(spark, sf_dir):
    db = derived_db(spark, sf_dir)
    inputs = hold(lineage.resolve_inputs(db))
    db = lineage.recalculate(db, inputs=inputs)
    edits = db.observations.filter("metric_id = 'metric_gross_revenue' and period_id = 'period_1998q2' and as_of = '2001-12-31'").select("id", (F.col("num") + 1000).alias("num"))
    _, changes = lineage.edit_values(db, edits, inputs=inputs)
    return changes.select("id", "direct", "before", "after")


def edit_provenance(spark, sf_dir):
    db = reviewed_db(spark, sf_dir)
    inputs = hold(lineage.resolve_inputs(db))
    db = db.replace(observations=lineage.recalculate(db, inputs=inputs).observations)
    edits = db.observations.filter("metric_id = 'metric_gross_revenue' and period_id = 'period_1998q2' and as_of = '2001-12-31'").select("id", (F.col("num") + 1000).alias("num"))
    after, _ = lineage.edit_values(db, edits, inputs=inputs)
    return after.provenance_records.select("target_id", "cell", "review_status")


def metric_hierarchy(spark, sf_dir):
    found = hierarchy.metric_hierarchy(reviewed_db(spark, sf_dir))
    return found.select("model_id", "metric_id", "parent_id", "depth", F.array_join("path", ".").alias("path"))


def hierarchy_below(spark, sf_dir):
    return hierarchy.metric_hierarchy(reviewed_db(spark, sf_dir), root_metric_id="metric_net_revenue").select("model_id", "metric_id", "parent_id", "depth")


def forest_depth(spark, sf_dir):
    parts = _read(spark, sf_dir, "part")
    items = parts.select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 > 0, F.floor(F.col("p_partkey") / 5) * 5 + F.col("p_size") % 3).cast("long").alias("parent_id"))
    return hierarchy.ordered_depths(items)


def parent_issues(spark, sf_dir):
    parts = _read(spark, sf_dir, "part")
    items = parts.select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 1000).alias("parent_id"))
    return hierarchy.parent_issues(items)


def component_cycles(spark, sf_dir):
    supplier = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * F.col("s_suppkey") + 1) % 101).alias("parent_id"))
    return hierarchy.parent_cycles(supplier)


def hidden_ranges(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey", "l_orderkey")
    return hierarchy.consecutive_ranges(lines, "l_suppkey", "l_orderkey")


def _lines(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")


def _formula(text: str, df: DataFrame) -> DataFrame:
    columns = {"quantity|0": "l_quantity", "price|0": "l_extendedprice", "discount|0": "l_discount", "tax|0": "l_tax"}

    def lookup(key):
        if key == "flag|0":
            return X._value("string", text=F.col("l_returnflag"))
        return X._value("number", num=F.col(columns[key]) if key in columns else F.col(key))

    return X.with_values(df, {None: text}, lookup).select("l_orderkey", "l_linenumber", *X.FIELDS)


def expr_arithmetic(spark, sf_dir):
    out = _formula("ref('quantity') - 25 + -ref('tax') * 100 == 0 ? null : round(ref('quantity') / (ref('quantity') - 25), 3)", _lines(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "kind", "num", "error")


def expr_round(spark, sf_dir):
    out = _formula("round((ref('quantity') - 25) / 2) + round(ref('tax') * ref('price'), mod(ref('quantity'), 4) - 1) * 1000", _lines(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "num")


def expr_mod(spark, sf_dir):
    out = _formula("mod(ref('quantity') - 25, ref('quantity') > 40 ? 0 - 7 : ref('quantity') > 38 ? 0 : 7)", _lines(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "num", "error")


def expr_minmax(spark, sf_dir):
    out = _formula("max(min(ref('quantity'), 30, ref('discount') * 100), abs(ref('quantity') - 40)) + average(1, 2, ref('quantity'))", _lines(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", F.round("num", 6).alias("num"))


def expr_when(spark, sf_dir):
    out = _formula("when(ref('flag') == 'R', coalesce(null, ref('flag')), when(ref('quantity') < 30, 'small', ref('quantity') == 50 ? 1 / 0 + 1 : null))", _lines(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "kind", "str", "error")


def expr_sum(spark, sf_dir):
    out = _formula("sum(ref('quantity'), ref('tax'), 1 / 4) - coalesce(ref('quantity') == 7 ? null : ref('discount'), 0 - 1)", _lines(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "num", "error")


def locator_parse(spark, sf_dir):
    cells = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.concat(F.lit("$"), F.element_at(F.array(*(F.lit(x) for x in ("a", "B", "aa", "ZZ", "", "Ab1x", "c"))), F.col("l_linenumber")), F.lit("$"), F.col("l_orderkey") % 1000).alias("cell"))
    column = S.cell_column(F.col("cell"))
    return cells.select("l_orderkey", "l_linenumber", S.cell_row(F.col("cell")).alias("row"), column.alias("column"), S.column_number(column).alias("number"))


def formula_kind(spark, sf_dir):
    text = F.element_at(F.array(*(F.lit(x) for x in ("=1+2", "= 50%*2", "=A1*2", "=SUM(3,4)", "", "=1.5e3/2", "=(2-1)^2"))), F.col("l_linenumber"))
    df = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", text.alias("formula"))
    return df.select("l_orderkey", "l_linenumber", S.formula_kind(F.when(F.col("l_orderkey") % 5 == 0, "opaque").otherwise("supported"), F.col("l_orderkey") % 7 == 0, F.col("formula")).alias("formula_kind"))


def _formats(spark, sf_dir, inspector):
    pick = lambda *x: F.element_at(F.array(*(F.lit(v) for v in x)), F.col("l_linenumber"))
    kind = F.when(F.col("l_quantity") == 13, "null").otherwise(pick("number", "number", "number", "number", "number", "string", "boolean"))
    num = F.when(kind == "number", F.when(F.col("l_linenumber").isin(1, 5), F.col("l_quantity") / 32 - 0.75).otherwise(F.col("l_quantity") * 250 - 6000 + F.col("l_linenumber") * 2 / 16 + F.col("l_quantity") / 64))
    data_type = pick("percentage", "count", "currency", "number", "percentage", "text", "boolean")
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", S.format_value(kind, num, F.col("l_returnflag"), F.col("l_quantity") > 25, data_type, inspector).alias("text"))


def number_format(spark, sf_dir):
    return _formats(spark, sf_dir, False)


def inspector_format(spark, sf_dir):
    return _formats(spark, sf_dir, True)


def unique_lookup(spark, sf_dir):
    return records.unique_lookup(_lines(spark, sf_dir), ["l_orderkey"], "l_returnflag")


def transformation_dedup(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    cells = orders.select(F.concat(F.lit("metric_"), F.col("o_custkey") % 50).alias("output_metric_id"), F.lower("o_orderstatus").alias("status"), F.concat(F.lit("ref('m') * "), F.col("o_orderkey") % 3).alias("expression"), F.date_format("o_orderdate", "yyyyMM").alias("period_id"), F.concat(F.lit("=B"), F.col("o_orderkey") % 2).alias("formula"))
    found = records.dedup_transformations(cells)
    sources = F.transform(F.map_entries("sources"), lambda e: F.concat_ws("", e["key"], e["value"]))
    return found.withColumn("sources", F.array_join(sources, ","))


def distinct_records(spark, sf_dir):
    lines = _lines(spark, sf_dir).select("l_returnflag", F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("l_linenumber"), "l_quantity", "l_orderkey")
    return records.distinct_records(lines, "l_orderkey").select("l_returnflag", "l_linenumber", "l_quantity", "l_orderkey", "record")


def context_ids(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    return records.context_ids(orders, ["o_orderstatus", "o_orderpriority"], "o_orderkey")


def function_histogram(spark, sf_dir):
    formulas = _lines(spark, sf_dir).select(F.concat(F.lit("=Sum(A1)+"), F.element_at(F.array(*(F.lit(x) for x in ("IF(B1>2,1,0)", "sum(B2)*Round(C1,2)", "AVERAGE.IF(A1)", "2", "IFERROR(SUM(A2),0)", "MAX(1,2)", "x"))), F.col("l_linenumber"))).alias("formula"))
    return records.function_histogram(formulas, "formula")


def _sums(spark, sf_dir, average):
    lines = _lines(spark, sf_dir)
    criteria = lines.select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("position"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.format_string("%.1f", "l_quantity")).alias("criteria"), F.when(F.col("l_orderkey") % 2 == 0, F.lit("r")).otherwise("17").alias("wanted"))
    # the sum range begins a row below the criteria
    values = lines.filter("l_linenumber > 1").select(F.col("l_orderkey").alias("group"), (F.col("l_linenumber") - 1).alias("position"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    out = records.sum_if(criteria, values, "wanted", average)
    return out.select(F.col("group").alias("l_orderkey"), F.round(F.col("total").cast("double"), 4).alias("total"))


def sum_if(spark, sf_dir):
    return _sums(spark, sf_dir, False)


def average_if(spark, sf_dir):
    return _sums(spark, sf_dir, True)


def style_roles(spark, sf_dir):
    return records.grouped_counts(_lines(spark, sf_dir).withColumn("kind", F.when(F.col("l_linenumber") % 2 == 0, "input")), "l_returnflag", "kind")


def blockers_by_metric(spark, sf_dir):
    cells = _lines(spark, sf_dir).select(F.concat(F.lit("metric_"), F.col("l_orderkey") % 20).alias("output_metric_id"), F.when(F.col("l_linenumber") < 4, "unmapped_cells").otherwise("unsupported_range").alias("reason"), F.when(F.col("l_linenumber") != 3, F.concat(F.lit("Model!B"), F.col("l_quantity").cast("int"))).alias("input"))
    return records.blockers(cells)


def sections_in_several(spark, sf_dir):
    return records.in_several(_read(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey"), "o_orderpriority", "o_custkey")


def sections_not_covered(spark, sf_dir):
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    return records.not_covered(customers, _read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey")), "custkey")


def task_matches(spark, sf_dir):
    lines = _lines(spark, sf_dir).select(F.concat(F.lit("transformation_"), F.col("l_orderkey") % 50).alias("transformation_id"), F.concat(F.lit("period_"), F.col("l_quantity").cast("int")).alias("period_id"), "l_linenumber", "l_orderkey")
    return records.match_tasks(lines.filter("l_linenumber = 3 and l_orderkey % 3 = 0"), lines.filter("l_linenumber = 2 and l_orderkey % 5 = 0"))


def history_fold(spark, sf_dir):
    return records.history(records.edit_actions(_read(spark, sf_dir, "events")))


def workbook_cells(spark, sf_dir):
    """Cells of made workbooks: a sheet for each order, with a row for each of its lines. B holds quantities, C taxes, D to H formulas."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"))
    rows = _lines(spark, sf_dir).select(F.format_string("book%d", F.col("l_orderkey") % 100).alias("path"), F.format_string("S%d", "l_orderkey").alias("sheet"), place.alias("n"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"), F.col("l_returnflag").alias("f"))
    cell = lambda column, kind, value, formula=None: F.struct(F.concat(F.lit(column), "n").alias("cell"), F.lit(kind).alias("type"), F.concat(F.lit(column), F.col("n") % 2).alias("style"), value.cast("string").alias("value"), (F.lit(None).cast("string") if formula is None else F.format_string(formula, *["n"] * formula.count("%d"))).alias("formula"))
    twice = F.when(F.col("n") == 4, F.col("q")).otherwise(F.col("q") * 2)  # the fourth row was not computed anew
    cells = [cell("A", "s", F.col("f")), cell("B", "n", F.col("q")), cell("C", "n", F.col("t")), cell("D", "n", twice, "=B%d*2"), cell("E", "n", F.when(F.col("t") == 0, 7.0).otherwise(F.col("q") / F.when(F.col("t") != 0, F.col("t"))), "=IFERROR(B%d/C%d,7)"), cell("F", "n", F.col("q") + F.col("t"), "=SUM(A%d:C%d)"), cell("G", "n", F.col("q"), "=[1]Other!B%d+Z%d"), cell("H", "n", F.when(F.col("q") > 25, F.col("t")).otherwise(0.0), "=IF(B%d>25,C%d,0)")]
    return rows.select("path", "sheet", F.explode(F.array(*cells)).alias("c")).select("path", "sheet", "c.*")


def workbook_inventory(spark, sf_dir):
    from .sources import xlsx

    cells = workbook_cells(spark, sf_dir)
    row, column = F.regexp_extract("cell", "([0-9]+)$", 1).cast("int"), F.substring("cell", 1, 1)
    # texts that are only formatted, formulas without a result, and references that are cut off
    cells = cells.withColumns({"value": F.when(~((column == "A") & (row % 3 == 0)) & ~((column == "D") & (row % 2 == 0)), F.when((column == "A") & (row % 3 == 1), "").otherwise(F.col("value"))), "formula": F.when((column == "G") & (row % 5 == 0), F.replace("formula", F.lit("]"), F.lit(""))).otherwise(F.col("formula"))})
    return xlsx.inventory(cells)


def formula_translation(spark, sf_dir):
    from .functions.translation import translate_cells

    cells = hold(workbook_cells(spark, sf_dir))
    column = F.regexp_extract("cell", "^([A-Z]+)", 1)
    mapping = cells.filter("cell not like 'A%'").select("path", "sheet", "cell", F.concat(F.lit("metric_"), F.lower(column)).alias("metric_id"), F.concat(F.lit("period_"), F.regexp_extract("cell", "([0-9]+)$", 1)).alias("period_id"))
    out = translate_cells(cells, mapping)
    return out.select("path", "sheet", "cell", "metric_id", "period_id", "expression", F.array_join("dependencies", ",").alias("dependencies"), "blocker")


def formula_blockers(spark, sf_dir):
    """Formulas over a map that has the odd rows and no column A, C or Z. I reads the next row, J a literal, K another sheet."""
    from .functions.translation import translate_cells

    cells = hold(workbook_cells(spark, sf_dir))
    n = F.regexp_extract("cell", "([0-9]+)$", 1).cast("int")
    own = cells.filter("cell like 'B%'").withColumn("n", n).drop("cell", "formula", "type")
    more = lambda column, kind, value, formula: own.select("path", "sheet", F.concat(F.lit(column), "n").alias("cell"), F.lit(kind).alias("type"), "style", value.alias("value"), formula.alias("formula"))
    value = F.col("value")
    cells = cells.unionByName(more("I", "n", value, F.format_string("=B%d*1", F.col("n") + 1))).unionByName(more("J", "n", (value.cast("double") * 2).cast("string"), F.format_string("=B%d*A%d", "n", "n"))).unionByName(more("K", "n", value, F.format_string("=Gone!B%d", "n")))
    mapping = cells.filter((n % 2 == 1) & ~F.substring("cell", 1, 1).isin("A", "C")).select("path", "sheet", "cell", F.concat(F.lit("metric_"), F.lower(F.substring("cell", 1, 1))).alias("metric_id"), F.concat(F.lit("period_"), n).alias("period_id"))
    literals = cells.filter("cell like 'A%'").select("path", "sheet", "cell", F.lit("n").alias("type"), F.lit("2").alias("value"))
    out = translate_cells(cells, mapping, literals, strict_grid=True)
    return out.select("path", "sheet", "cell", "expression", "blocker")


def _extraction(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Extraction of columns A to F of the made workbooks: a metric for each sheet and column, a period for each row. A holds texts, D lacks results in even rows, F is not there."""
    n, column = F.regexp_extract("cell", "([0-9]+)$", 1).cast("int"), F.substring("cell", 1, 1)
    cells = workbook_cells(spark, sf_dir).filter(column.isin("A", "B", "C", "D", "E"))
    gone = ((column == "A") & (n % 3 == 0)) | ((column == "D") & (n % 2 == 0))
    cells = hold(cells.withColumn("value", F.when(~gone, F.col("value"))))
    places = hold(cells.filter("cell like 'B%'").select("path", "sheet", n.alias("n")))
    kinds = {"A": "number", "B": "count", "C": "percentage", "D": "number", "E": "number", "F": "text"}
    metric = lambda c: F.concat(F.lit("metric_"), F.lower(c), F.lit("_"), F.col("sheet"))
    each = places.select("*", F.explode(F.array(*(F.lit(c) for c in kinds))).alias("c")).filter("c <> 'F' or n % 5 = 0")
    empty = F.lit(None).cast("string")
    paths = places.select("path").distinct()
    m = {
        "models": paths.select("path", F.concat(F.lit("model_"), "path").alias("model_id"), F.lit("entity_1").alias("entity_id"), F.lit("2024-01-01").alias("as_of"), F.lit("version_1").alias("version_id"), F.lit("scenario_base").alias("default_scenario_id"), F.lit("artifact_1").alias("source_id")),
        "periods": places.select("path", "n").distinct().select("path", F.concat(F.lit("period_"), "n").alias("period_id"), empty.alias("column"), F.when(F.col("n") < 3, "actual").otherwise("estimate").alias("actuality"), F.col("n").cast("long").alias("ord")),
        "metrics": each.select("path", "sheet", "c").distinct().select("path", metric("c").alias("metric_id"), F.element_at(F.create_map(*(F.lit(x) for k in kinds.items() for x in k)), F.col("c")).alias("data_type"), "sheet", F.lit(None).cast("long").alias("row"), empty.alias("expression"), F.ascii("c").cast("long").alias("ord")),
        "cells": each.select("path", metric("c").alias("metric_id"), "sheet", F.concat("c", "n").alias("cell"), F.concat(F.lit("period_"), "n").alias("period_id"), F.lit(None).cast("double").alias("confidence")),
        "headers": paths.select("path", F.lit("S0").alias("sheet"), F.lit("Z1").alias("low"), F.lit("Z1").alias("high")),
    }
    m = {name: hold(df) for name, df in m.items()}
    return extraction.extract(cells, m)


def extracted_observations(spark, sf_dir):
    return _extraction(spark, sf_dir)["observations"].select("path", "model_id", "id", "metric_id", "period_id", "scenario_id", "kind", F.round("num", 6).alias("num"), "value_type", "transformation_id")


def extracted_items(spark, sf_dir):
    return _extraction(spark, sf_dir)["unresolved_items"].select("path", "id", "category", "target_id", "sheet", "cell", "action_owner")


def extracted_transformations(spark, sf_dir):
    found = _extraction(spark, sf_dir)["transformations"]
    return found.select("path", "id", "output_metric_id", "status", "expression", F.size("source_expressions").alias("n_sources"), F.array_join(F.map_keys("source_expressions"), ",").alias("periods"))


def package_items(spark, sf_dir):
    """Items and reports of packages made from events: some lines, labels and texts are missing, and ids begin one another."""
    e, user = F.col("event_id"), F.col("user_id")
    text = lambda gap: F.concat("event_type", F.lit(f"{gap}of user "), user, F.lit(" at "), e)
    label = F.when(e % 5 < 2, "action_required").otherwise("needs_review")
    items = _read(spark, sf_dir, "events").select(F.concat(F.lit("package_"), user % 97).alias("path"), F.concat(F.lit("item_"), e).alias("id"), F.when(e % 4 == 3, "resolved").otherwise("open").alias("status"), label.alias("attention_level"), text(" ").alias("description"), e.alias("e"), text("  ").alias("shown"))
    name = F.when(F.col("e") % 7 == 0, "NOTE").when(F.col("attention_level") == "action_required", "ACTION REQUIRED").otherwise("NEEDS REVIEW")
    line = F.when(F.col("e") % 10 != 0, F.concat(F.lit("- "), name, F.lit(" `"), "id", F.lit("`: "), F.when(F.col("e") % 6 == 0, "other").otherwise(F.col("shown"))))
    reports = items.groupBy("path").agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("e", line.alias("line"))))).alias("lines")).select("path", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    return packages.report_items(hold(reports), items.drop("e", "shown"))


def shared_formula_shift(spark, sf_dir):
    base = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.lit("=SUM($A$1:B2)&\"C3\"+C$3").alias("formula"), (F.col("l_orderkey") % 5).cast("int").alias("rows"), F.col("l_linenumber").cast("int").alias("cols"))
    return records.shift_formulas(base, "formula", "rows", "cols", "shifted").select("l_orderkey", "l_linenumber", "shifted")


def reviewed_db(spark: SparkSession, sf_dir: str) -> ModelDb:
    """The derived database with provenance, items and presentations made from the observations' numbers. One model has no presentation."""
    db = derived_db(spark, sf_dir)
    obs = db.observations
    rank = (F.col("ord") % 32 / 4).cast("int")
    quarter = (F.floor(F.col("ord") / 64) % 400).cast("int")
    cell = F.concat(F.when(quarter % 9 == 0, F.lit("$")).otherwise(F.lit("")), F.char(65 + quarter % 26), 10 + rank)
    records_ = obs.filter("ord % 11 <> 0").select(F.col("id").alias("target_id"), F.concat(F.lit("context_"), F.col("ord") % 6).alias("context_id"), F.col("model_id").alias("sheet"), cell.alias("cell"), F.when(F.col("ord") % 5 == 0, 0.5).alias("confidence"), F.when(F.col("ord") % 7 == 0, "corrected").alias("review_status"), "ord")
    of_metrics = db.metrics.filter("ord % 3 <> 1").select(F.col("id").alias("target_id"), F.concat(F.lit("context_"), F.col("ord") % 6).alias("context_id"), F.lit("Metrics").alias("sheet"), F.concat(F.lit("A"), 20 - F.col("ord")).alias("cell"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("review_status"), (F.col("ord") - 100).alias("ord"))
    records_ = records_.unionByName(of_metrics)
    artifacts = spark.range(2).select(F.concat(F.lit("artifact_"), "id").alias("id"), F.concat(F.lit("Workbook "), "id").alias("title"), F.col("id").alias("ord"))
    runs = spark.range(1).select(F.lit("run_1").alias("id"), F.lit("completed").alias("status"), F.col("id").alias("ord"))
    contexts = spark.range(6).select(F.concat(F.lit("context_"), "id").alias("id"), F.concat(F.lit("artifact_"), F.col("id") % 2).alias("source_artifact_id"), F.lit("run_1").alias("extraction_run_id"), (0.9 - (F.col("id") % 3) * 0.1).alias("confidence"), F.when(F.col("id") % 3 == 0, "unreviewed").otherwise("confirmed").alias("review_status"), F.col("id").alias("ord"))
    pick = F.col("ord") % 13 == 0
    items = obs.filter(pick).select(
        F.concat(F.lit("item_"), "id").alias("id"),
        F.when(F.col("ord") % 4 == 0, F.col("id")).when(F.col("ord") % 4 == 1, F.col("metric_id")).when(F.col("ord") % 4 == 2, F.col("transformation_id")).when(F.col("ord") % 8 == 3, F.col("model_id")).alias("target_id"),
        F.when(F.col("ord") % 5 == 0, F.col("model_id")).alias("model_id"),
        F.when(F.col("ord") % 3 == 0, F.col("model_id")).alias("sheet"),
        F.when(F.col("ord") % 3 == 0, cell).alias("cell"),
        F.when(F.col("ord") % 8 == 0, "source_error").otherwise("formula").alias("category"),
        F.when(F.col("ord") % 6 < 2, "action_required").otherwise("needs_review").alias("attention_level"),
        F.when(F.col("ord") % 12 == 0, "model_owner").when(F.col("ord") % 12 == 1, "source_owner").alias("action_owner"),
        F.when(F.col("ord") % 17 == 0, "resolved").otherwise("open").alias("status"),
        "ord",
    )
    presentations = db.models.filter("ord < 4").select(F.explode(F.sequence(F.lit(1), F.lit(2))).alias("n"), "id", "ord").select(F.concat_ws("_", F.lit("presentation"), "id", "n").alias("id"), F.col("id").alias("model_id"), F.when(F.col("n") == 2, F.col("id")).alias("sheet"), (F.col("ord") * 2 + F.col("n")).alias("ord"), "n")
    # five models, two presentations, seven metrics
    parent = db.relationships.select(F.col("from_id").alias("metric_id"), F.col("to_id").alias("parent_id"))
    shown = presentations.crossJoin(db.metrics.select(F.col("id").alias("metric_id"), F.col("ord").alias("m"))).filter("m % 3 <> n % 3").join(parent, "metric_id", "left")
    shown = shown.select(F.col("id").alias("presentation_id"), F.concat_ws("_", "id", F.lit("section"), F.col("m") % 2).alias("section_id"), "metric_id", "parent_id", F.col("m").alias("ord"))
    named = shown.select("presentation_id", "section_id").distinct().select(F.col("section_id").alias("id"), F.concat(F.lit("Section "), F.substring("section_id", -1, 1)).alias("title"), F.substring("section_id", -1, 1).cast("long").alias("ord"))
    return db.replace(provenance_records=records_, provenance_contexts=contexts, source_artifacts=artifacts, extraction_runs=runs, unresolved_items=items, presentations=presentations.drop("n").withColumn("title", F.lit("Table")), presentation_metrics=shown, sections=named)


def provenance_resolved(spark, sf_dir):
    return review.provenance(reviewed_db(spark, sf_dir)).select("target_id", "source_artifact_id", "confidence", "review_status", "cell")


def unreviewed_counts(spark, sf_dir):
    return review.unreviewed_counts(reviewed_db(spark, sf_dir))


def attention_queue(spark, sf_dir):
    return review.attention_queue(reviewed_db(spark, sf_dir)).drop("model_name")


def attention_by_owner(spark, sf_dir):
    return review.attention_by_owner(review.attention_queue(reviewed_db(spark, sf_dir)))


def navigation_target(spark, sf_dir):
    return review.navigation_targets(reviewed_db(spark, sf_dir), "presentation_model_asia_2")


def broken_db(spark: SparkSession, sf_dir: str) -> ModelDb:
    """A copy with faults at fixed places, so that each rule has something to find."""
    db = reviewed_db(spark, sf_dir)
    at = lambda m, r=0: F.col("ord") % m == r
    obs = db.observations.withColumns(
        {
            "version_id": F.when(at(97), "version_9").otherwise(F.col("version_id")),
            "metric_id": F.when(at(103), "metric_unknown").otherwise(F.col("metric_id")),
            "period_id": F.when(at(107), "period_unknown").otherwise(F.col("period_id")),
            "entity_id": F.when(at(109), "entity_unknown").otherwise(F.col("entity_id")),
            "kind": F.when(at(89), "string").otherwise(F.col("kind")),
            "num": F.when(at(89), None).when(at(113), F.col("num") + 0.5).otherwise(F.col("num")),
            "value_type": F.when(at(83), "derived").otherwise(F.col("value_type")),
            "transformation_id": F.when(at(127) & F.col("transformation_id").isNotNull(), "transformation_growth").otherwise(F.col("transformation_id")),
        }
    )
    twice = obs.filter(at(101)).withColumn("ord", F.col("ord") + 10**9).withColumn("id", F.when(at(2), F.concat("id", F.lit("_again"))).otherwise(F.col("id")))
    extra = "('transformation_spare', 'metric_gone', 'supported', \"ref('a') + b\", 10L), ('transformation_twin', 'metric_net_revenue', 'supported', \"ref('metric_gross_revenue') - ref('metric_discount_amount')\", 11L)"
    transformations = db.transformations.unionByName(spark.sql(f"select * from values {extra} as t(id, output_metric_id, status, expression, ord)"))
    relationships = db.relationships.unionByName(spark.sql("select * from values ('relationship_x', 'metric_quantity', 'component_of', 'metric_gross_revenue', 20L), ('relationship_y', 'metric_gone', 'component_of', 'metric_quantity', 21L) as t(id, from_id, type, to_id, ord)"))
    sources = obs.filter("transformation_id is not null and ord % 3 <> 0 and period_id <> 'period_1995q3'").groupBy("transformation_id", "period_id").agg(F.min(F.when(at(5), "B1").otherwise("Z1")).alias("formula"))
    sources = sources.withColumn("formula", F.when(F.col("formula") == "Z1", " =Z1").otherwise(F.col("formula"))).unionByName(spark.sql("select 'transformation_spare' as transformation_id, 'period_gone' as period_id, '=A1' as formula"))
    versions = db.models.select(F.col("id").alias("model_id"), F.lit("version_1").alias("version_id"))
    models = db.models.withColumn("current_version_id", F.when(F.col("ord") == 2, "version_0").otherwise("version_1"))
    contexts = db.provenance_contexts.unionByName(db.provenance_contexts.filter("ord < 2").withColumn("id", F.concat("id", F.lit("_b"))).withColumn("ord", F.col("ord") + 10).withColumn("extraction_run_id", F.when(F.col("ord") == 11, "run_9").otherwise(F.col("extraction_run_id"))))
    records_ = db.provenance_records.unionByName(db.provenance_records.filter("ord % 37 = 0").withColumn("ord", F.col("ord") + 10**9))
    artifacts = spark.sql("select * from values ('artifact_0', 'sha256:ab12', 0L), ('artifact_1', 'sha256-xyz', 1L), ('artifact_2', null, 2L) as t(id, content_hash, ord)")
    runs = db.extraction_runs.withColumns({"source_artifact_ids": F.array(F.lit("artifact_0"), F.lit("artifact_9")), "model_version_id": F.lit("version_1")})
    shown = db.presentation_metrics.unionByName(db.presentation_metrics.filter("ord = 1").withColumn("ord", F.col("ord") + 100))
    # the third presentation takes the second one's first section; a metric without data is shown; a parent comes late, another is not there
    shown = shown.withColumn("section_id", F.when(F.col("presentation_id") == "presentation_model_america_1", F.regexp_replace("section_id", "america_1", "africa_2")).otherwise(F.col("section_id")))
    shown = shown.withColumn("parent_id", F.when((F.col("metric_id") == "metric_gross_revenue") & F.col("presentation_id").like("%2"), "metric_net_revenue").when(F.col("metric_id") == "metric_order_count", "metric_gone").otherwise(F.col("parent_id")))
    more = spark.sql("select 'presentation_model_africa_1' as presentation_id, 'presentation_model_africa_1_section_0' as section_id, 'metric_idle' as metric_id, cast(null as string) as parent_id, 500L as ord")
    presentations = db.presentations.unionByName(db.presentations.filter("ord = 1").withColumn("ord", F.lit(50).cast("long"))).withColumn("title", F.when(F.col("ord") != 4, F.col("title")))
    presentations = presentations.withColumn("id", F.when(F.col("ord") == 6, F.concat(F.lit("unnamed_presentation_"), "ord")).otherwise(F.col("id")))
    series_ = M.group_series(obs).select(*M.CONTEXT, "series_ord")
    series_ = series_.unionByName(series_.filter("series_ord % 5 = 0").withColumn("series_ord", F.col("series_ord") + 10**9))
    changes = spark.range(40).select(F.concat(F.lit("change_"), "id").alias("id"), F.col("id").alias("ord"), F.lit("number").alias("before_kind"), F.when(F.col("id") % 7 == 0, "text").otherwise("number").alias("after_kind"), F.when(F.col("id") % 3 == 0, "metric_gone").otherwise("metric_growth").alias("metric_id"))
    metrics = db.metrics.unionByName(spark.sql("select 'metric_idle' as id, 'Idle' as name, 'number' as data_type, array('x') as tags, 7L as ord"))
    again = obs.unionByName(twice)
    items = db.unresolved_items.withColumns({"description": F.lit("d"), "current_treatment": F.when(F.col("ord") % 7 > 0, "t"), "impact": F.lit("i"), "next_action": F.when(F.col("ord") % 3 == 0, "").otherwise("n")})
    frames = dict(unresolved_items=items, observations=again, metrics=metrics, series=series_, decision_changes=changes, extraction_runs=runs, presentations=presentations, transformations=transformations, relationships=relationships, transformation_sources=sources, model_versions=versions, models=models, provenance_contexts=contexts, provenance_records=records_, source_artifacts=artifacts, presentation_metrics=shown.unionByName(more))
    return db.replace(**frames)


def cyclic_db(spark: SparkSession, sf_dir: str) -> ModelDb:
    """A copy in which discounts are computed from net revenue, so that both stand on a cycle, one formula is opaque and metrics are their own ancestors."""
    db = broken_db(spark, sf_dir)
    again = F.when(F.col("id") == "transformation_net_margin", "opaque").otherwise("supported")
    extra = "('transformation_discount', 'metric_discount_amount', 'supported', \"ref('metric_net_revenue') * 2\", 20L), ('transformation_dark', 'metric_quantity', 'opaque', \"\", 21L)"
    transformations = db.transformations.withColumn("status", again).unionByName(spark.sql(f"select * from values {extra} as t(id, output_metric_id, status, expression, ord)"))
    obs = db.observations.withColumn("transformation_id", F.when(F.col("metric_id") == "metric_discount_amount", "transformation_discount").otherwise(F.col("transformation_id")))
    relationships = db.relationships.unionByName(spark.sql("select 'relationship_z' as id, 'metric_gross_revenue' as from_id, 'component_of' as type, 'metric_net_margin' as to_id, 30L as ord"))
    return db.replace(observations=obs, transformations=transformations, relationships=relationships)


#: Formulas of the catalogue by the last digit of the part; %d are other parts. Some break a rule of the language.
FORMULAS = ["ref('metric_%d')", "ref('metric_%d') * 2", "ref('metric_%d') + ref('metric_%d')", "lag('metric_%d')", "round(ref('metric_%d'), b)", "period_ref('metric_%d', 'period_x')", "foo(ref('metric_%d'))", "ref('metric_%d') && 1", "ref(", "ref('metric_%d') - ref('metric_%d')"]
#: How far on the parts of each formula lie.
STEPS = [(1,), (1,), (1, -2), (1,), (1,), (1,), (1,), (1,), (), (1, -4)]


def catalog_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    texts = [F.format_string(text, *((k + n) for n in steps)) if steps else F.lit(text) for text, steps in zip(FORMULAS, STEPS, strict=True)]
    text = F.element_at(F.array(*texts), (k % 10 + 1).cast("int"))
    status = F.when(F.col("p_size") % 9 == 0, "opaque").otherwise("supported")
    metric = F.concat(F.when(k % 19 == 0, "metric_gone_").otherwise("metric_"), k)
    return _read(spark, sf_dir, "part").select(F.concat(F.lit("transformation_"), k).alias("id"), metric.alias("output_metric_id"), status.alias("status"), F.when(status == "supported", text).alias("expression"), k.alias("ord"))


def catalog_db(spark: SparkSession, sf_dir: str) -> ModelDb:
    """A database without observations: metrics, formulas and relationships of parts, models of customers, presentations of orders, items and changes of events, runs and artifacts of suppliers."""
    part, customer, orders, events, supplier = (_read(spark, sf_dir, t) for t in ("part", "customer", "orders", "events", "supplier"))
    name = lambda kind, key: F.concat(F.lit(f"{kind}_"), key)
    k, c, o, e, u, s = F.col("p_partkey"), F.col("c_custkey"), F.col("o_orderkey"), F.col("event_id"), F.col("user_id"), F.col("s_suppkey")
    far = lambda x: x + 10**9
    metrics = part.filter(k % 37 != 0).select(name("metric", k).alias("id"), F.col("p_name").alias("name"), F.lit("number").alias("data_type"), k.alias("ord"))
    formulas = catalog_formulas(spark, sf_dir)
    formulas = formulas.unionByName(formulas.filter("ord % 23 = 0").withColumns({"id": F.concat("id", F.lit("_twin")), "ord": far(F.col("ord"))}))
    first = part.select(name("relationship", k).alias("id"), name("metric", k).alias("from_id"), F.when(k % 13 == 0, "derived_from").otherwise("component_of").alias("type"), name("metric", (k * k + 1) % 101).alias("to_id"), k.alias("ord"))
    second = part.filter(k % 6 == 0).select(F.concat(name("relationship", k), F.lit("_b")).alias("id"), F.when(k % 40 == 0, name("metric_gone", k)).otherwise(name("metric", k)).alias("from_id"), F.lit("component_of").alias("type"), name("metric", k + 5).alias("to_id"), far(k).alias("ord"))
    models = customer.select(name("model", c).alias("id"), name("version", c % 3).alias("current_version_id"), c.alias("ord"))
    versions = customer.select(name("model", c).alias("model_id"), F.explode(F.array(F.lit("version_0"), F.lit("version_1"))).alias("version_id"))
    presentations = orders.filter("o_custkey % 3 <> 0").select(F.when(o % 29 == 0, name("unnamed_presentation", o)).when(o % 50 == 0, name("presentation", o % 1000)).otherwise(name("presentation", o)).alias("id"), name("model", F.col("o_custkey")).alias("model_id"), F.when(o % 31 != 0, F.col("o_orderpriority")).alias("title"), o.alias("ord"))
    sections = orders.filter("o_custkey % 3 <> 0").select(F.explode(F.when(o % 41 == 0, F.array(o, o)).when(o % 43 == 0, F.array(o - 1)).otherwise(F.array(o))).alias("n"), o.alias("ord")).select(name("section", F.col("n")).alias("id"), "ord")
    pick = lambda test, a, b: F.when(test, a).otherwise(b)
    items = events.select(
        name("item", e).alias("id"), e.alias("ord"), F.element_at(F.array(*(F.lit(x) for x in ("formula", "presentation", "source_error"))), (e % 3 + 1).cast("int")).alias("category"),
        pick(e % 4 == 3, "resolved", F.lit("open")).alias("status"), pick(e % 5 < 2, "action_required", F.lit("needs_review")).alias("attention_level"), F.when(e % 7 != 6, name("model", u)).alias("model_id"),
        F.when(e % 8 == 0, name("transformation", u)).when(e % 8 == 1, name("metric", u)).when(e % 8 > 2, name("model", u)).alias("target_id"), F.when(e % 8 == 2, F.array(name("transformation", u + 1), name("metric", u))).alias("affected_target_ids"),
    )
    traces = events.filter(e % 97 < 2).select(pick(e % 97 == 0, name("item", e), name("metric", u)).alias("target_id"), name("context", e % 50).alias("context_id"), e.alias("ord"))
    contexts = supplier.select(name("context", s).alias("id"), name("artifact", s % 7).alias("source_artifact_id"), name("run", s % 9).alias("extraction_run_id"), F.lit(0.5).alias("confidence"), F.when(s % 3 == 0, "unreviewed").alias("review_status"), s.alias("ord"))
    hashes = F.element_at(F.array(*(F.lit(x) for x in ("sha256:ab12", "sha256-xyz", None, "md5:0G", "crc32:DEAD"))), (s % 5 + 1).cast("int"))
    artifacts = supplier.select(name("artifact", s).alias("id"), hashes.alias("content_hash"), s.alias("ord"))
    runs = supplier.select(name("run", s).alias("id"), pick(s % 2 == 0, "completed", F.lit("completed_with_issues")).alias("status"), s.alias("ord"))
    changes = events.select(name("change", e).alias("id"), e.alias("ord"), F.lit("number").alias("before_kind"), pick(F.col("event_type") == "error", "string", F.lit("number")).alias("after_kind"))
    base = model_db(spark, sf_dir)
    none = spark.createDataFrame([], base.observations.schema)
    return ModelDb({"observations": none, "periods": base.periods, "metrics": metrics, "transformations": formulas, "relationships": first.unionByName(second), "models": models, "model_versions": versions, "presentations": presentations, "sections": sections, "unresolved_items": items, "provenance_records": traces, "provenance_contexts": contexts, "source_artifacts": artifacts, "extraction_runs": runs, "decision_changes": changes})


def expr_issues(spark, sf_dir):
    rows = spark.createDataFrame([(t, i.path, i.reason) for t in FORMULAS for i in X.analyze(t.replace("%d", "0")).issues], "template string, path string, reason string")
    of = catalog_formulas(spark, sf_dir).filter("status = 'supported'").select("id", F.regexp_replace("expression", "metric_-?[0-9]+", "metric_%d").alias("template"))
    return of.join(rows, "template").select("id", "path", "reason")


def formula_references(spark, sf_dir):
    return lineage.transformation_refs(catalog_db(spark, sf_dir)).select("transformation_id", "ref", "metric_id", "offset", "dependency")


def formula_cycle_paths(spark, sf_dir):
    return validate.formula_cycles(catalog_db(spark, sf_dir)).select("metric_id", "path")


def cell_cycle_paths(spark, sf_dir):
    return validate.formula_cycles(cyclic_db(spark, sf_dir)).select("model_id", "metric_id", "path")


def strong_components(spark, sf_dir):
    """Parts lead to the next one; some lead back by a few. A cycle is a run of parts that overlapping ways back hold together."""
    k, back = F.col("p_partkey"), F.when(F.col("p_size") % 4 == 0, F.col("p_partkey") - F.col("p_size") % 5)
    part = _read(spark, sf_dir, "part")
    edges = part.select(k.alias("a"), F.explode(F.array(k + 1, back)).alias("b")).filter("b >= 0").join(part.select(k.alias("b")), "b", "left_semi").select("a", "b")
    return graphs.strong_components(edges)


def metric_search(spark, sf_dir):
    return series.search_metrics(ModelDb({"metrics": _read(spark, sf_dir, "part").select(F.concat(F.lit("metric_"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.lower("p_type"), "p_brand").alias("tags"), F.col("p_partkey").alias("ord"))}), " WIDGET ").select("id", "name")


def expr_nested(spark, sf_dir):
    """Formulas by the line of an order, eight operations deep, in one pass."""
    deep = lambda step: functools.reduce(lambda text, _: step.replace("@", text), range(8), "ref('quantity')")
    formulas = {1: deep("round(@ * 3 / 2, 1)"), 2: deep("(mod(@, 11) + ref('tax'))"), 3: deep("(@ > 30 ? @ - 20 : @ + 7)"), 4: deep("max(@ / 2, min(@, 9))"), 5: deep("(100 / (@ - 5))"), 6: deep("coalesce(@ == 3 ? null : @, 4)")}
    lookup = lambda key: X._value("number", num=F.col({"quantity|0": "l_quantity", "tax|0": "l_tax"}[key]))
    out = X.with_values(_lines(spark, sf_dir), formulas, lookup, by="l_linenumber")
    return out.select("l_orderkey", "l_linenumber", F.round("num", 6).alias("num"), "error")


#: Rules on collections that grow with no observation are tried on the catalogue.
CATALOG = ["transformation_expression", "transformation_duplicate", "transformation_cycle", "transformation_opaque", "component_metric", "component_multiple_parents", "component_cycle", "artifact_content_hash", "provenance_context_duplicate", "decision_change_value_type", "model_current_version", "presentation_duplicate_id", "presentation_duplicate_section", "presentation_names", "presentation_missing", "extraction_run_open_attention", "open_items", "unresolved_repair_required"]


def _rule(rule: Callable[[ModelDb], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    build = catalog_db if rule.__name__ in CATALOG else broken_db
    return lambda spark, sf_dir: rule(build(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    private = ("derived_db", "reviewed_db", "broken_db", "cyclic_db", "catalog_db", "catalog_formulas", "model_db", "queries", "hold", "workbook_cells")
    plain = {name: f for name, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_") and name not in private}
    return plain | {f"validate_{rule.__name__}": _rule(rule) for rule, _ in validate.RULES}
