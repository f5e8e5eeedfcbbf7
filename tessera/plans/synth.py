"""A model database derived from the star-schema tables.

Models are regions, entities nations, periods order quarters and years. Each nation and quarter has four base
metrics; figures before 2000 are actual, later ones are estimates of three scenarios by order status. Vintage 1
(as of 2000-06-30) knows finished lines alone, vintage 2 (2001-12-31) all lines. Sums are decimals until the end,
so they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model_db import ModelDb

METRICS = [
    ("metric_gross_revenue", "Gross revenue", "currency", ["sales", "top_line"], None),
    ("metric_discount_amount", "Discount amount", "currency", ["sales"], "metric_gross_revenue"),
    ("metric_order_count", "Order count", "count", ["volume"], None),
    ("metric_quantity", "Quantity", "number", ["volume"], "metric_order_count"),
    ("metric_net_revenue", "Net revenue", "currency", ["sales", "derived"], "metric_gross_revenue"),
    ("metric_net_margin", "Net margin", "percentage", ["derived"], "metric_net_revenue"),
    ("metric_growth", "Growth on year", "percentage", ["derived"], "metric_net_revenue"),
]
EXPRESSIONS = [
    ("transformation_net_revenue", "metric_net_revenue", "ref('metric_gross_revenue') - ref('metric_discount_amount')"),
    ("transformation_net_margin", "metric_net_margin", "ref('metric_gross_revenue') == 0 ? null : round(ref('metric_net_revenue') / ref('metric_gross_revenue'), 6)"),
    ("transformation_growth", "metric_growth", "round(ref('metric_gross_revenue') / lag('metric_gross_revenue', 4) - 1, 6)"),
]
BASE = ["gross_revenue", "discount_amount", "order_count", "quantity"]


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, nation_key, year, quarter, actuality, scenario_id, vintage, base metrics): one aggregation over the lines.

    Dimensions are small tables that Spark broadcasts while they are under its threshold.
    """
    read = lambda t, *c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c)
    lines = read("lineitem", "l_orderkey", "l_extendedprice", "l_discount", "l_quantity", "l_linestatus")
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    customers = read("customer", "c_custkey", "c_nationkey")
    nations = read("nation", "n_nationkey", "n_regionkey").join(read("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    year = F.year("o_orderdate")
    price, discount = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    scenario = F.when(year < 2000, None).otherwise(F.element_at(F.create_map(*(F.lit(x) for x in ("F", "scenario_base", "O", "scenario_bull", "P", "scenario_bear"))), F.col("o_orderstatus")))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    keyed = joined.select(
        F.lower("r_name").alias("region"),
        F.col("n_nationkey").alias("nation_key"),
        year.alias("year"),
        F.quarter("o_orderdate").alias("quarter"),
        F.when(year < 2000, "actual").otherwise("estimate").alias("actuality"),
        scenario.alias("scenario_id"),
        "l_orderkey",
        price.alias("price"),
        (price * discount).alias("off"),
        F.col("l_quantity").cast("decimal(18,2)").alias("q"),
        F.explode(F.when(F.col("l_linestatus") == "F", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))).alias("vintage"),
    )
    keys = ["region", "nation_key", "year", "quarter", "actuality", "scenario_id", "vintage"]
    # orders first: the distinct count of orders then needs no second pass over the lines
    by_order = keyed.groupBy(*keys, "l_orderkey").agg(F.sum("price").alias("p"), F.sum("off").alias("d"), F.sum("q").alias("q"))
    return by_order.groupBy(*keys).agg(F.sum("p").cast("double").alias("gross_revenue"), F.sum("d").cast("double").alias("discount_amount"), F.count(F.lit(1)).cast("double").alias("order_count"), F.sum("q").cast("double").alias("quantity"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat observations of the base metrics and empty ones of the derived metrics."""
    derived = [m[0].removeprefix("metric_") for m in METRICS[4:]]
    values = [F.struct(F.lit(i).alias("rank"), F.lit(m).alias("metric"), F.col(m).alias("num")) for i, m in enumerate(BASE)]
    values += [F.struct(F.lit(4 + i).alias("rank"), F.lit(m).alias("metric"), F.lit(None).cast("double").alias("num")) for i, m in enumerate(derived)]
    long = facts(spark, sf_dir).withColumn("x", F.explode(F.array(*values))).select("*", "x.*").drop("x")
    period = F.format_string("%dq%d", "year", "quarter")
    scenario = F.coalesce(F.regexp_replace("scenario_id", "scenario_", ""), F.lit("actual"))
    derived_rank = F.col("rank") >= 4
    return long.select(
        # one number for each nation, quarter, vintage, metric and scenario
        (((F.col("nation_key") * 400 + (F.col("year") - 1990) * 4 + F.col("quarter")) * 2 + F.col("vintage")) * 32 + F.col("rank") * 4 + F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("scenario_base", 1, "scenario_bull", 2, "scenario_bear", 3))), F.col("scenario_id")), F.lit(0))).cast("long").alias("ord"),
        F.concat(F.lit("model_"), F.translate("region", " ", "_")).alias("model_id"),
        F.concat(F.lit("metric_"), "metric").alias("metric_id"),
        F.concat(F.lit("entity_nation_"), "nation_key").alias("entity_id"),
        F.when(F.col("vintage") == 1, "2000-06-30").otherwise("2001-12-31").alias("as_of"),
        F.lit("version_1").alias("version_id"),
        F.concat_ws("_", F.lit("obs"), "nation_key", "metric", period, scenario, "vintage").alias("id"),
        F.concat(F.lit("period_"), period).alias("period_id"),
        "scenario_id",
        "actuality",
        F.when(F.col("num").isNull(), "null").otherwise("number").alias("kind"),
        "num",
        F.lit(None).cast("string").alias("str"),
        F.lit(None).cast("boolean").alias("bool"),
        F.when(derived_rank, "derived").when(F.col("actuality") == "actual", "reported").otherwise("assumption").alias("value_type"),
        F.when(derived_rank, F.concat(F.lit("transformation_"), "metric")).alias("transformation_id"),
    )


def model_db(spark: SparkSession, sf_dir: str, with_derived: bool = False) -> ModelDb:
    obs = observations(spark, sf_dir)
    if not with_derived:
        obs = obs.filter("transformation_id is null")
    periods = spark.range(1992 * 4, 2004 * 4).select(F.floor(F.col("id") / 4).cast("int").alias("y"), (F.col("id") % 4 + 1).cast("int").alias("q"))
    periods = periods.select(F.format_string("period_%dq%d", "y", "q").alias("id"), F.format_string("%d Q%d", "y", "q").alias("label"), F.lit("fiscal_quarter").alias("type"), F.make_date("y", F.col("q") * 3 - 2, F.lit(1)).alias("start_date"), F.last_day(F.make_date("y", F.col("q") * 3, F.lit(1))).alias("end_date"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    entities = nation.select(F.concat(F.lit("entity_nation_"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ord"))
    first = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.min("n_nationkey").alias("_first"))
    models = region.join(first, "r_regionkey").select(F.concat(F.lit("model_"), F.translate(F.lower("r_name"), " ", "_")).alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("entity_nation_"), "_first").alias("primary_entity_id"), F.lit("2001-12-31").alias("as_of"), F.col("r_regionkey").cast("long").alias("ord"))
    scenarios = spark.range(3).select(F.element_at(F.array(*(F.lit(f"scenario_{x}") for x in ("base", "bull", "bear"))), (F.col("id") + 1).cast("int")).alias("id"), F.col("id").alias("ord"))
    metrics = spark.sql("select * from values " + ", ".join(f"('{i}', '{n}', '{t}', array({', '.join(repr(x) for x in tags)}), {k}L)" for k, (i, n, t, tags, _) in enumerate(METRICS)) + " as t(id, name, data_type, tags, ord)")
    relationships = spark.sql("select * from values " + ", ".join(f"('relationship_{k}', '{i}', 'component_of', '{p}', {k}L)" for k, (i, _, _, _, p) in enumerate(METRICS) if p) + " as t(id, from_id, type, to_id, ord)")
    transformations = spark.sql("select * from values " + ", ".join(f"('{i}', '{m}', 'supported', \"{e}\", {k}L)" for k, (i, m, e) in enumerate(EXPRESSIONS)) + " as t(id, output_metric_id, status, expression, ord)")
    return ModelDb({"observations": obs, "periods": periods, "entities": entities, "models": models, "scenarios": scenarios, "metrics": metrics, "relationships": relationships, "transformations": transformations})
