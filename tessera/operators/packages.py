"""Checks of extraction packages as tables: the report's form, its account of open items, translation tasks and privacy.

A package is named by ``path``. Each check returns (path, issue, object_id). Any number of packages is checked at once; a report is one
row, at most as large as a document may be.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.hold import hold as held

#: The sections of a report, in order.
SECTIONS = ["Inputs and hashes", "Inventory", "Object counts", "Table presentation", "Actual / estimate boundary", "Formula coverage", "Workbook quality audit", "Unresolved mappings", "Missing lineage", "Validator result", "Questions and next actions"]
#: The label of each attention level, and fields of an item that a report must hold.
LABELS = {"action_required": "ACTION REQUIRED", "needs_review": "NEEDS REVIEW"}
FIELDS = ["description", "current_treatment", "impact", "next_action"]
#: Letters by which the beginning of a value is known, and of the pieces in which beginnings are looked for.
GRAM, CELL = 4, 64
_LOCAL = r"(?i:file:)//|/(?:home|root|Users)/|(?m:(?:^|[\s\"'`])[A-Za-z]:[\\/])"


def _issue(df: DataFrame, issue: str | Column, what: Column | str) -> DataFrame:
    return df.select("path", (F.lit(issue) if isinstance(issue, str) else issue).alias("issue"), (F.col(what) if isinstance(what, str) else what).alias("object_id"))


def normalized(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def report_lines(reports: DataFrame) -> DataFrame:
    """(path, line, text) of reports (path, text)."""
    return reports.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text"))


def report_form(reports: DataFrame, command: str = r"check-extraction(\s|`|$)") -> DataFrame:
    """Reports without the title, or with sections that are missing, out of order or empty, or whose validator section lacks the checker's ``command``."""
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^##[ \t]+(.+?)[ \t]*$"), F.lit(1))
    parts = F.slice(F.split("text", r"(?m)^##[ \t]+.+?[ \t]*$"), F.lit(2), F.greatest(F.size(heads), F.lit(1)))
    named = reports.select("path", "text", heads.alias("heads"), parts.alias("parts"))
    untitled = _issue(named.filter(~F.col("text").rlike(r"(?m)^# Extraction report\s*$")), "no_title", "path")
    wanted = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(s).alias("name")) for i, s in enumerate(SECTIONS)))
    each = named.select("path", "heads", "parts", F.explode(wanted).alias("w")).select("path", F.col("w.n").alias("n"), F.col("w.name").alias("name"), F.array_position("heads", F.col("w.name")).alias("at"), "parts")
    # a section that is there must come after the last one that is there
    before = F.array(*(F.struct(F.lit(i).alias("n"), F.array_position("heads", F.lit(s)).alias("at")) for i, s in enumerate(SECTIONS)))
    order = named.select("path", F.explode(before).alias("b")).select("path", "b.*").filter("at > 0")
    prior = order.select("path", F.col("n").alias("m"), F.col("at").alias("before"))
    last = order.join(prior, "path").filter("m < n").groupBy("path", "n").agg(F.max_by("before", "m").alias("before"))
    j = each.join(last, ["path", "n"], "left")
    state = F.when(F.col("at") == 0, "no_section").when(F.col("at") <= F.col("before"), "section_order")
    found = untitled.unionByName(_issue(j.filter(state.isNotNull()), state, "name"))
    content = F.try_element_at("parts", F.col("at").cast("int"))
    there = j.filter("at > 0").withColumn("content", content)
    found = found.unionByName(_issue(there.filter(F.trim(F.regexp_replace("content", r"\s+", " ")) == ""), "empty_section", "name"))
    return found.unionByName(_issue(there.filter((F.col("name") == "Validator result") & ~F.col("content").rlike(command)), "no_command", "name"))


def _cut(text: str, size: Column, over: Column) -> Column:
    """Pieces of ``size`` letters, each with the first ``over`` letters of the next one."""
    pieces = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size, F.lit("}")), F.lit(0))
    # as the variable of a lambda the pieces are cut once, not once for each of them
    return F.transform(F.array(pieces), lambda p: F.transform(p, lambda x, i: F.concat(x, F.coalesce(F.substr(F.get(p, i + 1), F.lit(1), over), F.lit("")))))[0]


def occurrences(texts: DataFrame, wanted: DataFrame, flags: Collection[str] = ()) -> DataFrame:
    """(path, value, and ``flags``): values (path, value) that a text (path, no, text, and flags) of their package holds, anywhere in it, and whether such a text has a flag.

    Places where any value can begin, by its first ``GRAM`` letters, are found on short pieces of the texts. From each, the lengths of the values
    that begin so are cut and joined to the values as a whole. Work grows with the texts and the lengths, not with values times texts,
    however much the values are alike.
    """
    wanted = wanted.filter(F.length("value") > 0).select("path", "value").distinct()
    heads = held(wanted.groupBy("path", F.least(F.length("value"), F.lit(GRAM)).alias("size"), F.substring("value", 1, GRAM).alias("head")).agg(F.collect_set(F.length("value")).alias("lengths")))
    spans = held(heads.groupBy("path").agg(F.greatest(F.max(F.array_max("lengths")), F.lit(CELL)).alias("span"), F.collect_set("size").alias("sizes"), F.array_join(F.collect_set(F.substring("head", 1, 1)), "").alias("firsts")))
    sized = texts.join(spans, "path")
    cells = sized.select("path", "no", "span", "sizes", "firsts", F.posexplode(_cut("text", F.lit(CELL), F.lit(GRAM - 1))).alias("cell", "piece")).withColumn("size", F.explode("sizes"))
    letters = F.sequence(F.lit(1), F.least(F.length("piece"), F.lit(CELL)))
    places = cells.select("*", F.explode(F.filter(letters, lambda i: F.contains("firsts", F.substr("piece", i, F.lit(1))))).alias("i"))
    begun = places.select("path", "no", "span", "size", F.substr("piece", F.col("i"), F.col("size")).alias("head"), (F.col("cell").cast("long") * CELL + F.col("i") - 1).alias("at"))
    hits = begun.join(heads, ["path", "size", "head"]).select("path", "no", F.floor(F.col("at") / F.col("span")).cast("int").alias("block"), (F.col("at") % F.col("span") + 1).cast("int").alias("start"), "lengths")
    blocks = sized.select("path", "no", *flags, F.posexplode(_cut("text", F.col("span"), F.col("span"))).alias("block", "piece"))
    cuts = hits.join(blocks, ["path", "no", "block"]).select("path", *flags, "piece", "start", F.explode("lengths").alias("n"))
    # a piece that ends early is shorter than any value of that length
    found = cuts.filter(F.col("start") + F.col("n") <= F.length("piece") + 1).select("path", F.substr("piece", F.col("start"), F.col("n")).alias("value"), *flags)
    once = found.groupBy("path", "value").agg(*(F.max(f).alias(f) for f in flags)) if flags else found.distinct()
    return once.join(wanted, ["path", "value"], "left_semi")


def report_items(reports: DataFrame, items: DataFrame) -> DataFrame:
    """Open items that no line of the report names, or none with their label, and texts of any item that the report does not hold.

    items: (path, id, status, attention_level, and any of ``FIELDS``). White space does not count in texts. Without a report nothing is compared.
    """
    said = items.filter("id is not null").join(reports.select("path").distinct(), "path", "left_semi")
    opened = said.filter("status = 'open'").select("path", "id", F.when(F.col("attention_level") == "action_required", LABELS["action_required"]).otherwise(LABELS["needs_review"]).alias("label")).distinct()
    lines = report_lines(reports).select("path", F.col("line").alias("no"), "text", *(F.contains("text", F.lit(label)).alias(level) for level, label in LABELS.items()))
    there = occurrences(lines, opened.select("path", F.col("id").alias("value")), LABELS).withColumnRenamed("value", "id")
    labelled = F.coalesce(*(F.when(F.col("label") == label, F.col(level)) for level, label in LABELS.items()))
    seen = opened.join(there, ["path", "id"], "left").select("path", "id", labelled.alias("labelled"))
    found = _issue(seen.filter("labelled is null"), "item_not_recorded", "id").unionByName(_issue(seen.filter("not labelled"), "item_label", "id"))
    fields = [f for f in FIELDS if f in items.columns]
    if not fields:
        return found
    texts = said.select("path", "id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), normalized(f).alias("value")) for f in fields))).alias("x")).select("path", "id", "x.*").filter("value <> ''")
    whole = reports.filter("text is not null").select("path", F.lit(0).alias("no"), normalized("text").alias("text"))
    lost = texts.join(whole.select("path").distinct(), "path", "left_semi").join(occurrences(whole, texts), ["path", "value"], "left_anti")
    return found.unionByName(_issue(lost, "item_text", F.concat_ws("/", "id", "field")))


def translation_tasks(tasks: DataFrame, transformations: DataFrame) -> DataFrame:
    """Tasks given twice, for formulas that are not opaque, or with another source formula, and opaque formulas of a period without a task.

    tasks: (path, transformation_id, period_id, formula); transformations: (path, id, status, source_expressions).
    """
    sources = transformations.filter("status = 'opaque'").select("path", F.col("id").alias("transformation_id"), F.explode("source_expressions").alias("period_id", "source"))
    opaque = transformations.filter("status = 'opaque'").select("path", F.col("id").alias("transformation_id"), F.lit(True).alias("opaque")).distinct()
    key = F.concat_ws("|", "transformation_id", "period_id")
    found = _issue(tasks.groupBy("path", "transformation_id", "period_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "task_twice", key)
    j = tasks.join(opaque, ["path", "transformation_id"], "left").join(sources, ["path", "transformation_id", "period_id"], "left")
    state = F.when(F.col("opaque").isNull(), "task_not_opaque").when(~F.col("formula").eqNullSafe(F.col("source")), "task_formula")
    found = found.unionByName(_issue(j.filter(state.isNotNull()), state, key))
    covered = j.filter(state.isNull()).select("path", "transformation_id", "period_id")
    return found.unionByName(_issue(sources.join(covered, ["path", "transformation_id", "period_id"], "left_anti"), "no_task", key))


def privacy(reports: DataFrame) -> DataFrame:
    """Texts that show a path of someone's machine."""
    return _issue(reports.filter(F.col("text").rlike(_LOCAL)), "local_path", "path")
