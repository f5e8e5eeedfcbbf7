"""Package checks against plain string checks."""

import random
import re

from tessera.operators import packages


def make_report(rng, items, drop=()):
    out = ["# Extraction report", ""]
    for name in packages.SECTIONS:
        if name in drop:
            continue
        out += [f"## {name}", "", "Text of the section."]
        if name == "Unresolved mappings":
            for i, level, text in items:
                if rng.random() < 0.85:
                    out.append(f"- {packages.LABELS[level] if rng.random() < 0.85 else 'note'} `{i}`: {text.replace(' ', rng.choice([' ', chr(10), '  ']), 1) if rng.random() < 0.9 else 'other'}")
        if name == "Validator result":
            out.append("`check-extraction` passed")
    return "\n".join(out)


def test_items_of_reports_match_plain_checks(spark):
    rng = random.Random(6)
    reports, items = [], []
    for p in range(12):
        mine = [(f"unresolved_item_{p}_{k}" if k % 7 else f"u{k}", rng.choice(list(packages.LABELS)), f"the cell {k} of sheet {p} is blank") for k in range(20)]
        reports.append((f"p{p}", make_report(rng, mine)))
        items += [(f"p{p}", i, "open" if rng.random() < 0.8 else "resolved", level, text if rng.random() < 0.9 else None, 1) for i, level, text in mine]
    items.append(("p_without", "x", "open", "needs_review", "t", 1))
    want = set()
    for path, i, status, level, text, _ in items:
        report = dict(reports).get(path)
        if report is None:
            continue
        lines = [x for x in re.split("\r?\n", report) if i in x]
        if status == "open" and not lines:
            want.add((path, "item_not_recorded", i))
        elif status == "open" and not any(packages.LABELS[level] in x for x in lines):
            want.add((path, "item_label", i))
        if text and " ".join(text.split()) not in " ".join(report.split()):
            want.add((path, "item_text", f"{i}/description"))
    frame = spark.createDataFrame(items, "path string, id string, status string, attention_level string, description string, line int")
    found = packages.report_items(spark.createDataFrame(reports, "path string, text string"), frame)
    assert {tuple(r) for r in found.collect()} == want and {x[1] for x in want} == {"item_not_recorded", "item_label", "item_text"}
    assert packages.report_items(spark.createDataFrame([], "path string, text string"), frame).count() == 0


def test_values_are_found_anywhere_in_long_and_alike_texts(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["ab", "abab", "b", "\U0001f600a", "a b", "."])
    texts = [(f"p{k % 3}", k, "".join(word() for _ in range(rng.choice([0, 3, 40, 400]))), k % 4 == 0) for k in range(24)]
    values = {(f"p{k % 3}", "".join(word() for _ in range(1 + k % 5))) for k in range(200)}
    values |= {(path, text[at : at + size]) for path, _, text, _ in texts for at, size in ((0, 1), (7, 3), (61, 4), (62, 70), (100, 300), (0, len(text))) if text[at : at + size]}
    values |= {(path, value + "!") for path, value in list(values)[:50]} | {("none", "ab"), ("p0", "x" * 500)}
    want = {(path, v, any(flag for p, _, t, flag in texts if p == path and v in t)) for path, v in values if any(p == path and v in t for p, _, t, _ in texts)}
    found = packages.occurrences(spark.createDataFrame(texts, "path string, no int, text string, marked boolean"), spark.createDataFrame(list(values), "path string, value string"), ["marked"])
    assert {tuple(r) for r in found.collect()} == want and len({x[2] for x in want}) == 2 and len(want) < len(values)


def test_no_value_is_compared_with_a_whole_report(spark):
    items = spark.createDataFrame([("p", "u1", "open", "needs_review", "a text")], "path string, id string, status string, attention_level string, description string")
    plan = packages.report_items(spark.createDataFrame([("p", "# x")], "path string, text string"), items)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(_text" not in plan and not re.search(r"Contains\(text#\d+, id#", plan)


def test_form_of_reports(spark):
    rng = random.Random(1)
    good = make_report(rng, [])
    swapped = good.replace("## Inventory", "## x").replace("## Object counts", "## Inventory").replace("## x", "## Object counts")
    rows = [("good", good), ("title", good.replace("# Extraction report\n", "# Report\n", 1)), ("less", make_report(rng, [], drop=("Missing lineage",))), ("swapped", swapped), ("empty", re.sub(r"(## Inventory\n)\nText of the section.", r"\1  ", good)), ("command", good.replace("`check-extraction` passed", "passed")), ("path", good + "\nsee /home/someone/x or C:\\x"), ("nothing", "")]
    df = spark.createDataFrame(rows, "path string, text string")
    found = {tuple(r) for r in packages.report_form(df).filter("path <> 'nothing'").collect()}
    assert found == {("title", "no_title", "title"), ("less", "no_section", "Missing lineage"), ("swapped", "section_order", "Object counts"), ("empty", "empty_section", "Inventory"), ("command", "no_command", "Validator result")}
    assert packages.report_form(df).filter("path = 'nothing'").count() == 12
    assert [r["path"] for r in packages.privacy(df).collect()] == ["path"]


def test_translation_tasks(spark):
    t = spark.createDataFrame([("p", "t1", "opaque", {"y1": "=A1", "y2": "=A2"}), ("p", "t2", "supported", {"y1": "=B1"}), ("q", "t1", "opaque", {"y1": "=C1"})], "path string, id string, status string, source_expressions map<string,string>")
    tasks = spark.createDataFrame([("p", "t1", "y1", "=A1"), ("p", "t1", "y1", "=A1"), ("p", "t1", "y2", "=Z"), ("p", "t2", "y1", "=B1"), ("p", "t9", "y1", "=B1")], "path string, transformation_id string, period_id string, formula string")
    assert {tuple(r) for r in packages.translation_tasks(tasks, t).collect()} == {("p", "task_twice", "t1|y1"), ("p", "task_formula", "t1|y2"), ("p", "no_task", "t1|y2"), ("p", "task_not_opaque", "t2|y1"), ("p", "task_not_opaque", "t9|y1"), ("q", "no_task", "t1|y1")}
