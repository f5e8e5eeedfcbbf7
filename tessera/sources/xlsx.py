"""XLSX workbooks as DataFrames: stored cells, shared formulas, sheets and comments.

Files come through Spark's binaryFile reader, so any store will do. Sheets of a workbook are dealt over tasks and parsed a row
at a time; only cells that are stored are sent, never a rectangle, and shared texts are joined by their number.
"""

from __future__ import annotations

import gzip
import io
import itertools
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_REF = re.compile(r"""("(?:[^"]|"")*"|'(?:[^']|'')*'!)|(?<![A-Za-z0-9_.$])(\$?)([A-Za-z]{1,3})(\$?)([1-9][0-9]*)(?![A-Za-z0-9_(.])""")
CELLS = "path string, sheet string, cell string, row int, col int, type string, style int, raw string, value string, formula string"


def column_index(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def shift_formula(formula: str, rows: int, columns: int) -> str:
    """The formula with its relative A1 references moved; ``$`` parts, quoted text, sheet and function names stay."""

    def move(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        col, row = column_index(m[3]) + (0 if m[2] else columns), int(m[5]) + (0 if m[4] else rows)
        if col < 1 or row < 1:
            raise ValueError(f"{m[0]} moves off the sheet")
        return f"{m[2]}{m[3] if m[2] else column_letters(col)}{m[4]}{row}"

    return _REF.sub(move, formula)


def _text(node: ET.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _sheets(package: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    """(name, part, state) in workbook order."""
    names = {r.get("Id"): r.get("Target") for r in ET.fromstring(package.read("xl/_rels/workbook.xml.rels")).iter(f"{_PKG}Relationship")}
    out = []
    for s in ET.fromstring(package.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = names[s.get(f"{_REL}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}", s.get("state", "visible")))
    return out


def shared_texts(stream: BinaryIO) -> Iterator[str]:
    """The shared texts of a workbook in order, read one by one."""
    for event, x in ET.iterparse(stream, ("start", "end")):
        if event == "start" and x.tag == f"{_MAIN}sst":
            root = x
        elif event == "end" and x.tag == f"{_MAIN}si":
            yield _text(x)
            root.clear()


def sheet_cells(stream: BinaryIO) -> Iterator[tuple]:
    """(cell, row, col, type, style, raw, value, formula) of a sheet, read row by row; the value of a shared text is left to the caller."""
    bases: dict[str, tuple[str, int, int]] = {}
    data = None
    for event, c in ET.iterparse(stream, ("start", "end")):
        if event == "start":
            data = c if c.tag == f"{_MAIN}sheetData" else data
            continue
        if c.tag == f"{_MAIN}row":
            data.clear()
        if c.tag != f"{_MAIN}c":
            continue
        ref = c.get("r")
        letters, digits = re.match(r"([A-Za-z]+)(\d+)", ref).groups()
        row, col, kind = int(digits), column_index(letters), c.get("t", "n")
        raw = c.findtext(f"{_MAIN}v")
        value = _text(c.find(f"{_MAIN}is")) if kind == "inlineStr" else raw
        if kind == "n" and raw is not None and float(raw).is_integer() and abs(float(raw)) < 2**53:
            value = str(int(float(raw)))
        elif kind == "b":
            value = {"1": "true", "0": "false"}.get(raw, raw)
        f, formula = c.find(f"{_MAIN}f"), None
        if f is not None:
            formula = f"={f.text}" if f.text else None
            if f.get("t") == "shared":
                if f.text:
                    bases[f.get("si")] = (formula, row, col)
                elif f.get("si") in bases:
                    base, r, k = bases[f.get("si")]
                    formula = shift_formula(base, row - r, col - k)
        yield ref, row, col, kind, int(c.get("s", 0)), raw, value, formula


def workbook_comments(content: bytes) -> Iterator[tuple[str, str, str]]:
    """(sheet, cell, text) of comments, without the author before the text."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        for name, part, _ in _sheets(package):
            folder, file = part.rsplit("/", 1)
            rels = f"{folder}/_rels/{file}.rels"
            if rels not in package.namelist():
                continue
            for r in ET.fromstring(package.read(rels)).iter(f"{_PKG}Relationship"):
                if not r.get("Type", "").endswith("/comments"):
                    continue
                target = r.get("Target")
                place = target.lstrip("/") if target.startswith("/") else "xl/" + target.removeprefix("../")
                root = ET.fromstring(package.read(place))
                authors = [a.text or "" for a in root.iter(f"{_MAIN}author")]
                for c in root.iter(f"{_MAIN}comment"):
                    author = authors[int(c.get("authorId", 0))] if authors else ""
                    yield name, c.get("ref"), _text(c).removeprefix(f"{author}:").strip()


#: Number formats of the file format that are not written out, and theme colours by number: dark before light.
BUILTIN_FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@"}
THEME = ["dk1", "lt1", "dk2", "lt2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink"]
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _is_on(node: ET.Element | None) -> bool:
    return node is not None and node.get("val", "1") in ("1", "true")


def _colour(node: ET.Element | None, theme: list[str | None]) -> str | None:
    """The colour as six hex digits, or ``theme`` or ``indexed`` with its number where the file does not say more; a tint is added as it stands."""
    if node is None:
        return None
    at = node.get("theme")
    base = node.get("rgb", "")[-6:] or None
    if at is not None:
        base = (theme[int(at)] if int(at) < len(theme) else None) or f"theme{at}"
    elif base is None and node.get("indexed") is not None:
        base = f"indexed{node.get('indexed')}"
    return f"{base} {float(node.get('tint')):g}" if base and node.get("tint") else base


def workbook_styles(content: bytes) -> Iterator[tuple]:
    """(style, number_format_id, number_format, font, bold, italic, font_colour, fill, fill_colour, n_borders) of each cell format."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        names = set(package.namelist())
        if "xl/styles.xml" not in names:
            yield 0, 0, "General", None, False, False, None, "none", None, 0
            return
        theme: list[str | None] = []
        if "xl/theme/theme1.xml" in names:
            scheme = ET.fromstring(package.read("xl/theme/theme1.xml")).find(f".//{_DRAW}clrScheme")
            colour = lambda n: None if n is None or not len(n) else n[0].get("lastClr") or n[0].get("val")
            theme = [colour(scheme.find(f"{_DRAW}{t}")) for t in THEME] if scheme is not None else []
        root = ET.fromstring(package.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(f"{_MAIN}numFmt")}
        part = lambda name: list(root.find(f"{_MAIN}{name}") if root.find(f"{_MAIN}{name}") is not None else [])
        fonts, fills, borders = part("fonts"), part("fills"), part("borders")
        empty = ET.Element("none")
        pick = lambda items, i: items[i] if 0 <= i < len(items) else empty
        for style, xf in enumerate(part("cellXfs") or [empty]):
            number = int(xf.get("numFmtId", 0))
            font, fill, border = (pick(x, int(xf.get(k, 0))) for x, k in ((fonts, "fontId"), (fills, "fillId"), (borders, "borderId")))
            name, pattern = font.find(f"{_MAIN}name"), fill.find(f"{_MAIN}patternFill")
            kind = pattern.get("patternType", "none") if pattern is not None else "gradient" if fill.find(f"{_MAIN}gradientFill") is not None else "none"
            shade = _colour(pattern.find(f"{_MAIN}fgColor"), theme) if pattern is not None else None
            yield style, number, own.get(number, BUILTIN_FORMATS.get(number)), name.get("val") if name is not None else None, _is_on(font.find(f"{_MAIN}b")), _is_on(font.find(f"{_MAIN}i")), _colour(font.find(f"{_MAIN}color"), theme), kind, shade, sum(b.get("style") is not None for b in border)


def workbook_sheets(content: bytes) -> Iterator[tuple]:
    """(sheet, state, dimension, freeze, merged, hidden_rows, hidden_columns, n_rules, n_links) of each sheet."""
    on = ("1", "true")
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        for name, part, state in _sheets(package):
            root = ET.fromstring(package.read(part))
            dimension, pane = root.find(f"{_MAIN}dimension"), root.find(f".//{_MAIN}pane")
            hidden = [int(r.get("r", 0)) for r in root.iter(f"{_MAIN}row") if r.get("hidden") in on]
            columns = [k for c in root.iter(f"{_MAIN}col") if c.get("hidden") in on for k in range(int(c.get("min", 0)), int(c.get("max", 0)) + 1)]
            merged = [m.get("ref", "") for m in root.iter(f"{_MAIN}mergeCell")]
            yield name, state, dimension.get("ref", "") if dimension is not None else "", pane.get("topLeftCell") if pane is not None else None, merged, hidden, columns, len(list(root.iter(f"{_MAIN}cfRule"))), len(list(root.iter(f"{_MAIN}hyperlink")))


def _each_workbook(spark: SparkSession, path: str, rows: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(path, rows of ``rows``) of all workbooks of a path."""
    columns = [c.split()[0] for c in f"path string, {schema}".split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(file, *r) for r in rows(content)], columns=columns)

    return _files(spark, path).mapInPandas(run, f"path string, {schema}")


def read_styles(spark: SparkSession, path: str) -> DataFrame:
    """The cell formats of all workbooks: (path, style, number format, font, fill, borders)."""
    return _each_workbook(spark, path, workbook_styles, "style int, number_format_id int, number_format string, font string, bold boolean, italic boolean, font_colour string, fill string, fill_colour string, n_borders int")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """What is said of sheets: state, size, frozen pane, merged ranges, hidden rows and columns, numbers of rules and links."""
    return _each_workbook(spark, path, workbook_sheets, "sheet string, state string, dimension string, freeze string, merged array<string>, hidden_rows array<int>, hidden_columns array<int>, n_rules int, n_links int")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, risk) of the parts of all workbooks; risk: macros, external_links, connections, embeddings, binary, media that few can render, or null."""

    def names(content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            yield from ((n,) for n in package.namelist())

    part = F.col("part")
    risk = F.when(part.contains("vbaProject"), "macros").when(part.startswith("xl/externalLinks/"), "external_links").when(part == "xl/connections.xml", "connections").when(part.startswith("xl/embeddings/"), "embeddings").when(part.endswith(".bin"), "binary").when(part.startswith("xl/media/") & F.lower(part).rlike(r"[.](emf|wmf)$"), "media")
    return _each_workbook(spark, path, names, "part string").withColumn("risk", risk)


def with_styles(cells: DataFrame, styles: DataFrame) -> DataFrame:
    """``cells`` with the columns of their style; a style that the workbook does not have is its first one. Styles are few and are broadcast while small."""
    named = [c for c in styles.columns if c not in ("path", "style")]
    own = styles.select("path", "style", F.struct(*named).alias("_own"))
    first = styles.filter("style = 0").select("path", F.struct(*named).alias("_first"))
    joined = cells.join(own, ["path", "style"], "left").join(first, "path", "left").withColumn("_s", F.coalesce("_own", "_first"))
    return joined.select(*cells.columns, *(F.col(f"_s.{c}").alias(c) for c in named))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: Cells or texts that are sent at once.
_ROWS = 10_000


def _chunks(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while part := list(itertools.islice(rows, _ROWS)):
        yield pd.DataFrame(part, columns=columns)


def read_cells(spark: SparkSession, path: str, sheets: list[str] | None = None) -> DataFrame:
    """Stored cells of all workbooks of a path; only the named sheets, if given.

    A first pass unpacks each workbook into its sheets, which are dealt over tasks by their names; a sheet is read row by row.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as package:
                    for name, part, _ in _sheets(package):
                        if sheets is None or name in sheets:
                            packed = io.BytesIO()
                            with package.open(part) as source, gzip.GzipFile(fileobj=packed, mode="wb", compresslevel=1) as target:
                                while piece := source.read(1 << 20):
                                    target.write(piece)
                            yield pd.DataFrame([(file, name, packed.getvalue())], columns=["path", "sheet", "xml"])

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as package:
                    if "xl/sharedStrings.xml" in package.namelist():
                        with package.open("xl/sharedStrings.xml") as stream:
                            yield from _chunks(((file, str(i), t) for i, t in enumerate(shared_texts(stream))), ["path", "raw", "_text"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        for pdf in batches:
            for file, name, xml in zip(pdf["path"], pdf["sheet"], pdf["xml"], strict=True):
                yield from _chunks(((file, name, *c) for c in sheet_cells(gzip.GzipFile(fileobj=io.BytesIO(xml)))), names)

    unpacked = _files(spark, path).mapInPandas(unpack, "path string, sheet string, xml binary").repartition("path", "sheet")
    cells = unpacked.mapInPandas(parse, CELLS)
    shared = _files(spark, path).mapInPandas(texts, "path string, raw string, _text string").withColumn("type", F.lit("s"))
    joined = cells.join(shared, ["path", "raw", "type"], "left")
    return joined.withColumn("value", F.when(F.col("type") == "s", F.col("_text")).otherwise(F.col("value"))).select(*(c.split()[0] for c in CELLS.split(", ")))


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(file, *c) for c in workbook_comments(content)], columns=["path", "sheet", "cell", "text"])

    return _files(spark, path).mapInPandas(run, "path string, sheet string, cell string, text string")


def inventory(cells: DataFrame) -> DataFrame:
    """(path, sheet, stored, non_empty, formulas, external, styles): counts of each sheet.

    A cell is not empty if a value, even an empty text, or a formula is stored, whether or not that has a result.
    """
    return cells.groupBy("path", "sheet").agg(
        F.count(F.lit(1)).alias("stored"),
        F.count_if(F.col("value").isNotNull() | F.col("formula").isNotNull()).alias("non_empty"),
        F.count_if(F.col("formula").isNotNull()).alias("formulas"),
        F.count_if(F.col("formula").contains("[") & F.col("formula").contains("]")).alias("external"),
        F.count_distinct("style").alias("styles"),
    )
