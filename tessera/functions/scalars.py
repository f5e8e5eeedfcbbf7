"""Scalar functions of the expression language and of the projections, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, scale: Column) -> Column:
    """``floor(x * scale + 0.5) / scale``: halves go toward plus infinity. Large numbers stay as they are."""
    y = x * scale
    low = F.floor(y).cast("double")
    rounded = F.when(F.abs(y) >= 2.0**52, y).otherwise(low + F.when(y - low >= 0.5, 1.0).otherwise(0.0))
    return divide(rounded, scale)


def floor_mod(value: Column, divisor: Column) -> Column:
    """``v - d * floor(v / d)``: the sign of the divisor. Null for a zero divisor (the language reports it as an error)."""
    return F.when(divisor != 0, value - divisor * F.floor(value / divisor))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN and no error; dividing by it is multiplying by an infinity."""
    return F.coalesce(F.try_divide(a, b), a * F.when(b == 0, float("inf")))


def is_finite(x: Column) -> Column:
    return F.abs(x) < float("inf")  # NaN is above all numbers


def cell_row(cell: Column) -> Column:
    """Row number of an A1 reference, or of the first cell of a range; null if there is none."""
    found = F.regexp_extract(F.replace(cell, F.lit("$"), F.lit("")), r"^[A-Za-z]+([0-9]+)", 1)
    return F.when(found != "", found.cast("long"))


def cell_column(cell: Column) -> Column:
    """Upper-case column letters of an A1 reference; null if there are none."""
    found = F.upper(F.regexp_extract(F.replace(cell, F.lit("$"), F.lit("")), r"^([A-Za-z]+)[0-9]+", 1))
    return F.when(found != "", found)


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda n, c: n * 26 + (F.ascii(c) - 64))


def formula_kind(status: Column, has_dependencies: Column, source_formula: Column) -> Column:
    """``constant`` for a supported formula without inputs whose source holds only numbers, percents and operators."""
    rest = F.regexp_replace(F.coalesce(source_formula, F.lit("")), r"^\s*=", "")
    rest = F.regexp_replace(rest, r"[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?|\.[0-9]+", "")
    plain = (F.regexp_replace(rest, r"[\s()+\-*/^%,]", "") == "") & F.coalesce(source_formula, F.lit("")).rlike("[0-9]")
    return F.when((status != "supported") | has_dependencies, "expression").when(plain, "constant").otherwise("expression")


def _digits(x: Column, least: int, most: int, percent: bool = False) -> Column:
    """``x`` (not negative; a hundredfold if ``percent``) with thousands separators and ``least`` to ``most`` decimals.

    Halves of its shortest decimal form go up. Numbers of 10^23 or more, and infinities, are formatted as doubles.
    """
    exact = x.cast("string").try_cast("decimal(38,15)")
    text = F.coalesce(F.format_number(F.round(exact * 100 if percent else exact, most), most), F.format_number(x * 100 if percent else x, most))
    return F.regexp_replace(text, f"0{{0,{most - least}}}$", "") if most > least else text


def format_value(kind: Column, num: Column, text: Column, flag: Column, data_type: Column, inspector: bool = False) -> Column:
    """Display text of a tagged value: a dash for null, Yes or No, text as it is, percents, counts without decimals, others with one.

    In tables negative numbers but percents stand in parentheses; the inspector shows a minus sign and up to two decimals.
    """
    most = 2 if inspector else 1
    size = F.abs(num)
    percent = F.concat(F.when(num < 0, "-").otherwise(""), _digits(size, 1, most, percent=True), F.lit("%"))
    plain = F.when(data_type == "count", _digits(size, 0, 0)).otherwise(_digits(size, 1, most))
    signed = F.when(num < 0, F.concat(F.lit("-"), plain) if inspector else F.concat(F.lit("("), plain, F.lit(")"))).otherwise(plain)
    number = F.when(data_type == "percentage", percent).otherwise(signed)
    return F.when(kind == "null", "—").when(kind == "boolean", F.when(flag, "Yes").otherwise("No")).when(kind == "string", text).otherwise(number)
