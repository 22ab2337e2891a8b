"""Lenient numbers, number text and safe division as Column expressions (no UDFs)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
#: White space that Java's \s leaves out.
_SPACE = "[\\s\\x0B ﻿  -     　]+"
_PREFIX = r"^[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def num(value: Column, kind: T.DataType) -> Column:
    """A double that is never null or NaN: blanks and garbage are 0.

    Texts lose white space; of comma and dot the last one is the decimal mark, a lone comma kind too;
    then the longest numeric prefix counts. Numeric columns skip all that, so that filters on them can
    be pushed down.
    """
    if isinstance(kind, T.IntegralType | T.DecimalType):
        return F.coalesce(value.cast("double"), F.lit(0.0))
    if isinstance(kind, T.FractionalType):
        return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    if isinstance(kind, T.BooleanType):
        return F.when(value, 1.0).otherwise(0.0)
    if isinstance(kind, T.NullType):
        return F.lit(0.0)
    if not isinstance(kind, T.StringType):
        return F.lit(0.0) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else F.coalesce(value.cast("timestamp").cast("double"), F.lit(0.0))
    bare = F.regexp_replace(value, _SPACE, "")
    comma, dot = (F.instr(F.reverse(bare), m) for m in (",", "."))  # distance from the end, 0 if absent
    plain = F.when((comma > 0) & (dot > 0) & (dot < comma), F.translate(bare, ",", "")).when((comma > 0) & (dot > 0), F.translate(F.translate(bare, ".", ""), ",", ".")).otherwise(F.translate(bare, ",", "."))
    return F.coalesce(F.nanvl(F.regexp_extract(plain, _PREFIX, 0).try_cast("double"), F.lit(0.0)), F.lit(0.0))


def js_text(value: Column, kind: T.DataType) -> Column:
    """The text of a value as a label; null stays null. Whole doubles have no fraction, and only
    magnitudes from 1e21 or below 1e-6 have an exponent."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: js_text(x, kind.elementType)), ", ")
    if isinstance(kind, T.StructType | T.MapType):
        return F.to_json(value)
    if not isinstance(kind, T.DoubleType | T.FloatType):
        return value.cast("string")
    x = value.cast("double")
    size, text = F.abs(x), x.cast("string")
    wide = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,25)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    long = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,15)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E-", "e-"), "E", "e+")
    return (
        F.when(F.isnan(x), "NaN").when(x == INF, "Infinity").when(x == -INF, "-Infinity")
        .when((size < 1e15) & (x == F.floor(x)), F.when(size < 1e15, x).cast("long").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), text)
        .when((size >= 1e21) | (size < 1e-6), exponent)
        .when(size < 1, wide).otherwise(long)
    )


def js_round(x: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    scale = float(10**digits)
    wide = F.abs(x) >= 1e15  # no fraction, and floor() would leave the range of whole numbers
    return F.when(wide | F.isnan(x), x).otherwise(F.floor(F.when(wide | F.isnan(x), 0.0).otherwise(x) * scale + 0.5).cast("double") / scale)


def fixed(x: Column, digits: int) -> Column:
    """The text of a float (as a double) by C's printf("%.<digits>f"): the exact value counts, with halves to even and
    all digits of wide numbers. format_string() takes the shortest text for the value, with halves away from zero."""
    size, unit = F.abs(x), 10**18
    high, low = (F.floor(y).cast("decimal(19,0)") for y in (size / 2.0**65, size % 2.0**65 / 4))  # up to 2^128
    tail = high * Decimal(2**65 % unit) + low * 4
    head = high * Decimal(2**65 // unit) + F.call_function("div", tail, F.lit(Decimal(unit)))
    wide = F.concat(F.when(x < 0, "-").otherwise(""), F.ltrim(F.concat(head.cast("string"), F.lpad((tail % Decimal(unit)).cast("string"), 18, "0")), F.lit("0")), F.lit("." + "0" * digits if digits else ""))
    return F.when(F.isnan(x), "nan").when(x == INF, "inf").when(x == -INF, "-inf").when(size >= 2.0**55, wide).otherwise(F.translate(F.format_number(x, digits), ",", ""))


def divide(a: Column, b: Column) -> Column:
    """a / b of doubles by the IEEE rules: infinities and NaN, never an error."""
    by_zero = F.when((a > 0) & ~F.isnan(a), INF).when(a < 0, -INF).otherwise(float("nan"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


def div(a: Column, b: Column, fallback: Column | float = 0.0) -> Column:
    """a / b, or the fallback where b is 0 or the result isn't finite."""
    fb = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    q = F.try_divide(a, b)
    return F.when(b == 0, fb).when(finite(q), q).otherwise(fb)


def iferror(x: Column, fallback: Column | float = 0.0) -> Column:
    fb = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    return F.when(x.isNull() | finite(x), x).otherwise(fb)
