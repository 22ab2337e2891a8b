"""Document-style filters, projections, skip and limit as Columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pivolith.functions.numeric import num

_NUMBER = (int, float)


def parse_filter(text: str) -> dict:
    """The filter of a JSON text; anything but an object is an error."""
    found = json.loads(text) if text.strip() else {}
    if not isinstance(found, dict):
        raise ValueError("a filter is a JSON object")
    return found


def _each(values: Column, name: str) -> Column:
    """What the elements hold under a name; null if none holds anything."""
    found = F.filter(F.transform(values, lambda x: x.getField(name)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def at_path(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """A column by name, or by dotted path into structs, maps and JSON texts. A path through an array of
    structs gives the array of what its elements hold there."""
    if path in df.columns:
        return F.col(f"`{path}`"), df.schema[path].dataType
    head, *rest = path.split(".")
    if head not in df.columns:
        return F.lit(None).cast("string"), T.NullType()
    value, kind = F.col(f"`{head}`"), df.schema[head].dataType
    while rest:
        step = rest.pop(0)
        if isinstance(kind, T.StructType):
            if step not in kind.names:
                return F.lit(None).cast("string"), T.NullType()
            value, kind = value.getField(step), kind[step].dataType
        elif isinstance(kind, T.MapType):
            value, kind = F.try_element_at(value, F.lit(step)), kind.valueType
        elif isinstance(kind, T.ArrayType) and step.isdigit():
            value, kind = F.get(value, F.lit(int(step))), kind.elementType
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            if step not in kind.elementType.names:
                return F.lit(None).cast("string"), T.NullType()
            value, kind = _each(value, step), T.ArrayType(kind.elementType[step].dataType)
            if isinstance(kind.elementType, T.ArrayType):
                value, kind = F.flatten(value), kind.elementType
        elif isinstance(kind, T.StringType):
            return F.get_json_object(value, "$." + ".".join([step, *rest])), T.VariantType() if hasattr(T, "VariantType") else kind
        else:
            return F.lit(None).cast("string"), T.NullType()
    return value, kind


def _comparable(value: Column, kind: T.DataType, other: Any) -> Column | None:
    """The column as something to compare with a literal, or None if the types never compare."""
    json_text = isinstance(kind, getattr(T, "VariantType", ()))
    if isinstance(other, bool):
        return value if isinstance(kind, T.BooleanType) else F.when(value.isin("true", "false"), value.try_cast("boolean")) if json_text else None
    if isinstance(other, _NUMBER):
        return value if isinstance(kind, T.NumericType) else value.try_cast("double") if json_text else None
    if isinstance(other, str):
        return value if json_text or isinstance(kind, T.StringType | T.TimestampType | T.DateType | T.TimestampNTZType) else None
    return value


def _same(value: Column, kind: T.DataType, other: Any) -> Column:
    if other is None:
        return value.isNull()
    if isinstance(other, list):
        return value == F.array(*map(F.lit, other)) if isinstance(kind, T.ArrayType) else F.lit(False)
    if isinstance(kind, T.ArrayType):
        own = _comparable(value, kind.elementType, other)
        return F.lit(False) if own is None else F.exists(value, lambda x: x == F.lit(other))
    own = _comparable(value, kind, other)
    return F.lit(False) if own is None else own == F.lit(other)


def _ordered(sign: str, value: Column, kind: T.DataType, other: Any, lenient: bool) -> Column:
    if lenient:
        text = isinstance(kind, getattr(T, "VariantType", ()))
        value, other = num(value, T.StringType() if text else kind), num(F.lit(other), T.StringType() if isinstance(other, str) else T.DoubleType())
    else:
        value = _comparable(value, kind, other)
        if value is None or other is None:
            return F.lit(False)
        other = F.lit(other)
    return {"$gt": value > other, "$gte": value >= other, "$lt": value < other, "$lte": value <= other}[sign]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def _no(test: Column) -> Column:
    """Not; a test without an answer, as of a null, counts as failed first."""
    return ~F.coalesce(test, F.lit(False))


def _some(df: DataFrame, value: Column, kind: T.DataType, want: Any, lenient: bool) -> Column:
    return F.exists(value, lambda x: _field(df, x, kind, want, lenient))


def _holds(df: DataFrame, kind: T.DataType, want: Any, lenient: bool) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(_field(df, x, kind, want, lenient), F.lit(False))


def _field(df: DataFrame, value: Column, kind: T.DataType, want: Any, lenient: bool) -> Column:
    if not (isinstance(want, Mapping) and any(k.startswith("$") for k in want)):
        return _same(value, kind, want)
    tests = []
    each = kind.elementType if isinstance(kind, T.ArrayType) else None
    for sign, other in want.items():
        if each is not None and sign in ("$gt", "$gte", "$lt", "$lte", "$regex", "$in", "$mod"):  # any element will do
            own = {sign: other} | ({"$options": want["$options"]} if sign == "$regex" and "$options" in want else {})
            tests.append(F.exists(value, _holds(df, each, own, lenient)))
        elif each is not None and sign == "$nin":
            tests.append(_no(_field(df, value, kind, {"$in": other}, lenient)))
        elif sign == "$eq":
            tests.append(_same(value, kind, other))
        elif sign == "$ne":
            tests.append(_no(_same(value, kind, other)))
        elif sign in ("$gt", "$gte", "$lt", "$lte"):
            tests.append(_ordered(sign, value, kind, other, lenient))
        elif sign in ("$in", "$nin"):
            hit = _any([_same(value, kind, x) for x in other]) if not _plain(kind, other) else value.isin(other)
            tests.append(hit if sign == "$in" else _no(hit))
        elif sign == "$regex":
            flags = "".join(f for f in "imsx" if f in want.get("$options", ""))
            tests.append(F.coalesce(value.cast("string"), F.lit("")).rlike((f"(?{flags})" if flags else "") + other))
        elif sign == "$options":
            continue
        elif sign == "$exists":
            tests.append(value.isNotNull() if other else value.isNull())
        elif sign == "$not":
            tests.append(_no(_field(df, value, kind, other, lenient)))
        elif sign == "$mod":
            tests.append(F.try_mod(num(value, kind).cast("long"), F.lit(int(other[0]))) == int(other[1]))
        elif sign == "$size":
            tests.append((value.isNotNull() & (F.size(value) == other)) if isinstance(kind, T.ArrayType) else F.lit(False))
        elif sign == "$all":
            tests.append(_all([_same(value, kind, x) for x in other]) if other else F.lit(False))
        elif sign == "$elemMatch" and isinstance(kind, T.ArrayType):
            tests.append(_some(df, value, kind.elementType, other, lenient))
        else:
            raise ValueError(f"unknown operator {sign}")
    return _all(tests)


def _plain(kind: T.DataType, values: list) -> bool:
    """Whether isin() says it all, so that the scan can use it."""
    return bool(values) and (isinstance(kind, T.StringType) and all(isinstance(v, str) for v in values) or isinstance(kind, T.NumericType) and all(isinstance(v, _NUMBER) and not isinstance(v, bool) for v in values))


def condition(df: DataFrame, want: Mapping[str, Any] | None, lenient: bool = False) -> Column:
    """A filter as a Column; sibling keys are AND-ed. Where a value is null, the Column may be null
    instead of false, which where() takes alike: so plain comparisons reach the scan.

    lenient: order comparisons turn both sides into numbers, blanks and garbage being 0. Otherwise
    values of different types never compare. Null and missing are the same: `{f: null}` finds both,
    $ne and $nin let them through.
    """
    tests = []
    for name, value in (want or {}).items():
        if name in ("$and", "$or", "$nor"):
            parts = [condition(df, x, lenient) for x in value]
            tests.append(_all(parts) if name == "$and" else _any(parts) if name == "$or" else _no(_any(parts)))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        else:
            tests.append(_field(df, *at_path(df, name), value, lenient))
    return _all(tests)


def project(df: DataFrame, projection: Mapping[str, int] | None) -> DataFrame:
    """Fields with 1 are kept, with `_id` unless it has 0; else fields with 0 are dropped."""
    projection = {"_id": 0} if projection is None else projection
    wanted = [c for c in df.columns if projection.get(c) == 1 or (c == "_id" and projection.get("_id", 1))]
    if any(v for k, v in projection.items() if k != "_id"):
        return df.select(*[F.col(f"`{c}`") for c in wanted])
    return df.drop(*[k for k, v in projection.items() if not v])


def find(df: DataFrame, filters: Mapping[str, Any] | None = None, projection: Mapping[str, int] | None = None, skip: int = 0, limit: int = 0, order_by: list[str] | None = None, lenient: bool = False) -> DataFrame:
    """Filter, project, skip, limit, in this order. A limit of 0 is none. Skip and limit are only
    repeatable with order_by."""
    if filters is not None and not isinstance(filters, Mapping):
        raise ValueError("filters are an object")
    out = df.where(condition(df, filters, lenient)) if filters else df
    if order_by:
        out = out.orderBy(*order_by)
    out = project(out, projection)
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit else out
