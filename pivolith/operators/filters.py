"""Row filters that stand before aggregation: text on row fields, ranges on metrics."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pivolith.functions.numeric import js_text, num
from pivolith.operators.computed import with_computed


def text_filter(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Rows whose fields contain the (trimmed) texts, whatever their case. 0 and false count as empty."""
    for name, text in wanted.items():
        said = text.strip().lower()
        if said:
            kind = df.schema[name].dataType
            value = F.coalesce(js_text(F.col(f"`{name}`"), kind), F.lit(""))
            if isinstance(kind, T.NumericType | T.BooleanType):
                value = F.when(num(F.col(f"`{name}`"), kind) == 0, "").otherwise(value)
            df = df.where(F.lower(value).contains(said))
    return df


def range_filter(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows whose fields, as numbers, lie between the bounds, both included; None is no bound."""
    for name, (least, most) in ranges.items():
        kind, column = df.schema[name].dataType, F.col(f"`{name}`")
        tests = [lambda x, b=float(b), up=up: x >= b if up else x <= b for b, up in ((least, True), (most, False)) if b is not None]
        if not tests:
            continue
        if not isinstance(kind, T.NumericType):
            df = df.where(reduce(lambda a, b: a & b, [t(num(column, kind)) for t in tests]))
            continue
        inside = reduce(lambda a, b: a & b, [t(column) for t in tests])  # reaches the scan
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            blank = column.isNull() | F.isnan(column)
            inside = inside & ~F.isnan(column) if most is None else inside
        else:
            blank = column.isNull()
        df = df.where(inside | blank if (least is None or least <= 0) and (most is None or most >= 0) else inside)
    return df


def search_fields(df: DataFrame, said: str = "", hidden: tuple[str, ...] = ()) -> list[str]:
    """Field names with a text in them, sorted, without hidden ones."""
    return sorted(c for c in df.columns if said.lower() in c.lower() and c not in hidden)


def prepared(df: DataFrame, formulas: Mapping[str, str] | None = None, texts: Mapping[str, str] | None = None, ranges: Mapping[str, tuple[float | None, float | None]] | None = None, fallback: float | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """The rows that a pivot sees: computed fields, then text filters, then ranges, either of which may be on computed fields."""
    return range_filter(text_filter(with_computed(df, formulas or {}, fallback, aliases), texts or {}), ranges or {})


def raw_view(df: DataFrame, hidden: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """Rows as they are shown unpivoted: every field that isn't hidden as text, null as ''."""
    shown = df.select(*[F.coalesce(js_text(F.col(f"`{f.name}`"), f.dataType), F.lit("")).alias(f.name) for f in df.schema.fields if f.name not in hidden])
    return shown.limit(limit) if limit else shown
