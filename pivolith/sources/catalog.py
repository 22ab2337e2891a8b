"""Named sources behind an allow-list."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(value: Column, kind: T.DataType) -> Column:
    """Arrays as text joined by ", ", structs and maps as JSON, NaN and infinities as null."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: flat(x, kind.elementType).cast("string")), ", ")
    if isinstance(kind, T.StructType | T.MapType):
        return F.to_json(value)
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    if isinstance(kind, T.NumericType | T.BooleanType | T.StringType):
        return value
    return value.cast("string")


def flatten(df: DataFrame) -> DataFrame:
    return df.select(*[flat(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


class Catalog:
    """Sources by name: a function of the session, a table or view name, or a Parquet path."""

    def __init__(self, spark: SparkSession, sources: dict[str, Callable[[SparkSession], DataFrame] | str] | None = None, allowed: Iterable[str] | None = None) -> None:
        self.spark, self.sources = spark, dict(sources or {})
        said = os.environ.get("ALLOWED_COLLECTIONS", "")
        self.allowed = list(allowed) if allowed is not None else [s.strip() for s in said.split(",") if s.strip()] or list(self.sources)

    def register(self, name: str, source: Callable[[SparkSession], DataFrame] | str) -> None:
        self.sources[name] = source
        if name not in self.allowed:
            self.allowed.append(name)

    def names(self) -> list[str]:
        return list(self.allowed)

    def get(self, name: str) -> DataFrame:
        if name not in self.allowed:
            raise ValueError(f"source {name!r} isn't allowed")
        source = self.sources.get(name, name)
        if callable(source):
            return source(self.spark)
        return self.spark.read.parquet(source) if "/" in source else self.spark.table(source)

    def fields(self, name: str, sample: int = 200) -> dict[str, str]:
        """Field names with their types; of VARIANT fields the type of the first value in a sample."""
        df = self.get(name)
        dynamic = [f.name for f in df.schema.fields if f.dataType.simpleString() == "variant"]
        found = df.limit(sample).agg(*[F.first(F.expr(f"schema_of_variant(`{c}`)"), ignorenulls=True).alias(c) for c in dynamic]).first().asDict() if dynamic else {}
        return {f.name: found.get(f.name) or f.dataType.simpleString() for f in df.schema.fields}

    def peek(self, name: str, limit: int = 50) -> DataFrame:
        return flatten(self.get(name).drop("_id").limit(limit))
