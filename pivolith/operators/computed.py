"""Computed fields: formulas over the numbers of a row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pivolith.functions import formula
from pivolith.functions.numeric import iferror, num


def parsed(formulas: Mapping[str, str], fields: list[str], aliases: Mapping[str, str] | None = None) -> dict[str, formula.Node]:
    names = list(dict.fromkeys([*fields, *formulas]))
    return {n: formula.parse(text, names, aliases) for n, text in formulas.items()}


def with_computed(df: DataFrame, formulas: Mapping[str, str], fallback: float | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """df with a double column for each formula, which may use fields and other formulas. Members of
    a cycle, and what uses them, are 0. fallback replaces results that aren't finite;
    aliases are other spellings of fields in formulas."""
    trees = parsed(formulas, df.columns, aliases)
    order, lost = formula.in_order(trees)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for name in [*order, *[n for n in trees if n in lost]]:
        value = F.lit(0.0) if name in lost else formula.lower(trees[name], lambda f: num(F.col(f"`{f}`"), kinds[f]))
        df = df.withColumn(name, value if fallback is None or name in lost else iferror(value, fallback))
        kinds[name] = T.DoubleType()
    return df


def put(formulas: Mapping[str, str], name: str, text: str, fields: list[str], aliases: Mapping[str, str] | None = None) -> dict[str, str]:
    """The formulas with one added or replaced, which then comes last. A blank name or a formula that can't be read is an error."""
    if not name.strip():
        raise ValueError("a computed field has a name")
    out = {n: t for n, t in formulas.items() if n != name} | {name: text}
    parsed(out, [f for f in fields if f not in out], aliases)
    return out


def drop(formulas: Mapping[str, str], name: str) -> dict[str, str]:
    return {n: t for n, t in formulas.items() if n != name}
