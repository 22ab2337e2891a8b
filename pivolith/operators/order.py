"""Sorting a pivot by a metric without tearing its groups apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pivolith.operators.pivot import LEVEL, SUBTOTAL


def group_sums(rows: tuple[str, ...], by: str) -> Column:
    value = F.coalesce(F.nanvl(F.col(f"`{by}`"), F.lit(0.0)), F.lit(0.0))
    return F.sum(F.when(F.col(LEVEL) == len(rows), value)).over(Window.partitionBy(F.col(LEVEL) == 0, F.col(f"`{rows[0]}`")))


def order_keys(table: DataFrame, rows: tuple[str, ...], by: str, descending: bool = False, group: Column | None = None) -> list[Column]:
    """What to order a pivot's rows by. With two or more row fields, groups of the first go by the sum of
    their leaves, whatever the aggregate; leaves by value; a group's subtotals follow its leaves.
    The total stays last; ties go by label. group: the groups' sums, if a column has them already."""
    value = F.coalesce(F.nanvl(F.col(f"`{by}`"), F.lit(0.0)), F.lit(0.0))
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    total = (F.col(LEVEL) == 0) if rows else F.lit(False)
    ties = [F.col(f"`{r}`") for r in rows]
    if len(rows) < 2:
        return [total, turn(value), *ties]
    group = group_sums(rows, by) if group is None else group
    return [total, turn(group), ties[0], F.col(SUBTOTAL), F.col(LEVEL).desc(), turn(value), *ties[1:]]


def sort_pivot(table: DataFrame, rows: tuple[str, ...], by: str, descending: bool = False) -> DataFrame:
    if len(rows) < 2:
        return table.orderBy(*order_keys(table, rows, by, descending))
    return table.withColumn("__group", group_sums(rows, by)).orderBy(*order_keys(table, rows, by, descending, F.col("__group"))).drop("__group")
