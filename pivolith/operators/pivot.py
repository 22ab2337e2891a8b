"""Pivot: row levels by column keys, subtotals, a grand total, computed metrics.

The base rows are aggregated once, to the leaves (row labels and column key); sums, counts, minima and
maxima of leaves merge, so subtotals and the total are grouping sets over the small leaf frame and the
base rows are never expanded. Only the fields that the metrics need are read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pivolith.functions import formula
from pivolith.functions.formats import Format
from pivolith.functions.numeric import iferror, js_text, num
from pivolith.operators.computed import parsed, with_computed
from pivolith.plans.spec import Metric, PivotSpec

#: Joins the parts of a column key.
PART = "\x01"
#: The total's label, and what a header ends in where a metric is shown in ten thousands.
TOTAL, IN_TEN_THOUSANDS = "汇总", "（万）"
KEY, LEVEL, SUBTOTAL = "__key", "__level", "__is_subtotal"


def normalised(df: DataFrame, spec: PivotSpec) -> PivotSpec:
    """Without metrics, the rows are counted."""
    return spec if spec.vals else PivotSpec(spec.rows, spec.cols, (Metric(df.columns[0], "count"),), spec.subtotals)


def _label(df: DataFrame, name: str) -> Column:
    return F.coalesce(js_text(F.col(f"`{name}`"), df.schema[name].dataType), F.lit(""))


def _inputs(name: str, trees: Mapping[str, formula.Node]) -> list[str]:
    """The fields whose sums a metric needs; those of a formula through other formulas."""
    seen, todo, out = set(), [name], []
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in trees:
            todo += formula.used(trees[n])
        else:
            out.append(n)
    return out


def pivot_long(df: DataFrame, spec: PivotSpec, formulas: Mapping[str, str] | None = None, fallback: float | None = None, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """A row for each set of row labels and column key: r1..rn, __key, __level (row fields that are
    set), __is_subtotal and the metrics. Leaves have level n, the total level 0.

    A metric on a formula ignores its aggregate: the formula is taken over the sums of its inputs.
    Results that are null or NaN are 0. aliases are other spellings of fields in formulas.
    """
    spec = normalised(df, spec)
    trees = parsed(formulas or {}, df.columns, aliases)
    needed = list(dict.fromkeys(f for m in spec.vals for f in _inputs(m.field, trees)))
    n = len(spec.rows)
    labels = [f"r{k + 1}" for k in range(n)]
    used = {f for f in [*spec.rows, *spec.cols] if f in trees}
    base = with_computed(df, formulas or {}, fallback, aliases) if used else df
    keyed = base.select(
        *[_label(base, f).alias(r) for f, r in zip(spec.rows, labels, strict=True)],
        F.concat_ws(PART, *[_label(base, f) for f in spec.cols]).alias(KEY) if spec.cols else F.lit("").alias(KEY),
        *[num(F.col(f"`{f}`"), df.schema[f].dataType).alias(f"x{i}") for i, f in enumerate(needed)],
    )
    want = {(m.field, m.agg) for m in spec.vals if m.field not in trees}
    sums = [i for i, f in enumerate(needed) if {(f, "sum"), (f, "avg")} & want or any(f in _inputs(m.field, trees) for m in spec.vals if m.field in trees)]
    least, most = ([i for i, f in enumerate(needed) if (f, a) in want] for a in ("min", "max"))
    parts = [("n", F.count(F.lit(1)), F.sum), *[(f"sum{i}", F.sum(f"x{i}"), F.sum) for i in sums], *[(f"min{i}", F.min(f"x{i}"), F.min) for i in least], *[(f"max{i}", F.max(f"x{i}"), F.max) for i in most]]
    leaves = keyed.groupBy(*labels, KEY).agg(*[a.alias(c) for c, a, _ in parts])
    levels = sorted({n, 0} | (set(range(1, n)) if spec.subtotals else set()), reverse=True)
    if n:
        merged = leaves.groupingSets([[*map(F.col, labels[:k]), F.col(KEY)] for k in levels], *labels, KEY).agg(*[merge(c).alias(c) for c, _, merge in parts], F.grouping_id().alias("_set"))
        # a set bit of the grouping id is a label that is rolled up; the key's bit is the last
        level = F.lit(n) - F.bit_count(F.col("_set"))
    else:
        merged, level = leaves.withColumn("_set", F.lit(0)), F.lit(0)
    merged = merged.withColumn(LEVEL, level.cast("int"))

    _, lost = formula.in_order(trees)
    at = {f: i for i, f in enumerate(needed)}

    def over_sums(name: str) -> Column:
        if name in lost:
            return F.lit(0.0)
        if name in trees:
            value = formula.lower(trees[name], over_sums)
            return value if fallback is None else iferror(value, fallback)
        return F.col(f"sum{at[name]}")

    def value(m: Metric) -> Column:
        if m.field in trees:
            return F.coalesce(F.nanvl(over_sums(m.field), F.lit(0.0)), F.lit(0.0))
        i = at[m.field]
        return {"count": lambda: F.col("n").cast("double"), "avg": lambda: F.col(f"sum{i}") / F.col("n")}.get(m.agg, lambda: F.col(f"{m.agg}{i}"))()

    return merged.select(
        *[F.coalesce(F.col(r), F.lit("")).alias(r) for r in labels], KEY, LEVEL, ((F.col(LEVEL) > 0) & (F.col(LEVEL) < n)).alias(SUBTOTAL),
        *[value(m).alias(m.name) for m in dict.fromkeys(spec.vals)],
    )


def column_keys(long: DataFrame) -> list[str]:
    """The column keys in collated order: one small job, bounded by spark.sql.pivotMaxValues."""
    most = int(long.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r[0] for r in long.select(KEY).distinct().orderBy(F.collate(F.col(KEY), "UNICODE"), KEY).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} column keys: use pivot_long()")
    return found


def header(key: str, metric: Metric, formats: Mapping[str, Format] | None = None) -> str:
    """The key's parts, then the metric; one shown in ten thousands says so."""
    said = key.replace(PART, " / ")
    named = metric.name + (IN_TEN_THOUSANDS if (formats or {}).get(f"{metric.field}|{metric.agg}", Format()).ten_thousand else "")
    return f"{said}|{named}" if said else named


def pivot(df: DataFrame, spec: PivotSpec, formulas: Mapping[str, str] | None = None, fallback: float | None = None, keys: list[str] | None = None, aliases: Mapping[str, str] | None = None, formats: Mapping[str, Format] | None = None) -> DataFrame:
    """The pivot as a table: row fields, __level, __is_subtotal, then for each column key each metric.

    Cells without rows are 0. Rows are in collated order of their labels, a group's subtotal after
    its rows, the total (labelled 汇总 in the first row field) last. keys: the column keys and their
    order, where known; else they are looked up, and the leaves, which the look-up and the table both need, are
    cached (clearCache() or an executor's lack of room drops them; they are made again then). formats only matter for
    headers. Without input rows there is no row.
    """
    spec = normalised(df, spec)
    long = pivot_long(df, spec, formulas, fallback, aliases)
    labels = [f"r{k + 1}" for k in range(len(spec.rows))]
    if keys is None:
        long = long.persist() if spec.cols else long
        keys = column_keys(long) if spec.cols else [""]
    metrics = list(dict.fromkeys(spec.vals))
    names = [f"_{i}_{j}" for i in range(len(keys)) for j in range(len(metrics))]
    if spec.cols and keys:
        each = long.groupBy(*labels, LEVEL, SUBTOTAL).pivot(KEY, keys).agg(*[F.max(f"`{m.name}`").alias(f"m{j}") for j, m in enumerate(metrics)])
        wide = each.toDF(*labels, LEVEL, SUBTOTAL, *names).na.fill(0.0, names)
    else:  # one row of long is one of the table
        wide = long.select(*labels, LEVEL, SUBTOTAL, *[F.coalesce(F.col(f"`{m.name}`"), F.lit(0.0)).alias(n) for m, n in zip(metrics, names, strict=False)] if keys else [])
        wide = wide if keys else wide.distinct()
    by = [x for k, r in enumerate(labels, 1) for x in (F.col(LEVEL) < k, F.collate(F.col(r), "UNICODE"), F.col(r))]
    wide = wide.orderBy(*by) if by else wide
    first = lambda k, r: F.when(F.col(LEVEL) == 0, TOTAL).otherwise(F.col(r)) if k == 0 else F.col(r)
    return wide.select(
        *[first(k, r).alias(f) for k, (r, f) in enumerate(zip(labels, spec.rows, strict=True))], LEVEL, SUBTOTAL,
        *[F.col(f"_{i}_{j}").alias(header(k, m, formats)) for i, k in enumerate(keys) for j, m in enumerate(metrics)],
    )
