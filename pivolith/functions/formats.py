"""Display text of numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pivolith.functions.numeric import finite, js_round


@dataclass(frozen=True)
class Format:
    decimals: int = 2
    thousand: bool = True
    currency: str = ""
    position: str = "prefix"
    ten_thousand: bool = False


def format_number(value: Column, fmt: Format = Format()) -> Column:
    """Rounded half up, then fixed decimals, thousands separators and a currency sign."""
    digits = min(8, max(0, fmt.decimals))
    fixed = js_round(value / 10_000 if fmt.ten_thousand else value, digits).try_cast(f"decimal(38,{digits})")
    text = F.format_number(fixed, digits) if fmt.thousand else fixed.cast("string")
    if not fmt.currency:
        return text
    return F.concat(text, F.lit(fmt.currency)) if fmt.position == "suffix" else F.concat(F.lit(fmt.currency), text)


def format_aggregate(value: Column, agg: str, fmt: Format = Format()) -> Column:
    """Empty for what isn't finite; counts as whole numbers."""
    safe = F.when(finite(value), value)
    text = F.when(safe.isNotNull(), js_round(safe)).cast("long").cast("string") if agg == "count" else format_number(safe, fmt)
    return F.coalesce(text, F.lit(""))
