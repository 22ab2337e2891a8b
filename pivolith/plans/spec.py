"""The logical plan of a pivot, and saved views; both go to JSON and back."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pivolith.functions.formats import Format

AGGREGATES = ("sum", "count", "min", "max", "avg")


@dataclass(frozen=True)
class Metric:
    field: str
    agg: str = "sum"

    def __post_init__(self) -> None:
        if self.agg not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.agg!r}")

    @property
    def name(self) -> str:
        return f"{self.field} {self.agg}"


@dataclass(frozen=True)
class PivotSpec:
    rows: tuple[str, ...] = ()
    cols: tuple[str, ...] = ()
    vals: tuple[Metric, ...] = ()
    subtotals: bool = False


@dataclass
class View:
    """A saved pivot. It holds no filters, limits or sort, and applies to whatever rows are loaded."""

    collection: str
    name: str
    spec: PivotSpec = field(default_factory=PivotSpec)
    formulas: dict[str, str] = field(default_factory=dict)
    formats: dict[str, Format] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()
    mode: str = "pivot"
    fallback: float | None = None
    updated_at: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> View:
        raw = json.loads(text)
        spec = raw.pop("spec", {})
        vals = tuple(Metric(**v) for v in spec.get("vals", ()))
        raw["spec"] = PivotSpec(tuple(spec.get("rows", ())), tuple(spec.get("cols", ())), vals, spec.get("subtotals", False))
        raw["formats"] = {k: Format(**v) for k, v in raw.get("formats", {}).items()}
        raw["hidden"] = tuple(raw.get("hidden", ()))
        return cls(**raw)
