"""Saved views, and CSV export."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pivolith.functions.formats import Format, format_aggregate
from pivolith.plans.spec import View


class ViewStore:
    """Views by (collection, name), in a JSON file."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def _all(self) -> dict[str, str]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def _put(self, views: dict[str, str]) -> None:
        draft = self.path.with_suffix(".new")
        draft.write_text(json.dumps(views, ensure_ascii=False))
        draft.replace(self.path)

    def save(self, view: View) -> bool:
        """False without a collection and a name; else it replaces the view of that name."""
        if not view.collection or not view.name:
            return False
        view.updated_at = datetime.now(UTC).isoformat().replace("+00:00", "Z")
        self._put(self._all() | {json.dumps([view.collection, view.name]): view.to_json()})
        return True

    def get(self, collection: str, name: str) -> View | None:
        found = self._all().get(json.dumps([collection, name]))
        return View.from_json(found) if found else None

    def list(self, collection: str | None = None) -> list[dict[str, str]]:
        """Collection, name and time of the views, the latest first."""
        views = [View.from_json(v) for v in self._all().values()]
        rows = [{"collection": v.collection, "name": v.name, "updatedAt": v.updated_at} for v in views if collection in (None, v.collection)]
        return sorted(rows, key=lambda r: r["updatedAt"], reverse=True)

    def delete(self, collection: str, name: str) -> bool:
        views = self._all()
        views.pop(json.dumps([collection, name]), None)
        self._put(views)
        return True


def displayed(table: DataFrame, formats: Mapping[str, Format] | None = None) -> DataFrame:
    """A pivot as text: numbers formatted by the metric that a column's name ends in, null as ''."""
    out = []
    for f in table.schema.fields:
        if f.name.startswith("__"):
            continue
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            field, _, agg = f.name.rpartition("|")[2].rpartition(" ")
            value = format_aggregate(value, agg, (formats or {}).get(f"{field}|{agg}", Format()))
        out.append(F.coalesce(value.cast("string"), F.lit("")).alias(f.name))
    return table.select(*out)


def export_csv(table: DataFrame, path: str, single: bool = True) -> None:
    """Quoted CSV with a header; one file if single (a displayed table), else a file for each partition."""
    (table.coalesce(1) if single else table).write.mode("overwrite").options(header="true", quoteAll="true", escape='"').csv(path)
