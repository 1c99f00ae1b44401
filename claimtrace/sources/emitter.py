"""The emitter: what an analysis publishes, checked when it is emitted and written as one fragment."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame

from claimtrace.functions.display import derive
from claimtrace.functions.expressions import is_numeric_text  # noqa: F401  (the same rule as a column)

KEY = re.compile(r"[a-z][a-z0-9_]*(?:\.[a-z0-9_]+)*")
NUMERIC = re.compile(r"[+-]?[0-9][0-9, ]*(?:\.[0-9]+)?%?")


class Emitter:
    """Collects values, intervals, tables and code lists of one script."""

    def __init__(self, script: str, inputs: dict[str, str] | None = None):
        self.script, self.inputs = script, dict(inputs or {})
        self.values: dict[str, dict] = {}
        self.tables: dict[str, dict] = {}
        self.code_lists: dict[str, list[dict]] = {}

    def _new(self, key: str, where: dict) -> str:
        if not KEY.fullmatch(key):
            raise ValueError(f"{key!r} is no key")
        if key in where:
            raise ValueError(f"{key!r} is emitted twice")
        return key

    def value(self, key: str, value: object, digits: int | None = None, display: str | None = None, **more: object) -> str:
        shown = derive(value, digits, display)
        self.values[self._new(key, self.values)] = {"value": value, "display": shown} | ({"digits": digits} if digits is not None else {}) | more
        return shown

    def interval(self, key: str, point: float, low: float, high: float, level: str, digits: int) -> None:
        """An estimate and its bounds, which have to enclose it."""
        if not low <= point <= high:
            raise ValueError(f"{key}: the estimate lies outside its interval")
        slug = re.sub("[^0-9A-Za-z]", "", level).lower()
        if not slug:
            raise ValueError("a level without letters or digits")
        self.value(f"{key}.point", point, digits)
        for bound, x in (("low", low), ("high", high)):
            self.value(f"{key}.ci{slug}_{bound}", x, digits, bounds=f"{key}.point", bound=bound, level=level)

    def interval_of(self, key: str, row: DataFrame, level: str, digits: int) -> None:
        """An interval from a one-row frame with ``ror, low, high``, such as ``odds_ratio`` gives."""
        r = row.first()
        self.interval(key, r["ror"], r["low"], r["high"], level, digits)

    def table(self, key: str, columns: list[str], rows: list[list[object]], caption: str | None = None) -> None:
        """Cells are numbers, or (template, parts), or words; a number typed as text is refused."""
        composed, body = [], []
        for i, row in enumerate(rows):
            if len(row) != len(columns):
                raise ValueError(f"{key}: row {i} has {len(row)} cells for {len(columns)} columns")
            line = []
            for j, cell in enumerate(row):
                if isinstance(cell, tuple):
                    template, parts = cell[0], [derive(p) for p in cell[1]]
                    if template.count("{}") != len(parts):
                        raise ValueError(f"{key}: row {i} has a template for other parts")
                    composed.append({"row": i, "column": j, "template": template, "parts": parts})
                    line.append(template.format(*parts))
                elif isinstance(cell, str):
                    if NUMERIC.fullmatch(cell):
                        raise ValueError(f"{key}: {cell!r} is a number typed as text")
                    line.append(cell)
                else:
                    composed.append({"row": i, "column": j, "template": "{}", "parts": [derive(cell)]})
                    line.append(derive(cell))
            body.append(line)
        self.tables[self._new(key, self.tables)] = {"caption": caption, "columns": columns, "rows": body, "composed": composed}

    def code_list(self, table: str, concept: str, system: str, codes: list[str]) -> None:
        self.code_lists.setdefault(table, []).append({"concept": concept, "system": system, "codes": codes})

    def document(self) -> dict:
        made = {"generated_by": self.script, "inputs": [{"path": p, "sha256": h} for p, h in sorted(self.inputs.items())]}
        return {"schema": "results", "provenance": made, "values": self.values, "tables": self.tables, "code_lists": self.code_lists}

    def write(self, path: str) -> str:
        """Writes the fragment and, beside it, its digest."""
        data = (json.dumps(self.document(), indent=2, ensure_ascii=False) + "\n").encode("utf-8")
        digest = hashlib.sha256(data).hexdigest()
        Path(path).write_bytes(data)
        Path(path + ".sha256").write_text(f"{digest}  {Path(path).name}\n")
        return digest
