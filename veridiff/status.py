"""Results and their status: success, error, skipped or invalid."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "task_id string, ref string, cand string, file_format string, strategy string, parameters map<string,string>, similarity double, status string, error string, details string"


@dataclass
class Validation:
    path: str
    exists: bool = False
    format_ok: bool = False
    parseable: bool = False
    n_records: int = 0
    error: str | None = None

    @property
    def is_valid(self) -> bool:
        """Emptiness does not count here."""
        return self.exists and self.format_ok and self.parseable


@dataclass
class Result:
    ref: str
    cand: str
    file_format: str
    strategy: str
    parameters: dict[str, Any] = field(default_factory=dict)
    similarity: float | None = None
    status: str = "error"
    error: str | None = None
    details: dict[str, Any] = field(default_factory=dict)
    task_id: str | None = None

    @property
    def is_scored(self) -> bool:
        return self.status in ("success", "invalid")

    def settle(self, ref: Validation, cand: Validation) -> Result:
        """Decide the status: bad reference, bad candidate, empty candidate, finite similarity, else error."""
        if not ref.is_valid:
            self.status = "skipped"
        elif not cand.is_valid or cand.n_records == 0:
            self.status, self.similarity = "invalid", 0.0
        elif self.error is None and self.similarity is not None and math.isfinite(self.similarity):
            self.status = "success"
        else:
            self.status = "error"
        return self

    def row(self) -> tuple:
        return (self.task_id, self.ref, self.cand, self.file_format, self.strategy, {k: str(v) for k, v in self.parameters.items()}, self.similarity, self.status, self.error, json.dumps(self.details, default=str))


def status_column(ref_valid: Column, cand_valid: Column, cand_records: Column, similarity: Column, error: Column) -> Column:
    """The same ladder for tables of results."""
    return F.when(~ref_valid, "skipped").when(~cand_valid | (cand_records == 0), "invalid").when(similarity.isNotNull() & ~F.isnan(similarity) & error.isNull(), "success").otherwise("error")
