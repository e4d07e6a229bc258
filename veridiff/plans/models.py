"""Typed plans: how two tables are aligned and how their columns are compared.  They drive DataFrame construction."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableMeta:
    """How a delimited file is read."""

    delimiter: str = ","
    comment: str | None = None
    header: bool = True
    skip_rows: int = 0


@dataclass(frozen=True)
class AlignPlan:
    """``id_columns``: names of key columns; empty: align by row number; None: find the smallest key both sides share."""

    id_columns: tuple[str, ...] | None = None
    column_map: dict[str, str] = field(default_factory=dict)  # reference name -> candidate name
    transpose: bool = False
    case_sensitive_ids: bool = False
    fuzzy_ids: bool = False
    sort_by: tuple[str, ...] = ()
    ascending: tuple[bool, ...] = ()


@dataclass(frozen=True)
class ColumnRule:
    """``strategy``: exact, rae, overlap, pearson, spearman or ignore."""

    column: str
    strategy: str
    tolerance: float = 0.0
    delimiter: str = ","
    threshold: float = 1.0

    @property
    def cell_tolerance(self) -> float:
        return self.tolerance or 1e-6  # a tolerance of 0 still forgives rounding


@dataclass(frozen=True)
class ComparePlan:
    rules: tuple[ColumnRule, ...] = ()  # empty: numeric columns by rae, others exact


#: What an agent's run can fail at, and how a step of it can end.
FAILURES = (
    "planning", "tool_selection", "tool_usage", "hallucination", "environment_config",
    "code_execution", "data_io", "infrastructure", "resource_limit", "unknown",
)
STEP_ENDS = ("success", "failure", "partial")


@dataclass(frozen=True)
class Step:
    """One labelled step of a run."""

    step: int
    category: str
    status: str
    attempt: int = 1
    note: str = ""

    def __post_init__(self) -> None:
        if self.category not in FAILURES or self.status not in STEP_ENDS:
            raise ValueError(f"unknown category {self.category} or status {self.status}")


@dataclass(frozen=True)
class Diagnosis:
    """Whether a run failed, and then at which step and of what."""

    failed: bool
    steps: tuple[Step, ...] = ()
    category: str | None = None
    blocker_step: int | None = None
    reason: str | None = None
    confidence: float = 0.0
