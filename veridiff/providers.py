"""Judgement steps behind one protocol.  The default provider decides offline by fixed rules and never judges meaning."""

from __future__ import annotations

import json
from collections.abc import Callable
from difflib import SequenceMatcher
from typing import Protocol

from .plans.catalog import CATALOG, family_of
from .plans.models import AlignPlan, ComparePlan
from .sources.detect import extension


class Provider(Protocol):
    def match(self, refs: list[str], cands: list[str]) -> dict[str, tuple[str, float]]: ...
    def format(self, path: str, lines: list[str]) -> str | None: ...
    def strategy(self, path: str, fmt: str, guideline: str) -> tuple[str, dict]: ...
    def align(self, ref_columns: list[str], cand_columns: list[str]) -> AlignPlan: ...
    def compare(self, columns: list[str]) -> ComparePlan: ...
    def judge(self, kind: str, ref: object, cand: object, question: str) -> float | None: ...


class Offline:
    def match(self, refs: list[str], cands: list[str]) -> dict[str, tuple[str, float]]:
        """Each reference file with at most one candidate, most similar names first; extensions must agree in family."""
        name = lambda p: p.rstrip("/").rsplit("/", 1)[-1].lower()
        scored = []
        for r in refs:
            for c in cands:
                s = SequenceMatcher(None, name(r), name(c)).ratio()
                if extension(r) == extension(c):
                    s = (s + 1) / 2
                elif family_of(extension(r)) != family_of(extension(c)) or family_of(extension(r)) is None:
                    continue
                scored.append((-s, r, c))
        out: dict[str, tuple[str, float]] = {}
        used: set[str] = set()
        for s, r, c in sorted(scored):
            if r not in out and c not in used and -s >= 0.5:
                out[r] = (c, -s)
                used.add(c)
        return out

    def format(self, path: str, lines: list[str]) -> str | None:
        """A format for a file that no rule knows; offline there is none."""
        return None

    def strategy(self, path: str, fmt: str, guideline: str) -> tuple[str, dict]:
        family = family_of(fmt)
        default = CATALOG[family]["default"] if family else "approximate"
        named = [s for s in (CATALOG[family]["strategies"] if family else {}) if s in guideline.lower()]
        return (named[0] if len(named) == 1 else default), {}

    def align(self, ref_columns: list[str], cand_columns: list[str]) -> AlignPlan:
        return AlignPlan()

    def compare(self, columns: list[str]) -> ComparePlan:
        return ComparePlan()

    def judge(self, kind: str, ref: object, cand: object, question: str) -> float | None:
        return None


class Judging(Offline):
    """The offline rules, with meaning judged by a callable: it gets a request and gives back an answer, both plain dicts.

    A request holds ``kind`` (table, txt or image), ``question`` and for each side what a judge can read: the first
    ``max_rows`` rows of a table as comma-separated text, the first ``max_chars`` characters of a text, an image in base64.
    An answer holds ``similarity`` from 0 to 1, or ``equivalent`` alone, and may hold ``reason``; anything else is no judgement.
    """

    def __init__(self, ask: Callable[[dict], dict], max_rows: int = 1000, max_chars: int = 100_000):
        self.ask, self.max_rows, self.max_chars = ask, max_rows, max_chars
        self.answers: list[dict] = []

    def format(self, path: str, lines: list[str]) -> str | None:
        """The judge may name the format of a file from its first lines: an answer's ``format``, if it is a known one."""
        answer = self.ask({"kind": "format", "path": path, "lines": lines})
        name = answer.get("format") if isinstance(answer, dict) else None
        return name if isinstance(name, str) and family_of(name) else None

    def payload(self, kind: str, side) -> str:
        if kind == "table":
            order = [c for c in ("_row",) if c in side.columns]
            rows = (side.orderBy(*order) if order else side).limit(self.max_rows).drop("_row").collect()
            names = [c for c in side.columns if c != "_row"]
            return "\n".join(",".join("" if v is None else str(v) for v in r) for r in [names, *rows])
        row = side.first()
        text = (row["payload"] if kind == "image" else row["text"]) if row else ""
        return text if kind == "image" else text[: self.max_chars]

    def judge(self, kind: str, ref: object, cand: object, question: str) -> float | None:
        answer = self.ask({"kind": kind, "question": question, "reference": self.payload(kind, ref), "candidate": self.payload(kind, cand)})
        answer = json.loads(answer) if isinstance(answer, str) else answer
        self.answers.append(answer)
        value = answer.get("similarity")
        if value is None and isinstance(answer.get("equivalent"), bool):
            value = float(answer["equivalent"])
        if isinstance(value, bool) or not isinstance(value, int | float) or not 0 <= value <= 1:
            return None
        return float(value)
