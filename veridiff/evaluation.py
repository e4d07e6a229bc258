"""Task evaluation: match candidate files to reference files, detect, recommend, compare, score."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import api
from .plans.models import Diagnosis, Step
from .providers import Offline, Provider
from .report import task_scores
from .sources.lines import listing
from .status import SCHEMA, Result

#: Files that are never candidates.
IGNORED = (".DS_Store", "task.json", "eval.json", "trace.json", "log.txt")


@dataclass
class Task:
    id: str
    question: str = ""
    refs: list[str] = field(default_factory=list)
    guidelines: list[str] = field(default_factory=list)
    inputs: list[str] = field(default_factory=list)


def read_task(spark: SparkSession, folder: str) -> Task:
    """task.json and eval.json of a task folder; their ids must agree."""
    read = lambda name: json.loads(spark.read.text(f"{folder}/{name}", wholetext=True).first()["value"])
    spec, ev = read("task.json"), read("eval.json")
    if spec["id"] != ev["id"]:
        raise ValueError(f"task {spec['id']} and evaluation {ev['id']} differ")
    guides = [x.get("guidelines", "") for x in ev.get("scoring", {}).get("expected_output", [])]
    refs = [f"{folder}/ref_answer/{x}" if "/" not in x else f"{folder}/{x}" for x in ev["ref_answer"]]
    return Task(spec["id"], spec.get("question", ""), refs, (guides + [""] * len(refs))[: len(refs)], spec.get("input_files", []))


def candidates(spark: SparkSession, folder: str, inputs: list[str]) -> list[list[str]]:
    """Candidate files in three tiers: the folder itself, its data folder, other folders."""
    skip = {*IGNORED, *(x.rsplit("/", 1)[-1] for x in inputs)}
    tiers: list[list[str]] = [[], [], []]
    base = folder.rstrip("/").split("://")[-1].lstrip("/")
    for r in listing(spark, folder, recursive=True).collect():
        rest = r["path"].split(base, 1)[-1].lstrip("/")
        if rest.rsplit("/", 1)[-1] not in skip:
            tiers[0 if "/" not in rest else 1 if rest.startswith("data/") else 2].append(r["path"])
    return tiers


def evaluate(spark: SparkSession, task: Task, folder: str, provider: Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, score) of one candidate folder."""
    provider = provider or Offline()
    matches: dict[str, tuple[str, float]] = {}
    for tier in candidates(spark, folder, task.inputs):
        if tier and not matches:  # a later tier only when nothing has matched
            matches = provider.match(task.refs, tier)
    rows = []
    for ref, guide in zip(task.refs, task.guidelines):
        if ref not in matches:
            fmt = api.detect.extension(ref)
            rows.append(Result(ref, "", fmt, "", similarity=0.0, status="invalid", error="no candidate", task_id=task.id).row())
            continue
        fmt = api.detect_format(spark, ref)
        strategy, params = provider.strategy(ref, fmt, guide)
        rows.append(api.compare_files(spark, ref, matches[ref][0], strategy, fmt, provider, task.id, **params).row())
    results = spark.createDataFrame(rows, SCHEMA)
    return results, task_scores(results)


def save(results: DataFrame, path: str) -> None:
    """One JSON record a file; NaN is written as null."""
    from pyspark.sql import functions as F

    results.withColumn("similarity", F.when(~F.isnan("similarity"), F.col("similarity"))).write.mode("overwrite").json(path)


def save_state(spark: SparkSession, task: Task, results: DataFrame, score: DataFrame, path: str) -> None:
    """The whole state of a task as one JSON record: the task, its results (one a reference file) and its score."""
    from dataclasses import asdict

    def plain(v):
        return None if isinstance(v, float) and v != v else v

    rows = [{k: plain(v) for k, v in r.asDict().items()} for r in results.collect()]
    state = {"task": asdict(task), "results": rows, "score": [{k: plain(v) for k, v in r.asDict().items()} for r in score.collect()]}
    spark.createDataFrame([(json.dumps(state, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: Words of an error and what a run that ends in it failed at; the first that is found decides.
SIGNS = (
    ("resource_limit", ("memoryerror", "out of memory", "killed", "timed out", "timeout", "no space left", "context length")),
    ("infrastructure", ("rate limit", "connection refused", "connection reset", "service unavailable", "api error")),
    ("environment_config", ("modulenotfounderror", "importerror", "command not found", "no module named", "permission denied")),
    ("data_io", ("filenotfounderror", "no such file", "parsererror", "unicodedecodeerror", "is a directory", "empty file")),
    ("tool_usage", ("unrecognized argument", "invalid option", "unexpected keyword", "missing required argument", "usage:")),
    ("tool_selection", ("unknown tool", "no tool named", "tool not found")),
    ("code_execution", ("traceback", "syntaxerror", "typeerror", "valueerror", "keyerror", "indexerror", "error:")),
)


def diagnose(trace: list[dict]) -> Diagnosis:
    """What a run failed at, by fixed signs in the outputs of its steps (dicts with ``output`` and, if known, ``ok``).

    A step fails when it says so or shows a sign; a later step that succeeds makes up for it.  The blocker is the first
    failure that none made up for.  Planning and invention leave no fixed signs: such failures stay unknown.
    """
    steps = []
    for i, s in enumerate(trace, 1):
        text = str(s.get("output", "")).lower()
        sign = next((c for c, words in SIGNS if any(w in text for w in words)), None)
        bad = s.get("ok") is False or s.get("ok") is None and sign is not None
        steps.append(Step(i, sign or "unknown", "failure" if bad else "success", int(s.get("attempt", 1)), text[:120] if bad else ""))
    open_ = next((k for k in range(len(steps)) if all(s.status == "failure" for s in steps[k:])), len(steps))
    if not steps or open_ == len(steps):
        return Diagnosis(not steps, tuple(steps), None if steps else "unknown")
    first = steps[open_]
    return Diagnosis(True, tuple(steps), first.category, first.step, first.note, 0.5 if first.category != "unknown" else 0.1)
