"""The reporting mart and its aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import report as R
from ..fixtures import load
from .registry import query, rounded

USES = ("agent_eval", "catalog", "difficulty", "cost", "skip")
MART = """, g AS (SELECT id, agent, first(avg_similarity ORDER BY row_no) FILTER (WHERE avg_similarity IS NOT NULL) AS avg_similarity, bool_and(candidate_path IS NOT NULL AND candidate_path <> '') AS completion, min(row_no) AS row_no FROM agent_eval GROUP BY id, agent),
k AS (SELECT * FROM cost QUALIFY row_number() OVER (PARTITION BY id, agent ORDER BY row_no DESC) = 1),
mart AS (SELECT g.id, domain, field, difficulty, g.agent, avg_similarity, coalesce(avg_similarity >= 0.5, false) AS equivalent, completion, duration_seconds, input_tokens, output_tokens, g.row_no
  FROM g LEFT JOIN catalog USING (id) LEFT JOIN difficulty USING (id) LEFT JOIN k ON k.id = g.id AND k.agent = g.agent WHERE g.id NOT IN (SELECT id FROM skip))"""


def _mart(spark, sf_dir):
    return R.build(*load(spark, sf_dir, *USES))


@query(MART + " SELECT id, domain, field, difficulty, agent, round(avg_similarity, 6) AS avg_similarity, equivalent, completion, round(duration_seconds, 6) AS duration_seconds, input_tokens, output_tokens, row_no FROM mart", USES)
def dash_build(spark, sf_dir):
    return rounded(_mart(spark, sf_dir))


@query(MART + " SELECT agent, round(avg(equivalent::INT), 6) AS rate, count(*) AS n FROM mart GROUP BY agent", USES)
def dash_rate_by_agent(spark, sf_dir):
    return rounded(R.rate_by(_mart(spark, sf_dir), "equivalent", "agent"))


@query(MART + " SELECT difficulty, agent, round(avg(completion::INT), 6) AS rate, count(*) AS n FROM mart WHERE difficulty IS NOT NULL GROUP BY ALL", USES)
def dash_rate_by_difficulty(spark, sf_dir):
    return rounded(R.rate_by(_mart(spark, sf_dir), "completion", "difficulty", "agent"))


@query(
    MART
    + """, b AS (SELECT agent, quantile_cont(duration_seconds, 0.25) AS q1, quantile_cont(duration_seconds, 0.5) AS median, quantile_cont(duration_seconds, 0.75) AS q3 FROM mart WHERE duration_seconds IS NOT NULL GROUP BY agent)
    SELECT agent, round(q1, 6) AS q1, round(b.median, 6) AS median, round(q3, 6) AS q3, round(min(CASE WHEN i THEN v END), 6) AS low, round(max(CASE WHEN i THEN v END), 6) AS high, sum(CASE WHEN i THEN 0 ELSE 1 END)::BIGINT AS outliers
    FROM (SELECT *, duration_seconds AS v, duration_seconds BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS i FROM mart JOIN b USING (agent) WHERE duration_seconds IS NOT NULL) b GROUP BY ALL""",
    USES,
)
def dash_cost_box(spark, sf_dir):
    return rounded(R.box_by(_mart(spark, sf_dir), "duration_seconds", "agent"))


@query(MART + " SELECT domain, count(*) AS n FROM (SELECT id, first(domain ORDER BY row_no) AS domain FROM mart GROUP BY id) GROUP BY domain", USES)
def dash_domain_counts(spark, sf_dir):
    return R.tasks_by(_mart(spark, sf_dir), "domain")


@query(MART + " SELECT x.d AS domain, x.f AS difficulty, count(*) AS n FROM (SELECT id, first({'d': domain, 'f': difficulty} ORDER BY row_no) AS x FROM mart GROUP BY id) t GROUP BY ALL", USES)
def dash_domain_by_difficulty(spark, sf_dir):
    return R.tasks_by(_mart(spark, sf_dir), "domain", "difficulty")


@query(MART + " SELECT count(DISTINCT id) AS n_tasks, count(DISTINCT agent) AS n_agents, bool_and(difficulty IS NULL) AS no_difficulty, bool_and(duration_seconds IS NULL) AS no_cost FROM mart", USES)
def dash_overview(spark, sf_dir):
    return R.overview(_mart(spark, sf_dir))


@query(", f AS (SELECT id, agent, min(row_no) AS first FROM agent_eval GROUP BY ALL) SELECT id, agent, first, row_number() OVER (ORDER BY first) AS place FROM f", ("agent_eval",))
def dash_first_appearance(spark, sf_dir):
    return R.first_rows(load(spark, sf_dir, "agent_eval"), ["id", "agent"], "row_no")


@query(
    """, s AS (SELECT id AS task_id, avg_similarity AS similarity, CASE WHEN row_no % 11 = 0 THEN 'error' WHEN row_no % 13 = 0 THEN 'skipped' WHEN avg_similarity IS NULL THEN 'invalid' ELSE 'success' END AS status FROM agent_eval)
    SELECT task_id, round(avg(CASE WHEN status IN ('success', 'invalid') THEN similarity END), 6) AS avg_similarity, sum(CASE WHEN status IN ('success', 'invalid') THEN 1 ELSE 0 END)::BIGINT AS n_scored, count(*) AS n_files FROM s GROUP BY task_id""",
    ("agent_eval",),
)
def task_score(spark, sf_dir):
    e = load(spark, sf_dir, "agent_eval")
    status = F.when(F.col("row_no") % 11 == 0, "error").when(F.col("row_no") % 13 == 0, "skipped").when(F.col("avg_similarity").isNull(), "invalid").otherwise("success")
    return rounded(R.task_scores(e.select(F.col("id").alias("task_id"), F.col("avg_similarity").alias("similarity"), status.alias("status"))))
