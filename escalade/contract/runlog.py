"""Round folds, memories, deliberation choices, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runlog
from . import bindings as b
from .base import cnt, query, with_

CALLS = """calls AS (SELECT user_id AS problem_id, event_type AS role, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS prompt_tokens,
  CAST(floor(value) AS BIGINT) AS completion_tokens, event_id % 4 AS attempts, event_id % 9 = 0 AS failed FROM events)"""


def calls(spark, sf):
    return b.table(spark, sf, "events").select(
        F.col("user_id").alias("problem_id"), F.col("event_type").alias("role"),
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("prompt_tokens"),
        F.floor("value").cast("bigint").alias("completion_tokens"), (F.col("event_id") % 4).alias("attempts"),
        F.when(F.col("event_id") % 9 == 0, "http 500").otherwise("").alias("error"),
    )


LEDGER = f"""CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) AS calls,
  CAST(sum(greatest(1, attempts)) AS BIGINT) AS http_attempts, {cnt('failed')} AS failed_calls,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens"""


@query("token_ledger", with_(CALLS) + f"""
SELECT problem_id, role, {LEDGER} FROM calls GROUP BY GROUPING SETS ((problem_id, role), (problem_id))""")
def token_ledger(spark, sf):
    return runlog.token_ledger(calls(spark, sf))


@query("first_pass_round", """WITH e AS (SELECT conv_id, turn, length(text) % 5 = 0 AS passed, text AS answer FROM conversations WHERE turn < 6),
f AS (SELECT conv_id, min(turn) FILTER (WHERE passed) AS first, max(turn) AS last FROM e GROUP BY conv_id)
SELECT f.conv_id AS problem_id, first IS NOT NULL AS passed, coalesce(first, last) + 1 AS rounds_used,
  CASE WHEN first IS NOT NULL THEN 'evaluator_pass' ELSE 'max_rounds_exhausted' END AS stop_reason, e.answer AS final_answer
FROM f JOIN e ON e.conv_id = f.conv_id AND e.turn = coalesce(first, last)""")
def first_pass_round(spark, sf):
    evals = b.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("problem_id"), F.col("turn").alias("round"), (F.length("text") % 5 == 0).alias("passed"),
        F.col("text").alias("answer"),
    )
    return runlog.fold_rounds(evals, 6)


@query("last_n_attempts", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS attempt_id FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3""")
def last_n_attempts(spark, sf):
    return runlog.last_n(b.table(spark, sf, "conversations"), ["conv_id"], "turn", 3).select("conv_id", "turn", "attempt_id")


@query("revision_trail", """SELECT conv_id, turn, event_id, CASE WHEN event_id > 1 THEN event_id - 1 ELSE 0 END AS parent_event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS event_id, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
WHERE event_id > n - 4""")
def revision_trail(spark, sf):
    out = runlog.revision_trail(b.table(spark, sf, "conversations"), ["conv_id"], "turn", 4)
    return out.select("conv_id", "turn", "event_id", F.coalesce("parent_event_id", F.lit(0)).alias("parent_event_id"))


POLLS = """polls AS (SELECT user_id AS problem_id, CAST(day(ts) AS INTEGER) AS turn, event_id AS peer_idx,
  CAST(1 + CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS INTEGER) AS score, (['n/a', 'ok', 'because of it', ''])[event_id % 4 + 1] AS reason,
  CASE WHEN event_id % 5 = 0 THEN 'I would check' ELSE '' END AS intent,
  CASE WHEN event_id % 3 = 0 THEN concat('\\boxed{', regexp_extract(props, '(\\d+)', 1), '}') ELSE '' END AS candidate FROM events)"""


def polls(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1)
    reasons = F.array(*[F.lit(x) for x in ("n/a", "ok", "because of it", "")])
    return b.table(spark, sf, "events").select(
        F.col("user_id").alias("problem_id"), F.dayofmonth("ts").alias("turn"), F.col("event_id").alias("peer_idx"),
        (k.cast("int") + 1).alias("score"), F.get(reasons, (F.col("event_id") % 4).cast("int")).alias("reason"),
        F.when(F.col("event_id") % 5 == 0, "I would check").otherwise("").alias("intent"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\\boxed{"), k, F.lit("}"))).otherwise("").alias("candidate"),
    )


TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY problem_id, turn ORDER BY score DESC, peer_idx) AS rn FROM polls)"


@query("speaker_argmax", with_(POLLS, TOP) + "SELECT problem_id, turn, peer_idx AS speaker, score AS best_score FROM top WHERE rn = 1")
def speaker_argmax(spark, sf):
    return runlog.speaker_argmax(polls(spark, sf))


@query("deferred_peers", with_(POLLS, TOP) + """SELECT problem_id, turn, peer_idx, score FROM top WHERE rn > 1 AND score >= 60
  AND (reason = 'because of it' OR intent <> '' OR candidate <> '')""")
def deferred_peers(spark, sf):
    return runlog.deferred_peers(polls(spark, sf), 60).select("problem_id", "turn", "peer_idx", "score")


@query("best_proposal", with_(POLLS) + """SELECT problem_id, turn, coalesce(max(candidate) FILTER (WHERE rn = 1), '') AS proposal,
  coalesce(max(peer_idx) FILTER (WHERE rn = 1), -1) AS proposer FROM (
  SELECT *, CASE WHEN candidate <> '' THEN row_number() OVER (PARTITION BY problem_id, turn, candidate <> '' ORDER BY score DESC, peer_idx) END AS rn FROM polls) GROUP BY 1, 2""")
def best_proposal(spark, sf):
    out = runlog.best_proposal(polls(spark, sf))
    return out.fillna("", ["proposal"]).fillna(-1, ["proposer"])


VOTES = """votes AS (SELECT user_id AS problem_id, CAST(day(ts) AS INTEGER) AS approval_round, event_id AS seq,
  CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) >= 30 AS approve,
  CASE WHEN event_id % 2 = 0 THEN concat('\\boxed{', CAST(event_id % 3 AS VARCHAR), '}') ELSE '' END AS revised_answer FROM events)"""


def votes(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    return b.table(spark, sf, "events").select(
        F.col("user_id").alias("problem_id"), F.dayofmonth("ts").alias("approval_round"), F.col("event_id").alias("seq"),
        (k >= 30).alias("approve"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("\\boxed{"), (F.col("event_id") % 3).cast("string"), F.lit("}"))).otherwise("").alias("revised_answer"),
    )


@query("approval_vote", with_(VOTES) + """
SELECT 'unanimous' AS policy, problem_id, approval_round, count(*) AS n_votes, count(*) FILTER (WHERE approve) AS n_approve, bool_and(approve) AS approved FROM votes GROUP BY 2, 3
UNION ALL SELECT 'majority', problem_id, approval_round, count(*), count(*) FILTER (WHERE approve), count(*) FILTER (WHERE approve) > count(*) // 2 FROM votes GROUP BY 2, 3""")
def approval_vote(spark, sf):
    v = votes(spark, sf)
    frames = [runlog.approval_vote(v, p).withColumn("policy", F.lit(p)) for p in ("unanimous", "majority")]
    return frames[0].unionByName(frames[1])


@query("candidate_choice", with_(VOTES) + """, g AS (SELECT * FROM votes WHERE revised_answer <> ''),
c AS (SELECT problem_id, approval_round, revised_answer, count(*) AS n, min(seq) AS first FROM g GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT problem_id, approval_round FROM votes),
p AS (SELECT 'majority_revision' AS policy, problem_id, approval_round, revised_answer, row_number() OVER (PARTITION BY problem_id, approval_round ORDER BY n DESC, first) AS rn FROM c
  UNION ALL SELECT 'first_revision', problem_id, approval_round, revised_answer, row_number() OVER (PARTITION BY problem_id, approval_round ORDER BY seq) FROM g
  UNION ALL SELECT 'latest_revision', problem_id, approval_round, revised_answer, row_number() OVER (PARTITION BY problem_id, approval_round ORDER BY seq DESC) FROM g)
SELECT pol.policy, k.problem_id, k.approval_round, coalesce(p.revised_answer, '') AS candidate
FROM k CROSS JOIN (VALUES ('majority_revision'), ('first_revision'), ('latest_revision')) pol(policy)
LEFT JOIN p ON p.problem_id = k.problem_id AND p.approval_round = k.approval_round AND p.policy = pol.policy AND p.rn = 1""")
def candidate_choice(spark, sf):
    v = votes(spark, sf)
    policies = ("majority_revision", "first_revision", "latest_revision")
    frames = [runlog.choose_candidate(v, p).fillna("", ["candidate"]).withColumn("policy", F.lit(p)) for p in policies]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
