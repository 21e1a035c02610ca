"""Run logs: round folds, attempt memories, deliberation polls and votes, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.outcomes import ratio
from ..functions.text import is_meaningful, normalize_boxed

CALL_COUNTERS = ("prompt_tokens", "completion_tokens", "calls", "http_attempts", "failed_calls")


def flatten_run_log(df: DataFrame) -> DataFrame:
    """Nested run records to the flat 14-column summary."""
    t = F.col("tokens")
    return df.select(
        "problem_id", "protocol", "final_answer", "passed", "correctness", "rounds_used", "stop_reason", "judge_calls",
        "direct_protocol_fail", t["prompt_tokens"].alias("prompt_tokens"),
        t["completion_tokens"].alias("completion_tokens"), t["total_tokens"].alias("total_tokens"),
        t["calls"].alias("llm_calls"), "wall_seconds",
    )


def explode_events(df: DataFrame) -> DataFrame:
    """One row per logged event, with its position in the run."""
    return df.select("problem_id", "protocol", F.posexplode("events").alias("seq", "e")).select(
        "problem_id", "protocol", "seq", "e.type", "e.stage", "e.role", "e.sender", "e.content",
        F.col("e.tokens.prompt").alias("prompt_tokens"), F.col("e.tokens.completion").alias("completion_tokens"),
        "e.error", "e.attempts",
    )


def run_summary(runs: DataFrame, by=()) -> DataFrame:
    """n, passed, accuracy, format failures, unparseable judgements."""
    sums = runs.groupBy(*by).agg(
        F.count("*").alias("n_problems"), F.count_if("passed").alias("n_passed"),
        F.count_if("direct_protocol_fail").alias("n_direct_protocol_fail"),
        F.count_if("judge_unparseable").alias("n_judge_unparseable"),
    )
    return sums.select(*by, "n_problems", "n_passed", F.coalesce(ratio("n_passed", "n_problems"), F.lit(0.0)).alias("accuracy"),
                       "n_direct_protocol_fail", "n_judge_unparseable")


def token_ledger(calls: DataFrame, by=("problem_id",)) -> DataFrame:
    """Tokens, calls, attempts and failures per role and in total (``role`` NULL).

    ``calls`` holds ``role, prompt_tokens, completion_tokens, attempts, error``.
    Rows are summed per (group, role) first and only those sums are rolled up.
    """
    by = list(by)
    sums = calls.groupBy(*by, "role").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.count("*").alias("calls"), F.sum(F.greatest(F.lit(1), F.col("attempts"))).cast("bigint").alias("http_attempts"),
        F.count_if(F.coalesce(F.col("error") != "", F.lit(False))).alias("failed_calls"),
    )
    scope = F.explode(F.array(F.col("role"), F.lit(None).cast("string"))).alias("_role")
    both = sums.select(*by, *CALL_COUNTERS, scope)
    out = both.groupBy(*by, "_role").agg(*[F.sum(c).alias(c) for c in CALL_COUNTERS])
    return out.select(*by, F.col("_role").alias("role"), *CALL_COUNTERS,
                      (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


def fold_rounds(evals: DataFrame, max_rounds: int, keys=("problem_id",), order: str = "round") -> DataFrame:
    """Rounds used until the first pass, stop reason and final answer.

    Rounds count from 0.  Rounds after the first pass are ignored, as the run
    would have stopped there.
    """
    keys = list(keys)
    within = evals.where(F.col(order) < max_rounds)
    folded = within.groupBy(*keys).agg(
        F.min(F.when(F.col("passed"), F.col(order))).alias("_first"),
        F.max(order).alias("_last"),
        F.min_by("answer", F.when(F.col("passed"), F.col(order))).alias("_won"),
        F.max_by("answer", order).alias("_final"),
    )
    passed = F.col("_first").isNotNull()
    return folded.select(
        *keys, passed.alias("passed"), (F.coalesce("_first", "_last") + 1).cast("bigint").alias("rounds_used"),
        F.when(passed, "evaluator_pass").otherwise("max_rounds_exhausted").alias("stop_reason"),
        F.when(passed, F.col("_won")).otherwise(F.col("_final")).alias("final_answer"),
    )


def last_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Last ``n`` rows per key, renumbered 1..n.

    The rank filter is applied inside each map task first, so a key with any
    number of rows sends at most ``n`` per task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    kept = df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    oldest = Window.partitionBy(*keys).orderBy(order)
    return kept.withColumn("attempt_id", F.row_number().over(oldest).cast("bigint")).drop("_rn")


def revision_trail(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Last ``n`` events per key with their *original* numbers and their parent's.

    The original number is the total minus the distance from the end; the total
    is a partial aggregate, so the whole trail of a key is never in one task.
    """
    totals = df.groupBy(*keys).agg(F.count("*").alias("_total"))
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    kept = df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    event = (F.col("_total") - F.col("_rn") + 1).cast("bigint")
    return kept.join(totals, keys).withColumn("event_id", event).withColumn(
        "parent_event_id", F.when(F.col("event_id") > 1, F.col("event_id") - 1)
    ).drop("_rn", "_total")


# --- deliberation -----------------------------------------------------------


def speaker_argmax(polls: DataFrame, keys=("problem_id", "turn")) -> DataFrame:
    """Highest score speaks, lowest peer index on ties."""
    best = F.struct(F.col("score"), -F.col("peer_idx"))
    return polls.groupBy(*keys).agg(F.max_by("peer_idx", best).alias("speaker"), F.max("score").alias("best_score"))


def deferred_peers(polls: DataFrame, threshold: int, keys=("problem_id", "turn")) -> DataFrame:
    """Peers at or above the threshold that did not win and had something to say."""
    keys = list(keys)
    said = is_meaningful("reason") | is_meaningful("intent") | F.coalesce(F.col("candidate") != "", F.lit(False))
    loud = polls.where((F.col("score") >= threshold) & said)
    winner = speaker_argmax(polls, keys).select(*keys, "speaker")
    return loud.join(winner, keys).where(F.col("peer_idx") != F.col("speaker")).drop("speaker")


def best_proposal(polls: DataFrame, keys=("problem_id", "turn")) -> DataFrame:
    """Candidate of the highest-scoring peer that proposed one, and who it was."""
    has = F.coalesce(F.col("candidate") != "", F.lit(False))
    best = F.when(has, F.struct(F.col("score"), -F.col("peer_idx")))
    return polls.groupBy(*keys).agg(
        F.max_by("candidate", best).alias("proposal"), F.max_by("peer_idx", best).alias("proposer")
    )


def approval_vote(votes: DataFrame, policy: str = "unanimous", keys=("problem_id", "approval_round")) -> DataFrame:
    """Unanimous or strict-majority approval; no votes is no approval."""
    yes, n = F.count_if("approve"), F.count("*")
    rule = yes > F.floor(n / 2) if policy == "majority" else yes == n
    return votes.groupBy(*keys).agg(n.alias("n_votes"), yes.alias("n_approve"), (rule & (n > 0)).alias("approved"))


def choose_candidate(votes: DataFrame, policy: str = "majority_revision", keys=("problem_id", "approval_round"),
                     value: str = "revised_answer", order: str = "seq") -> DataFrame:
    """Replacement candidate per round, as a box; NULL keeps the current one.

    Revisions without a box do not count.

    ``majority_revision`` takes the most common revision, first seen on ties;
    ``latest_revision`` and ``first_revision`` take the last and the first.
    """
    keys = list(keys)
    votes = votes.withColumn(value, normalize_boxed(value))
    given = F.col(value) != ""
    if policy == "majority_revision":
        counts = votes.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
        best = F.when(given, F.struct(F.col("_n"), -F.col("_first")))
        return counts.groupBy(*keys).agg(F.max_by(value, best).alias("candidate"))
    pick = F.max_by if policy == "latest_revision" else F.min_by
    return votes.groupBy(*keys).agg(pick(value, F.when(given, F.col(order))).alias("candidate"))
