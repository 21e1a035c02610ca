"""Fixed vocabulary: protocols, their ranks and spellings, and the known settings.

All of these are bounded constants, so they travel as literal expressions or as
a ten-row broadcast dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical protocol ids, cheapest first; "none" is the action
# taken when no execution succeeded.
BASELINE = "baseline_llm"
SINGLE = "single_agent"
PER = "planner_executor_reviewer"
BROADCAST = "broadcast"
NONE = "none"

EXECUTIONS = (BASELINE, SINGLE, PER, BROADCAST)
LABELS = EXECUTIONS + (NONE,)

# Short names used in column names of outcome and cost columns.
SHORT = {
    BASELINE: "baseline",
    SINGLE: "single",
    PER: "per",
    BROADCAST: "broadcast",
    NONE: "none",
}

# Escalation ranks; abstaining ranks below the cheapest execution.
ESCALATION_RANK = {BASELINE: 0, SINGLE: 1, PER: 2, BROADCAST: 3, NONE: -1}

# Display names.
DISPLAY = {
    BASELINE: "Baseline",
    SINGLE: "Single",
    PER: "PER",
    BROADCAST: "Broadcast",
    NONE: "None",
}

# Accepted spellings.
ALIASES = {
    "baseline": BASELINE,
    "baseline_llm": BASELINE,
    "single": SINGLE,
    "single_agent": SINGLE,
    "per": PER,
    "planner_executor_reviewer": PER,
    "broadcast": BROADCAST,
    "none": NONE,
    "unsolved": NONE,
}

OUTCOME_COLUMNS = {p: f"{SHORT[p]}_correct" for p in EXECUTIONS}
TOKEN_COLUMNS = {p: f"{SHORT[p]}_tokens" for p in EXECUTIONS}

# Columns a matched outcome table must carry.
REQUIRED_COLUMNS = (
    "setting",
    "benchmark_id",
    "slice_id",
    "run_id",
    "model",
    "model_endpoint",
    "domain",
    "problem_uid",
    "baseline_correct",
    "single_correct",
    "per_correct",
    "broadcast_correct",
)

# Setting id, solver, setting label, order in the coverage
# report, order in the label-distribution report.
SETTINGS = (
    ("omnimath2__competition_math_4181__gpt_oss_120b", "gpt-oss-120b", "OmniMath", 1, 2),
    ("jeebench__text_only__gpt_oss_120b", "gpt-oss-120b", "JEEBench", 2, 4),
    ("scibench__text_only__gpt_oss_120b", "gpt-oss-120b", "SciBench", 3, 6),
    ("labbench__llm_strict__gpt_oss_120b", "gpt-oss-120b", "LAB-Bench strict", 4, 8),
    ("labbench__text_no_tool__gpt_oss_120b_text_no_tool", "gpt-oss-120b", "LAB-Bench text-no-tool", 5, 10),
    ("omnimath2__competition_math_4181__gemma_4_31b", "Gemma-4-31B-it", "OmniMath", 6, 1),
    ("jeebench__text_only__gemma_4_31b", "Gemma-4-31B-it", "JEEBench", 7, 3),
    ("scibench__text_only__gemma_4_31b", "Gemma-4-31B-it", "SciBench", 8, 5),
    ("labbench__llm_strict__gemma_4_31b", "Gemma-4-31B-it", "LAB-Bench strict", 9, 7),
    ("labbench__text_no_tool__gemma_4_31b_text_no_tool", "Gemma-4-31B-it", "LAB-Bench text-no-tool", 10, 9),
)

SETTING_DIM_SCHEMA = "setting string, solver string, setting_label string, coverage_ord int, oracle_ord int"


def setting_dim(spark: SparkSession, rows=SETTINGS) -> DataFrame:
    """The setting registry as a small literal DataFrame."""
    return spark.createDataFrame(list(rows), SETTING_DIM_SCHEMA)


def protocol_dim(spark: SparkSession) -> DataFrame:
    """One row per label value, in fixed order."""
    rows = [
        (p, i, ESCALATION_RANK[p], DISPLAY[p], OUTCOME_COLUMNS.get(p))
        for i, p in enumerate(LABELS)
    ]
    return spark.createDataFrame(
        rows,
        "protocol string, oracle_rank int, escalation_rank int, display string, outcome_col string",
    )


def literal_map(mapping: dict):
    """A Python dict as a Spark map literal, built in one call."""

    def lit(v) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)

    return F.expr("map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in mapping.items()) + ")")
