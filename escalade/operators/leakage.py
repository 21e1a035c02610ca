"""Name-based guard against outcome columns among the features."""

from __future__ import annotations

import re

# Exact names that encode an outcome, a label or a gold answer.
FORBIDDEN_NAMES = frozenset({
    "baseline_correct", "single_correct", "per_correct", "broadcast_correct",
    "baseline_final_passed", "single_agent_final_passed", "per_final_passed", "broadcast_final_passed",
    "oracle_cheapest_successful", "cheapest_successful_protocol", "oracle_label", "any_protocol_solved",
    "outcome", "verdict", "failed", "failure", "success", "succeeded", "correct", "incorrect", "correctness",
    "solved", "result", "target", "label", "y", "y_true", "y_label", "ground_truth", "is_correct", "gold_label",
    "answer", "gold", "gold_answer", "final_answer", "reference_answer", "solution", "predicted_success",
})

# Name families, by ending and by beginning.
FORBIDDEN_ENDINGS = (
    "_correct", "_final_passed", "_passed", "_solved", "_success", "_succeeded", "_failed", "_failure", "_incorrect",
    "_wrong", "_score", "_verdict", "_outcome", "_label",
)
FORBIDDEN_BEGINNINGS = ("oracle", "gold", "cheapest", "first_success")
FORBIDDEN_IS = re.compile(r"is_(correct|wrong|failure|success|solved)")


class LeakageError(ValueError):
    """An outcome column was offered as a feature."""


def is_forbidden(column: str) -> bool:
    name = str(column).strip().lower()
    return (
        name in FORBIDDEN_NAMES
        or name.endswith(FORBIDDEN_ENDINGS)
        or any(name == b or name.startswith(b + "_") for b in FORBIDDEN_BEGINNINGS)
        or FORBIDDEN_IS.fullmatch(name) is not None
    )


def assert_no_leakage(columns, where: str = "feature construction") -> None:
    bad = sorted({str(c) for c in columns if is_forbidden(c)})
    if bad:
        raise LeakageError(f"{where}: {bad} encode outcomes or answers and may not be features")
