"""Expressions over protocol names, outcomes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import (
    ALIASES,
    BROADCAST,
    DISPLAY,
    ESCALATION_RANK,
    EXECUTIONS,
    NONE,
    OUTCOME_COLUMNS,
    PER,
    literal_map,
)

# Accepted outcome spellings, trimmed and lower-cased.
TRUE_SPELLINGS = ("1", "true", "t", "yes", "1.0")
FALSE_SPELLINGS = ("0", "false", "f", "no", "0.0")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once and not repeated in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _norm(col) -> Column:
    return F.lower(F.trim(_c(col).cast("string")))


def ratio(num, den) -> Column:
    """num / den as DOUBLE, NULL on an empty denominator."""
    return F.when(_c(den) != 0, _c(num).cast("double") / _c(den).cast("double"))


def percent(num, den) -> Column:
    """100 * num / den as DOUBLE, NULL on an empty denominator."""
    return F.when(_c(den) != 0, F.lit(100.0) * _c(num).cast("double") / _c(den).cast("double"))


def canonical_protocol(col, on_error: str = "raise") -> Column:
    """Any known spelling to the canonical id.

    Unknown spellings fail the job (``raise``) or become NULL (``null``) for a
    caller that quarantines them; they never pass through as a new class.
    """
    found = F.try_element_at(literal_map(ALIASES), _norm(col))
    if on_error == "null":
        return found
    bad = F.concat(F.lit("unknown protocol name: "), F.coalesce(_c(col).cast("string"), F.lit("NULL")))
    return F.coalesce(found, F.raise_error(bad).cast("string"))


def display_name(col) -> Column:
    return F.element_at(literal_map(DISPLAY), canonical_protocol(col))


def strict_outcome(col, on_error: str = "raise") -> Column:
    """Binary outcome text or number to BOOLEAN; anything else is an error.

    A missing outcome is not a failure, so NULL and blank are errors as well.
    """
    text = _norm(col)
    known = F.when(text.isin(*TRUE_SPELLINGS), F.lit(True)).when(text.isin(*FALSE_SPELLINGS), F.lit(False))
    if on_error == "null":
        return known
    bad = F.concat(F.lit("not a binary outcome: "), F.coalesce(_c(col).cast("string"), F.lit("NULL")))
    return F.coalesce(known, F.raise_error(bad).cast("boolean"))


def lenient_outcome(col) -> Column:
    """Only ``1`` and ``true`` succeed; all else, NULL included, is a failure."""
    return F.coalesce(_norm(col).isin("1", "true"), F.lit(False))


def oracle_label(columns: dict | None = None) -> Column:
    """First success in the fixed order, else ``none``.

    All four cells are required: a NULL in any of them gives a NULL label, so a
    truncated row cannot be labelled by an early success.
    """
    cols = columns or OUTCOME_COLUMNS
    cells = [_c(cols[p]) for p in EXECUTIONS]
    complete = F.lit(True)
    for cell in cells:
        complete = complete & cell.isNotNull()
    ladder = F.coalesce(*[F.when(cell, F.lit(p)) for p, cell in zip(EXECUTIONS, cells)], F.lit(NONE))
    return F.when(complete, ladder)


def any_solved(columns: dict | None = None) -> Column:
    cols = columns or OUTCOME_COLUMNS
    out = F.lit(False)
    for p in EXECUTIONS:
        out = out | _c(cols[p])
    return out


def escalation_rank(col) -> Column:
    return F.element_at(literal_map(ESCALATION_RANK), _c(col))


def escalation_direction(pred, gold) -> Column:
    """``over``, ``under`` or ``match`` for canonical labels."""
    p, g = escalation_rank(pred), escalation_rank(gold)
    return F.when(p > g, "over").when(p < g, "under").otherwise("match")


def value_target_columns(label="oracle_label", baseline="baseline_correct") -> dict:
    """The four prediction targets, as boolean expressions."""
    lab, base = _c(label), _c(baseline)
    return {
        "Baseline failure": ~base,
        "Any collaboration improves over Baseline": (~base) & (lab != NONE),
        "PER first success": lab == PER,
        "Broadcast first success": lab == BROADCAST,
    }


def difficulty_tier(col, low: int = 1, high: int = 10) -> Column:
    """Half-even rounding, clipped; NULL and NaN give NULL (greatest/least skip NULLs)."""
    c = _c(col).cast("double")
    return F.when(
        c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(low), F.least(F.lit(high), F.bround(c, 0).cast("int")))
    )


def truthy(col) -> Column:
    """Is a tag cell non-empty?"""
    text = _norm(col)
    return F.coalesce(~text.isin("", "0", "false", "none", "null", "[]", "{}"), F.lit(False))
