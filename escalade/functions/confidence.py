"""Confidence parsing and the two confidence policies, as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..dims import BASELINE, SINGLE
from .outcomes import _c, bind

GATE_THRESHOLD = 70.0
CASCADE_HIGH = 70.0
CASCADE_LOW = 10.0


def _clip(c: Column) -> Column:
    """Clip to [0, 100]; guarded because greatest/least skip NULLs."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)))


def _json_integer(payload: Column, key: str) -> Column:
    """Integer under ``key``: numbers truncate, booleans are 0/1, integer text counts."""
    path = f"$.{key}"

    def read(text: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(payload, path, "variant"))
        number = text.try_cast("double")
        return (
            F.when(kind == "STRING", F.when(text.rlike(r"^[+-]?\d+$"), number))
            .when(kind == "BOOLEAN", F.when(text == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(F.signum(number) * F.floor(F.abs(number)).cast("double"))
        )

    return bind(F.trim(F.try_variant_get(payload, path, "string")), read)


def parse_confidence(col, key: str = "PROBABILITY") -> Column:
    """Raw response text to a 0-100 score, NULL when nothing is parseable.

    For text; :func:`read_confidence` takes numbers too.  Steps, first hit wins: the key of a JSON object; ``KEY: n`` anywhere; a bare
    integer; the first standalone integer up to 100.  Intermediate values are
    bound once, so the plan stays small when the optimizer copies the expression.
    """
    spellings = list(dict.fromkeys([key, key.lower(), key.upper()]))
    keyed_pattern = "(?i)[\"']?" + re.escape(key) + "[\"']?\\s*:\\s*(\\d{1,3})"

    def by_key(payload: Column) -> Column:
        """The first spelling that is present decides, even if it does not parse."""
        out = F.lit(None).cast("double")
        for k in reversed(spellings):
            present = F.try_variant_get(payload, f"$.{k}", "variant").isNotNull()
            out = F.when(present, _json_integer(payload, k)).otherwise(out)
        return out

    def number(text: Column, pattern: str) -> Column:
        return F.regexp_extract(text, pattern, 1).try_cast("double")  # '' casts to NULL

    def ladder(text: Column) -> Column:
        payload = F.try_parse_json(F.when(text.startswith("{"), text))
        keyed = F.coalesce(bind(payload, by_key), number(text, keyed_pattern), number(text, r"^(\d{1,3})$"))
        ints = F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9]{1,3})\b"), 1), lambda x: x.try_cast("double"))
        first = F.get(F.filter(ints, lambda x: x <= 100), F.lit(0))
        return F.coalesce(bind(keyed, _clip), first)

    def present(raw: Column) -> Column:
        return F.when(~F.lower(raw).isin("", "nan", "none", "null"), raw)

    raw = F.btrim(_c(col).cast("string"), F.lit(" \t\n\r\f\x0b"))
    return bind(bind(raw, present), ladder)


def read_confidence(df: DataFrame, column: str, key: str = "PROBABILITY") -> Column:
    """The 0-100 score of a column of numbers or of raw responses, by its type.

    A number is a score already.  In a table of texts (a CSV file) a cell that
    is a decimal number with a point, an exponent, a sign or more than three
    digits is a number as well; whole numbers read alike either way.
    """
    if isinstance(df.schema[column].dataType, NumericType):
        return clip_confidence(column)
    text = F.btrim(_c(column).cast("string"))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.coalesce(clip_confidence(number), parse_confidence(column, key))


def clip_confidence(col) -> Column:
    """Numeric confidence column clipped to [0, 100]; NaN and NULL are unparseable."""
    c = _c(col).cast("double")
    return _clip(F.when(~F.isnan(c), c))


def failure_risk(col) -> Column:
    """The score that ranks failures: 0-100 confidence to 0-1 risk."""
    return (F.lit(100.0) - _c(col)) / F.lit(100.0)


def confidence_gate(col, threshold: float = GATE_THRESHOLD) -> Column:
    """Keep the cheapest protocol at or above the threshold, else step up once."""
    return F.when(_c(col) >= F.lit(float(threshold)), F.lit(BASELINE)).otherwise(F.lit(SINGLE))


def cascade(col, tier_label, high: float = CASCADE_HIGH, low: float = CASCADE_LOW) -> Column:
    """Three bands; the lowest band and NULL take the tier label."""
    c = _c(col)
    return (
        F.when(c >= F.lit(float(high)), F.lit(BASELINE))
        .when(c >= F.lit(float(low)), F.lit(SINGLE))
        .otherwise(_c(tier_label))
    )
