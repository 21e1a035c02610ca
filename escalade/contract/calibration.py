"""Confidence parsing and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.confidence import confidence_gate, failure_risk, parse_confidence, read_confidence
from ..operators import calibration as cal
from ..operators import ranks
from ..operators.heuristics import TierMajority
from ..operators.splits import SplitConfig, refit_rows, stratified_split
from . import bindings as b
from .base import CBASE, PARSED, RAW, cnt, query, rat, rounded, split_sql, with_
from .metrics import BIN_SQL, GATE_SQL, PICK_SQL, POLICY_CTES, pick_outcome

RISK_SQL = "(CAST(100 AS DOUBLE) - confidence) / CAST(100 AS DOUBLE)"
USABLE = "u AS (SELECT *, confidence / 100 AS p, " + RISK_SQL + " AS risk FROM conf WHERE confidence IS NOT NULL)"


@query("parse_confidence", with_(RAW, PARSED) + "SELECT event_id, coalesce(confidence, -1) AS confidence, confidence IS NOT NULL AS parseable FROM parsed")
def parse(spark, sf):
    raw = b.raw_confidence(spark, sf)
    out = raw.select("event_id", parse_confidence("confidence_raw").alias("c"))
    return out.select("event_id", F.coalesce("c", F.lit(-1.0)).alias("confidence"), F.col("c").isNotNull().alias("parseable"))


@query("failure_risk", with_(*CBASE, USABLE) + "SELECT problem_uid, risk FROM u")
def risk(spark, sf):
    return b.confident(spark, sf).where("confidence IS NOT NULL").select("problem_uid", failure_risk("confidence").alias("risk"))


@query("confidence_gate", with_(*CBASE) + f"SELECT problem_uid, {GATE_SQL} AS predicted_label FROM conf")
def gate(spark, sf):
    return b.confident(spark, sf).select("problem_uid", confidence_gate("confidence").alias("predicted_label"))


@query("gate_replay", with_(*CBASE) + f"""
SELECT setting, count(*) AS n, {cnt('coalesce(confidence >= 70, FALSE)')} AS kept_baseline,
  {cnt('NOT coalesce(confidence >= 70, FALSE)')} AS escalated_single,
  {rat(cnt('CASE WHEN coalesce(confidence >= 70, FALSE) THEN baseline_correct ELSE single_correct END'), 'count(*)')} AS gate_solve_rate
FROM conf GROUP BY setting""")
def gate_replay(spark, sf):
    return cal.gate_replay(b.confident(spark, sf), 70)


@query("threshold_sweep", with_(*CBASE, split_sql(0.8, 0.1, 42, "conf", "sp")) + f""",
t AS (SELECT CAST(unnest(range(0, 105, 5)) AS DOUBLE) AS threshold),
s AS (SELECT setting, threshold, count(*) AS n, {cnt('coalesce(confidence >= threshold, FALSE)')} AS kept_baseline,
  {cnt('CASE WHEN coalesce(confidence >= threshold, FALSE) THEN baseline_correct ELSE single_correct END')} AS solved
  FROM sp, t WHERE split = 'dev' GROUP BY 1, 2)
SELECT setting, threshold, n, kept_baseline, solved, {rat('solved', 'n')} AS solve_rate,
  row_number() OVER (PARTITION BY setting ORDER BY solved DESC, threshold) = 1 AS is_best FROM s""")
def threshold_sweep(spark, sf):
    dev = stratified_split(b.confident(spark, sf), SplitConfig.primary()).where("split = 'dev'")
    return cal.threshold_sweep(dev, [float(t) for t in range(0, 105, 5)])


CASCADE_PAIRS = [(float(h), float(w)) for h in (60, 70, 80, 90) for w in (5, 10, 20, 40)]


@query("cascade_sweep", with_(*POLICY_CTES) + f""",
t AS (SELECT unnest({[h for h, _ in CASCADE_PAIRS]}) AS high, unnest({[w for _, w in CASCADE_PAIRS]}) AS low),
ok AS (SELECT *, {PICK_SQL} AS tier_correct FROM tiered),
s AS (SELECT setting, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, count(*) AS n, {cnt('coalesce(confidence >= high, FALSE)')} AS kept_baseline,
  {cnt('coalesce(confidence >= low AND confidence < high, FALSE)')} AS kept_single,
  {cnt('CASE WHEN coalesce(confidence >= high, FALSE) THEN baseline_correct WHEN coalesce(confidence >= low, FALSE) THEN single_correct ELSE tier_correct END')} AS solved
  FROM ok, t GROUP BY 1, 2, 3)
SELECT setting, high, low, n, kept_baseline, kept_single, solved, {rat('solved', 'n')} AS solve_rate,
  row_number() OVER (PARTITION BY setting ORDER BY solved DESC, high, low) = 1 AS is_best FROM s""")
def cascade_sweep(spark, sf):
    rows = stratified_split(b.confident(spark, sf), SplitConfig.primary())
    test = TierMajority().fit(refit_rows(rows)).transform(rows.where("split = 'test'"), "tier_label")
    return cal.cascade_sweep(test.withColumn("tier_correct", pick_outcome(F.col("tier_label"))), CASCADE_PAIRS)


@query("read_confidence", """SELECT event_id, greatest(0, least(100, value)) AS confidence, greatest(0, least(100, value)) AS from_text FROM events""")
def numeric_confidence(spark, sf):
    """Numbers in a numeric column, and the same as decimal text."""
    events = b.table(spark, sf, "events").select("event_id", "value", F.format_string("%.17g", "value").alias("cell"))
    return events.select("event_id", read_confidence(events, "value").alias("confidence"), read_confidence(events, "cell").alias("from_text"))


# --- ranking ----------------------------------------------------------------


def auroc_sql(by: str, out: str, source: str, y: str, score: str, weight: str = "1") -> str:
    """Plain twin: one window over the score table."""
    return f"""{out}_t AS (SELECT {by}, {score} AS score, sum(CASE WHEN {y} THEN {weight} ELSE 0 END) AS pos,
    sum(CASE WHEN {y} THEN 0 ELSE {weight} END) AS neg FROM {source} GROUP BY {by}, {score}),
  {out}_c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {out}_t),
  {out} AS (SELECT {by}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
    CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (CAST(2 AS DOUBLE) * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auroc
    FROM {out}_c GROUP BY {by})"""


def ap_sql(by: str, out: str, source: str, y: str, score: str) -> str:
    return f"""{out}_t AS (SELECT {by}, {score} AS score, count(*) FILTER (WHERE {y}) AS pos, count(*) FILTER (WHERE NOT ({y})) AS neg
    FROM {source} GROUP BY {by}, {score}),
  {out}_c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {out}_t
    WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  {out} AS (SELECT {by}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
    CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * (CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))) / CAST(sum(pos) AS DOUBLE), 9) END AS average_precision
    FROM {out}_c GROUP BY {by})"""


def _usable(spark, sf):
    return b.confident(spark, sf).where("confidence IS NOT NULL")


def _wrong():
    return ~F.col("baseline_correct")


@query("auroc", with_(*CBASE, USABLE, auroc_sql("setting", "a", "u", "NOT baseline_correct", "risk")) + "SELECT * FROM a")
def auroc(spark, sf):
    return cal.auroc(_usable(spark, sf), _wrong(), failure_risk("confidence"), ["setting"])


# A continuous score: nearly every row has its own value.
VALUE_SQL = "v AS (SELECT event_type, event_id, value, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) + value > 70 AS y FROM events)"


def _continuous(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    return b.table(spark, sf, "events").select("event_type", "event_id", "value", (k + F.col("value") > 70).alias("y"))


@query("auroc_continuous", with_(VALUE_SQL, auroc_sql("event_type", "a", "v", "y", "value")) + "SELECT * FROM a")
def auroc_continuous(spark, sf):
    rows = _continuous(spark, sf)
    return cal.auroc(rows, F.col("y"), F.col("value"), ["event_type"])


@query("average_precision", with_(*CBASE, USABLE, ap_sql("setting", "a", "u", "NOT baseline_correct", "risk")) + "SELECT * FROM a")
def average_precision(spark, sf):
    out = cal.average_precision(_usable(spark, sf), _wrong(), failure_risk("confidence"), ["setting"])
    return rounded(out, "average_precision")


@query("average_precision_ordered", with_(*CBASE, USABLE) + """, r AS (
  SELECT setting, NOT baseline_correct AS y, row_number() OVER w AS n, sum(CAST(NOT baseline_correct AS INTEGER)) OVER w AS hits FROM u
  WINDOW w AS (PARTITION BY setting ORDER BY risk DESC, pk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT setting, count(*) AS n, count(*) FILTER (WHERE y) AS n_pos,
  CASE WHEN count(*) FILTER (WHERE y) > 0 THEN round(sum(CAST(hits AS DOUBLE) / CAST(n AS DOUBLE)) FILTER (WHERE y) / CAST(count(*) FILTER (WHERE y) AS DOUBLE), 9) END AS average_precision
FROM r GROUP BY setting""")
def average_precision_ordered(spark, sf):
    rows = _usable(spark, sf)
    points = ranks.split_points(rows, "pk", 32)
    return rounded(cal.average_precision_ordered(rows, _wrong(), failure_risk("confidence"), "pk", ["setting"], points), "average_precision")


@query("brier", with_(*CBASE, USABLE) + """
SELECT setting, count(*) AS n, round(avg((p - CAST(baseline_correct AS INTEGER)) * (p - CAST(baseline_correct AS INTEGER))), 9) AS brier
FROM u GROUP BY setting""")
def brier(spark, sf):
    return rounded(cal.brier(_usable(spark, sf), F.col("baseline_correct"), F.col("confidence") / 100, ["setting"]), "brier")


BINS = f"""bins AS (SELECT setting, {BIN_SQL} AS bin, count(*) AS n, sum(p) / CAST(count(*) AS DOUBLE) AS mp,
  CAST(count(*) FILTER (WHERE baseline_correct) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS er FROM u GROUP BY 1, 2)"""


@query("reliability_bins", with_(*CBASE, USABLE, BINS) + """
SELECT setting, bin, round(bin * CAST(0.1 AS DOUBLE), 9) AS lower, CASE WHEN bin = 9 THEN 1 ELSE round((bin + 1) * CAST(0.1 AS DOUBLE), 9) END AS upper,
  n, round(mp, 9) AS mean_probability, er AS empirical_rate, round(abs(mp - er), 9) AS abs_gap FROM bins""")
def reliability_bins(spark, sf):
    out = cal.reliability_bins(_usable(spark, sf), F.col("baseline_correct"), F.col("confidence") / 100, ["setting"])
    return rounded(out, "lower", "upper", "mean_probability", "abs_gap")


ECE_SQL = "SELECT setting, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(mp - er)) / CAST(sum(n) AS DOUBLE), 9) AS ece FROM bins GROUP BY setting"


@query("ece", with_(*CBASE, USABLE, BINS) + ECE_SQL)
def ece(spark, sf):
    return rounded(cal.ece(_usable(spark, sf), F.col("baseline_correct"), F.col("confidence") / 100, ["setting"]), "ece")


@query("confidence_report", with_(*CBASE, USABLE, BINS, f"e AS ({ECE_SQL})", auroc_sql("setting", "a", "u", "NOT baseline_correct", "risk")) + f""",
br AS (SELECT setting, avg((p - CAST(baseline_correct AS INTEGER)) * (p - CAST(baseline_correct AS INTEGER))) AS b,
  avg(p) FILTER (WHERE baseline_correct) AS mr, avg(p) FILTER (WHERE NOT baseline_correct) AS mw FROM u GROUP BY setting)
SELECT c.setting, count(*) AS n_total, count(confidence) AS n_parseable, {rat('count(confidence)', 'count(*)')} AS parse_rate,
  any_value(auroc) AS failure_auroc, any_value(ece) AS ece, round(any_value(b), 9) AS brier,
  round(any_value(mr), 9) AS mean_conf_correct, round(any_value(mw), 9) AS mean_conf_wrong
FROM conf c LEFT JOIN a ON a.setting = c.setting LEFT JOIN e ON e.setting = c.setting LEFT JOIN br ON br.setting = c.setting GROUP BY c.setting""")
def confidence_report(spark, sf):
    out = cal.confidence_report(b.confident(spark, sf), "setting")
    return rounded(out, "ece", "brier", "mean_conf_correct", "mean_conf_wrong")


TARGETS = {
    "Baseline failure": "NOT baseline_correct",
    "Any collaboration improves over Baseline": "NOT baseline_correct AND oracle_label <> 'none'",
    "PER first success": "oracle_label = 'planner_executor_reviewer'",
    "Broadcast first success": "oracle_label = 'broadcast'",
}
TG = "tg AS (" + " UNION ALL ".join(f"SELECT setting, '{k}' AS target, risk, {v} AS y FROM u" for k, v in TARGETS.items()) + ")"


@query("target_metrics", with_(*CBASE, USABLE, TG, auroc_sql("setting, target", "a", "tg", "y", "risk"), ap_sql("setting, target", "p", "tg", "y", "risk")) + f"""
SELECT a.setting, a.target, a.n_pos + a.n_neg AS n_parseable, a.n_pos AS positive_n, {rat('a.n_pos', 'a.n_pos + a.n_neg')} AS prevalence,
  auroc, average_precision AS auprc FROM a JOIN p ON a.setting = p.setting AND a.target = p.target""")
def target_metrics(spark, sf):
    return rounded(cal.target_metrics(b.confident(spark, sf), failure_risk("confidence")), "auprc")
