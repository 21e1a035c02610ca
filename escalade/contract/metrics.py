"""Report tables, replay and routing metrics, majority routers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import BASELINE, EXECUTIONS, LABELS, OUTCOME_COLUMNS, SHORT, SINGLE
from ..functions.confidence import cascade, confidence_gate
from ..operators import replay as rp
from ..operators import reports
from ..operators.calibration import bin_index
from ..operators.heuristics import BucketMajority, TierMajority, majority_label
from ..operators.splits import SplitConfig, refit_rows, stratified_split
from ..plans.reports import published_tables
from . import bindings as b
from .base import (
    BASE,
    CBASE,
    MACRO_F1,
    PRED,
    cnt,
    confusion_sql,
    f1_sql,
    pct,
    query,
    rank_sql,
    rat,
    replay_sql,
    split_sql,
    with_,
)
from .outcomes import COVER, DIM_SQL, SHARE_COLS, _dim

REP = (*BASE, PRED, replay_sql("pred"))
GATE_SQL = "CASE WHEN confidence >= 70 THEN 'baseline_llm' ELSE 'single_agent' END"


@query("coverage_table", with_(*BASE) + f"SELECT setting, count(*) AS n, {COVER} FROM lab GROUP BY setting")
def coverage(spark, sf):
    return reports.coverage_table(b.labelled(spark, sf))


@query("oracle_distribution", with_(*BASE) + f"SELECT setting, count(*) AS n, {SHARE_COLS} FROM lab GROUP BY setting")
def distribution(spark, sf):
    return reports.oracle_distribution(b.labelled(spark, sf))


@query("label_counts", with_(*BASE) + "SELECT setting, oracle_label, count(*) AS n FROM lab GROUP BY 1, 2")
def label_counts(spark, sf):
    return reports.label_counts(b.labelled(spark, sf))


def _inter(group: str) -> str:
    per, bro = "per_correct", "broadcast_correct"
    cells = {"per_only": f"{per} AND NOT {bro}", "broadcast_only": f"{bro} AND NOT {per}",
             "both": f"{per} AND {bro}", "neither": f"NOT {per} AND NOT {bro}"}
    cols = [f"{pct(cnt(per), 'count(*)')} AS per_solve_pct", f"{pct(cnt(bro), 'count(*)')} AS broadcast_solve_pct",
            f"{pct(cnt(bro) + ' - ' + cnt(per), 'count(*)')} AS broadcast_minus_per_points"]
    for k, v in cells.items():
        cols += [f"{cnt(v)} AS {k}_count", f"{pct(cnt(v), 'count(*)')} AS {k}_pct"]
    return f"{group}, count(*) AS n, " + ", ".join(cols)


@query("interaction_table", with_(*BASE) + f"""
SELECT {_inter('setting')} FROM lab WHERE NOT baseline_correct AND NOT single_correct GROUP BY setting""")
def interaction(spark, sf):
    return reports.interaction_table(b.labelled(spark, sf))


@query("interaction_subsets", with_(*CBASE) + f""", s AS (
  SELECT 'all' AS subset, * FROM conf
  UNION ALL SELECT 'baseline_failed', * FROM conf WHERE NOT baseline_correct
  UNION ALL SELECT 'both_failed', * FROM conf WHERE NOT baseline_correct AND NOT single_correct
  UNION ALL SELECT 'gate_escalated', * FROM conf WHERE NOT coalesce(confidence >= 70, FALSE))
SELECT {_inter('subset, setting')} FROM s GROUP BY subset, setting""")
def interaction_subsets(spark, sf):
    escalated = ~F.coalesce(F.col("confidence") >= 70, F.lit(False))
    return reports.interaction_subsets(b.confident(spark, sf), escalated)


SHARE01 = ", ".join(f"{rat(cnt(f'''oracle_label = '{p}' '''), 'count(*)')} AS {SHORT[p]}_share" for p in LABELS)


@query("label_by_tier", with_(*BASE) + f"SELECT difficulty_tier, count(*) AS n, {SHARE01} FROM lab GROUP BY 1")
def label_by_tier(spark, sf):
    return reports.label_shares(b.labelled(spark, sf), "difficulty_tier")


BIN_SQL = "CASE WHEN confidence IS NOT NULL THEN " + " + ".join(
    f"CAST(confidence / 100 > CAST({i * 0.1!r} AS DOUBLE) AS INTEGER)" for i in range(1, 10)
) + " END"


@query("confidence_composition", with_(*CBASE) + f""", x AS (SELECT coalesce({BIN_SQL}, -1) AS bin, oracle_label AS label FROM conf)
SELECT bin, label, count(*) AS n, CAST(count(*) AS DOUBLE) / CAST(any_value(t) AS DOUBLE) AS share
FROM (SELECT *, count(*) OVER (PARTITION BY bin) AS t FROM x) GROUP BY bin, label""")
def confidence_composition(spark, sf):
    rows = b.confident(spark, sf).withColumn("bin", F.coalesce(bin_index(F.col("confidence") / 100), F.lit(-1)))
    return reports.label_composition(rows, "bin")


SRC = ", ".join(f"{rat(cnt(SHORT[p] + '_correct'), 'count(*)')} AS {SHORT[p]}_rate" for p in EXECUTIONS)


@query("source_breakdown", with_(*BASE) + f"SELECT source, count(*) AS n, {SRC} FROM lab GROUP BY source ORDER BY n DESC, source LIMIT 12")
def source_breakdown(spark, sf):
    return reports.source_breakdown(b.labelled(spark, sf), 12)


@query("top_k", with_(*BASE) + "SELECT problem_uid, broadcast_tokens FROM lab ORDER BY broadcast_tokens DESC, problem_uid LIMIT 12")
def top_k(spark, sf):
    m = b.labelled(spark, sf).select("problem_uid", "broadcast_tokens")
    return reports.top_k(m, [F.desc("broadcast_tokens"), "problem_uid"], 12)


@query("marginal_cost_gain", with_(*BASE) + " UNION ALL ".join(
    f"""SELECT setting, count(*) AS n, '{lo}' AS from_protocol, '{hi}' AS to_protocol,
  CAST(sum({SHORT[hi]}_tokens) - sum({SHORT[lo]}_tokens) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS extra_tokens,
  CAST({cnt(SHORT[hi] + '_correct')} - {cnt(SHORT[lo] + '_correct')} AS DOUBLE) / CAST(count(*) AS DOUBLE) AS extra_solve_rate,
  CASE WHEN {cnt(SHORT[hi] + '_correct')} > {cnt(SHORT[lo] + '_correct')} THEN
    CAST(sum({SHORT[hi]}_tokens) - sum({SHORT[lo]}_tokens) AS DOUBLE) / CAST({cnt(SHORT[hi] + '_correct')} - {cnt(SHORT[lo] + '_correct')} AS DOUBLE) END AS tokens_per_extra_solve
  FROM lab GROUP BY setting""" for lo, hi in zip(EXECUTIONS, EXECUTIONS[1:])))
def marginal(spark, sf):
    return rp.marginal_cost_gain(b.labelled(spark, sf))


# --- replay -----------------------------------------------------------------

REP_COLS = ["problem_uid", "predicted_label", "oracle_label", "success", "tokens", "excess_tokens", "mode_correct", "solvable"]


@query("replay", with_(*REP) + f"SELECT {', '.join(REP_COLS)} FROM rep")
def replay(spark, sf):
    return b.replayed(spark, sf).select(*REP_COLS)


PRF = " UNION ALL ".join(
    f"""SELECT setting, '{p}' AS label, tp_{s} AS tp, np_{s} - tp_{s} AS fp, ng_{s} - tp_{s} AS fn,
  coalesce({rat(f'tp_{s}', f'np_{s}')}, 0) AS "precision", coalesce({rat(f'tp_{s}', f'ng_{s}')}, 0) AS recall, {f1_sql(s)} AS f1 FROM cm"""
    for p, s in SHORT.items()
)


@query("class_prf", with_(*REP) + f", cm AS (SELECT setting, {confusion_sql()} FROM rep GROUP BY setting) {PRF}")
def class_prf(spark, sf):
    return rp.class_prf(b.replayed(spark, sf), "oracle_label", "predicted_label", ["setting"])


@query("macro_f1", with_(*REP) + f", cm AS (SELECT setting, {confusion_sql()} FROM rep GROUP BY setting) SELECT setting, {MACRO_F1} AS macro_f1 FROM cm")
def macro_f1(spark, sf):
    return rp.macro_f1(b.replayed(spark, sf), "oracle_label", "predicted_label", ["setting"])


@query("accuracy", with_(*REP) + f"SELECT setting, {rat(cnt('mode_correct'), 'count(*)')} AS accuracy FROM rep GROUP BY setting")
def accuracy(spark, sf):
    return rp.accuracy(b.replayed(spark, sf), "oracle_label", "predicted_label", ["setting"])


P, G = rank_sql("predicted_label"), rank_sql("oracle_label")
DIRECTION = ", ".join(f"{rat(cnt(f'({P}) {op} ({G})'), 'count(*)')} AS {name}" for op, name in
                      ((">", "over_escalation_rate"), ("<", "under_escalation_rate"), ("=", "match_rate")))


@query("escalation_rates", with_(*REP) + f"SELECT setting, count(*) AS n, {DIRECTION} FROM rep GROUP BY setting")
def escalation(spark, sf):
    return rp.escalation_rates(b.replayed(spark, sf), "oracle_label", "predicted_label", ["setting"])


SUMMARY = f"""SELECT setting, count(*) AS n_examples, {rat(cnt('success'), 'count(*)')} AS solve_rate,
  {rat(cnt('mode_correct'), 'count(*)')} AS mode_accuracy,
  coalesce({rat(cnt('solvable AND NOT success'), cnt('solvable'))}, 0) AS missed_success_rate, {DIRECTION},
  CAST(sum(tokens) AS DOUBLE) / CAST(count(tokens) AS DOUBLE) AS avg_tokens,
  CAST(sum(excess_tokens) AS DOUBLE) / CAST(count(excess_tokens) AS DOUBLE) AS avg_excess_tokens_vs_oracle,
  {confusion_sql()} FROM rep GROUP BY setting"""


@query("routing_summary", with_(*REP) + f""", cm AS ({SUMMARY})
SELECT setting, n_examples, solve_rate, mode_accuracy, {MACRO_F1} AS macro_f1, missed_success_rate, over_escalation_rate,
  under_escalation_rate, match_rate, avg_tokens, avg_excess_tokens_vs_oracle FROM cm""")
def routing_summary(spark, sf):
    return rp.routing_summary(b.replayed(spark, sf), ["setting"])


ROUTES = ", ".join(f"CAST(np_{SHORT[p]} AS DOUBLE) / CAST(n AS DOUBLE) AS route_{SHORT[p]}" for p in LABELS)


@query("heldout_table", with_(*REP, split_sql(0.7, 0.15, 20260712, "rep", "sp")) + f""", cm AS (
  SELECT setting, count(*) AS n, {cnt('baseline_correct')} AS nb, {cnt('success')} AS ns, {cnt('solvable')} AS no, {confusion_sql()}
  FROM sp WHERE split = 'test' GROUP BY setting)
SELECT setting, n, {rat('nb', 'n')} AS baseline_solve, {rat('ns', 'n')} AS router_solve, {rat('no', 'n')} AS oracle_solve,
  {rat('no - ns', 'n')} AS oracle_gap, {MACRO_F1} AS oracle_label_macro_f1, {ROUTES} FROM cm""")
def heldout(spark, sf):
    rows = stratified_split(b.replayed(spark, sf), SplitConfig.six_setting()).where("split = 'test'")
    return rp.heldout_table(rows)


# --- heuristics -------------------------------------------------------------


def majority_sql(source: str, by: str, out: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    group = f"{by}, " if by else ""
    return f"""{out} AS (SELECT {group}oracle_label AS majority FROM (
  SELECT {group}oracle_label, row_number() OVER ({part} ORDER BY count(*) DESC,
    CASE oracle_label WHEN 'baseline_llm' THEN 0 WHEN 'single_agent' THEN 1 WHEN 'planner_executor_reviewer' THEN 2 WHEN 'broadcast' THEN 3 ELSE 4 END) AS rn
  FROM {source} {('WHERE ' + by + ' IS NOT NULL') if by else ''} GROUP BY {group}oracle_label) WHERE rn = 1)"""


PRIMARY = split_sql(0.8, 0.1, 42)
FITROWS = "fit AS (SELECT * FROM sp WHERE split IN ('train', 'dev'))"


@query("majority_label", with_(*BASE, majority_sql("lab", "source", "mj")) + """
SELECT mj.source, n_rows, majority FROM mj JOIN (SELECT source, count(*) AS n_rows FROM lab GROUP BY source) c ON c.source = mj.source""")
def majority(spark, sf):
    return majority_label(b.labelled(spark, sf), ["source"])


def _split(spark, sf, df=None):
    return stratified_split(df if df is not None else b.labelled(spark, sf), SplitConfig.primary())


@query("tier_majority", with_(*BASE, PRIMARY, FITROWS, majority_sql("fit", "difficulty_tier", "mt"), majority_sql("fit", "", "mg")) + """
SELECT problem_uid, coalesce(mt.majority, (SELECT majority FROM mg)) AS predicted_label
FROM sp LEFT JOIN mt ON mt.difficulty_tier = sp.difficulty_tier WHERE split = 'test'""")
def tier_majority(spark, sf):
    rows = _split(spark, sf)
    model = TierMajority().fit(refit_rows(rows))
    return model.transform(rows.where("split = 'test'")).select("problem_uid", "predicted_label")


TIERLESS = """chain AS (SELECT * REPLACE (CASE WHEN pk % 3 = 0 THEN NULL WHEN pk % 11 = 0 THEN 99 + difficulty_tier ELSE difficulty_tier END AS difficulty_tier)
  FROM sp)"""


@query("tier_lookup", with_(*BASE, PRIMARY, FITROWS, majority_sql("fit", "difficulty_tier", "mt"), majority_sql("fit", "", "mg"), TIERLESS) + """
SELECT problem_uid, coalesce(mt.majority, (SELECT majority FROM mg)) AS predicted_label
FROM chain LEFT JOIN mt ON mt.difficulty_tier = chain.difficulty_tier""")
def tier_lookup(spark, sf):
    rows = _split(spark, sf)
    model = TierMajority().fit(refit_rows(rows))
    tier = F.when(F.col("pk") % 3 == 0, F.lit(None)).when(F.col("pk") % 11 == 0, F.col("difficulty_tier") + 99).otherwise(F.col("difficulty_tier"))
    return model.transform(rows.withColumn("difficulty_tier", tier)).select("problem_uid", "predicted_label")


@query("bucket_majority", with_(*BASE, PRIMARY, TIERLESS, "fit AS (SELECT * FROM chain WHERE split IN ('train', 'dev'))",
       majority_sql("fit", "difficulty_tier", "mt"), majority_sql("fit", "source", "ms"), majority_sql("fit", "", "mg")) + """
SELECT problem_uid, coalesce(mt.majority, ms.majority, (SELECT majority FROM mg)) AS predicted_label
FROM chain LEFT JOIN mt ON mt.difficulty_tier = chain.difficulty_tier LEFT JOIN ms ON ms.source = chain.source WHERE split = 'test'""")
def bucket_majority(spark, sf):
    tier = F.when(F.col("pk") % 3 == 0, F.lit(None)).when(F.col("pk") % 11 == 0, F.col("difficulty_tier") + 99).otherwise(F.col("difficulty_tier"))
    rows = _split(spark, sf).withColumn("difficulty_tier", tier)
    model = BucketMajority(["difficulty_tier", "source"]).fit(refit_rows(rows))
    return model.transform(rows.where("split = 'test'")).select("problem_uid", "predicted_label")


# --- policies ---------------------------------------------------------------

CASCADE_SQL = "CASE WHEN confidence >= 70 THEN 'baseline_llm' WHEN confidence >= 10 THEN 'single_agent' ELSE tier_label END"
POLICY_CTES = (*CBASE, split_sql(0.8, 0.1, 42, "conf", "sp"), FITROWS, majority_sql("fit", "difficulty_tier", "mt"),
               majority_sql("fit", "", "mg"), """tiered AS (SELECT sp.*, coalesce(mt.majority, (SELECT majority FROM mg)) AS tier_label
  FROM sp LEFT JOIN mt ON mt.difficulty_tier = sp.difficulty_tier WHERE split = 'test')""")
POLICIES = {
    "Baseline": "'baseline_llm'",
    "Single": "'single_agent'",
    "Tier-majority": "tier_label",
    "Self-confidence gate": GATE_SQL,
    "Cascade": CASCADE_SQL,
    "Fixed-order oracle": "oracle_label",
}
PICK_SQL = ("CASE tier_label WHEN 'none' THEN FALSE WHEN 'baseline_llm' THEN baseline_correct WHEN 'single_agent' THEN single_correct "
            "WHEN 'planner_executor_reviewer' THEN per_correct ELSE broadcast_correct END")


def pick_outcome(label):
    """Whether the protocol that a label names solved the problem."""
    return rp._pick(label, OUTCOME_COLUMNS, False)


LONG = "long AS (" + " UNION ALL ".join(f"SELECT *, '{k}' AS policy, {v} AS predicted_label FROM tiered" for k, v in POLICIES.items()) + ")"


def policies_long(spark, sf):
    """Six policies replayed on the same test rows."""
    rows = _split(spark, sf, b.confident(spark, sf))
    model = TierMajority().fit(refit_rows(rows))
    test = model.transform(rows.where("split = 'test'"), "tier_label")
    named = {
        "Baseline": F.lit(BASELINE), "Single": F.lit(SINGLE), "Tier-majority": "tier_label",
        "Self-confidence gate": confidence_gate("confidence"), "Cascade": cascade("confidence", "tier_label"),
        "Fixed-order oracle": "oracle_label",
    }
    keep = [c for c in test.columns if c not in ("tier_label", "predicted_label")]
    return rp.replay(rp.policy_long(test, named, keep))


@query("policy_table", with_(*POLICY_CTES, LONG, replay_sql("long")) + f"""
SELECT policy, count(*) AS n, CAST(100 AS DOUBLE) * CAST({cnt('success')} AS DOUBLE) / CAST(count(*) AS DOUBLE) AS solve_pct,
  CAST(sum(tokens) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_tokens,
  CAST(sum(excess_tokens) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_excess_tokens FROM rep GROUP BY policy""")
def policy_table(spark, sf):
    return rp.policy_table(policies_long(spark, sf))


@query("escalation_by_tier", with_(*POLICY_CTES, LONG, replay_sql("long")) + f"""
SELECT policy, difficulty_tier, count(*) AS n, {DIRECTION} FROM rep GROUP BY policy, difficulty_tier""")
def escalation_by_tier(spark, sf):
    return rp.escalation_rates(policies_long(spark, sf), "oracle_label", "predicted_label", ["policy", "difficulty_tier"])


@query("cascade", with_(*POLICY_CTES) + f"SELECT problem_uid, {CASCADE_SQL} AS predicted_label FROM tiered")
def cascade_query(spark, sf):
    rows = _split(spark, sf, b.confident(spark, sf))
    model = TierMajority().fit(refit_rows(rows))
    test = model.transform(rows.where("split = 'test'"), "tier_label")
    return test.select("problem_uid", cascade("confidence", "tier_label").alias("predicted_label"))


# --- published form ---------------------------------------------------------


SHARES = [SHORT[p] for p in LABELS]
SHARES_SQL = f"SELECT setting, count(*) AS n, {SHARE_COLS} FROM lab GROUP BY setting"
ROUND_SQL = "CAST(printf('%.{d}f', {c}) AS DOUBLE) AS {c}"
NAMED_SQL = "coalesce(solver, concat('endpoint/', lower(c.setting))) AS solver, coalesce(setting_label, c.setting) AS setting"


def _published(spark, sf, name):
    return published_tables(b.labelled(spark, sf), _dim(spark), resamples=2000)[name]


@query("published_tables", with_(*BASE, DIM_SQL) + f""", c AS (SELECT setting, count(*) AS n, {COVER} FROM lab GROUP BY setting)
SELECT {NAMED_SQL}, n, {', '.join(ROUND_SQL.format(d=2, c=f'{k}_pct') for k in ('baseline', 'single', 'per', 'broadcast', 'oracle'))}
FROM c LEFT JOIN dim ON dim.setting = c.setting""")
def published(spark, sf):
    return _published(spark, sf, "matched_protocol_coverage")


@query("published_distribution", with_(*BASE, DIM_SQL) + f""", c AS ({SHARES_SQL})
SELECT {NAMED_SQL}, n, {', '.join(ROUND_SQL.format(d=2, c=f'{k}_pct') for k in SHARES)} FROM c LEFT JOIN dim ON dim.setting = c.setting""")
def published_distribution(spark, sf):
    return _published(spark, sf, "oracle_label_distribution")
