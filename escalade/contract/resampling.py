"""Intervals.  The twins repeat the hashed draws of both kinds of weights."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import resample as rs
from ..operators.heuristics import TierMajority
from ..operators.replay import _pick
from ..functions.outcomes import ratio
from ..operators.splits import SplitConfig, refit_rows, stratified_split
from ..dims import OUTCOME_COLUMNS
from . import bindings as b
from .base import BASE, CBASE, MACRO_F1, PRED, cnt, confusion_sql, query, rank_sql, rat, replay_sql, rounded, split_sql, with_
from .calibration import BIN_SQL, RISK_SQL, auroc_sql
from .metrics import FITROWS, NAMED_SQL, ROUND_SQL, _inter, _published, majority_sql
from .outcomes import DIM_SQL

B = 2000
SEED = 42
ROWS = {"n": B, "seed": SEED, "mode": "rows"}


def weights_sql(source: str, out: str = "wt") -> str:
    """Twin of the row weights: four lanes of 32 bits per hash, Poisson(1) by inversion."""
    lanes = []
    for i in range(rs.LANES):
        bits = f"CAST(concat('0x', substr(h, {8 * i + 1}, 8)) AS BIGINT)"
        w = " + ".join(f"CAST({bits} >= {math.ceil(t * rs.UNIT)} AS INTEGER)" for t in rs.poisson_thresholds())
        lanes.append(f"SELECT * EXCLUDE (h, block), block * {rs.LANES} + {i} AS replicate, {w} AS w FROM {out}_h")
    return f"""{out}_h AS (SELECT s.*, block, md5(concat_ws('|', '{SEED}', CAST(block AS VARCHAR), problem_uid)) AS h
  FROM {source} s, (SELECT unnest(range({(B + rs.LANES - 1) // rs.LANES})) AS block)),
{out} AS ({' UNION ALL '.join(lanes)})"""


def bounds(by: str, source: str, value: str = "draw") -> str:
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (f"SELECT {key}round(quantile_cont({value}, 0.025), 9) AS ci_low, round(quantile_cont({value}, 0.975), 9) AS ci_high "
            f"FROM {source}{group}")


@query("bootstrap_ci", with_(*BASE, weights_sql("lab")) + f""",
d AS (SELECT setting, replicate, {rat('sum(w) FILTER (WHERE per_correct)', 'sum(w)')} AS draw FROM wt GROUP BY 1, 2),
c AS ({bounds('setting', 'd')})
SELECT lab.setting, count(*) AS n, {rat(cnt('per_correct'), 'count(*)')} AS point, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high
FROM lab JOIN c ON c.setting = lab.setting GROUP BY lab.setting""")
def bootstrap_ci(spark, sf):
    return rounded(rs.bootstrap_ci(b.labelled(spark, sf), "per_correct", ["setting"], **ROWS), "ci_low", "ci_high")


METRICS = {
    "solve_rate": ("CAST(broadcast_correct AS INTEGER) * w", "w"),
    "avg_tokens": ("broadcast_tokens * w", "w"),
    "tokens_per_solve": ("broadcast_tokens * w", "CAST(broadcast_correct AS INTEGER) * w"),
}


@query("bootstrap_metrics", with_(*BASE, weights_sql("lab")) + ", d AS (" + " UNION ALL ".join(
    f"SELECT setting, replicate, '{k}' AS metric, {rat(f'sum({n})', f'sum({d})')} AS draw FROM wt GROUP BY 1, 2" for k, (n, d) in METRICS.items()
) + "), p AS (" + " UNION ALL ".join(
    f"SELECT setting, '{k}' AS metric, {rat(f'sum({n})', f'sum({d})')} AS point FROM (SELECT *, 1 AS w FROM lab) GROUP BY 1" for k, (n, d) in METRICS.items()
) + f"), c AS ({bounds('setting, metric', 'd')}) SELECT p.setting, p.metric, point, ci_low, ci_high FROM p JOIN c ON p.setting = c.setting AND p.metric = c.metric")
def bootstrap_metrics(spark, sf):
    ok, w, t = F.col("broadcast_correct").cast("int"), F.col("w"), F.col("w_broadcast_tokens")
    metrics = {"solve_rate": (ok * w, w), "avg_tokens": (t, w), "tokens_per_solve": (t, ok * w)}
    out = rs.bootstrap_metrics(b.labelled(spark, sf), metrics, ["broadcast_correct"], ["setting"], measures=["broadcast_tokens"], **ROWS)
    return rounded(out, "ci_low", "ci_high")


def paired_sql(by: str, source: str, a: str, z: str) -> str:
    key = f"{by}, "
    point = f"CAST(100 AS DOUBLE) * ({rat(f'{cnt(a)} - {cnt(z)}', 'count(*)')})"
    on = " AND ".join(f"p.{c.strip()} = c.{c.strip()}" for c in by.split(","))
    cols = ", ".join(f"p.{c.strip()}" for c in by.split(","))
    diff = f"sum(w * (CAST({a} AS INTEGER) - CAST({z} AS INTEGER)))"
    return f""", d AS (SELECT {key}replicate, CAST(100 AS DOUBLE) * ({rat(diff, 'sum(w)')}) AS draw FROM wt GROUP BY {key}replicate),
c AS ({bounds(by, 'd')}), p AS (SELECT {key}count(*) AS n, {point} AS point FROM {source} GROUP BY {by})
SELECT {cols}, n, point, ci_low, ci_high FROM p JOIN c ON {on}"""


BOTH = "bf AS (SELECT * FROM lab WHERE NOT baseline_correct AND NOT single_correct)"


@query("interaction_ci", with_(*BASE, BOTH, weights_sql("bf")) + paired_sql("setting", "bf", "broadcast_correct", "per_correct"))
def interaction_ci(spark, sf):
    return rounded(rs.interaction_ci(b.labelled(spark, sf), **ROWS), "ci_low", "ci_high")


@query("paired_difference", with_(*BASE, weights_sql("lab")) + paired_sql("setting", "lab", "single_correct", "baseline_correct"))
def paired_difference(spark, sf):
    out = rs.paired_difference(b.labelled(spark, sf), "single_correct", "baseline_correct", ["setting"], scale=100.0, **ROWS)
    return rounded(out, "ci_low", "ci_high")


USABLE_W = f"u AS (SELECT *, confidence / 100 AS p, {RISK_SQL} AS risk FROM conf WHERE confidence IS NOT NULL)"


@query("auroc_ci", with_(*CBASE, USABLE_W, weights_sql("u"), auroc_sql("setting", "a", "u", "NOT baseline_correct", "risk"),
       auroc_sql("setting, replicate", "d", "wt", "NOT baseline_correct", "risk", "w")) + f""", c AS ({bounds('setting', 'd', 'auroc')})
SELECT a.setting, auroc AS point, ci_low, ci_high FROM a JOIN c ON a.setting = c.setting""")
def auroc_ci(spark, sf):
    return rounded(rs.auroc_ci(b.confident(spark, sf), **ROWS), "ci_low", "ci_high")


def ece_sql(by: str, source: str, out: str, w: str) -> str:
    return f"""{out}_b AS (SELECT {by}, {BIN_SQL} AS bin, sum({w}) AS n, sum({w} * p) AS sp, sum(CASE WHEN baseline_correct THEN {w} ELSE 0 END) AS sc
    FROM {source} GROUP BY {by}, bin HAVING sum({w}) > 0),
  {out} AS (SELECT {by}, sum(n * abs(sp / CAST(n AS DOUBLE) - CAST(sc AS DOUBLE) / CAST(n AS DOUBLE))) / CAST(sum(n) AS DOUBLE) AS ece FROM {out}_b GROUP BY {by})"""


@query("ece_ci", with_(*CBASE, USABLE_W, weights_sql("u"), ece_sql("setting", "u", "e", "1"), ece_sql("setting, replicate", "wt", "d", "w")) + f""",
c AS ({bounds('setting', 'd', 'ece')}) SELECT e.setting, round(ece, 9) AS point, ci_low, ci_high FROM e JOIN c ON e.setting = c.setting""")
def ece_ci(spark, sf):
    return rounded(rs.ece_ci(b.confident(spark, sf), **ROWS), "point", "ci_low", "ci_high")


def _routed(col):
    return _pick(F.col(col), OUTCOME_COLUMNS, False)


PICK = ("CASE {0} WHEN 'none' THEN FALSE WHEN 'baseline_llm' THEN baseline_correct WHEN 'single_agent' THEN single_correct "
        "WHEN 'planner_executor_reviewer' THEN per_correct ELSE broadcast_correct END")
ARMS = (*BASE, split_sql(0.7, 0.15, 20260712), FITROWS, majority_sql("fit", "difficulty_tier", "mt"), majority_sql("fit", "", "mg"),
        """arms AS (SELECT sp.problem_uid, sp.setting, baseline_correct,
  """ + PICK.format("coalesce(mt.majority, (SELECT majority FROM mg))") + """ AS tier_ok,
  """ + PICK.format("CASE (pk * 7 + 3) % 5 WHEN 0 THEN 'baseline_llm' WHEN 1 THEN 'single_agent' WHEN 2 THEN 'planner_executor_reviewer' WHEN 3 THEN 'broadcast' ELSE 'none' END") + """ AS router_ok
  FROM sp LEFT JOIN mt ON mt.difficulty_tier = sp.difficulty_tier WHERE split = 'test')""",
        """pairs AS (SELECT problem_uid, setting, 'router_minus_tier_majority' AS pair, router_ok AS arm_a, tier_ok AS arm_b FROM arms
  UNION ALL SELECT problem_uid, setting, 'router_minus_baseline', router_ok, baseline_correct FROM arms)""")


@query("router_delta_ci", with_(*ARMS, weights_sql("pairs")) + paired_sql("setting, pair", "pairs", "arm_a", "arm_b"))
def router_delta_ci(spark, sf):
    return rounded(rs.router_delta_ci(_arms(spark, sf), ROUTER_PAIRS, **ROWS), "ci_low", "ci_high")


ROUTER_PAIRS = {"router_minus_tier_majority": ("router_ok", "tier_ok"), "router_minus_baseline": ("router_ok", "baseline_correct")}


def _arms(spark, sf):
    """Test rows with the outcomes of two routers."""
    from ..functions.outcomes import canonical_protocol

    rows = stratified_split(b.labelled(spark, sf), SplitConfig.six_setting())
    model = TierMajority().fit(refit_rows(rows))
    test = model.transform(rows.where("split = 'test'"), "tier_label").withColumn("router_label", canonical_protocol(b.hash_prediction()))
    return test.withColumn("tier_ok", _routed("tier_label")).withColumn("router_ok", _routed("router_label"))


P, G = rank_sql("predicted_label"), rank_sql("oracle_label")


def _total(cond: str) -> str:
    return f"CAST(coalesce(sum(w) FILTER (WHERE {cond}), 0) AS BIGINT)"


def summary_sql(source: str, keys: str, out: str) -> str:
    base = f"""{out}_s AS (SELECT {keys}, CAST(sum(w) AS BIGINT) AS n, {_total('success')} AS ns, {_total('mode_correct')} AS nm,
  {_total('solvable')} AS nv, {_total('solvable AND NOT success')} AS nx, {_total(f'({P}) > ({G})')} AS no, {_total(f'({P}) < ({G})')} AS nu,
  {_total(f'({P}) = ({G})')} AS ne, {confusion_sql('w')} FROM {source} GROUP BY {keys})"""
    parts = {
        "solve_rate": rat("ns", "n"), "mode_accuracy": rat("nm", "n"), "macro_f1": f"CASE WHEN n > 0 THEN {MACRO_F1} END",
        "missed_success_rate": f"CASE WHEN n > 0 THEN coalesce({rat('nx', 'nv')}, 0) END", "over_escalation_rate": rat("no", "n"),
        "under_escalation_rate": rat("nu", "n"), "match_rate": rat("ne", "n"),
    }
    return base + f", {out} AS (" + " UNION ALL ".join(f"SELECT {keys}, '{k}' AS metric, {v} AS value FROM {out}_s" for k, v in parts.items()) + ")"


@query("routing_ci", with_(*BASE, PRED, replay_sql("pred"), weights_sql("rep"), "ones AS (SELECT *, 1 AS w FROM rep)",
       summary_sql("ones", "setting", "pt"), summary_sql("wt", "setting, replicate", "dr")) + f""", c AS ({bounds('setting, metric', 'dr', 'value')})
SELECT pt.setting, pt.metric, round(pt.value, 9) AS point, ci_low, ci_high FROM pt JOIN c ON c.setting = pt.setting AND c.metric = pt.metric""")
def routing_ci(spark, sf):
    return rounded(rs.routing_ci(b.replayed(spark, sf), **ROWS), "point", "ci_low", "ci_high")


# The default weights: cost independent of the number of rows.  Every draw is repeated: counts per cell, a table of
# cumulative probabilities for each different count, and the place of the draw's 52 bits in it.


def cells_sql(source: str, columns: str, out: str = "wt") -> str:
    """Twin of the cell weights over the columns of a cell (groups first)."""
    key = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c.strip()} AS VARCHAR), '<null>')" for c in columns.split(",")) + ")"
    spread = "(12 * sqrt(c) + 40)"
    lanes = " UNION ALL ".join(
        f"SELECT * EXCLUDE (h, twin), 2 * twin + {i} AS replicate, CAST(concat('0x', substr(h, {16 * i + 1}, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM {out}_h"
        for i in (0, 1))
    return f"""{out}_n AS (SELECT {columns}, count(*) AS c, {key} AS key FROM {source} GROUP BY {columns}),
{out}_r AS (SELECT DISTINCT c, CAST(floor(greatest(c - {spread}, 0)) AS BIGINT) AS low, CAST(floor(c + {spread}) AS BIGINT) AS high FROM {out}_n),
{out}_k AS (SELECT c, unnest(range(low, high + 1)) AS k FROM {out}_r),
{out}_t AS (SELECT c, k, sum(exp(k * ln(c) - c - lgamma(k + 1))) OVER (PARTITION BY c ORDER BY k) AS upto FROM {out}_k),
{out}_h AS (SELECT n.* EXCLUDE (key), twin, md5(concat('{SEED}|', CAST(twin AS VARCHAR), '|', key)) AS h FROM {out}_n n, (SELECT unnest(range({B // 2})) AS twin)),
{out}_u AS ({lanes}),
{out} AS (SELECT d.* EXCLUDE (c, u), coalesce(t.k + 1, r.low) AS w FROM {out}_u d JOIN {out}_r r ON r.c = d.c ASOF LEFT JOIN {out}_t t ON t.c = d.c AND d.u >= t.upto)"""


CI = ("ci_low", "ci_high")


@query("bootstrap_ci_cells", with_(*BASE, cells_sql("lab", "setting, per_correct")) + f""",
d AS (SELECT setting, replicate, {rat('sum(w) FILTER (WHERE per_correct)', 'sum(w)')} AS draw FROM wt GROUP BY 1, 2),
c AS ({bounds('setting', 'd')})
SELECT lab.setting, count(*) AS n, {rat(cnt('per_correct'), 'count(*)')} AS point, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high
FROM lab JOIN c ON c.setting = lab.setting GROUP BY lab.setting""")
def bootstrap_ci_cells(spark, sf):
    return rounded(rs.bootstrap_ci(b.labelled(spark, sf), "per_correct", ["setting"], n=B), *CI)


SCORE_CELLS = cells_sql("u", "setting, confidence, baseline_correct", "wc") + f", wt AS (SELECT *, confidence / 100 AS p, {RISK_SQL} AS risk FROM wc)"


@query("auroc_ci_cells", with_(*CBASE, USABLE_W, SCORE_CELLS, auroc_sql("setting", "a", "u", "NOT baseline_correct", "risk"),
       auroc_sql("setting, replicate", "d", "wt", "NOT baseline_correct", "risk", "w")) + f""", c AS ({bounds('setting', 'd', 'auroc')})
SELECT a.setting, auroc AS point, ci_low, ci_high FROM a JOIN c ON a.setting = c.setting""")
def auroc_ci_cells(spark, sf):
    return rounded(rs.auroc_ci(b.confident(spark, sf), n=B), *CI)


@query("ece_ci_cells", with_(*CBASE, USABLE_W, SCORE_CELLS, ece_sql("setting", "u", "e", "1"), ece_sql("setting, replicate", "wt", "d", "w")) + f""",
c AS ({bounds('setting', 'd', 'ece')}) SELECT e.setting, round(ece, 9) AS point, ci_low, ci_high FROM e JOIN c ON e.setting = c.setting""")
def ece_ci_cells(spark, sf):
    return rounded(rs.ece_ci(b.confident(spark, sf), n=B), "point", *CI)


@query("routing_ci_cells", with_(*BASE, PRED, replay_sql("pred"), "ones AS (SELECT *, 1 AS w FROM rep)", cells_sql("rep", "setting, oracle_label, predicted_label, success", "wc"),
       "wt AS (SELECT *, oracle_label = predicted_label AS mode_correct, oracle_label <> 'none' AS solvable FROM wc)",
       summary_sql("ones", "setting", "pt"), summary_sql("wt", "setting, replicate", "dr")) + f""", c AS ({bounds('setting, metric', 'dr', 'value')})
SELECT pt.setting, pt.metric, round(pt.value, 9) AS point, ci_low, ci_high FROM pt JOIN c ON c.setting = pt.setting AND c.metric = pt.metric""")
def routing_ci_cells(spark, sf):
    return rounded(rs.routing_ci(b.replayed(spark, sf), n=B), "point", *CI)


def difference_draws_sql(by: str, source: str, a: str, z: str) -> str:
    return f"""sd AS (SELECT *, CAST({a} AS INTEGER) - CAST({z} AS INTEGER) AS diff FROM {source}), {cells_sql('sd', by + ', diff')},
d AS (SELECT {by}, replicate, CAST(100 AS DOUBLE) * ({rat('sum(w * diff)', 'sum(w)')}) AS draw FROM wt GROUP BY {by}, replicate)"""


def difference_sql(by: str, source: str, a: str, z: str) -> str:
    """The paired difference in points over the cells of equal differences."""
    on = " AND ".join(f"p.{c.strip()} = c.{c.strip()}" for c in by.split(","))
    cols = ", ".join(f"p.{c.strip()}" for c in by.split(","))
    point = f"CAST(100 AS DOUBLE) * ({rat(f'{cnt(a)} - {cnt(z)}', 'count(*)')})"
    return f"""{difference_draws_sql(by, source, a, z)}, c AS ({bounds(by, 'd')}), p AS (SELECT {by}, count(*) AS n, round({point}, 9) AS point FROM {source} GROUP BY {by})
SELECT {cols}, n, point, ci_low, ci_high FROM p JOIN c ON {on}"""


@query("interaction_ci_cells", with_(*BASE, BOTH) + ", " + difference_sql("setting", "bf", "broadcast_correct", "per_correct"))
def interaction_ci_cells(spark, sf):
    return rounded(rs.interaction_ci(b.labelled(spark, sf), n=B), "point", *CI)


INTER_PCT = ("per_solve_pct", "broadcast_solve_pct", "broadcast_minus_per_points", "per_only_pct", "broadcast_only_pct", "both_pct", "neither_pct")


@query("published_interaction", with_(*BASE, DIM_SQL, BOTH) + f""", {difference_draws_sql("setting", "bf", "broadcast_correct", "per_correct")},
q AS (SELECT setting, quantile_cont(draw, 0.025) AS lo, quantile_cont(draw, 0.975) AS hi FROM d GROUP BY setting),
c AS (SELECT {_inter("setting")} FROM bf GROUP BY setting)
SELECT {NAMED_SQL}, n, {", ".join(ROUND_SQL.format(d=1, c=k) for k in INTER_PCT)}, per_only_count, broadcast_only_count, both_count, neither_count,
  printf('[%.1f,%.1f]', lo, hi) AS broadcast_minus_per_ci_points FROM c JOIN q ON q.setting = c.setting LEFT JOIN dim ON dim.setting = c.setting""")
def published_interaction(spark, sf):
    return _published(spark, sf, "per_broadcast_interaction")


@query("router_delta_ci_cells", with_(*ARMS) + ", " + difference_sql("setting, pair", "pairs", "arm_a", "arm_b"))
def router_delta_ci_cells(spark, sf):
    return rounded(rs.router_delta_ci(_arms(spark, sf), ROUTER_PAIRS, n=B), "point", *CI)


def bracketed(df):
    """Rounded points, and whether the bounds lie around them, instead of the bounds: no other engine repeats these draws."""
    around = (F.col("ci_low") <= F.col("point")) & (F.col("point") <= F.col("ci_high")) & (F.col("ci_low") < F.col("ci_high"))
    certain = F.col("point").isin(0.0, 1.0) & (F.col("ci_low") == F.col("ci_high")) & (F.col("ci_low") == F.col("point"))
    return rounded(df.withColumn("brackets", around | certain).drop("ci_low", "ci_high"), "point")


@query("multinomial_cells", with_(*BASE) + f"""
SELECT count(*) AS n, CAST({B} AS BIGINT) AS replicates, round({rat(cnt('broadcast_correct'), 'count(*)')}, 9) AS point, TRUE AS brackets FROM lab""")
def multinomial(spark, sf):
    """Every replicate has as many draws as there are rows, over one cell per problem; the share of successes splits no node below it."""
    rows = b.labelled(spark, sf)
    draws = rs.multinomial_cells(rows, ["problem_uid", "broadcast_correct"], n=B, of=["broadcast_correct"]).groupBy("replicate").agg(
        ratio(F.sum(F.when(F.col("broadcast_correct"), F.col("w")).otherwise(0)), F.sum("w")).alias("draw"), F.sum("w").alias("n"),
    )
    bounds = draws.groupBy("n").agg(F.count("*").alias("replicates"), F.percentile("draw", F.lit(0.025)).alias("ci_low"), F.percentile("draw", F.lit(0.975)).alias("ci_high"))
    point = rows.agg(F.avg(F.col("broadcast_correct").cast("double")).alias("point")).scalar()
    return bracketed(bounds.withColumn("point", point))
