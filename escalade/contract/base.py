"""Registry of queries and the shared SQL fragments of their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import LABELS, SHORT

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key`` with its optional SQL twin."""

    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    """Round sums of doubles, whose last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def rat(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) <> 0 THEN CAST(({n}) AS DOUBLE) / CAST(({d}) AS DOUBLE) END"


def pct(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) <> 0 THEN CAST(100 AS DOUBLE) * CAST(({n}) AS DOUBLE) / CAST(({d}) AS DOUBLE) END"


def cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


RUN = """run AS (
  SELECT l_partkey AS pk, (l_linenumber - 1) % 4 + 1 AS ln,
         2 * count(*) FILTER (WHERE l_returnflag = 'R') < count(*) AS passed,
         CAST(sum(l_quantity) AS BIGINT) * ((l_linenumber - 1) % 4 + 1) AS tokens
  FROM lineitem GROUP BY 1, 2, (l_linenumber - 1) % 4)"""

MATCHED = """m AS (
  SELECT pk,
         bool_or(passed) FILTER (WHERE ln = 1) AS baseline_correct,
         bool_or(passed) FILTER (WHERE ln = 2) AS single_correct,
         bool_or(passed) FILTER (WHERE ln = 3) AS per_correct,
         bool_or(passed) FILTER (WHERE ln = 4) AS broadcast_correct,
         CAST(sum(tokens) FILTER (WHERE ln = 1) AS BIGINT) AS baseline_tokens,
         CAST(sum(tokens) FILTER (WHERE ln = 2) AS BIGINT) AS single_tokens,
         CAST(sum(tokens) FILTER (WHERE ln = 3) AS BIGINT) AS per_tokens,
         CAST(sum(tokens) FILTER (WHERE ln = 4) AS BIGINT) AS broadcast_tokens
  FROM run GROUP BY pk HAVING count(*) = 4)"""

LAB = """lab AS (
  SELECT CAST(pk AS VARCHAR) AS problem_uid, p_type AS setting, p_brand AS source, p_name AS problem,
         CAST(p_size AS DOUBLE) / 4 AS difficulty,
         greatest(1, least(10, CAST(round_even(CAST(p_size AS DOUBLE) / 4, 0) AS INTEGER))) AS difficulty_tier,
         p_size, m.*,
         CASE WHEN baseline_correct THEN 'baseline_llm' WHEN single_correct THEN 'single_agent'
              WHEN per_correct THEN 'planner_executor_reviewer' WHEN broadcast_correct THEN 'broadcast'
              ELSE 'none' END AS oracle_label
  FROM m JOIN part ON p_partkey = pk)"""

RAW = """raw AS (
  SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k,
         CASE event_id % 6
           WHEN 0 THEN concat('{"PROBABILITY": ', regexp_extract(props, '(\\d+)', 1), '}')
           WHEN 1 THEN concat('Probability : ', regexp_extract(props, '(\\d+)', 1))
           WHEN 2 THEN concat('  ', regexp_extract(props, '(\\d+)', 1), ' ')
           WHEN 3 THEN concat('I am about ', regexp_extract(props, '(\\d+)', 1), ' percent sure')
           WHEN 4 THEN concat('{"PROBABILITY": ', CAST(CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) + 60 AS VARCHAR), '}')
           ELSE 'no idea' END AS confidence_raw
  FROM events)"""

# The parsing ladder on text, written once for every twin that needs it.
PARSED = """parsed AS (
  SELECT event_id, k, confidence_raw,
         CASE WHEN starts_with(trim(confidence_raw), '{') THEN
                greatest(0, least(100, TRY_CAST(json_extract_string(confidence_raw, '$.PROBABILITY') AS DOUBLE)))
              WHEN regexp_matches(confidence_raw, '(?i)["'']?PROBABILITY["'']?\\s*:\\s*\\d{1,3}') THEN
                greatest(0, least(100, CAST(regexp_extract(confidence_raw, '(?i)["'']?PROBABILITY["'']?\\s*:\\s*(\\d{1,3})', 1) AS DOUBLE)))
              WHEN regexp_matches(trim(confidence_raw), '^\\d{1,3}$') THEN
                greatest(0, least(100, CAST(trim(confidence_raw) AS DOUBLE)))
              ELSE TRY_CAST(nullif(regexp_extract(confidence_raw, '\\b(\\d{1,2}|100)\\b', 1), '') AS DOUBLE)
         END AS confidence
  FROM raw)"""

CONF = """conf AS (SELECT lab.*, confidence, confidence_raw FROM lab JOIN parsed ON event_id = pk)"""

PRED = """pred AS (
  SELECT *, CASE (pk * 7 + 3) % 5 WHEN 0 THEN 'baseline_llm' WHEN 1 THEN 'single_agent'
              WHEN 2 THEN 'planner_executor_reviewer' WHEN 3 THEN 'broadcast' ELSE 'none' END AS predicted_label
  FROM lab)"""


def replay_sql(source: str, out: str = "rep") -> str:
    """Twin of ``replay`` over a CTE with ``predicted_label``."""

    def pick(col, suffix, none):
        return (
            f"CASE {col} WHEN 'none' THEN {none} WHEN 'baseline_llm' THEN baseline_{suffix} "
            f"WHEN 'single_agent' THEN single_{suffix} WHEN 'planner_executor_reviewer' THEN per_{suffix} "
            f"WHEN 'broadcast' THEN broadcast_{suffix} END"
        )

    tok, ora = pick("predicted_label", "tokens", 0), pick("oracle_label", "tokens", 0)
    return f"""{out} AS (
  SELECT *, {pick('predicted_label', 'correct', 'FALSE')} AS success,
         {tok} AS tokens, {ora} AS oracle_tokens,
         CAST(CASE WHEN ({tok}) IS NOT NULL AND ({ora}) IS NOT NULL THEN greatest(({tok}) - ({ora}), 0) END AS BIGINT) AS excess_tokens,
         predicted_label = oracle_label AS mode_correct, oracle_label <> 'none' AS solvable
  FROM {source})"""


def rank_sql(col: str) -> str:
    return (
        f"CASE {col} WHEN 'baseline_llm' THEN 0 WHEN 'single_agent' THEN 1 WHEN 'planner_executor_reviewer' THEN 2 "
        f"WHEN 'broadcast' THEN 3 ELSE -1 END"
    )


def split_sql(train: float, dev: float, seed: int, source: str = "lab", out: str = "sp") -> str:
    """Twin of ``stratified_split``: one plain window, floors and minimum-one rules."""
    return f"""{out}_r AS (
  SELECT *, row_number() OVER (PARTITION BY oracle_label ORDER BY sha256(concat_ws(':', '{seed}', oracle_label, problem_uid))) AS rk,
         count(*) OVER (PARTITION BY oracle_label) AS sz FROM {source}),
{out}_a AS (
  SELECT *, CASE WHEN sz >= 3 AND floor(CAST(sz AS DOUBLE) * CAST({train} AS DOUBLE)) = 0 THEN 1
                 ELSE floor(CAST(sz AS DOUBLE) * CAST({train} AS DOUBLE)) END AS tr,
         CASE WHEN sz >= 3 AND floor(CAST(sz AS DOUBLE) * CAST({dev} AS DOUBLE)) = 0 THEN 1
                 ELSE floor(CAST(sz AS DOUBLE) * CAST({dev} AS DOUBLE)) END AS dv FROM {out}_r),
{out}_b AS (
  SELECT *, CASE WHEN sz >= 3 AND sz - tr - dv = 0 AND tr >= dv AND tr > 1 THEN tr - 1 ELSE tr END AS tr2,
         CASE WHEN sz >= 3 AND sz - tr - dv = 0 AND NOT (tr >= dv AND tr > 1) AND dv > 1 THEN dv - 1 ELSE dv END AS dv2
  FROM {out}_a),
{out} AS (
  SELECT *, CASE WHEN rk <= tr2 THEN 'train' WHEN rk <= tr2 + dv2 THEN 'dev' ELSE 'test' END AS split FROM {out}_b)"""


def f1_sql(s: str) -> str:
    return f"CASE WHEN np_{s} + ng_{s} > 0 THEN CAST(2 AS DOUBLE) * tp_{s} / CAST(np_{s} + ng_{s} AS DOUBLE) ELSE 0 END"


def confusion_sql(weight: str | None = None) -> str:
    out = []
    for lab in LABELS:
        s = SHORT[lab]
        conds = {
            "tp": f"oracle_label = '{lab}' AND predicted_label = '{lab}'",
            "np": f"predicted_label = '{lab}'",
            "ng": f"oracle_label = '{lab}'",
        }
        for name, cond in conds.items():
            agg = f"sum({weight}) FILTER (WHERE {cond})" if weight else f"count(*) FILTER (WHERE {cond})"
            out.append(f"CAST(coalesce({agg}, 0) AS BIGINT) AS {name}_{s}")
    return ", ".join(out)


MACRO_F1 = "(" + " + ".join(f"({f1_sql(SHORT[p])})" for p in LABELS) + ") / CAST(5 AS DOUBLE)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (RUN, MATCHED, LAB)
CBASE = (*BASE, RAW, PARSED, CONF)
