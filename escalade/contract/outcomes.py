"""Outcome tables, labels, validation, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import EXECUTIONS, LABELS, OUTCOME_COLUMNS, SHORT, TOKEN_COLUMNS
from ..functions.outcomes import (
    any_solved,
    canonical_protocol,
    difficulty_tier,
    escalation_direction,
    lenient_outcome,
    strict_outcome,
)
from ..operators import filters, matched, reports, settings
from ..operators.splits import SplitConfig, stratified_split
from . import bindings as b
from .base import BASE, LAB, MATCHED, PRED, RUN, cnt, pct, query, rank_sql, split_sql, with_

# Five of the six part types are listed settings; the sixth stays unknown, and
# one listed setting has no rows.
DIM = (
    ("ECONOMY", "solver-a", "Economy", 1, 5),
    ("SMALL", "solver-a", "Small", 2, 4),
    ("MEDIUM", "solver-b", "Medium", 3, 3),
    ("LARGE", "solver-b", "Large", 4, 2),
    ("STANDARD", "solver-b", "Standard", 5, 1),
    ("ABSENT", "solver-c", "Absent", 6, 6),
)
DIM_SQL = "dim(setting, solver, setting_label, coverage_ord, oracle_ord) AS (VALUES " + ", ".join(map(str, DIM)) + ")"
SPELL_SQL = "CASE l_linenumber WHEN 1 THEN 'Baseline' WHEN 2 THEN 'single_agent' WHEN 3 THEN ' PER ' ELSE 'broadcast' END"


def _dim(spark):
    from ..dims import setting_dim

    return setting_dim(spark, DIM)


OUT = "baseline_correct, single_correct, per_correct, broadcast_correct"
TOK = "baseline_tokens, single_tokens, per_tokens, broadcast_tokens"


@query("canonical_protocol", """
SELECT protocol, count(*) AS n FROM (
  SELECT CASE lower(trim(s)) WHEN 'baseline' THEN 'baseline_llm' WHEN 'single_agent' THEN 'single_agent'
              WHEN 'per' THEN 'planner_executor_reviewer' WHEN 'broadcast' THEN 'broadcast' ELSE '<unknown>' END AS protocol
  FROM (SELECT CASE l_linenumber WHEN 1 THEN 'Baseline' WHEN 2 THEN 'single_agent' WHEN 3 THEN ' PER '
               WHEN 4 THEN 'broadcast' ELSE concat('p', CAST(l_linenumber AS VARCHAR)) END AS s FROM lineitem))
GROUP BY 1""")
def canonical(spark, sf):
    line = F.col("l_linenumber")
    text = (F.when(line == 1, "Baseline").when(line == 2, "single_agent").when(line == 3, " PER ")
            .when(line == 4, "broadcast").otherwise(F.concat(F.lit("p"), line.cast("string"))))
    named = F.coalesce(canonical_protocol(text, on_error="null"), F.lit("<unknown>"))
    return b.table(spark, sf, "lineitem").groupBy(named.alias("protocol")).agg(F.count("*").alias("n"))


def _spelled(on: str = "event_id"):
    e = F.col(on)
    yes = F.array(*[F.lit(x) for x in ("1", "true", "T", " yes ", "1.0")])
    no = F.array(*[F.lit(x) for x in ("0", "False", "f", "NO", "0.0")])
    return F.when(F.col("value") > 10, F.get(yes, (e % 5).cast("int"))).otherwise(F.get(no, (e % 5).cast("int")))


SPELLED_SQL = """CASE WHEN value > 10 THEN (['1','true','T',' yes ','1.0'])[event_id % 5 + 1]
  ELSE (['0','False','f','NO','0.0'])[event_id % 5 + 1] END"""


@query("strict_outcome", "SELECT event_id, value > 10 AS outcome FROM events")
def strict(spark, sf):
    return b.table(spark, sf, "events").select("event_id", strict_outcome(_spelled()).alias("outcome"))


@query("lenient_outcome", f"SELECT event_id, lower(trim({SPELLED_SQL})) IN ('1', 'true') AS outcome FROM events")
def lenient(spark, sf):
    return b.table(spark, sf, "events").select("event_id", lenient_outcome(_spelled()).alias("outcome"))


@query("difficulty_tier", """
SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN greatest(1, least(10, CAST(round_even(CAST(p_size AS DOUBLE) / 4, 0) AS INTEGER))) ELSE -1 END AS tier
FROM part""")
def tier(spark, sf):
    size = F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double") / 4)
    return b.table(spark, sf, "part").select("p_partkey", F.coalesce(difficulty_tier(size), F.lit(-1)).alias("tier"))


@query("matched_outcomes", with_(RUN, MATCHED) + f"""
SELECT 'matched' AS part, CAST(pk AS VARCHAR) AS problem_uid, p_type AS setting, {OUT}, {TOK}, CAST(4 AS INTEGER) AS n_protocols
FROM m JOIN part ON p_partkey = pk
UNION ALL
SELECT 'incomplete', CAST(pk AS VARCHAR), any_value(p_type),
  coalesce(bool_or(passed) FILTER (WHERE ln = 1), FALSE), coalesce(bool_or(passed) FILTER (WHERE ln = 2), FALSE),
  coalesce(bool_or(passed) FILTER (WHERE ln = 3), FALSE), coalesce(bool_or(passed) FILTER (WHERE ln = 4), FALSE),
  CAST(coalesce(sum(tokens) FILTER (WHERE ln = 1), -1) AS BIGINT), CAST(coalesce(sum(tokens) FILTER (WHERE ln = 2), -1) AS BIGINT),
  CAST(coalesce(sum(tokens) FILTER (WHERE ln = 3), -1) AS BIGINT), CAST(coalesce(sum(tokens) FILTER (WHERE ln = 4), -1) AS BIGINT),
  CAST(count(*) AS INTEGER)
FROM run JOIN part ON p_partkey = pk GROUP BY pk HAVING count(*) < 4""")
def matched_outcomes(spark, sf):
    part = b.table(spark, sf, "part").select(F.col("p_partkey").alias("pk"), F.col("p_type").alias("setting"))
    runs = b.runs(spark, sf).join(part, "pk")
    full, incomplete = matched.matched_outcomes(runs)
    full = full.withColumn("n_protocols", F.lit(4))
    both = full.withColumn("part", F.lit("matched")).unionByName(incomplete.withColumn("part", F.lit("incomplete")))
    # No NULLs in the output, so that every reader sees integers and booleans.
    return both.fillna(-1, list(TOKEN_COLUMNS.values())).fillna(False, list(OUTCOME_COLUMNS.values()))


@query("oracle_label", with_(*BASE) + f"SELECT problem_uid, {OUT}, oracle_label FROM lab")
def oracle_label(spark, sf):
    return b.labelled(spark, sf).select("problem_uid", *OUTCOME_COLUMNS.values(), "oracle_label")


@query("any_solved", with_(*BASE) + "SELECT problem_uid, oracle_label <> 'none' AS solved FROM lab")
def solved(spark, sf):
    return b.matched(spark, sf).select("problem_uid", any_solved().alias("solved"))


SHARE_COLS = ", ".join(f"{pct(cnt(f'''oracle_label = '{p}' '''), 'count(*)')} AS {SHORT[p]}_pct" for p in LABELS)


@query("oracle_shares", with_(*BASE) + f"SELECT setting, {SHARE_COLS} FROM lab GROUP BY setting")
def oracle_shares(spark, sf):
    return matched.oracle_shares(b.labelled(spark, sf), ["setting"])


@query("escalation_direction", with_(*BASE, PRED) + f"""
SELECT problem_uid, CASE WHEN {rank_sql('predicted_label')} > {rank_sql('oracle_label')} THEN 'over'
  WHEN {rank_sql('predicted_label')} < {rank_sql('oracle_label')} THEN 'under' ELSE 'match' END AS direction FROM pred""")
def direction(spark, sf):
    pred = canonical_protocol(b.hash_prediction())
    return b.labelled(spark, sf).select("problem_uid", escalation_direction(pred, "oracle_label").alias("direction"))


@query("value_targets", with_(*BASE) + """
SELECT problem_uid, setting, 'Baseline failure' AS target, NOT baseline_correct AS y FROM lab
UNION ALL SELECT problem_uid, setting, 'Any collaboration improves over Baseline', NOT baseline_correct AND oracle_label <> 'none' FROM lab
UNION ALL SELECT problem_uid, setting, 'PER first success', oracle_label = 'planner_executor_reviewer' FROM lab
UNION ALL SELECT problem_uid, setting, 'Broadcast first success', oracle_label = 'broadcast' FROM lab""")
def value_targets(spark, sf):
    return matched.value_targets(b.labelled(spark, sf))


# --- validation -------------------------------------------------------------


def _dirty(spark, sf):
    """Raw text outcomes with non-binary cells, duplicate ids and stale labels."""
    m = b.labelled(spark, sf)
    text = {c: F.when(F.col(c), "1").otherwise("0") for c in OUTCOME_COLUMNS.values()}
    base = m.select(
        "pk", "setting", "problem_uid",
        *[text[c].alias(c) for c in OUTCOME_COLUMNS.values()],
        F.when(F.col("pk") % 53 == 0, F.lit("unsolved")).otherwise(F.col("oracle_label")).alias("oracle_cheapest_successful"),
        F.when(F.col("pk") % 2 == 0, "train").otherwise("test").alias("split"),
    )
    bad = base.withColumns({
        "baseline_correct": F.when(F.col("pk") % 101 == 0, "2").otherwise(F.col("baseline_correct")),
        "per_correct": F.when(F.col("pk") % 211 == 0, F.lit(None)).otherwise(F.col("per_correct")),
    })
    return bad.unionByName(bad.where("pk % 67 = 0").withColumn("split", F.lit("dev")))


DIRTY = """one AS (
  SELECT pk, setting, problem_uid,
    CASE WHEN pk % 101 = 0 THEN '2' WHEN baseline_correct THEN '1' ELSE '0' END AS baseline_correct,
    CASE WHEN single_correct THEN '1' ELSE '0' END AS single_correct,
    CASE WHEN pk % 211 = 0 THEN NULL WHEN per_correct THEN '1' ELSE '0' END AS per_correct,
    CASE WHEN broadcast_correct THEN '1' ELSE '0' END AS broadcast_correct,
    CASE WHEN pk % 53 = 0 THEN 'none' ELSE oracle_label END AS stored,
    CASE WHEN pk % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM lab),
dirty AS (SELECT * FROM one UNION ALL SELECT * REPLACE ('dev' AS split) FROM one WHERE pk % 67 = 0)"""


def _non_binary(col: str) -> str:
    return (f"SELECT 'non_binary:{col}' AS \"check\", setting, coalesce({col}, 'NULL') AS example, count(*) AS n FROM dirty "
            f"WHERE {col} IS NULL OR {col} NOT IN ('0', '1') GROUP BY 1, 2, 3")


@query("validate_matched", with_(*BASE, DIRTY) + f""", found AS (
{' UNION ALL '.join(_non_binary(c) for c in OUTCOME_COLUMNS.values())}
UNION ALL SELECT 'duplicate_uid', setting, problem_uid, count(*) - 1 FROM dirty GROUP BY setting, problem_uid HAVING count(*) > 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "check", setting ORDER BY example) AS rn FROM found)
SELECT "check", setting, CAST(sum(n) AS BIGINT) AS n_bad, string_agg(example, ', ' ORDER BY example) FILTER (WHERE rn <= 5) AS examples
FROM ranked GROUP BY 1, 2""")
def validate_matched(spark, sf):
    return matched.validate_matched(_dirty(spark, sf))


LADDER = """CASE WHEN baseline_correct NOT IN ('0','1') OR per_correct IS NULL THEN NULL
  WHEN baseline_correct = '1' THEN 'baseline_llm' WHEN single_correct = '1' THEN 'single_agent'
  WHEN per_correct = '1' THEN 'planner_executor_reviewer' WHEN broadcast_correct = '1' THEN 'broadcast' ELSE 'none' END"""
UNSOLVED = "coalesce(baseline_correct = '1', FALSE) OR single_correct = '1' OR coalesce(per_correct = '1', FALSE) OR broadcast_correct = '1'"
CHECKS = {
    "null_outcome": "per_correct IS NULL",
    "non_binary_outcome": "baseline_correct = '2'",
    "null_problem_uid": "problem_uid IS NULL",
    "label_mismatch": f"stored IS DISTINCT FROM ({LADDER})",
    "none_iff_unsolved": f"(stored = 'none') = ({UNSOLVED})",
}


@query("quality_report", with_(*BASE, DIRTY) + " UNION ALL ".join(
    f"SELECT '{k}' AS \"check\", setting, {cnt(v)} AS n_bad FROM dirty GROUP BY setting" for k, v in CHECKS.items()
) + """ UNION ALL SELECT 'duplicate_problem_uid', setting, count(*) FILTER (WHERE n > 1) FROM
  (SELECT setting, problem_uid, count(*) AS n FROM dirty GROUP BY 1, 2) GROUP BY setting
UNION ALL SELECT 'split_overlap', setting, count(*) FILTER (WHERE lo <> hi) FROM
  (SELECT setting, problem_uid, min(split) AS lo, max(split) AS hi FROM dirty GROUP BY 1, 2) GROUP BY setting""")
def quality_report(spark, sf):
    return matched.quality_report(_dirty(spark, sf), split="split")


# --- settings ---------------------------------------------------------------


@query("filter_settings", with_(*BASE, DIM_SQL) + "SELECT problem_uid, setting FROM lab WHERE setting IN (SELECT setting FROM dim)")
def filter_settings(spark, sf):
    return settings.filter_settings(b.labelled(spark, sf), _dim(spark)).select("problem_uid", "setting")


@query("missing_settings", with_(*BASE, DIM_SQL) + "SELECT setting FROM dim WHERE setting NOT IN (SELECT setting FROM lab)")
def missing_settings(spark, sf):
    return settings.missing_settings(b.labelled(spark, sf), _dim(spark))


@query("label_settings", with_(*BASE, DIM_SQL) + """
SELECT lab.setting, coalesce(solver, concat('endpoint/', lower(lab.setting))) AS solver,
       coalesce(setting_label, lab.setting) AS setting_label, count(*) AS n
FROM lab LEFT JOIN dim ON dim.setting = lab.setting GROUP BY 1, 2, 3""")
def label_settings(spark, sf):
    named = settings.label_settings(b.labelled(spark, sf), _dim(spark))
    return named.groupBy("setting", "solver", "setting_label").agg(F.count("*").alias("n"))


COVER = ", ".join(f"{pct(cnt(OUTCOME_COLUMNS[p]), 'count(*)')} AS {SHORT[p]}_pct" for p in EXECUTIONS)
COVER += f", {pct(cnt('''oracle_label <> 'none' '''), 'count(*)')} AS oracle_pct"


@query("report_order", with_(*BASE, DIM_SQL) + f"""
SELECT c.*, CAST(coalesce(oracle_ord, 1000000000) AS BIGINT) AS report_rank
FROM (SELECT setting, count(*) AS n, {COVER} FROM lab GROUP BY setting) c LEFT JOIN dim ON dim.setting = c.setting""")
def report_order(spark, sf):
    return settings.report_order(reports.coverage_table(b.labelled(spark, sf)), _dim(spark), "oracle_ord")


@query("union_settings", with_(*BASE) + "SELECT problem_uid, setting, CASE WHEN setting IN ('SMALL', 'ECONOMY', 'STANDARD') THEN baseline_tokens ELSE -1 END AS baseline_tokens FROM lab")
def union_settings(spark, sf):
    m = b.labelled(spark, sf)
    with_tokens, settings_seen = ["SMALL", "ECONOMY", "STANDARD"], [*[d[0] for d in DIM if d[0] != "ABSENT"], "PROMO"]
    frames = [
        m.where(F.col("setting") == s).select("problem_uid", "setting", *(["baseline_tokens"] if s in with_tokens else [])) for s in settings_seen
    ]
    return settings.union_settings(frames).fillna(-1, ["baseline_tokens"])


# --- filters ----------------------------------------------------------------

TAGS = ["", "0", "math", "[]", "proof", "None"]
TAG_SQL = "(['', '0', 'math', '[]', 'proof', 'None'])[doc_id % 6 + 1]"


@query("filter_tagged", f"SELECT doc_id FROM documents WHERE {TAG_SQL} NOT IN ('math', 'proof')")
def filter_tagged(spark, sf):
    tags = F.get(F.array(*[F.lit(t) for t in TAGS]), (F.col("doc_id") % 6).cast("int"))
    docs = b.table(spark, sf, "documents").withColumn("tags", tags)
    return filters.filter_tagged(docs, "tags").select("doc_id")


PHRASES = ("the th", "er er", "is and")


@query("filter_missing_artifact", "SELECT doc_id, " + ", ".join(
    f"contains(lower(text), '{p}') AS has_{i}" for i, p in enumerate(PHRASES)) + """,
  CASE WHEN contains(lower(text), 'the th') OR contains(lower(text), 'er er') OR contains(lower(text), 'is and')
       THEN 'excluded' ELSE 'kept' END AS part FROM documents""")
def filter_missing_artifact(spark, sf):
    kept, excluded = filters.split_missing_artifact(b.table(spark, sf, "documents"), "text", PHRASES)
    kept = kept.withColumn("reasons", F.array().cast("array<string>")).withColumn("part", F.lit("kept"))
    both = kept.unionByName(excluded.withColumn("part", F.lit("excluded")))
    return both.select("doc_id", *[F.array_contains("reasons", p).alias(f"has_{i}") for i, p in enumerate(PHRASES)], "part")


@query("filter_subsets", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src3', 'src5') GROUP BY source")
def filter_subsets(spark, sf):
    kept = filters.filter_in(b.table(spark, sf, "documents"), "source", ["src1", "src3", "src5"])
    return kept.groupBy("source").agg(F.count("*").alias("n"))


@query("limit_rows", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def limit_rows(spark, sf):
    return filters.limit_rows(b.table(spark, sf, "documents"), 100, "doc_id").select("doc_id", "source")


@query("expected_rows", with_(*BASE) + "SELECT CAST(2000 AS BIGINT) AS expected, count(*) AS loaded, count(*) = 2000 AS ok FROM lab")
def expected_rows(spark, sf):
    return matched.expect_rows(b.labelled(spark, sf), 2000)


# --- leakage ----------------------------------------------------------------


def _problems(spark, sf):
    docs = b.table(spark, sf, "documents")
    word = F.get(F.split("text", " "), (F.col("doc_id") % 5).cast("int"))
    meta = F.map_from_arrays(
        F.array(F.lit("lang"), F.when(F.col("doc_id") % 50 == 0, "gold_answer").when(F.col("doc_id") % 50 == 1, "answer_key").otherwise("source")),
        F.array(F.col("lang"), F.col("source")),
    )
    return docs.select(
        "doc_id", F.col("text").alias("input"),
        F.when(F.col("doc_id") % 2 == 0, word).otherwise(F.upper(F.coalesce(word, F.lit("")))).alias("answer"), meta.alias("metadata"),
    )


WORD_SQL = "(string_split(text, ' '))[doc_id % 5 + 1]"
LEAK = f"""leak AS (
  SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN {WORD_SQL} ELSE upper(coalesce({WORD_SQL}, '')) END AS answer,
    CASE doc_id % 50 WHEN 0 THEN 'gold_answer' WHEN 1 THEN 'answer_key' ELSE '' END AS leaked FROM documents)"""
TRIM = r"regexp_replace(coalesce(answer, ''), '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g')"


@query("row_leakage", with_(LEAK) + f"""
SELECT doc_id, leaked AS leaked_keys, leaked <> '' AS hard_fail,
  length({TRIM}) >= 3 AND contains(text, {TRIM}) AS answer_in_prompt FROM leak""")
def row_leakage(spark, sf):
    out = filters.row_leakage(_problems(spark, sf))
    return out.select("doc_id", F.concat_ws(",", "leaked_keys").alias("leaked_keys"), "hard_fail", "answer_in_prompt")


@query("forbidden_overlap", "SELECT doc_id, CASE doc_id % 50 WHEN 0 THEN 'gold_answer' ELSE 'answer_key' END AS overlap FROM documents WHERE doc_id % 50 < 2")
def forbidden_overlap(spark, sf):
    keys = F.array(*[F.lit(k) for k in filters.FORBIDDEN_METADATA])
    overlap = F.array_intersect(F.map_keys("metadata"), keys)
    return _problems(spark, sf).where(F.arrays_overlap(F.map_keys("metadata"), keys)).select(
        "doc_id", F.array_join(overlap, ",").alias("overlap")
    )


def _purity(feature: str, expr: str) -> str:
    return (f"SELECT '{feature}' AS feature, CAST({expr} AS VARCHAR) AS value, oracle_label AS label, count(*) AS n FROM lab GROUP BY 2, 3")


@query("value_leakage_scan", with_(*BASE) + f""", c AS ({_purity('source', 'source')} UNION ALL
{_purity('difficulty_tier', 'difficulty_tier')} UNION ALL {_purity('feature_17', 'baseline_correct')}),
v AS (SELECT feature, value, max(n) AS top, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT feature, count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n_rows, sum(top) AS explained FROM v GROUP BY 1),
g AS (SELECT feature, max(n) AS majority FROM (SELECT feature, label, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT feature, n_values, n_rows, CAST(explained AS DOUBLE) / CAST(n_rows AS DOUBLE) AS purity,
  CAST(majority AS DOUBLE) / CAST(n_rows AS DOUBLE) AS base_rate FROM p JOIN g USING (feature)""")
def value_leakage(spark, sf):
    m = b.labelled(spark, sf).withColumn("feature_17", F.col("baseline_correct"))
    return filters.value_leakage(m, ["source", "difficulty_tier", "feature_17"], "oracle_label")


# --- splits -----------------------------------------------------------------


@query("stratified_split", with_(*BASE, split_sql(0.8, 0.1, 42)) + "SELECT problem_uid, oracle_label, split FROM sp")
def stratified(spark, sf):
    m = b.labelled(spark, sf).select("problem_uid", "oracle_label")
    return stratified_split(m, SplitConfig.primary())


@query("stratified_split_six", with_(*BASE, split_sql(0.7, 0.15, 20260712)) + """
SELECT oracle_label, split, count(*) AS n, min(problem_uid) AS first_uid FROM sp GROUP BY 1, 2""")
def stratified_six(spark, sf):
    m = b.labelled(spark, sf).select("problem_uid", "oracle_label")
    return stratified_split(m, SplitConfig.six_setting()).groupBy("oracle_label", "split").agg(
        F.count("*").alias("n"), F.min("problem_uid").alias("first_uid")
    )


@query("source_holdout", with_(*BASE) + """
SELECT problem_uid, source, CASE WHEN CAST(concat('0x', substr(md5(concat_ws('|', '42', source)), 1, 8)) AS BIGINT) % 10000 < 2000
  THEN 'holdout' ELSE 'train' END AS split FROM lab""")
def source_holdout(spark, sf):
    from ..operators.splits import group_holdout

    return group_holdout(b.labelled(spark, sf).select("problem_uid", "source"), "source", 0.2)


@query("union_train_dev", with_(*BASE, split_sql(0.8, 0.1, 42)) + "SELECT problem_uid, split FROM sp WHERE split IN ('train', 'dev')")
def union_train_dev(spark, sf):
    from ..operators.splits import refit_rows

    return refit_rows(stratified(spark, sf)).select("problem_uid", "split")
