"""Joins between runs and table comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..operators.reports import coverage_table
from ..operators.splits import SplitConfig, stratified_split
from . import bindings as b
from .base import BASE, PRED, query, rat, split_sql, with_
from .outcomes import COVER


@query("join_predictions", with_(*BASE, PRED) + "SELECT problem_uid, oracle_label, (['Baseline','single','PER','broadcast','unsolved'])[(pk * 7 + 3) % 5 + 1] AS predicted_label FROM pred")
def join_predictions(spark, sf):
    out = joins.join_predictions(b.labelled(spark, sf), b.predictions(spark, sf))
    return out.select("problem_uid", "oracle_label", "predicted_label")


@query("unjoined_predictions", with_(*BASE) + "SELECT CAST(p_partkey AS VARCHAR) AS problem_uid FROM part WHERE p_partkey NOT IN (SELECT pk FROM lab)")
def unjoined(spark, sf):
    return joins.unjoined(b.predictions(spark, sf), b.matched(spark, sf)).select("problem_uid")


@query("join_split", with_(*BASE, split_sql(0.8, 0.1, 42)) + "SELECT setting, split, count(*) AS n FROM sp GROUP BY 1, 2")
def join_split(spark, sf):
    m = b.labelled(spark, sf)
    split = stratified_split(m.select("problem_uid", "oracle_label"), SplitConfig.primary())
    return joins.join_split(m, split).groupBy("setting", "split").agg(F.count("*").alias("n"))


def _second(spark, sf):
    """A second scoring of the same problems under other ids, with some outcomes flipped."""
    m = b.labelled(spark, sf)
    flip = F.col("pk") % 97 == 0
    return m.withColumn("baseline_correct", F.when(flip, ~F.col("baseline_correct")).otherwise(F.col("baseline_correct")))


def _text():
    return F.concat(F.lit(" "), F.col("problem"), F.lit(" \n\t size "), F.col("p_size").cast("string"), F.lit("  "), F.col("source"))


SECOND = """second AS (SELECT pk, concat('b', CAST(pk + 5 AS VARCHAR)) AS uid_b, setting, p_size, source, problem,
  CASE WHEN pk % 97 = 0 THEN NOT baseline_correct ELSE baseline_correct END AS baseline_correct, single_correct FROM lab)"""


@query("crosswalk_join", with_(*BASE, SECOND) + f"""
SELECT a.setting, count(*) AS n, count(x.uid_b) AS n_matched,
  count(*) FILTER (WHERE concat('', a.problem_uid) IN (SELECT uid_b FROM second)) AS n_raw_matched,
  {rat('count(x.uid_b)', 'count(*)')} AS coverage
FROM lab a LEFT JOIN (SELECT * FROM second WHERE pk % 10 <> 0) x ON x.pk = a.pk GROUP BY a.setting""")
def crosswalk(spark, sf):
    a = b.labelled(spark, sf).select(F.col("problem_uid").alias("uid_a"), "setting", "baseline_correct")
    other = _second(spark, sf).select(F.concat(F.lit("b"), (F.col("pk") + 5).cast("string")).alias("uid_b"), F.col("single_correct"))
    xwalk = b.table(spark, sf, "part").where("p_partkey % 10 <> 0").select(
        F.col("p_partkey").cast("string").alias("example_id"), F.col("p_partkey").cast("string").alias("uid_a"),
        F.concat(F.lit("b"), (F.col("p_partkey") + 5).cast("string")).alias("uid_b"),
    )
    return joins.crosswalk_coverage(a, other, xwalk)


@query("crosswalk_rows", with_(*BASE, SECOND) + """
SELECT a.problem_uid AS uid_a, s.uid_b, a.baseline_correct AS a_correct, s.baseline_correct AS b_correct
FROM lab a JOIN second s ON s.pk = a.pk WHERE a.pk % 10 <> 0""")
def crosswalk_rows(spark, sf):
    a = b.labelled(spark, sf).select(F.col("problem_uid").alias("uid_a"), F.col("baseline_correct").alias("a_correct"))
    other = _second(spark, sf).select(F.concat(F.lit("b"), (F.col("pk") + 5).cast("string")).alias("uid_b"),
                                      F.col("baseline_correct").alias("b_correct"))
    xwalk = b.table(spark, sf, "part").where("p_partkey % 10 <> 0").select(
        F.col("p_partkey").cast("string").alias("uid_a"), F.concat(F.lit("b"), (F.col("p_partkey") + 5).cast("string")).alias("uid_b")
    )
    return joins.crosswalk_join(a, other, xwalk).select("uid_a", "uid_b", "a_correct", "b_correct")


KEY_SQL = "sha1(concat(problem, ' size ', CAST(p_size AS VARCHAR), ' ', source))"


@query("text_key", with_(*BASE) + f"SELECT problem_uid, {KEY_SQL} AS text_key FROM lab")
def text_key(spark, sf):
    from ..functions.text import text_key as key

    return b.labelled(spark, sf).select("problem_uid", key(_text()).alias("text_key"))


@query("reconcile_by_text", with_(*BASE, SECOND) + f""",
a AS (SELECT {KEY_SQL} AS text_key, problem_uid AS uid, baseline_correct AS bc, single_correct AS sc FROM lab),
z AS (SELECT {KEY_SQL} AS text_key, uid_b AS uid, baseline_correct AS bc, single_correct AS sc FROM second),
ga AS (SELECT text_key, count(*) AS n, min(uid) AS uid, list_sort(list(concat(CAST(bc AS VARCHAR), '|', CAST(sc AS VARCHAR)))) AS vals, min(bc) AS bc, min(sc) AS sc FROM a GROUP BY 1),
gb AS (SELECT text_key, count(*) AS n, min(uid) AS uid, list_sort(list(concat(CAST(bc AS VARCHAR), '|', CAST(sc AS VARCHAR)))) AS vals, min(bc) AS bc, min(sc) AS sc FROM z GROUP BY 1)
SELECT ga.text_key, CASE WHEN ga.n = 1 AND gb.n = 1 THEN CASE WHEN ga.vals = gb.vals THEN 'pair_agrees' ELSE 'pair_differs' END
    WHEN ga.vals = gb.vals THEN 'group_agrees' ELSE 'group_differs' END AS status, ga.n AS n_a, gb.n AS n_b,
  CASE WHEN ga.n = 1 THEN ga.uid END AS uid_a, CASE WHEN ga.n = 1 THEN gb.uid END AS uid_b,
  CASE WHEN ga.n = 1 THEN CAST(ga.bc AS VARCHAR) ELSE '-' END AS baseline_correct_a, CASE WHEN ga.n = 1 THEN CAST(gb.bc AS VARCHAR) ELSE '-' END AS baseline_correct_b,
  CASE WHEN ga.n = 1 THEN CAST(ga.sc AS VARCHAR) ELSE '-' END AS single_correct_a, CASE WHEN ga.n = 1 THEN CAST(gb.sc AS VARCHAR) ELSE '-' END AS single_correct_b
FROM ga JOIN gb ON ga.text_key = gb.text_key""")
def reconcile(spark, sf):
    left = b.labelled(spark, sf).withColumn("text", _text()).select("problem_uid", "text", "baseline_correct", "single_correct")
    right = _second(spark, sf).withColumn("text", _text()).select(
        F.concat(F.lit("b"), (F.col("pk") + 5).cast("string")).alias("problem_uid"), "text", "baseline_correct", "single_correct"
    )
    out = joins.reconcile(left, right, "text", "problem_uid", ["baseline_correct", "single_correct"])
    shown = [f"{c}_{s}" for c in ("baseline_correct", "single_correct") for s in ("a", "b")]
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in shown})


@query("unattributable_costs", with_(*BASE) + f"""
SELECT problem_uid, broadcast_tokens FROM (SELECT *, count(*) OVER (PARTITION BY {KEY_SQL}) AS c FROM lab) WHERE c = 1""")
def unattributable(spark, sf):
    from ..functions.text import text_key as key

    rows = b.labelled(spark, sf).select("problem_uid", "broadcast_tokens", _text().alias("text"))
    return joins.drop_ambiguous(rows, key("text")).select("problem_uid", "broadcast_tokens")


@query("table_diff", with_(*BASE, SECOND) + f""",
a AS (SELECT setting, {COVER.split(' AS baseline_pct')[0]} AS baseline_pct FROM lab GROUP BY setting),
z AS (SELECT setting, {COVER.split(' AS baseline_pct')[0]} AS baseline_pct FROM second GROUP BY setting)
SELECT a.setting, 'baseline_pct' AS "column", round(a.baseline_pct, 9) AS produced, round(z.baseline_pct, 9) AS reference
FROM a JOIN z ON a.setting = z.setting WHERE abs(a.baseline_pct - z.baseline_pct) > CAST(0.001 AS DOUBLE)""")
def table_diff(spark, sf):
    a = coverage_table(b.labelled(spark, sf))
    z = coverage_table(_second(spark, sf)).drop("oracle_pct")
    out = joins.table_diff(a, z, ["setting"], 0.001)
    return out.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in ("produced", "reference")})


@query("attach_ci", with_(*BASE) + """
SELECT setting, count(*) AS n, '[' || printf('%.1f', CAST(100 AS DOUBLE) * count(*) FILTER (WHERE baseline_correct) / count(*)) || ',' ||
  printf('%.1f', CAST(100 AS DOUBLE) * count(*) FILTER (WHERE broadcast_correct) / count(*)) || ']' AS ci FROM lab GROUP BY setting""")
def attach_ci(spark, sf):
    from ..functions.text import format_ci

    table = coverage_table(b.labelled(spark, sf))
    ci = table.select("setting", format_ci("baseline_pct", "broadcast_pct", 1).alias("ci"))
    return table.select("setting", "n").join(ci, "setting", "left")


@query("format_ci", with_(*BASE) + """
SELECT problem_uid, '[' || printf('%.2f', difficulty / 8) || ',' || printf('%.2f', difficulty) || ']' AS ci FROM lab""")
def format_ci_query(spark, sf):
    from ..functions.text import format_ci

    return b.labelled(spark, sf).select("problem_uid", format_ci(F.col("difficulty") / 8, "difficulty", 2).alias("ci"))
