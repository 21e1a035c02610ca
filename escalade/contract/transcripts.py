"""Transcript jobs over texts built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import AGREE, EXECUTOR_MARKERS, PASSING_TAGS, PLACEHOLDERS, ROUTE_NAMES, SUBMISSION_PHRASE, TAGS, boxed, final_answer
from ..operators import runlog, transcripts as tr
from . import bindings as b
from .base import cnt, query, rat, with_

K = "CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT)"


def _events(spark, sf):
    return b.table(spark, sf, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1)).withColumn(
        "setting", F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string"))
    )


def _by_kind(kind, texts):
    out = F.when(kind == 0, texts[0])
    for i, t in enumerate(texts[1:-1], start=1):
        out = out.when(kind == i, t)
    return out.otherwise(texts[-1])


def _cat(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


# Pieces of a text are either plain strings or the marker None for the number k.
SOLVER = (
    ("So the value is \\boxed{", None, "}."),
    ("First \\boxed{1} then \\boxed{", None, "} end"),
    ("Fraction \\boxed{\\frac{1}{", None, "}} done"),
    ("Earlier \\boxed{", None, "} and cut \\boxed{12"),
    ("The answer is ", None, "."),
    ("Empty \\boxed{} ", None),
    ("Line one\n\nLine two \\boxed{ ", None, " }"),
)
JUDGE = (
    ("Correctness: 1\nResponse: fine ", None),
    ("Correctness: 0\nResponse: wrong unit ", None),
    ("Correctness: 2\nResponse: odd ", None),
    ("Verdict: PASS\nResponse: none ", None),
    ("Verdict: FAIL\n1. Correctness:   10\n\nResponse: long\ntext ", None),
    ("Correctness: 1 ", None),
)


def texts_spark(kind, pieces):
    return _by_kind(kind, [_cat(*[F.col("k") if p is None else p for p in one]) for one in pieces])


def texts_sql(kind: str, pieces) -> str:
    def quote(p):
        return "'" + p.replace("'", "''") + "'"

    arms = []
    for i, one in enumerate(pieces):
        arms.append(f"WHEN {i} THEN concat({', '.join('CAST(k AS VARCHAR)' if p is None else quote(p) for p in one)})")
    return f"CASE {kind} {' '.join(arms)} END"


EV = f"ev AS (SELECT *, {K} AS k, concat('s', CAST(user_id % 4 AS VARCHAR)) AS setting FROM events)"
SOLVED = f"""sv AS (SELECT *, {texts_sql('event_id % 7', SOLVER)} AS solver_text, {texts_sql('(event_id // 7) % 6', JUDGE)} AS judge_text FROM ev),
bx AS (SELECT *, coalesce(regexp_extract_all(solver_text, '\\\\boxed\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}', 1)[-1], '') AS rawbox FROM sv),
sc AS (SELECT *, trim(rawbox) AS box, CASE WHEN regexp_matches(judge_text, 'Response:\\s*.+') THEN regexp_extract(judge_text, 'Correctness:\\s*(\\d)', 1) ELSE '' END AS digit FROM bx)"""


def _responses(spark, sf):
    e = F.col("event_id")
    ev = _events(spark, sf)
    return ev.withColumn("solver_text", texts_spark(e % 7, SOLVER)).withColumn(
        "judge_text", texts_spark(F.floor(e / 7) % 6, JUDGE)
    ).withColumn("protocol", F.col("event_type"))


@query("score_transcripts", with_(EV, SOLVED) + f"""
SELECT setting, event_type AS protocol, count(*) AS n, {cnt("box <> ''")} AS n_boxed, {cnt("box = ''")} AS n_format_fail,
  {cnt("box <> '' AND digit NOT IN ('0', '1')")} AS n_unparseable, {cnt("box <> '' AND digit = '1'")} AS n_passed,
  {rat(cnt("box <> '' AND digit = '1'"), 'count(*)')} AS pass_rate, {cnt("box <> ''")} AS judge_calls FROM sc GROUP BY 1, 2""")
def score_transcripts(spark, sf):
    return tr.score_transcripts(_responses(spark, sf))


@query("boxed_answers", with_(EV, SOLVED) + """
SELECT event_id, box AS boxed_answer, CASE WHEN box <> '' THEN box
  ELSE regexp_replace(trim(string_split(solver_text, chr(10))[-1]), '\\.+$', '') END AS final_answer FROM sc""")
def boxed_answers(spark, sf):
    return _responses(spark, sf).select("event_id", boxed("solver_text").alias("boxed_answer"),
                                        final_answer("solver_text").alias("final_answer"))


@query("run_summary", with_(EV, SOLVED) + f"""
SELECT event_type AS protocol, count(*) AS n_problems, {cnt("box <> '' AND digit = '1'")} AS n_passed,
  {rat(cnt("box <> '' AND digit = '1'"), 'count(*)')} AS accuracy, {cnt("box = ''")} AS n_direct_protocol_fail,
  {cnt("box <> '' AND digit NOT IN ('0', '1')")} AS n_judge_unparseable FROM sc GROUP BY 1""")
def run_summary(spark, sf):
    return runlog.run_summary(tr.scored_responses(_responses(spark, sf)), ["protocol"])


# --- reviews ----------------------------------------------------------------

REVIEW_TAILS = (
    "[Agree]", "[Route: Planner]", "[route:executor]", "[Route:Evaluator]", "no tag at all",
    "[Agree] but later [Route:Planner]", "[Agree]\nFinal Answer For Evaluator: \\boxed{7}", "bad [Route:Nobody]",
)
# A tilde stands for the line break inside a tail.
TAILS_SQL = "[" + ", ".join("'" + t.replace("\n", "~") + "'" for t in REVIEW_TAILS) + "]"
MARKER_SQL = " OR ".join(f"contains(both_, '{w}')" for w in EXECUTOR_MARKERS)
ROUTES_SQL = f"'(?i)\\[({AGREE}|Route:\\s*(?:{'|'.join(ROUTE_NAMES)}))\\]'"
REVIEWS = f"""rv AS (
  SELECT concat('s', CAST(conv_id % 3 AS VARCHAR)) AS setting, conv_id, turn, turn % 3 = 2 AS eval_failed,
    CASE WHEN turn % 2 = 0 THEN 'check the unit' ELSE 'think again' END AS advice,
    concat(text, chr(10), ({TAILS_SQL})[(conv_id + turn) % 8 + 1]) AS review_text FROM conversations),
rt AS (SELECT *, lower(concat(advice, chr(10), replace(review_text, '~', chr(10)))) AS both_,
    lower(coalesce(regexp_extract_all(review_text, {ROUTES_SQL}, 1)[-1], '')) AS tag FROM rv),
rr AS (SELECT *, CASE WHEN tag LIKE '%planner' THEN 'planner' WHEN tag LIKE '%executor' THEN 'executor'
    WHEN eval_failed THEN CASE WHEN {MARKER_SQL} THEN 'executor' ELSE 'planner' END
    WHEN tag = 'agree' THEN 'agree' WHEN tag LIKE '%evaluat%' THEN 'evaluate' ELSE 'executor' END AS route FROM rt)"""


def _reviews(spark, sf):
    tail = F.get(F.array(*[F.lit(t) for t in REVIEW_TAILS]), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    return b.table(spark, sf, "conversations").select(
        F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")).alias("setting"), F.col("conv_id").alias("problem_id"),
        F.col("turn").alias("round"), (F.col("turn") % 3 == 2).alias("eval_failed"),
        F.when(F.col("turn") % 2 == 0, "check the unit").otherwise("think again").alias("advice"),
        F.concat("text", F.lit("\n"), tail).alias("review_text"),
    )


@query("route_flow", with_(REVIEWS) + """
SELECT a.setting, a.turn AS round, a.route, z.route AS next_route, count(*) AS n,
  count(*) FILTER (WHERE contains(a.review_text, 'Final Answer For Evaluator')) AS n_submitted
FROM rr a LEFT JOIN rr z ON z.conv_id = a.conv_id AND z.turn = a.turn + 1 GROUP BY 1, 2, 3, 4""")
def route_flow(spark, sf):
    return tr.route_flow(_reviews(spark, sf))


# --- polls and votes --------------------------------------------------------

POLL_TEXT = (
    ('{"score": ', None, ', "reason": "because", "intent": "check", "candidate_answer": "\\\\boxed{', None, '}"}'),
    ('Sure:\n```json\n{"score": ', None, ', "reason": "r", "intent": "say \\\\boxed{', None, '}"}\n```\nthanks'),
    ('My poll {"score": ', None, ', "intent": "see \\\\boxed{3}"} as asked'),
    ("score: ", None, ", candidate answer: \\boxed{9}"),
    ('{"score": "', None, '", "intent": "none"}'),
    ('{"intent": "', None, '", "reason": null}'),
    ("```json\n{}\n``` score: ", None),
)
POLLS_SQL = f"""pt AS (SELECT *, {texts_sql('event_id % 7', POLL_TEXT)} AS t FROM ev),
pj AS (SELECT *, CASE WHEN contains(t, '{{}}') THEN NULL WHEN json_valid(t) THEN t WHEN contains(t, '```') THEN trim(regexp_extract(t, '(?s)```json\\s*(.+?)```', 1), chr(10))
    WHEN contains(t, '{{"') THEN regexp_extract(t, '(\\{{.*\\}})', 1) END AS body FROM pt),
pp AS (SELECT *, greatest(1, least(100, coalesce(CASE WHEN body IS NOT NULL AND json_extract_string(body, '$.score') IS NOT NULL
      THEN TRY_CAST(json_extract_string(body, '$.score') AS INTEGER)
      ELSE TRY_CAST(nullif(regexp_extract(t, '(?i)"?score"?\\s*[:=]\\s*(-?\\d+)', 1), '') AS INTEGER) END, 1))) AS score,
    coalesce(json_extract_string(body, '$.reason'), '') AS reason,
    CASE WHEN body IS NULL THEN t ELSE coalesce(json_extract_string(body, '$.intent'), '') END AS intent,
    regexp_extract(coalesce(json_extract_string(body, '$.candidate_answer'), ''), '(\\\\boxed\\{{[^{{}}]+\\}})', 1) AS named FROM pj),
pl AS (SELECT *, CASE WHEN named <> '' THEN named ELSE regexp_extract(CASE WHEN intent <> '' THEN intent ELSE t END, '(\\\\boxed\\{{[^{{}}]+\\}})', 1) END AS candidate FROM pp)"""


def _poll_texts(spark, sf):
    return _events(spark, sf).withColumn("text", texts_spark(F.col("event_id") % 7, POLL_TEXT))


@query("poll_rounds", with_(EV, POLLS_SQL) + f"""
SELECT setting, count(*) AS n, count(body) AS n_parsed, {rat('count(body)', 'count(*)')} AS parse_rate,
  {cnt("candidate <> ''")} AS n_candidates, CAST(sum(score) AS BIGINT) AS sum_score FROM pl GROUP BY setting""")
def poll_rounds(spark, sf):
    return tr.poll_rounds(_poll_texts(spark, sf))


@query("parse_polls", with_(EV, POLLS_SQL) + "SELECT event_id, score, reason, intent, candidate, body IS NOT NULL AS parse_ok FROM pl")
def parse_polls(spark, sf):
    return tr.parse_polls(_poll_texts(spark, sf)).select("event_id", "score", "reason", "intent", "candidate", "parse_ok")


VOTE_TEXT = (
    ('{"approve": true, "feedback": "good ', None, '", "revised_answer": ""}'),
    ('{"approve": "no", "feedback": "bad", "revised_answer": "\\\\boxed{', None, '}"}'),
    ('{"approve": "Approved", "feedback": ""}'),
    ("approve = yes; revised answer: \\boxed{", None, "}"),
    ("I reject ", None),
    ('{"approve": 0, "revised_answer": "no box ', None, '"}'),
    ("```json\n{}\n```\napprove: yes ", None),
)
VOTES_SQL = f"""vt AS (SELECT *, {texts_sql('event_id % 7', VOTE_TEXT)} AS t FROM ev),
vj AS (SELECT *, CASE WHEN json_valid(t) AND NOT contains(t, '{{}}') THEN t END AS body FROM vt),
vp AS (SELECT *, CASE WHEN body IS NULL THEN lower(regexp_extract(t, '(?i)"?approve"?\\s*[:=]\\s*(true|false|yes|no)', 1)) IN ('true', 'yes')
      ELSE coalesce(lower(json_extract_string(body, '$.approve')), '') IN {tr.YES} END AS approve,
    regexp_extract(CASE WHEN body IS NULL THEN CASE WHEN contains(t, 'revised answer') THEN t ELSE '' END ELSE coalesce(json_extract_string(body, '$.revised_answer'), '') END,
      '(\\\\boxed\\{{[^{{}}]+\\}})', 1) AS revised FROM vj)"""


@query("approval_rounds", with_(EV, VOTES_SQL) + f"""
SELECT setting, event_id % 3 AS approval_round, count(*) AS n_votes, {cnt('approve')} AS n_approve, {cnt("revised <> ''")} AS n_revised,
  count(body) AS n_parsed, {rat('count(body)', 'count(*)')} AS parse_rate FROM vp GROUP BY 1, 2""")
def approval_rounds(spark, sf):
    rows = _events(spark, sf).withColumn("text", texts_spark(F.col("event_id") % 7, VOTE_TEXT)).withColumn(
        "approval_round", F.col("event_id") % 3
    )
    return tr.approval_rounds(rows)


# --- notes ------------------------------------------------------------------

NOTE_TAILS = ("", "\nFinal Answer For Evaluator: \\boxed{5}\n[Agree] ok", " [Route:Planner] go", "\nFinal Answer For Evaluator: all of this")
NOTE_SQL = "(['', '~Final Answer For Evaluator: \\boxed{5}~[Agree] ok', ' [Route:Planner] go', '~Final Answer For Evaluator: all of this'])[(conv_id + turn) % 4 + 1]"
SQUEEZE = r"trim(regexp_replace({0}, '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g'))"
PHRASE_SQL = f"instr(lower(x.kept), '{SUBMISSION_PHRASE.lower()}:')"
# The walk over the lines as a fold: state 0 outside a submission, 1 in one that has been blank so far, 2 in one.
PASSES_SQL = f"starts_with(x.kept, '[') AND contains(x.kept, ']') AND lower(split_part(x.kept[2:], ']', 1)) IN {PASSING_TAGS}"
STATE_SQL = f"(CASE WHEN a.state = 2 AND {PASSES_SQL} THEN 0 ELSE a.state END)"
LINES_SQL = f"""list_reduce(list_prepend({{'kept': '', 'state': 0}}, list_transform(string_split(trim(content), chr(10)), lambda x: {{'kept': x, 'state': 0}})), lambda a, x: {{
    'kept': CASE WHEN {STATE_SQL} > 0 THEN a.kept WHEN {PHRASE_SQL} > 0 THEN concat(a.kept, chr(10), x.kept[:{PHRASE_SQL} - 1]) ELSE concat(a.kept, chr(10), x.kept) END,
    'state': CASE WHEN {STATE_SQL} = 0 AND {PHRASE_SQL} = 0 THEN 0
      WHEN {STATE_SQL} < 2 AND trim(CASE WHEN {STATE_SQL} = 0 THEN x.kept[{PHRASE_SQL} + {len(SUBMISSION_PHRASE) + 1}:] ELSE x.kept END) = '' THEN 1 ELSE 2 END}}).kept"""
UNTAGGED_SQL = f"""array_to_string(list_transform(string_split(left_over, '['), lambda p, i: CASE WHEN i = 1 THEN p
  WHEN contains(p, ']') AND split_part(p, ']', 1) IN {TAGS} THEN p[length(split_part(p, ']', 1)) + 2:] ELSE concat('[', p) END), '')"""
NOTES = rf"""nt AS (SELECT conv_id, turn, replace(concat(CASE WHEN turn % 4 = 3 THEN 'n/a' ELSE text END, {NOTE_SQL}), '~', chr(10)) AS content FROM conversations),
nl AS (SELECT *, {LINES_SQL} AS left_over FROM nt),
nc AS (SELECT *, {SQUEEZE.format(UNTAGGED_SQL)} AS clean,
  {SQUEEZE.format("content")} AS plain FROM nl)"""


@query("trail_text", (with_(NOTES) + """
SELECT conv_id, turn, CASE WHEN length(clean) <= 80 THEN clean ELSE concat(rtrim(substr(clean, 1, 77)), '...') END AS note,
  length(plain) >= 3 AND lower(plain) NOT IN PLACEHOLDER_LIST AS meaningful,
  CASE WHEN contains(content, '\\boxed{5}') THEN '\\boxed{5}' WHEN clean = '' THEN '[No candidate answer]'
    WHEN length(clean) <= 240 THEN clean ELSE concat(rtrim(substr(clean, 1, 237)), '...') END AS candidate FROM nc""").replace("PLACEHOLDER_LIST", str(PLACEHOLDERS)))
def trail_text(spark, sf):
    tail = F.get(F.array(*[F.lit(t) for t in NOTE_TAILS]), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    base = F.when(F.col("turn") % 4 == 3, F.lit("n/a")).otherwise(F.col("text"))
    rows = b.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(base, tail).alias("content"))
    return tr.trail_text(rows, max_chars=80).select("conv_id", "turn", "note", "meaningful", "candidate")


# --- raw responses ----------------------------------------------------------

BODY = (
    ('{"choices": [{"finish_reason": "stop", "message": {"content": " answer ', None, ' "}}], "usage": {"prompt_tokens": ', None, ', "completion_tokens": 7, "total_tokens": 99}}'),
    ('{"choices": [{"message": {"content": "", "reasoning_content": "thought ', None, '"}}], "usage": {"prompt_tokens": ', None, ', "completion_tokens": 3}}'),
    ('{"choices": [{"message": {"content": null, "reasoning": {"text": "deep ', None, '"}}}], "usage": {"prompt_tokens": ', None, '}}'),
    ('{"choices": [{"finish_reason": "length", "message": {"content": "  ", "output_text": "out ', None, '"}}]}'),
    ('{"choices": [], "usage": {"completion_tokens": ', None, '}}'),
    ("upstream timeout ", None),
)
BODY_SQL = f"""rb AS (SELECT *, {texts_sql('event_id % 6', BODY)} AS body FROM ev),
rp AS (SELECT *, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS j FROM rb),
ru AS (SELECT *, event_id % 6 < 4 AS has_text, coalesce(CAST(json_extract_string(j, '$.usage.prompt_tokens') AS BIGINT), 0) AS pt,
  coalesce(CAST(json_extract_string(j, '$.usage.completion_tokens') AS BIGINT), 0) AS ct,
  coalesce(CAST(json_extract_string(j, '$.usage.total_tokens') AS BIGINT), 0) AS tt FROM rp)"""


@query("response_usage", with_(EV, BODY_SQL) + f"""
SELECT event_type AS role, count(*) AS calls, {cnt('has_text')} AS n_with_text, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(ct) AS BIGINT) AS completion_tokens,
  CAST(sum(CASE WHEN tt = 0 THEN pt + ct ELSE tt END) AS BIGINT) AS total_tokens, CAST(sum(greatest(1, event_id % 4)) AS BIGINT) AS http_attempts,
  {cnt('event_id % 6 = 5')} AS failed_calls FROM ru GROUP BY 1""")
def response_usage(spark, sf):
    rows = _events(spark, sf).select(
        F.col("event_type").alias("role"), texts_spark(F.col("event_id") % 6, BODY).alias("body"),
        (F.col("event_id") % 4).alias("attempts"), F.when(F.col("event_id") % 6 == 5, "timeout").alias("error"),
    )
    return tr.response_usage(rows)
