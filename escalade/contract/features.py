"""Text terms, vocabulary, weights, scaled numbers, feature vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.text import add_bigrams, parse_json_list, words
from ..operators import features as ft
from ..operators.leakage import is_forbidden
from ..operators.splits import SplitConfig, refit_rows, stratified_split
from ..session import written
from . import bindings as b
from .base import BASE, query, rounded, split_sql, with_

WORDS = r"""wd AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS ws FROM %s),
tm AS (SELECT doc_id, ws, list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) AS terms FROM wd)"""
DOCS = WORDS % "documents"
TRAIN = WORDS % "(SELECT documents.* FROM documents JOIN labels ON labels.doc_id = documents.doc_id)"


@query("tokens_ngrams", with_(DOCS) + "SELECT doc_id, len(ws) AS n_words, len(terms) AS n_terms, md5(array_to_string(terms, '|')) AS digest FROM tm")
def tokens(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text").select("doc_id", words("text").alias("ws")).withColumn("terms", add_bigrams("ws"))
    return docs.select("doc_id", F.size("ws").cast("bigint").alias("n_words"), F.size("terms").cast("bigint").alias("n_terms"),
                       F.md5(F.array_join("terms", "|").cast("binary")).alias("digest"))


def _train(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    return docs.join(b.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


def _counts(spark, sf):
    return ft.term_counts(ft.with_terms(_train(spark, sf), "text"), "doc_id")


COUNTS = "tc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tm) GROUP BY 1, 2)"
VOCAB = """vc AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n_total, count(*) AS df FROM tc GROUP BY term HAVING count(*) >= 2
  ORDER BY n_total DESC, term LIMIT 20000)"""


@query("vocabulary", with_(TRAIN, COUNTS, VOCAB) + "SELECT * FROM vc")
def vocabulary(spark, sf):
    return ft.vocabulary(_counts(spark, sf))


@query("tfidf", with_(TRAIN, COUNTS, VOCAB) + """, x AS (
  SELECT tc.doc_id, tc.term, tf * (ln(CAST(1 + (SELECT count(*) FROM wd) AS DOUBLE) / (1 + df)) + 1) AS raw FROM tc JOIN vc ON vc.term = tc.term),
nm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM x GROUP BY doc_id),
w AS (SELECT x.doc_id, term, raw / norm AS weight FROM x JOIN nm ON nm.doc_id = x.doc_id)
SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS sum_weight, round(max(weight), 6) AS max_weight,
  md5(string_agg(term, '|' ORDER BY term)) AS digest FROM w GROUP BY doc_id""")
def tfidf(spark, sf):
    counts = written(_counts(spark, sf), "term-counts")  # read twice: for the vocabulary and for the weights
    n_docs = _train(spark, sf).select("doc_id").count()
    return _digest(ft.tfidf(counts, ft.vocabulary(counts), n_docs, "doc_id"))


def _digest(weights):
    out = weights.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"), F.sum("weight").alias("sum_weight"), F.max("weight").alias("max_weight"),
        F.md5(F.array_join(F.array_sort(F.collect_list("term")), "|").cast("binary")).alias("digest"),
    )
    return rounded(out, "sum_weight", "max_weight", digits=6)


OTHERS = """ow AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS ws
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
om AS (SELECT doc_id, list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) AS terms FROM ow),
oc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM om) GROUP BY 1, 2)"""


@query("tfidf_unseen", with_(TRAIN, COUNTS, VOCAB, OTHERS) + """, x AS (
  SELECT oc.doc_id, oc.term, tf * (ln(CAST(1 + (SELECT count(*) FROM wd) AS DOUBLE) / (1 + df)) + 1) AS raw FROM oc JOIN vc ON vc.term = oc.term),
nm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM x GROUP BY doc_id),
w AS (SELECT x.doc_id, term, raw / norm AS weight FROM x JOIN nm ON nm.doc_id = x.doc_id)
SELECT doc_id, count(*) AS n_terms, round(sum(weight), 6) AS sum_weight, round(max(weight), 6) AS max_weight,
  md5(string_agg(term, '|' ORDER BY term)) AS digest FROM w GROUP BY doc_id""")
def tfidf_unseen(spark, sf):
    """Weights of documents outside the fitting rows, by the vocabulary of those rows."""
    docs, fitted = b.table(spark, sf, "documents").select("doc_id", "text"), b.table(spark, sf, "labels").select("doc_id")
    others = ft.term_counts(ft.with_terms(docs.join(fitted, "doc_id", "left_anti"), "text"), "doc_id")
    return _digest(ft.tfidf(others, ft.vocabulary(_counts(spark, sf)), _train(spark, sf).select("doc_id").count(), "doc_id"))


@query("scale_numeric", with_(*BASE) + """
SELECT problem_uid, round(difficulty / (SELECT stddev_pop(difficulty) FROM lab), 9) AS difficulty_scaled,
  round(difficulty_tier / (SELECT stddev_pop(difficulty_tier) FROM lab), 9) AS difficulty_tier_scaled FROM lab""")
def scale_numeric(spark, sf):
    m = b.labelled(spark, sf).select("problem_uid", "difficulty", "difficulty_tier")
    scales = ft.numeric_scales(m, ["difficulty", "difficulty_tier"])
    out = ft.scale_numeric(m, scales).select("problem_uid", "difficulty_scaled", "difficulty_tier_scaled")
    return rounded(out, "difficulty_scaled", "difficulty_tier_scaled")


LIST_SQL = """CASE p_partkey % 6 WHEN 0 THEN concat('["', p_type, '", "', p_brand, '"]') WHEN 1 THEN concat('"', p_type, '"')
  WHEN 2 THEN concat('[''', p_type, ''']') WHEN 3 THEN '' WHEN 4 THEN CAST(p_size AS VARCHAR) ELSE p_name END"""


def _lists():
    kind = F.col("p_partkey") % 6
    return (
        F.when(kind == 0, F.concat(F.lit('["'), "p_type", F.lit('", "'), "p_brand", F.lit('"]')))
        .when(kind == 1, F.concat(F.lit('"'), "p_type", F.lit('"')))
        .when(kind == 2, F.concat(F.lit("['"), "p_type", F.lit("']")))
        .when(kind == 3, "").when(kind == 4, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    )


@query("parse_json_list", f"""SELECT p_partkey, CASE WHEN raw = '' THEN '' WHEN json_valid(raw) AND json_type(raw) = 'ARRAY'
  THEN array_to_string(CAST(from_json(CASE WHEN json_valid(raw) THEN raw ELSE '[]' END, '["VARCHAR"]') AS VARCHAR[]), '|')
  WHEN json_valid(raw) THEN json_extract_string(raw, '$') ELSE raw END AS labels FROM (SELECT p_partkey, {LIST_SQL} AS raw FROM part)""")
def json_list(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", F.array_join(parse_json_list(_lists()), "|").alias("labels"))


@query("project_features", with_(*BASE) + """SELECT problem, source, concat('["', lower(setting), '", "', problem, '"]') AS domain,
  difficulty, difficulty_tier FROM lab""")
def project(spark, sf):
    return ft.feature_frame(b.labelled(spark, sf), ft.TEXT_METADATA)


@query("forbidden_columns", with_(*BASE) + """
SELECT c AS "column", n FROM (SELECT unnest(['baseline_correct', 'single_correct', 'per_correct', 'broadcast_correct', 'oracle_label',
  'x_final_passed', 'router_score', 'Gold_Answer', 'is_wrong', 'oracle', 'first_success_protocol', ' Verdict ']) AS c, (SELECT count(*) FROM lab) AS n)""")
def forbidden_columns(spark, sf):
    """The guard's verdict on a labelled table: cells that may not become features."""
    # One name of every family beside the table's own, and three that only look like one.
    offered = ["x_final_passed", "router_score", "Gold_Answer", "is_wrong", "oracle", "first_success_protocol", " Verdict ", "goldfish", "scored", "is_correctly"]
    m = b.labelled(spark, sf).withColumns({c: F.lit(1) for c in offered})
    bad = [c for c in m.columns if is_forbidden(c)]
    counts = m.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in bad])
    return counts.unpivot([], [F.col(f"`{c}`") for c in bad], "column", "n")


def _featurized(spark, sf, spec):
    rows = stratified_split(b.labelled(spark, sf), SplitConfig.primary())
    model = ft.Featurizer(spec).fit(refit_rows(rows))
    return model.transform(rows.where("split = 'test'"))


def _vector(df):
    """The width, and the places and values of all entries that are not 0."""
    values = vector_to_array("features")
    spelled = F.transform(values, lambda v, i: F.when(v != 0, F.concat(i.cast("string"), F.lit(":"), F.format_string("%.6f", v))))
    return df.select("problem_uid", F.size(values).alias("width"), F.array_join(F.array_compact(spelled), " ").alias("entries"))


FIT = (*BASE, split_sql(0.8, 0.1, 42), "fit AS (SELECT * FROM sp WHERE split IN ('train', 'dev'))", "test AS (SELECT * FROM sp WHERE split = 'test')")
# Sources in alphabetic order; labels by how many rows have them, ties by name.
PLACES = """src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS pos FROM (SELECT DISTINCT source FROM fit))"""


@query("one_hot", with_(*FIT, PLACES) + """
SELECT problem_uid, CAST((SELECT count(*) FROM src) AS INTEGER) AS width,
  coalesce(CAST(pos AS VARCHAR) || ':1.000000', '') AS entries FROM test LEFT JOIN src ON src.source = test.source""")
def one_hot(spark, sf):
    return _vector(_featurized(spark, sf, ft.FeatureSpec(text=None, multilabel=(), numeric=())))


LISTED = """fl AS (SELECT problem_uid, unnest([lower(setting), problem]) AS lab FROM fit),
known AS (SELECT lab, row_number() OVER (ORDER BY count(DISTINCT problem_uid) DESC, lab) - 1 AS pos FROM fl GROUP BY lab)"""


@query("multi_hot", with_(*FIT, LISTED) + """, tl AS (SELECT DISTINCT problem_uid, unnest([lower(setting), problem]) AS lab FROM test)
SELECT test.problem_uid, CAST((SELECT count(*) FROM known) AS INTEGER) AS width,
  coalesce(string_agg(CAST(pos AS VARCHAR) || ':1.000000', ' ' ORDER BY pos), '') AS entries
FROM test JOIN tl ON tl.problem_uid = test.problem_uid LEFT JOIN known ON known.lab = tl.lab GROUP BY test.problem_uid""")
def multi_hot(spark, sf):
    return _vector(_featurized(spark, sf, ft.FeatureSpec(text=None, categorical=(), numeric=())))


def _terms_sql(out: str, source: str) -> str:
    """Counts of the terms of a problem's text."""
    return rf"""{out}_w AS (SELECT problem_uid, regexp_extract_all(strip_accents(lower(problem)), '[\p{{L}}\p{{N}}_]{{2,}}') AS ws FROM {source}),
{out}_m AS (SELECT problem_uid, list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1]))) AS terms FROM {out}_w),
{out} AS (SELECT problem_uid, term, count(*) AS tf FROM (SELECT problem_uid, unnest(terms) AS term FROM {out}_m) GROUP BY 1, 2)"""


KNOWN_TERMS = """known_terms AS (SELECT term, df, row_number() OVER (ORDER BY n_total DESC, term) - 1 AS pos FROM (
  SELECT term, sum(tf) AS n_total, count(*) AS df FROM fit_terms GROUP BY term HAVING count(*) >= 2 ORDER BY n_total DESC, term LIMIT 20000))"""
N_TERMS, N_SOURCES, N_LABELS = "(SELECT count(*) FROM known_terms)", "(SELECT count(*) FROM src)", "(SELECT count(*) FROM known)"


@query("assemble", with_(*FIT, PLACES, LISTED, _terms_sql("fit_terms", "fit"), _terms_sql("test_terms", "test")) + f""",
tl AS (SELECT DISTINCT problem_uid, unnest([lower(setting), problem]) AS lab FROM test),
{KNOWN_TERMS}, x AS (SELECT problem_uid, pos, tf * (ln(CAST(1 + (SELECT count(*) FROM fit) AS DOUBLE) / (1 + df)) + 1) AS raw
  FROM test_terms JOIN known_terms ON known_terms.term = test_terms.term),
nm AS (SELECT problem_uid, sqrt(sum(raw * raw)) AS norm FROM x GROUP BY problem_uid),
e AS (
  SELECT x.problem_uid, pos, printf('%.6f', raw / norm) AS v FROM x JOIN nm ON nm.problem_uid = x.problem_uid
  UNION ALL SELECT problem_uid, {N_TERMS} + pos, '1.000000' FROM test JOIN src ON src.source = test.source
  UNION ALL SELECT problem_uid, {N_TERMS} + {N_SOURCES} + pos, '1.000000' FROM tl JOIN known ON known.lab = tl.lab
  UNION ALL SELECT problem_uid, {N_TERMS} + {N_SOURCES} + {N_LABELS}, printf('%.6f', difficulty / (SELECT stddev_pop(difficulty) FROM fit)) FROM test
  UNION ALL SELECT problem_uid, {N_TERMS} + {N_SOURCES} + {N_LABELS} + 1, printf('%.6f', difficulty_tier / (SELECT stddev_pop(difficulty_tier) FROM fit)) FROM test)
SELECT problem_uid, CAST({N_TERMS} + {N_SOURCES} + {N_LABELS} + 2 AS INTEGER) AS width,
  string_agg(CAST(pos AS VARCHAR) || ':' || v, ' ' ORDER BY pos) AS entries FROM e GROUP BY problem_uid""")
def assemble(spark, sf):
    """All kinds of features: places and weights of terms, categories, labels and numbers."""
    return _vector(_featurized(spark, sf, ft.TEXT_METADATA))
