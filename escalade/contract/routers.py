"""Learned routers.  What a solver predicts has no SQL twin; that it is at the optimum, and over which rows and features, has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import TEXT_METADATA
from ..operators.splits import SplitConfig, refit_rows, stratified_split
from ..plans import router as rt
from . import bindings as b
from .base import BASE, query, split_sql, with_
from .features import KNOWN_TERMS, LISTED, N_LABELS, N_SOURCES, N_TERMS, PLACES, _terms_sql


def _rows(spark, sf):
    keep = ["problem_uid", "setting", "oracle_label", *TEXT_METADATA.columns()]
    return stratified_split(b.labelled(spark, sf).select(*keep), SplitConfig.primary())


@query("logistic_router")
def logistic_router(spark, sf):
    rows = _rows(spark, sf)
    router = rt.text_metadata_router(class_weight=None).fit(refit_rows(rows))
    return router.predict(rows.where("split = 'test'")).select("problem_uid", "oracle_label", "predicted_label")


@query("select_on_dev")
def select_on_dev(spark, sf):
    # Held, as features and solver read them about ten times: the tables are joined and split once.
    rows = _rows(spark, sf).persist()
    try:
        best, log = rt.select_on_dev(rows.where("split = 'train'"), rows.where("split = 'dev'"), TEXT_METADATA)
    finally:
        rows.unpersist()
    table = [(r["class_weight"] or "none", r["C"], r["dev_macro_f1"], all(r[k] == best[k] for k in best)) for r in log]
    return spark.createDataFrame(table, "class_weight string, C double, dev_macro_f1 double, chosen boolean")


@query("fit_refit_evaluate")
def fit_refit_evaluate(spark, sf):
    *_, predictions = rt.fit_refit_evaluate(_rows(spark, sf), TEXT_METADATA)
    return predictions.select("problem_uid", "oracle_label", "predicted_label")


@query("router_report")
def router_report(spark, sf):
    rows = _rows(spark, sf)
    router = rt.text_metadata_router().fit(refit_rows(rows))
    return rt.router_report(router.predict(rows.where("split = 'test'")))


GRID_SQL = ", ".join(f"('{c['class_weight'] or 'none'}', CAST({c['C']} AS DOUBLE))" for c in rt.GRID)


@query("router_grid", with_(*BASE, split_sql(0.8, 0.1, 42), "fit AS (SELECT * FROM sp WHERE split = 'train')", PLACES, LISTED, _terms_sql("fit_terms", "fit"), KNOWN_TERMS) + f"""
SELECT class_weight, C, (SELECT count(*) FROM fit) AS n_train, (SELECT count(DISTINCT oracle_label) FROM fit) AS n_classes,
  {N_TERMS} + {N_SOURCES} + {N_LABELS} + 2 AS n_features, (SELECT count(*) FROM sp WHERE split = 'dev') AS n_dev, TRUE AS optimal
FROM (VALUES {GRID_SQL}) g(class_weight, C)""")
def router_grid(spark, sf):
    """The whole grid by one solver: rows, classes and features of the fit, dev rows told by each model, and whether its gradient vanishes."""
    rows = _rows(spark, sf)
    train, dev = rows.where("split = 'train'"), rows.where("split = 'dev'")
    featurizer, models = rt.fit_grid(train, TEXT_METADATA)
    told = models.predictions(rt.sparse_rows(featurizer.transform(dev), F.lit(0), "oracle_label"), "oracle_label").groupBy("place").agg(F.sum("n").alias("n_dev"))
    _, width, classes = models.coefficients.shape
    fitted = [(i, c["class_weight"] or "none", c["C"], classes, width - 1, models.gradients[i] < 1e-6) for i, c in enumerate(rt.GRID)]
    table = spark.createDataFrame(fitted, "place int, class_weight string, C double, n_classes bigint, n_features bigint, optimal boolean")
    n_train = train.agg(F.count("*")).scalar()
    return table.join(told, "place").withColumn("n_train", n_train).drop("place")
