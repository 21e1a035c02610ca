"""Router features: declared columns, text terms, categories, scaled numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    OneHotEncoder,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import add_bigrams, parse_json_list, term_frequencies, words
from .leakage import assert_no_leakage


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns become which kind of feature; forbidden names fail here."""

    text: str | None = "problem"
    categorical: tuple[str, ...] = ("source",)
    multilabel: tuple[str, ...] = ("domain",)
    numeric: tuple[str, ...] = ("difficulty", "difficulty_tier")
    min_df: int = 2
    max_features: int = 20000

    def __post_init__(self):
        assert_no_leakage(self.columns(), "feature spec")

    def columns(self) -> list[str]:
        return [c for c in (self.text,) if c] + [*self.categorical, *self.multilabel, *self.numeric]


TEXT_METADATA = FeatureSpec()
METADATA_ONLY = FeatureSpec(text=None)


def feature_frame(df: DataFrame, spec: FeatureSpec, keep=()) -> DataFrame:
    """Exactly the declared columns (and the row keys in ``keep``)."""
    missing = [c for c in spec.columns() if c not in df.columns]
    if missing:
        raise KeyError(f"feature columns absent from the input: {missing}")
    assert_no_leakage(spec.columns(), "feature frame")
    return df.select(*keep, *spec.columns())


# --- text -------------------------------------------------------------------


def with_terms(df: DataFrame, text: str, out: str = "terms") -> DataFrame:
    """Words and adjacent pairs of a text column."""
    return df.withColumn("_words", words(text)).withColumn(out, add_bigrams("_words")).drop("_words")


def term_counts(df: DataFrame, key: str, terms: str = "terms") -> DataFrame:
    """``(key, term, tf)`` of a table with one row per document.

    A document is one row, so its terms are counted in place; nothing is
    shuffled.
    """
    return df.select(key, F.explode(term_frequencies(terms)).alias("t")).select(key, "t.term", "t.tf")


def vocabulary(counts: DataFrame, min_df: int = 2, max_features: int = 20000) -> DataFrame:
    """``(term, n_total, df)`` of terms in ``min_df`` documents, most frequent first, ties by term.

    A top-k over the term table; the result has at most ``max_features`` rows.
    """
    totals = counts.groupBy("term").agg(F.sum("tf").alias("n_total"), F.count("*").alias("df")).where(F.col("df") >= min_df)
    return totals.orderBy(F.desc("n_total"), "term").limit(max_features)


def tfidf(counts: DataFrame, vocab: DataFrame, n_docs: int, key: str) -> DataFrame:
    """``(key, term, weight)``: tf x (ln((1+n)/(1+df)) + 1), scaled to unit length per document.

    Every term of the given vocabulary counts, whatever its size; ``counts`` may
    be of other documents than those that the vocabulary was made from.  The norm
    is a window over one document, whose rows the vocabulary bounds.
    """
    idf = F.log(F.lit(float(1 + n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    side = vocab.select("term", idf.alias("idf"))
    raw = counts.join(side, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))


# --- numbers ----------------------------------------------------------------


def _number(col: str):
    """Numeric value with blanks and text as 0."""
    n = F.col(col).try_cast("double")
    return F.coalesce(F.when(~F.isnan(n), n), F.lit(0.0))


def numeric_scales(df: DataFrame, cols) -> dict[str, float]:
    """Population standard deviation per column, 1 where it is 0; one row to the driver."""
    row = df.agg(*[F.stddev_pop(_number(c)).alias(c) for c in cols]).first()
    return {c: (row[c] if row[c] else 1.0) for c in cols}


def scale_numeric(df: DataFrame, scales: dict[str, float], suffix: str = "_scaled") -> DataFrame:
    """Divide by the fitted scale; nothing is centred."""
    return df.withColumns({f"{c}{suffix}": _number(c) / F.lit(float(s)) for c, s in scales.items()})


# --- the whole feature vector -----------------------------------------------


class Featurizer:
    """Fitted on training rows; transforming never refits."""

    def __init__(self, spec: FeatureSpec = TEXT_METADATA, key: str = "problem_uid"):
        self.spec, self.key = spec, key
        self.scales: dict[str, float] = {}
        self.model: PipelineModel | None = None
        self.parts: list[str] = []

    def _prepare(self, df: DataFrame) -> DataFrame:
        s = self.spec
        assert_no_leakage(s.columns(), "featurizer")
        if s.text:
            df = with_terms(df, s.text, "_terms")
        df = df.withColumns({f"_cat_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in s.categorical})
        df = df.withColumns({f"_list_{c}": parse_json_list(c) for c in s.multilabel})
        return scale_numeric(df, self.scales, "_num") if self.scales else df

    def fit(self, df: DataFrame) -> "Featurizer":
        s = self.spec
        self.scales = numeric_scales(df, s.numeric) if s.numeric else {}
        prepared = self._prepare(df)
        stages: list = []
        self.parts = []
        if s.text:
            doc = F.col(self.key) if self.key in prepared.columns else F.monotonically_increasing_id()
            keyed = prepared.select("_terms", doc.alias("_doc"))
            n_docs = df.count()
            vocab = vocabulary(term_counts(keyed, "_doc", "_terms"), s.min_df, s.max_features).collect()
            if vocab:
                idf = [math.log((1 + n_docs) / (1 + r["df"])) + 1.0 for r in vocab]
                counter = CountVectorizerModel.from_vocabulary(
                    [r["term"] for r in vocab], inputCol="_terms", outputCol="_tf", minTF=1.0
                )
                stages += [counter, ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf"),
                           Normalizer(p=2.0, inputCol="_tfidf", outputCol="_text")]
                self.parts.append("_text")
        for c in s.categorical:
            stages += [StringIndexer(inputCol=f"_cat_{c}", outputCol=f"_ix_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"),
                       OneHotEncoder(inputCol=f"_ix_{c}", outputCol=f"_hot_{c}", dropLast=True)]
            self.parts.append(f"_hot_{c}")
        for c in s.multilabel:
            # All labels, those of most rows first and ties by name, so that places do not depend on the run.
            labels = prepared.select(F.explode(F.array_distinct(f"_list_{c}")).alias("label")).groupBy("label").count()
            known = [r["label"] for r in labels.orderBy(F.desc("count"), "label").collect()]
            if not known:
                continue
            stages.append(CountVectorizerModel.from_vocabulary(known, inputCol=f"_list_{c}", outputCol=f"_multi_{c}", minTF=1.0, binary=True))
            self.parts.append(f"_multi_{c}")
        numbers = [f"{c}_num" for c in s.numeric]
        stages.append(VectorAssembler(inputCols=self.parts + numbers, outputCol="features", handleInvalid="keep"))
        self.model = Pipeline(stages=stages).fit(prepared)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._prepare(df))
        drop = [c for c in out.columns if c not in df.columns and c != "features"]
        return out.drop(*drop)

    def n_features(self, df: DataFrame) -> int:
        """Width of the feature vector."""
        row = self.transform(df).select("features").first()
        return int(row["features"].size)
