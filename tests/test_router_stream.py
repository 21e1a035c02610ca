import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import rows
from escalade.contract import bindings as b
from escalade.operators import features as ft
from escalade.operators.splits import SplitConfig, stratified_split
from escalade.plans import reports, router
from escalade.streaming import run_log as st


@pytest.fixture(scope="module")
def learnable(spark):
    """Tier decides the label, so a router can learn it."""
    df = spark.range(0, 400).select(
        F.col("id").cast("string").alias("problem_uid"), (F.col("id") % 4).cast("int").alias("difficulty_tier"), (F.col("id") % 4 * 1.0).alias("difficulty"),
        F.concat(F.lit("src"), (F.col("id") % 4).cast("string")).alias("source"), F.concat(F.lit("word"), (F.col("id") % 4).cast("string"), F.lit(" common text")).alias("problem"),
        F.lit('["a", "b"]').alias("domain"),
    )
    label = F.get(F.array(*[F.lit(x) for x in ("baseline_llm", "single_agent", "broadcast", "none")]), F.col("difficulty_tier"))
    return stratified_split(df.withColumn("oracle_label", label), SplitConfig.primary()).persist()


def test_router_learns_and_never_predicts_unseen_classes(spark, learnable):
    fitted, best, log, predictions = router.fit_refit_evaluate(learnable, grid=router.GRID[:2])
    assert best == {"class_weight": None, "C": 0.25} or log[1]["dev_macro_f1"] > log[0]["dev_macro_f1"]
    report = router.router_report(predictions).first()
    assert report["accuracy"] == 1.0 and report["macro_f1"] == pytest.approx(0.8)
    seen = {r[0] for r in fitted.predict(learnable).select("predicted_label").distinct().collect()}
    assert "planner_executor_reviewer" not in seen
    scores = fitted.scores(learnable.limit(5)).select("probabilities").collect()
    assert all(sum(r[0].values()) == pytest.approx(1.0) for r in scores)


def test_empty_split_is_an_error(learnable):
    with pytest.raises(ValueError):
        router.fit_refit_evaluate(learnable.where("split <> 'dev'"))
    with pytest.raises(ValueError):
        router.select_on_dev(learnable, learnable, grid=())


def test_optimum_satisfies_the_sum_of_losses_objective(learnable):
    """At the solution the gradient of C * sum(loss) + |w|^2 / 2 vanishes."""
    spec = ft.FeatureSpec(text=None, categorical=(), multilabel=())
    r = router.LogisticRouter(spec=spec, C=0.5, class_weight=None, max_iter=500).fit(learnable)
    data = r.featurizer.transform(learnable).select(vector_to_array("features").alias("x"), "oracle_label").collect()
    w, c = r.model.coefficientMatrix.toArray(), r.model.interceptVector.toArray()
    grad = w.copy()
    for row in data:
        z = w @ row["x"] + c
        p = [math.exp(v - max(z)) for v in z]
        total = sum(p)
        for k in range(len(p)):
            y = 1.0 if router.INDEX[row["oracle_label"]] == k else 0.0
            if k in {int(router.INDEX[q]) for q in r.present}:
                grad[k] += 0.5 * (p[k] / total - y) * __import__("numpy").array(row["x"])
    assert abs(grad[[0, 1, 3]]).max() < 0.05


def test_featurizer_unknowns_and_blanks(spark, learnable):
    f = ft.Featurizer().fit(learnable)
    odd = spark.createDataFrame([("z", "unseen words", "nowhere", '["q"]', None, None), ("y", None, None, None, 2.0, 1)],
                                "problem_uid string, problem string, source string, domain string, difficulty double, difficulty_tier int")
    out = {r["problem_uid"]: r for r in f.transform(odd).select("problem_uid", vector_to_array("features").alias("v")).collect()}
    assert sum(abs(x) for x in out["z"]["v"]) == 0.0
    assert f.n_features(learnable) == len(out["y"]["v"])
    assert set(f.scales) == {"difficulty", "difficulty_tier"}


def test_constant_number_keeps_its_value(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 3.0)], "a double, b double")
    scales = ft.numeric_scales(df, ["a", "b"])
    assert scales == {"a": 1.0, "b": 1.0}


def test_tfidf_against_formula(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc"), (3, "bb cc cc")], "d int, t string")
    counts = ft.term_counts(ft.with_terms(docs, "t"), "d")
    vocab = ft.vocabulary(counts, 2, 100)
    assert [r["term"] for r in vocab.collect()] == ["aa", "cc", "bb"]
    got = {(r["d"], r["term"]): r["weight"] for r in ft.tfidf(counts, vocab, 3, "d").collect()}
    idf = math.log(4 / 3) + 1
    assert got[(1, "aa")] == pytest.approx(2 * idf / math.sqrt((2 * idf) ** 2 + idf**2))


def test_streams_match_batch_and_resume(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    keyed = stream.withColumnsRenamed({"user_id": "problem_id", "event_type": "protocol"})
    for _ in range(2):
        st.stream_run_log(keyed, out, cp)
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert spark.read.parquet(out).count() == events.select("user_id", "event_type").distinct().count()


def _run_records(spark, path, records):
    spark.createDataFrame(records, "problem_id string, protocol string, ts timestamp, n int").coalesce(1).write.mode("append").parquet(path)


def test_late_repeats_are_found(spark, tmp_path):
    """A repeat comes years after the first, in both directions of time; nulls are a key like any other."""
    from datetime import datetime

    source, out, cp = (str(tmp_path / x) for x in "soc")
    schema = "problem_id string, protocol string, ts timestamp, n int"
    _run_records(spark, source, [("a", "x", datetime(2020, 1, 1), 1), ("a", "x", datetime(2019, 1, 1), 2), ("b", None, datetime(2021, 1, 1), 3)])
    st.stream_run_log(spark.readStream.schema(schema).parquet(source), out, cp)
    _run_records(spark, source, [("a", "x", datetime(2030, 1, 1), 4), ("b", None, datetime(2000, 1, 1), 5), ("c", "x", datetime(2001, 1, 1), 6)])
    _run_records(spark, source, [("c", "x", datetime(2040, 1, 1), 7)])
    st.stream_run_log(spark.readStream.schema(schema).parquet(source), out, cp)
    st.stream_run_log(spark.readStream.schema(schema).parquet(source), out, cp)
    assert rows(spark.read.parquet(out).select("problem_id", "protocol", "n")) == rows(spark.createDataFrame([("a", "x", 2), ("b", None, 3), ("c", "x", 6)], "a string, b string, n int"))


def test_a_batch_may_be_handled_again(spark, tmp_path):
    """A batch that fails after half of its work, and one that is handled twice, leave what one handling leaves."""
    from datetime import datetime

    out, schema = str(tmp_path / "o"), "problem_id string, protocol string, ts timestamp, n int"
    handle = st.append_new(out, buckets=4)
    first = spark.createDataFrame([(f"p{k}", "x", datetime(2020, 1, 1), k) for k in range(40)], schema)
    second = spark.createDataFrame([(f"p{k}", "x", datetime(2020, 1, 2), k) for k in range(20, 60)], schema)
    handle(first, 0)
    # Files that a broken attempt left in the folder of the batch.
    second.withColumn("bucket", F.lit(1)).limit(7).write.partitionBy("bucket").parquet(f"{out}/epoch=1")
    for _ in range(2):
        handle(second, 1)
        got = spark.read.parquet(out)
        assert got.count() == 60 == got.select("problem_id").distinct().count() and got.where("epoch = 1").agg(F.min("n")).first()[0] == 40
    handle(first, 0)  # the first batch again, when the second is there
    assert spark.read.parquet(out).count() == 60

    source, live, cp = (str(tmp_path / x) for x in "slc")
    first.write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts"))
    inner = st.append_new(live)

    def broken(batch, epoch):
        inner(batch, epoch)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        stream.writeStream.option("checkpointLocation", cp).foreachBatch(broken).trigger(availableNow=True).start().awaitTermination()
    st.stream_run_log(spark.readStream.schema(schema).parquet(source), live, cp)
    assert spark.read.parquet(live).count() == 40


def test_the_ledger_keeps_two_triggers(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in "soc")
    schema = "role string, prompt_tokens bigint, completion_tokens bigint"
    for k in range(4):
        spark.createDataFrame([("r", 1, k)], schema).write.mode("append").parquet(source)
        st.stream_ledger(spark.readStream.schema(schema).parquet(source), out, cp)
    assert len([f for f in (tmp_path / "o").iterdir() if f.name.startswith("epoch=")]) == 2
    assert tuple(st.read_ledger(spark, out).select("calls", "prompt_tokens", "completion_tokens").first()) == (4, 4, 6)


def test_published_tables_round_and_order(spark, sf):
    from escalade.contract.outcomes import _dim

    out = reports.published_tables(b.labelled(spark, sf), _dim(spark), resamples=50)
    cover = out["matched_protocol_coverage"].collect()
    assert [r["setting"] for r in cover][:5] == ["Economy", "Small", "Medium", "Large", "Standard"]
    assert cover[-1]["solver"] == "endpoint/promo"
    assert all(r["oracle_pct"] == round(r["oracle_pct"], 2) for r in cover)
    assert all(r["broadcast_minus_per_ci_points"].startswith("[") for r in out["per_broadcast_interaction"].collect())


def test_wide_binding_equals_the_long_operator(spark, sf):
    from escalade.operators.matched import matched_outcomes

    full, _ = matched_outcomes(b.runs(spark, sf), ("problem_uid",))
    wide = b.matched(spark, sf).select(*full.columns)
    assert rows(wide) == rows(full)


def _noisy(spark, n=1200):
    """Rows whose label depends on the features only in part, so that the optimum is inside."""
    x = F.pmod(F.xxhash64("id"), F.lit(97)) / 97
    df = spark.range(n).select(
        F.col("id").cast("string").alias("problem_uid"), (F.col("id") % 7).cast("int").alias("difficulty_tier"), x.alias("difficulty"),
        F.concat(F.lit("src"), (F.col("id") % 5).cast("string")).alias("source"), F.concat_ws(" ", F.lit("word"), F.concat(F.lit("w"), (F.col("id") % 11).cast("string"))).alias("problem"),
        F.lit('["a"]').alias("domain"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).alias("_r"),
    )
    label = F.when(F.col("_r") < 20 + 40 * F.col("difficulty"), "baseline_llm").when(F.col("_r") < 70 + 2 * F.col("difficulty_tier"), "single_agent").otherwise("broadcast")
    return df.withColumn("oracle_label", label).drop("_r")


def test_grid_is_every_single_fit(spark):
    from escalade.plans import grid

    df = _noisy(spark).coalesce(2).persist()
    featurizer, models = router.fit_grid(df)
    assert models.coefficients.shape == (6, featurizer.n_features(df) + 1, 3) and models.classes == ["baseline_llm", "single_agent", "broadcast"]
    passes = []
    for place, config in list(enumerate(router.GRID))[:3]:
        _, alone = router.fit_grid(df, grid=[config])
        passes.append(alone.passes)
        assert abs(alone.coefficients[0] - models.coefficients[place]).max() < 1e-6
    # As many passes as the slowest configuration of six takes, not as all together.
    assert models.passes < sum(passes) and models.passes < 2.5 * max(passes)
    # And Spark's solver, which stops earlier, comes near the same optimum.
    mine = models.coefficients[1]
    theirs = router.LogisticRouter(C=1.0, class_weight=None).fit(df, featurizer)
    w = theirs.model.coefficientMatrix.toArray()[[0, 1, 3]].T
    assert abs(mine[:-1] - w).max() < 0.1
    y = router.LABELS
    told = models.predictions(grid.sparse_rows(featurizer.transform(df), F.lit(0), "oracle_label"), "oracle_label")
    hits = {r["place"]: r["n"] for r in told.where("oracle_label = predicted_label").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    single = theirs.predict(df).where("oracle_label = predicted_label").count()
    assert len(y) == 5 and abs(hits[1] - single) <= 6 and sum(r["n"] for r in told.collect()) == 6 * df.count()


def test_grid_gradients_are_differences_of_losses():
    import numpy as np
    import pyarrow as pa

    from escalade.plans import grid

    rng = np.random.default_rng(1)
    places = [sorted(rng.choice(6, rng.integers(0, 4), replace=False).tolist()) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({
        "y": pa.array(rng.integers(0, 3, 40), pa.int32()), "places": pa.array(places, pa.list_(pa.int32())),
        "values": pa.array([rng.normal(size=len(p)).tolist() for p in places], pa.list_(pa.float64())),
    })
    x, weights = rng.normal(size=(7, 6)), rng.random((2, 3))
    base = grid._loss_and_gradient(x, weights, 3, [batch])
    for place in ((0, 0), (3, 4), (6, 5), (6, 1)):
        more = x.copy()
        more[place] += 1e-6
        config = place[1] // 3 * 3
        assert (grid._loss_and_gradient(more, weights, 3, [batch])[-1, config] - base[-1, config]) / 1e-6 == pytest.approx(base[place], abs=1e-4)


def _entries(rng, rows, width, most, classes):
    import numpy as np
    import pyarrow as pa

    places = [np.sort(rng.choice(width, rng.integers(0, most), replace=False)).tolist() for _ in range(rows)]
    return pa.RecordBatch.from_pydict({
        "y": pa.array(rng.integers(0, classes, rows), pa.int32()), "places": pa.array(places, pa.list_(pa.int32())),
        "values": pa.array([rng.normal(size=len(p)).tolist() for p in places], pa.list_(pa.float64())),
    })


@pytest.mark.parametrize("heavy", [[0, 1, 2, 3, 4, 5], [1, 4], []])
def test_grid_curvature_is_differences_of_gradients(heavy, monkeypatch):
    import numpy as np

    from escalade.plans import grid

    monkeypatch.setattr(grid, "PAIRS", 7)
    rng = np.random.default_rng(1)
    batch, heavy = _entries(rng, 40, 6, 5, 3), np.array(heavy, dtype=np.int64)
    x, weights = rng.normal(size=(7, 6)), rng.random((2, 3))
    total, squares, products = grid._loss_and_gradient(x, weights, 3, [batch], heavy)
    assert np.array_equal(total, grid._loss_and_gradient(x, weights, 3, [batch]))
    for config in (0, 1):
        own = slice(3 * config, 3 * config + 3)
        bend = grid.Curvature(squares[:, own], products[config], heavy, 0.25)
        block = bend.block.copy()
        block[-1, :, -1, :] -= 1.0
        for feature in range(7):
            for c in range(3):
                more = x.copy()
                more[feature, 3 * config + c] += 1e-6
                step = (grid._loss_and_gradient(more, weights, 3, [batch])[:-1, own] - total[:-1, own]) / 1e-6
                assert bend.diagonal[feature, c] - 0.25 == pytest.approx(step[feature, c], abs=1e-4)
                if feature in bend.places:
                    at = list(bend.places).index(feature)
                    step[feature, c] += 0.25 * (feature < 6)
                    assert np.allclose(block[at, c], step[bend.places], atol=1e-4)


@pytest.mark.parametrize("block", [1024, 30])
def test_grid_takes_few_passes_over_features_that_are_alike(spark, monkeypatch, block):
    import numpy as np

    from escalade.plans import grid

    monkeypatch.setattr(grid, "BLOCK", block)
    rng = np.random.default_rng(3)
    first, second = rng.random(600), rng.integers(0, 12, 600)
    # A category as feature, its copy scaled, a number near its double, and the intercept: only the penalty tells them apart.
    rows = [(int(y), [int(s), 12 + int(s), 24, 25], [1.0, 0.3, float(10 * a), float(20 * a + 0.01 * b)])
            for a, b, s, y in zip(first, rng.random(600), second, (first * 2 + second / 12 + 0.4 * rng.normal(size=600)).clip(0, 2).astype(int))]
    table = spark.createDataFrame(rows, "y int, places array<int>, values array<double>").coalesce(2).persist()
    counts = {str(k): sum(r[0] == k for r in rows) for k in range(3)}
    models = grid.fit_grid(table, counts, list(counts), 26, router.GRID, max_passes=200)
    table.unpersist()
    assert max(models.gradients) <= 1e-9
    assert models.passes <= (20 if block == 1024 else 120)


def test_the_driver_gets_the_sums_of_a_pass_once(spark, monkeypatch):
    """However many tasks there are, what comes to the driver is one array, and the models are the same."""
    import numpy as np
    from pyspark import RDD

    from escalade.plans import grid

    rng = np.random.default_rng(5)
    data = [(int(y), sorted(rng.choice(9, 3, replace=False).tolist()), rng.random(3).tolist()) for y in rng.integers(0, 3, 300)]
    counts = {str(k): sum(r[0] == k for r in data) for k in range(3)}
    table = spark.createDataFrame(data, "y int, places array<int>, values array<double>")
    sent, collect = [], RDD.collect

    def counted(self):
        got = collect(self)
        sent.append(sum(x.nbytes for r in got for x in (r if isinstance(r, tuple) else (r,)) if isinstance(x, np.ndarray)))
        return got

    monkeypatch.setattr(RDD, "collect", counted)
    one = 8 * ((2 * 9 + 3) * 3 + 10 * 11 // 2 * 3) * len(router.GRID)
    fits = []
    for tasks, part in ((1, 1 << 16), (64, 1 << 16), (64, 100)):
        monkeypatch.setattr(grid, "PART", part, raising=False)
        sent.clear()
        fits.append(grid.fit_grid(table.repartition(tasks).persist(), counts, list(counts), 9, router.GRID, max_passes=20))
        assert max(sent) == one
        assert abs(fits[-1].coefficients - fits[0].coefficients).max() < 1e-6
    monkeypatch.setattr(grid, "BLOCK", 12)
    assert sorted(grid.heavy_places(table.repartition(64), 9, 3)) == sorted(grid.heavy_places(table.repartition(1), 9, 3))
    spark.catalog.clearCache()


def test_select_on_dev_makes_its_rows_once(spark, sf, monkeypatch, capsys):
    """Train and dev rows come from rows that are held while the query runs, and not after it."""
    from escalade.contract import routers

    class Seen(Exception):
        pass

    def spied(train, dev, *rest):
        for part in (train, dev):
            capsys.readouterr()
            part.explain()
            assert "InMemoryTableScan" in capsys.readouterr().out
        raise Seen

    monkeypatch.setattr(routers.rt, "select_on_dev", spied)
    with pytest.raises(Seen):
        routers.select_on_dev(spark, sf)
    routers._rows(spark, sf).explain()
    assert "InMemoryTableScan" not in capsys.readouterr().out
