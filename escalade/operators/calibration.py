"""Confidence calibration and ranking quality.

Rows are first reduced to a score table (one row per group and score), with a
partial aggregate before its shuffle; every figure is computed from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.outcomes import bind, ratio, value_target_columns
from .ranks import add_range, by_ranges, running_totals


def score_table(df: DataFrame, y: Column, score: Column, by=(), weight: Column | None = None) -> DataFrame:
    """``(by..., score, pos, neg)``; NULL scores are unparseable and drop out."""
    w = weight if weight is not None else F.lit(1)
    return (
        df.select(*by, score.alias("score"), y.alias("_y"), w.alias("_w")).where("score IS NOT NULL")
        .groupBy(*by, "score")
        .agg(
            F.sum(F.when(F.col("_y"), F.col("_w")).otherwise(F.lit(0))).cast("bigint").alias("pos"),
            F.sum(F.when(F.col("_y"), F.lit(0)).otherwise(F.col("_w"))).cast("bigint").alias("neg"),
        )
    )


def _wide(col: str) -> Column:
    """Counts widened so that products of two counts cannot overflow."""
    return F.col(col).cast("decimal(18,0)")


def auroc_from_table(table: DataFrame, by=(), points=None, bounded: bool = False) -> DataFrame:
    """Tie-averaged AUROC, NULL when a class is absent; ``points`` and ``bounded`` as of ``running_totals``."""
    by = list(by)
    t = running_totals(table, by, "score", ["neg"], points=points, bounded=bounded)
    pair = _wide("pos") * (F.lit(2) * _wide("cum_neg") + _wide("neg"))
    sums = t.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(pair.cast("decimal(38,0)")).alias("_u2")
    )
    den = F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return sums.select(*by, "n_pos", "n_neg", F.when(den > 0, F.col("_u2").cast("double") / den).alias("auroc"))


def average_precision_from_table(table: DataFrame, by=(), points=None) -> DataFrame:
    """Step average precision with ties grouped, NULL when a class is absent."""
    by = list(by)
    t = running_totals(table, by, "score", ["pos", "neg"], descending=True, points=points)
    tp, fp = F.col("cum_pos") + F.col("pos"), F.col("cum_neg") + F.col("neg")
    step = F.col("pos").cast("double") * (tp.cast("double") / (tp + fp).cast("double"))
    sums = t.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(step).alias("_s"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(*by, "n_pos", "n_neg",
                       F.when(both, F.col("_s") / F.col("n_pos").cast("double")).alias("average_precision"))


def auroc(df: DataFrame, y: Column, score: Column, by=(), points=None) -> DataFrame:
    """Any number of different scores; ``points`` (see ``ranks.split_points``) replace the sampled ranges."""
    return auroc_from_table(score_table(df, y, score, by), by, points)


def average_precision(df: DataFrame, y: Column, score: Column, by=(), points=None) -> DataFrame:
    return average_precision_from_table(score_table(df, y, score, by), by, points)


def average_precision_ordered(df: DataFrame, y: Column, score: Column, order: str, by=(),
                              points: list[float] | None = None) -> DataFrame:
    """Average precision that breaks score ties by an explicit numeric order column.

    The position of a row is the count of rows with a better score, plus the
    rows of earlier order ranges in its tie group, plus its place in its own
    range; so a tie group of any size is spread over the order ranges.
    """
    by = list(by)
    rows = df.select(*by, score.alias("score"), y.alias("_y"), F.col(order).alias("_order")).where("score IS NOT NULL")
    rows = add_range(rows, "_order", points or [])
    cells = rows.groupBy(*by, "score", "_range").agg(
        F.count("*").alias("n"), F.count_if("_y").alias("p")
    )
    # Few rows per group: at most distinct scores x ranges, summed in two steps.
    per_score = running_totals(
        cells.groupBy(*by, "score").agg(F.sum("n").alias("n"), F.sum("p").alias("p")), by, "score", ["n", "p"], descending=True
    ).select(*by, "score", F.col("cum_n").alias("_sn"), F.col("cum_p").alias("_sp"))
    per_range = running_totals(cells, [*by, "score"], "_range", ["n", "p"], bounded=True).select(
        *by, "score", "_range", F.col("cum_n").alias("_rn"), F.col("cum_p").alias("_rp")
    )
    offsets = per_range.join(per_score, [*by, "score"]).select(
        *by, "score", "_range", (F.col("_sn") + F.col("_rn")).alias("_n0"), (F.col("_sp") + F.col("_rp")).alias("_p0")
    )
    w = Window.partitionBy(*by, "score", "_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumns({
        "_n": F.count("*").over(w), "_p": F.sum(F.col("_y").cast("int")).over(w)
    }).join(offsets, [*by, "score", "_range"])
    rank = F.col("_n") + F.col("_n0")
    hits = F.col("_p") + F.col("_p0")
    sums = ranked.groupBy(*by).agg(
        F.count_if("_y").alias("n_pos"), F.count("*").alias("n"),
        F.sum(F.when(F.col("_y"), hits.cast("double") / rank.cast("double"))).alias("_s"),
    )
    return sums.select(*by, "n", "n_pos",
                       F.when(F.col("n_pos") > 0, F.col("_s") / F.col("n_pos").cast("double")).alias("average_precision"))


def brier(df: DataFrame, y: Column, p: Column, by=()) -> DataFrame:
    """Mean squared error of a probability, NULL on no rows."""
    table = score_table(df, y, p, by)
    q = F.col("score")
    err = F.col("pos") * (q - 1.0) * (q - 1.0) + F.col("neg") * q * q
    sums = table.groupBy(*by).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum(err).alias("_e"))
    return sums.select(*by, "n", ratio("_e", "n").alias("brier"))


def bin_edges(n_bins: int) -> list[float]:
    """Inner edges of equal-width bins on [0, 1]."""
    step = 1.0 / n_bins
    return [i * step for i in range(1, n_bins)]


def bin_index(p: Column, n_bins: int = 10) -> Column:
    """0-based bin: the first is closed on both sides, the others are (lo, hi]."""
    def count_edges(q: Column) -> Column:
        passed = F.filter(F.array(*[F.lit(e) for e in bin_edges(n_bins)]), lambda edge: q > edge)
        return F.when((q >= 0.0) & (q <= 1.0), F.size(passed))

    return bind(p, count_edges)


def bins_from_table(table: DataFrame, by=(), n_bins: int = 10) -> DataFrame:
    """Reliability bins of a score table; empty bins do not appear."""
    inside = F.col("bin").isNotNull()
    pos = F.when(inside, F.col("pos")).otherwise(0)
    n = F.when(inside, F.col("pos") + F.col("neg")).otherwise(0)
    sums = (
        table.withColumn("bin", bin_index(F.col("score"), n_bins))
        .groupBy(*by, "bin")
        .agg(F.sum(n).alias("n"), F.sum(pos).alias("pos"), F.sum(n * F.col("score")).alias("_sp"))
        .where("n > 0")
    )
    width = 1.0 / n_bins
    mean, rate = ratio("_sp", "n"), ratio("pos", "n")
    return sums.select(
        *by, "bin", (F.col("bin") * F.lit(width)).alias("lower"),
        F.when(F.col("bin") == n_bins - 1, F.lit(1.0)).otherwise((F.col("bin") + 1) * F.lit(width)).alias("upper"),
        "n", mean.alias("mean_probability"), rate.alias("empirical_rate"), F.abs(mean - rate).alias("abs_gap"),
    )


def reliability_bins(df: DataFrame, y: Column, p: Column, by=(), n_bins: int = 10) -> DataFrame:
    return bins_from_table(score_table(df, y, p, by), by, n_bins)


def ece_from_table(table: DataFrame, by=(), n_bins: int = 10) -> DataFrame:
    bins = bins_from_table(table, by, n_bins)
    sums = bins.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("abs_gap")).alias("_g"))
    return sums.select(*by, "n", ratio("_g", "n").alias("ece"))


def ece(df: DataFrame, y: Column, p: Column, by=(), n_bins: int = 10) -> DataFrame:
    """Sample-weighted calibration error over equal-width bins."""
    return ece_from_table(score_table(df, y, p, by), by, n_bins)


def confidence_report(df: DataFrame, by=(), confidence: str = "confidence", correct: str = "baseline_correct",
                      n_bins: int = 10, points: list[float] | None = None) -> DataFrame:
    """Parse rate, failure AUROC, ECE, Brier and mean confidences per group.

    One pass builds the score table with the unparseable rows as its NULL
    score; the denominators always include them.  Scores may be continuous;
    ``points`` replace the sampled ranges of their order.
    """
    by = [by] if isinstance(by, str) else list(by)
    if not by:
        whole = confidence_report(df.withColumn("_all", F.lit(1)), ["_all"], confidence, correct, n_bins, points)
        return whole.drop("_all")
    cells = df.groupBy(*by, F.col(confidence).alias("confidence")).agg(
        F.count_if(F.col(correct)).alias("right"), F.count_if(~F.col(correct)).alias("wrong")
    )
    p = F.col("confidence") / F.lit(100.0)
    base = cells.groupBy(*by).agg(
        F.sum(F.col("right") + F.col("wrong")).alias("n_total"),
        F.coalesce(F.sum(F.when(F.col("confidence").isNotNull(), F.col("right") + F.col("wrong"))), F.lit(0)).alias("n_parseable"),
        F.sum(F.when(p.isNotNull(), F.col("right") * (p - 1.0) * (p - 1.0) + F.col("wrong") * p * p)).alias("_err"),
        F.sum(F.when(p.isNotNull(), F.col("right"))).alias("_nr"), F.sum(F.when(p.isNotNull(), F.col("wrong"))).alias("_nw"),
        F.sum(F.col("right") * F.col("confidence")).alias("_cr"), F.sum(F.col("wrong") * F.col("confidence")).alias("_cw"),
    )
    # Unparseable cells stay in with zero counts: a filter would be pushed below
    # the aggregate and give the three figures three different scans.
    known = F.col("confidence").isNotNull()
    right, wrong = (F.when(known, F.col(c)).otherwise(0) for c in ("right", "wrong"))
    risk = cells.select(*by, ((F.lit(100.0) - F.col("confidence")) / F.lit(100.0)).alias("score"), wrong.alias("pos"), right.alias("neg"))
    prob = cells.select(*by, p.alias("score"), right.alias("pos"), wrong.alias("neg"))
    out = (
        base.join(auroc_from_table(risk, by, points).select(*by, "auroc"), by, "left")
        .join(ece_from_table(prob, by, n_bins).select(*by, "ece"), by, "left")
    )
    return out.select(
        *by, "n_total", "n_parseable", ratio("n_parseable", "n_total").alias("parse_rate"),
        F.col("auroc").alias("failure_auroc"), "ece", ratio("_err", "n_parseable").alias("brier"),
        ratio("_cr", F.lit(100) * F.col("_nr")).alias("mean_conf_correct"),
        ratio("_cw", F.lit(100) * F.col("_nw")).alias("mean_conf_wrong"),
    )


def target_metrics(df: DataFrame, score: Column, by=("setting",), label="oracle_label", points=None) -> DataFrame:
    """Per group and target: n parseable, positives, prevalence, AUROC, AP.

    One aggregate counts all four targets per score; the long form is taken
    from the score table, not from the rows.
    """
    by = list(by)
    targets = value_target_columns(label)
    cells = df.select("*", score.alias("score")).where("score IS NOT NULL").groupBy(*by, "score").agg(
        F.count("*").alias("_n"), *[F.count_if(y).alias(name) for name, y in targets.items()]
    )
    table = cells.unpivot([*by, "score", "_n"], list(targets), "target", "pos").withColumn("neg", F.col("_n") - F.col("pos"))
    keys = [*by, "target"]
    if points is None:
        table = by_ranges(table, keys, "score")
    a = auroc_from_table(table, keys, points)
    ap = average_precision_from_table(table, keys, points).select(*keys, "average_precision")
    n = F.col("n_pos") + F.col("n_neg")
    return a.join(ap, keys).select(
        *keys, n.alias("n_parseable"), F.col("n_pos").alias("positive_n"), ratio("n_pos", n).alias("prevalence"),
        "auroc", F.col("average_precision").alias("auprc"),
    )


def gate_replay(df: DataFrame, threshold: float, by=("setting",), confidence: str = "confidence") -> DataFrame:
    """Kept and escalated counts and the realised solve rate of the gate."""
    kept = F.coalesce(F.col(confidence) >= F.lit(float(threshold)), F.lit(False))
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(kept).alias("kept_baseline"),
        F.count_if(F.when(kept, F.col("baseline_correct")).otherwise(F.col("single_correct"))).alias("_s"),
    )
    return sums.select(*by, "n", "kept_baseline", (F.col("n") - F.col("kept_baseline")).alias("escalated_single"),
                       ratio("_s", "n").alias("gate_solve_rate"))


def _bands(df: DataFrame, cuts: list[float], by: list[str], confidence: str, **outcomes: str) -> DataFrame:
    """One row per group: for each band between cuts (the number of cuts reached, 0 for NULL) its rows and successes."""
    reached = F.coalesce(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(confidence))), F.lit(0))
    reached = F.when(F.col(confidence).isNull(), 0).otherwise(reached).alias("k")
    sums = df.groupBy(*by, reached).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in outcomes.items()])
    return sums.groupBy(*by).agg(F.collect_list(F.struct("k", "n", *outcomes)).alias("_bands"))


def _total(low: Column | int, high: Column | int, field: str) -> Column:
    """Sum of a field over the bands from ``low`` up to, but without, ``high``."""
    chosen = F.filter("_bands", lambda x: (x["k"] >= low) & (x["k"] < high))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda t, x: t + x[field])


def threshold_sweep(df: DataFrame, thresholds: list[float], by=("setting",), confidence: str = "confidence") -> DataFrame:
    """The gate at many thresholds in one pass; the best keeps the lowest threshold on ties.

    Rows reduce to one count per band between thresholds; a threshold's figures add up bands, so no row meets every threshold.
    """
    by, cuts = list(by), sorted({float(t) for t in thresholds})
    sums = _bands(df, cuts, by, confidence, b="baseline_correct", s="single_correct")
    points = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(k + 1).alias("at")) for k, t in enumerate(cuts)])
    top = len(cuts) + 1
    at = sums.withColumn("_p", F.explode(points)).select(
        *by, "_p.threshold", _total(0, top, "n").alias("n"), _total(F.col("_p.at"), top, "n").alias("kept_baseline"),
        (_total(F.col("_p.at"), top, "b") + _total(0, F.col("_p.at"), "s")).alias("solved"),
    )
    return _with_best(at, by, ["threshold"])


def cascade_sweep(df: DataFrame, pairs: list[tuple[float, float]], by=("setting",), confidence: str = "confidence",
                  tier_success: str = "tier_correct") -> DataFrame:
    """The cascade at many (high, low) pairs in one pass; the best keeps the lowest pair on ties.

    From ``high`` on the cheapest protocol decides, from ``low`` on the single agent, below it (and without a confidence) the tier's label.
    """
    by, cuts = list(by), sorted({float(t) for pair in pairs for t in pair})
    place = {t: k + 1 for k, t in enumerate(cuts)}
    sums = _bands(df, cuts, by, confidence, b="baseline_correct", s="single_correct", t=tier_success)
    points = F.array(*[
        F.struct(F.lit(float(h)).alias("high"), F.lit(float(w)).alias("low"), F.lit(place[float(h)]).alias("at_high"), F.lit(place[float(w)]).alias("at_low"))
        for h, w in pairs
    ])
    top, high, low = len(cuts) + 1, F.col("_p.at_high"), F.col("_p.at_low")
    at = sums.withColumn("_p", F.explode(points)).select(
        *by, "_p.high", "_p.low", _total(0, top, "n").alias("n"), _total(high, top, "n").alias("kept_baseline"), _total(low, high, "n").alias("kept_single"),
        (_total(high, top, "b") + _total(low, high, "s") + _total(0, F.least(low, high), "t")).alias("solved"),
    )
    return _with_best(at, by, ["high", "low"])


def _with_best(sums: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Adds the solve rate, and whether a row has its group's most solved at the lowest keys."""
    order = Window.partitionBy(*by).orderBy(F.desc("solved"), *keys)
    return sums.withColumns({"solve_rate": ratio("solved", "n"), "is_best": F.row_number().over(order) == 1})
