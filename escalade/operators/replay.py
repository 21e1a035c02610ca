"""Replay of routing policies over observed outcomes, and the metrics on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import EXECUTIONS, LABELS, NONE, OUTCOME_COLUMNS, SHORT, TOKEN_COLUMNS
from ..functions.outcomes import canonical_protocol, escalation_direction, ratio


def _pick(pred: Column, columns: dict, none_value) -> Column:
    """Value of the routed protocol's column, without building a map per row."""
    out = F.when(pred == NONE, F.lit(none_value))
    for p in EXECUTIONS:
        out = out.when(pred == p, F.col(columns[p]))
    return out


def replay(df: DataFrame, pred: str = "predicted_label", label: str = "oracle_label",
           success: dict | None = None, tokens: dict | None = TOKEN_COLUMNS) -> DataFrame:
    """Look up what following ``pred`` would have realised; nothing is modelled.

    ``none`` realises no success at no cost.  Without cost columns tokens are
    NULL, never 0.
    """
    success = success or OUTCOME_COLUMNS
    priced = tokens is not None and all(c in df.columns for c in tokens.values())
    out = df.withColumn(pred, canonical_protocol(pred)).withColumn(label, canonical_protocol(label))
    p, g = F.col(pred), F.col(label)
    out = out.withColumn("success", _pick(p, success, False))
    if priced:
        cost, oracle = _pick(p, tokens, 0).cast("bigint"), _pick(g, tokens, 0).cast("bigint")
    else:
        cost = F.when(p == NONE, F.lit(0)).cast("bigint")
        oracle = F.when(g == NONE, F.lit(0)).cast("bigint")
    out = out.withColumn("tokens", cost).withColumn("oracle_tokens", oracle)
    excess = F.when(
        F.col("tokens").isNotNull() & F.col("oracle_tokens").isNotNull(),
        F.greatest(F.col("tokens") - F.col("oracle_tokens"), F.lit(0)),
    ).cast("bigint")
    return out.withColumn("excess_tokens", excess).withColumn("mode_correct", p == g).withColumn("solvable", g != NONE)


# --- classification metrics -------------------------------------------------


def confusion_counts(gold: str, pred: str, weight: str = "1") -> list[Column]:
    """Per label: true positives, predicted and gold counts, as aggregate columns.

    Fifteen conditional sums in one aggregate replace a confusion table and its
    second shuffle.
    """
    out = []
    for lab in LABELS:
        conds = {"tp": f"{gold} = '{lab}' AND {pred} = '{lab}'", "np": f"{pred} = '{lab}'", "ng": f"{gold} = '{lab}'"}
        out += [
            F.expr(f"CAST(coalesce(sum(CASE WHEN {c} THEN {weight} ELSE 0 END), 0) AS BIGINT)").alias(f"{k}_{SHORT[lab]}")
            for k, c in conds.items()
        ]
    return out


def _f1(s: str) -> str:
    return f"CASE WHEN np_{s} + ng_{s} > 0 THEN (2D * tp_{s}) / CAST(np_{s} + ng_{s} AS DOUBLE) ELSE 0D END"


def f1_from_counts(s: str) -> Column:
    """2tp / (predicted + gold), 0 on an empty denominator."""
    return F.expr(_f1(s))


def macro_f1_from_counts() -> Column:
    """Mean over all five labels, absent ones included."""
    return F.expr("(" + " + ".join(f"({_f1(SHORT[p])})" for p in LABELS) + ") / 5D")


def class_prf(df: DataFrame, gold: str, pred: str, by=()) -> DataFrame:
    """Precision, recall and F1 per label; five rows per group whatever occurs."""
    by = list(by)
    counts = df.groupBy(*by).agg(*confusion_counts(gold, pred))
    rows = []
    for lab in LABELS:
        s = SHORT[lab]
        rows.append(F.struct(
            F.lit(lab).alias("label"), F.col(f"tp_{s}").alias("tp"),
            (F.col(f"np_{s}") - F.col(f"tp_{s}")).alias("fp"),
            (F.col(f"ng_{s}") - F.col(f"tp_{s}")).alias("fn"),
            F.coalesce(ratio(f"tp_{s}", f"np_{s}"), F.lit(0.0)).alias("precision"),
            F.coalesce(ratio(f"tp_{s}", f"ng_{s}"), F.lit(0.0)).alias("recall"),
            f1_from_counts(s).alias("f1"),
        ))
    return counts.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def macro_f1(df: DataFrame, gold: str, pred: str, by=()) -> DataFrame:
    by = list(by)
    return df.groupBy(*by).agg(*confusion_counts(gold, pred)).select(
        *by, macro_f1_from_counts().alias("macro_f1")
    )


def accuracy(df: DataFrame, gold: str, pred: str, by=()) -> DataFrame:
    """Share of equal labels, 0 on empty input."""
    n = F.count("*")
    hit = F.count_if(F.col(gold) == F.col(pred)).cast("double")
    return df.groupBy(*by).agg(F.when(n == 0, F.lit(0.0)).otherwise(hit / n.cast("double")).alias("accuracy"))


def direction_counts(gold: Column, pred: Column) -> list[Column]:
    d = escalation_direction(pred, gold)
    return [F.count_if(d == k).alias(f"n_{k}") for k in ("over", "under", "match")]


def direction_rates(n="n") -> list[Column]:
    return [
        F.coalesce(ratio("n_over", n), F.lit(0.0)).alias("over_escalation_rate"),
        F.coalesce(ratio("n_under", n), F.lit(0.0)).alias("under_escalation_rate"),
        F.coalesce(ratio("n_match", n), F.lit(0.0)).alias("match_rate"),
    ]


def escalation_rates(df: DataFrame, gold: str, pred: str, by=()) -> DataFrame:
    """Over, under and match shares."""
    by = list(by)
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), *direction_counts(F.col(gold), F.col(pred)))
    return counts.select(*by, "n", *direction_rates())


def routing_summary(replayed: DataFrame, by=(), gold: str = "oracle_label", pred: str = "predicted_label") -> DataFrame:
    """Headline routing metrics in one aggregate; token means only if every row has tokens."""
    by = list(by)
    g, p = F.col(gold), F.col(pred)
    counts = replayed.groupBy(*by).agg(
        F.count("*").alias("n_examples"),
        F.count_if("success").alias("n_success"),
        F.count_if(g == p).alias("n_mode"),
        F.count_if("solvable").alias("n_solvable"),
        F.count_if(F.col("solvable") & ~F.col("success")).alias("n_missed"),
        *direction_counts(g, p),
        F.count("tokens").alias("n_tokens"),
        F.sum("tokens").alias("sum_tokens"),
        F.count("excess_tokens").alias("n_excess"),
        F.sum("excess_tokens").alias("sum_excess"),
        *confusion_counts(gold, pred),
    )
    complete = F.col("n_tokens") == F.col("n_examples")
    return counts.where("n_examples > 0").select(
        *by, "n_examples",
        ratio("n_success", "n_examples").alias("solve_rate"),
        ratio("n_mode", "n_examples").alias("mode_accuracy"),
        macro_f1_from_counts().alias("macro_f1"),
        F.coalesce(ratio("n_missed", "n_solvable"), F.lit(0.0)).alias("missed_success_rate"),
        *direction_rates("n_examples"),
        F.when(complete, ratio("sum_tokens", "n_tokens")).alias("avg_tokens"),
        F.when(complete, ratio("sum_excess", "n_excess")).alias("avg_excess_tokens_vs_oracle"),
    )


def heldout_table(replayed: DataFrame, by=("setting",), pred: str = "predicted_label", gold: str = "oracle_label") -> DataFrame:
    """Per group: baseline, router and oracle solve, gap, macro-F1, five route shares."""
    by = list(by)
    g, p = F.col(gold), F.col(pred)
    counts = replayed.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("baseline_correct")).alias("n_base"),
        F.count_if("success").alias("n_success"),
        F.count_if("solvable").alias("n_solvable"),
        *confusion_counts(gold, pred),
    )
    return counts.select(
        *by, "n",
        ratio("n_base", "n").alias("baseline_solve"),
        ratio("n_success", "n").alias("router_solve"),
        ratio("n_solvable", "n").alias("oracle_solve"),
        ratio(F.col("n_solvable") - F.col("n_success"), "n").alias("oracle_gap"),
        macro_f1_from_counts().alias("oracle_label_macro_f1"),
        *[ratio(f"np_{SHORT[q]}", "n").alias(f"route_{SHORT[q]}") for q in LABELS],
    )


def policy_long(df: DataFrame, policies: dict[str, str | Column], keep: list[str]) -> DataFrame:
    """Several policy columns of one row as rows ``(policy, predicted_label)``; a narrow explode."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("policy"), (F.col(c) if isinstance(c, str) else c).alias("predicted_label"))
        for name, c in policies.items()
    ])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.policy", "_p.predicted_label")


def policy_table(replayed: DataFrame, by=("policy",)) -> DataFrame:
    """Solve percent, mean tokens and mean excess tokens per policy on the same rows."""
    n = F.count("*")
    counts = replayed.groupBy(*by).agg(
        n.alias("n"), F.count_if("success").alias("s"),
        F.count("tokens").alias("nt"), F.sum("tokens").alias("t"),
        F.count("excess_tokens").alias("ne"), F.sum("excess_tokens").alias("e"),
    )
    return counts.select(
        *by, "n",
        (F.lit(100.0) * F.col("s").cast("double") / F.col("n").cast("double")).alias("solve_pct"),
        F.when(F.col("nt") == F.col("n"), ratio("t", "nt")).alias("avg_tokens"),
        F.when(F.col("ne") == F.col("n"), ratio("e", "ne")).alias("avg_excess_tokens"),
    )


def marginal_cost_gain(df: DataFrame, by=("setting",)) -> DataFrame:
    """Each step to the next dearer protocol: extra tokens against extra solves.

    Eight sums per group in one aggregate; the steps are differences of them.
    """
    by = list(by)
    aggs = [F.count("*").alias("n")]
    for p in EXECUTIONS:
        aggs += [F.count_if(F.col(OUTCOME_COLUMNS[p])).alias(f"s_{SHORT[p]}"),
                 F.sum(TOKEN_COLUMNS[p]).alias(f"t_{SHORT[p]}")]
    sums = df.groupBy(*by).agg(*aggs)
    steps = []
    for lo, hi in zip(EXECUTIONS, EXECUTIONS[1:]):
        a, b = SHORT[lo], SHORT[hi]
        extra_t, extra_s = F.col(f"t_{b}") - F.col(f"t_{a}"), F.col(f"s_{b}") - F.col(f"s_{a}")
        steps.append(F.struct(
            F.lit(lo).alias("from_protocol"), F.lit(hi).alias("to_protocol"),
            ratio(extra_t, "n").alias("extra_tokens"),
            ratio(extra_s, "n").alias("extra_solve_rate"),
            F.when(extra_s > 0, ratio(extra_t, extra_s)).alias("tokens_per_extra_solve"),
        ))
    return sums.select(*by, "n", F.explode(F.array(*steps)).alias("s")).select(*by, "n", "s.*")
