"""Label quality against gold: F1, confusion, calibration, spans, ablation differences and stage costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.operators.portfolio import pearson

FIELDS = ("fundamental_sentiment", "strategic_optimism", "phenomenon")


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded, 0 where b is 0."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in order."""
    own = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), F.col(order)).alias("_x")).select(key, "_x.*")


def matched(pred: DataFrame, gold: DataFrame, field: str, key: str = "report_id", order: str | None = None) -> DataFrame:
    """(key, gold, pred) of ids that both have, where gold is labelled. With order, of a gold id that repeats the last row counts."""
    if order is not None:
        gold = last_by(gold, key, order)
    g = gold.select(key, F.col(field).alias("gold")).where("gold is not null")
    return pred.select(key, F.col(field).alias("pred")).join(g, key)


def label_counts(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, support) over the union of gold and predicted labels."""
    n = pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    g = n.select(F.col("gold").alias("label"), hit.alias("tp"), F.lit(0).alias("fp"), (F.col("n") - hit).alias("fn"), F.col("n").alias("support"))
    p = n.where(F.col("pred").isNotNull()).select(F.col("pred").alias("label"), F.lit(0).alias("tp"), (F.col("n") - hit).alias("fp"), F.lit(0).alias("fn"), F.lit(0).alias("support"))
    return g.union(p).groupBy("label").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "support")])


def prf(counts: DataFrame) -> DataFrame:
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(pairs: DataFrame) -> DataFrame:
    """Mean of the labels' F1, each stage rounded to 4 digits."""
    return prf(label_counts(pairs)).agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 4).alias("macro_f1"), F.count(F.lit(1)).alias("labels"))


def confusion(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """All cells of gold x predicted labels, 0 where there is none."""
    grid = pairs.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "gold string, pred string")
    n = pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(n, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def error_kinds(negative: str = "none") -> Column:
    """Of (gold, pred) rows."""
    return F.when(F.col("gold") == F.col("pred"), "correct").when(F.col("gold") == negative, "false_positive").when(F.col("pred") == negative, "false_negative").otherwise("misclassification")


def accuracy_by_gold(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold").agg(F.count(F.lit(1)).alias("n"), ratio(F.sum(F.when(F.col("gold") == F.col("pred"), 1).otherwise(0)), F.count(F.lit(1))).alias("accuracy"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """rows (uncertainty, correct) -> (bin, centre, n, accuracy) by confidence 1 - uncertainty."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), ((1 - F.col("uncertainty")) * bins).cast("int")))
    out = rows.groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), ratio(F.sum(F.col("correct").cast("int")), F.count(F.lit(1))).alias("accuracy"))
    return out.withColumn("centre", F.round((F.col("bin") + 0.5) / bins, 4))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    gap = F.sum(F.abs(F.col("centre") - F.col("accuracy")) * F.col("n"))
    return bins.agg(F.coalesce(F.round(F.try_divide(gap, F.sum("n").cast("double")), 4), F.lit(0.0)).alias("ece"))


def span_prf(rows: DataFrame, gold: str = "gold_spans", pred: str = "pred_spans") -> DataFrame:
    """Micro precision, recall and F1 of sets of span texts."""
    g, p = F.array_distinct(F.coalesce(gold, F.array().cast("array<string>"))), F.array_distinct(F.coalesce(pred, F.array().cast("array<string>")))
    c = rows.agg(*[F.coalesce(F.sum(F.size(x)), F.lit(0)).cast("long").alias(n) for n, x in (("tp", F.array_intersect(g, p)), ("fp", F.array_except(p, g)), ("fn", F.array_except(g, p)))])
    return prf(c)


def score_deltas(full: DataFrame, other: DataFrame, scores: Sequence[str], key: str = "report_id") -> DataFrame:
    """Mean absolute difference of each score; null counts as 0."""
    both = full.select(key, *[F.coalesce(F.col(s), F.lit(0.0)).alias(f"a_{s}") for s in scores]).join(other.select(key, *[F.coalesce(F.col(s), F.lit(0.0)).alias(f"b_{s}") for s in scores]), key)
    return both.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.abs(F.col(f"a_{s}") - F.col(f"b_{s}"))), 4).alias(s) for s in scores])


def label_flips(full: DataFrame, other: DataFrame, fields: Sequence[str] = FIELDS, key: str = "report_id") -> DataFrame:
    """Share of rows whose label differs; two nulls are equal."""
    both = full.select(key, *[F.col(f).alias(f"a_{f}") for f in fields]).join(other.select(key, *[F.col(f).alias(f"b_{f}") for f in fields]), key)
    return both.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).cast("int")), 4).alias(f) for f in fields])


def confidence_accuracy(rows: DataFrame) -> DataFrame:
    """rows (confidence, all_correct) -> n and accuracy by confidence level; unknown levels are medium."""
    level = F.when(F.col("confidence").isin("low", "medium", "high"), F.col("confidence")).otherwise("medium")
    return rows.groupBy(level.alias("confidence")).agg(F.count(F.lit(1)).alias("n"), ratio(F.sum(F.col("all_correct").cast("int")), F.count(F.lit(1))).alias("accuracy"))


def confidence_correlation(rows: DataFrame) -> DataFrame:
    level = F.when(F.col("confidence") == "low", 1.0).when(F.col("confidence") == "high", 3.0).otherwise(2.0)
    return rows.select(level.alias("x"), F.col("all_correct").cast("double").alias("y")).agg(F.round(F.coalesce(pearson("x", "y"), F.lit(0.0)), 4).alias("correlation"))


def phenomenon_errors(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """For each label: support, P, R, rates, the most common confusion (ties: first in the labels' order), 5 example ids."""
    counts = prf(label_counts(pairs))
    order = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("pred"))
    wrong = pairs.where("gold <> pred")
    top = wrong.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")).groupBy("gold").agg(F.max_by("pred", F.struct("n", (-order).alias("o"))).alias("confused_with"))
    # ids are kept as the five least by a bounded rank, not by gathering a label's errors
    from pyspark.sql.window import Window

    ranked = wrong.withColumn("_r", F.row_number().over(Window.partitionBy("gold").orderBy("report_id"))).where("_r <= 5")
    ids = ranked.groupBy("gold").agg(F.array_join(F.sort_array(F.collect_list("report_id")), ",").alias("examples"))
    out = counts.join(top.withColumnRenamed("gold", "label"), "label", "left").join(ids.withColumnRenamed("gold", "label"), "label", "left")
    return out.select("label", "support", "precision", "recall", ratio(F.col("fp"), F.col("fp") + F.col("tp")).alias("fp_rate"), ratio(F.col("fn"), F.col("fn") + F.col("tp")).alias("fn_rate"), "confused_with", "examples")


def stage_costs(events: DataFrame, price_in: float = 0.001, price_out: float = 0.003) -> DataFrame:
    """events (stage, latency, input_tokens, output_tokens, failed) -> calls, means, failure rate and cost of each stage."""
    cost = F.sum("input_tokens") / 1000.0 * price_in + F.sum("output_tokens") / 1000.0 * price_out
    return events.groupBy("stage").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.avg("latency"), 4).alias("mean_latency"), F.round(F.avg("input_tokens"), 4).alias("mean_input"), F.round(F.avg("output_tokens"), 4).alias("mean_output"),
        F.round(F.avg(F.col("failed").cast("int")), 4).alias("failure_rate"), F.round(cost, 6).alias("cost"),
    )


def joint_objective(metrics: dict[str, Column], weights: dict[str, float]) -> Column:
    """A weighted sum of metrics; a missing one counts as 0."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.coalesce(metrics[name], F.lit(0.0)) * w
    return F.round(out, 6)


# fixed values: the weights of the joint objective
OBJECTIVE = {"strategic_f1": 0.35, "phenomenon_f1": 0.20, "evidence_f1": 0.10, "mean_rank_ic_20": 0.15, "ls_sharpe_20": 0.15, "ece": -0.15}
COMPARED = ("strategic_f1", "evidence_f1", "ece", "mean_rank_ic_20", "ls_sharpe_20", "turnover")


def table_digests(rows: DataFrame, by: str) -> DataFrame:
    """For each setting a digest of its rows that does not depend on their order: n, rows_xor, rows_sum."""
    own = sorted(c for c in rows.columns if c != by)
    digest = F.md5(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}))
    part = lambda n: F.conv(F.substring(digest, 1, n), 16, 10).cast("long")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(part(15)).alias("rows_xor"), F.sum(part(8)).alias("rows_sum"))


def registry(metrics: DataFrame, digests: DataFrame, full: str, weights: dict[str, float] = OBJECTIVE) -> DataFrame:
    """metrics (setting, and the metrics; missing ones null) with composite_j and same_as_full: whether a setting's table has
    the digest of the full one's. A setting without a table is not the same."""
    named = digests.select("setting", F.struct("n", "rows_xor", "rows_sum").alias("digest"))
    whole = digests.where(F.col("setting") == full).select(F.struct("n", "rows_xor", "rows_sum").alias("__full"))  # one row
    j = joint_objective({m: F.col(m) for m in weights}, weights)
    out = metrics.join(named, "setting", "left").join(whole, F.lit(True), "left")
    same = F.coalesce(F.col("digest") == F.col("__full"), F.lit(False)) & (F.col("setting") != full)
    return out.select(*metrics.columns, j.alias("composite_j"), F.col("digest").isNotNull().alias("has_table"), same.alias("same_as_full"))


def equal_metrics(metrics: DataFrame, fields: Sequence[str] = COMPARED) -> DataFrame:
    """(field, value, settings, n) of each value of a metric that several settings share; a missing metric is a value too."""
    each = metrics.select("setting", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])).alias("x")).select("setting", "x.*")
    groups = each.groupBy("field", "value").agg(F.array_join(F.array_sort(F.collect_list("setting")), ",").alias("settings"), F.count(F.lit(1)).alias("n"))  # a row a setting
    return groups.where("n > 1")
