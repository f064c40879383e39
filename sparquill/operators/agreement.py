"""Agreement of annotators. Ratings are long: (item_id, rater, label or score); missing ones are absent or null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions.text import char_tokens


def pairs_of(ratings: DataFrame, first: int, second: int, value: str = "label") -> DataFrame:
    """(item_id, a, b) of items that both raters have."""
    side = lambda r, x: ratings.where(F.col("rater") == r).select("item_id", F.col(value).alias(x))
    return side(first, "a").join(side(second, "b"), "item_id")


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """(observed - expected) / (1 - expected), rounded to 4; 1 or 0 where expected is 1. A null counts as a label."""
    named = pairs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in ("a", "b")])
    n = named.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    marginal = n.select(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).alias("nb")).union(n.select("b", F.lit(0), "n")).groupBy("label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    expected = marginal.agg(F.sum(F.col("na") * F.col("nb")).cast("double").alias("e"), F.sum("na").cast("double").alias("total"))
    observed = n.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("o"))
    e, o = F.col("e") / (F.col("total") * F.col("total")), F.col("o") / F.col("total")
    return expected.crossJoin(observed).select(  # two single rows
        F.col("total").cast("long").alias("n"), F.round(o, 4).alias("agreement"),
        F.round(F.when(F.abs(1 - e) < 1e-12, F.when(o >= 1, 1.0).otherwise(0.0)).otherwise((o - e) / (1 - e)), 4).alias("kappa"),
    )


def _patterns(rated: DataFrame) -> DataFrame:
    """(item_id, v) -> (cells, m, items): how many items have the same counts of values; cells: (v, n) of each value, m: ratings.

    An item's values are gathered as an array of its raters' alone; the patterns, not the items, go on.
    """
    item = rated.groupBy("item_id").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    pattern = item.groupBy("vs").agg(F.count(F.lit(1)).alias("items"))
    cells = F.transform(F.array_distinct("vs"), lambda v: F.struct(v.alias("v"), F.size(F.filter("vs", lambda x: x == v)).cast("long").alias("n")))
    return pattern.select(cells.alias("cells"), F.size("vs").cast("long").alias("m"), "items")


def fleiss_kappa(ratings: DataFrame, raters: int) -> DataFrame:
    """For items that all raters have."""
    item = _patterns(ratings.where("label is not null").select("item_id", F.col("label").alias("v"))).where(F.col("m") == raters)
    share = item.select("items", F.explode("cells").alias("c")).groupBy("c.v").agg(F.sum(F.col("c.n") * F.col("items")).alias("n"))
    item = item.withColumn("sq", F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + c["n"] * c["n"]))
    agreeing = F.sum((F.col("sq") - raters) * F.col("items")).cast("double") / F.sum("items") / float(raters * (raters - 1))
    p = item.agg(F.coalesce(F.sum("items"), F.lit(0)).cast("long").alias("items"), agreeing.alias("p"))
    e = share.agg((F.sum(F.col("n") * F.col("n")).cast("double") / (F.sum("n").cast("double") * F.sum("n").cast("double"))).alias("e"))
    return p.crossJoin(e).select("items", F.round(F.when(F.abs(1 - F.col("e")) < 1e-12, F.when(F.col("p") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("p") - F.col("e")) / (1 - F.col("e"))), 4).alias("kappa"))


def krippendorff(ratings: DataFrame, value: str, interval: bool = False) -> DataFrame:
    """Alpha over items with two ratings or more, with agreeing pairs counted twice, as the reports of this method are made.

    Of an item with m ratings each ordered pair weighs 1 / (m - 1); the labels' shares are the sums of these pairs. interval: disagreement is the squared difference.
    """
    rated = ratings.where(F.col(value).isNotNull()).select("item_id", F.col(value).alias("v"))
    item = _patterns(rated).where("m >= 2")
    # pairs of an item's distinct values: at most the number of raters squared
    pair = item.select("m", "items", F.explode("cells").alias("x"), "cells").select("m", "items", "x", F.explode("cells").alias("y"))
    same = F.col("x.v") == F.col("y.v")
    count = F.when(same, F.col("x.n") * (F.col("x.n") - 1) * 2).otherwise(F.col("x.n") * F.col("y.n")) / (F.col("m") - 1) * F.col("items")
    o = pair.groupBy(F.col("x.v").alias("a"), F.col("y.v").alias("b")).agg(F.sum(count).alias("o"))
    d = (F.pow(F.col("a").cast("double") - F.col("b").cast("double"), F.lit(2.0))) if interval else (F.col("a") != F.col("b")).cast("double")
    n_c = o.groupBy(F.col("a").alias("v")).agg(F.sum("o").alias("n"))
    other = n_c.toDF("w", "k")
    d2 = (F.pow(F.col("v").cast("double") - F.col("w").cast("double"), F.lit(2.0))) if interval else (F.col("v") != F.col("w")).cast("double")
    expected = n_c.crossJoin(other).agg(F.sum(F.col("n") * F.col("k") * d2).alias("e"), F.sum(F.col("n") * F.col("k")).alias("total"))  # one row for each pair of labels
    observed = o.agg((F.sum(F.col("o") * d) / F.sum("o")).alias("do"))
    flat = F.when(F.col("do") > 1e-12, 0.0).otherwise(1.0)  # no disagreement is expected
    alpha = F.when(F.col("total").isNull(), 0.0).when(F.col("e") > 1e-12, 1 - F.col("do") / F.try_divide(F.col("e"), F.col("total"))).otherwise(flat)
    return observed.crossJoin(expected).select(F.round(alpha, 4).alias("alpha"))


def adjudicate(a: Column, b: Column, c: Column) -> Column:
    """The majority label of three; without one, the first that is there."""
    return F.when(a.isNotNull() & (a.eqNullSafe(b) | a.eqNullSafe(c)), a).when(b.isNotNull() & b.eqNullSafe(c), b).otherwise(F.coalesce(a, b, c))


def median_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.element_at(F.sort_array(F.array(a, b, c)), 2)


# fixed values: confidences in order
CONFIDENCE = ("low", "medium", "high")


def clean_spans(spans: Column) -> Column:
    """Spans' texts, trimmed, without empty ones; null has none."""
    return F.filter(F.transform(F.coalesce(spans, F.expr("cast(array() as array<string>)")), lambda x: F.trim(x)), lambda x: x != "")


def adjudicated(items: DataFrame, fields: Sequence[str], a: str = "a", b: str = "b", c: str | None = None) -> DataFrame:
    """items (structs a, b and perhaps c of the fields, evidence_spans and annotation_confidence) with `resolved`, a struct.

    Of three, each label is the majority's, without one the first's; of two, the first's, and what they differ in stands
    in unresolved. A missing label is a label like any other. Spans are the ordered union of all (of two that agree, the
    first's as they stand). Confidence is the median of three or the lower of two; what is none counts as low.
    """
    of = lambda who, f: F.col(f"{who}.{f}")

    def label(f: str) -> Column:
        x, y = of(a, f), of(b, f)
        if c is None:
            return x
        z = of(c, f)
        return F.when(x.eqNullSafe(y) | x.eqNullSafe(z), x).when(y.eqNullSafe(z), y).otherwise(x)

    who = [a, b] if c is None else [a, b, c]
    spans = [clean_spans(of(w, "evidence_spans")) for w in who]
    union = F.array_distinct(F.concat(*spans))
    if c is None:
        union = F.when(spans[0] == spans[1], spans[0]).otherwise(union)
    place = lambda w: F.greatest(F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE]), F.coalesce(of(w, "annotation_confidence"), F.lit(""))), F.lit(1))
    order = F.sort_array(F.array(*[place(w) for w in who]))
    confidence = F.element_at(F.array(*[F.lit(x) for x in CONFIDENCE]), F.element_at(order, 1 if c is None else 2).cast("int"))
    unresolved = F.array_compact(F.array(*[F.when(~of(a, f).eqNullSafe(of(b, f)), F.lit(f)) for f in fields])) if c is None else F.expr("cast(array() as array<string>)")
    return items.withColumn("resolved", F.struct(*[label(f).alias(f) for f in fields], union.alias("evidence_spans"), confidence.alias("annotation_confidence"), unresolved.alias("unresolved")))


def side_by_side(annotations: DataFrame, raters: Sequence, columns: Sequence[str], key: str = "item_id", order: str | None = None) -> DataFrame:
    """annotations (key, rater, columns) -> one row for each item, a struct of columns for each rater, r0, r1, ..., null where
    a rater has not got the item. Of rows that a rater repeats the last in order counts (one of them without an order)."""
    own = F.struct(*columns)
    pick = lambda r: F.max_by(F.when(F.col("rater") == r, own), F.when(F.col("rater") == r, F.col(order))) if order else F.any_value(F.when(F.col("rater") == r, own), ignoreNulls=True)
    return annotations.where(F.col("rater").isin(*raters)).groupBy(key).agg(*[pick(r).alias(f"r{i}") for i, r in enumerate(raters)])


def human_evaluation(evals: DataFrame, yes_no: str = "factual_preservation", scores: Sequence[str] = ("faithfulness", "tone_removal"), key: str = "report_id", order: str = "line") -> DataFrame:
    """A row for all ('all') and one for each phenomenon: items, yes_rate of a yes/no question, and of each score n, mean, std.

    evals: rater (in their order), key, order, gold_phenomenon, pred_phenomenon, and the answers as text. Of an item's rows of
    one rater the last counts; an item's phenomenon is that of its first rater's gold, else prediction, else 'unknown'. A
    score that is no number does not count; deviations are of the population; a rate of nothing is 0.
    """
    answers = [yes_no, *scores]
    last = evals.groupBy(key, "rater").agg(F.max_by(F.struct("gold_phenomenon", "pred_phenomenon", *answers), order).alias("x")).select(key, "rater", "x.*")
    named = F.coalesce(F.nullif(F.col("gold_phenomenon"), F.lit("")), F.nullif(F.col("pred_phenomenon"), F.lit("")), F.lit("unknown"))
    first = last.groupBy(key).agg(F.min_by(named, "rater").alias("phenomenon"))
    each = last.select(key, *answers).join(first, key).withColumn("scope", F.explode(F.array(F.lit("all"), "phenomenon")))
    yes = F.count(F.when(F.lower(F.trim(yes_no)) == "yes", 1))
    share = F.round(F.coalesce(F.try_divide(yes.cast("double"), F.count(yes_no).cast("double")), F.lit(0.0)), 4)
    made = []
    for s in scores:
        x = F.col(s).try_cast("double")
        made += [F.count(x).alias(f"{s}_n"), F.round(F.coalesce(F.avg(x), F.lit(0.0)), 4).alias(f"{s}_mean"), F.round(F.coalesce(F.stddev_pop(x), F.lit(0.0)), 4).alias(f"{s}_std")]
    return each.groupBy("scope").agg(F.countDistinct(key).alias("items"), share.alias("yes_rate"), *made)


def char_overlap(a_spans: Column, b_spans: Column) -> dict[str, Column]:
    """Precision, recall and F1 of the sets of characters of two annotators' spans; both empty give 1."""
    a, b = char_tokens(a_spans), char_tokens(b_spans)
    both, none = F.size(F.array_intersect(a, b)), (F.size(a) == 0) & (F.size(b) == 0)
    p = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(both.cast("double"), F.size(b).cast("double")), F.lit(0.0)))
    r = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(both.cast("double"), F.size(a).cast("double")), F.lit(0.0)))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def human_summary(ratings: DataFrame) -> DataFrame:
    """ratings (item_id, rater, score as text or number): n, mean and population deviation of the valid scores by rater."""
    s = F.col("score").try_cast("double")
    return ratings.groupBy("rater").agg(F.count(s).alias("n"), F.round(F.avg(s), 4).alias("mean_score"), F.round(F.coalesce(F.stddev_pop(s), F.lit(0.0)), 4).alias("std_score"))
