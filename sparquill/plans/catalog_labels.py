"""Named queries of label evaluation, agreement, scoring, sampling and checks, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import agreement, cleaning, evaluation, sampling, scoring, signals
from sparquill.plans import adapters as A
from sparquill.plans.catalog import LATIN, SQL, query, sql_hits

GP = "WITH " + A.ctes("v_gold", "v_predictions") + """,
pairs AS (SELECT p.report_id, g.phenomenon AS gold, p.phenomenon AS pred, p.uncertainty, g.annotation_confidence AS confidence,
  g.phenomenon = p.phenomenon AND g.fundamental_sentiment = p.fundamental_sentiment AND g.strategic_optimism = p.strategic_optimism AS all_correct
  FROM v_predictions p JOIN v_gold g USING (report_id))"""
COUNTS = """,
counts AS (
  SELECT label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, CAST(sum(sup) AS BIGINT) AS support FROM (
    SELECT gold AS label, CASE WHEN gold = pred THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN gold = pred THEN 0 ELSE 1 END AS fn, 1 AS sup FROM pairs
    UNION ALL SELECT pred, 0, CASE WHEN gold = pred THEN 0 ELSE 1 END, 0, 0 FROM pairs) GROUP BY 1),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp::DOUBLE / (tp + fp), 4) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp::DOUBLE / (tp + fn), 4) END AS r FROM counts),
f1s AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE round(2 * p * r / (p + r), 4) END AS f1 FROM pr)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.matched(A.predictions(spark, sf), A.gold(spark, sf), "phenomenon")


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    g = A.gold(spark, sf).select("report_id", F.col("annotation_confidence").alias("confidence"), *[F.col(f).alias(f"g_{f}") for f in evaluation.FIELDS])
    rows = A.predictions(spark, sf).join(g, "report_id")
    right = F.lit(True)
    for f in evaluation.FIELDS:
        right = right & (F.col(f) == F.col(f"g_{f}"))
    return rows.withColumn("all_correct", right)


@query("macro_f1", GP + COUNTS + " SELECT round(coalesce(avg(f1), 0), 4) AS macro_f1, count(*) AS labels FROM f1s")
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.macro_f1(_pairs(spark, sf))


@query("label_scores", GP + COUNTS + " SELECT label, support, p AS \"precision\", r AS recall, f1 FROM f1s")
def label_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.prf(evaluation.label_counts(_pairs(spark, sf))).select("label", "support", "precision", "recall", "f1")


@query("confusion_matrix", GP + f""", l AS (SELECT unnest({A._LIST(A.PHENOMENA)}) AS x)
SELECT a.x AS gold, b.x AS pred, (SELECT count(*) FROM pairs WHERE gold = a.x AND pred = b.x) AS n FROM l a, l b""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion(_pairs(spark, sf), A.PHENOMENA)


@query("label_errors", GP + " SELECT CASE WHEN gold = pred THEN 'correct' WHEN gold = 'none' THEN 'false_positive' WHEN pred = 'none' THEN 'false_negative' ELSE 'misclassification' END AS kind, count(*) AS n FROM pairs GROUP BY 1")
def label_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).groupBy(evaluation.error_kinds().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("accuracy_by_gold", GP + " SELECT gold, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM pairs GROUP BY 1")
def accuracy_by_gold(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.accuracy_by_gold(_pairs(spark, sf))


BINS = """, bins AS (SELECT CAST(greatest(0, least(9, CAST(trunc((1 - uncertainty) * 10) AS INT))) AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM pairs GROUP BY 1)"""


def _bins(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.calibration(_joined(spark, sf).select("uncertainty", (F.col("phenomenon") == F.col("g_phenomenon")).alias("correct")))


@query("calibration_bins", GP + BINS + " SELECT bin, n, accuracy, round((bin + 0.5) / 10, 4) AS centre FROM bins")
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _bins(spark, sf)


@query("ece", GP + BINS + " SELECT round(sum(abs(round((bin + 0.5) / 10, 4) - accuracy) * n) / sum(n), 4) AS ece FROM bins")
def ece(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.expected_calibration_error(_bins(spark, sf))


@query("evidence_prf", """WITH s AS (SELECT doc_id, list_distinct(list_filter(string_split(text, ' '), lambda x, i: i % 2 = 1)) AS g, list_distinct(list_filter(string_split(text, ' '), lambda x, i: (i - 1) % 3 <> 0)) AS p FROM documents),
c AS (SELECT CAST(sum(len(list_intersect(g, p))) AS BIGINT) AS tp, CAST(sum(len(list_filter(p, lambda x: NOT list_contains(g, x)))) AS BIGINT) AS fp, CAST(sum(len(list_filter(g, lambda x: NOT list_contains(p, x)))) AS BIGINT) AS fn FROM s),
pr AS (SELECT *, round(tp::DOUBLE / (tp + fp), 4) AS p, round(tp::DOUBLE / (tp + fn), 4) AS r FROM c)
SELECT tp, fp, fn, p AS "precision", r AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM pr""")
def evidence_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Spans are words of the whole text: those at even places against those at places that three does not divide."""
    w = F.split("text", " ")
    return evaluation.span_prf(A.table(spark, sf, "documents").select(F.filter(w, lambda x, i: i % 2 == 0).alias("gold_spans"), F.filter(w, lambda x, i: i % 3 != 0).alias("pred_spans")))


@query("score_deltas", "WITH " + A.ctes("v_predictions") + " SELECT count(*) AS n, round(avg(abs(coalesce(uncertainty, 0) - round(uncertainty * 0.9, 4))), 4) AS uncertainty, round(avg(abs(coalesce(strategic_optimism_gap, 0) - CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE strategic_optimism_gap END)), 4) AS strategic_optimism_gap FROM v_predictions")
def score_deltas(spark: SparkSession, sf: str) -> DataFrame:
    p = A.predictions(spark, sf)
    other = p.select("report_id", F.round(F.col("uncertainty") * 0.9, 4).alias("uncertainty"), F.when(F.col("l_orderkey") % 3 != 0, F.col("strategic_optimism_gap")).alias("strategic_optimism_gap"))
    return evaluation.score_deltas(p, other, ["uncertainty", "strategic_optimism_gap"])


@query("label_flips", "WITH " + A.ctes("v_gold", "v_predictions") + " SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN p.{f} IS DISTINCT FROM g.{f} THEN 1.0 ELSE 0.0 END), 4) AS {f}" for f in evaluation.FIELDS) + " FROM v_predictions p JOIN v_gold g USING (report_id)")
def label_flips(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.label_flips(A.predictions(spark, sf), A.gold(spark, sf))


@query("confidence_accuracy", GP + " SELECT confidence, count(*) AS n, round(avg(CASE WHEN all_correct THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM pairs GROUP BY 1")
def confidence_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confidence_accuracy(_joined(spark, sf))


@query("confidence_correlation", GP + """, x AS (SELECT CASE confidence WHEN 'low' THEN 1.0 WHEN 'high' THEN 3.0 ELSE 2.0 END AS x, CASE WHEN all_correct THEN 1.0 ELSE 0.0 END AS y FROM pairs)
SELECT round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 4) AS correlation FROM x""")
def confidence_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confidence_correlation(_joined(spark, sf))


@query("phenomenon_errors", GP + COUNTS + f""", w AS (SELECT gold, pred, count(*) AS n, list_position({A._LIST(A.PHENOMENA)}, pred) AS o FROM pairs WHERE gold <> pred GROUP BY 1, 2),
t AS (SELECT gold, pred AS confused_with FROM w QUALIFY row_number() OVER (PARTITION BY gold ORDER BY n DESC, o) = 1),
e AS (SELECT gold, string_agg(report_id, ',' ORDER BY report_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY report_id) AS rn FROM pairs WHERE gold <> pred) WHERE rn <= 5 GROUP BY 1)
SELECT label, support, p AS "precision", r AS recall, CASE WHEN fp + tp = 0 THEN 0.0 ELSE round(fp::DOUBLE / (fp + tp), 4) END AS fp_rate, CASE WHEN fn + tp = 0 THEN 0.0 ELSE round(fn::DOUBLE / (fn + tp), 4) END AS fn_rate, confused_with, examples
FROM f1s LEFT JOIN t ON t.gold = label LEFT JOIN e ON e.gold = label""")
def phenomenon_errors(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.phenomenon_errors(_pairs(spark, sf), A.PHENOMENA)


STAGE = "WITH e AS (SELECT event_type AS stage, value AS latency, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query("stage_cost", STAGE + """ SELECT stage, count(*) AS calls, round(avg(latency), 4) AS mean_latency, round(avg(k), 4) AS mean_input, round(avg(k * 2), 4) AS mean_output,
  round(avg(CASE WHEN stage = 'error' OR k % 10 = 0 THEN 1.0 ELSE 0.0 END), 4) AS failure_rate, round(sum(k) / 1000.0 * 0.001 + sum(k * 2) / 1000.0 * 0.003, 6) AS cost FROM e GROUP BY 1""")
def stage_cost(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = A.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("latency"), k.alias("input_tokens"), (k * 2).alias("output_tokens"), ((F.col("event_type") == "error") | (k % 10 == 0)).alias("failed"))
    return evaluation.stage_costs(e)


# ---------------------------------------------------------------- agreement

R = "WITH " + A.ctes("v_ratings")


@query("cohen_kappa", R + """, ab AS (SELECT a.item_id, a.label AS a, b.label AS b FROM v_ratings a JOIN v_ratings b ON a.item_id = b.item_id AND a.rater = 0 AND b.rater = 1),
t AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END)::DOUBLE AS o FROM ab), ma AS (SELECT a AS l, count(*) AS n FROM ab GROUP BY 1), mb AS (SELECT b AS l, count(*) AS n FROM ab GROUP BY 1),
e AS (SELECT sum(ma.n * mb.n)::DOUBLE AS e FROM ma JOIN mb USING (l))
SELECT CAST(n AS BIGINT) AS n, round(o / n, 4) AS agreement, round((o / n - e / (n * n)) / (1 - e / (n * n)), 4) AS kappa FROM t, e""")
def cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.cohen_kappa(agreement.pairs_of(A.ratings(spark, sf), 0, 1))


@query("fleiss_kappa", R + """, c AS (SELECT item_id, label, count(*) AS n FROM v_ratings GROUP BY 1, 2), i AS (SELECT item_id, sum(n) AS m, sum(n * n) AS sq FROM c GROUP BY 1 HAVING sum(n) = 3),
s AS (SELECT label, sum(n)::DOUBLE AS n FROM c WHERE item_id IN (SELECT item_id FROM i) GROUP BY 1), e AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS e FROM s), p AS (SELECT count(*) AS items, avg((sq - 3) / 6.0::DOUBLE) AS p FROM i)
SELECT items, round((p - e) / (1 - e), 4) AS kappa FROM p, e""")
def fleiss_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.fleiss_kappa(A.ratings(spark, sf), 3)


def _alpha_sql(value: str, d: str) -> str:
    return R + f""", v AS (SELECT item_id, rater, {value} AS v FROM v_ratings), m AS (SELECT item_id, count(*) AS m FROM v GROUP BY 1 HAVING count(*) >= 2),
o AS (SELECT a.v AS x, b.v AS y, sum((CASE WHEN a.v = b.v THEN 2 ELSE 1 END)::DOUBLE / (m - 1)) AS o FROM v a JOIN v b ON a.item_id = b.item_id AND a.rater <> b.rater JOIN m ON m.item_id = a.item_id GROUP BY 1, 2),
n AS (SELECT x, sum(o) AS n FROM o GROUP BY 1),
e AS (SELECT sum(a.n * b.n * {d.replace('$x', 'a.x').replace('$y', 'b.x')}) / sum(a.n * b.n) AS e FROM n a, n b)
SELECT round(1 - (SELECT sum(o * {d.replace('$x', 'x').replace('$y', 'y')}) / sum(o) FROM o) / e, 4) AS alpha FROM e"""


@query("krippendorff_nominal", _alpha_sql("label", "(CASE WHEN $x = $y THEN 0 ELSE 1 END)"))
def krippendorff_nominal(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.krippendorff(A.ratings(spark, sf), "label")


@query("krippendorff_interval", _alpha_sql("score", "(($x - $y) * ($x - $y))"))
def krippendorff_interval(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.krippendorff(A.ratings(spark, sf), "score", interval=True)


@query("adjudicate", R + """, w AS (SELECT item_id, max(CASE WHEN rater = 0 THEN label END) AS a, max(CASE WHEN rater = 1 THEN label END) AS b, max(CASE WHEN rater = 2 THEN label END) AS c FROM v_ratings GROUP BY 1)
SELECT item_id, CASE WHEN a IS NOT NULL AND (a = b OR a = c) THEN a WHEN b = c THEN b ELSE coalesce(a, b, c) END AS label FROM w""")
def adjudicate(spark: SparkSession, sf: str) -> DataFrame:
    # dealt before the grouping, which sorts for its texts: once, where the items' ratings meet
    w = A.ratings(spark, sf).repartition("item_id").groupBy("item_id").pivot("rater", [0, 1, 2]).agg(F.max("label"))
    return w.select("item_id", agreement.adjudicate(F.col("0"), F.col("1"), F.col("2")).alias("label"))


@query("rater_summary", R + " SELECT CAST(rater AS BIGINT) AS rater, count(score) AS n, round(avg(score), 4) AS mean_score, round(stddev_pop(score), 4) AS std_score FROM v_ratings GROUP BY 1")
def rater_summary(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.human_summary(A.ratings(spark, sf)).withColumn("rater", F.col("rater").cast("long"))


@query("char_overlap", r"""WITH s AS (SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: i % 2 = 1), ''), '[ \t\r\n]', '', 'g'), ''), lambda x: x <> '')) AS a,
  list_distinct(list_filter(string_split(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: (i - 1) % 3 <> 0), ''), '[ \t\r\n]', '', 'g'), ''), lambda x: x <> '')) AS b FROM documents),
k AS (SELECT *, len(list_intersect(a, b))::DOUBLE AS i FROM s), pr AS (SELECT doc_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(b) = 0 THEN 0.0 ELSE i / len(b) END AS p, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 THEN 0.0 ELSE i / len(a) END AS r FROM k)
SELECT doc_id, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr""")
def char_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Spans are lines of the whole text: those at even places against those at places that three does not divide."""
    lines = F.split("text", "\n")
    made = agreement.char_overlap(F.filter(lines, lambda x, i: i % 2 == 0), F.filter(lines, lambda x, i: i % 3 != 0))
    return A.table(spark, sf, "documents").select("doc_id", *[F.round(c, 6).alias(n) for n, c in made.items()])


# ---------------------------------------------------------------- scoring

_TXT = "(title || chr(10) || summary)"


_LONG = "len(list_filter(string_split(summary, ' '), lambda x: length(x) {} AND trim(x) <> ''))"


def _to4(x: str) -> str:
    """Four digits, half up on the double's shortest decimal form, as Spark rounds."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE)"


_FLAGS = ", ".join(f"('{name}', {', '.join(str(x).upper() for x in (f.retrieval, f.neutralizer, f.verifier, f.gate, f.prior))})" for name, f in scoring.VARIANTS.items())


@query("ablation_variants", "WITH " + A.ctes("v_docs") + f""", labels AS ({SQL["rule_labels"]}), flags(variant, retrieval, neutralizer, verifier, gate, prior) AS (VALUES {_FLAGS}),
d AS (SELECT doc_id, title, summary, fundamental_sentiment, strategic_optimism, phenomenon AS found, {sql_hits(_TXT, LATIN.hedges)} AS hedges, {sql_hits(_TXT, LATIN.risks)} AS risks, {sql_hits('summary', LATIN.risks)} AS beyond,
    {_LONG.format('>= 14')} AS cues, {_LONG.format('= 13')} AS risk_cues, CASE WHEN doc_id % 3 = 0 THEN {_LONG.format('= 12')} ELSE 0 END AS missing,
    CASE WHEN summary = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, len(list_filter(string_split(summary, chr(10)), lambda x: trim(x) <> '')) / 5.0::DOUBLE) END AS covered,
    (doc_id % 10)::DOUBLE / 10.0::DOUBLE AS consistency, doc_id % 5 = 0 AS failed,
    least(0.6::DOUBLE, greatest(0.2::DOUBLE, CASE WHEN doc_id % 5 = 0 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN doc_id % 7 = 0 THEN 0.35::DOUBLE ELSE 0 END)) AS penalty
  FROM v_docs JOIN labels USING (doc_id)),
e AS (SELECT *, CASE fundamental_sentiment WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS fact,
    CASE strategic_optimism WHEN 'high' THEN 1.0::DOUBLE WHEN 'low' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS raw,
    neutralizer AND NOT failed AND doc_id % 2 = 0 AND replace(summary, 'th', '') NOT IN ('', summary) AS active,
    CASE WHEN retrieval THEN covered ELSE 1.0::DOUBLE END AS coverage,
    {_to4("least(1.0::DOUBLE, 0.15::DOUBLE * hedges + 0.2::DOUBLE * cues)")} AS hedge_score,
    CASE WHEN retrieval THEN {_to4("least(1.0::DOUBLE, 0.08::DOUBLE * greatest(0, beyond - risks) + 0.1::DOUBLE * risk_cues + 0.18::DOUBLE * missing)")} ELSE 0.0::DOUBLE END AS omission_penalty
  FROM d CROSS JOIN flags),
f AS (SELECT *, CASE WHEN active THEN fact ELSE raw END AS counterfactual_score,
    {_to4("CASE WHEN NOT verifier THEN (own + (1 - coverage)) / 2 WHEN failed THEN (own + (1 - consistency) + penalty + (1 - coverage)) / 4 ELSE (own + (1 - consistency) + (1 - coverage)) / 3 END")} AS u
  FROM (SELECT *, 0.45::DOUBLE AS own FROM e)),
g AS (SELECT *, {_to4("raw - counterfactual_score + hedge_score + omission_penalty")} AS gap, greatest(0.7::DOUBLE, 1 - 0.45::DOUBLE * u) AS base FROM f),
h AS (SELECT *, {_to4("least(1.0::DOUBLE, CASE WHEN NOT verifier THEN base WHEN failed THEN least(base, greatest(0.2::DOUBLE, 0.5::DOUBLE * consistency)) ELSE greatest(base, 0.25::DOUBLE + 0.75::DOUBLE * consistency) END)")} AS confidence FROM g),
i AS (SELECT *, CASE WHEN prior THEN gated ELSE {_to4("0.6::DOUBLE * gated")} END AS effective FROM (SELECT *, CASE WHEN gate THEN gap * confidence ELSE gap END AS gated FROM h)),
j AS (SELECT *, {_to4("fact - 0.85::DOUBLE * effective")} AS composite_score FROM i)
SELECT doc_id, variant, fact AS sentiment_score, counterfactual_score, hedge_score, omission_penalty, gap AS strategic_optimism_gap, coverage AS retrieval_coverage, u AS uncertainty, confidence AS penalty_confidence,
  {_to4("fact - effective")} AS gated_score, composite_score, {_to4("0.7::DOUBLE * composite_score + 0.3::DOUBLE * fact")} AS blend_score,
  CASE WHEN NOT retrieval AND found = 'hedged_downside' THEN 'none' ELSE found END AS phenomenon FROM j""")
def ablation_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every document under each set of flags, from labels by lexicon and stage outputs made from the text."""
    from sparquill.functions import lexicon as L

    d = A.docs(spark, sf)
    words = F.split("summary", " ")
    decomposition = F.struct(F.filter(words, lambda x: F.length(x) >= 14).alias("hedge_cues"), F.filter(words, lambda x: F.length(x) == 13).alias("risk_cues"), F.when(F.col("doc_id") % 3 == 0, F.filter(words, lambda x: F.length(x) == 12)).otherwise(F.array().cast("array<string>")).alias("missing_risk_hints"))
    neutral = F.struct(F.regexp_replace("summary", "th", "").alias("neutralized_text"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("th"))).otherwise(F.array().cast("array<string>")).alias("removed_rhetoric"))
    verifier = F.struct((F.col("doc_id") % 5 != 0).alias("numbers_preserved"), F.lit(True).alias("entities_preserved"), (F.col("doc_id") % 7 != 0).alias("no_new_facts"), (F.col("doc_id") % 10 / 10.0).alias("factual_consistency"), F.when(F.col("doc_id") % 5 == 0, "fail").otherwise("pass").alias("verdict"))
    found = scoring.measures(F.col("title"), F.col("summary"), F.col("summary"), decomposition, neutral, verifier, LATIN)
    counts = L.rule_hits(F.col("title"), F.col("summary"), LATIN)
    # texts are looked at once, before the variants: as plain columns, since fields of a struct are put back where they are used
    rows = d.select("doc_id", verifier.alias("verifier"), *[c.alias(f"hits_{k}") for k, c in counts.items()], *[c.alias(f"found_{k}") for k, c in found.items()])
    labels = L.labels_of({k: F.col(f"hits_{k}") for k in counts})
    rows = rows.select("doc_id", "verifier", *[f"found_{k}" for k in found], *[c.alias(k) for k, c in labels.items()])
    labels, found = {k: F.col(k) for k in labels}, {k: F.col(f"found_{k}") for k in found}
    # an array made before it is exploded, so that what the variants share is computed once; exploding it as an outer one
    # keeps the optimizer from a filter on its size, which would compute all of it once more
    each = [F.struct(F.lit(name).alias("variant"), *[c.alias(k) for k, c in scoring.score_measures(labels, found, F.col("verifier"), flags).items()]) for name, flags in scoring.VARIANTS.items()]
    return rows.select("doc_id", F.array(*each).alias("variants")).select("doc_id", F.explode_outer("variants").alias("x")).select("doc_id", "x.*")


_HEDGE = f"round(least(1.0, 0.15 * {sql_hits(_TXT, LATIN.hedges)} + 0.2 * len(list_filter(string_split(summary, ' '), lambda x: length(x) >= 14))), 4)"


@query("hedge_scores", "WITH " + A.ctes("v_docs") + f""" SELECT doc_id, CAST({_HEDGE} AS DOUBLE) AS hedge_score,
  CAST(round(least(1.0, 0.08 * greatest(0, {sql_hits('summary', LATIN.risks)} - {sql_hits('title', LATIN.risks)}) + 0.1 * len(list_filter(string_split(summary, ' '), lambda x: length(x) = 13))), 4) AS DOUBLE) AS omission_penalty FROM v_docs""")
def hedge_scores(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("summary", " ")
    none = F.array().cast("array<string>")
    text = F.concat("title", F.lit("\n"), "summary")
    return A.docs(spark, sf).select("doc_id", scoring.hedge_score(text, F.filter(w, lambda x: F.length(x) >= 14), LATIN).alias("hedge_score"), scoring.omission_penalty(F.col("title"), F.col("summary"), F.filter(w, lambda x: F.length(x) == 13), none, LATIN).alias("omission_penalty"))


def _struct(col: str, shift: int):
    """A made-up prediction that depends on the id."""
    k = F.col("doc_id") + shift
    pick = lambda values, m: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(k, F.lit(m)) % len(values) + 1).cast("int"))
    return F.struct(
        pick(A.SENTIMENTS, 3).alias("fundamental_sentiment"), pick(["low", "balanced", "high", None], 8).alias("strategic_optimism"), pick(["none", "none", "hedged_downside", "euphemistic_risk"], 4).alias("phenomenon"),
        F.round(F.pmod(k * 7, F.lit(100)) / 100.0, 4).alias("uncertainty"), F.array(F.struct(F.lit(col).alias("text"), F.lit("x").alias("label"))).alias("evidence_spans"),
    ).alias(col)


def _struct_sql(shift: int, p: str) -> str:
    k = f"(doc_id + {shift})"
    return (f"{A._LIST(A.SENTIMENTS)}[CAST({k} % 3 % 3 + 1 AS INT)] AS {p}_s, ['low', 'balanced', 'high', NULL][CAST({k} % 8 % 4 + 1 AS INT)] AS {p}_o, "
            f"['none', 'none', 'hedged_downside', 'euphemistic_risk'][CAST({k} % 4 + 1 AS INT)] AS {p}_p, round(({k} * 7) % 100 / 100.0, 4) AS {p}_u")


@query("route_labels", "WITH " + A.ctes("v_docs") + f""", x AS (SELECT *, {_struct_sql(0, 'd')}, {_struct_sql(1, 'c')}, {_struct_sql(2, 'r')}, {_struct_sql(3, 'l')},
  {sql_hits('summary', LATIN.risks)} AS risk, {sql_hits('summary', LATIN.hedges)} AS hedge, {sql_hits('title', LATIN.optimistic)} AS promise,
  len(list_filter({A._LIST(LATIN.promises)}, lambda t: contains(title, t))) > 0 AND len(list_filter({A._LIST(LATIN.risks)}, lambda t: contains(summary, t))) > 0 AS mismatch FROM v_docs)
SELECT doc_id, r_s AS fundamental_sentiment, CASE WHEN r_o IS NOT NULL AND r_p <> 'none' THEN r_o WHEN c_o IS NOT NULL AND d_o IS NULL THEN c_o WHEN d_o = 'balanced' AND c_o IS NOT NULL AND c_o <> 'balanced' THEN c_o ELSE d_o END AS strategic_optimism,
  CASE WHEN r_p <> 'none' THEN r_p WHEN c_p <> 'none' THEN c_p WHEN d_p <> 'none' THEN d_p WHEN l_p = 'hedged_downside' AND risk > 0 AND (hedge > 0 OR promise > 0) THEN l_p WHEN l_p = 'euphemistic_risk' AND risk > 0 AND promise > 0 THEN l_p WHEN mismatch THEN 'title_body_mismatch' ELSE 'none' END AS phenomenon,
  round(least(r_u, d_u), 4) AS uncertainty FROM x""")
def route_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = A.docs(spark, sf).withColumns({n: _struct(n, i) for i, n in enumerate(("direct", "cot", "react", "rule"))})
    made = scoring.route(F.col("direct"), F.col("cot"), F.col("react"), F.col("rule"), F.col("title"), F.col("summary"), LATIN)
    return d.select("doc_id", *[made[k].alias(k) for k in ("fundamental_sentiment", "strategic_optimism", "phenomenon", "uncertainty")])


@query("refine_labels", """WITH x AS (SELECT doc_id, ['none', 'hedged_downside'][CAST(doc_id % 2 + 1 AS INT)] AS p, ['balanced', 'low', 'high'][CAST(doc_id % 3 + 1 AS INT)] AS o, doc_id % 4 AS m, doc_id % 5 AS r, doc_id % 6 AS z FROM documents),
y AS (SELECT *, CASE WHEN p = 'none' AND m >= 2 THEN 'omitted_downside_context' WHEN p = 'none' AND m >= 1 AND r >= 1 THEN 'hedged_downside' ELSE p END AS p2, CASE WHEN o = 'balanced' AND m >= 2 THEN 'high' ELSE o END AS o2 FROM x)
SELECT doc_id, CASE WHEN p2 = 'none' AND z >= 3 THEN 'euphemistic_risk' ELSE p2 END AS phenomenon, CASE WHEN o2 = 'balanced' AND z >= 2 THEN 'high' ELSE o2 END AS strategic_optimism FROM y""")
def refine_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    items = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: i <= n), lambda i: i.cast("string"))
    p, o = F.when(k % 2 == 0, "none").otherwise("hedged_downside"), F.when(k % 3 == 0, "balanced").when(k % 3 == 1, "low").otherwise("high")
    phenomenon, optimism = scoring.refine(p, o, items(k % 4), items(k % 5), items(k % 6))
    return A.table(spark, sf, "documents").select("doc_id", phenomenon.alias("phenomenon"), optimism.alias("strategic_optimism"))


@query("label_gap", "WITH " + A.ctes("v_predictions") + """ SELECT report_id, round(CASE strategic_optimism WHEN 'high' THEN 1.0 WHEN 'low' THEN -1.0 ELSE 0.0 END - CASE fundamental_sentiment WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END, 4)::DOUBLE AS gap FROM v_predictions""")
def label_gap(spark: SparkSession, sf: str) -> DataFrame:
    return A.predictions(spark, sf).select("report_id", signals.label_gap(F.col("fundamental_sentiment"), F.col("strategic_optimism")).alias("gap"))


# ---------------------------------------------------------------- sampling and checks

_SC = "((doc_id % 1048576 + 42) * 2654435761) % 4294967296"


@query("uniform_sample", f"SELECT doc_id FROM documents ORDER BY {_SC}, doc_id LIMIT 50")
def uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty documents for a second annotator; the number is the feature."""
    return sampling.uniform(A.table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@query("stratified_sample", "WITH " + A.ctes("v_docs") + f""", s AS (SELECT year(report_date) AS y, count(*) AS n, row_number() OVER (ORDER BY year(report_date)) AS i, count(*) OVER () AS k FROM v_docs GROUP BY 1),
q AS (SELECT y, n, least(n, 120 // k + CASE WHEN i <= 120 % k THEN 1 ELSE 0 END) AS q FROM s),
r AS (SELECT doc_id, CAST(year(report_date) AS BIGINT) AS report_year, row_number() OVER (PARTITION BY year(report_date) ORDER BY {_SC}, doc_id) AS rn FROM v_docs),
l AS (SELECT *, sum(n - q) OVER (ORDER BY y) AS room FROM q), t AS (SELECT *, least(120, (SELECT sum(n) FROM q)) - (SELECT sum(q) FROM q) AS spare FROM l)
SELECT doc_id, report_year FROM r JOIN t ON t.y = r.report_year WHERE rn <= q + greatest(0, least(n - q, spare - (room - (n - q))))""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """120 documents over the years; the number is the feature."""
    return sampling.stratified(A.docs(spark, sf).select("doc_id", F.year("report_date").cast("long").alias("report_year")), "report_year", "doc_id", 120)


@query("priority_queue", "WITH " + A.ctes("v_gold", "v_predictions") + """, w AS (SELECT * FROM (VALUES ('omitted_downside_context', 4.0), ('euphemistic_risk', 3.0), ('title_body_mismatch', 2.0), ('hedged_downside', 1.5), ('none', 0.0)) t(l, w))
SELECT p.report_id, round(CAST(a.w + b.w AS DOUBLE), 4) AS score, array_to_string(list_sort(list_distinct(list_filter([p.phenomenon, g.phenomenon], lambda x: x <> 'none'))), ',') AS phenomena
FROM v_predictions p JOIN v_gold g USING (report_id) JOIN w a ON a.l = p.phenomenon JOIN w b ON b.l = g.phenomenon""")
def priority_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.predictions(spark, sf).select("report_id", F.col("phenomenon").alias("m1")).join(A.gold(spark, sf).select("report_id", F.col("phenomenon").alias("m2")), "report_id")
    return sampling.priority(rows, ["m1", "m2"], "report_id", F.lit(0.0))


@query("coverage_thresholds", """WITH c AS (SELECT CASE WHEN quality = 0 AND toxic = 1 THEN 'both' WHEN quality = 0 THEN 'low_quality' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS label, count(*) AS n FROM labels GROUP BY 1),
t AS (SELECT * FROM (VALUES ('both', 10), ('low_quality', 15), ('toxic', 15), ('clean', 30), ('absent', 1)) t(label, required))
SELECT label, CAST(required AS BIGINT) AS required, coalesce(n, 0) AS n, coalesce(n, 0) >= required AS met FROM t LEFT JOIN c USING (label)""")
def coverage_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "both").when(F.col("quality") == 0, "low_quality").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    n = A.table(spark, sf, "labels").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return cleaning.coverage(n, {"both": 10, "low_quality": 15, "toxic": 15, "clean": 30, "absent": 1})


@query("annotation_validation", """SELECT problem, count(*) AS n FROM (
  SELECT 'label:lang' AS problem FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
  UNION ALL SELECT 'span' FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT 'duplicate' FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)) GROUP BY 1""")
def annotation_validation(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents")
    span = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\u0001"))).otherwise(F.col("text")).alias("text"))
    rows = d.select("source", "text", "lang", F.array(span).alias("spans"))
    return cleaning.annotation_errors(rows, {"lang": ["en", "de", "fr"]}, "source").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("leakage_audit", "WITH " + A.ctes("v_docs") + """, r AS (SELECT md5(text) AS h, report_date, CASE WHEN doc_id % 50 = 7 THEN 'test' ELSE split END AS split FROM v_docs)
SELECT 'several_splits' AS kind, h FROM r GROUP BY h HAVING count(DISTINCT split) > 1
UNION ALL SELECT DISTINCT 'wrong_year', h FROM r WHERE split <> CASE WHEN year(report_date) <= 2024 THEN 'train' WHEN year(report_date) = 2025 THEN 'dev' ELSE 'test' END""")
def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    r = A.docs(spark, sf).select(F.md5("text").alias("h"), "report_date", F.when(F.col("doc_id") % 50 == 7, "test").otherwise(F.col("split")).alias("split"))
    return cleaning.leakage(r, X.split_of(F.col("report_date")), "h")


@query("report_star", "SELECT doc_id, source, analyst_order, analyst_name FROM (SELECT doc_id, source, CAST(generate_subscripts(string_split(lang || '.' || source || ', ' || lang, ','), 1) - 1 AS BIGINT) AS analyst_order, unnest([source, lang]) AS analyst_name FROM documents)")
def report_star(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents")
    raw = d.select(
        F.col("doc_id").alias("report_id"), F.col("source").alias("stock_id"), F.col("source").alias("broker_id"), F.col("source").alias("broker_name"), F.concat(F.col("lang"), F.lit("."), F.col("source"), F.lit(", "), F.col("lang")).alias("authors"),
        F.lit("2024-01-02 10:00:00").alias("publish_time"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("summary"), F.lit("buy").alias("rating"), F.lit("").alias("last_rating"), F.lit("1").alias("target_low"), F.lit("2").alias("target_high"),
    )
    bridge = cleaning.normalise_report(raw)["bridge"]
    return bridge.select(F.col("report_id").alias("doc_id"), F.col("broker_id").alias("source"), F.col("analyst_order").cast("long").alias("analyst_order"), "analyst_name")


@query("table_profile", "SELECT count(*) AS rows, min(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS first, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS last, count(DISTINCT CAST(o_custkey AS VARCHAR)) AS distinct_keys FROM orders")
def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.profile(A.table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate")), "d", "o_custkey")


@query("market_codes", "SELECT DISTINCT stock_code, CASE WHEN substr(stock_code, 1, 1) IN ('6', '9') THEN '1.' || stock_code ELSE '0.' || stock_code END AS secid FROM (SELECT lpad(CAST(l_suppkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS stock_code FROM lineitem)")
def market_codes(spark: SparkSession, sf: str) -> DataFrame:
    code = X.stock_code((F.col("l_suppkey") * 7919 % 1000000).cast("string"))
    return A.table(spark, sf, "lineitem").select(code.alias("stock_code")).distinct().select("stock_code", X.secid(F.col("stock_code")).alias("secid"))
