"""Named queries of studies: statistics in one row, adjudication, human evaluation, models' answers, report tables, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.operators import agreement, evaluation, inference, portfolio, reports
from sparquill.plans import adapters as A
from sparquill.plans import catalog as C
from sparquill.plans.catalog import LATIN, query
from sparquill.plans.stage import materialize, stage_path
from sparquill.sources import writers

# ---------------------------------------------------------------- statistics of the coefficients


@query("ic_summary")
def ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    """n, mean, bootstrap interval, Newey-West t and p in one row (newey_west has the SQL of all but the drawn interval)."""
    return portfolio.ic_summary(C._ic(spark, sf), "signal", "trade_date", "ic")


# ---------------------------------------------------------------- adjudication, human evaluation

_LABELS = ("fundamental_sentiment", "phenomenon")
_CONF = "['low', 'medium', 'high']"
_ANNOTATED = "WITH " + A.ctes("v_docs") + """, w AS (SELECT doc_id, title, source, lang, CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN NULL ELSE 'negative' END AS s0, CASE doc_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN NULL ELSE 'neutral' END AS s1, CASE doc_id % 5 WHEN 0 THEN 'negative' WHEN 1 THEN NULL ELSE 'neutral' END AS s2,
  [' ' || title, source, ''] AS e0, [source, lang] AS e1, [title, lang, lang] AS e2, CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'sure' END AS c0, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS c1, 'medium' AS c2 FROM v_docs),
t AS (SELECT *, list_filter([trim(e0[1]), e0[2]], lambda x: x <> '') AS p0, e1 AS p1, list_filter([trim(e2[1]), e2[2], e2[3]], lambda x: x <> '') AS p2,
  greatest(1, coalesce(list_position(""" + _CONF + ", c0), 1)) AS k0, greatest(1, coalesce(list_position(" + _CONF + ", c1), 1)) AS k1, 2 AS k2, doc_id % 9 = 0 AS no2, doc_id % 10 = 0 AS no0 FROM w)"


def _raters(spark: SparkSession, sf: str) -> DataFrame:
    """Three annotators of each document, in long form; the third has not got each ninth."""
    d, k = A.docs(spark, sf), F.col("doc_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % n + 1).cast("int"))
    rows = [
        (0, pick(3, "positive", None, "negative"), F.array(F.concat(F.lit(" "), "title"), F.col("source"), F.lit("")), pick(4, "low", "high", "medium", "sure")),
        (1, pick(4, "positive", None, "neutral", "neutral"), F.array("source", "lang"), pick(3, "high", "medium", None)), (2, pick(5, "negative", None, "neutral", "neutral", "neutral"), F.array("title", "lang", "lang"), F.lit("medium")),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), s.alias("fundamental_sentiment"), F.lit("none").alias("phenomenon"), e.alias("evidence_spans"), c.alias("annotation_confidence")) for r, s, e, c in rows]))
    return d.select(k.alias("item_id"), each.alias("x")).select("item_id", "x.*").where("rater < 2 or item_id % 9 <> 0")


def _resolved(df: DataFrame) -> DataFrame:
    r = F.col("resolved")
    return df.select("item_id", r["fundamental_sentiment"].alias("label"), F.array_join(r["evidence_spans"], "|").alias("spans"), r["annotation_confidence"].alias("confidence"), F.array_join(r["unresolved"], ",").alias("unresolved"))


@query("adjudicate_three", _ANNOTATED + f""" SELECT doc_id AS item_id, CASE WHEN s0 IS NOT DISTINCT FROM s1 OR s0 IS NOT DISTINCT FROM s2 THEN s0 WHEN s1 IS NOT DISTINCT FROM s2 THEN s1 ELSE s0 END AS label,
  array_to_string(list_filter(list_concat(p0, p1, p2), lambda x, i: list_position(list_concat(p0, p1, p2), x) = i), '|') AS spans, {_CONF}[list_sort([k0, k1, k2])[2]] AS confidence, '' AS unresolved FROM t WHERE NOT no2""")
def adjudicate_three(spark: SparkSession, sf: str) -> DataFrame:
    wide = agreement.side_by_side(_raters(spark, sf), [0, 1, 2], [*_LABELS, "evidence_spans", "annotation_confidence"])
    return _resolved(agreement.adjudicated(wide.where("r2 is not null"), _LABELS, "r0", "r1", "r2"))


@query("adjudicate_two", _ANNOTATED + f""" SELECT doc_id AS item_id, s0 AS label, array_to_string(CASE WHEN p0 = p1 THEN p0 ELSE list_filter(list_concat(p0, p1), lambda x, i: list_position(list_concat(p0, p1), x) = i) END, '|') AS spans,
  {_CONF}[least(k0, k1)] AS confidence, CASE WHEN s0 IS DISTINCT FROM s1 THEN 'fundamental_sentiment' ELSE '' END AS unresolved FROM t WHERE no2""")
def adjudicate_two(spark: SparkSession, sf: str) -> DataFrame:
    """Items that only two annotators have."""
    wide = agreement.side_by_side(_raters(spark, sf), [0, 1, 2], [*_LABELS, "evidence_spans", "annotation_confidence"])
    return _resolved(agreement.adjudicated(wide.where("r2 is null"), _LABELS, "r0", "r1"))


_SCORES = ("faithfulness", "tone_removal")


def _score_sql(s: str) -> str:
    return f"count(TRY_CAST({s} AS DOUBLE)) AS {s}_n, round(coalesce(avg(TRY_CAST({s} AS DOUBLE)), 0.0), 4) AS {s}_mean, round(coalesce(stddev_pop(TRY_CAST({s} AS DOUBLE)), 0.0), 4) AS {s}_std"


@query("human_evaluation", """WITH e AS (SELECT r.rater, e.event_id // 2 AS report_id, e.event_id AS line, CASE WHEN e.event_id % 3 = 0 THEN '' WHEN r.rater = 0 THEN e.event_type END AS gold_phenomenon, CASE WHEN e.event_id % 5 <> 0 THEN 'p' || r.rater END AS pred_phenomenon,
  CASE (e.event_id + r.rater) % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'YES ' END AS factual_preservation, CASE (e.event_id + r.rater) % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE CAST((e.event_id + r.rater) % 5 + 1 AS VARCHAR) END AS faithfulness,
  CAST(e.user_id % 5 + 0.5 AS VARCHAR) AS tone_removal FROM events e, (VALUES (0), (1), (2)) r(rater) WHERE e.event_id % 7 <> r.rater),
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY rater, report_id ORDER BY line DESC) = 1),
f AS (SELECT report_id, arg_min(coalesce(nullif(gold_phenomenon, ''), nullif(pred_phenomenon, ''), 'unknown'), rater) AS phenomenon FROM l GROUP BY 1),
s AS (SELECT l.*, unnest(['all', phenomenon]) AS scope FROM l JOIN f USING (report_id))
SELECT scope, count(DISTINCT report_id) AS items, round(coalesce(count(*) FILTER (WHERE lower(trim(factual_preservation)) = 'yes') / nullif(count(factual_preservation), 0), 0.0), 4) AS yes_rate, """ + ", ".join(map(_score_sql, _SCORES)) + " FROM s GROUP BY 1")
def human_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Events as answers of three raters; two rows share an item, some items are missing, some answers are none."""
    e = A.table(spark, sf, "events").withColumn("rater", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("event_id % 7 <> rater")
    k = F.col("event_id") + F.col("rater")
    evals = e.select(
        "rater", F.floor(F.col("event_id") / 2).alias("report_id"), F.col("event_id").alias("line"), F.when(F.col("event_id") % 3 == 0, "").when(F.col("rater") == 0, F.col("event_type")).alias("gold_phenomenon"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("p"), "rater")).alias("pred_phenomenon"), F.when(k % 4 == 0, " Yes").when(k % 4 == 1, "no").when(k % 4 == 2, "YES ").alias("factual_preservation"),
        F.when(k % 6 == 0, "n/a").when(k % 6 != 1, (k % 5 + 1).cast("string")).alias("faithfulness"), (F.col("user_id") % 5 + 0.5).cast("string").alias("tone_removal"),
    )
    return agreement.human_evaluation(evals)


# ---------------------------------------------------------------- models' answers


def _stub():
    """A model that answers by the text's length, fails on some, and gives what does not fit on others."""

    def ask(row: dict) -> dict:
        n = row["doc_id"] % 5
        if n == 0:
            raise ValueError("no answer")
        if n == 1:
            return {"fundamental_sentiment": "positive", "uncertainty": "high"}
        return {"fundamental_sentiment": "positive" if len(row["text"] or "") % 2 else "negative", "strategic_optimism": "high", "phenomenon": "none", "uncertainty": 0.25, "evidence_spans": [{"text": "t", "label": "l"}], "reasoning_summary": "stub"}

    return ask


_RULES = C.SQL["rule_labels"].replace("array_to_string(", "len(", 1).replace(", ',') AS evidence FROM h", ") AS evidence FROM h")


@query("model_answers", f"""WITH r AS ({_RULES}) SELECT d.doc_id, d.doc_id % 5 < 2 AS failed, CASE WHEN d.doc_id % 5 < 2 THEN r.fundamental_sentiment WHEN length(text) % 2 = 1 THEN 'positive' ELSE 'negative' END AS fundamental_sentiment,
  CASE WHEN d.doc_id % 5 < 2 THEN r.strategic_optimism ELSE 'high' END AS strategic_optimism, CASE WHEN d.doc_id % 5 < 2 THEN r.phenomenon ELSE 'none' END AS phenomenon, CAST(CASE WHEN d.doc_id % 5 < 2 THEN 0.95 ELSE 0.25 END AS DOUBLE) AS uncertainty,
  CAST(CASE WHEN d.doc_id % 5 < 2 THEN r.evidence ELSE 1 END AS BIGINT) AS spans, CASE WHEN d.doc_id % 5 < 2 THEN '[direct fallback] rule-based fallback after LLM failure' ELSE 'stub' END AS reasoning_summary FROM documents d JOIN r USING (doc_id)""")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A model that fails on some rows; those have the rules' labels."""
    fallback = inference.prediction_fallback(F.col("title"), F.col("summary"), "direct", LATIN)
    found = inference.with_answers(A.docs(spark, sf), ["doc_id", "text"], _stub, inference.PREDICTION, fallback)
    a = F.col("answer")
    return found.select("doc_id", F.col("answer_error").isNotNull().alias("failed"), *[a[c].alias(c) for c in ("fundamental_sentiment", "strategic_optimism", "phenomenon", "uncertainty")], F.size(a["evidence_spans"]).cast("long").alias("spans"), a["reasoning_summary"].alias("reasoning_summary"))


# ---------------------------------------------------------------- the seven report tables

_DAY = "CAST(DATE '2023-01-01' + CAST(m % 700 AS INT) AS VARCHAR) || ' 00:00:00'"
_TABLES_SQL = f"""WITH raw AS (SELECT *, doc_id // 2 AS m FROM documents WHERE doc_id % 31 <> 0),
r AS (SELECT doc_id, m, 'i' || doc_id AS info_code, lpad(CAST(m % 50 AS VARCHAR), 6, '0') AS stock_id, source AS stock_name, CASE WHEN m % 7 = 0 THEN '' ELSE 'b' || (m % 5) END AS broker_id, CASE WHEN m % 11 = 0 THEN 'Full ' ELSE 'Broker ' END || (m % 5) AS broker_name,
  CASE WHEN doc_id % 4 = 0 THEN ['id1', 'id2'] WHEN doc_id % 6 = 5 THEN [] ELSE ['10' || (doc_id % 3), lang] END AS ids, CASE WHEN doc_id % 6 = 5 THEN ['Zed', 'Yan'] ELSE ['Ann', 'Bob', 'x.y'] END AS names, {_DAY} AS publish_time, 'T' || m AS title,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Body of ' || doc_id END AS body_raw, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '风险提示：risk ' || doc_id END AS risk, CASE WHEN doc_id % 3 = 0 THEN 'list ' || doc_id ELSE 'Body of ' || doc_id END AS summary,
  CASE WHEN doc_id % 2 = 0 THEN 'buy' ELSE 'hold' END AS rating, 'hold' AS last_rating, '' AS rating_change, '9' AS high, CASE WHEN doc_id % 2 = 0 THEN '5' ELSE '' END AS low, CASE WHEN doc_id % 2 = 0 THEN '5-9' ELSE '9' END AS target, 'ind' AS industry, 'u' || m AS url, '2024-01-0' || (doc_id % 9 + 1) AS fetched FROM raw),
h AS (SELECT *, sha1(concat_ws('||', title, summary, body_raw, risk)) AS text_hash, substr(sha1(concat_ws('||', stock_id, broker_id, publish_time, title, url)), 1, 20) AS report_id, array_to_string(ids, ',') AS aid, array_to_string(names, ',') AS aname FROM r),
v AS (SELECT *, sha1(concat_ws('||', text_hash, rating, target)) AS version_hash FROM h),
p AS (SELECT *, unnest(range(1, 4)) AS n FROM v), q AS (SELECT *, coalesce(ids[n], '') AS a, coalesce(names[n], '') AS b FROM p WHERE n <= greatest(len(ids), len(names))),
t AS (
  SELECT 'reports' AS tab, report_id AS key, concat_ws('|', stock_id, stock_name, broker_id, broker_name, aid, aname, publish_time, title, summary, body_raw, risk, rating, target, industry, url, text_hash, version_hash, '0', fetched, fetched) AS row_, doc_id AS o FROM v
  UNION ALL SELECT 'ratings', report_id || '|' || publish_time, concat_ws('|', stock_id, broker_id, rating, last_rating, rating_change, high, low, url, fetched, fetched), doc_id FROM v
  UNION ALL SELECT 'brokers', CASE WHEN broker_id <> '' THEN broker_id ELSE broker_name END, concat_ws('|', broker_id, broker_name, fetched, fetched), -doc_id FROM v
  UNION ALL SELECT 'analysts', concat_ws('|', a, b, broker_id), concat_ws('|', broker_name, fetched, fetched), doc_id FROM q
  UNION ALL SELECT 'bridge', concat_ws('|', report_id, n, a, b), concat_ws('|', broker_id, broker_name, fetched, fetched), doc_id FROM q
  UNION ALL SELECT 'versions', concat_ws('|', info_code, version_hash), concat_ws('|', report_id, url, fetched, title, summary, body_raw, risk, rating, target), doc_id FROM v)
SELECT tab, key, arg_max(md5(row_), o) AS row_md5 FROM t GROUP BY 1, 2
UNION ALL SELECT 'aliases', concat_ws('|', broker_id, broker_name), md5(concat_ws('|', min(publish_time), max(publish_time), min(fetched), max(fetched))) FROM v GROUP BY broker_id, broker_name"""


def _report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as landed report rows; two share a report, some have no code, no broker, no authors, no body."""
    k = F.col("doc_id")
    d = A.table(spark, sf, "documents").withColumn("m", F.floor(k / 2))
    m, text = F.col("m"), lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    blank = k % 3 == 0
    few = k % 6 == 5
    return d.select(
        k.alias("line"), F.when(k % 31 != 0, text("i", k.cast("string"))).otherwise(" ").alias("info_code"), F.lpad((m % 50).cast("string"), 6, "0").alias("stock_id"), F.col("source").alias("stock_name"),
        F.when(m % 7 == 0, None).otherwise(text("b", (m % 5).cast("string"))).alias("broker_id"), F.when(m % 11 == 0, "").otherwise(text("Broker ", (m % 5).cast("string"))).alias("broker_name"), text("Full ", (m % 5).cast("string")).alias("broker_full_name"),
        F.when(few, F.array(F.lit(" "))).otherwise(F.array(text("10", (k % 3).cast("string"), ".Ann"), F.lit(" Bob "), F.lit(None).cast("string"), text(F.col("lang"), ".x.y"))).alias("authors"), F.when(k % 4 == 0, F.array(F.lit("id1"), F.lit(" "), F.lit(" id2"))).alias("author_ids"),
        F.lit("Zed , ,Yan").alias("researcher"), text(F.date_add(F.lit("2023-01-01").cast("date"), (m % 700).cast("int")).cast("string"), " 00:00:00").alias("publish_time"), text(" T", m.cast("string")).alias("title"),
        F.when(blank, "").otherwise(text("Body of ", k.cast("string"), "\n风险提示： risk ", k.cast("string"))).alias("body"), text("list ", k.cast("string")).alias("list_summary"), F.when(k % 2 == 0, "").otherwise("hold").alias("rating"), F.lit("buy").alias("rating_other"),
        F.lit("hold").alias("last_rating"), F.lit(None).cast("string").alias("rating_change"), F.lit("9").alias("target_high"), F.when(k % 2 == 0, "5").alias("target_low"), F.lit("").alias("industry"), F.lit("ind").alias("industry_other"),
        text("u", m.cast("string")).alias("source_url"), text("2024-01-0", (k % 9 + 1).cast("string")).alias("fetched_at"),
    )


@query("report_tables", _TABLES_SQL)
def report_tables(spark: SparkSession, sf: str) -> DataFrame:
    """All seven tables, written and read back: for each row its table, its key, and a digest of its other columns."""
    made = materialize(reports.made_reports(_report_rows(spark, sf), "line"), "reports_made")
    path = stage_path(spark, "reports")
    reports.write_report_tables(reports.report_tables(made), path)
    out = None
    for name, key in reports.KEYS.items():
        df = spark.read.parquet(f"{path}/{name}")
        one = df.select(F.lit(name).alias("tab"), F.concat_ws("|", *key).alias("key"), F.md5(F.concat_ws("|", *[c for c in df.columns if c not in key])).alias("row_md5"))
        out = one if out is None else out.union(one)
    return out


# ---------------------------------------------------------------- counted writes and registries


@query("counted_write", """SELECT count(*) AS rows, count(*) FILTER (WHERE r IS NULL) AS kept, count(*) FILTER (WHERE r = 'deleted') AS deleted, count(*) FILTER (WHERE r = 'short') AS short, min(d) AS first, max(d) AS last, count(*) FILTER (WHERE trim(summary) <> '') AS with_summary, count(*) FILTER (WHERE r IS NULL) AS written
FROM (SELECT *, CAST(report_date AS VARCHAR) AS d, CASE WHEN doc_id % 17 = 0 THEN 'deleted' WHEN length(text) < 200 THEN 'short' END AS r FROM (WITH """ + A.ctes("v_docs") + " SELECT * FROM v_docs))")
def counted_write(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by reason, dates and filled summaries, out of the job that writes what stays."""
    reason = F.when(F.col("doc_id") % 17 == 0, "deleted").when(F.length("text") < 200, "short")
    path = stage_path(spark, "counted")
    seen = writers.write_counted(A.docs(spark, sf), path, writers.counters(reason, ["deleted", "short"], "report_date", ["summary"]), keep=reason.isNull())
    row = [seen[x] for x in ("rows", "reason_kept", "reason_deleted", "reason_short", "first", "last", "with_summary")]
    made = spark.createDataFrame([tuple(row)], "rows long, kept long, deleted long, short long, first string, last string, with_summary long")
    return made.crossJoin(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written")))  # two single rows


SETTINGS = ("full", "no_history", "no_neutral", "no_refine", "copy")
_REG = "WITH " + A.ctes("v_gold", "v_predictions") + ", n AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS setting, count(*) AS n, round(avg(CASE WHEN p.phenomenon = g.phenomenon OR p.l_orderkey % {m} = 0 THEN 1.0 ELSE 0.0 END), 4) AS phenomenon_f1, round(avg(CASE WHEN p.strategic_optimism = g.strategic_optimism OR p.l_orderkey % {m} = 0 THEN 1.0 ELSE 0.0 END), 4) AS strategic_f1 FROM v_predictions p JOIN v_gold g USING (report_id)"
    for s, m in zip(SETTINGS, (13, 3, 3, 5, 13), strict=True)
) + "), m AS (SELECT setting, strategic_f1, phenomenon_f1, CASE WHEN setting <> 'no_refine' THEN CAST(0.5 AS DOUBLE) END AS evidence_f1, CAST(0.1 AS DOUBLE) AS ece FROM n)"


def _settings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(metrics of made variants, their tables): a variant takes over gold labels of some orders; 'copy' is the full one."""
    gold = A.gold(spark, sf).select("report_id", F.col("phenomenon").alias("g1"), F.col("strategic_optimism").alias("g2"))
    both = A.predictions(spark, sf).select("report_id", "phenomenon", "strategic_optimism", "l_orderkey").join(gold, "report_id")
    each = both.withColumn("x", F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(m).alias("m")) for s, m in zip(SETTINGS, (13, 3, 3, 5, 13), strict=True)]))).select("*", "x.*")
    take = F.col("l_orderkey") % F.col("m") == 0
    rows = each.select("setting", "report_id", F.when(take, F.col("g1")).otherwise(F.col("phenomenon")).alias("phenomenon"), F.when(take, F.col("g2")).otherwise(F.col("strategic_optimism")).alias("strategic_optimism"), "g1", "g2")
    share = lambda a, b: F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 4)
    metrics = rows.groupBy("setting").agg(share("strategic_optimism", "g2").alias("strategic_f1"), share("phenomenon", "g1").alias("phenomenon_f1"))
    metrics = metrics.select("*", F.when(F.col("setting") != "no_refine", F.lit(0.5)).alias("evidence_f1"), F.lit(0.1).alias("ece"), F.lit(None).cast("double").alias("mean_rank_ic_20"), F.lit(None).cast("double").alias("ls_sharpe_20"))
    return metrics, rows.select("setting", "report_id", "phenomenon", "strategic_optimism")


@query("setting_registry", _REG + """ SELECT setting, strategic_f1, phenomenon_f1, evidence_f1, ece, round(0.35 * strategic_f1 + 0.2 * phenomenon_f1 + 0.1 * coalesce(evidence_f1, 0) - 0.15 * ece, 6) AS composite_j, true AS has_table, setting = 'copy' AS same_as_full FROM m""")
def setting_registry(spark: SparkSession, sf: str) -> DataFrame:
    metrics, tables = _settings(spark, sf)
    return evaluation.registry(metrics, evaluation.table_digests(tables, "setting"), "full").drop("mean_rank_ic_20", "ls_sharpe_20")


@query("equal_metrics", _REG + ", e AS (" + " UNION ALL ".join(f"SELECT setting, '{f}' AS field, {f} AS value FROM m" for f in ("strategic_f1", "evidence_f1", "ece")) + ") SELECT field, value, string_agg(setting, ',' ORDER BY setting) AS settings, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1")
def equal_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.equal_metrics(_settings(spark, sf)[0], ("strategic_f1", "evidence_f1", "ece"))
