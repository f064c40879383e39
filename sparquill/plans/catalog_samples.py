"""Named queries of annotation samples, report fields and checks of annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as X
from sparquill.operators import cleaning, sampling
from sparquill.plans import adapters as A
from sparquill.plans.catalog import query

# ---------------------------------------------------------------- samples for annotation

_ORDER = "((doc_id % 1048576) + 42) * 2654435761 % 4294967296"
_YEARS = "WITH " + A.ctes("v_docs") + f", d AS (SELECT doc_id, split, CAST(year(report_date) AS BIGINT) AS report_year, {_ORDER} AS o, source FROM v_docs)"


def _share_sql(name: str, rows: str, total: int) -> str:
    """A CTE with the first rows of each year of `rows`: total shared over the years in order, none above its size, and what
    is left to the years that have more."""
    return f"""{name}_y AS (SELECT report_year, count(*) AS n, row_number() OVER (ORDER BY report_year) - 1 AS i, count(*) OVER () AS k FROM {rows} GROUP BY 1),
{name}_b AS (SELECT *, least(n, {total} // k + CASE WHEN i < {total} % k THEN 1 ELSE 0 END) AS base FROM {name}_y),
{name}_q AS (SELECT report_year, base + greatest(0, least(n - base, least({total}, sum(n) OVER ()) - sum(base) OVER () - coalesce(sum(n - base) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM {name}_b),
{name} AS (SELECT * EXCLUDE (r, quota) FROM (SELECT x.*, row_number() OVER (PARTITION BY x.report_year ORDER BY o, doc_id) AS r, quota FROM {rows} x JOIN {name}_q USING (report_year)) WHERE r <= quota)"""


def _by_year(spark: SparkSession, sf: str) -> DataFrame:
    return A.docs(spark, sf).select("doc_id", "split", F.year("report_date").cast("long").alias("report_year"), "source")


TARGETS = {"train": 120, "dev": 60, "test": 30}


@query("gold_workset", _YEARS + "".join(f", {s}_rows AS (SELECT * FROM d WHERE split = '{s}'), {_share_sql(f'{s}_set', f'{s}_rows', n)}" for s, n in TARGETS.items()) + " " + " UNION ALL ".join(f"SELECT doc_id, split, report_year FROM {s}_set" for s in TARGETS))
def gold_workset(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of each split, even over its years."""
    return sampling.by_split(_by_year(spark, sf), "report_year", "doc_id", TARGETS).select("doc_id", "split", "report_year")


@query("pilot_and_main", _YEARS + ", " + _share_sql("pilot", "d", 80) + ", left_ AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM pilot)), " + _share_sql("main", "left_", 300) + " SELECT 'pilot' AS sample, doc_id, report_year FROM pilot UNION ALL SELECT 'main', doc_id, report_year FROM main")
def pilot_and_main(spark: SparkSession, sf: str) -> DataFrame:
    """A pilot sample, and a main one that shares no row with it."""
    pilot, main = sampling.two_stage(_by_year(spark, sf), "report_year", "doc_id", 80, 300)
    return pilot.select(F.lit("pilot").alias("sample"), "doc_id", "report_year").union(main.select(F.lit("main"), "doc_id", "report_year"))


@query("evaluation_sample", _YEARS + """, p AS (SELECT *, CASE WHEN doc_id % 10 < 7 THEN 'none' ELSE source END AS phenomenon FROM d),
m AS (SELECT *, phenomenon <> 'none' AND row_number() OVER (PARTITION BY phenomenon ORDER BY o, doc_id) <= 5 AS must FROM p)
SELECT doc_id, phenomenon FROM m ORDER BY must DESC, o, doc_id LIMIT 150""")
def evaluation_sample(spark: SparkSession, sf: str) -> DataFrame:
    """At least five of each phenomenon, then any."""
    rows = _by_year(spark, sf).withColumn("phenomenon", F.when(F.col("doc_id") % 10 < 7, "none").otherwise(F.col("source")))
    return sampling.at_least(rows, "phenomenon", "doc_id", 5, 150).select("doc_id", "phenomenon")


@query("split_or_all", "WITH " + A.ctes("v_docs") + " SELECT 'dev' AS asked, doc_id FROM v_docs WHERE split = 'dev' OR NOT EXISTS (SELECT 1 FROM v_docs WHERE split = 'dev') UNION ALL SELECT 'pilot', doc_id FROM v_docs")
def split_or_all(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a split; all of them where the split has none."""
    d = A.docs(spark, sf)
    return sampling.split_or_all(d, "dev").select(F.lit("dev").alias("asked"), "doc_id").union(sampling.split_or_all(d, "pilot").select(F.lit("pilot"), "doc_id"))


# ---------------------------------------------------------------- fields of landed rows

_FIELDS = ("summary", "abstract", "digest", "content", "contentAbstract", "reportSummary", "summaryContent", "shortContent")


@query("first_fields", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN trim(substr('ab ' || replace(substr(text, 1, 700), chr(10), ' '), 1, 10)) WHEN 1 THEN 'digest ' || doc_id WHEN 2 THEN repeat('x', 600) ELSE '' END AS summary, CASE WHEN doc_id % 3 = 0 THEN '7' WHEN doc_id % 3 = 1 THEN '0.5' ELSE '' END AS close FROM documents""")
def first_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The first of several fields that is filled: texts normalised and cut, numbers where 0 is as good as nothing."""
    k = F.col("doc_id")
    d = A.table(spark, sf, "documents").withColumn("head", F.concat(F.lit("ab "), F.replace(F.substring("text", 1, 700), F.lit("\n"), F.lit(" "))))
    values = {"summary": F.lit(" \t\n"), "abstract": F.when(k % 4 == 0, F.concat(F.lit("\n  "), F.substring("head", 1, 10))), "digest": F.when(k % 4 == 1, F.concat(F.lit("digest  "), k.cast("string"))), "shortContent": F.when(k % 4 == 2, F.lit("x" * 700))}
    d = d.select("doc_id", *[values.get(f, F.lit(None)).cast("string").alias(f) for f in _FIELDS], F.when(k % 3 == 0, "0").otherwise("").alias("a"), F.when(k % 3 == 1, "0.0").otherwise(" ").alias("b"), F.when(k % 3 == 0, "7").when(k % 3 == 1, "0.5").alias("c"))
    return d.select("doc_id", X.first_text(*[F.col(f) for f in _FIELDS]).alias("summary"), X.first_number(F.col("a"), F.col("b"), F.col("c")).alias("close"))


# ---------------------------------------------------------------- annotations


@query("annotation_report", "WITH " + A.ctes("v_gold") + """, g AS (SELECT *, CASE WHEN l_orderkey % 97 = 0 THEN 'odd' ELSE phenomenon END AS ph FROM v_gold), e AS (SELECT count(*) AS n FROM g WHERE ph = 'odd'), x AS (
  SELECT 'rows' AS kind, '' AS label, count(*) AS n FROM g UNION ALL SELECT 'fundamental_sentiment', fundamental_sentiment, count(*) FROM g GROUP BY 2 UNION ALL SELECT 'phenomenon', ph, count(*) FROM g GROUP BY 2
  UNION ALL SELECT 'complete', '', count(*) FROM g UNION ALL SELECT 'problem', 'label:phenomenon', n FROM e UNION ALL SELECT 'ready', CASE WHEN n = 0 THEN 'yes' ELSE 'no' END, 1 FROM e)
SELECT kind, label, n FROM x""")
def annotation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations with some labels that are none: distributions, problems, whether they are ready."""
    g = A.gold(spark, sf).withColumn("phenomenon", F.when(F.col("l_orderkey") % 97 == 0, "odd").otherwise(F.col("phenomenon")))
    rows = g.select("report_id", F.lit("text").alias("text"), "fundamental_sentiment", "phenomenon", F.expr("array(named_struct('start', 0, 'end', 4, 'text', 'text'))").alias("spans"))
    return cleaning.annotation_report(rows, {"fundamental_sentiment": A.SENTIMENTS, "phenomenon": A.PHENOMENA})


@query("trimmed_copy", "SELECT o_orderkey, trim(s) AS status, trim(p) AS priority FROM (SELECT o_orderkey, ' ' || o_orderstatus || ' ' AS s, o_orderpriority || '  ' AS p FROM orders)")
def trimmed_copy(spark: SparkSession, sf: str) -> DataFrame:
    """A table with all of its texts trimmed, and nothing else changed."""
    o = A.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias("status"), F.concat("o_orderpriority", F.lit("  ")).alias("priority"))
    return cleaning.trimmed(o)
