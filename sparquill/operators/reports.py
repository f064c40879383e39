"""Landed report rows to seven keyed tables: reports, ratings, brokers, aliases, analysts, their bridge, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.operators.cleaning import first_by, last_by

# fixed values: what begins a risk section, by priority, and headings that are no summary
RISK_MARKERS = ("风险提示：", "风险提示", "风险因素：", "风险因素", "风险警示：", "风险警示")
HEADINGS = ("投资要点", "核心观点", "事件：", "事项：")
#: Columns that report_tables() reads, all text but authors and author_ids, which are arrays of it.
RAW = (
    "info_code", "stock_id", "stock_name", "broker_id", "broker_name", "broker_full_name", "researcher", "publish_time", "title", "body", "list_summary", "rating", "rating_other",
    "last_rating", "rating_change", "target_high", "target_low", "industry", "industry_other", "source_url", "fetched_at",
)


def sha1_of(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("||", *[F.coalesce(p, F.lit("")) for p in parts]))


def _strings(x: str) -> Column:
    """The array's items, trimmed, without empty ones; null has none."""
    return F.filter(F.transform(F.coalesce(F.col(x), F.expr("cast(array() as array<string>)")), lambda e: F.trim(F.coalesce(e, F.lit("")))), lambda e: e != "")


def analysts_of(authors: str = "authors", author_ids: str = "author_ids", researcher: str = "researcher") -> tuple[Column, Column]:
    """(ids, names), arrays: authors are 'id.name' or names; author_ids, if there are any, take the place of the ids in
    authors; without names the comma-joined researcher counts. Neither has empty items; an item with a comma is several."""
    items = _strings(authors)
    dotted = F.filter(items, lambda e: F.instr(e, ".") > 0)
    own = F.transform(dotted, lambda e: F.trim(F.substring_index(e, ".", 1)))
    given = _strings(author_ids)
    ids = F.when(F.size(F.coalesce(F.col(author_ids), F.expr("cast(array() as array<string>)"))) > 0, given).otherwise(own)
    names = F.transform(items, lambda e: F.when(F.instr(e, ".") > 0, F.trim(F.regexp_replace(e, r"^[^.]*\.", ""))).otherwise(e))
    other = F.transform(F.split(F.coalesce(F.col(researcher), F.lit("")), ","), lambda e: F.trim(e))
    names = F.when(F.size(items) > 0, names).otherwise(other)
    cut = lambda x: F.filter(F.split(F.array_join(x, ","), ","), lambda e: e != "")
    return cut(ids), cut(names)


def made_reports(raw: DataFrame, order: str) -> DataFrame:
    """raw (RAW, authors, author_ids, order) with all that the tables are made of. Rows without an info_code go."""
    rows = raw.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in RAW}).where("info_code <> ''")
    filled = lambda a, b: F.when(F.col(a) != "", F.col(a)).otherwise(F.col(b))
    ids, names = analysts_of()
    body, risk = T.split_risk(F.col("body"), RISK_MARKERS)
    rows = rows.withColumns({"text": F.col("body"), "ids": ids, "names": names})
    rows = rows.withColumns({"body_raw": body, "risk_section_raw": risk, "broker_name": filled("broker_name", "broker_full_name"), "rating": filled("rating", "rating_other"), "industry": filled("industry", "industry_other")})
    rows = rows.withColumns({"s1": T.extractive_summary(F.col("body_raw"), HEADINGS), "s2": T.extractive_summary(F.col("text"), HEADINGS)})
    summary = F.when(F.col("s1") != "", F.col("s1")).when(F.col("s2") != "", F.col("s2")).otherwise(F.col("list_summary"))
    rows = rows.withColumns({"summary": summary, "target_price": T.price_range(F.col("target_low"), F.col("target_high")), "analyst_id": F.array_join("ids", ","), "analyst_name": F.array_join("names", ",")})
    rows = rows.withColumn("text_hash", sha1_of(F.col("title"), F.col("summary"), F.col("body_raw"), F.col("risk_section_raw")))
    rows = rows.withColumn("version_hash", sha1_of(F.col("text_hash"), F.col("rating"), F.col("target_price")))
    rows = rows.withColumn("report_id", F.substring(sha1_of(*[F.col(c) for c in ("stock_id", "broker_id", "publish_time", "title", "source_url")]), 1, 20))
    return rows.drop("s1", "s2", "text", "broker_full_name", "rating_other", "industry_other", "authors", "author_ids", "researcher").withColumnRenamed(order, "__order")


#: The key of each table, by which its rows are unique and sorted.
KEYS = {
    "reports": ("report_id",), "ratings": ("report_id", "publish_time"), "brokers": ("broker_key",), "aliases": ("broker_id", "broker_name"), "analysts": ("analyst_id", "analyst_name", "broker_id"),
    "bridge": ("report_id", "analyst_order", "analyst_id", "analyst_name"), "versions": ("info_code", "version_hash"),
}


def report_tables(made: DataFrame) -> dict[str, DataFrame]:
    """made_reports() -> the seven tables. Write made once before (plans.stage.materialize): each table reads it.

    Of rows that share a key the last in order stays, but for brokers, where the first does; an alias has the first and
    last publish time and fetch of all its rows. Analysts are ids and names side by side, the shorter list filled up with
    empty texts. Where order ties, which row stays is not said.
    """
    stamps = [F.col("fetched_at").alias("created_at"), F.col("fetched_at").alias("updated_at")]
    last = lambda rows, name: last_by(rows, KEYS[name], ["__order"]).drop("__order")
    own = lambda *cols: made.select(*cols, "__order")
    people = made.select("*", F.posexplode(F.arrays_zip("ids", "names")).alias("at", "p"))
    people = people.withColumns({"analyst_order": F.col("at") + 1, "analyst_id": F.coalesce("p.ids", F.lit("")), "analyst_name": F.coalesce("p.names", F.lit(""))})
    seen = lambda c: F.nullif(F.col(c), F.lit(""))
    span = lambda f, c, name: F.coalesce(f(seen(c)), F.lit("")).alias(name)
    brokers = made.select(F.when(F.col("broker_id") != "", F.col("broker_id")).otherwise(F.col("broker_name")).alias("broker_key"), "broker_id", "broker_name", *stamps, "__order")
    return {
        "reports": last(own("report_id", "stock_id", "stock_name", "broker_id", "broker_name", "analyst_id", "analyst_name", "publish_time", "title", "summary", "body_raw", "risk_section_raw", "rating", "target_price", "industry", "source_url", "text_hash", "version_hash", F.lit("0").alias("is_deleted"), *stamps), "reports"),
        "ratings": last(own("report_id", "publish_time", "stock_id", "broker_id", "rating", "last_rating", "rating_change", F.col("target_high").alias("target_price_upper"), F.col("target_low").alias("target_price_lower"), "source_url", *stamps), "ratings"),
        "brokers": first_by(brokers, KEYS["brokers"], ["__order"]).drop("__order"),
        "aliases": made.groupBy("broker_id", "broker_name").agg(span(F.min, "publish_time", "first_seen_at"), span(F.max, "publish_time", "last_seen_at"), span(F.min, "fetched_at", "created_at"), span(F.max, "fetched_at", "updated_at")),
        "analysts": last(people.select("analyst_id", "analyst_name", "broker_id", "broker_name", *stamps, "__order"), "analysts"),
        "bridge": last(people.select("report_id", "analyst_order", "analyst_id", "analyst_name", "broker_id", "broker_name", *stamps, "__order"), "bridge"),
        "versions": last(own("info_code", "version_hash", "report_id", "source_url", "fetched_at", "title", "summary", "body_raw", "risk_section_raw", "rating", "target_price"), "versions"),
    }


def write_report_tables(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Each table below path, in order of its key over all files, by range partitions sorted in themselves."""
    for name, df in tables.items():
        df.repartitionByRange(*KEYS[name]).sortWithinPartitions(*KEYS[name]).write.mode(mode).parquet(f"{path}/{name}")


def reports_by_date(reports: DataFrame) -> DataFrame:
    """The table of reports in the five columns of the report feed: date, stock, company, title, summary on one line."""
    return reports.select(
        F.substring_index("publish_time", " ", 1).alias("report_date"), F.col("stock_id").alias("stock_code"), F.col("stock_name").alias("company_name"), "title", T.inline(F.replace(F.col("summary"), F.lit("\n"), F.lit(" "))).alias("summary")
    )


def extraction_counts(made: DataFrame) -> DataFrame:
    """One row: rows, and how many have a summary, a body, a risk section."""
    has = lambda c: F.count(F.when(F.col(c) != "", 1))
    return made.agg(F.count(F.lit(1)).alias("rows"), has("summary").alias("summary_present"), has("body_raw").alias("body_present"), has("risk_section_raw").alias("risk_present"))
