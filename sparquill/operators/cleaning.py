"""Report cleaning, de-duplication by key, keyed merges, corpus statistics and checks of annotations and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions import text as T


def first_by(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in order; combined before the shuffle, so a key with many rows costs no more."""
    own = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*own), F.struct(*order)).alias("_x")).select(*key, "_x.*").select(*rows.columns)


def last_by(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in order: an upsert's outcome."""
    own = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*own), F.struct(*order)).alias("_x")).select(*key, "_x.*").select(*rows.columns)


def clean_reports(raw: DataFrame) -> DataFrame:
    """raw (seq, report_date, stock_code, company_name, title, summary) -> clean rows: texts normalised, rows without
    summary dropped, the first of each (date, stock, title, summary) kept, id and year added."""
    rows = raw.select(
        "seq", F.to_date("report_date").alias("report_date"), T.stock_code(F.col("stock_code")).alias("stock_code"), T.normalize(F.col("company_name")).alias("company_name"),
        T.normalize(F.col("title")).alias("title"), T.normalize(F.col("summary")).alias("summary"),
    ).where("summary <> ''")
    rows = first_by(rows, ["report_date", "stock_code", "title", "summary"], ["seq"])
    return rows.select(
        T.report_id(F.col("report_date"), F.col("stock_code"), F.col("title"), F.col("summary")).alias("report_id"), "report_date", F.year("report_date").alias("report_year"),
        "stock_code", "company_name", "title", "summary", F.concat_ws("\n", "title", "summary").alias("combined_text"), F.length("title").alias("title_length"), F.length("summary").alias("summary_length"),
    )


def drop_reason(deleted: Column, date: Column, key: Column) -> Column:
    """Why a master row goes: deleted, no date, no key, in this order; null where it stays."""
    return F.when(F.lower(F.coalesce(deleted.cast("string"), F.lit(""))).isin("1", "true", "yes"), "deleted").when(date.isNull(), "missing_date").when(F.coalesce(key, F.lit("")) == "", "missing_key")


def reason_counts(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def merge_aliases(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Earliest first_seen and latest last_seen of each key; empty strings do not count."""
    seen = lambda c: F.nullif(F.col(c), F.lit(""))
    return old.unionByName(new).groupBy(*key).agg(F.min(seen("first_seen")).alias("first_seen"), F.max(seen("last_seen")).alias("last_seen"))


def replace_partition(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new's keys replaced by new."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def corpus_stats(rows: DataFrame, length: str = "summary_length") -> DataFrame:
    q = lambda p: F.percentile(length, F.lit(p))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("stock_code").alias("stocks"), F.min("report_date").alias("first_date"), F.max("report_date").alias("last_date"),
        F.coalesce(F.min(length), F.lit(0)).cast("long").alias("length_min"), F.round(F.coalesce(q(0.25), F.lit(0.0)), 4).alias("length_p25"), F.round(F.coalesce(q(0.5), F.lit(0.0)), 4).alias("length_median"),
        F.round(F.coalesce(F.avg(length), F.lit(0.0)), 4).alias("length_mean"), F.round(F.coalesce(q(0.75), F.lit(0.0)), 4).alias("length_p75"), F.coalesce(F.max(length), F.lit(0)).cast("long").alias("length_max"),
    )


def profile(table: DataFrame, date: str, distinct: str) -> DataFrame:
    """Row count, date range and distinct values of a packaged asset; empty strings do not count."""
    d, k = F.nullif(F.col(date).cast("string"), F.lit("")), F.nullif(F.col(distinct).cast("string"), F.lit(""))
    return table.agg(F.count(F.lit(1)).alias("rows"), F.min(d).alias("first"), F.max(d).alias("last"), F.countDistinct(k).alias("distinct_keys"))


def normalise_report(raw: DataFrame) -> dict[str, DataFrame]:
    """One raw report table (report_id, stock_id, broker_id, broker_name, authors, publish_time, title, summary, rating,
    last_rating, target_low, target_high) -> the star: reports, ratings, brokers, aliases, analysts and their bridge."""
    base = raw.withColumn("day", T.trade_date(F.col("publish_time"))).withColumn("text_hash", F.sha1(F.concat_ws("||", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))))
    base = base.withColumn("version_hash", F.sha1(F.concat_ws("||", "text_hash", F.coalesce("rating", F.lit("")), T.price_range(F.col("target_low"), F.col("target_high")))))
    people = base.select("report_id", "broker_id", "broker_name", "publish_time", F.posexplode(T.authors(F.col("authors"))).alias("analyst_order", "a")).select(
        "report_id", "analyst_order", F.col("a.id").alias("analyst_id"), F.col("a.name").alias("analyst_name"), "broker_id", "broker_name", "publish_time"
    )
    return {
        "reports": base.select("report_id", "stock_id", "broker_id", "day", "title", "summary", "rating", T.price_range(F.col("target_low"), F.col("target_high")).alias("target_price"), "text_hash", "version_hash"),
        "ratings": base.select("report_id", "publish_time", "stock_id", "rating", "last_rating", F.when(F.coalesce("last_rating", F.lit("")) == "", "new").when(F.col("rating") == F.col("last_rating"), "same").otherwise("changed").alias("rating_change")),
        "brokers": first_by(base.select("broker_id", "broker_name", "publish_time"), ["broker_id"], ["publish_time", "broker_name"]),
        "aliases": base.groupBy("broker_id", "broker_name").agg(F.min("day").alias("first_seen_at"), F.max("day").alias("last_seen_at")),
        "analysts": people.select("analyst_id", "analyst_name", "broker_id").distinct(),
        "bridge": people.select("report_id", "analyst_order", "analyst_id", "analyst_name", "broker_id"),
    }


def annotation_errors(rows: DataFrame, domains: dict[str, Sequence[str]], key: str = "report_id") -> DataFrame:
    """(key, problem) of labels outside of their domain, spans that do not match the text, and ids that repeat.

    rows: key, text, the label fields, spans (array of start, end, text).
    """
    bad = [F.when(F.col(f).isNotNull() & ~F.col(f).isin(*values), F.lit(f"label:{f}")) for f, values in domains.items()]
    span = F.when(F.exists(F.coalesce("spans", F.array()), lambda s: (s["start"] < 0) | (s["end"] > F.length("text")) | (s["end"] <= s["start"]) | (F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]) != s["text"])), F.lit("span"))
    each = rows.select(key, F.explode(F.array_compact(F.array(*bad, span))).alias("problem"))
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("duplicate").alias("problem"))
    return each.union(twice)


def annotation_report(rows: DataFrame, domains: dict[str, Sequence[str]], key: str = "report_id") -> DataFrame:
    """(kind, label, n): number of rows, of complete ones, of each label of each field, of each problem, and 'ready' with 'yes'
    where there is no problem and no row lacks a label, else 'no'. rows as in annotation_errors(); null labels have no row."""
    fields = list(domains)
    whole = rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(complete(fields), 1)).alias("complete"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("kind"), F.col(f).alias("label")) for f in fields]))
    labels = rows.select(each.alias("x")).select("x.*").where("label is not null").groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    problems = annotation_errors(rows, domains, key).groupBy(F.lit("problem").alias("kind"), F.col("problem").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counts = whole.select(F.explode(F.array(F.struct(F.lit("rows").alias("kind"), F.lit("").alias("label"), F.col("rows").alias("n")), F.struct(F.lit("complete").alias("kind"), F.lit("").alias("label"), F.col("complete").alias("n")))).alias("x")).select("x.*")
    found = problems.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad"))
    ready = whole.join(found, F.lit(True)).select(F.lit("ready").alias("kind"), F.when((F.col("bad") == 0) & (F.col("rows") == F.col("complete")) & (F.col("rows") > 0), "yes").otherwise("no").alias("label"), F.lit(1).cast("long").alias("n"))
    return counts.union(labels).union(problems).union(ready)


def trimmed(table: DataFrame) -> DataFrame:
    """The table with its columns of text trimmed."""
    return table.select(*[F.trim(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in table.schema])


def complete(fields: Sequence[str]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f).isNotNull()
    return out


def coverage(counts: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """(label, n) against least numbers: label, required, n, met."""
    need = counts.sparkSession.createDataFrame(list(thresholds.items()), "label string, required int")
    return F.broadcast(need).join(counts, "label", "left").select("label", F.col("required").cast("long").alias("required"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.coalesce("n", F.lit(0).cast("long")) >= F.col("required")).alias("met"))


def leakage(rows: DataFrame, policy: Column, key: str = "report_id", split: str = "split") -> DataFrame:
    """(kind, key) of ids in several splits and of ids whose split is not the policy's."""
    many = rows.groupBy(key).agg(F.countDistinct(split).alias("n")).where("n > 1").select(F.lit("several_splits").alias("kind"), key)
    wrong = rows.where(F.col(split) != policy).select(F.lit("wrong_year").alias("kind"), key).distinct()
    return many.union(wrong)


