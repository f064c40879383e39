"""Runs and their inputs: predictions brought to one form, resuming, splits, queues, ablation checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.functions import text as T
from sparquill.operators.evaluation import ratio

# fixed values: the labels of each field and what stands for one that is missing or unknown
VALID = {
    "fundamental_sentiment": ("positive", "neutral", "negative"),
    "strategic_optimism": ("high", "balanced", "low"),
    "phenomenon": ("hedged_downside", "euphemistic_risk", "title_body_mismatch", "omitted_downside_context", "none"),
}
DEFAULTS = {"fundamental_sentiment": "neutral", "strategic_optimism": "balanced", "phenomenon": "none"}
MOST_SPANS = 15
#: States of an item that a later run takes up again.
FAILED = ("failed", "missing")


def known_label(raw: Column, field: str) -> Column:
    """Trimmed and lower-cased; what is not a label of the field is its default."""
    x = F.lower(F.trim(raw))
    return F.when(x.isin(*VALID[field]), x).otherwise(DEFAULTS[field])


def class_of_label(raw: Column, classes: Mapping[str, str]) -> Column:
    """A classifier's own label by dictionary, else by the parts 'pos' and 'neg', else neutral."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), raw)
    low = F.lower(raw)
    return F.coalesce(known, F.when(low.contains("pos"), "positive").when(low.contains("neg"), "negative").otherwise("neutral"))


def known_prediction(raw: DataFrame) -> DataFrame:
    """raw with labels known, uncertainty in 0 .. 1 (0.5 where it is no number), spans with a text, at most MOST_SPANS of them."""
    number = F.col("uncertainty").try_cast("double")
    spans = F.transform(F.filter(F.coalesce("evidence_spans", F.array().cast(raw.schema["evidence_spans"].dataType)), lambda s: F.coalesce(s["text"], F.lit("")) != ""), lambda s: F.struct(s["text"].alias("text"), F.coalesce(s["label"], F.lit("unknown")).alias("label")))
    made = {f: known_label(F.col(f), f) for f in VALID}
    clamped = F.when(number.isNull() | F.isnan(number), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    return raw.withColumns({**made, "uncertainty": F.round(clamped, 4), "evidence_spans": F.slice(spans, 1, MOST_SPANS)})


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key no earlier run has, to resume it or to leave out what is annotated."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def to_retry(requests: DataFrame, states: DataFrame, key: str, order: str, failed: Sequence[str] = FAILED) -> DataFrame:
    """Requests whose last state is among failed, with that status. Tables have no order: sort by what numbers the requests."""
    last = states.groupBy(key).agg(F.max_by("status", order).alias("status")).where(F.col("status").isin(*failed))
    return requests.join(last, key)


def status_counts(states: DataFrame, key: str, order: str, known: Sequence[str] = ("covered", "missing", "failed")) -> DataFrame:
    """One row: how many keys have each last state."""
    last = states.groupBy(key).agg(F.max_by("status", order).alias("status"))
    return last.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in known])


def with_split(rows: DataFrame, test: DataFrame, dev: DataFrame, key: str) -> DataFrame:
    """rows with split: test where test has the key, then dev, then the row's own, then train."""
    mark = lambda ids, name: ids.select(key).distinct().withColumn(name, F.lit(True))
    joined = rows.join(mark(test, "__test"), key, "left").join(mark(dev, "__dev"), key, "left")
    split = F.when(F.col("__test"), "test").when(F.col("__dev"), "dev").otherwise(F.coalesce("split", F.lit("train")))
    return joined.withColumn("split", split).drop("__test", "__dev")


def ids_digest(key: Column) -> list[Column]:
    """Aggregates n, ids_xor, ids_sum: equal sets of ids have equal ones, whatever their order; nothing is gathered."""
    digest = F.md5(key.cast("string"))
    part = lambda n: F.conv(F.substring(digest, 1, n), 16, 10).cast("long")
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(part(15)).alias("ids_xor"), F.sum(part(8)).alias("ids_sum")]


#: Ids of a split that are joined to one text before they meet.
ID_BLOCK = 8192


def ids_md5(rows: DataFrame, by: str, key: str, block: int = ID_BLOCK) -> DataFrame:
    """(by, n, ids_md5): the md5 of each group's ids in order, joined by commas; null ids count in n alone.

    The ids are sorted by ranges over the whole cluster and joined to blocks there; md5 can only go over a text from front to
    end, so one task goes over each group's blocks in order, a batch at a time, and holds none of them.
    """
    kind = rows.schema[by].dataType.simpleString()

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for group, ids in frame.groupby("g", sort=False, dropna=False)["k"]:
                ids = ids.to_numpy()
                parts = [ids[a : a + block] for a in range(0, len(ids), block)]
                yield pd.DataFrame({"g": [None if pd.isna(group) else group] * len(parts), "first": [x[0] for x in parts], "last": [x[-1] for x in parts], "ids": [",".join(map(str, x.tolist())) for x in parts]})

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for frame in batches:
            for group, ids in zip(frame["g"], frame["ids"], strict=True):
                if digest is not None and (group == now or (pd.isna(group) and pd.isna(now))):
                    digest.update(b",")
                else:
                    if digest is not None:
                        yield pd.DataFrame({"g": [now], "ids_md5": [digest.hexdigest()]})
                    now, digest = group, hashlib.md5()
                digest.update(ids.encode())
        if digest is not None:
            yield pd.DataFrame({"g": [now], "ids_md5": [digest.hexdigest()]})

    own = rows.select(F.col(by).alias("g"), F.col(key).cast("long").alias("k"))
    joined = own.where("k is not null").repartitionByRange("k").sortWithinPartitions("g", "k").mapInPandas(blocks, f"g {kind}, first long, last long, ids string")
    made = joined.repartition("g").sortWithinPartitions("g", "first", "last").mapInPandas(digests, f"g {kind}, ids_md5 string")
    n = own.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return n.join(made, n["g"].eqNullSafe(made["g"]), "left").select(n["g"].alias(by), "n", "ids_md5")


def best_gold(pred: DataFrame, golds: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row: name and overlap of the gold table that shares most ids with pred; of equals the first named."""
    ids = pred.select(key).distinct()
    each = None
    for place, (name, gold) in enumerate(golds.items()):
        one = gold.select(key).distinct().join(ids, key).agg(F.count(F.lit(1)).alias("overlap")).select(F.lit(name).alias("gold"), "overlap", F.lit(-place).alias("place"))
        each = one if each is None else each.union(one)
    return each.agg(F.max_by(F.struct("gold", "overlap"), F.struct("overlap", "place")).alias("x")).select("x.gold", "x.overlap")


def errors_by_field(joined: DataFrame, fields: Sequence[str], key: str, negative: Mapping[str, str] = DEFAULTS) -> DataFrame:
    """(key, field, gold, pred, kind) of each label that differs; joined has each field and g_ before its gold."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"g_{f}").alias("gold"), F.col(f).alias("pred"), F.lit(negative[f]).alias("negative")) for f in fields]))
    rows = joined.select(key, each.alias("x")).select(key, "x.*").where(F.col("gold").isNotNull() & ~F.col("gold").eqNullSafe(F.col("pred")))
    kind = F.when(F.col("gold") == F.col("negative"), "false_positive").when(F.col("pred") == F.col("negative"), "false_negative").otherwise("misclassification")
    return rows.select(key, "field", "gold", "pred", kind.alias("kind"))


def kappa_by_field(joined: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, n, agreement, kappa of each field and of all labels together ('overall'); a null counts as a label of its own."""
    name = lambda c: F.coalesce(F.col(c), F.lit("None"))
    each = joined.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), name(f"g_{f}").alias("a"), name(f).alias("b")) for f in fields])).alias("x")).select("x.*")
    cells = each.groupBy("field", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.union(cells.groupBy("a", "b").agg(F.sum("n").alias("n")).select(F.lit("overall"), "a", "b", "n"))
    sides = cells.select("field", F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb")))).alias("m")).select("field", "m.*")
    expected = sides.groupBy("field", "label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).groupBy("field").agg(F.sum(F.col("na") * F.col("nb")).cast("double").alias("e"))
    seen = cells.groupBy("field").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("o"))
    e, o = F.col("e") / (F.col("n") * F.col("n")), F.col("o") / F.col("n")
    kappa = F.when(F.abs(1 - e) < 1e-12, F.when(o >= 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(o - e, 1 - e))
    return seen.join(expected, "field").select("field", "n", F.round(o, 4).alias("agreement"), F.round(kappa, 4).alias("kappa"))


def label_integrity(full: DataFrame, variants: DataFrame, fields: Sequence[str], key: str) -> DataFrame:
    """For each variant: rows that both have, and for each field how many labels differ from the full run's; suspect where a
    variant repeats all labels of it."""
    joined = variants.join(full.select(key, *[F.col(f).alias(f"__{f}") for f in fields]), key)
    differ = [F.count(F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), 1)).alias(f) for f in fields]
    out = joined.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), *differ)
    same = F.lit(True)
    for f in fields:
        same = same & (F.col(f) == 0)
    return out.withColumn("suspect", same)


def cost_table(events: DataFrame, price_in: float = 0.001, price_out: float = 0.003, direct: str = "direct_llm") -> DataFrame:
    """(stage, calls, tokens, cost) of each stage, of all ('TOTAL'), of the direct method's and of all others."""
    cost = lambda: F.round(F.sum("input_tokens") / 1000.0 * price_in + F.sum("output_tokens") / 1000.0 * price_out, 6).alias("cost")
    totals = [F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), cost()]
    kind = F.explode(F.array(F.col("stage"), F.lit("TOTAL"), F.when(F.col("stage") == direct, "direct_llm_only").otherwise("agentic_overhead")))
    return events.select(kind.alias("stage"), "input_tokens", "output_tokens").groupBy("stage").agg(*totals)


# fixed values: the last year of training, and the years of the others
TRAIN_UNTIL, DEV_YEAR, TEST_YEAR = 2024, 2025, 2026
_TEXTS = ("company_name", "broker_name", "analyst_name", "title", "body_raw", "risk_section_raw", "rating", "industry")
_TRIMMED = ("broker_id", "analyst_id", "target_price", "source_url", "version_hash")


def split_of_year(year: Column, train_until: int = TRAIN_UNTIL, dev: int = DEV_YEAR, test: int = TEST_YEAR) -> Column:
    """The split that has the year; null where none has."""
    return F.when(year <= train_until, "train").when(year == dev, "dev").when(year == test, "test")


def experiment_master(raw: DataFrame, order: str, split: Column | None = None) -> DataFrame:
    """Master rows brought to one form, with status: why a row goes (deleted, missing_date, missing_key, duplicate) or
    'packaged', and the split of its year (or as the expression split over report_date, a date as text, says).

    raw: report_id, publish_time, stock_id, stock_name, title, summary, body_raw, is_deleted as text, of the others in
    _TEXTS and _TRIMMED those that it has, and order, a number of the row. Texts are normalised, a blank summary is the
    body, a missing id is built from date, stock, title and summary; a row without a stock, or without title and
    summary, has no key. Of rows that share an id the first in order is packaged; of those that tie there, one.
    A date that is none, or a year that no split has, is an error once such a row would be packaged.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = raw.withColumn("company_name", F.col("stock_name"))
    rows = rows.withColumns({c: T.normalize(F.coalesce(F.col(c), F.lit(""))) for c in (*_TEXTS, "summary") if c in rows.columns})
    rows = rows.withColumns({c: text(c) for c in _TRIMMED if c in rows.columns})
    rows = rows.withColumn("summary", F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("body_raw")))
    day = F.regexp_replace(F.substring(text("publish_time"), 1, 10), "/", "-")
    rows = rows.withColumns({"report_date": day, "is_deleted": text("is_deleted"), "stock_code": T.stock_code(F.coalesce("stock_id", F.lit("")))})
    built = T.report_id(F.col("report_date"), F.col("stock_code"), F.col("title"), F.col("summary"))
    rows = rows.withColumn("report_id", F.when(text("report_id") != "", text("report_id")).otherwise(built))
    no_key = (F.col("stock_code") == "") | ((F.col("title") == "") & (F.col("summary") == ""))
    rows = rows.withColumn("status", F.when(F.col("is_deleted") == "1", "deleted").when(F.col("report_date") == "", "missing_date").when(no_key, "missing_key"))
    first = rows.where("status is null").groupBy("report_id").agg(F.min(order).alias("__first"))
    tie = F.row_number().over(Window.partitionBy("report_id", order, F.col("status").isNull()).orderBy(F.xxhash64("title", "summary", "publish_time")))
    rows = rows.withColumn("__tie", tie).join(first, "report_id", "left")
    rows = rows.withColumn("status", F.coalesce("status", F.when((F.col(order) == F.col("__first")) & (F.col("__tie") == 1), "packaged").otherwise("duplicate")))
    date = F.try_to_date("report_date", "yyyy-MM-dd")
    split = split_of_year(F.year(date)) if split is None else split
    error = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), "report_date")).cast("string")
    split = F.when(date.isNull(), error("no date")).when(split.isNull(), error("no split for the year of")).otherwise(split)
    combined = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("summary"), F.lit("")))
    rows = rows.withColumns({"split": F.when(F.col("status") == "packaged", split), "report_year": F.year(date), "combined_text": combined})
    return rows.drop("__first", "__tie", "stock_name", "stock_id")


def master_counts(master: DataFrame) -> DataFrame:
    """One row about experiment_master()'s result: rows by status and by split, range of dates, stocks and companies packaged."""
    packaged = F.col("status") == "packaged"
    when = lambda c: F.when(packaged, F.col(c))
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("packaged", "deleted", "missing_date", "missing_key", "duplicate")]
    splits = [F.count(F.when(F.col("split") == s, 1)).alias(s) for s in ("train", "dev", "test")]
    return master.agg(
        F.count(F.lit(1)).alias("rows"), *counts, *splits, F.min(when("report_date")).alias("first_date"), F.max(when("report_date")).alias("last_date"),
        F.countDistinct(when("stock_code")).alias("stocks"), F.countDistinct(when("company_name")).alias("companies"),
    )


def queue_summary(queue: DataFrame) -> DataFrame:
    """(phenomenon, n, least, most) over a queue's lists of phenomena; a row without any counts as 'none'."""
    named = F.explode(F.when(F.size("phenomena") > 0, F.col("phenomena")).otherwise(F.array(F.lit("none"))))
    return queue.select(named.alias("phenomenon"), "score").groupBy("phenomenon").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


def extraction_quality(rows: DataFrame, source: str, texts: Sequence[str]) -> DataFrame:
    """For each source: rows, and the share in which each text is filled."""
    filled = [ratio(F.count(F.when(F.trim(F.coalesce(t, F.lit(""))) != "", 1)), F.count(F.lit(1))).alias(f"with_{t}") for t in texts]
    return rows.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"), *filled)
