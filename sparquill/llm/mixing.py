"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each document has a fixed pseudo-random position (the leading 36 bits of md5 of its id). A source's mix is a number of
whole passes over it plus a remainder of tokens, and the remainder is made of the documents below a threshold of that
position. The threshold is found without sorting: tokens are summed by (source, 12-bit bucket), the cumulative sums
show the boundary bucket, and only the documents of that bucket are split again by the next 12 bits, three times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.plans.stage import materialize

WORD = r"[^\x20\x09-\x0D]+"
BITS = 12
LEVELS = 3
#: Source tables of up to this many rows are broadcast; larger ones are joined by salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position(key: Column) -> Column:
    """36 pseudo-random bits of a key; a null key counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 9), 16, 10).cast("long")


def source_targets(sources: DataFrame, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> + weight, target.

    Sources by code point, null last, get the weights in turn and share the sum of all sizes; a target stops at cap
    times its source's size and the excess is shared again by weight. The rank is distributed: a range-partitioned
    sort, and an offset for each partition (one row for each partition is broadcast).
    """
    ordered = materialize(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_mid", F.monotonically_increasing_id()), "mix_sources"
    )
    part = F.shiftright("_mid", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(
        ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(
            "source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * cap).alias("_most")
        ),
        "mix_weights",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # the level only rises, and each further round has stopped at least one more source
        over = F.col("_most") < F.col("weight") * F.lit(level)
        stopped, n, free = ranked.agg(
            F.coalesce(F.sum(F.when(over, F.col("_most"))), F.lit(0)),
            F.count(F.when(over, 1)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
        ).first()
        if n == full or not free:
            break
        level, full = float(total - stopped) / float(free), n
    target = F.least(F.col("weight") * F.lit(level), F.col("_most").cast("double"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _with_source(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """rows joined with table's row of the same source. Up to BROADCAST_SOURCES sources: a broadcast whose size was
    counted; beyond: an equi-join on (source, salt), which spreads a hot source over SALTS tasks."""
    rows = rows.withColumn("_null", F.col("source").isNull()).withColumn("_key", F.coalesce("source", F.lit("")))
    table = table.select(
        F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_key"),
        *[c for c in table.columns if c != "source"],
    )
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), ["_null", "_key"]).drop("_null", "_key")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.col("_pos"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["_null", "_key", "_salt"]).drop("_null", "_key", "_salt")


def mix_plan(rows: DataFrame, cap: int = 3) -> tuple[DataFrame, int]:
    """(source, size, _pos) of all documents -> (source, source_size, target, _whole, _edge), and its number of rows.

    A document is in the mix _whole times, and once more if its position is below _edge.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, cap)
    n = targets.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))

    # edge: all documents below it (in units of the level's buckets) are taken; base: their tokens
    edge = plan.select("source", "_rest", F.lit(0).cast("long").alias("_edge"), F.lit(0).cast("long").alias("_base"))
    for step in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - step)
        bucket = F.shiftright("_pos", shift)
        near = _with_source(rows, edge, n).where(F.shiftright("_pos", shift + BITS) == F.col("_edge"))
        sums = near.groupBy("source", "_rest", "_edge", "_base", bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
        w = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # 4096 rows at most
        upto = F.col("_base") + F.sum("_sum").over(w)
        sums = sums.withColumn("_upto", upto)
        fits = F.col("_upto") <= F.col("_rest")
        if step == LEVELS:  # the last boundary bucket goes in where that comes nearer to the target
            fits = fits | ((F.col("_upto") - F.col("_rest")) < (F.col("_rest") - (F.col("_upto") - F.col("_sum"))))
        found = sums.groupBy(F.col("source").alias("_s")).agg(
            F.min(F.when(~fits, F.col("_bucket"))).alias("_first"), F.max(F.when(fits, F.col("_upto"))).alias("_got")
        )
        end = F.shiftleft(F.col("_edge") + 1, BITS)  # no bucket below is left out
        begin = F.shiftleft("_edge", BITS)
        edge = materialize(
            edge.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "_rest",
                F.when(F.col("_s").isNull() & F.col("_first").isNull() & F.col("_got").isNull(), begin)
                .otherwise(F.coalesce("_first", end)).alias("_edge"),
                F.coalesce("_got", "_base").alias("_base"),
            ),
            f"mix_edge{step}",
        )
    edge = edge.select("source", "_edge")
    null_safe = plan.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    table = materialize(null_safe.select("source", "source_size", "target", "_whole", F.coalesce("_edge", F.lit(0)).alias("_edge")), "mix_plan")
    return table, n


def mix(documents: DataFrame, cap: int = 3) -> DataFrame:
    """(doc_id, text, source, ...) -> doc_id, source, size, source_size, target, taken.

    Defined cases: null text has size 0; null sources form one source, last in order; rows with equal doc_id share a
    position and are taken together; an empty table gives no rows; a total size of 0 gives targets of 0. Columns other
    than these three are not read. taken is size times the number of times the mix holds the document, at most cap.
    """
    rows = materialize(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), position(F.col("doc_id")).alias("_pos")),
        "mix_rows",
    )
    table, n = mix_plan(rows, cap)
    out = _with_source(rows, table, n)
    times = _times(cap)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def _times(cap: int) -> Column:
    return F.least(F.col("_whole") + F.when(F.col("_pos") < F.col("_edge"), 1).otherwise(0), F.lit(cap))


def mixed(documents: DataFrame, cap: int = 3) -> DataFrame:
    """documents, each row as often as the mix holds it; the columns stay as they are. The texts are not shuffled unless
    there are more than BROADCAST_SOURCES sources."""
    rows = documents.select("source", word_count(F.col("text")).alias("size"), position(F.col("doc_id")).alias("_pos"))
    table, n = mix_plan(materialize(rows, "mix_rows"), cap)
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(documents.columns)]
    placed = documents.select(*own, F.col("source"), position(F.col("doc_id")).alias("_pos"))
    held = _with_source(placed, table, n).withColumn("_times", _times(cap).cast("int")).where("_times > 0")
    each = held.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return each.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(documents.columns)])
