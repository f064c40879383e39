"""Deterministic samples and queues for annotation. Order comes from an arithmetic hash of the id, not from input order."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparquill.functions.lexicon import Lexicons, hits


def scatter(key: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random order of integer ids."""
    return F.pmod((F.pmod(key, F.lit(1 << 20)) + seed) * F.lit(2654435761), F.lit(1 << 32))


def quotas(sizes: dict[object, int], total: int) -> dict[object, int]:
    """total shared evenly over the strata in sorted order, the remainder to the first, none above its size; what is
    left goes to strata that have more."""
    out = {k: 0 for k in sorted(sizes)}
    base, extra = divmod(total, len(out)) if out else (0, 0)
    for i, k in enumerate(out):
        out[k] = min(sizes[k], base + (i < extra))
    left = min(total, sum(sizes.values())) - sum(out.values())
    for k in out:
        more = min(left, sizes[k] - out[k])
        out[k] += more
        left -= more
    return out


def stratified(rows: DataFrame, stratum: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """total rows, evenly over the strata, each stratum's first in scattered order. The strata (years) are few."""
    sizes = {r[stratum]: r["n"] for r in rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = quotas({k: n for k, n in sizes.items() if k is not None}, total)
    if not share:
        return rows.limit(0)
    most = F.coalesce(*[F.when(F.col(stratum) == k, F.lit(n)) for k, n in share.items()], F.lit(0))
    order = Window.partitionBy(stratum).orderBy(scatter(F.col(key), seed), key)
    # the constant bound lets Spark cut each partition's rank before the shuffle
    ranked = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(share.values()))
    return ranked.where(F.col("_r") <= most).drop("_r")


def by_split(rows: DataFrame, stratum: str, key: str, targets: Mapping[str, int], split: str = "split", seed: int = 42) -> DataFrame:
    """For each named split a sample of so many rows, evenly over its strata; a split without rows gives none."""
    parts = [stratified(rows.where(F.col(split) == name), stratum, key, n, seed) for name, n in targets.items()]
    return functools.reduce(DataFrame.union, parts) if parts else rows.limit(0)


def split_or_all(rows: DataFrame, name: str, split: str = "split") -> DataFrame:
    """The rows of the split, or all rows where none has it."""
    own = rows.where(F.col(split) == name)
    return own if own.limit(1).count() else rows


def two_stage(rows: DataFrame, stratum: str, key: str, pilot: int = 400, main: int = 2000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A pilot sample, and a main one from the rest."""
    first = stratified(rows, stratum, key, pilot, seed)
    return first, stratified(rows.join(first.select(key), key, "left_anti"), stratum, key, main, seed)


def uniform(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(scatter(F.col(key), seed), key).limit(n)


def at_least(rows: DataFrame, label: str, key: str, each: int, total: int, skip: str = "none", seed: int = 42) -> DataFrame:
    """`each` rows of every label but `skip`, then any others in scattered order, up to total."""
    order = Window.partitionBy(label).orderBy(scatter(F.col(key), seed), key)
    must = rows.where(F.col(label) != skip).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).select(key, F.lit(0).alias("_first"))
    return rows.join(must, key, "left").orderBy(F.coalesce("_first", F.lit(1)), scatter(F.col(key), seed), key).limit(total).drop("_first")


# fixed values: what a method's vote for a phenomenon adds; unknown ones add 1
VOTES = {"omitted_downside_context": 4.0, "euphemistic_risk": 3.0, "title_body_mismatch": 2.0, "hedged_downside": 1.5, "none": 0.0}


def vote_weight(label: Column) -> Column:
    out = F.when(label.isNull(), 0.0)
    for k, w in VOTES.items():
        out = out.when(label == k, w)
    return out.otherwise(1.0)


def lexicon_bonus(title: Column, summary: Column, lex: Lexicons = Lexicons()) -> Column:
    """Half a vote of the phenomenon that the hits hint at, the first of four rules that holds."""
    risk, hedge, opt = hits(summary, lex.risks), hits(summary, lex.hedges), hits(title, lex.optimistic)
    return (
        F.when((risk > 0) & (hedge > 0), 0.5 * VOTES["hedged_downside"]).when((risk > 0) & (opt > 0), 0.5 * VOTES["euphemistic_risk"])
        .when((opt > 1) & (risk == 0), 0.5 * VOTES["title_body_mismatch"]).when((hedge > 1) & (risk == 0), 0.3 * VOTES["omitted_downside_context"]).otherwise(0.0)
    )


def priority(rows: DataFrame, methods: Sequence[str], key: str, bonus: Column) -> DataFrame:
    """key, score (votes of the methods' columns plus bonus) and the distinct phenomena they name, in order of the alphabet."""
    score = bonus
    for m in methods:
        score = score + vote_weight(F.col(m))
    named = F.array_sort(F.array_distinct(F.filter(F.array(*[F.col(m) for m in methods]), lambda x: x.isNotNull() & (x != "none"))))
    return rows.select(key, F.round(score, 4).alias("score"), F.array_join(named, ",").alias("phenomena"))
