"""Models inside of a job: one for each Python worker, rows that fail set apart, and typed answers in their place."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions import lexicon

# fixed values: what stands for each step that fails
FALLBACK_UNCERTAINTY = 0.95
DECOMPOSITION = "factual_claims array<string>, directional_cues array<string>, hedge_cues array<string>, optimistic_rhetoric array<string>, risk_cues array<string>, evidence_spans array<string>, history_context_used string, fallback string"
NEUTRALISATION = "neutralized_text string, removed_rhetoric array<string>, preserved_facts array<string>, fallback string"
VERIFICATION = "numbers_preserved boolean, entities_preserved boolean, no_new_facts boolean, factual_consistency double, verdict string, issues array<string>"
PREDICTION = "fundamental_sentiment string, strategic_optimism string, phenomenon string, uncertainty double, evidence_spans array<struct<text:string,label:string>>, reasoning_summary string"

Model = Callable[[dict], dict]


def _plain(value):
    """A cell of a pandas frame as a model expects it."""
    if isinstance(value, np.ndarray):
        return [_plain(x) for x in value.tolist()]
    return None if isinstance(value, float) and value != value else value


def with_answers(rows: DataFrame, inputs: Sequence[str], make: Callable[[], Model], schema: str, fallback: Column, out: str = "answer") -> DataFrame:
    """rows with the model's answer (a struct of schema) and `out`_error, null where it gave one.

    make() runs once in each Python worker, when its first row comes; model(row) gets a dict of inputs and returns one of
    the answer's fields, which goes to Spark as JSON. A row for which it raises, or whose answer the schema does not take,
    has the fallback and says why; rows beside it are not concerned. Fields that an answer leaves out are null.
    """
    models: list[Model] = []

    @F.pandas_udf("json string, error string")
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple[str | None, str | None]] = []
            for row in batch.to_dict("records"):
                try:
                    if not models:
                        models.append(make())
                    answer = models[0]({k: _plain(v) for k, v in row.items()})
                    if not isinstance(answer, dict):
                        raise TypeError(f"the answer is {type(answer).__name__}, not a dict")
                    found.append((json.dumps(answer, allow_nan=False), None))
                except Exception as e:  # a row's own failure
                    found.append((None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(found, columns=["json", "error"], dtype=object)

    asked = rows.withColumn("__asked", ask(F.struct(*[F.col(c) for c in inputs])))
    asked = asked.withColumn("__made", F.from_json("__asked.json", f"{schema}, __unfit string", {"columnNameOfCorruptRecord": "__unfit"}))
    error = F.coalesce("__asked.error", F.when(F.col("__made.__unfit").isNotNull(), F.concat(F.lit("the answer does not fit: "), F.substring("__asked.json", 1, 400))))
    kind = T.StructType.fromDDL(schema).simpleString()
    asked = asked.withColumn(f"{out}_error", error)
    answer = F.when(F.col(f"{out}_error").isNull(), F.col("__made").dropFields("__unfit").cast(kind)).otherwise(fallback.cast(kind))
    return asked.withColumn(out, answer).drop("__asked", "__made")


def _strings() -> Column:
    return F.expr("cast(array() as array<string>)")


def prediction_fallback(title: Column, summary: Column, style: str, words: lexicon.Lexicons | None = None) -> Column:
    """The labels of the rules, with high uncertainty, in place of a direct prediction."""
    made = lexicon.rule_labels(title, summary, words) if words is not None else lexicon.rule_labels(title, summary)
    note = F.lit(f"[{style} fallback] rule-based fallback after LLM failure")
    labels = [made[f].alias(f) for f in ("fundamental_sentiment", "strategic_optimism", "phenomenon")]
    return F.struct(*labels, F.lit(FALLBACK_UNCERTAINTY).alias("uncertainty"), made["evidence_spans"].alias("evidence_spans"), note.alias("reasoning_summary"))


def decomposition_fallback(history: Column) -> Column:
    lists = [_strings().alias(x) for x in ("factual_claims", "directional_cues", "hedge_cues", "optimistic_rhetoric", "risk_cues", "evidence_spans")]
    return F.struct(*lists, history.alias("history_context_used"), F.lit("decomposer_error").alias("fallback"))


def neutralisation_fallback(summary: Column) -> Column:
    return F.struct(summary.alias("neutralized_text"), _strings().alias("removed_rhetoric"), _strings().alias("preserved_facts"), F.lit("neutralizer_error").alias("fallback"))


def verification_fallback() -> Column:
    good = [F.lit(True).alias(x) for x in ("numbers_preserved", "entities_preserved", "no_new_facts")]
    return F.struct(*good, F.lit(0.5).alias("factual_consistency"), F.lit("pass").alias("verdict"), F.array(F.lit("verifier_error_fallback")).alias("issues"))


def failure_counts(rows: DataFrame, out: str = "answer") -> DataFrame:
    """One row: rows, how many have the fallback, and their share."""
    failed = F.count(f"{out}_error")
    return rows.agg(F.count(F.lit(1)).alias("n"), failed.alias("failed"), F.round(F.coalesce(F.try_divide(failed.cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0)), 4).alias("failure_rate"))
