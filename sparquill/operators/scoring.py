"""Routing, refinement and scoring of report predictions, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparquill.functions.lexicon import Lexicons, hits
from sparquill.functions.text import history_coverage, numbers_within
from sparquill.operators.signals import label_score, optimism_score


@dataclass(frozen=True)
class Flags:
    """Which stages take part."""

    retrieval: bool = True
    neutralizer: bool = True
    verifier: bool = True
    gate: bool = True
    prior: bool = True


VARIANTS = {
    "full": Flags(), "no_retrieval": Flags(retrieval=False), "no_neutralizer": Flags(neutralizer=False), "no_verifier": Flags(verifier=False),
    "no_gate": Flags(gate=False), "no_prior": Flags(prior=False),
}


def filled(items: Column) -> Column:
    """How many items are not blank; null counts as none."""
    return F.when(items.isNull(), 0).otherwise(F.size(F.filter(items, lambda x: F.trim(x) != "")))


def _or_none(label: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("none"))


def route(direct: Column, cot: Column, react: Column, rule: Column, title: Column, summary: Column, lex: Lexicons = Lexicons()) -> dict[str, Column]:
    """One set of labels from four predictions (structs with the label fields, uncertainty and evidence_spans)."""
    there = lambda c: c.isNotNull() & (c != "")
    opt_d, opt_c, opt_r = direct["strategic_optimism"], cot["strategic_optimism"], react["strategic_optimism"]
    optimism = F.when(there(opt_r) & (_or_none(react["phenomenon"]) != "none"), opt_r).when(F.coalesce(there(opt_c), F.lit(False)) & ~F.coalesce(there(opt_d), F.lit(False)), opt_c)
    optimism = optimism.when((opt_d == "balanced") & there(opt_c) & (opt_c != "balanced"), opt_c).otherwise(opt_d)
    risk, hedge, promise = hits(summary, lex.risks), hits(summary, lex.hedges), hits(title, lex.optimistic)
    any_of = lambda text, tokens: F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(F.coalesce(text, F.lit("")), t))
    p_rule = _or_none(rule["phenomenon"])
    phenomenon = (
        F.when(_or_none(react["phenomenon"]) != "none", react["phenomenon"]).when(_or_none(cot["phenomenon"]) != "none", cot["phenomenon"])
        .when(_or_none(direct["phenomenon"]) != "none", direct["phenomenon"])
        .when((p_rule == "hedged_downside") & (risk > 0) & ((hedge > 0) | (promise > 0)), p_rule).when((p_rule == "euphemistic_risk") & (risk > 0) & (promise > 0), p_rule)
        .when(any_of(title, lex.promises) & any_of(summary, lex.risks), "title_body_mismatch").otherwise("none")
    )
    u_direct = F.coalesce(direct["uncertainty"], F.lit(0.5))
    spans = react["evidence_spans"]
    return {
        "fundamental_sentiment": F.when(there(react["fundamental_sentiment"]), react["fundamental_sentiment"]).otherwise(direct["fundamental_sentiment"]),
        "strategic_optimism": optimism, "phenomenon": phenomenon,
        "uncertainty": F.round(F.least(F.coalesce(react["uncertainty"], u_direct), u_direct), 4),
        "evidence_spans": F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, spans).otherwise(direct["evidence_spans"]),
    }


def refine(phenomenon: Column, optimism: Column, missing: Column, risks: Column, removed: Column, flags: Flags = Flags()) -> tuple[Column, Column]:
    """(phenomenon, optimism) after what the stages found: risk hints that are missing, risk cues, removed rhetoric."""
    m, r, x = filled(missing), filled(risks), filled(removed)
    if flags.retrieval:
        phenomenon = F.when((phenomenon == "none") & (m >= 2), "omitted_downside_context").when((phenomenon == "none") & (m >= 1) & (r >= 1), "hedged_downside").otherwise(phenomenon)
        optimism = F.when((optimism == "balanced") & (m >= 2), "high").otherwise(optimism)
    if flags.neutralizer:
        optimism = F.when((optimism == "balanced") & (x >= 2), "high").otherwise(optimism)
        phenomenon = F.when((phenomenon == "none") & (x >= 3), "euphemistic_risk").otherwise(phenomenon)
    return phenomenon, optimism


def hedge_score(text: Column, cues: Column, lex: Lexicons = Lexicons()) -> Column:
    return F.round(F.least(F.lit(1.0), 0.15 * hits(text, lex.hedges) + 0.2 * filled(cues)), 4)


def omission_penalty(text: Column, context: Column, risks: Column, missing: Column, lex: Lexicons = Lexicons()) -> Column:
    beyond = F.greatest(F.lit(0), hits(context, lex.risks) - hits(text, lex.risks))
    return F.round(F.least(F.lit(1.0), 0.08 * beyond + 0.1 * filled(risks) + 0.18 * filled(missing)), 4)


def uncertainty(verifier: Column | None, own: Column | None, coverage: Column | None, disagreement: Column | None = None) -> Column:
    """Mean of the parts that are there: the model's own, 1 - consistency, a penalty for a failed check, 1 - coverage,
    disagreement; 0.5 without any. A null verifier struct gives no part."""
    parts = [own.cast("double")] if own is not None else []
    if verifier is not None:
        c = F.coalesce(verifier["factual_consistency"], F.lit(1.0))
        parts.append(F.when(verifier.isNotNull(), F.greatest(F.lit(0.0), 1 - c)))
        wrong = lambda field, w: F.when(~verifier[field], w).otherwise(0.0)
        penalty = wrong("numbers_preserved", 0.25) + wrong("entities_preserved", 0.15) + wrong("no_new_facts", 0.35)
        parts.append(F.when(verifier["verdict"] == "fail", F.least(F.lit(0.6), F.greatest(F.lit(0.2), penalty))))
    if coverage is not None:
        parts.append(F.greatest(F.lit(0.0), 1 - coverage))
    if disagreement is not None:
        parts.append(disagreement.cast("double"))
    if not parts:
        return F.lit(0.5)
    there = F.array_compact(F.array(*parts))
    return F.when(F.size(there) == 0, 0.5).otherwise(F.round(F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(there), F.lit(1)), 4))


def penalty_confidence(u: Column, verifier: Column | None) -> Column:
    base = F.greatest(F.lit(0.7), 1 - 0.45 * u)
    if verifier is None:
        return F.round(F.least(F.lit(1.0), base), 4)
    c = F.coalesce(verifier["factual_consistency"], F.lit(0.5))
    out = F.when(verifier.isNull(), base).when(verifier["verdict"] == "fail", F.least(base, F.greatest(F.lit(0.2), 0.5 * c))).otherwise(F.greatest(base, 0.25 + 0.75 * c))
    return F.round(F.least(F.lit(1.0), out), 4)


def measures(title: Column, summary: Column, context: Column, decomposition: Column, neutral: Column, verifier: Column, lex: Lexicons = Lexicons(), nothing: str = "") -> dict[str, Column]:
    """All that scores take from a report's texts, for any flags: hedging, omission with and without retrieval, whether the
    neutralised text counts, coverage of the history."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")))
    blank = F.array().cast("array<string>")
    plain = neutral["neutralized_text"]
    return {
        "hedge": hedge_score(text, decomposition["hedge_cues"], lex),
        "omission": omission_penalty(text, context, decomposition["risk_cues"], decomposition["missing_risk_hints"], lex),
        "bare_omission": omission_penalty(text, F.lit(""), blank, blank, lex),
        "active": F.coalesce((plain != "") & (plain != summary) & (filled(neutral["removed_rhetoric"]) > 0) & (verifier["verdict"] == "pass"), F.lit(False)),
        "coverage": history_coverage(context, nothing),
    }


def score_measures(labels: Mapping[str, Column], found: Mapping[str, Column], verifier: Column, flags: Flags = Flags()) -> dict[str, Column]:
    """All scores of one report under the flags, from measures(); no text is looked at."""
    active = found["active"] if flags.neutralizer else F.lit(False)
    fact, raw = label_score(labels["fundamental_sentiment"]), optimism_score(labels["strategic_optimism"])
    counterfactual = F.when(active, fact).otherwise(raw)
    hedge, omission = found["hedge"], found["omission" if flags.retrieval else "bare_omission"]
    gap = F.round(raw - counterfactual + hedge + omission, 4)
    coverage = found["coverage"] if flags.retrieval else F.lit(1.0)
    checked = verifier if flags.verifier else None
    u = uncertainty(checked, labels["uncertainty"], coverage)
    conf = penalty_confidence(u, checked)
    effective = gap * conf if flags.gate else gap
    if not flags.prior:
        effective = F.round(0.6 * effective, 4)
    composite = F.round(fact - 0.85 * effective, 4)
    phenomenon = labels["phenomenon"]
    if not flags.retrieval:
        phenomenon = F.when(phenomenon == "hedged_downside", "none").otherwise(phenomenon)
    return {
        "sentiment_score": fact, "counterfactual_score": counterfactual, "hedge_score": hedge, "omission_penalty": omission, "strategic_optimism_gap": gap,
        "retrieval_coverage": coverage, "uncertainty": u, "penalty_confidence": conf, "gated_score": F.round(fact - effective, 4), "composite_score": composite,
        "blend_score": F.round(0.7 * composite + 0.3 * fact, 4), "phenomenon": phenomenon,
    }


def score_report(labels: dict[str, Column], title: Column, summary: Column, context: Column, decomposition: Column, neutral: Column, verifier: Column, flags: Flags = Flags(), lex: Lexicons = Lexicons(), nothing: str = "") -> dict[str, Column]:
    """All scores of one report under the flags.

    neutral: struct (neutralized_text, removed_rhetoric); decomposition: struct (hedge_cues, risk_cues,
    missing_risk_hints); verifier: struct (numbers_preserved, entities_preserved, no_new_facts, factual_consistency,
    verdict). Without retrieval the context, risk cues and missing hints are blank and coverage is 1. For several sets of
    flags make measures() columns first, and score_measures() of each set from them.
    """
    return score_measures(labels, measures(title, summary, context, decomposition, neutral, verifier, lex, nothing), verifier, flags)


def guard_neutral(candidate: Column, removed: Column, summary: Column, title: Column) -> Column:
    """Whether a neutralised text may stand: no new numbers, not much longer, and changed only where rhetoric was removed."""
    source = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")))
    n = F.length(summary)
    short = F.length(candidate) <= F.greatest(n + 120, (n * 1.6).cast("int"))
    honest = (F.trim(candidate) == F.trim(summary)) | (filled(removed) > 0)
    return F.coalesce((F.trim(candidate) != "") & numbers_within(candidate, source) & short & honest, F.lit(False))


def verifier_shortcut(a: Column, b: Column) -> Column:
    """Whether two texts are the same but for white space, so that no check by a model is needed."""
    flat = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))
    return flat(a) == flat(b)
