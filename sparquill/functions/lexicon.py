"""Lexicon scoring as column expressions; every function takes its token lists as parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default word lists of the rule labels.
POSITIVE = ("增长", "提升", "改善", "修复", "亮眼", "稳健", "回升", "突破", "向好")
NEGATIVE = ("下降", "承压", "放缓", "拖累", "收窄", "下滑", "风险", "减值", "恶化")
OPTIMISTIC = ("积极", "主动", "稳步", "健康发展", "向好", "优化", "夯实", "蓄势", "信心")
HEDGES = ("短期", "阶段性", "暂时", "预计", "有望", "边际", "平稳")
# Word lists of the scorer.
RISKS = ("承压", "下滑", "风险", "拖累", "放缓", "减值", "恶化")
TITLE_PROMISES = ("有望", "看好", "成长", "向好", "景气", "改善")
# Word lists of the extended labels.
WIDE_POSITIVE = (
    "增长", "提升", "改善", "回升", "突破", "向好", "亮眼", "稳健", "超预期", "高增", "放量", "扩张", "盈利", "利好", "景气",
    "修复", "新高", "加速", "翻倍", "丰厚", "产销两旺", "量价齐升", "毛利率提升", "净利润增长",
)
WIDE_NEGATIVE = (
    "下降", "承压", "放缓", "拖累", "收窄", "下滑", "风险", "减值", "恶化", "亏损", "萎缩", "低迷", "疲软", "缩量", "暴跌",
    "利空", "不及预期", "下修", "走弱", "下行", "毛利率下降", "计提减值", "业绩下滑", "营收下降",
)
WIDE_NEUTRAL = (
    "持平", "平稳", "波动", "分化", "结构性", "常态化", "维持", "基本面稳定", "同比持平", "环比持平", "温和", "震荡",
    "正常波动", "窄幅", "中性", "符合预期", "区间运行", "保持稳定", "变化不大", "整体平稳", "基本一致",
)


@dataclass(frozen=True)
class Lexicons:
    positive: Sequence[str] = POSITIVE
    negative: Sequence[str] = NEGATIVE
    optimistic: Sequence[str] = OPTIMISTIC
    hedges: Sequence[str] = HEDGES
    risks: Sequence[str] = RISKS
    promises: Sequence[str] = TITLE_PROMISES


def hits(text: Column, tokens: Sequence[str]) -> Column:
    """Sum over tokens of their non-overlapping occurrences; tokens inside of others count on their own."""
    text = F.coalesce(text, F.lit(""))
    total = F.lit(0)
    for t in tokens:
        total = total + F.try_divide(F.length(text) - F.length(F.replace(text, F.lit(t))), F.lit(len(t))).cast("int")
    return total.cast("long")


def evidence(text: Column, tokens: Sequence[str], most: int, label: str = "lexicon_hit") -> Column:
    """The first `most` tokens, in the lists' order, that occur in the text, as (text, label) structs."""
    found = F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(F.coalesce(text, F.lit("")), t))
    return F.transform(F.slice(found, 1, most), lambda t: F.struct(t.alias("text"), F.lit(label).alias("label")))


def whole_text(title: Column, summary: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")))


def rule_hits(title: Column, summary: Column, lex: Lexicons = Lexicons()) -> dict[str, Column]:
    """The counts that rule_labels() goes by, and whether both texts are filled."""
    text = whole_text(title, summary)
    counts = {k: hits(text, getattr(lex, k)) for k in ("positive", "negative", "optimistic", "hedges")}
    filled = (F.length(F.coalesce(title, F.lit(""))) > 0) & (F.length(F.coalesce(summary, F.lit(""))) > 0)
    return counts | {"title_optimistic": hits(title, lex.optimistic), "summary_optimistic": hits(summary, lex.optimistic), "both_filled": filled}


def labels_of(found: Mapping[str, Column]) -> dict[str, Column]:
    """Sentiment, optimism, phenomenon and uncertainty from rule_hits()."""
    pos, neg, opt, hedge = (found[k] for k in ("positive", "negative", "optimistic", "hedges"))
    leap = found["both_filled"] & (found["title_optimistic"] > found["summary_optimistic"] + 1)
    return {
        "fundamental_sentiment": F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral"),
        "strategic_optimism": F.when(opt >= F.greatest(F.lit(2).cast("long"), hedge + 1), "high").when((neg > opt) & (hedge == 0), "low").otherwise("balanced"),
        "phenomenon": F.when((hedge > 0) & (neg > 0), "hedged_downside").when((opt > 0) & (neg > 0), "euphemistic_risk").when(leap, "title_body_mismatch").otherwise("none"),
        "uncertainty": F.lit(0.45),
    }


def rule_labels(title: Column, summary: Column, lex: Lexicons = Lexicons()) -> dict[str, Column]:
    """Sentiment, optimism, phenomenon, uncertainty and evidence by counts of hits."""
    text = whole_text(title, summary)
    return labels_of(rule_hits(title, summary, lex)) | {"evidence_spans": evidence(text, [*lex.positive, *lex.negative, *lex.optimistic, *lex.hedges], 8)}


def extended_labels(title: Column, summary: Column, positive: Sequence[str] = WIDE_POSITIVE, negative: Sequence[str] = WIDE_NEGATIVE, neutral: Sequence[str] = WIDE_NEUTRAL, band: float = 0.15) -> dict[str, Column]:
    """Sentiment by the ratio of hits, the title's counting twice more; uncertainty falls with the ratio's size."""
    text = whole_text(title, summary)
    pos = hits(text, positive) + 2 * hits(title, positive)
    neg = hits(text, negative) + 2 * hits(title, negative)
    total = pos + neg + hits(text, neutral)
    ratio = F.coalesce(F.try_divide((pos - neg).cast("double"), total.cast("double")), F.lit(0.0))
    return {
        "fundamental_sentiment": F.when(total == 0, "neutral").when(ratio > band, "positive").when(ratio < -band, "negative").otherwise("neutral"),
        "strategic_optimism": F.lit("balanced"), "phenomenon": F.lit("none"),
        "uncertainty": F.when(total == 0, 0.5).otherwise(F.round(1 - F.least(F.lit(1.0), 0.5 + F.abs(ratio)), 4)),
        "evidence_spans": evidence(text, [*positive, *negative, *neutral], 10),
    }


def continuous_score(text: Column, positive: Sequence[str] = WIDE_POSITIVE, negative: Sequence[str] = WIDE_NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative) hits, 0 without hits."""
    p, n = hits(text, positive), hits(text, negative)
    return F.coalesce(F.try_divide((p - n).cast("double"), (p + n).cast("double")), F.lit(0.0))


def divergence(title: Column, summary: Column, lex: Lexicons = Lexicons()) -> Column:
    """Net hits of the title less those of the summary."""
    net = lambda x: hits(x, lex.positive) - hits(x, lex.negative)
    return (net(title) - net(summary)).cast("double")
