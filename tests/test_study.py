"""Statistics in one row, adjudication, human evaluation, models' answers, report tables, counted writes, registries."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparquill.operators import agreement, evaluation, inference, portfolio, reports
from sparquill.sources import writers


def test_drawn_is_the_plain_generator():
    for n in (1, 2, 7, 64, 100, 1000):
        rng = random.Random(42)
        assert portfolio.drawn(n, 50, 42).tolist() == [[rng.randrange(n) for _ in range(n)] for _ in range(50)]


def plain_summary(values, resamples=1000):
    n, rng = len(values), random.Random(42)
    means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(resamples))
    mean = sum(values) / n
    t = 0.0
    if n >= 2:
        e, lag = [v - mean for v in values], int(n ** (1 / 3))
        total = sum(x * x for x in e) + sum(2 * (1 - j / (lag + 1)) * sum(e[i] * e[i - j] for i in range(j, n)) for j in range(1, lag + 1))
        t = mean / math.sqrt(max(total / n / n, 1e-18))
    return n, round(mean, 6), round(means[int(0.025 * resamples)], 6), round(means[int(0.975 * resamples)], 6), round(t, 6)


def test_summary_of_coefficients_is_that_of_plain_loops(spark):
    rng = random.Random(7)
    series = {"one": [0.25], "same": [0.5] * 9, "zero": [0.0, 0.0], "long": [rng.gauss(0.02, 0.1) for _ in range(500)], "turns": [1.0, -1.0] * 20}
    rows = [(s, f"{i:04d}", v) for s, values in series.items() for i, v in enumerate(values)] + [("long", "9999", None), ("none", "0000", None)]
    rng.shuffle(rows)
    found = portfolio.ic_summary(spark.createDataFrame(rows, "signal string, day string, ic double").repartition(3), "signal", "day", "ic")
    got = {r["signal"]: r for r in found.collect()}
    assert set(got) == set(series)
    for s, values in series.items():
        r = got[s]
        n, mean, low, high, t = plain_summary(values)
        assert (r["n"], r["mean"], r["ci_lower"], r["ci_upper"]) == (n, mean, low, high), s
        assert r["t_stat"] == pytest.approx(t, rel=1e-9, abs=1e-6) and 0 <= r["p_value"] <= 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Scan ExistingRDD") == 1


# ---------------------------------------------------------------- adjudication, human evaluation


def plain_adjudicated(a, b, c):
    spans = lambda x: [y.strip() for y in (x["evidence_spans"] or []) if y.strip()]
    order = {"low": 0, "medium": 1, "high": 2}
    rank = lambda x: order.get(x["annotation_confidence"], 0)
    if c is not None:
        label = Counter([a["label"], b["label"], c["label"]]).most_common(1)[0][0]
        union = list(dict.fromkeys(spans(a) + spans(b) + spans(c)))
        return label, union, list(order)[sorted([rank(a), rank(b), rank(c)])[1]], []
    union = spans(a) if spans(a) == spans(b) else list(dict.fromkeys(spans(a) + spans(b)))
    return a["label"], union, list(order)[min(rank(a), rank(b))], [] if a["label"] == b["label"] else ["label"]


def test_adjudication_against_a_plain_loop(spark):
    rng = random.Random(5)
    kind = "struct<label:string,evidence_spans:array<string>,annotation_confidence:string>"
    one = lambda: {"label": rng.choice([None, "x", "y", "z"]), "evidence_spans": rng.choice([None, [], ["p", " p", "q"], ["q", "", "r"], ["r"]]), "annotation_confidence": rng.choice([None, "low", "medium", "high", "?"])}
    items = [(i, one(), one(), one()) for i in range(300)]
    df = spark.createDataFrame(items, f"item_id int, a {kind}, b {kind}, c {kind}")
    for third in ("c", None):
        for r in agreement.adjudicated(df, ["label"], c=third).collect():
            i = r["item_id"]
            got = r["resolved"]
            want = plain_adjudicated(items[i][1], items[i][2], items[i][3] if third else None)
            assert (got["label"], got["evidence_spans"], got["annotation_confidence"], got["unresolved"]) == want, items[i]


def test_raters_side_by_side(spark):
    rows = spark.createDataFrame([(1, "ann", "x", 1), (1, "ann", "z", 2), (1, "bob", "y", 1), (2, "bob", None, 1), (3, "eve", "q", 1)], "item_id int, rater string, label string, line int")
    wide = {r["item_id"]: (r["r0"] and r["r0"]["label"], r["r1"] and (r["r1"]["label"],)) for r in agreement.side_by_side(rows, ["ann", "bob"], ["label"], order="line").collect()}
    assert wide == {1: ("z", ("y",)), 2: (None, (None,))}


def test_human_evaluation_by_hand(spark):
    rows = [
        (0, "a", 1, "hedge", "p", "no", "1", "5"), (0, "a", 2, "hedge", "p", " YES", "4", "x"), (1, "a", 1, "other", None, "no", "2", None), (1, "b", 1, "", "mood", None, "3.5", "2"), (0, "c", 3, None, "", "maybe", None, None),
    ]
    df = spark.createDataFrame(rows, "rater int, report_id string, line int, gold_phenomenon string, pred_phenomenon string, factual_preservation string, faithfulness string, tone_removal string")
    got = {r["scope"]: (r["items"], r["yes_rate"], r["faithfulness_n"], r["faithfulness_mean"], r["faithfulness_std"], r["tone_removal_n"], r["tone_removal_mean"]) for r in agreement.human_evaluation(df).collect()}
    assert got == {"all": (3, 0.3333, 3, 3.1667, 0.8498, 1, 2.0), "hedge": (1, 0.5, 2, 3.0, 1.0, 0, 0.0), "mood": (1, 0.0, 1, 3.5, 0.0, 1, 2.0), "unknown": (1, 0.0, 0, 0.0, 0.0, 0, 0.0)}


# ---------------------------------------------------------------- models' answers


def test_models_answers(spark, tmp_path):
    made = str(tmp_path)

    def make():
        import os
        import uuid

        open(os.path.join(made, uuid.uuid4().hex), "w").close()

        def ask(row):
            assert row["tags"] is None or isinstance(row["tags"], list)
            if row["text"] is None:
                raise KeyError("text")
            return {"fits": {"n": len(row["text"]), "tags": row["tags"]}, "less": {"n": 1}, "list": [1], "nan": {"n": 1, "x": float("nan")}, "wrong": {"n": "many"}}[row["text"]]

        return ask

    rows = [(i, t, ["a", "b"] if i % 2 else None) for i, t in enumerate(["fits", "less", "list", "nan", "wrong", None] * 20)]
    df = spark.createDataFrame(rows, "i int, text string, tags array<string>").repartition(2)
    out = inference.with_answers(df, ["text", "tags"], make, "n int, tags array<string>, x double", F.struct(F.lit(-1).alias("n"), F.lit(None).alias("tags"), F.lit(None).alias("x"))).cache()
    got = {r["i"]: (r["answer"]["n"], r["answer"]["tags"], r["answer_error"]) for r in out.collect()}
    assert got[0] == (4, None, None) and got[6] == (4, None, None) and got[1] == (1, None, None)
    assert [got[i][0] for i in (2, 3, 4, 5)] == [-1] * 4
    assert "list" in got[2][2] and "ValueError" in got[3][2] and "does not fit" in got[4][2] and "KeyError" in got[5][2]
    assert tuple(inference.failure_counts(out).first()) == (120, 80, 0.6667)
    assert 1 <= len(list(tmp_path.iterdir())) <= 4  # a model for each worker, not for each row or batch


def test_typed_fallbacks(spark):
    df = spark.createDataFrame([("s", "h")], "summary string, history string")

    def never():
        raise RuntimeError("no model")

    for schema, fallback, want in (
        (inference.DECOMPOSITION, inference.decomposition_fallback(F.col("history")), {"history_context_used": "h", "fallback": "decomposer_error", "risk_cues": []}),
        (inference.NEUTRALISATION, inference.neutralisation_fallback(F.col("summary")), {"neutralized_text": "s", "fallback": "neutralizer_error", "preserved_facts": []}),
        (inference.VERIFICATION, inference.verification_fallback(), {"numbers_preserved": True, "factual_consistency": 0.5, "verdict": "pass", "issues": ["verifier_error_fallback"]}),
    ):
        r = inference.with_answers(df, ["summary"], never, schema, fallback).first()
        assert "no model" in r["answer_error"] and {k: r["answer"][k] for k in want} == want


# ---------------------------------------------------------------- report tables


def test_analysts(spark):
    cases = [
        (["11.Ann", " Bob ", "", None, "12.Cy.D"], None, "Z", ["11", "12"], ["Ann", "Bob", "Cy.D"]), (["11.Ann"], ["x", " ", "y "], None, ["x", "y"], ["Ann"]), (["11.Ann"], [" "], None, [], ["Ann"]),
        ([], None, "Zed, ,Yan ", [], ["Zed", "Yan"]), (None, ["q"], None, ["q"], []), (["Ann, Eve"], None, None, [], ["Ann", " Eve"]),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, authors array<string>, author_ids array<string>, researcher string")
    ids, names = reports.analysts_of()
    assert [(r["a"], r["b"]) for r in df.select("i", ids.alias("a"), names.alias("b")).orderBy("i").collect()] == [c[3:] for c in cases]


def test_report_tables_are_sorted_and_keyed(spark, tmp_path):
    base = dict.fromkeys(reports.RAW, "")
    rows = [
        base | {"line": i, "info_code": f"i{i}", "stock_id": "1", "broker_id": "b", "broker_name": f"n{i % 2}", "publish_time": f"2024-01-0{i % 3 + 1} 09:00", "title": "T", "source_url": "u", "body": f"B{i} \n风险因素：x 风险提示：y{i}", "authors": [f"{i}.A", "B"], "author_ids": None, "fetched_at": f"f{i}"}
        for i in range(6)
    ] + [base | {"line": 9, "info_code": " ", "authors": None, "author_ids": None}]
    schema = "line int, authors array<string>, author_ids array<string>, " + ", ".join(f"{c} string" for c in reports.RAW)
    made = reports.made_reports(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema), "line")
    tables = reports.report_tables(made)
    reports.write_report_tables(tables, str(tmp_path / "t"))
    count = {n: spark.read.parquet(str(tmp_path / "t" / n)).count() for n in tables}
    assert count == {"reports": 3, "ratings": 3, "brokers": 1, "aliases": 2, "analysts": 7, "bridge": 9, "versions": 6}
    for n, key in reports.KEYS.items():
        df = spark.read.parquet(str(tmp_path / "t" / n))
        assert df.select(*key).distinct().count() == df.count()
    kept = {r["publish_time"][:10]: r for r in tables["reports"].collect()}
    assert kept["2024-01-01"]["body_raw"] == "B3 \n风险因素：x" and kept["2024-01-01"]["risk_section_raw"] == "风险提示：y3" and kept["2024-01-01"]["updated_at"] == "f3"
    assert tables["brokers"].first()["broker_name"] == "n0"
    alias = {r["broker_name"]: (r["first_seen_at"], r["last_seen_at"], r["created_at"], r["updated_at"]) for r in tables["aliases"].collect()}
    assert alias["n1"] == ("2024-01-01 09:00", "2024-01-03 09:00", "f1", "f5")
    assert tuple(reports.extraction_counts(made).first()) == (6, 6, 6, 6)
    assert reports.reports_by_date(tables["reports"]).where("report_date = '2024-01-01'").first()["summary"] == "B3 风险因素：x"
    assert all(t.count() == 0 for t in reports.report_tables(made.limit(0)).values())


# ---------------------------------------------------------------- counted writes, registries


def test_counted_writes_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, None if i % 3 else "bad", f"2024-01-{i + 1:02d}" if i else "", " " if i % 2 else "t") for i in range(10)], "i int, why string, day string, text string").mapInArrow(noted, "i int, why string, day string, text string")
    seen = writers.write_counted(df, str(tmp_path / "t"), writers.counters(F.col("why"), ["bad"], "day", ["text"]), keep=F.col("why").isNull())
    assert seen == {"rows": 10, "reason_kept": 6, "reason_bad": 4, "reason_other": 0, "first": "2024-01-02", "last": "2024-01-10", "with_text": 5}
    assert reads.value == 10 and spark.read.parquet(str(tmp_path / "t")).count() == 6
    said = json.loads(writers.write_with_manifest({"a": (spark.range(3), writers.counters()), "b": (spark.range(0), writers.counters())}, str(tmp_path / "m")))
    assert said == {"a": {"rows": 3}, "b": {"rows": 0}} == json.loads((next((tmp_path / "m" / "manifest").glob("*.txt"))).read_text())


def test_registry(spark):
    rows = [("full", 1, "a"), ("full", 2, None), ("copy", 2, None), ("copy", 1, "a"), ("other", 1, "a"), ("other", 2, "b"), ("twice", 1, "a"), ("twice", 1, "a"), ("twice", 2, None)]
    digests = evaluation.table_digests(spark.createDataFrame(rows, "setting string, id int, label string"), "setting")
    fields = ["strategic_f1", "phenomenon_f1", "evidence_f1", "mean_rank_ic_20", "ls_sharpe_20", "ece"]
    metrics = spark.createDataFrame([("full", 0.5, 0.25, 0.1, 0.2, 1.0, 0.3), ("copy", 0.5, 0.25, None, None, None, 0.3), ("other", None, None, None, None, None, None), ("gone", 0.5, 0.0, 0.1, 0.0, 0.0, 0.0)], "setting string, " + ", ".join(f"{f} double" for f in fields))
    got = {r["setting"]: (r["composite_j"], r["has_table"], r["same_as_full"]) for r in evaluation.registry(metrics, digests, "full").collect()}
    assert got == {"full": (0.37, True, False), "copy": (0.18, True, True), "other": (0.0, True, False), "gone": (0.185, False, False)}
    equal = {(r["field"], r["settings"]) for r in evaluation.equal_metrics(metrics, ["strategic_f1", "evidence_f1", "ece"]).collect()}
    assert equal == {("strategic_f1", "copy,full,gone"), ("evidence_f1", "full,gone"), ("evidence_f1", "copy,other"), ("ece", "copy,full")}


def test_weight_grid_cell_by_hand(spark, tiny):
    """One setting of the grid is the back-test of signals that a plain loop makes."""
    from sparquill.operators import signals
    from sparquill.plans import catalog, catalog_runs

    alpha, beta, gamma = 0.8, 0.4, 0.2
    rows = catalog._signed(spark, tiny).where("weight > 0").select("trade_date", "stock_code", "weight", "body_only", "strategic_optimism_gap", "uncertainty", "forward_return_20").collect()
    days = {}
    for r in rows:
        composite = round(alpha * r["body_only"] - beta * r["strategic_optimism_gap"] - gamma * r["uncertainty"], 6)
        value = round(0.75 * composite + 0.25 * r["body_only"] - 0.15 * r["strategic_optimism_gap"], 6)
        d = days.setdefault((r["trade_date"], r["stock_code"]), [0.0, 0.0, r["forward_return_20"]])
        d[0] += r["weight"] * value
        d[1] += r["weight"]
    each = spark.createDataFrame([(t, c, "cell", round(v / w, 6), fr) for (t, c), (v, w, fr) in days.items()], "trade_date date, stock_code string, signal string, value double, forward_return double")
    norm = signals.normalise(each)
    mean_ic = np.mean([r["ic"] for r in portfolio.rank_ic(norm, ["trade_date", "signal"]).collect()])
    summary = portfolio.summary(portfolio.long_short(norm, digits=catalog.DIGITS), horizon=20).first()
    cell = catalog_runs.weight_grid(spark, tiny).where(f"alpha = {alpha} and beta = {beta} and gamma = {gamma}").first()
    assert cell["mean_ic"] == pytest.approx(mean_ic, abs=2e-6)
    assert cell["sharpe"] == pytest.approx(summary["gross_sharpe"], abs=2e-4) and cell["turnover"] == pytest.approx(summary["turnover"], abs=2e-6)


# ---------------------------------------------------------------- fields of landed rows


def test_entities_and_first_fields(spark):
    from sparquill.functions import text as X

    df = spark.createDataFrame([("<p>Caf&eacute; &lt;b&gt;x&#x2014;y</p>\r\n&hellip;&nbsp;z", " \n", "0", "7.5"), (None, None, None, " ")], "t string, a string, n string, m string")
    rows = df.select(
        X.strip_tags(F.col("t"), every_entity=True).alias("every"), X.inline(F.col("t"), every_entity=True).alias("line"), X.first_text(F.col("a"), F.lit(" x  y "), F.lit("z"), most=2).alias("first"), X.first_number(F.col("n"), F.col("m")).alias("number"),
        X.stock_code(F.col("a")).alias("code"), X.strip(F.lit("\n\t a b \u3000")).alias("strip"),
    ).collect()
    assert tuple(rows[0]) == ("Caf\u00e9 x\u2014y\n\u2026 z", "Caf\u00e9 x\u2014y \u2026 z", "x ", "7.5", "", "a b")
    assert tuple(rows[1]) == ("", "", "x ", "", "", "a b")
