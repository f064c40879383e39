"""Literal vectors for the operators."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparquill.functions import lexicon as L
from sparquill.functions import text as X
from sparquill.operators import agreement, align, cleaning, evaluation, portfolio, sampling, scoring, signals
from sparquill.sources import readers, writers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def ratings(spark, rows):
    return spark.createDataFrame([(str(i), r, v) for i, row in enumerate(rows) for r, v in enumerate(row)], "item_id string, rater int, label string")


def test_text(spark):
    r = one(
        spark, n=X.normalize(F.lit(" a　 b \r\n\r\n c\t")), t=X.strip_tags(F.lit("<p>x &amp; <b>y</b></p>")), c=X.stock_code(F.lit("sz12")), long=X.stock_code(F.lit("1234567")),
        nan=X.blank_if_nullish(F.lit(" NaN ")), day=X.trade_date(F.lit("2024/01/02 10:00")), num=X.numbers(F.lit("3.5% up 3.5% of 12")), ok=X.numbers_within(F.lit("12"), F.lit("12 and 3")),
        rng=X.price_range(F.lit("1"), F.lit("2")), half=X.price_range(F.lit(None).cast("string"), F.lit("2")), cov=X.history_coverage(F.lit("a\nb\n\n")), sid=X.secid(F.lit("600000")),
    )
    assert (r.n, r.t, r.c, r.long, r.nan, r.day, r.num, r.ok) == ("a b\nc", "x & y", "000012", "1234567", "", "2024-01-02", ["3.5%", "12"], True)
    assert (r.rng, r.half, r.cov, r.sid) == ("1-2", "2", 0.4, "1.600000")


def test_text_sections(spark):
    head, tail = X.split_risk(F.lit("body RISK: b WARN: c"), ["WARN:", "RISK:"])
    r = one(spark, h=head, t=tail, s=X.extractive_summary(F.lit("Heading\n• first line\n- second"), ["Heading"]), p=X.paragraphs(F.lit("<p>a</p> x <p> b </p>")), z=X.paragraphs(F.lit("<i>only</i>")), a=X.authors(F.lit("1.Ann, Bob")))
    assert (r.h, r.t, r.s, r.p, r.z) == ("body RISK: b", "WARN:c", "first line\nsecond", "a\nb", "only")
    assert [tuple(x) for x in r.a] == [("1", "Ann"), ("", "Bob")]


def test_lexicon_counts_overlapping_tokens(spark):
    r = one(spark, h=L.hits(F.lit("净利润增长增长"), ("增长", "净利润增长")), none=L.hits(F.lit(None).cast("string"), ("a",)), **{k: v for k, v in L.rule_labels(F.lit("业绩增长"), F.lit("预计承压"), L.Lexicons()).items()})
    assert (r.h, r.none, r.fundamental_sentiment, r.phenomenon, r.strategic_optimism) == (3, 0, "neutral", "hedged_downside", "balanced")
    assert [s.text for s in r.evidence_spans] == ["增长", "承压", "预计"]


@pytest.mark.parametrize(("values", "want"), [([1, 2, 3, 4], [-1, -0.333333, 0.333333, 1]), ([5, 5, 5], [0, 0, 0]), ([1, 1, 3, 4], [-0.666667, -0.666667, 0.333333, 1]), ([42], [0])])
def test_rank_scale(spark, values, want):
    df = spark.createDataFrame([("d", i, float(v)) for i, v in enumerate(values)], "g string, i int, v double")
    assert [r.s for r in signals.rank_scale(df, ["g"], "v", "s").orderBy("i").collect()] == want


def test_normalise_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("d", "s", 0, 1.0), ("d", "s", 1, None), ("d", "s", 2, 3.0)], "trade_date string, signal string, i int, value double")
    assert [r.value for r in signals.normalise(df).orderBy("i").collect()] == [-1.0, None, 1.0]


def test_report_signals(spark):
    made = signals.report_signals(F.lit("positive"), F.lit(0.4), F.lit(0.25), F.lit(1.9), F.lit(0.1234567))
    r = one(spark, **made)
    assert [round(r[s], 6) for s in signals.SIGNALS] == [1.0, 0.123457, -0.4, 1.9, 1.425, 1.675, 1.615, -0.3, 1.34]
    r = one(spark, **signals.report_signals(F.lit("negative"), F.lit(0.2), F.lit(0.4), F.lit(None).cast("double"), F.lit(0.0)))
    assert [r[s] for s in ("composite", "uncertainty_gated", "finance_blend", "finance_plus_gap", "gap_scaled", "quality_weighted")] == [-1.2, -0.72, -1.15, -1.18, -0.15, -0.782]
    assert one(spark, w=signals.report_weight(F.lit("0"), F.lit("x"), F.lit(2.0)), z=signals.report_weight(F.lit(-1.0))).asDict() == {"w": 2.0, "z": 0.0}


def test_asof_and_returns(spark):
    p = spark.createDataFrame([("s", f"2024-01-0{d}", float(c), 0.0) for d, c in ((1, 10), (2, 11), (4, 0), (5, 12))], "stock_code string, trade_date string, close double, pct_change double").withColumn("trade_date", F.to_date("trade_date"))
    c = align.price_context(p, horizons=(1,))
    assert [r.forward_return_1 for r in c.orderBy("trade_date").collect()] == [0.1, -1.0, None, None]
    rep = spark.createDataFrame([("a", "s", "2024-01-03"), ("b", "s", "2024-01-01"), ("c", "s", "2024-01-05"), ("d", "t", "2024-01-01")], "id string, stock_code string, report_date string").withColumn("report_date", F.to_date("report_date"))
    got = {r.id: str(r.trade_date) for r in align.asof_forward(rep, c, "same_day_close").collect()}
    assert got == {"a": "2024-01-04", "b": "2024-01-01", "c": "2024-01-05"}
    assert {r.id: str(r.trade_date) for r in align.asof_forward(rep, c).collect()} == {"a": "2024-01-05", "b": "2024-01-02"}


def test_history(spark):
    c = spark.createDataFrame([("k", i, f"r{i}", f"t{i}") for i in range(8)], "key string, at int, id string, text string")
    got = {r.at: [x.id for x in r.history or []] for r in align.history_before(c.select("key", "at"), c, 3).collect()}
    assert got[0] == [] and got[2] == ["r0", "r1"] and got[7] == ["r4", "r5", "r6"]


def test_portfolio(spark):
    df = spark.createDataFrame([("s", 1, v, r, c) for v, r, c in ((0.0, 0.01, "4"), (0.0, 0.02, "2"), (1.0, 0.03, "3"), (1.0, -0.02, "1"))], "signal string, trade_date int, value double, forward_return double, stock_code string")
    r = portfolio.long_short(df, quantiles=2).first()
    assert (r.shorts, r.longs, r.gross_return, r.turnover) == (["2", "4"], ["1", "3"], -0.01, None)
    series = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.1, -0.2, 0.3, 0.05, 0.15, -0.1, 0.2, 0.25])], "signal string, d int, v double")
    r = portfolio.newey_west(series, "signal", "d", "v").first()
    assert portfolio.newey_west_lag(64) == 3 and r.n == 8 and r.mean == 0.09375
    r = portfolio.bootstrap_ci(spark.createDataFrame([("s", i, 1.0) for i in range(100)], "signal string, d int, v double"), "signal", "d", "v").first()
    assert (r.ci_lower, r.ci_upper) == (1.0, 1.0)


def test_pearson_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(portfolio.pearson("x", "y").alias("r")).first().r is None


def test_agreement(spark):
    r = ratings(spark, ["aa", "ab", "bb", "aa", "bb", "ab"])
    assert agreement.krippendorff(r, "label").first().alpha == 0.6
    n = spark.createDataFrame([(str(i), k, v) for i, p in enumerate([(5, 4), (3, 3), (2, 4), (4, 4)]) for k, v in enumerate(p)], "item_id string, rater int, score int")
    assert agreement.krippendorff(n, "score", interval=True).first().alpha == 0.2771
    k = agreement.cohen_kappa(agreement.pairs_of(r, 0, 1)).first()
    assert (k.n, k.agreement, k.kappa) == (6, 0.6667, 0.4)
    a = one(spark, x=agreement.adjudicate(F.lit("a"), F.lit("b"), F.lit("b")), y=agreement.adjudicate(F.lit("a"), F.lit("b"), F.lit("c")))
    assert (a.x, a.y) == ("b", "a")


def test_evaluation(spark):
    pairs = spark.createDataFrame([("1", "a", "a"), ("2", "a", "b"), ("3", "b", "b"), ("4", "c", "a")], "report_id string, gold string, pred string")
    assert evaluation.macro_f1(pairs).first().macro_f1 == 0.3889
    spans = spark.createDataFrame([(["A", "B"], ["A", "C"])], "gold_spans array<string>, pred_spans array<string>")
    r = evaluation.span_prf(spans).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    assert evaluation.confusion(pairs, ["a", "b", "c"]).count() == 9
    e = spark.createDataFrame([("s", 1.0, 500, 100, False)], "stage string, latency double, input_tokens int, output_tokens int, failed boolean")
    assert evaluation.stage_costs(e).first().cost == 0.0008


def test_scoring(spark):
    v = F.struct(F.lit(True).alias("numbers_preserved"), F.lit(True).alias("entities_preserved"), F.lit(True).alias("no_new_facts"), F.lit(0.9).alias("factual_consistency"), F.lit("pass").alias("verdict"))
    r = one(spark, u=scoring.uncertainty(v, F.lit(0.3), F.lit(1.0)), c=scoring.penalty_confidence(F.lit(0.2), v), none=scoring.uncertainty(None, None, None))
    assert (r.u, r.c, r.none) == (0.1333, 0.925, 0.5)
    p, o = scoring.refine(F.lit("none"), F.lit("balanced"), F.array(F.lit("x"), F.lit("y")), F.array(), F.array())
    r = one(spark, p=p, o=o, bad=scoring.guard_neutral(F.lit("9"), F.array(F.lit("x")), F.lit("abc"), F.lit("")), good=scoring.guard_neutral(F.lit("ab"), F.array(F.lit("c")), F.lit("abc"), F.lit("")))
    assert (r.p, r.o, r.bad, r.good) == ("omitted_downside_context", "high", False, True)


def test_cleaning(spark):
    raw = spark.createDataFrame([(1, "2024-01-02", "1", "c", "T", " s "), (0, "2024-01-02", "1", "d", "T", "s"), (2, "2024-01-02", "2", "c", "T", " ")], "seq int, report_date string, stock_code string, company_name string, title string, summary string")
    rows = cleaning.clean_reports(raw).collect()
    assert [(r.company_name, r.stock_code, r.summary) for r in rows] == [("d", "000001", "s")]
    ann = spark.createDataFrame([("a", "hello", "x", [(0, 2, "he")]), ("b", "hello", "bad", [(1, 9, "ello")]), ("a", "hello", "x", None)], "report_id string, text string, lab string, spans array<struct<start:int,end:int,text:string>>")
    got = sorted((r.report_id, r.problem) for r in cleaning.annotation_errors(ann, {"lab": ["x"]}).collect())
    assert got == [("a", "duplicate"), ("b", "label:lab"), ("b", "span")]


def test_sampling(spark):
    assert sampling.quotas({2022: 1, 2023: 5, 2024: 5}, 7) == {2022: 1, 2023: 4, 2024: 2}
    df = spark.createDataFrame([(i, 2022 + i % 3) for i in range(30)], "id long, y int")
    first, main = sampling.two_stage(df, "y", "id", 6, 9)
    assert first.count() == 6 and main.count() == 9 and first.join(main, "id").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿x,y\n1,"a\nb"\n', encoding="utf-8")
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), ["x", "y"]).first().asDict() == {"x": "1", "y": "a\nb"}
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "a.csv"), ["y", "x"])
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[2]\n')
    with pytest.raises(Exception, match="no JSON object"):
        readers.read_jsonl_strict(spark, str(tmp_path / "a.jsonl"), "a int").collect()
    df = spark.createDataFrame([("train", 1), ("odd", 2)], "split string, x int")
    with pytest.raises(Exception, match="unknown split"):
        writers.write_splits(df, str(tmp_path / "out"))
    writers.write_splits(df.where("x = 1"), str(tmp_path / "ok"))
    assert json.loads(writers.manifest({"t": df}, "split", "x"))["t"]["rows"] == 2
    assert "a\\_b" in writers.latex_table(spark.createDataFrame([("a_b", 1.234)], "n string, v double"), ["n", "v"], "c")
    assert one(spark, j=readers.unwrap_jsonp(F.lit('cb({"a": (1)});'))).j == '{"a": (1)}'
    k = readers.kline_rows(spark.createDataFrame([("s", ["2024-01-02,1,2"])], "stock_code string, klines array<string>")).first()
    assert (k.trade_date, k.close, k.volume) == ("2024-01-02", "2", None)


def test_stream(spark, tmp_path):
    from sparquill.sources import keyed
    from sparquill.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": "a", "n": 1}\n{"id": "a", "n": 2}\n{"id": "b", "n": 1}\n')
    schema = spark.createDataFrame([], "id string, n int").schema
    ingest.upsert_stream(ingest.report_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "t"), str(tmp_path / "c"), "id", "n").awaitTermination()
    assert {r.id: r.n for r in keyed.read_keyed(spark, str(tmp_path / "t")).collect()} == {"a": 2, "b": 1}


def test_bootstrap_is_that_of_plain_python(spark):
    import random

    values = [0.1, -0.2, 0.05, 0.3, 0.0, -0.1, 0.2]
    df = spark.createDataFrame([("s", f"d{i}", v) for i, v in enumerate(values)], "signal string, trade_date string, ic double")
    r = portfolio.bootstrap_ci(df, "signal", "trade_date", "ic", resamples=200).first()
    rng = random.Random(42)
    means = sorted(sum(values[rng.randrange(7)] for _ in range(7)) / 7 for _ in range(200))
    assert (r.ci_lower, r.ci_upper) == (round(means[5], 6), round(means[195], 6))


def test_predictions(spark):
    from sparquill.operators import lifecycle

    row = spark.createDataFrame([(" HIGH", None, "x", "nan", [("t", None), ("", "l")])], "strategic_optimism string, fundamental_sentiment string, phenomenon string, uncertainty string, evidence_spans array<struct<text string, label string>>")
    r = lifecycle.known_prediction(row).first()
    assert (r.strategic_optimism, r.fundamental_sentiment, r.phenomenon, r.uncertainty) == ("high", "neutral", "none", 0.5) and [tuple(x) for x in r.evidence_spans] == [("t", "unknown")]


def test_last_gold_counts(spark):
    gold = spark.createDataFrame([("r", "a", 1), ("r", "b", 2)], "report_id string, label string, at int")
    pred = spark.createDataFrame([("r", "b")], "report_id string, label string")
    assert [tuple(x) for x in evaluation.matched(pred, gold, "label", order="at").collect()] == [("r", "b", "b")]


def test_locked_writes_and_entities(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x int")
    path = f"file://{tmp_path}/once"
    writers.write_locked(df, path)
    with pytest.raises(FileExistsError):
        writers.write_locked(df, path)
    writers.write_locked(df, path, force=True)
    with pytest.raises(ValueError, match="2 x span"):
        writers.freeze(df, spark.createDataFrame([("span",), ("span",)], "problem string"), f"{path}2")
    (tmp_path / "f.txt").write_text("abc")
    assert writers.digests(spark, f"file://{tmp_path}/f.txt").first().sha256.startswith("ba7816bf")
    assert one(spark, x=X.all_entities(F.lit("&eacute;&#x41;&hellip;"))).x == "\u00e9A\u2026"
