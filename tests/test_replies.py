"""JSON in replies against a plain parser, and master rows, flags and weights against plain loops."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time

import pytest

from pyspark.sql import functions as F

from sparquill.operators import align, lifecycle, replies


def plain(reply):
    """The first of the tries that is JSON."""

    def parsed(x):
        try:
            json.loads(x, parse_constant=lambda c: 1 / 0, object_pairs_hook=once)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    text = reply.strip()
    block = re.search(r"```(?:json)?(.*?)```", text, re.S)
    tries = ([block[1].strip()] if block else []) + [text]
    tries += [re.sub(r"(?m)(^\s*|[,{]\s*)([A-Za-z_][A-Za-z0-9_ ]*?):", lambda m: f'{m[1]}"{m[2].strip()}":', x) for x in tries]
    for x in tries:
        if parsed(x):
            return x
    begin = text.find("{")
    depth, inside, skip = 0, False, False
    for i, c in enumerate(text[begin:] if begin >= 0 else ""):
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                found = text[begin : begin + i + 1]
                return found if parsed(found) else None
    return None


def made(rng):
    words = ["growth, risk: high", "{b: 1}", 'say "no"', "back\\slash", "}", "plain", "数据", "a\nb", "x: y, z: w", "[1]", "'"]

    def value(depth):
        kind = rng.randrange(7 if depth < 3 else 4)
        if kind < 2:
            return rng.choice(words)
        if kind < 4:
            return rng.choice([1, -2.5, True, None, 1e20])
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["k", "two words", "a_b", "K1", "x:y"]): value(depth + 1) for _ in range(rng.randrange(4))}

    body = json.dumps(value(0), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    if rng.random() < 0.3:
        body = re.sub(r'"([A-Za-z_][A-Za-z0-9_ ]*)"(\s*):', r"\1\2:", body)
    if rng.random() < 0.15 and body:
        at = rng.randrange(len(body))
        body = body[:at] + rng.choice(["", "}", '"', "\\", ",", "{"]) + body[at + 1 :]
    around = rng.randrange(6)
    if around == 0:
        return f"Here:\n```json\n{body}\n```\nDone."
    if around == 1:
        return f"```\n{rng.choice(['nothing', body])}\n``` and {body}"
    if around == 2:
        return f"so it is {body} and not {{that}}"
    if around == 3:
        return f'\\ "quoted {{" {body}'
    return rng.choice(["", " ", "\n"]) + body + rng.choice(["", "\n\n", " "])


def test_replies_against_a_plain_parser(spark):
    rng = random.Random(11)
    cases = [made(rng) for _ in range(1000)]
    cases += ['{"a": "growth, risk: high", "k": 1}', '{"a": "{b: 1}", "k": 5}', '```\nno\n```\n{"a": 1}', "{a: {b: 2}, c: 3} and }", "", "   ", "{", "}{", '"', "[1, 2", "-0", "01", "1.5e3", "true", '"text"', '"a" b', "[] x"]
    cases += ['{"neutralized_text": "标题", summary: "正文"}', '```json\n{"ok": true}\n```', '{"a": 1, "a": 2}', "{{}", '{"a": "\\', "nul", "{'a': 1}", "{ spaced key : 1 ,\n next: 2}"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, reply string")
    got = {r["i"]: r["json"] for r in replies.with_json(rows, "reply").collect()}
    for i, reply in enumerate(cases):
        assert got[i] == plain(reply), reply
        try:
            once = json.loads(reply)
        except ValueError:
            continue
        if got[i] is not None and "```" not in reply:
            assert json.loads(got[i]) == once, reply
    assert sum(x is not None for x in got.values()) > 500


def test_replies_null_and_problems(spark):
    rows = spark.createDataFrame([(0, None), (1, " "), (2, "no"), (3, "{}")], "i int, reply string")
    assert [(r["json"], r["json_problem"]) for r in replies.with_json(rows, "reply").orderBy("i").collect()] == [(None, "empty"), (None, "empty"), (None, "no_json"), ("{}", None)]


def test_long_replies_take_linear_time(spark):
    took = []
    for n in (20_000, 80_000):
        reply = "x " + '{"a": "' + '} \\" {' * n + '", "k": 7} and {'
        rows = spark.createDataFrame([(reply,)], "reply string")
        replies.with_json(rows, "reply").collect()
        start = time.time()
        assert json.loads(replies.with_json(rows, "reply").first()["json"])["k"] == 7
        took.append(time.time() - start)
    assert took[1] < 12 * max(took[0], 0.5)


# ---------------------------------------------------------------- master rows


def plain_master(rows):
    def normal(x):
        lines = [re.sub(r"\s+", " ", y).strip() for y in (x or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        return "\n".join(y for y in lines if y)

    out, seen = {}, set()
    for r in rows:
        n, (report_id, time_, stock, title, summary, body, deleted) = r[0], (x or "" for x in r[1:])
        day, code = time_.strip()[:10].replace("/", "-"), re.sub(r"\D", "", stock)
        code = code.zfill(6) if code else ""
        title, summary = normal(title), normal(summary) or normal(body)
        key = report_id.strip() or hashlib.sha1("||".join((day, code, title, summary)).encode()).hexdigest()[:16]
        if deleted.strip() == "1":
            out[n] = "deleted", None
        elif not day:
            out[n] = "missing_date", None
        elif not code or not (title or summary):
            out[n] = "missing_key", None
        elif key in seen:
            out[n] = "duplicate", None
        else:
            seen.add(key)
            year = int(day[:4])
            out[n] = "packaged", "train" if year <= 2024 else "dev" if year == 2025 else "test"
    return out


MASTER = "line int, report_id string, publish_time string, stock_id string, title string, summary string, body_raw string, is_deleted string, stock_name string"


def test_master_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [
        (
            i, rng.choice([None, "", " ", "r1", "r2 ", "r3", f"x{i}"]), rng.choice([None, "", "2024/12/31 10:00", "2025-03-01", "2026-01-05T00", " 2019/02/03"]), rng.choice([None, "", "SZ", "1", "600000.SH", "1234567"]),
            rng.choice([None, " ", "T", "a  b"]), rng.choice([None, "", "\t\r\n", "s\n\n t"]), rng.choice([None, "", "body"]), rng.choice([None, "0", "1", " 1 ", "true"]),
        )
        for i in range(400)
    ]
    df = spark.createDataFrame([(*r, "n") for r in rows], MASTER).repartition(3)
    got = {r["line"]: (r["status"], r["split"]) for r in lifecycle.experiment_master(df, "line").collect()}
    assert got == plain_master(rows)
    counts = lifecycle.master_counts(lifecycle.experiment_master(df, "line")).first()
    assert counts["rows"] == 400 and counts["packaged"] == sum(s == "packaged" for s, _ in got.values()) == counts["train"] + counts["dev"] + counts["test"]


def test_master_ties_and_errors(spark):
    row = (1, "r", "2024-01-01", "1", "T", "S", "", "0", "n")
    same = spark.createDataFrame([row, row, (1, "r", "2024-01-01", "1", "T", "other", "", "0", "n")], MASTER)
    assert sorted(r["status"] for r in lifecycle.experiment_master(same, "line").collect()) == ["duplicate", "duplicate", "packaged"]
    for day, problem in (("2027-01-01", "no split"), ("soon", "no date"), ("2024-13-01", "no date")):
        with pytest.raises(Exception, match=problem):
            lifecycle.experiment_master(spark.createDataFrame([(*row[:2], day, *row[3:])], MASTER), "line").collect()
    # an error only where the row would be packaged
    assert lifecycle.experiment_master(spark.createDataFrame([(*row[:2], "soon", *row[3:7], "1", "n")], MASTER), "line").first()["status"] == "deleted"


def test_flags_of_the_universe(spark):
    flags = [("1", "", "", ""), ("", "TRUE", "", ""), ("", "", "yes", ""), ("", "", "", "limit_up"), ("", "", "", "Down"), ("", "", "", "1"), ("no", None, "0", None)]
    df = spark.createDataFrame([(i, 120, *f) for i, f in enumerate(flags)] + [(7, 119, "", "", "", ""), (8, None, "", "", "", "")], "i int, entry_index int, is_st string, is_pt string, is_suspended string, limit_state string")
    kept = lambda **x: sorted(r["i"] for r in df.where(align.tradable(df.columns, **x)).collect())
    assert kept() == [5, 6] and kept(limits=False) == [3, 4, 5, 6] and kept(st=False, pt=False, suspended=False) == [0, 1, 2, 5, 6]
    assert sorted(r["i"] for r in df.where(align.tradable()).collect()) == list(range(7))


def test_ids_digest(spark):
    ids = spark.range(50).withColumn("g", F.lit(1))
    one = lambda df: df.groupBy("g").agg(*lifecycle.ids_digest(F.col("id"))).first()
    assert one(ids) == one(ids.orderBy(F.desc("id")).repartition(3)) != one(ids.where("id <> 7"))
