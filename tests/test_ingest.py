"""Landed responses, resumable ingest and keyed tables."""

from __future__ import annotations

import json
import os
import random
import re

import pytest

from pyspark.sql import functions as F

from sparquill.sources import keyed, responses
from sparquill.streaming import ingest, requests

# ---------------------------------------------------------------- landed responses

FIELDS = ",1,2,3,4,5,6,7,8,9,10"


def body(*days, wrap=False):
    text = json.dumps({"data": {"klines": [f"{d}{FIELDS}" for d in days]}})
    return f"jQuery_12.cb({text});" if wrap else text


def test_landed_files_come_back(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b"]), f"r{i}", i % 3 + 1, rng.choice([None, "timeout", "x\ny"]), rng.choice([None, "{}", "line\nend\n", "数据" * 1000, '{"request": 1}\n'])) for i in range(200)]
    df = spark.createDataFrame(rows, responses.SCHEMA).repartition(3)
    path = f"file://{tmp_path}/landed"
    responses.land(df, path)
    responses.land(df.where("request = 'r7'"), path)
    got = [tuple(r) for r in responses.read_landed(spark, path).collect()]
    assert sorted(got, key=str) == sorted([*rows, rows[7]], key=str)
    assert {r["service"] for r in responses.read_landed(spark, path, ["b"]).collect()} == {"b"}
    small = spark.read.format("landed_responses").option("path", path).option("partitionBytes", "10").load()
    assert small.rdd.getNumPartitions() > 2 and small.count() == 201
    (tmp_path / "landed" / "a" / "half.part").write_text("not done")
    (tmp_path / "landed" / "a" / "cut.landed").write_text('{"request": "q", "attempt": 1, "error": null, "bytes": 9}\nabc')
    with pytest.raises(Exception, match="ends within a record"):
        responses.read_landed(spark, path).collect()
    assert responses.read_landed(spark, f"file://{tmp_path}/none").collect() == []


def test_every_status(spark):
    one, two = body("2024-01-02"), body("2024-01-02", "2024-01-03", wrap=True)
    cases = {
        "ok": ([("s1", 1, None, one)], ("ok", "s1", False, 1, "", 1)), "callback": ([("s1", 1, None, two)], ("ok", "s1", False, 1, "", 2)),
        "third": ([("s1", 1, "timeout", None), ("s1", 2, None, "<html>"), ("s1", 3, None, one)], ("ok", "s1", False, 3, "", 1)),
        "empty": ([("s1", 1, None, body()), ("s2", 1, None, one)], ("empty", "s1", False, 1, "", 0)), "nodata": ([("s1", 1, None, '{"data": null}')], ("empty", "s1", False, 1, "", 0)),
        "fallback": ([("s1", i, "timeout", None) for i in (1, 2, 3)] + [("s2", 2, None, two), ("s2", 1, "reset", None)], ("fallback_ok", "s2", True, 5, "s1: timeout", 2)),
        "later_empty": ([("s1", 3, "timeout", None), ("s2", 1, None, body())], ("empty", "s2", True, 4, "s1: timeout", 0)),
        "all_failed": ([("s1", 3, "timeout", None), ("s2", 3, None, "["), ("s3", 3, "refused", None)], ("fallback_failed", "s3", True, 9, "s1: timeout | s2: parse | s3: refused", 0)),
        "parse": ([("s1", 1, "timeout", None), ("s1", 3, None, '{"data": {"klines": ["2024-01-02,1"]}}')], ("parse_failed", "s1", False, 3, "s1: parse", 0)),
        "request": ([("s1", 1, None, "{"), ("s1", 3, "timeout", None)], ("request_failed", "s1", False, 3, "s1: timeout", 0)),
        "too_late": ([("s1", 3, "timeout", None), ("s1", 4, None, one)], ("request_failed", "s1", False, 3, "s1: timeout", 0)), "other_service": ([("s9", 1, None, one)], ("request_failed", "s1", False, 0, "", 0)),
        "never": ([], ("request_failed", "s1", False, 0, "", 0)), "last_service": ([("s3", 1, None, one)], ("fallback_ok", "s3", True, 1, "", 1)),
    }
    rows = [(s, r, a, e, b) for r, (tries, _) in cases.items() for s, a, e, b in tries]
    asked = spark.createDataFrame([(r,) for r in cases] + [("ok",), (None,)], "request string")
    found = responses.outcomes(asked, spark.createDataFrame(rows, responses.SCHEMA), ["s1", "s2", "s3"])
    got = {r["request"]: (r["status"], r["service_used"], r["fallback_used"], r["attempts"], r["message"], r["row_count"]) for r in responses.status_rows(found).collect()}
    assert got == {r: want for r, (_, want) in cases.items()}
    prices = responses.price_rows(found).where("stock_code = 'fallback'").orderBy("trade_date").collect()
    assert [(p["trade_date"], p["open"], p["turnover"]) for p in prices] == [("2024-01-02", "1", "10"), ("2024-01-03", "1", "10")]
    assert responses.outcomes(asked.limit(0), spark.createDataFrame([], responses.SCHEMA), ["s1"]).collect() == []


# ---------------------------------------------------------------- keyed tables


def parts(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("part_of_")}


def test_untouched_parts_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("v"), F.lit("x").alias("w"))
    assert not keyed.exists(spark, path)
    keyed.write_keyed(rows, path, ["k"], parts=16)
    with pytest.raises(FileExistsError):
        keyed.write_keyed(rows, path, ["k"])
    before = parts(path)
    new = spark.createDataFrame([("y", 7, 1), ("z", 7, 2), ("n", 500, 3)], "w string, k long, v long")
    touched = keyed.replace_keys(new, path, ["k"])
    after = parts(path)
    assert 1 <= len(touched) <= 2
    for d in set(before) | set(after):
        assert (before.get(d) == after.get(d)) == (int(d.split("=")[1]) not in touched), d
    got = sorted((r["k"], r["v"], r["w"]) for r in keyed.read_keyed(spark, path).collect())
    assert got == sorted([(i % 100, i, "x") for i in range(1000) if i % 100 != 7] + [(7, 1, "y"), (7, 2, "z"), (500, 3, "n")])
    assert keyed.replace_keys(new.limit(0), path, ["k"]) == [] and parts(path) == after
    found = keyed.lookup(spark, path, spark.createDataFrame([(7,), (9,)], "k long"), ["k"])
    assert found.count() == 12 and re.search(r"PartitionFilters: \[[^\]]*part_of_16", found._jdf.queryExecution().toString())


def test_upserts_keep_the_last(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.write_keyed(spark.createDataFrame([("a", 1, "old"), ("b", 5, "old"), (None, 1, "old")], "k string, n int, w string"), path, ["k"], parts=4)
    batch = spark.createDataFrame([("a", 2, "new"), ("a", 3, "newest"), ("b", 4, "late"), (None, 2, "new"), ("c", 1, "first")], "k string, n int, w string")
    for _ in range(2):  # a batch that comes again changes nothing
        keyed.upsert_keys(batch, path, ["k"], ["n"])
        assert {r["k"]: r["w"] for r in keyed.read_keyed(spark, path).collect()} == {"a": "newest", "b": "old", None: "new", "c": "first"}


# ---------------------------------------------------------------- resumable ingest


class Stop(Exception):
    pass


def land_windows(folder, n):
    rng = random.Random(3)
    folder.mkdir()
    for w in range(n):
        rows = [{"request": f"s{rng.randrange(9)}", "at": w * 100 + i, "status": rng.choice(["ok", "empty", "request_failed"]), "n_rows": rng.choice([0, 3, None])} for i in range(30)]
        rows.append(rows[0])  # the same answer again
        (folder / f"w{w}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"w{w}.json", (1_700_000_000 + w, 1_700_000_000 + w))


def all_rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("stop_before", [True, False])
def test_a_stopped_ingest_ends_as_an_uninterrupted_one(spark, tmp_path, monkeypatch, stop_before):
    land_windows(tmp_path / "in", 5)
    answers = lambda: requests.landed(spark, str(tmp_path / "in"), requests.ANSWER)
    schema = spark.createDataFrame([], requests.ANSWER).schema
    requests.ingest_states(answers(), str(tmp_path / "whole"), str(tmp_path / "c0"), parts=4).awaitTermination()
    whole = all_rows(keyed.read_keyed(spark, str(tmp_path / "whole")).select("request", "attempts", "status", "rows", "at"))
    plain = spark.read.schema(schema).json(str(tmp_path / "in"))
    assert whole == all_rows(requests.states_of(plain).select("request", "attempts", "status", "rows", "at"))

    real = requests._upsert_into

    def failing(*args):
        merge = real(*args)

        def once(batch, batch_id):
            if batch_id == 2 and stop_before:
                raise Stop("stopped before a window is written")
            merge(batch, batch_id)
            if batch_id == 2:
                raise Stop("stopped after it is written, before it is noted")

        return once

    monkeypatch.setattr(requests, "_upsert_into", failing)
    with pytest.raises(Exception, match="stopped"):
        requests.ingest_states(answers(), str(tmp_path / "part"), str(tmp_path / "c1"), parts=4).awaitTermination()
    some = keyed.read_keyed(spark, str(tmp_path / "part")).agg(F.sum("attempts")).first()[0]
    assert some == (60 if stop_before else 90)
    monkeypatch.setattr(requests, "_upsert_into", real)
    requests.ingest_states(answers(), str(tmp_path / "part"), str(tmp_path / "c1"), parts=4).awaitTermination()
    assert all_rows(keyed.read_keyed(spark, str(tmp_path / "part")).select("request", "attempts", "status", "rows", "at")) == whole


def test_rows_of_windows(spark, tmp_path):
    land_windows(tmp_path / "in", 3)
    rows = requests.landed(spark, str(tmp_path / "in"), requests.ANSWER, files_per_batch=2)
    ingest.upsert_stream(rows, str(tmp_path / "t"), str(tmp_path / "c"), "request", "at", parts=4).awaitTermination()
    plain = spark.read.schema(requests.ANSWER).json(str(tmp_path / "in"))
    want = {r["request"]: r["at"] for r in plain.groupBy("request").agg(F.max("at").alias("at")).collect()}
    assert {r["request"]: r["at"] for r in keyed.read_keyed(spark, str(tmp_path / "t")).collect()} == want


def test_what_a_next_run_asks_for(spark):
    states = spark.createDataFrame([("a", 1, "ok", 5, 1), ("b", 3, "request_failed", 0, 1), ("c", 1, "parse_failed", 0, 1), ("d", 2, "empty", 0, 1), ("x", 1, "fallback_failed", 0, 1)], f"request string, {requests.STATE}")
    asked = spark.createDataFrame([(x,) for x in "abcde"], "request string")
    ids = lambda **k: sorted(r["request"] for r in requests.open_requests(asked, states, **k).collect())
    assert ids() == ["e"] and ids(retry_only=True) == ["b", "c"] and ids(retry_only=True, most_attempts=3) == ["c"]
    assert tuple(requests.run_counts(asked, states).first()) == (5, 4, 1, 1, 2, 5, 7)
