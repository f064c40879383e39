"""Named queries of landed answers, resumable ingest and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.plans import adapters as A
from sparquill.plans.catalog import query
from sparquill.plans.stage import stage_path
from sparquill.sources import keyed, responses
from sparquill.streaming import requests

# ---------------------------------------------------------------- landed answers

SERVICES = ("first", "second")
_CASE = "CAST(stock_code AS INT) % 7"


@query("fetch_outcomes", "WITH " + A.ctes("v_prices") + f""", s AS (SELECT stock_code, {_CASE} AS k, count(*) AS n, round(sum(close), 4) AS total FROM v_prices GROUP BY 1)
SELECT stock_code, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'fallback_ok' WHEN 3 THEN 'empty' WHEN 4 THEN 'fallback_failed' WHEN 5 THEN 'parse_failed' ELSE 'request_failed' END AS status,
  CASE WHEN k IN (2, 4) THEN 'second' ELSE 'first' END AS service_used, k IN (2, 4) AS fallback_used, CAST([1, 3, 4, 1, 6, 3, 0][k + 1] AS BIGINT) AS attempts,
  CASE k WHEN 2 THEN 'first: timeout' WHEN 4 THEN 'first: timeout | second: parse' WHEN 5 THEN 'first: parse' ELSE '' END AS message,
  CASE WHEN k < 3 THEN n ELSE 0 END AS row_count, CASE WHEN k < 3 THEN total ELSE 0.0 END AS total FROM s""")
def fetch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Prices as two services would answer for each stock: at once, after failures, by the second, with nothing, with
    broken lines, or never. What they answer is landed, read back as landed responses, and decided."""
    p = A.prices(spark, sf).withColumn("k", F.col("stock_code").cast("int") % 7)
    line = F.concat_ws(",", F.col("trade_date").cast("string"), *[F.col("close").cast("string") if c == "close" else F.lit("1") for c in ("open", "close", "high", "low", "volume", "amount", "amplitude", "pct_change", "change", "turnover")])
    quote = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    stocks = p.groupBy("stock_code", "k").agg(F.concat(F.lit('{"data":{"klines":['), F.array_join(quote, ","), F.lit("]}}")).alias("json"))
    jsonp, broken = F.concat(F.lit("callback_1("), F.col("json"), F.lit(");")), F.lit('{"data":{"klines":["2024-01-02,1,2"]}}')
    answer = lambda service, attempt, error, body: F.struct(F.lit(service).alias("service"), F.lit(attempt).alias("attempt"), F.lit(error).cast("string").alias("error"), body.alias("body"))
    nothing, none = F.lit(None).cast("string"), F.lit('{"data":{"klines":null}}')
    timeouts = [answer("first", i, "timeout", nothing) for i in (1, 2, 3)]
    tries = {
        0: [answer("first", 1, None, jsonp)], 1: [answer("first", 1, "timeout", nothing), answer("first", 2, None, F.lit("<html>")), answer("first", 3, None, F.col("json"))],
        2: [*timeouts, answer("second", 1, None, F.col("json"))], 3: [answer("first", 1, None, none), answer("second", 1, None, F.col("json"))],
        4: [*timeouts, *[answer("second", i, None, broken) for i in (1, 2, 3)]], 5: [answer("first", i, None, broken) for i in (1, 2, 3)] + [answer("third", 1, None, F.col("json"))],
    }
    case = F.expr("null")
    for k, made in tries.items():
        case = F.when(F.col("k") == k, F.array(*made)).otherwise(case)
    each = stocks.select(F.col("stock_code").alias("request"), F.explode(case).alias("a")).select("request", "a.*")
    path = stage_path(spark, "landed")
    responses.land(each, path)
    found = responses.outcomes(stocks.select(F.col("stock_code").alias("request")), responses.read_landed(spark, path), SERVICES)
    totals = responses.price_rows(found).groupBy("stock_code").agg(F.round(F.sum(F.col("close").cast("double")), 4).alias("total"))
    return responses.status_rows(found).withColumnRenamed("request", "stock_code").join(totals, "stock_code", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


# ---------------------------------------------------------------- ingest and keyed tables

_STATUS = {"error": "request_failed", "view": "empty", "click": "fallback_ok"}
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " ELSE 'ok' END"
_STATES_SQL = f"SELECT CAST(user_id AS VARCHAR) AS request, count(*) AS attempts, arg_max({_STATUS_SQL}, event_id) AS status, CAST(sum(user_id % 7) AS BIGINT) AS rows, max(event_id) AS at FROM events GROUP BY 1"


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    status = F.lit("ok")
    for k, v in _STATUS.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    return A.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("request"), F.col("event_id").alias("at"), status.alias("status"), (F.col("user_id") % 7).alias("n_rows"))


#: Files that a window lands as, and that a batch takes.
_FILES = 12


@query("ingest_states", _STATES_SQL)
def ingest_states(spark: SparkSession, sf: str) -> DataFrame:
    """Answers landed in four windows and ingested one by one: the state of every request."""
    path = stage_path(spark, "answers")
    answers = _answers(spark, sf)
    last = answers.agg(F.max("at")).first()[0] or 0
    for i in range(4):
        window = answers.where((F.col("at") * 4 >= i * (last + 1)) & (F.col("at") * 4 < (i + 1) * (last + 1)))
        # all answers of a request are in one file, so that they stay in order wherever a batch of files ends
        window.repartition(_FILES, "request").write.mode("append").json(f"{path}/in")
    requests.ingest_states(requests.landed(spark, f"{path}/in", requests.ANSWER, files_per_batch=_FILES), f"{path}/states", f"{path}/checkpoint", parts=8).awaitTermination()
    return keyed.read_keyed(spark, f"{path}/states").select("request", "attempts", "status", "rows", "at")


@query("request_states", _STATES_SQL)
def request_states(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the table as a whole, each answer given twice."""
    answers = _answers(spark, sf)
    return requests.states_of(answers.union(answers))


@query("run_counts", f"WITH s AS ({_STATES_SQL}), " + """q AS (SELECT DISTINCT CAST(user_id * 2 AS VARCHAR) AS request FROM events), j AS (SELECT q.request, status, rows, attempts FROM q LEFT JOIN s USING (request))
SELECT count(*) AS requested, count(status) AS processed, count(*) FILTER (WHERE status IN ('ok', 'fallback_ok')) AS covered, count(*) FILTER (WHERE status = 'empty') AS missing, count(*) FILTER (WHERE status = 'request_failed') AS failed,
  CAST(coalesce(sum(rows), 0) AS BIGINT) AS rows, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts FROM j""")
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    asked = A.table(spark, sf, "events").select((F.col("user_id") * 2).cast("string").alias("request"))
    return requests.run_counts(asked, requests.states_of(_answers(spark, sf)))


@query("open_requests", f"WITH s AS ({_STATES_SQL}) SELECT 'again' AS kind, request FROM s WHERE status = 'request_failed' AND attempts < 80 UNION ALL SELECT DISTINCT 'new', CAST(user_id * 2 AS VARCHAR) FROM events WHERE CAST(user_id * 2 AS VARCHAR) NOT IN (SELECT request FROM s)")
def open_requests(spark: SparkSession, sf: str) -> DataFrame:
    """What a run would ask for that takes up failed requests, and one that asks for twice the users' numbers."""
    states = requests.states_of(_answers(spark, sf))
    again = requests.open_requests(states.select("request"), states, retry_only=True, most_attempts=80)
    new = requests.open_requests(A.table(spark, sf, "events").select((F.col("user_id") * 2).cast("string").alias("request")).distinct(), states)
    return again.select(F.lit("again").alias("kind"), "request").union(new.select(F.lit("new"), "request"))


@query("keyed_upsert", "SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 3 = 0 OR user_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed table, and a batch of some users merged into it."""
    e = A.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    path, key = stage_path(spark, "keyed"), ["user_id", "event_type"]
    keyed.write_keyed(keyed.last_by(e.where("event_id % 3 = 0"), key, ["event_id"]), path, key, parts=16)
    keyed.upsert_keys(e.where("user_id % 5 = 0"), path, key, ["event_id"])
    return keyed.read_keyed(spark, path)


@query("keyed_replace", "SELECT user_id, event_id, value FROM events WHERE user_id % 11 <> 3 UNION ALL SELECT user_id, event_id, -value FROM events WHERE user_id % 11 = 3 AND event_id % 2 = 0")
def keyed_replace(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of some users replaced by others, in the parts that hold them."""
    e = A.table(spark, sf, "events").select("user_id", "event_id", "value")
    path = stage_path(spark, "keyed")
    keyed.write_keyed(e, path, ["user_id"], parts=16)
    keyed.replace_keys(e.where("user_id % 11 = 3 and event_id % 2 = 0").withColumn("value", -F.col("value")), path, ["user_id"])
    return keyed.read_keyed(spark, path)
