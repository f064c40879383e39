"""The thin opN queries over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparquill.llm.triebpe import encode_decode

    return encode_decode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.mixing import mix

    return mix(_documents(spark, sf_dir)).drop("source", "times")


OP8_SQL = r"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS pos
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
ranked AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1 AS weight,
         3 * source_size AS most FROM sources),
levels AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lam, CAST(-1 AS BIGINT) AS n
  UNION ALL
  SELECT l.i + 1,
         CAST((SELECT sum(source_size) FROM ranked) - coalesce(x.stopped, 0) AS DOUBLE) / CAST(x.free AS DOUBLE), x.n
  FROM levels l, LATERAL (
    SELECT sum(CASE WHEN most < weight * l.lam THEN most END) AS stopped,
           count(CASE WHEN most < weight * l.lam THEN 1 END) AS n,
           sum(CASE WHEN most < weight * l.lam THEN 0 ELSE weight END) AS free FROM ranked) x
  WHERE x.n <> l.n AND x.free > 0 AND l.i < 200),
lam AS (SELECT lam FROM levels ORDER BY i DESC LIMIT 1),
plan_ AS (
  SELECT source, source_size, least(weight * lam, CAST(most AS DOUBLE)) AS target,
         CASE WHEN source_size > 0 THEN CAST(floor(least(weight * lam, CAST(most AS DOUBLE)) / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM ranked, lam),
cum AS (
  SELECT r.doc_id, r.source, r.size, r.pos, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(r.size) OVER (PARTITION BY r.source, r.pos) AS here
  FROM rows_ r JOIN plan_ p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, whole + CASE WHEN upto <= rest OR (upto - rest) < (rest - (upto - here)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM cum
"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.lines import drop_repeated_lines

    return drop_repeated_lines(_documents(spark, sf_dir), least_words=1).select("doc_id", "text", "lines_dropped")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.near import near_groups

    return near_groups(_documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.quality import score_quality

    return score_quality(_documents(spark, sf_dir))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm import langid

    docs = _documents(spark, sf_dir)
    mark = langid.held_out(F.col("doc_id"))
    trees = langid.fit(docs.where(~mark & F.col("doc_id").isNotNull()))
    found = langid.predict(docs.select("doc_id", mark.alias("held_out"), "text"), trees)
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits")


def op5_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparquill.llm.tokenpack import read_packed, write_packed

    return read_packed(write_packed(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.exact import exact_groups

    return exact_groups(_documents(spark, sf_dir), keep="max")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.htmltext import extract

    pages = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", "text", F.length("text").alias("n_chars"), F.size(F.split("text", "\n")).alias("n_lines"))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.tiff import read_tiff, text_to_tiff

    media = text_to_tiff(_documents(spark, sf_dir))
    media = media.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    pages = read_tiff(media).where("page = 0")  # page 1 is the preview
    feature = F.format_string("%s %dx%d predictor %d, mean %.3f, deviation %.3f", "compression", "width", "height", "predictor", "mean", "deviation")
    return pages.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -32, 32)")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
        "compression", "predictor", "tiled", "n_pages",
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.phrases import collocations

    return collocations(_documents(spark, sf_dir)).drop("words")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
counted AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL),
freq AS MATERIALIZED (SELECT * FROM counted WHERE a >= 100),
totals AS (SELECT lang, CAST(sum(a) AS HUGEINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM freq WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, t.n, c.cut, x.a AS l, y.a AS r, (1000 * c.a * t.n) // (x.a * y.a) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[p:p + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, k, a, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM freq WHERE k > 2) z, LATERAL (SELECT unnest(range(1, z.k - z.m + 2)) AS p) q
  GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.around IS NULL OR 100 * i.around < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.leaks import find_leaks, n_hit

    found = find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = n_hit(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, k, gram FROM (
    SELECT item, least(10, len(w)) AS k,
           unnest(list_transform(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT)), lambda p: array_to_string(w[p:p + least(10, len(w)) - 1], ' '))) AS gram
    FROM i WHERE len(w) > 0)),
dw AS (
  SELECT rid, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p,
         unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS gram
  FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hits AS (SELECT rid, p, dw.k, item FROM dw JOIN win USING (k, gram)),
marked AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hits) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN named USING (rid)
"""


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparquill.llm.search import search

    found = search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", F.col("doc_id").cast("long").alias("doc_id"), "score")


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (
  SELECT iid, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
weighed AS (
  SELECT iid, item_id, term, times, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM q JOIN df USING (term), total),
scored AS (
  SELECT iid, item_id, doc_id, rid, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM weighed JOIN tf USING (term) JOIN n USING (rid), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


def queries() -> dict[str, Query]:
    return {"op1_line_dedup": op1_line_dedup, "op2_near_dedup": op2_near_dedup, "op3_quality": op3_quality, "op4_language": op4_language, "op5_packed_tokens": op5_packed_tokens, "op6_exact_dedup": op6_exact_dedup, "op7_trie_bpe": op7_trie_bpe, "op8_mix": op8_mix, "op9_html_text": op9_html_text, "op10_tiff": op10_tiff, "op11_collocations": op11_collocations, "op12_decontaminate": op12_decontaminate, "op13_search": op13_search}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op8_mix": OP8_SQL, "op11_collocations": OP11_SQL, "op12_decontaminate": OP12_SQL, "op13_search": OP13_SQL}
