"""Text, id and date functions of report cleaning, as column expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

NUMBER = r"\d+(?:\.\d+)?%?"


def normalize(text: Column) -> Column:
    """Line ends to LF, runs of (Unicode) white space in a line to one space, lines trimmed, blank lines dropped."""
    lf = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(lf, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def strip(text: Column) -> Column:
    """Without white space of any kind, line ends included, at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def first_text(*fields: Column, most: int = 600) -> Column:
    """The first field that holds anything once it is normalised, cut to so many characters; empty where none does."""
    made = [normalize(f) for f in fields]
    return F.coalesce(*[F.when(x != "", F.substring(x, 1, most)) for x in made], F.lit(""))


def first_number(*fields: Column) -> Column:
    """The first field, as text, that is neither blank nor a number equal to 0; empty where none is."""
    text = [F.trim(F.coalesce(f.cast("string"), F.lit(""))) for f in fields]
    return F.coalesce(*[F.when((x != "") & F.coalesce(x.try_cast("double") != 0, F.lit(True)), x) for x in text], F.lit(""))


def strip_tags(text: Column, every_entity: bool = False) -> Column:
    """Entities decoded, tags dropped, then normalised. The commonest entities without Python; every_entity: all of HTML's."""
    out = F.coalesce(text, F.lit(""))
    if every_entity:
        return normalize(F.regexp_replace(all_entities(out), "<[^>]+>", ""))
    # fixed values: entities
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return normalize(F.regexp_replace(out, "<[^>]+>", ""))


def all_entities(text: Column) -> Column:
    """Every named and numeric character reference of HTML decoded, in Arrow batches."""

    @F.pandas_udf("string")
    def decode(x: pd.Series) -> pd.Series:
        return x.map(html.unescape, na_action="ignore")

    return decode(text)


def inline(text: Column, every_entity: bool = False) -> Column:
    """strip_tags on one line."""
    return F.trim(F.regexp_replace(strip_tags(text, every_entity), r"\n+", " "))


def stock_code(raw: Column) -> Column:
    """Digits only, padded on the left to six, never cut; empty where there are none."""
    digits = F.regexp_replace(F.coalesce(raw.cast("string"), F.lit("")), r"\D", "")
    return F.when(F.length(digits).between(1, 5), F.lpad(digits, 6, "0")).otherwise(digits)


def report_id(*parts: Column, length: int = 16) -> Column:
    """The first characters of SHA-1 over the parts joined by two bars; null counts as empty."""
    return F.substring(F.sha1(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, length)


def trade_date(raw: Column) -> Column:
    """The first ten characters with slashes as dashes; null-like values give the empty string."""
    return F.replace(F.substring(blank_if_nullish(raw), 1, 10), F.lit("/"), F.lit("-"))


def blank_if_nullish(raw: Column) -> Column:
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    return F.when(F.lower(text).isin("nan", "none"), "").otherwise(text)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def split_of(day: Column) -> Column:
    """train up to 2024, dev for 2025, test for 2026; any other year is an error."""
    year = F.year(day)
    return F.when(year <= 2024, "train").when(year == 2025, "dev").when(year == 2026, "test").otherwise(F.raise_error(F.lit("no split for this year")).cast("string"))


def combined(title: Column, summary: Column) -> Column:
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(summary, F.lit("")))


def secid(code: Column) -> Column:
    """Market prefix by the first digit: 6 and 9 list on market 1, all others on market 0."""
    return F.when(code.rlike("^[69]"), F.concat(F.lit("1."), code)).otherwise(F.concat(F.lit("0."), code))


def price_range(low: Column, high: Column) -> Column:
    low, high = F.nullif(F.coalesce(low, F.lit("")), F.lit("")), F.nullif(F.coalesce(high, F.lit("")), F.lit(""))
    return F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("-", low, high)).otherwise(F.coalesce(low, high, F.lit("")))


def split_risk(body: Column, markers: Sequence[str]) -> tuple[Column, Column]:
    """(body before, risk section) at the first marker in order of priority, not of place, that occurs."""
    head, tail = strip(body), F.lit("")
    for m in reversed(markers):
        at = F.instr(body, m)
        rest = F.expr("1") * 0 + at + len(m)
        head = F.when(at > 0, strip(F.substring(body, F.lit(1), at - 1))).otherwise(head)
        tail = F.when(at > 0, F.concat(F.lit(m), strip(F.substring(body, rest, F.length(body))))).otherwise(tail)
    return head, tail


def extractive_summary(body: Column, headings: Sequence[str] = (), lines: int = 3, enough: int = 180, most: int = 600) -> Column:
    """Up to `lines` lines that are no heading, bullets stripped, stopping once `enough` characters are there. A short line
    (8 characters) that begins with a heading is one."""
    clean = F.filter(
        F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.regexp_replace(F.trim(x), "^[l•●·\\- ]+", "")),
        lambda x: (x != "") & ~(x.rlike("^(?:" + "|".join(map(re.escape, headings)) + ")") & (F.length(x) <= 8) | x.isin(*headings)) if headings else (x != ""),
    )
    taken = F.aggregate(
        clean, F.array().cast("array<string>"),
        lambda acc, x: F.when((F.size(acc) < lines) & (F.length(F.array_join(acc, "\n")) < enough), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return F.substring(F.array_join(taken, "\n"), 1, most)


def paragraphs(block: Column) -> Column:
    """Texts of the p elements joined by line ends; the whole block where it has none."""
    inner = F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: strip_tags(p)), lambda x: x != "")
    return F.when(F.size(inner) > 0, F.array_join(inner, "\n")).otherwise(strip_tags(block))


def numbers(text: Column) -> Column:
    """The distinct numeric tokens."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)))


def numbers_within(candidate: Column, source: Column) -> Column:
    return F.size(F.array_except(numbers(candidate), numbers(source))) == 0


def sanitize(items: Column, source: Column, most: int = 8) -> Column:
    """Distinct normalised items that occur in the source, at most so many."""
    clean = F.array_distinct(F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))))
    return F.slice(F.filter(clean, lambda x: (x != "") & F.contains(source, x)), 1, most)


def char_tokens(spans: Column) -> Column:
    """Distinct characters other than white space of all spans, in the order in which they come first."""
    return _characters(F.concat_ws("", spans))


# fixed values: what Unicode calls white space
_SPACE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}


@F.pandas_udf(ArrayType(StringType()))
def _characters(text: pd.Series) -> pd.Series:
    # a set of a text's characters; Spark alone makes an array of all of them first
    return text.map(lambda x: sorted(set(x) - _SPACE, key=x.index))


def safe_double(raw: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.expr("try_cast(NULL as double)") if raw is None else raw.try_cast("double"), F.lit(default).cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def history_coverage(context: Column, nothing: str = "") -> Column:
    lines = F.size(F.filter(F.split(F.coalesce(context, F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return F.when(F.coalesce(context, F.lit("")).isin("", nothing), 0.0).otherwise(F.least(F.lit(1.0), lines / 5.0))


def authors(ids: Column) -> Column:
    """'id.name' items, comma-joined -> array of (id, name); an item without a dot is a name."""
    return F.transform(
        F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != ""),
        lambda x: F.struct(
            F.when(F.instr(x, ".") > 0, F.substring_index(x, ".", 1)).otherwise("").alias("id"),
            F.when(F.instr(x, ".") > 0, F.regexp_replace(x, r"^[^.]*\.", "")).otherwise(x).alias("name"),
        ),
    )
