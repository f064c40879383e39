"""Models' replies: the JSON value in them, repaired where it can be, by native expressions in time linear in the reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A reply in parts: an escaped character, a structural one, or a run of others. Together they are the whole reply.
_PARTS = r'(?s)\\.|["{}\[\]]|[^\\"{}\[\]]++|\\'
_NUMBER_OR_WORD = r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$"
#: A key without quotes: after a comma, a brace or the begin of a line, and before a colon.
_BARE_KEY = r"(?md)(^\s*|[,{]\s*)([A-Za-z_](?:[A-Za-z0-9_ ]*[A-Za-z0-9_])?) *:"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def value_end(text: Column, opening: str, closing: str) -> Column:
    """Where the value that starts with the text's first character (opening) ends, in characters; 0 if it does not.

    One fold over the text's parts: depth, and whether a string is open, in which nothing but its end counts and an
    escaped character is never that end. Outside of strings a backslash means nothing. opening '"' takes a string.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(0).alias("end"))

    def step(s: Column, part: Column) -> Column:
        at, last = s["at"] + F.length(part), F.substring(part, -1, 1)
        quote = F.when(s["inside"], part == '"').otherwise(last == '"')
        inside = s["inside"] != quote
        if opening == '"':
            depth = s["depth"]
            over = s["inside"] & quote
        else:
            depth = F.when(s["inside"], s["depth"]).when(last == opening, s["depth"] + 1).when(last == closing, s["depth"] - 1).otherwise(s["depth"])
            over = ~s["inside"] & (last == closing) & (depth == 0)
        end = F.when(s["end"] > 0, s["end"]).when(over, at).otherwise(0)
        return F.struct(at.alias("at"), depth.alias("depth"), inside.alias("inside"), end.alias("end"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0)), start, step, lambda s: s["end"])


def is_json(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else. (What Spark parses may be followed by anything, so the value's end
    is looked for.)"""
    parsed = F.try_parse_json(text).isNotNull()
    ends = lambda o, c: value_end(text, o, c) == F.length(text)
    found = F.when(text.startswith("{"), parsed & ends("{", "}")).when(text.startswith("["), parsed & ends("[", "]")).when(text.startswith('"'), parsed & ends('"', '"'))
    return F.coalesce(found.otherwise(text.rlike(_NUMBER_OR_WORD)), F.lit(False))


def fenced(reply: Column) -> Column:
    """What the first fenced block holds, without white space around it; null where there is none."""
    return F.when(reply.rlike(r"(?s)```.*?```"), _stripped(F.regexp_extract(reply, r"(?s)```(?:json)?(.*?)```", 1)))


def quoted_keys(text: Column) -> Column:
    return F.regexp_replace(text, _BARE_KEY, '$1"$2":')


def json_of_reply(reply: Column) -> Column:
    """The JSON value in a reply, as text; null where there is none.

    The first that is JSON of: the first fenced block, the whole reply, both with quotes around bare keys, and what stands
    between the reply's first brace and the one that closes it. So what is JSON as it stands is never changed. White space
    around the reply does not count. A null reply has none; an object that repeats a key is none.
    """
    whole = _stripped(reply)
    block = fenced(whole)
    begin = F.instr(whole, "{")
    rest = F.when(begin > 0, F.substring(whole, begin, F.length(whole)))
    end = value_end(rest, "{", "}")
    braced = F.when(end > 0, F.substring(rest, F.lit(1), end))
    tries = [block, whole, quoted_keys(block), quoted_keys(whole), braced]
    return F.coalesce(*[F.when(is_json(x), x) for x in tries])


def with_json(rows: DataFrame, reply: str, out: str = "json") -> DataFrame:
    """rows with the reply's JSON (null where there is none) and `out`_problem: 'empty', 'no_json' or null."""
    found = json_of_reply(F.col(reply))
    blank = F.coalesce(_stripped(F.col(reply)), F.lit("")) == ""
    return rows.withColumn(out, found).withColumn(f"{out}_problem", F.when(blank, "empty").when(F.col(out).isNull(), "no_json"))
