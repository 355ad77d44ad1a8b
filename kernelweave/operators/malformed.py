"""Separation of raw delimited lines into loaded rows and rejected rows with a reason.

Every field is first taken as nullable text. Rules are column expressions that each yield an
error code or null; the non-null codes form an `errors` array, and a line is loaded exactly when
that array is empty. Splitting, unquoting and the id rules stay in the JVM. JSON is checked by the
JVM's strict parser; only the few values which that parser refuses are looked at again in an
Arrow-batched Python function, since the parser also refuses valid texts with repeated keys, very
deep nesting or very long numbers. A line is judged once: the verdict passes through a generator, which
no filter is pushed through, so neither side of the split computes the rules again.

Defined results: a null line has no fields (`columns`); an empty line has one field (`columns`);
lines of any length are handled; repeated lines are judged one by one; extra input columns are
kept on both sides, whatever their names; rejected rows keep their line. A weight that is no number is no
reason to reject a line: it loads as null and the row's `warnings` say so.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSERTION_FIELDS = ("id", "uri", "relation_id", "start_id", "end_id", "weight", "data")
CONCEPT_PATTERN = r"^/c/[a-z]{2,3}/[^/\s\p{Z}]+(?:/[^\s\p{Z}]*)?\z"
ADDRESS_PATTERN = r"^https?://[^\s\p{Z}]+\z"


def _unquotable(text: Column) -> Column:
    """Whether a field that begins with a quote is closed by its last character and only there."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return (F.length(text) >= 2) & text.endswith('"') & ~F.contains(F.replace(inner, F.lit('""'), F.lit("")), F.lit('"'))


def _unquote(text: Column) -> Column:
    return F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))


def split_delimited(line: Column, width: int) -> Column:
    """Tab-separated fields of a line: struct(n, fields, bad).

    `fields` holds at most `width + 1` values (enough to tell a wrong count), `n` counts all of
    them, `bad` tells a quoting error. Lines without a quoted field take the plain split; the
    others are folded over the tab pieces, joining pieces while the number of quotes is odd.
    """
    line = F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    pieces = F.split(line, "\t", -1)
    plain = F.struct(F.size(pieces).alias("n"), F.slice(pieces, 1, width + 1).alias("fields"), F.lit(False).alias("bad"))

    start = F.struct(
        F.lit(0).alias("n"), F.array().cast("array<string>").alias("fields"), F.lit(False).alias("bad"), F.lit(None).cast("string").alias("open")
    )

    def step(s: Column, piece: Column) -> Column:
        text = F.when(s["open"].isNotNull(), F.concat(s["open"], F.lit("\t"), piece)).otherwise(piece)
        quoted = s["open"].isNotNull() | piece.startswith('"')
        odd = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1
        stays = quoted & odd
        value = F.when(quoted, _unquote(text)).otherwise(text)
        return F.struct(
            F.when(stays, s["n"]).otherwise(s["n"] + 1).alias("n"),
            F.when(stays | (F.size(s["fields"]) > width), s["fields"]).otherwise(F.concat(s["fields"], F.array(value))).alias("fields"),
            (s["bad"] | (quoted & ~odd & ~_unquotable(text))).alias("bad"),
            F.when(stays, text).alias("open"),
        )

    folded = F.aggregate(pieces, start, step, lambda s: F.struct(s["n"].alias("n"), s["fields"].alias("fields"), (s["bad"] | s["open"].isNotNull()).alias("bad")))
    return F.when(line.startswith('"') | F.contains(line, F.lit('\t"')), folded).otherwise(plain)


_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([][{},:]))')


def nested_object(text: str) -> bool:
    """Whether a text is one strict JSON object, by a stack of open brackets; for nesting beyond any parser's depth."""
    stack: list[str] = []
    want, at = "value", 0
    while found := _TOKEN.match(text, at):
        string, scalar, sign = found.groups()
        at = found.end()
        if want == "end" or (not stack and sign != "{"):
            return False
        if string and want in ("key", "first key"):
            want = "colon"
        elif (string or scalar) and want in ("value", "first item"):
            want = "next"
        elif sign in ("{", "[") and want in ("value", "first item"):
            stack.append(sign)
            want = "first key" if sign == "{" else "first item"
        elif sign == ":" and want == "colon":
            want = "value"
        elif sign == "," and want == "next":
            want = "key" if stack[-1] == "{" else "value"
        elif sign in ("}", "]") and stack and stack[-1] == ("{" if sign == "}" else "[") and want in ("next", "first key" if sign == "}" else "first item"):
            stack.pop()
            want = "next" if stack else "end"
        else:
            return False
    return want == "end" and not text[at:].strip(" \t\n\r")


@F.pandas_udf(T.BooleanType())
def _strict_object(texts: pd.Series) -> pd.Series:
    def refuse(_: str) -> None:
        raise ValueError

    def check(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            return isinstance(json.loads(text, parse_constant=refuse, parse_int=str, parse_float=str), dict)
        except RecursionError:
            return nested_object(text)
        except ValueError:
            return False

    return texts.map(check, na_action=None)


def is_json_object(text: Column) -> Column:
    """Whether a text is one JSON object by RFC 8259, with nothing but blanks around it.

    The text is parsed as first element of an array whose second element is the text's own
    digest, so anything that follows the object, a closing bracket too, loses the digest.
    """
    digest = F.md5(text)
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    strict = F.coalesce(
        (F.try_variant_get(whole, "$[1]", "string") == digest) & F.schema_of_variant(F.try_variant_get(whole, "$[0]", "variant")).startswith("OBJECT"),
        F.lit(False),
    )
    again = F.when(~strict & F.startswith(F.ltrim(text), F.lit("{")), text)
    return strict | F.coalesce(_strict_object(again), F.lit(False))


def judge_lines(df: DataFrame, line_col: str = "raw_line") -> DataFrame:
    """Add `fields` (array of text) and `errors` (array of codes, in order of precedence)."""
    width = len(ASSERTION_FIELDS)
    cols = df.columns
    kept = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), split_delimited(F.col(f"`{line_col}`"), width).alias("__cut"))
    shaped = ~F.col("__cut.bad") & (F.col("__cut.n") == width)
    at = {name: F.when(shaped, F.get(F.col("__cut.fields"), F.lit(k))) for k, name in enumerate(ASSERTION_FIELDS)}
    kept = kept.withColumn("__json", is_json_object(at["data"]))
    rules = [
        F.when(F.col("__cut.bad"), "quoting"),
        F.when(~F.coalesce(F.col("__cut.bad"), F.lit(False)) & ~F.coalesce(F.col("__cut.n") == width, F.lit(False)), "columns"),
        F.when(shaped & ~F.coalesce(F.col("__json"), F.lit(False)), "bad_data"),
        F.when(shaped & ~at["start_id"].rlike(CONCEPT_PATTERN), "bad_start"),
        F.when(shaped & ~(at["end_id"].rlike(CONCEPT_PATTERN) | at["end_id"].rlike(ADDRESS_PATTERN)), "bad_end"),
    ]
    judged = F.struct(F.col("__cut.fields").alias("fields"), F.array_compact(F.array(*rules)).alias("errors"))
    once = kept.select("__row", F.explode(F.array(judged)).alias("__judged"))
    return once.select(*[F.col("__row").getField(c).alias(c) for c in cols], F.col("__judged.fields").alias("__fields"), F.col("__judged.errors").alias("__errors"))


def load_assertions(df: DataFrame, id_col: str = "line_id", line_col: str = "raw_line") -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected): typed rows `line_id, <seven fields>, warnings`, and `line_id, reason, errors, raw_line`; further input columns follow on both sides."""
    judged = judge_lines(df, line_col)
    field = lambda n: F.get(F.col("__fields"), F.lit(ASSERTION_FIELDS.index(n)))
    number = field("weight").try_cast("double")
    made = [field(n).alias(n) for n in ASSERTION_FIELDS if n != "weight"] + [number.alias("weight")]
    warnings = F.array_compact(F.array(F.when(field("weight").isNotNull() & number.isNull(), "bad_weight"))).alias("warnings")
    taken = {"line_id", "warnings", "reason", "errors", "raw_line", *ASSERTION_FIELDS}
    rest = [F.col(f"`{c}`").alias(f"in_{c}" if c in taken else c) for c in df.columns if c not in (id_col, line_col)]
    key = F.col(f"`{id_col}`").alias("line_id")
    loaded = judged.where(F.size("__errors") == 0).select(key, *made, warnings, *rest)
    rejected = judged.where(F.size("__errors") > 0).select(key, F.get(F.col("__errors"), F.lit(0)).alias("reason"), F.col("__errors").alias("errors"), F.col(f"`{line_col}`").alias("raw_line"), *rest)
    return loaded, rejected
