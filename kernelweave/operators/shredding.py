"""Flat child tables from deeply nested JSON, with links to record, object and position.

Levels are array fields, each read with a schema merged from all rows. The nested fields of a level
are kept as JSON text and parsed at their own level, which makes a lone object a list of one and
a JSON value written as a string the value it encodes. Each level explodes into rows that carry
the parent's key and the ordinal within the parent, so a child's key is its record's key and the
path of ordinals; a recursive level (operands of operands) repeats as deep as the merged schema
says. Exploding never moves a row; only `number_leaves` shuffles, by record.

Defined results: null, blank or unreadable texts have no children; null items keep their position;
missing fields are null; empty lists end a branch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _decoded(text: Column) -> Column:
    """A JSON string literal that holds JSON becomes what it holds; other texts stay."""
    read = lambda x: F.when(x.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0))).otherwise(x)
    return _let(F.btrim(text, F.lit(" \t\r\n")), read)


def json_text(text: Column) -> Column:
    """The text of a JSON value, freed from every layer of being written as a string.

    Each layer doubles the backslashes of the one within, so a text has no more layers than its length has
    binary digits; that many steps are exact, and those beyond the last layer change nothing.
    """
    steps = F.ceil(F.log2((F.length(text) + 2).cast("double"))).cast("int")
    return F.when(F.ltrim(text).startswith('"'), F.aggregate(F.sequence(F.lit(1), steps), text, lambda t, _: _decoded(t))).otherwise(F.btrim(text, F.lit(" \t\r\n")))


def as_list(text: Column) -> Column:
    """Items of a JSON list as texts; a lone object counts as a list of one."""
    return _let(json_text(text), lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).when(x.startswith("{"), F.array(x)))


def _level_fields(walker, column: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], int] = {}
        for batch in batches:
            for text in batch[column]:
                if text is not None:
                    walker(text, seen)
        yield pd.DataFrame([(a, b, d) for (a, b), d in seen.items()], columns=["level", "field", "depth"])

    return scan


def _value(x):
    """What a value counts as: JSON written as a string is decoded, repeatedly."""
    while isinstance(x, str) and x.lstrip(" \t\r\n")[:1] in ("{", "[", '"'):
        try:
            x = json.loads(x)
        except (ValueError, RecursionError):
            break
    return x


def _items(x) -> list:
    x = _value(x)
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def merged_schema(df: DataFrame, column: str, levels: list[str], recursive: tuple[str, ...] = ()) -> dict[str, tuple[list[str], int]]:
    """Merged schema of all rows: level -> (field names, deepest nesting of that level).

    `levels` name the array fields from outside in; the first may also be the bare list itself.
    Fields under `recursive` names belong to the last level. One pass merges the schema within
    partitions; only distinct field names, which the schema bounds, reach the driver.
    """

    def walk(text: str, seen: dict) -> None:
        top = _value(text)
        stack = [(0, 1, x) for x in (_items(top[levels[0]]) if isinstance(top, dict) and levels[0] in top else _items(top))]
        while stack:
            k, depth, item = stack.pop()
            item = _value(item)
            if not isinstance(item, dict):
                continue
            for name, value in item.items():
                key = (levels[k], name)
                seen[key] = max(seen.get(key, 0), depth)
                if k + 1 < len(levels) and name == levels[k + 1]:
                    stack += [(k + 1, 1, x) for x in _items(value)]
                elif k == len(levels) - 1 and name in recursive:
                    stack += [(k, depth + 1, x) for x in _items(value)]

    found = df.select(F.col(f"`{column}`").alias(column)).mapInPandas(_level_fields(walk, column), "level string, field string, depth int")
    merged: dict[str, tuple[list[str], int]] = {}
    for level, fields, depth in found.groupBy("level").agg(F.sort_array(F.collect_set("field")), F.max("depth")).collect():
        merged[level] = (fields, depth)
    return merged


def _fields(text: Column, names: list[str]) -> Column:
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in names) or "`_` string"
    return F.from_json(json_text(text), ddl)


def whole_number(text: Column) -> Column:
    """A whole number, also written with a fraction of zeros or an exponent; anything else is null, nothing is rounded."""
    exact = text.try_cast("decimal(38,12)")
    return F.coalesce(text.try_cast("bigint"), F.when(exact == F.floor(exact), exact.try_cast("bigint")))


def shred_objects(df: DataFrame, key: str, column: str, levels: tuple[str, str, str] = ("objects", "phi", "score"), recursive: tuple[str, ...] = ("sum_operands", "prod_operands")) -> dict[str, DataFrame]:
    """Child tables of three levels: objects, their links, and the leaves of each link's score.

    Every table has `rec_id`, the ordinals of all levels above (`obj_pos`, `item_no`) and the
    level's own fields as text in the struct `f`; leaves carry `path`, the ordinals below the score.
    """
    top, mid, low = levels
    schema = merged_schema(df, column, list(levels), recursive)
    names = {k: [n for n in schema.get(k, ([], 0))[0]] for k in levels}
    depth = schema.get(low, ([], 0))[1]
    lone = lambda x: _let(F.json_object_keys(x), lambda keys: F.when(F.array_contains(keys, top), F.get_json_object(x, f"$.{top}")).when(keys.isNotNull(), x))
    unwrap = lambda x: F.when(x.startswith("{"), lone(x)).otherwise(x)
    source = df.select(F.col(f"`{key}`").alias("rec_id"), as_list(_let(json_text(F.col(f"`{column}`")), unwrap)).alias("__l"))
    need = lambda k, extra: sorted(set(names[k]) | set(extra))

    objects = source.select("rec_id", F.posexplode("__l").alias("obj_pos", "__t")).select("rec_id", "obj_pos", _fields(F.col("__t"), need(top, ["id", mid])).alias("f"))
    items = objects.select("rec_id", "obj_pos", whole_number(F.col("f.id")).alias("obj_id"), F.posexplode(as_list(F.col(f"f.{mid}"))).alias("item_no", "__t"))
    items = items.select("rec_id", "obj_pos", "obj_id", "item_no", _fields(F.col("__t"), need(mid, [low])).alias("f"))

    wanted = need(low, ["type", *recursive])
    leaves = items.select("rec_id", "obj_pos", "obj_id", "item_no", F.array().cast("array<int>").alias("path"), F.explode(as_list(F.col(f"f.{low}"))).alias("__t"))
    for _ in range(max(depth - 1, 0)):
        leaves = leaves.select("rec_id", "obj_pos", "obj_id", "item_no", "path", "__t", _fields(F.col("__t"), list(recursive)).alias("__o"))
        inner = F.concat(*[F.coalesce(as_list(F.col(f"__o.{r}")), F.array().cast("array<string>")) for r in recursive])
        holds = F.coalesce(F.greatest(*[F.col(f"__o.{r}").isNotNull() for r in recursive]), F.lit(False))
        leaves = leaves.select(
            "rec_id", "obj_pos", "obj_id", "item_no", "path", holds.alias("__h"), F.posexplode(F.when(holds, inner).otherwise(F.array("__t"))).alias("__p", "__t")
        )
        leaves = leaves.select("rec_id", "obj_pos", "obj_id", "item_no", F.when(F.col("__h"), F.array_append("path", F.col("__p"))).otherwise(F.col("path")).alias("path"), "__t")
    leaves = leaves.select("rec_id", "obj_pos", "obj_id", "item_no", "path", _fields(F.col("__t"), wanted).alias("f"))
    return {top: objects, mid: items, low: leaves}


def number_leaves(leaves: DataFrame, kind: str) -> DataFrame:
    """Leaves of one type, numbered from 0 in reading order within their link."""
    order = Window.partitionBy("rec_id", "obj_pos", "item_no").orderBy("path")
    return leaves.where(F.col("f.type") == kind).select("rec_id", "obj_pos", "obj_id", "item_no", (F.row_number().over(order) - 1).alias("leaf_no"), "f")


def shred_list(df: DataFrame, key: str, column: str, field: str) -> DataFrame:
    """Items of one list field of a JSON object: `rec_id, item_no, f` (fields as text)."""
    schema = merged_schema(df.select(key, F.get_json_object(json_text(F.col(f"`{column}`")), f"$.{field}").alias("__c")), "__c", [field])
    names = schema.get(field, ([], 0))[0]
    listed = df.select(F.col(f"`{key}`").alias("rec_id"), F.posexplode(as_list(F.get_json_object(json_text(F.col(f"`{column}`")), f"$.{field}"))).alias("item_no", "__t"))
    return listed.select("rec_id", "item_no", _fields(F.col("__t"), sorted({*names, "contributor"})).alias("f"))
