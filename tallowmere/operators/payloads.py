"""Payloads of unknown quality: parsed to variants, every fault kept as a row, good items and bad ones told apart in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field of an item: kinds that it may have (string, integer, number, boolean, null, list, object; an integer is a number too), allowed values, limits."""

    name: str
    kinds: tuple[str, ...]
    required: bool = True
    values: tuple[str, ...] | None = None
    least: float | None = None
    most: float | None = None


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), 0)


def _kind(v: Column) -> Column:
    return _let(
        F.schema_of_variant(v),
        lambda s: F.when(s == "BIGINT", "integer").when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null").when(s.rlike("^ARRAY"), "list").when(s.rlike("^OBJECT"), "object").otherwise("other"),
    )


def _fault(path: Column, code: Column | str) -> Column:
    return F.struct(path.alias("path"), (F.lit(code) if isinstance(code, str) else code).alias("code"))


def _faulty(path: Column) -> Callable[[Column], Column]:
    return lambda code: _fault(path, code)


def _item_faults(item: Column, at: Column, fields: Sequence[Field]) -> Column:
    """The faults of one item; what is no object has that fault alone."""
    # a map of variants cannot be compared, so the keys come from the item's JSON
    keys = F.coalesce(F.json_object_keys(F.to_json(item)), F.array().cast("array<string>"))
    return F.when(_kind(item) == "object", _let(keys, lambda k: _object_faults(item, k, at, fields))).otherwise(F.array(_fault(at, "NOT_AN_OBJECT")))


def _code(item: Column, f: Field) -> Callable[[Column], Column]:
    """What is wrong with a field that is there, by its kind."""
    kinds = f.kinds + (("integer",) if "number" in f.kinds else ())

    def code(kind: Column) -> Column:
        c = F.when(~kind.isin(*kinds), "WRONG_KIND")
        if f.values is not None:
            c = c.when((kind == "string") & ~F.try_variant_get(item, f"$.{f.name}", "string").isin(*f.values), "UNKNOWN_VALUE")
        number = F.try_variant_get(item, f"$.{f.name}", "double")
        outside = [number < f.least] * (f.least is not None) + [number > f.most] * (f.most is not None)
        for x in outside:
            c = c.when(kind.isin("integer", "number") & x, "OUT_OF_RANGE")
        return c

    return code


def _object_faults(item: Column, keys: Column, at: Column, fields: Sequence[Field]) -> Column:
    found = [F.transform(F.filter(keys, lambda k: ~k.isin([f.name for f in fields])), lambda k: _fault(F.concat(at, F.lit("."), k), "UNEXPECTED_FIELD"))]
    for f in fields:
        kind = F.coalesce(_kind(F.variant_get(item, f"$.{f.name}", "variant")), F.lit("null"))
        code = F.when(F.array_contains(keys, f.name), _let(kind, _code(item, f))).when(F.lit(f.required), "MISSING")
        found.append(F.transform(F.array_compact(F.array(code)), _faulty(F.concat(at, F.lit(f".{f.name}")))))
    return F.concat(*found)


def _place(items: str, i: Column) -> Column:
    return F.concat(F.lit(f"$.{items}["), i.cast("string"), F.lit("]"))


def _parsed(df: DataFrame, key: str, payload: str, items: str) -> DataFrame:
    v = F.try_parse_json(F.coalesce(payload, F.lit("")))
    return df.select(key, v.alias("__v")).withColumn("__list", F.when(_kind(F.col("__v")) == "object", F.try_variant_get("__v", f"$.{items}", "array<variant>")))


def judged(df: DataFrame, key: str, payload: str, items: str, fields: Sequence[Field]) -> DataFrame:
    """``(key, place, item, faults, accepted, found)``: each item of each payload's list, as a variant, with its faults."""
    each = F.transform("__list", lambda x, i: F.struct(x.alias("item"), _item_faults(x, _place(items, i), fields).alias("found")))
    d = _parsed(df, key, payload, items).select(key, F.posexplode(each).alias("place", "x")).select(key, "place", "x.*")
    return d.select(key, F.col("place").cast("long").alias("place"), "item", F.size("found").cast("long").alias("faults"), (F.size("found") == 0).alias("accepted"), "found")


def violations(df: DataFrame, key: str, payload: str, items: str, fields: Sequence[Field]) -> DataFrame:
    """``(key, path, code)``: all faults of all payloads, those of the whole (NOT_JSON, NOT_AN_OBJECT, NOT_A_LIST) and those of items.

    Codes of items: NOT_AN_OBJECT, MISSING, WRONG_KIND, UNKNOWN_VALUE, OUT_OF_RANGE, UNEXPECTED_FIELD.  A null payload is not JSON.
    """
    p = _parsed(df, key, payload, items)
    whole = (
        F.when(F.col("__v").isNull(), F.struct(F.lit("$").alias("path"), F.lit("NOT_JSON").alias("code")))
        .when(_kind(F.col("__v")) != "object", _fault(F.lit("$"), "NOT_AN_OBJECT"))
        .when(F.col("__list").isNull(), _fault(F.lit(f"$.{items}"), "NOT_A_LIST"))
    )
    each = F.flatten(F.transform("__list", lambda x, i: _item_faults(x, _place(items, i), fields)))
    every = F.when(whole.isNotNull(), F.array(whole)).otherwise(each)
    return p.select(key, F.explode(every).alias("x")).select(key, "x.path", "x.code")
