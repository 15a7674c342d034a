"""Dynamically typed property values as tagged columns, and the three equality relations over them.

A value is struct<t, v>: its type name and canonical text.  A property map is
map<string, struct<t, v>>.  A key that is present with type ``null`` differs
from a missing key.  Lists and maps are JSON of [tag, content] pairs at every
depth, so that ``["int","1"]`` with plain quotes is an integer and nothing else.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StringType, StructField, StructType

VALUE = StructType([StructField("t", StringType()), StructField("v", StringType())])
PROPS = MapType(StringType(), VALUE)
NODE_SCHEMA = StructType([StructField("id", LongType()), StructField("labels", ArrayType(StringType())), StructField("props", PROPS)])
EDGE_SCHEMA = StructType([StructField("id", LongType()), StructField("src", LongType()), StructField("dst", LongType()), StructField("label", StringType()), StructField("props", PROPS)])
#: Nesting deeper than this is refused.
MAX_DEPTH = 32
VALUE_TYPE, PROPS_TYPE = "struct<t:string,v:string>", "map<string,struct<t:string,v:string>>"


def tree(value: Any, depth: int = 0) -> tuple[str, Any]:
    """Tag and content of a Python value: a text, or the trees of what it holds; tuples and other types are refused."""
    if depth > MAX_DEPTH:
        raise ValueError("property values nest too deeply")
    if value is None:
        return ("null", None)
    if isinstance(value, bool):
        return ("bool", "true" if value else "false")
    if isinstance(value, int):
        if -(2**63) <= value < 2**63:
            return ("int", str(value))
        return ("float", repr(float(value)))
    if isinstance(value, float):
        return ("float", repr(value))
    if isinstance(value, str):
        return ("str", value)
    if isinstance(value, list):
        return ("list", [tree(x, depth + 1) for x in value])
    if isinstance(value, Mapping):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("keys of a map property must be strings")
        return ("map", {k: tree(value[k], depth + 1) for k in sorted(value)})
    raise ValueError(f"unsupported property type {type(value).__name__}")


def encode(value: Any) -> tuple[str, str | None]:
    """Tag and text of a Python value."""
    t, content = tree(value)
    return (t, json.dumps(content, ensure_ascii=False, separators=(",", ":"))) if t in ("list", "map") else (t, content)


def grown(t: str, v: Any) -> Any:
    """The Python value of a tag and its content."""
    if t == "null" or v is None:
        return None
    if t == "bool":
        return v == "true"
    if t == "int":
        return int(v)
    if t == "float":
        return float({"Infinity": "inf", "-Infinity": "-inf"}.get(v, v))
    if t == "list":
        return [grown(*x) for x in v]
    if t == "map":
        return {k: grown(*x) for k, x in v.items()}
    return v


def decode(t: str, v: str | None) -> Any:
    """The Python value of a tag and its text."""
    return grown(t, json.loads(v) if t in ("list", "map") and v is not None else v)


def encode_props(props: Mapping[str, Any]) -> dict[str, tuple[str, str | None]]:
    return {k: encode(v) for k, v in props.items()}


def decode_props(props: Mapping[str, Any] | None) -> dict[str, Any]:
    return {k: decode(*v) for k, v in (props or {}).items()}


def value_lit(value: Any) -> Column:
    t, v = encode(value)
    return F.struct(F.lit(t).alias("t"), F.lit(v).cast("string").alias("v"))


def props_lit(props: Mapping[str, Any]) -> Column:
    if not props:
        return F.create_map().cast(PROPS_TYPE)
    return F.create_map(*[x for k in props for x in (F.lit(k), value_lit(props[k]))])


def tagged(kind: str, column: Column) -> Column:
    """A typed column as a tagged value; null becomes type null."""
    return F.when(column.isNull(), F.struct(F.lit("null").alias("t"), F.lit(None).cast("string").alias("v"))).otherwise(F.struct(F.lit(kind).alias("t"), column.cast("string").alias("v")))


def typed_props(columns: Mapping[str, tuple[str, Column]]) -> Column:
    return F.create_map(*[x for k, (kind, c) in columns.items() for x in (F.lit(k), tagged(kind, c))])


def prop(key: str, props: str | Column = "props") -> Column:
    return (F.col(props) if isinstance(props, str) else props)[key]


def _typed(key: str, kinds: tuple[str, ...], to: str, props: str | Column) -> Column:
    p = prop(key, props)
    return F.when(p["t"].isin(*kinds), p["v"].cast(to))


def prop_int(key: str, props: str | Column = "props") -> Column:
    return _typed(key, ("int",), "bigint", props)


def prop_float(key: str, props: str | Column = "props") -> Column:
    """Numbers as double."""
    return _typed(key, ("int", "float"), "double", props)


def prop_str(key: str, props: str | Column = "props") -> Column:
    return _typed(key, ("str",), "string", props)


def prop_bool(key: str, props: str | Column = "props") -> Column:
    return _typed(key, ("bool",), "boolean", props)


def _double(v: Column) -> Column:
    return v.cast("double") + F.lit(0.0)  # -0.0 becomes 0.0


def strict_key(value: Column) -> Column:
    """E1: equal keys for equal typed values; null (never equal) for NaN.  A missing value has a null key, too."""
    t, v = value["t"], value["v"]
    number = _double(v)
    nested = F.when(~v.contains('["float","nan"]'), F.replace(v, F.lit('["float","-0.0"]'), F.lit('["float","0.0"]')))
    text = F.when(t == "float", F.when(~F.isnan(number), number.cast("string"))).when(t.isin("list", "map"), nested).otherwise(F.coalesce(v, F.lit("")))
    return F.concat(t, F.lit(":"), text)


def _loose_float(v: Column) -> Column:
    """Key of a float's text, that of the integer where it is whole; null for NaN."""
    number = _double(v)
    whole = (number == F.floor(number)) & (F.abs(number) < 9.2e18)
    return F.when(F.isnan(number), None).when(whole, F.concat(F.lit("n:"), number.cast("bigint").cast("string"))).otherwise(F.concat(F.lit("f:"), number.cast("string")))


#: A float, an integer and the booleans as they stand in the text of a list or map.
FLOAT_LEAF, INT_LEAF, TRUE_LEAF, FALSE_LEAF = r'\["float","([^"]*)"\]', r'\["int","([^"]*)"\]', r'\["bool","true"\]', r'\["bool","false"\]'


def _loose_nested(v: Column) -> Column:
    """Text of a list or map with every number and boolean in it as its loose key; null if a NaN is among them."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, INT_LEAF, '["n:$1"]'), TRUE_LEAF, '["n:1"]'), FALSE_LEAF, '["n:0"]')
    between = F.split(text, FLOAT_LEAF)
    floats = F.transform(F.regexp_extract_all(text, F.lit(FLOAT_LEAF), F.lit(1)), _loose_float)
    put = F.zip_with(between, floats, lambda a, f: F.when(f.isNull(), a).otherwise(F.concat(a, F.lit('["'), f, F.lit('"]'))))
    return F.when(F.forall(floats, lambda f: f.isNotNull()), F.array_join(put, ""))


def loose_key(value: Column) -> Column:
    """E2: numbers and booleans compare by value, in lists and maps too; null equals missing; null key (never equal) for NaN."""
    t, v = value["t"], value["v"]
    return (
        F.when(t.isNull() | (t == "null"), F.lit("null"))
        .when(t == "bool", F.concat(F.lit("n:"), F.when(v == "true", "1").otherwise("0")))
        .when(t == "int", F.concat(F.lit("n:"), v))
        .when(t == "float", _loose_float(v))
        .when(t.isin("list", "map"), F.concat(t, F.lit(":"), _loose_nested(v)))
        .otherwise(F.concat(t, F.lit(":"), v))
    )


def props_key(props: str | Column, by=strict_key) -> Column:
    """One comparable text for a whole property map; null if any value never equals."""
    p = F.col(props) if isinstance(props, str) else props
    entries = F.array_sort(F.map_entries(p))
    parts = F.transform(entries, lambda e: F.concat(F.length(e["key"]).cast("string"), F.lit("="), e["key"], F.lit("="), by(e["value"])))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), F.array_join(F.transform(parts, lambda x: F.concat(F.length(x).cast("string"), F.lit("#"), x)), ""))


def python_text(t: str | None, v: str | None) -> str | None:
    """repr of a value, the keys of maps sorted; None where there is no value at all."""
    if t is None:
        return None

    def sort(x: Any) -> Any:
        return {k: sort(x[k]) for k in sorted(x)} if isinstance(x, dict) else [sort(y) for y in x] if isinstance(x, list) else x

    return repr(sort(decode(t, v)))


@F.pandas_udf(StringType())
def _python_text(t: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series([python_text(a, b) for a, b in zip(t, v, strict=True)])


def needs_python(value: Column) -> Column:
    """Whether a value's text cannot be made by SQL expressions: floats, nested values, strings with marks to escape."""
    return value["t"].isin("float", "list", "map") | ((value["t"] == "str") & value["v"].rlike(r"['\\]|[^\x20-\x7E\u00A1-\u00AC\u00AE-\u024F]"))


def text_key(value: Column, python: bool = True) -> Column:
    """E3: the value as Python shows it; null for a missing value.  With ``python`` off, only for values that need none."""
    t, v = value["t"], value["v"]
    plain = F.when(t == "null", "None").when(t == "bool", F.initcap(v)).when(t == "int", v).when(t == "str", F.concat(F.lit("'"), v, F.lit("'")))
    return F.when(needs_python(value), _python_text(t, v)).otherwise(plain) if python else plain


def python_needed(df: DataFrame, values: list[Column]) -> bool:
    """Whether any of the values needs the Python text; a JVM-side scan that stops at the first."""
    test = F.lit(False)
    for v in values:
        test = test | F.coalesce(needs_python(v), F.lit(False))
    return not df.filter(test).limit(1).isEmpty()


def identity_key(df: DataFrame, keys: list[str], props: str = "props", python: bool | None = None) -> Column:
    """``k=repr,...`` over ``keys``; null where any is missing.  ``python``: whether a value needs it, looked up if not said."""
    values = [prop(k, props) for k in keys]
    python = python_needed(df, values) if python is None else python
    parts = [F.concat(F.lit(f"{k}="), text_key(v, python)) for k, v in zip(keys, values, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(","), p)
    return out


def overlay(base: Column, extra: Column, last_wins: bool = True) -> Column:
    """Keys of both maps; where both have one, ``extra``'s value (or ``base``'s) stands."""
    if not last_wins:
        base, extra = extra, base
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k)), extra)


def finite(value: Any) -> bool:
    """Whether a decoded value holds no NaN or infinity."""
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, list):
        return all(map(finite, value))
    if isinstance(value, dict):
        return all(map(finite, value.values()))
    return True
