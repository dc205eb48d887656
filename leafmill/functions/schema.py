"""Schemas that users give: Python types to JSON Schema, JSON Schema to Spark types."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of JSON Schema types.
_NAMES = {str: "string", int: "integer", float: "number", bool: "boolean", dict: "object", list: "array"}
_SPARK = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "null": T.StringType()}


def load(source: str | dict) -> dict:
    """A schema that is given inline, as JSON text, or as the path of a JSON file."""
    if isinstance(source, dict):
        return source
    if not source.lstrip().startswith("{"):
        source = Path(source).read_text(encoding="utf-8")
    found = json.loads(source)
    if not isinstance(found, dict):
        raise ValueError("a schema is a JSON object")
    return found


def json_schema(source: type | dict) -> dict:
    """JSON Schema of a dict (as it is), a dataclass, or a model class with ``model_fields``; other things are an error."""
    if isinstance(source, dict):
        return source
    if not isinstance(source, type) or not (dataclasses.is_dataclass(source) or hasattr(source, "model_fields")):
        raise TypeError("a schema is a dict, a dataclass or a model class")
    return _of(source)


def _fields(cls: type) -> list[tuple[str, object, str | None, bool]]:
    """Name, type, description and whether a value must be given, of a class's fields."""
    if hasattr(cls, "model_fields"):
        return [(n, f.annotation, f.description, f.is_required()) for n, f in cls.model_fields.items()]
    known, none = typing.get_type_hints(cls), dataclasses.MISSING
    return [(f.name, known.get(f.name, f.type), f.metadata.get("description"), f.default is none and f.default_factory is none) for f in dataclasses.fields(cls)]


def _of(kind: object) -> dict:
    if kind in _NAMES:
        return {"type": _NAMES[kind]}
    outer, inner = typing.get_origin(kind), typing.get_args(kind)
    if outer in (typing.Union, types.UnionType):
        some = [_of(a) for a in inner if a is not type(None)]
        return some[0] if len(some) == 1 else {"anyOf": some}
    if outer is list:
        return {"type": "array", "items": _of(inner[0] if inner else str)}
    if outer is dict:
        return {"type": "object"}
    if isinstance(kind, type) and (dataclasses.is_dataclass(kind) or hasattr(kind, "model_fields")):
        rows = _fields(kind)
        out = {"type": "object", "properties": {n: _of(t) | ({"description": d} if d else {}) for n, t, d, _ in rows}}
        needed = [n for n, _, _, must in rows if must]
        return out | ({"required": needed} if needed else {})
    return {"type": "string"}


def spark_type(schema: dict) -> T.DataType:
    """The Spark type that holds values of a JSON Schema; what may be of several types, or of any shape, is a variant."""
    kind = schema.get("type")
    if isinstance(kind, list):
        some = [k for k in kind if k != "null"]
        kind = some[0] if len(some) == 1 else None
    if kind == "object" and schema.get("properties"):
        needed = set(schema.get("required", ()))
        return T.StructType([T.StructField(n, spark_type(s), True, {"required": n in needed}) for n, s in schema["properties"].items()])
    if kind == "array":
        return T.ArrayType(spark_type(schema.get("items", {"type": "string"})))
    return _SPARK.get(kind, T.VariantType())


def extracted(reply: Column, schema: dict) -> Column:
    """A typed record of a model's reply (JSON, fenced or not); null if it isn't an object or lacks a required value."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"(?s)^.*```json", ""), r"(?s)```.*$", "")
    got = F.from_json(F.trim(bare), spark_type(schema))
    whole = F.lit(True)
    for name in schema.get("required", ()):
        whole = whole & got[name].isNotNull()
    return F.when(whole, got)
