"""JSON recovery and schema checks: recursive, so they run as Arrow functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F


def recover(text: str | None) -> str | None:
    """The first JSON object or array of a text, as canonical JSON: the whole
    text, else a fenced block, else a balanced scan; trailing commas are repaired."""
    if not text:
        return None
    tried = [text.strip(), *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)]
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted = escaped or c != '"'
                escaped = c == "\\" and not escaped
            elif c == '"':
                quoted, escaped = True, False
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if not depth:
                    tried.append(text[start : i + 1])
                    break
    for candidate in tried:
        for form in (candidate, re.sub(r",\s*([}\]])", r"\1", candidate)):
            try:
                value = json.loads(form)
            except ValueError:
                continue
            if isinstance(value, (dict, list)):
                return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return None


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, _KINDS[kind])


def schema_error(value: object, schema: dict, path: str = "$") -> str | None:
    """the path of the first value that breaks the schema, with the rule."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{path}: type"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{path}: range"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{path}: length"
    if isinstance(value, list):
        for i, item in enumerate(value):
            if error := schema_error(item, schema.get("items", {}), f"{path}[{i}]"):
                return error
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}.{name}: required"
        known = schema.get("properties", {})
        for name, item in value.items():
            if name in known:
                if error := schema_error(item, known[name], f"{path}.{name}"):
                    return error
            elif schema.get("additionalProperties") is False:
                return f"{path}.{name}: unknown"
    return None


def semantic_error(value: object, path: str = "$") -> str | None:
    """a number that is not finite, or a confidence outside [0, 1]."""
    if isinstance(value, float) and value in (float("inf"), float("-inf")) or value != value:
        return f"{path}: not finite"
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for name, item in items:
        if name == "confidence" and isinstance(item, (int, float)) and not 0 <= item <= 1:
            return f"{path}.confidence: range"
        if error := semantic_error(item, f"{path}.{name}"):
            return error
    return None


def recovered_json(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return part.map(recover)

    return run(c)


def json_schema_error(c: Column, schema: dict) -> Column:
    """F18, F19 over JSON text; null where nothing is wrong or the text is null."""

    @F.pandas_udf("string")
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda t: None if t is None else schema_error(v := json.loads(t), schema) or semantic_error(v))

    return run(c)
