"""JSON Schema as column expressions: arguments of tools, checked and cast.

A schema is compiled once, by recursion over its parts, to one expression over VARIANT: a value inside objects is reached by
its path from the root (so nothing is parsed twice), items of an array by a lambda. What is said of a wrong value names
its path. Supported: type (a name, or a list with null), nullable, enum, minimum, maximum, minLength, maxLength, properties, required,
items, minItems, maxItems. A number without a fraction is an integer, however it is written.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for truth values.
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")
_INTEGER = r"\A(BIGINT|DECIMAL\(\d+,0\))\z"
_NUMBER = r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))\z"


def _none() -> Column:
    return F.array().cast("array<string>")


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def type_of(schema: dict) -> tuple[str | None, bool]:
    """The type that a schema asks for, if any, and whether null will do as well."""
    raw = schema.get("type")
    named = next((t for t in raw if t != "null"), None) if isinstance(raw, list) else raw
    return named, (isinstance(raw, list) and "null" in raw) or bool(schema.get("nullable", False))


def _at(root: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(root, path, kind)


def _below(path: str, key: str) -> str:
    if '"' in key or "\\" in key:
        raise ValueError(f"a property can't be reached by a path: {key!r}")
    return f'{path}["{key}"]'


def _fits(value: Column, kind: str) -> Column:
    """Whether a value has a type of JSON Schema."""
    told = F.schema_of_variant(value)
    tests = {
        "integer": told.rlike(_INTEGER),
        "number": told.rlike(_NUMBER),
        "string": told == "STRING",
        "boolean": told == "BOOLEAN",
        # By a view of their parts: their schema would be that of all that they hold, as a text.
        "array": F.try_variant_get(value, "$", "array<variant>").isNotNull(),
        "object": F.try_variant_get(value, "$", "map<string,variant>").isNotNull(),
    }
    return tests.get(kind, F.lit(True))


def _when(test: Column, text: Column) -> Column:
    """A list of one message if the test holds, else an empty one."""
    return F.when(test, F.array(text)).otherwise(_none())


def _equals(value: Column, other) -> Column:
    told = F.schema_of_variant(value)
    if other is None:
        return F.is_variant_null(value)
    if isinstance(other, bool):
        return (told == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == other)
    if isinstance(other, int | float):
        return told.rlike(_NUMBER) & (F.try_variant_get(value, "$", "double") == float(other))
    if isinstance(other, str):
        return (told == "STRING") & (F.try_variant_get(value, "$", "string") == other)
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(other))))


def _told(parent: Column | None, more: str) -> Column:
    return F.lit(more.removeprefix(".")) if parent is None else F.concat(parent, F.lit(more))


def _check(root: Column, path: str, schema: dict, parent: Column | None, told: str) -> Column:
    """Messages on the value at `path` of `root`; its own path reads parent + told (parent: the path of an array's item)."""
    value = _at(root, path)
    kind, nullable = type_of(schema)
    label = _told(parent, told) if parent is not None or told else F.lit("parameter")
    said = lambda text: F.concat(label, F.lit(text))
    parts = []
    if "enum" in schema:
        known = F.lit(False)
        for other in schema["enum"]:
            known = known | F.coalesce(_equals(value, other), F.lit(False))
        parts.append(_when(~known, said(f" must be one of {schema['enum']}")))
    if kind in ("integer", "number"):
        number = _at(root, path, "double")
        if "minimum" in schema:
            parts.append(_when(number < F.lit(float(schema["minimum"])), said(f" must be >= {schema['minimum']}")))
        if "maximum" in schema:
            parts.append(_when(number > F.lit(float(schema["maximum"])), said(f" must be <= {schema['maximum']}")))
    if kind == "string":
        size = F.length(_at(root, path, "string"))
        if "minLength" in schema:
            parts.append(_when(size < schema["minLength"], said(f" must be at least {schema['minLength']} chars")))
        if "maxLength" in schema:
            parts.append(_when(size > schema["maxLength"], said(f" must be at most {schema['maxLength']} chars")))
    if kind == "object":
        for key in schema.get("required", []):
            parts.append(_when(_at(root, _below(path, key)).isNull(), F.concat(F.lit("missing required "), _told(parent, f"{told}.{key}"))))
        for key, part in schema.get("properties", {}).items():
            inner = _below(path, key)
            parts.append(F.when(_at(root, inner).isNotNull(), _check(root, inner, part, parent, f"{told}.{key}")).otherwise(_none()))
    if kind == "array":
        items = _at(root, path, "array<variant>")
        if "minItems" in schema:
            parts.append(_when(F.size(items) < schema["minItems"], said(f" must have at least {schema['minItems']} items")))
        if "maxItems" in schema:
            parts.append(_when(F.size(items) > schema["maxItems"], said(f" must be at most {schema['maxItems']} items")))
        if "items" in schema:
            above = F.lit("") if parent is None and not told else _told(parent, told)
            each = F.transform(items, lambda v, i: _check(v, "$", schema["items"], F.concat(above, F.lit("["), i.cast("string"), F.lit("]")), ""))
            parts.append(F.flatten(each))
    found = F.concat(*parts) if parts else _none()
    if kind is not None:
        found = F.when(_fits(value, kind), found).otherwise(F.array(said(f" should be {kind}")))
    return F.when(F.is_variant_null(value), _none()).otherwise(found) if nullable else found


def violations(text: Column, schema: dict) -> Column:
    """What is wrong with arguments (JSON text) by the schema of their tool, an object: an array of messages, empty if all is right.

    Messages are in the order of the schema: a value's own, what is missing, then its properties or items. Properties that
    the schema doesn't name are left alone. Text that is no object, or no JSON, or null, is told so.
    """
    if schema.get("type", "object") != "object":
        raise ValueError(f"the schema of arguments is of type object, not {schema.get('type')!r}")
    whole = {**schema, "type": "object"}

    def of(value: Column) -> Column:
        told = F.schema_of_variant(value)
        kind = F.coalesce(F.when(told.startswith("ARRAY"), "list").when(told == "STRING", "str").when(told == "BOOLEAN", "bool").when(told == "VOID", "NoneType").when(told == "DOUBLE", "float").when(told.rlike(_INTEGER), "int").when(told.rlike(_NUMBER), "float"), F.lit("no JSON"))
        return F.when(_fits(value, "object"), _check(value, "$", whole, None, "")).otherwise(F.array(F.concat(F.lit("parameters must be an object, got "), kind)))

    return _once(F.try_parse_json(text), of)


def _cast(root: Column, path: str, schema: dict) -> Column:
    """JSON text of the value at `path` of `root`, cast as far as its schema asks and the value allows."""
    value, (kind, _) = _at(root, path), type_of(schema)
    same, told = F.to_json(value), F.schema_of_variant(_at(root, path))
    text = _at(root, path, "string")
    is_text = told == "STRING"
    if kind == "integer":
        return F.when(is_text & text.rlike(r"\A\s*[+-]?\d{1,38}\s*\z"), F.trim(text).cast("decimal(38,0)").cast("string")).otherwise(same)
    if kind == "number":
        number = F.trim(text).try_cast("double")
        plain = text.rlike(r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z")
        return F.when(is_text & plain & number.isNotNull(), number.cast("string")).otherwise(same)
    if kind == "string":
        written = F.when(told == "BOOLEAN", F.initcap(text)).when(told.rlike(_NUMBER), text).otherwise(same)
        return F.when(is_text | F.is_variant_null(value), same).otherwise(_quoted(written))
    if kind == "boolean":
        low = F.lower(text)
        return F.when(is_text & low.isin(*TRUE), "true").when(is_text & low.isin(*FALSE), "false").otherwise(same)
    if kind == "array" and "items" in schema:
        items = F.transform(_at(root, path, "array<variant>"), lambda v: _cast(v, "$", schema["items"]))
        return F.when(_fits(value, "array"), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).otherwise(same)
    if kind == "object":
        entries = F.map_entries(_at(root, path, "map<string,variant>"))

        def one(entry: Column) -> Column:
            cast = F.to_json(entry["value"])
            for key, part in schema.get("properties", {}).items():
                cast = F.when(entry["key"] == key, _cast(entry["value"], "$", part)).otherwise(cast)
            return F.concat(_quoted(entry["key"]), F.lit(":"), cast)

        return F.when(_fits(value, "object"), F.concat(F.lit("{"), F.array_join(F.transform(entries, one), ","), F.lit("}"))).otherwise(same)
    return same


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)\A\{\"x\":(.*)\}\z", 1)


def cast(text: Column, schema: dict) -> Column:
    """Arguments (JSON text) with values cast where that is safe: texts to numbers and truth values, others to text, in arrays and objects as well.

    What can't be cast stays as it is, to be told by `violations`; text that is no JSON stays as a whole. Keys are in the order
    of a VARIANT (by name).
    """
    if schema.get("type", "object") != "object":
        return text
    return F.coalesce(_once(F.try_parse_json(text), lambda value: _cast(value, "$", {**schema, "type": "object"})), text)
