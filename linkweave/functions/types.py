"""Base types of type names in several languages, and whether two type names go together.

All are Column expressions.  Tables of words come as literals in the expression, so nothing is joined or broadcast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkweave.plans.fixtures import TABLES


def _pairs(name: str) -> list[tuple[str, str]]:
    import re

    return re.findall(r"\('([^']*)', '([^']*)'\)", TABLES[name][1])


def _lookup(word: Column, table: str) -> Column:
    out = F.lit("Unknown")
    groups: dict[str, list[str]] = {}
    for key, base in _pairs(table):
        groups.setdefault(base, []).append(key)
    for base, keys in groups.items():
        out = F.when(F.lower(word).isin(keys), base).otherwise(out)
    return out


def base_type(word: Column) -> Column:
    """A type word of schema text."""
    return _lookup(word, "base_types")


def orm_base_type(word: Column) -> Column:
    """A column type of an ORM model."""
    return _lookup(word, "orm_base_types")


def pydantic_base_type(word: Column) -> Column:
    """Optional[..] and Union[..] are looked into; any list inside makes an array."""
    low = F.lower(word)
    wrapped = low.startswith("optional[") | low.startswith("union[")
    inner = F.trim(F.regexp_extract(low, r"(?s)^[^\[]*\[(.*)\]", 1))
    return (
        F.when(wrapped & (low.contains("array") | low.contains("list")), "Array")
        .when(wrapped & low.rlike(r"(?s)\[.*\]"), base_type(inner))
        .otherwise(base_type(word))
    )


def _either(a: Column, b: Column, x: str, y: str) -> Column:
    return ((a == x) & (b == y)) | ((a == y) & (b == x))


def zod_fits_pydantic(zod: Column, pydantic: Column) -> Column:
    a, b = F.lower(zod), F.lower(pydantic)
    same = a == b
    for x, y in (("string", "str"), ("number", "int"), ("number", "float"), ("boolean", "bool")):
        same = same | _either(a, b, x, y)
    for x, y in (("array", "list["), ("object", "dict[")):
        same = same | ((a == x) & b.startswith(y)) | (a.startswith(y) & (b == x))
    return same


def orm_fits_pydantic(orm: Column, pydantic: Column) -> Column:
    a, b = F.lower(orm), F.lower(pydantic)
    same = a == b
    for x, y in (("integer", "int"), ("string", "str"), ("text", "str"), ("boolean", "bool"), ("numeric", "float"), ("decimal", "float")):
        same = same | _either(a, b, x, y)
    dated = lambda c: c.contains("date") | c.contains("time")
    jsons = (a.contains("json") | (a == "dict")) & (b.contains("json") | b.isin("dict", "object"))
    return same | (a.contains("uuid") & b.contains("uuid")) | (dated(a) & dated(b)) | jsons


def pydantic_fits_openapi(pydantic: Column, openapi: Column) -> Column:
    a, b = F.lower(pydantic), F.lower(openapi)
    same = a == b
    for x, y in (("str", "string"), ("int", "integer"), ("bool", "boolean"), ("float", "number"), ("double", "number")):
        same = same | _either(a, b, x, y)
    for word in ("date", "time", "uuid"):
        same = same | (a.contains(word) & b.contains(word))
    return same | ((a.startswith("list[") | a.startswith("array")) & (b == "array")) | (a.startswith("dict[") & (b == "object"))
