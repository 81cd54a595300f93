"""Names, paths and verbs: the scalar functions of the engine as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that are taken off model names, each repeatedly, in this order (fixed values).
MODEL_SUFFIXES = ("Read", "Create", "Update", "Delete", "Response", "Request", "Schema", "Model")
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD")


def kebab(name: Column) -> Column:
    """PascalCase to kebab-case."""
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", "-$1"))


def strip_model_suffixes(name: Column) -> Column:
    for suffix in MODEL_SUFFIXES:
        name = F.regexp_replace(name, f"({suffix})+$", "")
    return name


def hook_path(hook: Column) -> Column:
    """Path of a generated query hook: /kebab-case of the bare name."""
    bare = F.element_at(F.split(hook, r"\."), -1)
    for pattern in ("^(use)+", "(Query)+$", "(Mutation)+$", "(ById)+$", "(Lazy)+$"):
        bare = F.regexp_replace(bare, pattern, "")
    return F.concat(F.lit("/"), kebab(bare))


def hook_verb(hook: Column) -> Column:
    """Verb that the bare name of a hook speaks of, whether it is a query or a mutation."""
    low = F.lower(F.element_at(F.split(hook, r"\."), -1))
    return F.when(low.rlike("create|add"), "POST").when(low.rlike("update|edit|patch"), "PUT").when(low.rlike("delete|remove"), "DELETE").otherwise("GET")


def verb_of(text: Column) -> Column:
    """The HTTP verb that a text names, null if none."""
    return F.when(F.upper(text).isin(*VERBS), F.upper(text))


def decorator_verb(name: Column) -> Column:
    """Verb of app.get and the like: the second dotted part, else GET."""
    return F.coalesce(verb_of(F.split_part(name, F.lit("."), F.lit(2))), F.lit("GET"))


def options_verb(options: Column) -> Column:
    """Verb in the options of a fetch call, else GET."""
    return F.coalesce(verb_of(F.regexp_extract(options, r"method:\s*[\"']?([A-Za-z]+)", 1)), F.lit("GET"))


def join_paths(base: Column, path: Column) -> Column:
    """/base/path with single slashes."""
    clean = lambda c: F.nullif(F.regexp_replace(c, "^/+|/+$", ""), F.lit(""))
    return F.concat(F.lit("/"), F.concat_ws("/", clean(base), clean(path)))


def action_path(name: Column) -> Column:
    return F.concat(F.lit("/api/"), F.replace(F.regexp_replace(name, r"^actions\.", ""), F.lit("."), F.lit("/")))


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def key_path(key: Column) -> Column:
    """The path of a function key path::name."""
    return F.regexp_extract(key, r"^(.*)::", 1)


def handler_of_operation(operation_id: Column) -> Column:
    return F.substring_index(operation_id, ":", -1)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading path parts that two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same).cast("long")).cast("int")


def dot_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def truncate(text: Column, length: int) -> Column:
    """The text cut to ``length`` bytes of UTF-8, at a character's end, and three dots; as it is if it is no longer, or if no character fits."""
    raw = F.encode(text, "UTF-8")
    inside = lambda k: F.hex(F.substring(raw, length - k + 1, 1)).between("80", "BF")  # noqa: E731  the byte after the cut goes on with a character
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    cut = F.decode(F.substring(raw, F.lit(1), F.lit(length) - back), "UTF-8")
    return F.when((F.octet_length(text) > length) & (F.lit(length) - back > 0), F.concat(cut, F.lit("..."))).otherwise(text)


def function_key(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), name)
