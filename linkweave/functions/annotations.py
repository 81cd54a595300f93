"""Type annotations as text: wrappers, unions, generics, columns, calls that transform models.

All are Column expressions over one annotation, so they stay in the JVM; nesting is taken off by folds of a fixed length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deepest nesting that is looked into (fixed value).
MAX_DEPTH = 20
#: Names that mark a parameter as a service, not as a body (fixed values).
SERVICE_NAMES = ("Depends", "Request", "Response", "HTTPException", "BackgroundTasks", "UploadFile", "File", "Form", "db", "session", "current_user", "user")
#: Methods that turn models into data or data into models, and what they do (fixed values).
TRANSFORMATIONS = {
    "model_validate": "ValidateData",
    "parse_obj": "ValidateData",
    "model_validate_json": "ValidateJson",
    "parse_raw": "ValidateJson",
    "from_orm": "FromOrm",
    "model_dump": "ToDict",
    "dict": "ToDict",
    "model_dump_json": "ToJson",
    "json": "ToJson",
    "model_serialize": "Serialize",
}
#: Those that are recognised on longer dotted names too (fixed values).
LONG_NAMED = ("model_validate", "model_dump", "from_orm", "dict", "json")
#: Variables that routers are commonly held in, beside app and router (fixed values).
ROUTER_NAMES = ("api_router", "api", "main_router", "main", "fastapi_router", "fastapi", "app_router", "web_router", "r", "rt", "router_instance")


def _empty() -> Column:
    return F.array().cast("array<string>")


def head(text: Column) -> Column:
    """What stands before the first bracket."""
    return F.trim(F.regexp_extract(text, r"(?s)^([^\[]*)", 1))


def bracketed(text: Column) -> Column:
    """What stands between the first and the last bracket; empty without brackets."""
    return F.trim(F.regexp_extract(text, r"(?s)^[^\[]*\[(.*)\]", 1))


def is_generic(text: Column) -> Column:
    return text.rlike(r"(?s)^[^\[]*\[.*\]")


def split_top(text: Column, separator: str) -> Column:
    """The parts between separators that stand outside brackets, trimmed."""
    start = F.struct(_empty().alias("done"), F.lit("").alias("part"), F.lit(0).alias("depth"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c.isin("[", "(", "{"), 1).when(c.isin("]", ")", "}"), -1).otherwise(0)
        cut = (c == separator) & (a["depth"] == 0)
        done = F.when(cut, F.array_append(a["done"], F.trim(a["part"]))).otherwise(a["done"])
        part = F.when(cut, "").otherwise(F.concat(a["part"], c))
        return F.struct(done.alias("done"), part.alias("part"), depth.cast("int").alias("depth"))

    return F.aggregate(F.split(text, ""), start, step, lambda a: F.array_append(a["done"], F.trim(a["part"])))


def innermost(text: Column) -> Column:
    """The model inside wrappers: values of dictionaries, items of lists, the first member of a union that isn't None, arguments of generics."""

    def step(x: Column, _: Column) -> Column:
        base, inner = head(x), bracketed(x)
        value = F.trim(F.regexp_extract(inner, r"(?s)^[^,]*,(.*)$", 1))
        member = F.get(F.filter(F.transform(F.split(inner, ","), lambda m: F.trim(m)), lambda m: ~m.isin("None", "")), 0)
        return (
            F.when(~is_generic(x) | (inner == ""), F.trim(x))
            .when(base.isin("dict", "Dict") & inner.contains(","), value)
            .when(base == "Union", F.coalesce(member, F.trim(x)))
            .otherwise(inner)
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(MAX_DEPTH)), F.trim(text), step)


def base_model(response_model: Column) -> Column:
    """Name of the model that a response model is about, without its module."""
    return F.trim(F.substring_index(innermost(response_model), ".", -1))


def _combined(members: Column) -> Column:
    return F.when(F.size(members) == 1, F.get(members, 0)).otherwise(F.concat(F.lit("Union["), F.array_join(members, ", "), F.lit("]")))


def union_members(text: Column) -> Column:
    """(has_none, members) of a union written with bars; members in order, without None."""
    parts = split_top(text, "|")
    return F.struct(F.exists(parts, lambda p: p == "None").alias("has_none"), F.filter(parts, lambda p: p != "None").alias("members"))


def optional_or_union(text: Column) -> Column:
    """(optional, base): Optional[..], Union[.., None] and .. | None."""
    inner, bars = bracketed(text), union_members(text)
    named = split_top(inner, ",")
    members = F.filter(named, lambda p: p != "None")
    out = lambda optional, base: F.struct(optional.alias("optional"), base.alias("base"))
    barred = (F.size(split_top(text, "|")) > 1) & (F.size(bars["members"]) > 0)
    union = is_generic(text) & (head(text) == "Union") & (F.size(named) > 1) & (F.size(members) > 0)
    return (
        F.when(barred, out(bars["has_none"], _combined(bars["members"])))
        .when(is_generic(text) & (head(text) == "Optional"), out(F.lit(True), inner))
        .when(union, out(F.exists(named, lambda p: p == "None"), _combined(members)))
        .otherwise(out(F.lit(False), text))
    )


def dict_value(inner: Column) -> Column:
    """The value type in the brackets of a dictionary type."""
    parts = split_top(inner, ",")
    return F.when(F.size(parts) > 1, F.get(parts, 1)).otherwise(inner)


def with_generics(text: Column) -> Column:
    """(optional, base, inner): lists are arrays, dictionaries objects, other generics themselves."""
    inner, base, bars = bracketed(text), head(text), union_members(text)
    none = F.lit(None).cast("string")
    out = lambda optional, b, i: F.struct(optional.alias("optional"), b.alias("base"), i.alias("inner"))
    return (
        F.when(F.size(split_top(text, "|")) > 1, out(bars["has_none"], _combined(bars["members"]), none))
        .when(~is_generic(text), out(F.lit(False), text, none))
        .when(base == "Optional", out(F.lit(True), inner, none))
        .when(base.isin("list", "List"), out(F.lit(False), F.lit("array"), inner))
        .when(base.isin("dict", "Dict"), out(F.lit(False), F.lit("object"), dict_value(inner)))
        .otherwise(out(F.lit(False), base, inner))
    )


def is_annotated(text: Column) -> Column:
    return is_generic(text) & head(text).rlike(r"(^|\.)Annotated$")


def annotated_inner(text: Column) -> Column:
    """T of Annotated[T, ..]."""
    return F.get(split_top(bracketed(text), ","), 0)


def annotated_kind(text: Column) -> Column:
    """Name of the second part of Annotated[T, x.Body(..)]: Body; null where there is none."""
    second = F.get(split_top(bracketed(text), ","), 1)
    return F.when(is_annotated(text), F.substring_index(F.trim(F.regexp_extract(second, r"(?s)^([^(]*)", 1)), ".", -1))


def missing_schema(text: Column) -> Column:
    """Whether a type says nothing about its fields: dictionaries, lists of dictionaries, any."""
    inner = F.when(head(text) == "Optional", bracketed(text)).otherwise(text)
    name = F.when(head(text) == "Optional", inner).otherwise(head(text))
    plain = name.isin("dict", "Dict") & ~F.coalesce(text.contains("[") & text.contains("TypedDict"), F.lit(False))
    listed = name.isin("list", "List") & bracketed(text).rlike("^[dD]ict")
    return plain | listed | name.isin("any", "Any")


def annotation_base_type(text: Column) -> Column:
    """Base type of an annotation that names no model."""
    word = F.lower(F.when(head(text) == "Optional", bracketed(text)).otherwise(head(text)))
    return (
        F.when(word.isin("str", "string"), "String")
        .when(word.isin("int", "integer", "float", "number"), "Number")
        .when(word.isin("bool", "boolean"), "Boolean")
        .when(word.isin("list", "array", "tuple"), "Array")
        .when(word.isin("dict", "object"), "Object")
        .otherwise("Unknown")
    )


def column_type(text: Column) -> Column:
    """(type_name, nullable) of a mapped column: Mapped[T], Mapped[Optional[T]], Column(T, ..), else by words in the text."""
    inner, low = bracketed(text), F.lower(text)
    called = F.regexp_extract(text, r"(?s)^[^(]*\((.*)\)", 1)
    out = lambda name, nullable: F.struct(name.alias("type_name"), nullable.alias("nullable"))
    by_word = F.when(low.contains("int"), "Integer").when(low.contains("str"), "String").when(low.contains("bool"), "Boolean").when(low.contains("float"), "Float").otherwise("Unknown")
    return (
        F.when(text.contains("Mapped[") & inner.startswith("Optional["), out(bracketed(inner), F.lit(True)))
        .when(text.contains("Mapped[") & is_generic(text), out(inner, F.lit(False)))
        .when(text.contains("Column(") & text.contains(")"), out(F.trim(F.split_part(called, F.lit(","), F.lit(1))), F.lower(called).contains("nullable=true")))
        .otherwise(out(by_word, F.lit(False)))
    )


def is_orm_class(bases: Column, annotations: Column) -> Column:
    """Whether a class with these bases (array) is a mapped one; bases called Model need a mapped annotation in the class."""
    last = lambda b: F.substring_index(b, ".", -1)
    sure = F.exists(bases, lambda b: last(b).isin("Base", "declarative_base") | b.contains("SQLAlchemyBase") | b.contains("db.Model"))
    mapped = F.exists(annotations, lambda a: a.rlike("Column|relationship|Mapped"))
    return sure | (F.exists(bases, lambda b: b.endswith("Model")) & mapped)


def transformation(call: Column) -> Column:
    """(method, model) where a call turns data into a model or a model into data; null for other calls."""
    parts = F.split(call, r"\.")
    method, model = F.element_at(parts, -1), F.regexp_extract(call, r"^(.*)\.[^.]*$", 1)
    two = (F.size(parts) == 2) & method.isin(*TRANSFORMATIONS)
    return F.when(two | ((F.size(parts) > 2) & method.isin(*LONG_NAMED)), F.struct(method.alias("method"), model.alias("model")))


def transformation_type(method: Column) -> Column:
    out = F.when(method.isin("from_attributes"), "FromOrm").when(method == "model_validate_dict", "FromDict")
    for kind in dict.fromkeys(TRANSFORMATIONS.values()):
        out = out.when(method.isin(*(m for m, k in TRANSFORMATIONS.items() if k == kind)), kind)
    return out


def is_route_decorator(name: Column) -> Column:
    """app.*, router.*, *.route*, and a verb on one of the usual router variables."""
    usual = name.rlike(rf"^(?:{'|'.join(ROUTER_NAMES)})\.(?:.*\.)?(?:get|post|put|patch|delete|head|options)$")
    return name.startswith("app.") | name.startswith("router.") | name.contains(".route") | usual


def has_decorator(decorators: Column, name: str) -> Column:
    """Whether a list of decorator names has the name, whole or as the last part."""
    return F.exists(decorators, lambda d: (d == name) | d.endswith(f".{name}"))


def is_service_name(name: Column) -> Column:
    """A service's name, alone or as a part between underscores."""
    either = "|".join(SERVICE_NAMES)
    return name.rlike(rf"^(?:{either})$|^(?:{either})_|_(?:{either})$|_(?:{either})_")


def is_body_parameter(name: Column, type_text: Column, is_model: Column) -> Column:
    """Whether a handler's parameter is the request's body: marked so, or a model that is no service and not marked as another source.

    ``is_model``: whether the type's simple name is a known model."""
    marked = lambda word: type_text.contains(f"{word}(")
    elsewhere = marked("Query") | marked("Path") | marked("Header")
    return F.coalesce(F.when(elsewhere, False).when(marked("Body"), True).when(is_service_name(name), False).otherwise(is_model), F.lit(False))
