"""Front-end sources: kinds of files, imports and their paths, calls of generated clients, types as text.  All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that are tried on an import's path, in this order (fixed values).
EXTENSIONS = ("ts", "tsx", "js", "jsx")
GENERATED = ("gen.ts", "gen.tsx")
INDEX_FILES = ("index.ts", "index.tsx", "index.js", "index.jsx", "index.gen.ts", "index.gen.tsx")
#: Decorators that validate a class's properties (fixed values).
VALIDATORS = ("IsString", "IsEmail", "IsOptional", "IsNumber", "Min", "Max", "Length", "IsArray", "IsObject", "IsBoolean", "IsDate", "IsEnum", "IsNotEmpty", "ApiProperty")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_sdk_file(path: Column) -> Column:
    """A generated or hand-written client, by the names of the file and of its folders."""
    segments = F.split(F.lower(path), "/")
    name = F.element_at(segments, -1)
    return F.arrays_overlap(segments, F.array(*map(F.lit, ("sdk", "openapi-client", "api-client")))) | name.rlike(r"\.gen\.tsx?$|^sdk\.[^.]*$|(?:\.sdk|-client|_client)\.tsx?$")


def is_generated_types(path: Column) -> Column:
    return F.lower(path).rlike(r"\.gen\.tsx?$|types\.gen\.ts$|[/\\](?:openapi-client|generated|sdk)[/\\]")


def inner_type(name: Column) -> Column:
    """What stands between the first < and the last >, else the name itself."""
    return F.when(name.rlike(r"(?s)^[^<]*<.*>"), F.trim(F.regexp_extract(name, r"(?s)^[^<]*<(.*)>", 1))).otherwise(name)


def base_type(text: Column) -> Column:
    """Base type of a type as text: keywords, arrays, names; other forms are unknown."""
    return (
        F.when(text == "string", "String")
        .when(text == "number", "Number")
        .when(text == "boolean", "Boolean")
        .when(text == "any", "Any")
        .when(text.isin("null", "undefined", "void", "unknown", "never", "object", "symbol", "bigint"), "Unknown")
        .when(text.endswith("[]"), "Array")
        .when(text.rlike(r"^[A-Za-z_$][\w$.]*(<.*>)?$"), "Object")
        .otherwise("Unknown")
    )


def trpc_path(chain: Column) -> Column:
    """/trpc/ and the procedure of a chain that ends in useQuery or useMutation."""
    bare = F.regexp_replace(F.regexp_replace(chain, r"(\.useQuery)+$", ""), r"(\.useMutation)+$", "")
    return F.concat(F.lit("/trpc/"), F.regexp_replace(bare, r"^(?:trpc|api)(?:\.|$)", ""))


def url_of_argument(argument: Column) -> Column:
    """The url of an options object, else the argument itself; / without an argument."""
    after = F.regexp_extract(argument, r"(?s)url:(.*)$", 1)
    double, single = F.regexp_extract(after, r"(?s)^[^\"]*\"([^\"]*)\"", 1), F.regexp_extract(after, r"(?s)^[^']*'([^']*)'", 1)
    found = F.when(after.contains('"'), F.when(after.rlike(r"(?s)\".*\""), double)).when(after.rlike(r"(?s)'.*'"), single)
    return F.coalesce(F.when(argument.contains("url:"), found), argument, F.lit("/"))


def matches_mapping(path: Column, pattern: Column) -> Column:
    """Whether an import falls under a path mapping: x/* needs the slash, others the whole path."""
    return F.when(pattern.endswith("/*"), F.startswith(path, F.regexp_replace(pattern, r"\*$", ""))).otherwise(path == pattern)


def is_mapping_prefix(path: Column, pattern: Column) -> Column:
    """The looser test: x/* by its letters alone."""
    return F.when(pattern.endswith("/*"), F.startswith(path, F.regexp_replace(pattern, r"/\*$", ""))).otherwise(path == pattern)


def apply_mapping(path: Column, pattern: Column, target: Column, base: Column) -> Column:
    """The file path that a mapping gives: the target below the base, with what the star stands for."""
    rest = F.regexp_replace(F.substring(path, F.char_length(F.regexp_replace(pattern, r"/\*$", "")) + 1, F.lit(1 << 20)), "^/+", "")
    return F.when(pattern.endswith("/*"), F.concat_ws("/", base, F.regexp_replace(target, r"/\*$", ""), rest)).otherwise(F.concat_ws("/", base, target))


def relative_target(importing: Column, path: Column) -> Column:
    """Path without an ending that a relative import points to: one folder up for each further dot at its start."""
    return target_from(folder(importing), path)


def target_from(importing_folder: Column, path: Column) -> Column:
    """``relative_target`` by the folder of the importing file, on which alone it depends."""
    dots = F.char_length(F.regexp_extract(path, r"^(\.*)", 1))
    here = F.split(importing_folder, "/")
    base = F.array_join(F.slice(here, F.lit(1), F.greatest(F.lit(0), F.size(here) - F.greatest(dots - 1, F.lit(0)))), "/")
    return F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(F.regexp_replace(path, r"^[./]+", ""), F.lit("")))


def candidates(target: Column) -> Column:
    """Files that an import's target may be, in order of preference."""
    bare = F.regexp_replace(target, r"(?<=[^/])\.[^./]*$", "")
    stem = F.concat(F.when(folder(target) == "", "").otherwise(F.concat(folder(target), F.lit("/"))), F.regexp_replace(file_name(target), r"(?<=.)\.[^.]*$", ""))
    with_extension = [F.concat(bare, F.lit(f".{x}")) for x in EXTENSIONS]
    generated = [F.concat(stem, F.lit(f".{x}")) for x in GENERATED]
    index = [F.concat(target, F.lit(f"/{x}")) for x in INDEX_FILES]
    return F.array(target, *with_extension, *generated, *index)


def without_ending(path: Column) -> Column:
    """The path without one of the endings that are tried."""
    return F.regexp_replace(path, rf"(\.gen)?\.({'|'.join(EXTENSIONS)})$", "")


def candidate_forms(target: Column) -> Column:
    """``without_ending`` of all candidates, each form once: candidates that differ by their ending alone have the same form, so one of each such group is asked."""
    of = candidates(target)
    first = (0, 1, 1 + len(EXTENSIONS), 1 + len(EXTENSIONS) + len(GENERATED))  # the target itself, with an ending, generated, an index file
    return F.array_distinct(F.array(*(without_ending(of[k]) for k in first)))
