"""What a project's folders tell before any source is read: roots, entry points, installed packages, path mappings.  Small helpers of the driver."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

#: Files that mark a project's folder, folders of environments, files of path mappings (fixed values, in order).
PYTHON_MARKS = ("pyproject.toml", "setup.py", "requirements.txt", ".git")
FRONTEND_MARKS = ("package.json", "tsconfig.json")
ENVIRONMENTS = (".venv", "venv", "env")
MAPPING_FILES = ("tsconfig.json", "tsconfig.base.json")
ENTRY_NAMES = ("main.py", "app.py", "__main__.py", "server.py")


def find_entry(folder: str, asked: str | None = None) -> str:
    """The asked file, which must lie in the folder, else the first usual entry point there."""
    root = os.path.realpath(folder)
    if asked is not None:
        path = os.path.realpath(os.path.join(root, asked))
        if os.path.commonpath([root, path]) != root:
            raise ValueError(f"{asked} leads out of {folder}")
        if not os.path.isfile(path):
            raise FileNotFoundError(f"{asked} is no file in {folder}")
        return path
    for name in ENTRY_NAMES:
        path = os.path.realpath(os.path.join(root, name))
        if os.path.isfile(path) and os.path.commonpath([root, path]) == root:
            return path
    raise FileNotFoundError(f"no entry point in {folder}: {', '.join(ENTRY_NAMES)}")


def _parents(path: str) -> list[str]:
    out = []
    while os.path.dirname(path) != path:
        path = os.path.dirname(path)
        out.append(path)
    return out


def python_root(app: str) -> str:
    """The nearest marked folder above the application's own folder, else that folder's parent (an application file's folder)."""
    app = os.path.abspath(app)
    start = os.path.dirname(app) if os.path.isfile(app) else app
    marked = (p for p in _parents(start) if any(os.path.exists(os.path.join(p, m)) for m in PYTHON_MARKS))
    return next(marked, os.path.dirname(app) or app)


def common_folder(paths: list[str]) -> str:
    """The longest path of whole parts that all begin with; empty if there is none."""
    parts = [p.split(os.sep) for p in paths]
    shared = os.path.commonprefix(parts)
    return os.sep.join(shared) or (os.sep if shared else "")


def frontend_root(paths: list[str]) -> str:
    """The nearest marked folder from what the source paths share upwards, else the parent of what they share."""
    if not paths:
        return "."
    shared = common_folder([os.path.abspath(p) for p in paths])
    marked = (p for p in [shared, *_parents(shared)] if any(os.path.exists(os.path.join(p, m)) for m in FRONTEND_MARKS))
    return next(marked, os.path.dirname(shared) or ".")


def site_packages(root: str) -> list[str]:
    """Package folders of the first environment in the project, or the one that VIRTUAL_ENV names, that has any."""
    for env in [*(os.path.join(root, e) for e in ENVIRONMENTS), *filter(None, [os.environ.get("VIRTUAL_ENV")])]:
        lib = os.path.join(env, "lib")
        if os.path.isdir(lib):
            found = [os.path.join(lib, p, "site-packages") for p in sorted(os.listdir(lib)) if p.startswith("python")]
            if found := [p for p in found if os.path.isdir(p)]:
                return found
    return []


def find_module(module: str, folders: list[str]) -> str | None:
    """A module's package folder or file among package folders."""
    for folder in folders:
        package, file = os.path.join(folder, module), os.path.join(folder, f"{module}.py")
        if os.path.isfile(os.path.join(package, "__init__.py")):
            return package
        if os.path.isfile(file):
            return file
    return None


def installed_modules(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(module) of packages and single files, as ``linking.external_modules`` wants them."""
    names = {n.removesuffix(".py") for f in folders for n in os.listdir(f) if n.endswith(".py") or os.path.isfile(os.path.join(f, n, "__init__.py"))}
    return spark.createDataFrame([(n,) for n in sorted(names)], "module string")


def requirement_lines(spark: SparkSession, root: str) -> DataFrame:
    """(line) of the project's requirements, of both kinds of files."""
    lines: list[str] = []
    plain, project = os.path.join(root, "requirements.txt"), os.path.join(root, "pyproject.toml")
    if os.path.isfile(plain):
        with open(plain, encoding="utf-8") as f:
            lines += f.read().splitlines()
    if os.path.isfile(project):
        import tomllib

        with open(project, "rb") as f:
            data = tomllib.load(f)
        lines += data.get("project", {}).get("dependencies", [])
        lines += [k for k in data.get("tool", {}).get("poetry", {}).get("dependencies", {}) if k != "python"]
    return spark.createDataFrame([(x,) for x in lines], "line string")


def path_mappings(root: str, folder: str | None = None, seen: frozenset[str] = frozenset()) -> tuple[str, list[tuple[str, str]]]:
    """The base folder and the (pattern, target) pairs of a project's path mappings; what a file extends comes first, and no file twice."""
    folder = folder or root
    path = next((p for p in (os.path.join(folder, n) for n in MAPPING_FILES) if os.path.exists(p)), None)
    if path is None or os.path.realpath(path) in seen:
        return root, []
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except ValueError:
        return root, []
    base, pairs = root, []
    if isinstance(extended := data.get("extends"), str):
        target = os.path.join(folder, extended)
        with_ending = os.path.splitext(target)[0] + ".json"
        there = os.path.dirname(target) if os.path.isfile(target) else target if os.path.isdir(target) else os.path.dirname(with_ending) if os.path.isfile(with_ending) else folder
        base, pairs = path_mappings(root, there, seen | {os.path.realpath(path)})
    options = data.get("compilerOptions") or {}
    if isinstance(options.get("baseUrl"), str):
        base = root if options["baseUrl"] == "." else os.path.join(root, options["baseUrl"])
    for pattern, targets in (options.get("paths") or {}).items():
        pairs += [(pattern, t) for t in targets if isinstance(t, str)] if isinstance(targets, list) else []
    return base, pairs
