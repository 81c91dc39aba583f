"""Dependencies that manifests declare, and the technologies of a file tree with their evidence."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Names of manifests, in the order in which they are believed, and what dependencies stand for.
MANIFESTS = ("package.json", "requirements.txt", "pyproject.toml")
PACKAGES = {
    "package.json": {"react": "React", "next": "Next.js", "typescript": "TypeScript"},
    "requirements.txt": {"pytest": "pytest", "flask": "Flask", "fastapi": "FastAPI"},
    "pyproject.toml": {"pytest": "pytest", "flask": "Flask", "fastapi": "FastAPI", "": "Python"},
}
MODULES = {"pytest": "pytest", "flask": "Flask", "fastapi": "FastAPI"}
CONTAINER_FILES = ("dockerfile", "compose.yaml", "compose.yml", "docker-compose.yml", "docker-compose.yaml")

DECLARED = "path string, manifest string, name string, error string"
_ARROW = pa.schema([(c, pa.string()) for c in ("path", "manifest", "name", "error")])
_NAME = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:$|[\[<>=!~;,(@ ])")


def _requirement(line: object) -> str | None:
    """The package that a requirement names, in lower case; options, comments and addresses name none."""
    found = _NAME.match(line) if isinstance(line, str) else None
    return found[1].lower() if found else None


def _lists(table: object) -> list:
    """The members of all lists among a table's values."""
    return [x for group in table.values() if isinstance(group, list) for x in group] if isinstance(table, dict) else []


def _of_pyproject(text: str) -> set[str]:
    """Packages of all dependency lists, tools that are set up by name, and an empty name for the project itself."""
    whole = tomllib.loads(text)
    project = whole.get("project") if isinstance(whole.get("project"), dict) else {}
    listed = [*_lists({"main": project.get("dependencies")}), *_lists(project.get("optional-dependencies")), *_lists(whole.get("dependency-groups"))]
    tools = [t for t in whole.get("tool", {}) if t == "pytest"] if isinstance(whole.get("tool"), dict) else []
    return {*filter(None, map(_requirement, listed)), *tools, *([""] if whole.get("build-system") or project else [])}


def _of_requirements(text: str) -> set[str]:
    return set(filter(None, map(_requirement, text.splitlines())))


def _of_package(text: str) -> set[str]:
    whole = json.loads(text)
    groups = [whole.get(k) or {} for k in ("dependencies", "devDependencies")]
    return {name for group in groups for name in group.keys()}


_PARSERS = {"package.json": _of_package, "requirements.txt": _of_requirements, "pyproject.toml": _of_pyproject}


def declared(files: DataFrame) -> DataFrame:
    """Rows (path, manifest, name, error) for files (path, text): each name that a manifest declares, once.

    A manifest that cannot be read gives one row with the error and no name. Files are parsed where they are, one at a
    time; files of other names, and without text, give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                manifest = path.rpartition("/")[2]
                try:
                    names, error = sorted(_PARSERS[manifest](text)), None
                except (ValueError, TypeError, AttributeError, RecursionError) as wrong:
                    names, error = [None], f"{type(wrong).__name__}: {wrong}"
                rows += [{"path": path, "manifest": manifest, "name": name, "error": error} for name in names]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    named = files.where(T.file_name("path").isin(*MANIFESTS) & F.col("text").isNotNull())
    return named.select("path", "text").mapInArrow(run, DECLARED)


def technologies(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Rows (technology, path, sha256): what a tree is made with and the best evidence for it.

    files: (path, text, sha256); imports: (path, module). Manifests at the root come before files, and among them the
    first of MANIFESTS; of equally good files the first path is taken.
    """
    pairs = [(manifest, name, tech) for manifest, names in PACKAGES.items() for name, tech in names.items()]
    meaning = F.create_map(*[F.lit(x) for m, n, t in pairs for x in (f"{m}\x00{n}", t)])
    rank = F.array_position(F.array(*map(F.lit, MANIFESTS)), F.col("manifest")).cast("int")
    root = declared(files.where(~F.contains("path", F.lit("/")))).where("error is null")
    stated = root.select(F.try_element_at(meaning, F.concat_ws("\x00", "manifest", "name")).alias("technology"), "path", rank.alias("rank"))
    last = F.lit(len(MANIFESTS) + 1).alias("rank")
    seen = (
        F.when(T.suffix("path") == ".py", "Python")
        .when(T.suffix("path").isin(".ts", ".tsx"), "TypeScript")
        .when(F.lower(T.file_name("path")).isin(*CONTAINER_FILES), "Docker")
    )
    of_files = files.select(seen.alias("technology"), "path", last)
    modules = F.create_map(*[F.lit(x) for pair in MODULES.items() for x in pair])
    of_imports = imports.select(F.try_element_at(modules, F.substring_index("module", ".", 1)).alias("technology"), "path", last)
    evidence = stated.unionByName(of_files).unionByName(of_imports).where("technology is not null")
    best = evidence.groupBy("technology").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return best.join(files.select("path", "sha256"), "path", "left").select("technology", "path", "sha256")
