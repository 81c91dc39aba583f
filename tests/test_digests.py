"""Canonical JSON, tree digests, manifests and choices that abstain."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import canonical
from tallgrass.operators import choices, trees
from tallgrass.sources import manifests


def test_canonical_json_is_that_of_python(spark):
    schema = "zeta string, a struct<y:int,x:array<string>>, m map<string,array<long>>, b boolean, n string, 'é' int".replace("'é'", "`é`")
    rows = [
        ('q"\\ \n\t\x01\x1f é 漢', (1, ["b", None, "a"]), {"k2": [2, 1], "k1": [], "é": None}, True, None, 5),
        ("", (None, []), {}, False, "x", None),
        (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema).select(F.struct("*").alias("v"))
    got = [r[0] for r in df.select(canonical.canonical_json(F.col("v"), df.schema["v"].dataType)).collect()]
    names = ["zeta", "a", "m", "b", "n", "é"]
    for text, row in zip(got, rows, strict=True):
        value = dict(zip(names, row, strict=True))
        value["a"] = row[1] and {"y": row[1][0], "x": row[1][1]}
        assert text == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def slow_tree(files, wide):
    """Digests by folder, from a dict of path and digest."""
    sha = lambda lines: hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()
    out = {}

    def folder(prefix):
        names = {p[len(prefix) :].split("/")[0] for p in files if p.startswith(prefix)}
        lines = {}
        for name in names:
            whole = prefix + name
            kind, digest = ("file", files[whole]) if whole in files else ("folder", folder(whole + "/"))
            lines[name] = f"{name}\0{kind}\0{digest}"
        if len(lines) > wide:
            parts = {}
            for name, line in lines.items():
                parts.setdefault(hashlib.sha256(name.encode()).hexdigest()[:3], []).append(line)
            found = sha(f"{part}\0part\0{sha(own)}" for part, own in parts.items())
        else:
            found = sha(lines.values())
        out[prefix.rstrip("/")] = found
        return found

    if files:
        folder("")
    return out


@pytest.mark.parametrize("wide", [4096, 3])
def test_tree_digests(spark, wide):
    files = {f"src/{a}/f{i}.py": f"{a}{i}" for a in "abc" for i in range(5)} | {"top.md": "t", "deep/er/and/deeper/x": "y", "é/ü": "z"}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, sha256 string")
    first = trees.tree_digests(frame(files).repartition(5), wide)
    got = {r.path: r.digest for r in first.collect() if r.kind == "folder"}
    assert got == slow_tree(files, wide)
    assert {r.path: r.n_files for r in first.collect() if r.kind == "folder"}[""] == len(files)
    changed = trees.tree_digests(frame(files | {"src/b/f3.py": "other"}).coalesce(1), wide)
    assert sorted(r.path for r in trees.changed_paths(first, changed).collect()) == ["", "src", "src/b", "src/b/f3.py"]
    assert trees.tree_digests(frame(files).where("false"), wide).count() == 0


def test_manifests_and_technologies(spark):
    toml = '[build-system]\nrequires=["x"]\n[project]\ndependencies=["Flask[async]>=2", "pytest-cov", 3]\n[project.optional-dependencies]\ndev=["FastAPI ; x"]\nodd="no list"'
    texts = {
        "pyproject.toml": toml, "requirements.txt": "# c\n-r other\nflask==1\nhttps://x/y\n pytest >= 7\npytest-xdist", "package.json": '{"dependencies": {"next": "1"}, "devDependencies": null}',
        "sub/package.json": '{"dependencies": {"react": "1"}}', "b.py": "", "a/z.py": "", "web/x.ts": "", "web/a.tsx": "", "ops/Dockerfile": "", "compose.yml": "",
    }
    frame = lambda d: spark.createDataFrame([(p, t, f"h:{p}") for p, t in d.items()], "path string, text string, sha256 string")
    imports = spark.createDataFrame([("b.py", "pytest.mark"), ("a/z.py", "fastapi"), ("b.py", "flasks")], "path string, module string")
    names = {}
    for r in manifests.declared(frame(texts)).collect():
        names.setdefault(r.path, set()).add(r.name)
    assert names == {
        "pyproject.toml": {"flask", "pytest-cov", "fastapi", ""}, "requirements.txt": {"flask", "pytest", "pytest-xdist"},
        "package.json": {"next"}, "sub/package.json": {"react"},
    }
    found = {r.technology: (r.path, r.sha256) for r in manifests.technologies(frame(texts), imports).collect()}
    assert found == {t: (p, f"h:{p}") for t, p in {
        "Python": "pyproject.toml", "Flask": "requirements.txt", "FastAPI": "pyproject.toml", "pytest": "requirements.txt",
        "Next.js": "package.json", "TypeScript": "web/a.tsx", "Docker": "compose.yml",
    }.items()}
    broken = {"pyproject.toml": "[x\n", "package.json": "[1]", "requirements.txt": "", "b.py": "", "a/z.py": ""}
    errors = [r.path for r in manifests.declared(frame(broken)).collect() if r.error]
    assert sorted(errors) == ["package.json", "pyproject.toml"]
    found = {r.technology: r.path for r in manifests.technologies(frame(broken), imports).collect()}
    assert found == {"Python": "a/z.py", "pytest": "b.py", "FastAPI": "a/z.py"}
    assert manifests.technologies(frame(broken).where("false"), imports.where("false")).count() == 0


def test_unique_best_abstains(spark):
    rows = [("a", "x", 2), ("a", "y", 1), ("b", "x", 2), ("b", "y", 2), ("c", "x", 3), ("c", "x", 3), ("d", None, 9), ("d", "z", None), (None, "x", 1), ("e", "x", 1), ("e", None, 5)]
    got = choices.unique_best(spark.createDataFrame(rows, "k string, v string, w int"), ["k"], "v", "w").collect()
    assert {r.k: (r.v, r.w) for r in got} == {"a": ("x", 2), "b": (None, 2), "c": ("x", 3), "d": (None, None), None: ("x", 1), "e": ("x", 1)}


def test_names_resolve_if_only_one_symbol_fits(spark):
    symbols = [("p.py", "A.run"), ("q.py", "B.run"), ("q.py", "B"), ("r.py", "pkg.C.stop"), ("s.py", "run"), ("t.py", "D"), ("u.py", "D")]
    cited = [(i, n) for i, n in enumerate(["A.run", "run", "C.stop", "stop", "op", "D", None, "nothing"])]
    found = choices.resolved_names(spark.createDataFrame(cited, "id int, name string"), spark.createDataFrame(symbols, "path string, qualified_name string"))
    assert {r.id: (r.path, r.candidates) for r in found.collect()} == {
        0: ("p.py", 1), 1: ("s.py", 1), 2: ("r.py", 1), 3: ("r.py", 1), 4: (None, 0), 5: (None, 2), 6: (None, 0), 7: (None, 0),
    }
