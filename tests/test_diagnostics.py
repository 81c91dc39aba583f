"""What choices rest on, against counts by hand over sets; files of patches; word families."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import text
from tallgrass.operators import diagnostics
from tallgrass.sources import diffs

KINDS = ("explicit_path", "exact_symbol", "filename_term", "symbol_term", "source_term", "family_term", "import_neighbor", "related_test")
ROWS = {
    "selected": "query_id string, path string, place int, score double, role string, is_test boolean",
    "candidates": "query_id string, path string, score double",
    "signals": "query_id string, path string, kind string, key string, term string",
    "useful": "query_id string, term string",
    "symbol_files": "name string, n_files int",
    "edges": "source string, target string, kind string",
}


def made(seed):
    rng = random.Random(seed)
    paths = [f"{d}/f{i}.py" for d in ("a", "a/b", "c") for i in range(5)] + ["top.py"]
    rows = {name: [] for name in ROWS}
    rows["symbol_files"] = [("one", 1), ("two", 2), ("many", 9)]
    rows["edges"] = [(rng.choice(paths), rng.choice(paths), rng.choice(("IMPORTS", "TESTS", "CONTAINS"))) for _ in range(14)]
    for q in ("q1", "q2", "q3", "none"):
        rows["useful"] += [(q, t) for t in rng.sample("abcdef", 4)]
        scored = [(q, p, rng.randint(0, 100) / 4) for p in rng.sample(paths, 10)]
        rows["candidates"] += scored
        for place, (_, p, score) in enumerate(sorted(scored, key=lambda r: -r[2])[: 0 if q == "none" else 6]):
            rows["selected"].append((q, p, place, score, rng.choice(("PRIMARY", "RELATED")), rng.random() < 0.3))
        for _, p, _ in scored:
            for kind in rng.sample(KINDS, rng.randint(0, 3)):
                named = kind in ("explicit_path", "exact_symbol")
                key = f"symbol:{rng.choice(('one', 'two', 'many', 'gone'))}" if kind == "exact_symbol" else f"{kind}:x"
                rows["signals"].append((q, p, kind, key, None if named else rng.choice("abcdefgh")))
    return rows


def by_hand(rows, q):
    chosen = [r for r in rows["selected"] if r[0] == q]
    paths, n = [r[1] for r in chosen], len(chosen)
    of = lambda p: [s for s in rows["signals"] if s[:2] == (q, p)]
    files = dict(rows["symbol_files"])
    out = {"n_selected": n, "n_candidates": sum(c[0] == q for c in rows["candidates"])}
    levels = dict.fromkeys(diagnostics.SPECIFICITY, 0)
    direct = weak = expanded = unique = ambiguous = 0
    for _, p, _, _, role, _ in chosen:
        kinds = {s[2] for s in of(p)}
        found = [files.get(s[3][7:], 0) for s in of(p) if s[2] == "exact_symbol"]
        is_direct, near = bool(kinds & set(diagnostics.DIRECT)), bool(kinds & set(diagnostics.GRAPH))
        direct, weak = direct + is_direct, weak + (not is_direct)
        expanded += role == "RELATED" and near and not is_direct
        unique, ambiguous = unique + (1 in found), ambiguous + any(x > 1 for x in found)
        rules = [
            "explicit_path" in kinds or 1 in found, bool(kinds & {"filename_term", "symbol_term"}), any(x > 1 for x in found),
            bool(kinds - set(diagnostics.DIRECT) - set(diagnostics.GRAPH)), near, True,
        ]
        levels[diagnostics.SPECIFICITY[rules.index(True)]] += 1
    out |= {"direct_paths": direct, "weak_only_paths": weak, "graph_expanded": expanded, "unique_symbol_paths": unique, "ambiguous_symbol_paths": ambiguous}
    out |= {k.lower(): v for k, v in levels.items()}
    useful, seen, novel = {t for x, t in rows["useful"] if x == q}, set(), 0
    for p in paths:
        new = {s[4] for s in of(p)} & useful - seen
        novel, seen = novel + bool(new), seen | new
    straight = {s[4] for p in paths for s in of(p) if s[2] in diagnostics.DIRECT} & useful
    out |= {"n_useful": len(useful), "n_supported": len(seen), "n_direct": len(straight), "n_novel_paths": novel, "coverage": len(seen) / len(useful)}
    top, scores = max(c[2] for c in rows["candidates"] if c[0] == q), [r[3] for r in chosen]
    out |= {"top_score": top, "median_score": statistics.median(scores) if n else 0, "within_75_percent": sum(s >= top * 0.75 for s in scores) / n if n else 0}
    folders = [p.rsplit("/", 1)[0] if "/" in p else "." for p in paths]
    out |= {"n_folders": len(set(folders)), "largest_folder_share": max(map(folders.count, folders)) / n if n else 0}
    clusters = [{p} for p in paths]
    for a, b, kind in rows["edges"]:
        if kind != "CONTAINS" and a in paths and b in paths:
            left, right = (next(c for c in clusters if x in c) for x in (a, b))
            if left is not right:
                clusters.remove(right)
                left |= right
    return out | {"n_clusters": len(clusters), "largest_cluster_share": max(map(len, clusters)) / n if n else 0}


@pytest.mark.parametrize("seed", [1, 2])
def test_locator_against_counts_by_hand(spark, seed):
    rows = made(seed)
    tables = {n: spark.createDataFrame(r, ROWS[n]) for n, r in rows.items()}
    got = {r.query_id: r.asDict() for r in diagnostics.locator(**tables).collect()}
    assert set(got) == {"q1", "q2", "q3", "none"}
    for q, found in got.items():
        expected = by_hand(rows, q)
        assert {k: found[k] for k in expected} == pytest.approx(expected), q
        assert None not in found.values()


def test_locator_of_nothing(spark):
    tables = {n: spark.createDataFrame([], s) for n, s in ROWS.items()}
    assert diagnostics.locator(**tables).count() == 0


def test_decisions_by_path(spark):
    rows = [
        ("q", "whole", 5, "DEPTH", None), ("q", "whole", 2, "REQUIRED", None), ("q", "part", 3, "DEPTH", None), ("q", "part", 4, None, "depth_limit"),
        ("q", "half", 3, "DEPTH", None), ("q", "half", 4, None, "context_budget"), ("q", "half", 4, None, "depth_limit"),
        ("q", "deep", 1, None, "depth_limit"), ("q", "short", 1, None, "context_budget"), ("q", "short", 1, None, "depth_limit"),
        ("q", "out", 9, None, "outside_task_cluster"),
    ]
    found = diagnostics.path_decisions(spark.createDataFrame(rows, "query_id string, path string, cost long, phase string, reason string"))
    assert {r.path: (r.cost, r.taken_cost, r.n_taken, r.omission) for r in found.collect()} == {
        "whole": (7, 7, 2, None), "part": (7, 3, 1, "partial_depth_limit"), "half": (11, 3, 1, "partial_context_budget"),
        "deep": (1, 0, 0, "depth_limit"), "short": (2, 0, 0, "context_budget"), "out": (9, 0, 0, "outside_task_cluster"),
    }


PATCH = """diff --git a/a.py b/a.py
index 1..2 100644
--- a/a.py
+++ b/a.py
@@ -1,2 +1,3 @@
 same
-rename from nothing
+Binary files a and b differ
+more
@@ -9 +10 @@
--- old
+++ new
diff --git a/old name.py b/new name.py
similarity index 100%
rename from old name.py
rename to new name.py
diff --git a/x.png b/x.png
new file mode 100644
Binary files /dev/null and b/x.png differ
diff --git a/gone b/gone
deleted file mode 100644
--- a/gone
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/c b/d
copy from c
copy to d
"""


def test_files_of_patches(spark):
    rows = spark.createDataFrame([("k", PATCH), ("empty", ""), ("null", None), ("noise", "no diff\n+x")], "k string, text string")
    got = {r.path: tuple(r)[2:] for r in diffs.diff_files(rows, "k").collect()}
    assert got == {
        "a.py": (None, False, "modified", 2, 3, 2), "new name.py": ("old name.py", False, "renamed", 0, 0, 0), "x.png": (None, True, "added", 0, 0, 0),
        "gone": (None, False, "deleted", 1, 0, 1), "d": ("c", False, "copied", 0, 0, 0),
    }


def test_families_by_their_beginning(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("ab", k=rng.randint(4, 14))) for _ in range(60)] + ["aaaaaaa", "aaaaaab", "aaaaaaaaaa", "aaaaaaabbb", "é" * 6, "é" * 7]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.is_family("a", "b").alias("same")).where(F.col("same")).collect()

    def same(a, b):
        short, common = min(len(a), len(b)), next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return short >= 6 and a != b and common >= 6 and common >= 0.7 * short

    assert sorted((r.a, r.b) for r in got) == sorted(p for p in pairs if same(*p)) and len(got) > 10
