"""Operators against brute force and small literal cases."""

import json
import random

import pytest

from tallgrass.functions import numbers, text
from tallgrass.operators import compaction, graph, intervals, relevance, snapshots, stats, telemetry, windows
from tallgrass.sources import events, files


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, column, **inputs):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in inputs.items())
    return spark.createDataFrame([tuple(inputs.values())], names).select(column).first()[0]


def test_terms_identifiers_and_paths(spark):
    got = one(spark, text.terms("t"), t="Where is parseHTTPHeader handled in the user_auth file? v2 x")
    assert sorted(got) == ["auth", "header", "http", "parse", "user", "v2"]
    assert sorted(one(spark, text.identifiers("t"), t="call app.auth.check the Widget and _x1")) == ["Widget", "_x1", "app.auth.check", "call"]
    assert one(spark, text.normalised_path("t"), t="./.github\\x.yml") == "github/x.yml"
    tests = ["tests/a.py", "a/test_b.py", "b_test.py", "c.spec.ts", "x/__tests__/y.js"]
    assert all(one(spark, text.is_test_path("t"), t=p) for p in tests) and not one(spark, text.is_test_path("t"), t="src/contest.py")
    assert [one(spark, text.language("t"), t=p) for p in ("a.py", "b/c.TSX", "noext", ".py")] == ["Python", "TSX", "Other", "Other"]


@pytest.mark.parametrize("raw", ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "x\x0by\x0cz\x85w ", "\n"])
def test_split_lines_as_python_does(spark, raw):
    assert one(spark, text.split_lines("t"), t=raw) == raw.splitlines()


def test_redaction_finds_four_kinds_and_spares_code(spark):
    secret = 'PASSWORD="hunter2 x"\nAuthorization: Bearer abcdefgh12345\nhttps://me:pw@host/x\n'
    secret += "-----BEGIN RSA PRIVATE KEY-----\nabc\ndef\n-----END RSA PRIVATE KEY-----\nPASSWORD=abc"
    clean = one(spark, text.redacted("t"), t=secret)
    assert not any(s in clean for s in ("hunter2", "abcdefgh12345", "me:pw", "def\n", "=abc"))
    assert clean.count("\n") == secret.count("\n")
    assert one(spark, text.secret_categories("t"), t=secret) == ["assigned secret", "bearer token", "credential URL", "private key"]
    plain = "tokens = count(words)\nsecretary: present\nhttps://host/path@rev"
    assert one(spark, text.redacted("t"), t=plain) == plain


def test_every_private_key_is_redacted(spark):
    key = lambda kind, body: f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"
    raw = f"one\n{key('RSA ', 'first+/=')}\ntwo {key('', 'second')} {key('EC ', 'third')} {key('', 'second')}\nrest"
    clean = one(spark, text.redacted("t"), t=raw)
    assert not any(s in clean for s in ("first", "second", "third", "PRIVATE KEY")) and clean.count(text.REDACTED) == 4
    assert clean.split("\n")[0] == "one" and clean.split("\n")[-1] == "rest" and clean.count("\n") == raw.count("\n")


@pytest.mark.parametrize("secret, hidden", [
    ("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\nqwe\n-----END RSA PRIVATE KEY-----\nafter", "DEK-Info 0A1B qwe"),
    ("-----BEGIN PRIVATE KEY-----\ncut off\nhere", "cut here"),
    ("-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x\n-----END PGP PRIVATE KEY BLOCK-----", "Version"),
    ("db_password = hunter2abc\nx", "hunter2abc"),
    ("AWS_SECRET_ACCESS_KEY=abcDEF", "abcDEF"),
    ("PASSWORD: 12345678", "12345678"),
    ('{"api_key": "s3 cr et"}', "s3 cr"),
    ("GITHUB_TOKEN='a b'", "a b"),
    ("authorization: BEARER abcdefgh.12345", "abcdefgh"),
    ("redis://:hunter2@host/0", "hunter2"),
])
def test_forms_of_secrets(spark, secret, hidden):
    clean = one(spark, text.redacted("t"), t=secret)
    assert text.REDACTED in clean and not any(h in clean for h in hidden.split())
    assert clean.count("\n") == secret.count("\n") and ("after" in clean) == ("after" in secret)


def test_what_is_no_secret_stays(spark):
    plain = "token_count = 3\npassword_hash = hash_password(value)\ntoken = 3\nsecrets.choice(x)\npasswords: \nbearer of news\nPRIVATE KEY"
    assert one(spark, text.redacted("t"), t=plain) == plain
    assert one(spark, text.secret_categories("t"), t=plain) == []


def test_family_and_prefix(spark):
    assert one(spark, text.common_prefix_length("a", "b"), a="authenticate", b="authentication") == 11
    assert one(spark, text.is_family("a", "b"), a="authenticate", b="authentication")
    assert one(spark, text.is_family("a", "b"), a="author", b="authorise")
    assert not one(spark, text.is_family("a", "b"), a="author", b="author")
    assert not one(spark, text.is_family("a", "b"), a="authority", b="authentic")
    assert not one(spark, text.is_family("a", "b"), a="conversationalist", b="convergencetheory")
    assert not one(spark, text.is_family("a", "b"), a="short", b="shorter")


def test_numbers(spark):
    assert one(spark, numbers.blocks("a", 16), a=17) == 2 and one(spark, numbers.blocks("a", 16), a=0) == 0
    assert one(spark, numbers.whole_blocks("a", 16), a=20) == 16
    assert one(spark, numbers.safe_ratio("a", "b"), a=1, b=0) == 0.0
    assert one(spark, numbers.percent_change("a", "b"), a=0, b=5) is None
    assert [one(spark, numbers.json_count("j", "$.k"), j=json.dumps({"k": k})) for k in (3, True, -1, 1.5, "x")] == [3, None, None, None, None]
    assert one(spark, numbers.batch_cost("p", "d", "m", "c"), p=4, d=0, m=1, c=0) == pytest.approx(1.32)


def covered_lines(ranges):
    return {line for a, b in ranges for line in range(a, b + 1)}


@pytest.mark.parametrize("seed", range(3))
def test_intervals_against_sets_of_lines(spark, seed):
    pick = random.Random(seed)
    rows = [(k, a, a + pick.randint(0, 6)) for k in range(4) for a in (pick.randint(1, 60) for _ in range(8))]
    ranges = spark.createDataFrame(rows, "key long, start long, end long")
    bounds = spark.createDataFrame([(k, 5, 50) for k in range(5)], "key long, first long, last long")
    merged = intervals.merge(ranges, ["key"])
    gaps = intervals.complement(merged, bounds, ["key"])
    for k in range(5):
        lines = covered_lines([(a, b) for key, a, b in rows if key == k])
        got = [(r.start, r.end) for r in merged.where(f"key = {k}").orderBy("start").collect()]
        assert covered_lines(got) == lines and all(b + 1 < c for (_, b), (c, _) in zip(got, got[1:], strict=False))
        free = [(r.gap_start, r.gap_end) for r in gaps.where(f"key = {k}").collect()]
        assert covered_lines(free) == set(range(5, 51)) - lines
        status = intervals.covered(merged, bounds, ["key"]).where(f"key = {k}").first()
        assert status.n_covered == len(lines & set(range(5, 51)))
    left = ranges.toDF("key", "l_start", "l_end")
    right = ranges.toDF("key", "r_start", "r_end")
    for size in (1, 4, 100):
        pairs = intervals.overlap_join(left, right, ["key"], size).count()
        assert pairs == sum(k == j and a <= d and b >= c for k, a, b in rows for j, c, d in rows)


def test_merge_with_gap_and_promotion(spark):
    df = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 5, 6), ("f", 20, 22)], "key string, start long, end long")
    merged = intervals.merge(df, ["key"], gap=2)
    assert values(merged, "start", "end") == [(1, 6), (20, 22)]
    lengths = spark.createDataFrame([("f", 12)], "key string, length long")
    assert values(intervals.promoted(merged, lengths, ["key"]), "start", "end", "kind") == [(1, 12, "full_file")]


def test_innermost_breaks_ties_by_name_then_start(spark):
    rows = [(1, "b", 5, 9), (1, "a", 7, 11), (1, "a", 6, 10), (1, "a", 8, 12), (2, None, 0, 1), (2, "z", 3, 4)]
    rows += [(3, "n", start, start + 5) for start in range(40, 0, -1)]
    df = spark.createDataFrame(rows, "key long, name string, start long, end long").repartition(3)
    assert values(intervals.innermost(df, ["key"], "start", "end", "name"), "key", "name", "start") == [(1, "a", 6), (2, "z", 3), (3, "n", 1)]


def test_first_fit_skips_and_goes_on(spark):
    rows = [(1, i, c) for i, c in enumerate([5, 4, 3, 2])] + [(2, 0, 9), (2, 1, None), (2, 2, 8)]
    df = spark.createDataFrame(rows, "key long, n long, cost long")
    found = windows.first_fit(df, ["key"], "cost", ["n"], 8)
    assert values(found, "key", "n", "taken") == [(1, 0, True), (1, 1, False), (1, 2, True), (1, 3, False), (2, 0, False), (2, 1, False), (2, 2, True)]


def test_sequences(spark):
    rows = [(1, i, v) for i, v in enumerate("aabcca")] + [(2, 0, None), (2, 1, None), (2, 2, "a")]
    df = spark.createDataFrame(rows, "k long, n long, v string")
    assert [(r.v, r.length) for r in windows.runs(df, ["k"], "v", ["n"]).orderBy("k", "run").collect()] == [
        ("a", 2), ("b", 1), ("c", 2), ("a", 1), (None, 2), ("a", 1),
    ]
    seen = windows.ledger(df.where("k = 1"), ["k"], "v", ["n"])
    assert values(seen, "n", "seen_before", "known_before", "known_after") == [
        (0, False, 0, 1), (1, True, 1, 1), (2, False, 1, 2), (3, False, 2, 3), (4, True, 3, 3), (5, True, 3, 3),
    ]
    turns = windows.round_robin(df.where("k = 1"), ["v"], ["k"], ["n"], 4)
    assert values(turns, "place", "v") == [(1, "a"), (2, "b"), (3, "c"), (4, "a")]


def test_quantiles_and_positions(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 7.0), ("c", None)], "k string, v double")
    found = stats.percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    assert {r.k: (r.p50, r.p95) for r in found.collect()} == {"a": (5.0, 9.5), "b": (7.0, 7.0), "c": (None, None)}
    cases = spark.createDataFrame([("base", 4.0, 0.0), ("new", 5.0, None)], "c string, x double, y double")
    assert [tuple(r) for r in stats.compare(cases, "c", "base", ["x", "y"]).collect()] == [("new", "x", 4.0, 5.0, 1.0, 25.0)]


def test_collapse_keeps_tracebacks_whole(spark):
    trace = ["Traceback (most recent call last):", "  frame", "  frame", "ValueError: x"]
    log = ["same", "same", "same", *trace, "after", "after"]
    lines = compaction.lines_of(spark.createDataFrame([(1, "\n".join(log))], "key long, text string"), "key")
    found = [r.line for r in compaction.collapsed(lines, "key").orderBy("run").collect()]
    assert found == ["same [repeated 3x]", *trace, "after [repeated 2x]"]


def test_budget_keeps_severe_lines_and_both_ends(spark):
    log = [f"line {i} " + "x" * 30 for i in range(30)] + ["ERROR broken"] + [f"tail {i}" for i in range(5)]
    lines = compaction.lines_of(spark.createDataFrame([(1, "\n".join(log))], "key long, text string"), "key")
    kept = [n for n, s in values(compaction.within_budget(lines, "key", 60), "line_no", "stays") if s]
    assert 31 in kept and 1 in kept and 36 in kept and len(kept) < 36


def test_compaction_of_tests_and_status(spark):
    log = "t.py::a PASSED\n...F..\nreal line\nt.py::b PASSED"
    lines = compaction.lines_of(spark.createDataFrame([(1, log)], "key long, text string"), "key")
    assert values(compaction.passing_condensed(lines, "key"), "n_passed", "n_progress", "n_kept") == [(2, 1, 1)]
    status = " M a.py\n?? b.py\nR  c.py -> d.py\n D e.py\nA  f.py\nOn branch main"
    lines = compaction.lines_of(spark.createDataFrame([(1, status)], "key long, text string"), "key")
    assert values(compaction.status_groups(lines, "key"), "kind", "paths") == [
        ("Added", ["f.py"]), ("Deleted", ["e.py"]), ("Modified", ["a.py"]), ("Renamed", ["c.py -> d.py"]), ("Untracked", ["b.py"]),
    ]


SOURCES = {
    "app/__init__.py": "",
    "app/auth.py": "from app.database import connect\nimport os.path\nLIMIT = 3\nclass AuthService:\n    @property\n    def name(self):\n        return connect()\n    async def check_password(self, value):\n        pass\n",
    "app/database.py": "def connect():\n    return 1\n",
    "app/service.py": "from app.auth import AuthService\nfrom . import database\n",
    "app/unrelated.py": "def paint():\n    return 'blue'\n",
    "tests/test_auth.py": "from app.auth import AuthService\ndef test_check():\n    AuthService()\n",
    "broken.py": "def (",
    "notes.md": "# auth\n",
    "image.png": "\x89PNG",
    "node_modules/x.js": "var a",
}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, source in SOURCES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(source)
    return files.scan(spark, str(root)).cache()


def test_scan_classifies_files(scanned):
    found = {r.path: r for r in scanned.collect()}
    assert set(found) == set(SOURCES) - {"node_modules/x.js", "app/__init__.py"}
    assert found["image.png"].kind == "binary" and found["app/auth.py"].language == "Python" and found["tests/test_auth.py"].is_test
    assert {p: r.line_count for p, r in found.items() if r.kind == "text"} == {p: len(SOURCES[p].splitlines()) for p in found if p != "image.png"}


def test_symbols_in_every_block():
    source = """
LIMIT, low = 1, 2
SIZE: int = 3
class A:
    INNER = 1
    @property
    def name(self):
        def helper(): pass
for i in x:
    def in_for(): pass
else:
    import in_else
while x:
    class InWhile:
        async def run(self): pass
match x:
    case 1:
        def in_case(): pass
async def outer():
    async with a:
        from b import c
    async for y in z:
        def in_async_for(): pass
try:
    import one
except E:
    import two
else:
    import three
finally:
    import four
with a:
    WITHIN = 1
"""
    found, imported, error = files._symbols("p", source)
    assert error is None
    kinds = {s[2]: s[3] for s in found}
    assert kinds == {
        "LIMIT": "constant", "SIZE": "constant", "WITHIN": "constant", "A": "class", "A.name": "method", "A.name.helper": "function",
        "in_for": "function", "InWhile": "class", "InWhile.run": "method", "in_case": "function", "outer": "function",
        "outer.in_async_for": "function",
    }
    assert [(i[1], i[2]) for i in imported] == [("in_else", None), ("b", "c"), ("one", None), ("two", None), ("three", None), ("four", None)]
    assert [s[6] for s in found if s[2] == "A.name.helper"] == ["A.name"]
    assert files._symbols("p", "def broken(:")[2] and files._symbols("p", "x\0")[2]


def test_symbols_imports_and_edges(spark, scanned):
    found = values(files.symbols(scanned).where("path = 'app/auth.py'"), "qualified_name", "kind", "start_line", "end_line", "is_async")
    assert found == [
        ("AuthService", "class", 4, 9, False), ("AuthService.check_password", "method", 8, 9, True),
        ("AuthService.name", "method", 6, 7, False), ("LIMIT", "constant", 3, 3, False),
    ]
    from pyspark.sql import functions as F

    records = files.imports(scanned).select(F.col("path").alias("source"), "module", "name")
    edges = graph.resolve_imports(records, files.module_names(scanned))
    assert values(edges, "source", "target") == [
        ("app/auth.py", "app/database.py"), ("app/service.py", "app/auth.py"), ("tests/test_auth.py", "app/auth.py"),
    ]
    assert values(graph.test_edges(edges, scanned), "source", "target") == [("tests/test_auth.py", "app/auth.py")]
    assert values(graph.in_degrees(edges), "node", "in_degree") == [("app/auth.py", 2), ("app/database.py", 1)]
    assert dict(values(graph.importance(edges, files.symbols(scanned)), "path", "score"))["app/auth.py"] == 3 * 2 + 2 + 3


def test_full_ranking_explains_itself(spark, scanned):
    from pyspark.sql import functions as F

    texts = scanned.where("kind = 'text'")
    records = files.imports(texts)
    edges = graph.resolve_imports(records.select(F.col("path").alias("source"), "module", "name"), files.module_names(texts))
    tests = graph.test_edges(edges, texts)
    both = edges.withColumn("kind", F.lit("IMPORTS")).union(tests.withColumn("kind", F.lit("TESTS")))
    query = [("q", "Where does AuthService validate auth passwords?", "", [], [], ["app/service.py"])]
    queries = spark.createDataFrame(query, "query_id string, task string, error_text string, paths array<string>, symbols array<string>, changed array<string>")
    ranked = relevance.rank(queries, texts, files.symbols(texts), records, both).orderBy("rank").collect()
    by_path = {r.path: r for r in ranked}
    assert ranked[0].path == "app/auth.py" and ranked[0].role == "PRIMARY"
    assert {s.kind for s in by_path["app/auth.py"].signals} >= {"filename_term", "exact_symbol", "family_term"} - {"family_term"}
    assert "import_neighbor" in {s.kind for s in by_path["app/database.py"].signals} and by_path["app/database.py"].role == "RELATED"
    assert "changed_relevant" in {s.kind for s in by_path["app/service.py"].signals}
    assert "app/unrelated.py" not in by_path
    assert all(r.score == sum(s.weight for s in r.signals) for r in ranked)


def test_ignore_rules_last_match_wins(spark):
    df = spark.createDataFrame([("logs/a.txt",), ("src/keep.log",), ("src/x.log",), ("build/out/y",)], "path string")
    rules = ["# note", "*.log", "!keep.log", "logs/", "/build/"]
    assert values(df.select("path", files.ignored("path", rules).alias("out")), "path", "out") == [
        ("build/out/y", True), ("logs/a.txt", True), ("src/keep.log", False), ("src/x.log", True),
    ]


def test_components_and_shares(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (60, 60)], "source long, target long")
    labels = graph.components(df)
    assert {r.node: r.component for r in labels.collect()} == {**dict.fromkeys(range(21), 0), 50: 50, 51: 50, 60: 60}
    assert values(graph.cluster_shares(labels), "size", "share") == [(1, 1 / 24), (2, 2 / 24), (21, 21 / 24)]


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, sha256 string")
    assert values(snapshots.changes(old, new, "path", "sha256"), "path", "status") == [
        ("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "created"),
    ]
    assert values(snapshots.stale(old, new, "path", "sha256"), "path", "reason") == [("b", "FILE_CHANGED"), ("c", "FILE_REMOVED")]


def test_event_logs_fold(spark, tmp_path):
    lines = [
        {"type": "thread.started", "thread_id": "t"},
        {"type": "item.completed", "item": {"type": "command_execution", "command": "cat app/state.py"}},
        {"type": "item.completed", "item": {"type": "command_execution", "command": "rg -n x app"}},
        {"type": "item.started", "item": {"type": "command_execution", "command": "git status"}},
        {"type": "item.completed", "item": {"type": "command_execution", "command": "git status"}},
        {"type": "item.completed", "item": {"type": "mcp_tool_call", "tool": "x"}},
        {"type": "item.completed", "item": {"type": "agent_message", "text": "first"}},
        {"type": "turn.completed", "usage": {"input_tokens": 1, "output_tokens": True}},
        {"type": "item.completed", "item": {"type": "agent_message", "text": "last PASSWORD=abc"}},
        {"type": "turn.completed", "usage": {"input_tokens": 1000, "cached_input_tokens": 200, "output_tokens": 300}},
    ]
    body = "\n".join(map(json.dumps, lines)) + "\nnot json\n[1]\n\n"
    (tmp_path / "run1.jsonl").write_text(body)
    run = telemetry.fold_runs(events.run_lines(spark, str(tmp_path))).first()
    assert (run.run_id, run.n_events, run.n_malformed) == ("run1", 10, 2)
    assert (run.n_read, run.n_search, run.n_git, run.n_listing, run.n_tool_calls) == (1, 1, 1, 0, 1)
    assert (run.input, run.cached_input, run.output, run.total) == (1000, 200, 300, None)
    assert run.final_message == f"last {text.REDACTED}"


def test_delivery_overlap_is_all_or_nothing(spark):
    schema = "run string, call long, path string, content_hash string, start long, end long, line_bytes array<long>"
    rows = [("a", 1, "p", "h", 1, 3, [10, 20, 30]), ("a", 2, "p", "h", 2, 4, [20, 30, 40]), ("a", 3, "p", "other", 1, 1, [5])]
    rows += [("b", 1, "p", "h", 1, 2, [1])]
    found = telemetry.delivery_overlap(spark.createDataFrame(rows, schema), ["run"])
    assert {r.run: (r.available, r.unique_bytes, r.repeated_bytes, r.overlap_ratio) for r in found.collect()} == {
        "a": (True, 105, 50, 50 / 155), "b": (False, 0, 0, None),
    }


def test_verdicts_and_areas(spark):
    schema = "valid boolean, base_correct boolean, correct boolean, base_reads int, reads int, base_searches int, searches int"
    rows = [(False, True, True, 1, 1, 1, 1), (True, True, False, 1, 1, 1, 1), (True, False, False, 1, 1, 1, 1), (True, True, True, 2, 1, 1, 5), (True, True, True, 1, 1, 1, 1)]
    found = [r[0] for r in spark.createDataFrame(rows, schema).select(telemetry.pair_verdict()).collect()]
    assert found == ["INVALID_INFRASTRUCTURE", "CORRECTNESS_REGRESSION", "TASK_FAILURE", "CORRECT_WITH_LESS_NATIVE_EXPLORATION", "CORRECT_NO_MEASURED_EXPLORATION_REDUCTION"]
    refs = [("t", "x", 1, True), ("t", "x", 1, False), ("t", "x", 2, True), ("t", "y", 1, True), ("t", "y", 1, False), ("t", "z", 1, False)]
    areas = telemetry.area_coverage(spark.createDataFrame(refs, "task string, area string, option long, satisfied boolean"))
    assert values(areas, "area", "full", "partial") == [("x", True, False), ("y", False, True), ("z", False, False)]


def test_status_and_diff_sources(spark):
    from tallgrass.sources import diffs

    raw = " M a.py\0R  new.py\0old.py\0?? b.py\0R  n2.py\0RX odd.py\0 D c.py\0"
    found = values(diffs.status_entries(spark.createDataFrame([(1, raw)], "key long, text string"), "key"), "path", "status")
    assert found == [("a.py", "modified"), ("b.py", "untracked"), ("c.py", "deleted"), ("n2.py", "renamed"), ("new.py", "renamed")]
    patch = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -3,2 +3,3 @@ def f\n-old\n+new\n+more\n same\n@@ -20 +21 @@\n-z\n+y\ndiff --git a/q b/q\n--- a/q\n+++ b/q\n@@ -0,0 +1 @@\n+only"
    lines = diffs.diff_lines(spark.createDataFrame([(1, patch)], "key long, text string"), "key")
    got = [tuple(r) for r in lines.select("path", "kind", "old_line", "new_line", "line").orderBy("path", "hunk", "old_line", "new_line").collect()]
    assert sorted(got, key=str) == sorted(
        [("x.py", "-", 3, None, "old"), ("x.py", "+", None, 3, "new"), ("x.py", "+", None, 4, "more"), ("x.py", "-", 20, None, "z"),
         ("x.py", "+", None, 21, "y"), ("q", "+", None, 1, "only")], key=str,
    )
    symbols = spark.createDataFrame([("x.py", "f", 1, 30), ("x.py", "f.g", 3, 4)], "path string, qualified_name string, start_line int, end_line int")
    assert values(diffs.affected_symbols(lines, symbols), "new_line", "qualified_name") == [(3, "f.g"), (4, "f.g"), (21, "f")]


def test_pack_takes_required_ranges_and_fits_the_budget(spark):
    from tallgrass.operators import packing

    body = "\n".join(f"line {i} of the file" for i in range(1, 201))
    texts = spark.createDataFrame([("a.py", body, 200), ("b.py", body, 200), ("c.py", body, 200)], "path string, text string, line_count int")
    symbols = spark.createDataFrame([("a.py", "f", 10, 12), ("a.py", "g", 15, 18), ("b.py", "h", 50, 180)], "path string, qualified_name string, start_line int, end_line int")
    signal = "array<struct<kind:string,key:string>>"
    rows = [
        ("q", "a.py", 95.0, "PRIMARY", [("exact_symbol", "symbol:f"), ("exact_symbol", "symbol:g")]),
        ("q", "b.py", 80.0, "PRIMARY", [("exact_symbol", "symbol:h")]),
        ("q", "c.py", 10.0, "RELATED", [("explicit_path", "path:c.py")]),
    ]
    ranked = spark.createDataFrame(rows, f"query_id string, path string, score double, role string, signals {signal}")
    packed = packing.pack(ranked, symbols, texts, budget=400).cache()
    assert values(packed, "path", "start", "end", "taken") == [("a.py", 9, 19, True), ("b.py", 49, 181, False), ("c.py", 1, 40, True)]
    located = packing.locator(packed)
    assert located.first().locator == "- c.py:1-40\n- a.py:9-19"
    assert values(packing.parsed_locator(located), "path", "start", "end") == [("a.py", 9, 19), ("c.py", 1, 40)]
    metrics = packing.pack_metrics(packed).first()
    assert metrics.n_ranges == 2 and metrics.selected_tokens <= 400 and metrics.tokens_avoided > 0
    required = spark.createDataFrame([("q", "a.py", 10, 12), ("q", "b.py", 60, 61)], "query_id string, path string, start long, end long")
    assert packing.recall(packed, required).first()[1:] == (0.5, 0.5)


def test_rates_tools_and_importance(spark):
    assert one(spark, numbers.per_second("a", "b"), a=30, b=2000) == 15.0
    assert [one(spark, telemetry.tool_kind("t"), t=t) for t in ("Read", "MultiEdit", "Glob", "Bash", "Else")] == ["read", "edit", "listing", "bash", "other"]
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b")], "source string, target string")
    rows = [("a", "K", "class"), ("a", "_h", "function"), *[("b", f"f{i}", "function") for i in range(5)]]
    scores = graph.importance(edges, spark.createDataFrame(rows, "path string, name string, kind string"))
    assert values(scores, "path", "score") == [("a", 3 * 2 + 2 + 1), ("b", 3 + 3)]


def test_sinks_write_what_is_read_back(spark, tmp_path):
    from tallgrass import sinks

    df = spark.createDataFrame([(1, "x", [1, 2]), (2, None, None)], "k long, t string, a array<long>")
    sinks.write_json(df, str(tmp_path / "json"))
    assert values(spark.read.schema(df.schema).json(str(tmp_path / "json")), "k", "t", "a") == [(1, "x", [1, 2]), (2, None, None)]
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {"k": 2, "t": None, "a": None} in lines
    sinks.write_json(df, str(tmp_path / "parts"), ["k"])
    assert sorted(p.name for p in (tmp_path / "parts").glob("k=*")) == ["k=1", "k=2"]
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "csv")).select("k", "a").collect()) == [("1", "[1,2]"), ("2", None)]
    for _ in range(2):
        sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(df, str(tmp_path / "once"))


def test_second_run_log_folds(spark):
    usage = lambda i, o: {"input_tokens": i, "output_tokens": o}
    call = lambda name, **given: {"type": "tool_use", "name": name, "input": given}
    said = lambda blocks, **more: {"type": "assistant", "message": {"model": "m1", "content": blocks, **more}}
    runs = {
        "done": [
            {"type": "system", "session_id": "s1"},
            said([{"type": "text", "text": "hm"}, call("Read", file_path="a.py"), call("Read", file_path="a.py")], usage=usage(5, 1)),
            said([call("Grep", pattern="x"), call("Edit", file_path="a.py"), call("Custom"), call("Read", file_path="b.py")]),
            {"type": "result", "subtype": "success", "result": "fine", "duration_ms": 12, "num_turns": 3, "usage": usage(100, 20)},
        ],
        "cut": [said([], usage=usage(5, 1)), said("text", usage={"input_tokens": 7, "output_tokens": -1}), "no json", [1]],
        "bad": [{"type": "result", "subtype": "error_max_turns", "result": None}, {"type": "result", "is_error": True}],
    }
    rows = [(run, n, x if isinstance(x, str) else json.dumps(x)) for run, lines in runs.items() for n, x in enumerate([*lines, ""], 1)]
    lines = spark.createDataFrame(rows, "run_id string, line_no long, value string")
    found = {r.run_id: r for r in telemetry.fold_streams(lines).collect()}
    done, cut = found["done"], found["cut"]
    assert (done.session, done.model, done.status, done.result, done.duration_ms, done.turns) == ("s1", "m1", "success", "fine", 12, 3)
    assert (done.input_tokens, done.output_tokens, done.cache_read_input_tokens) == (100, 20, None)
    assert (done.n_actions, done.n_read, done.n_search, done.n_edit, done.n_rereads) == (6, 3, 1, 1, 1)
    assert (cut.status, cut.n_malformed, cut.input_tokens, cut.output_tokens, cut.n_actions) == ("incomplete", 2, 12, 1, 0)
    assert found["bad"].status == "error"
    assert values(telemetry.malformed(lines), "run_id", "line_no", "problem") == [("cut", 3, "malformed"), ("cut", 4, "not an object")]


def test_searches_and_what_they_cover(spark):
    commands = {
        "rg -n word src/a.py": ("search", True, ["src/a.py"], False),
        "rg word": ("search", False, [], True),
        "grep -n 'two words' src ./tests/": ("search", True, ["src", "./tests/"], False),
        "rg -n -l word .": ("search", False, [], False),
        "rg -n -e word src": ("search", True, [], False),
        "rg --files src": ("file_listing_search", False, [], False),
        "git grep word -- src/a.py": ("search", True, ["src/a.py"], False),
        "git grep -c word": ("search", False, [], True),
        'Select-String -Pattern x -Path "src/a.py"': ("search", True, ["src/a.py"], False),
        "/usr/bin/rg.exe -n word ../up src/*.py": ("search", True, [], False),
        "rg word | head": None,
        "cat src/a.py": None,
        "git log": None,
        "rg 'open": None,
    }
    rows = spark.createDataFrame([("r", c) for c in commands], "run_id string, command string")
    found = telemetry.searches(rows).cache()
    got = {r.command: (r.kind, r.prints, r.targets, r.wide) for r in found.collect()}
    assert got == {c: x for c, x in commands.items() if x}
    paths = spark.createDataFrame([("src/a.py", False), ("src", True), ("tests", True)], "path string, is_folder boolean")
    summary = telemetry.search_summary(found, paths).first()
    assert summary.searched_paths == ["src/", "src/a.py", "tests/"]
    assert (summary.content_search_calls, summary.file_targeted_searches, summary.repository_wide_searches, summary.file_listing_searches) == (6, 3, 2, 1)


def test_named_reads(spark):
    reads = spark.createDataFrame([("r", "a"), ("r", "b")], "run_id string, path string")
    named = spark.createDataFrame([("r", "a"), ("r", "a"), ("q", "b")], "run_id string, path string")
    assert values(telemetry.named_reads(reads, named), "path", "membership") == [("a", telemetry.NAMED), ("b", telemetry.NOT_NAMED)]


KINDS = ("filename_term", "symbol_term", "source_term", "family_term", "exact_symbol", "import_neighbor", "related_test")


def random_ranges(seed):
    pick = random.Random(seed)
    rows = []
    for query in range(3):
        for i in range(pick.randint(6, 14)):
            signals = [(k := pick.choice(KINDS), f"{k}:{(t := pick.choice('stuvwx'))}", float(pick.choice((3, 8, 10, 12, 28))), t) for _ in range(pick.randint(0, 4))]
            start = pick.randint(1, 40)
            rows.append(
                (query, f"d{i % 3}/f{i}.py", start, start + 5, pick.randint(50, 400), pick.random() < 0.1, pick.random() < 0.2,
                 pick.random() < 0.2, pick.random() < 0.85, pick.random() * 150, signals)
            )
    return rows


def taken_simply(rows, budget):
    """The first three phases, range by range: names of what is taken with its phase."""
    frequency = {}
    for r in rows:
        for _, key, _, _ in r[10]:
            frequency[key] = frequency.get(key, 0) + 1
    covered, taken, used = set(), {}, 0

    def fresh(r):
        found = {}
        for kind, key, weight, term in r[10] if r[8] else ():
            name = f"fileterm:{term}:{'test' if r[7] else 'source'}" if kind == "filename_term" else key
            few = frequency[key] <= 3
            worth = {"exact_symbol": 120, "source_term": 9 if few else 3, "family_term": 4 if few else 1}.get(kind, 0)
            if kind in ("filename_term", "symbol_term"):
                worth = weight * (1 + 1 / frequency[key])
            if worth and name not in covered:
                found[name] = found.get(name, 0) + worth
        if r[6] and r[8] and f"anchor:{r[1]}" not in covered:
            found[f"anchor:{r[1]}"] = 35
        return found

    for r in sorted((r for r in rows if r[5]), key=lambda r: (-r[9], r[1], r[2])):
        covered |= set(fresh(r))
        taken[r[1]], used = "REQUIRED", used + r[4]
    while True:
        best = None
        for r in rows:
            gain = sum(fresh(r).values())
            if r[1] not in taken and used + r[4] <= budget and gain > 0:
                rank = (gain * (1 + min(r[9], 120) / 600) / (r[4] + 80) ** 0.65, gain, -r[4], r[1])
                if best is None or rank > best[0]:
                    best = rank, r
        if best is None:
            break
        covered |= set(fresh(best[1]))
        taken[best[1][1]], used = "COVERAGE", used + best[1][4]
    rare = lambda r: any(k == "family_term" and w >= 10 for k, _, w, _ in r[10])
    for r in sorted(rows, key=lambda r: (-r[9] * (2.5 if rare(r) else 1) / (r[4] + 80) ** 0.4, r[1], r[2])):
        if r[1] not in taken and r[8] and used + r[4] <= budget:
            taken[r[1]], used = "DEPTH", used + r[4]
    return taken


def strengths(rows, names):
    best = {}
    for r in rows:
        if r[1] in names:
            for kind, _, weight, term in r[10]:
                value = 3 if kind in ("filename_term", "symbol_term") else 2 if kind == "source_term" and weight >= 10 else 1 if kind == "family_term" and weight >= 8 else 0
                best[term] = max(best.get(term, 0), value)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_allocation_against_a_simple_choice(spark, seed):
    from tallgrass.operators import allocation

    signal = "array<struct<kind:string,key:string,weight:double,term:string>>"
    schema = f"query_id long, path string, start long, end long, cost long, required boolean, anchor boolean, is_test boolean, affinity boolean, score double, signals {signal}"
    rows, budget = random_ranges(seed), 900
    found = allocation.allocate(spark.createDataFrame(rows, schema), budget).collect()
    assert len(found) == len(rows)
    for query in range(3):
        own = [r for r in rows if r[0] == query]
        simple = taken_simply(own, budget)
        got = {r.path: r.phase for r in found if r.query_id == query and r.phase}
        new = [p for p, phase in got.items() if phase == "REPAIR"]
        assert {p: x for p, x in got.items() if p not in new} == {p: x for p, x in simple.items() if p in got}
        gone = set(simple) - set(got)
        assert len(new) <= 1 and (new or not gone) and all(simple[p] == "DEPTH" for p in gone)
        before, after = strengths(own, simple), strengths(own, got)
        assert all(after.get(t, 0) >= s for t, s in before.items())
        cost = {r[1]: r[4] for r in own}
        fixed = sum(cost[p] for p, x in got.items() if x == "REQUIRED")
        assert sum(cost[p] for p in got) <= max(budget, fixed)
        assert all((r.reason is None) == (r.phase is not None) for r in found if r.query_id == query)
    assert allocation.allocate(spark.createDataFrame([], schema), budget).count() == 0
