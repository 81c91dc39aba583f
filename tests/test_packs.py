"""Clusters, packs that fit when printed, and packs that grow, against slow versions."""

import random

import pytest

from tallgrass.operators import affinity, allocation, expansion, packing

SIGNALS = "array<struct<kind:string,key:string,weight:double,term:string>>"
RANKED = f"query_id string, path string, rank int, score double, role string, tests_requested boolean, signals {SIGNALS}"
EDGES = "source string, target string, kind string"


def slow_cluster(ranking, tests, edges, asked, spreads):
    """Anchors and cluster of one ranking of (path, score, role, kinds)."""
    imports = {(s, t) for s, t, k in edges if k == "IMPORTS"}
    covers = {(s, t) for s, t, k in edges if k == "TESTS"}
    names = [r[0] for r in ranking]
    reach = lambda p: {q for q in names if (p, q) in imports or ((q, p) in imports and q not in tests)}
    strong = [r for r in ranking if set(r[3]) & set(affinity.STRONG)]
    sources = [r[0] for r in strong if r[0] not in tests]
    anchors = [r[0] for r in strong if set(r[3]) & set(affinity.NAMED)] or sources[:1]
    if asked:
        anchors += [p for p in [r[0] for r in strong if r[0] in tests][:1] if p not in anchors]
    for p in sources:
        if len(anchors) < 3 and p not in anchors and any((p, a) in imports or (a, p) in imports for a in anchors):
            anchors.append(p)
    anchors = anchors or names[:2]
    cluster = set(anchors)
    for a in anchors:
        cluster |= reach(a)
        near = sorted((-r[1], r[0]) for r in ranking if (r[0], a) in covers)
        cluster |= {near[0][1]} if near else set()
    for p, score, role, _ in ranking:
        if p in cluster and role == "PRIMARY" and score >= spreads and p not in tests:
            cluster |= reach(p)
    return set(anchors), cluster & set(names)


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters_equal_a_walk_in_order_of_rank(spark, seed):
    pick = random.Random(seed)
    rows, edges, tests = [], set(), {f"f{i}" for i in range(40) if i % 6 == 0}
    for _ in range(160):
        a, b = pick.randrange(40), pick.randrange(40)
        edges.add((f"f{a}", f"f{b}", pick.choice(["IMPORTS", "IMPORTS", "TESTS"])))
    edges |= {(f"f{i}", "f7", "IMPORTS") for i in range(40)} | {("outside", "f3", "IMPORTS")}
    rankings = {}
    for q in range(25):
        kinds = ["path_term", "import_term"] if q == 0 else ["path_term", "import_term", "filename_term", "filename_term", "exact_symbol"]
        paths = pick.sample(range(40), pick.randint(1, 15))
        rankings[f"q{q}"] = [
            (f"f{p}", 150.0 - 7 * n, pick.choice(["PRIMARY", "RELATED"]), [pick.choice(kinds if n % 3 else kinds[:3])])
            for n, p in enumerate(paths)
        ]
        for n, (path, score, role, own) in enumerate(rankings[f"q{q}"]):
            rows.append((f"q{q}", path, n + 1, score, role, q % 2 == 0, [(k, "k", 1.0, None) for k in own]))
    files = spark.createDataFrame([(f"f{i}", f"f{i}" in tests) for i in range(39)], "path string, is_test boolean")
    found = affinity.clusters(spark.createDataFrame(rows, RANKED), files, spark.createDataFrame(list(edges), EDGES)).collect()
    assert len(found) == len(rows)
    for q, ranking in rankings.items():
        anchors, cluster = slow_cluster(ranking, tests, edges, int(q[1:]) % 2 == 0, affinity.SPREADS)
        assert {r.path for r in found if r.query_id == q and r.anchor} == anchors, q
        assert {r.path for r in found if r.query_id == q and r.affinity} == cluster, q


def test_a_later_file_does_not_reach_back(spark):
    signal = lambda kind: [(kind, "k", 1.0, None)]
    rows = [("q", p, n + 1, 100.0, "PRIMARY", False, signal(k)) for n, (p, k) in enumerate(
        [("a", "exact_symbol"), ("back", "path_term"), ("b", "path_term"), ("c", "path_term"), ("far", "path_term")]
    )]
    edges = spark.createDataFrame([("a", "c", "IMPORTS"), ("c", "b", "IMPORTS"), ("b", "far", "IMPORTS"), ("c", "back", "IMPORTS")], EDGES)
    files = spark.createDataFrame([], "path string, is_test boolean")
    found = affinity.clusters(spark.createDataFrame(rows, RANKED), files, edges).where("affinity").collect()
    # b and back join through c, but were passed already when c was reached: b no longer brings in far.
    assert sorted(r.path for r in found) == ["a", "b", "back", "c"]
    assert affinity.clusters(spark.createDataFrame([], RANKED), files, edges).count() == 0


FILES = [(f"{name}.py", "\n".join(f"{name} line {i} " + "x" * (i % 17) for i in range(1, n + 1)), n) for name, n in zip("abcdef", (30, 60, 90, 120, 200, 400), strict=True)]
SYMBOLS = [(f"{n}.py", f"{s}", f"{n}.{s}", a, b) for n in "abcdef" for s, a, b in (("one", 5, 9), ("two", 20, 28))]


@pytest.fixture
def tree(spark):
    files = spark.createDataFrame(FILES, "path string, text string, line_count int").selectExpr("*", "sha2(text, 256) as sha256")
    symbols = spark.createDataFrame(SYMBOLS, "path string, name string, qualified_name string, start_line int, end_line int")
    edges = spark.createDataFrame([("a.py", "e.py", "IMPORTS"), ("d.py", "a.py", "TESTS"), ("a.py", "b.py", "IMPORTS"), ("b.py", "c.py", "IMPORTS")], EDGES)
    rows = [
        (q, f"{n}.py", k + 1, 130.0 - 20 * k, "PRIMARY", False, [("exact_symbol", f"symbol:{n}.one", 95.0, None), ("exact_symbol", f"symbol:{n}.two", 95.0, None)])
        for q in ("q1", "q2") for k, n in enumerate("abc")
    ]
    return spark.createDataFrame(rows, RANKED), symbols, files, edges


def test_a_printed_pack_fits_the_budget(spark, tree):
    ranked, symbols, files, _ = tree
    for budget in (40, 90, 160, 300, 5000):
        packed = packing.pack(ranked, symbols, files, budget).cache()
        printed = {r.query_id: r for r in packing.rendered(packed).collect()}
        for r in printed.values():
            assert r.tokens <= budget and r.tokens == -(-len(r.text.encode()) // 4)
        taken = packed.where("taken and query_id = 'q1'").collect()
        assert bool(taken) == ("q1" in printed)
        assert all(f"## {r.path}:{r.start}-{r.end}\n{r.excerpt}\n" in printed["q1"].text for r in taken)
        if budget == 5000:
            assert packed.where("not taken").count() == 0
        else:
            assert packed.where("not taken and reason is null").count() == 0


def test_fitting_lowers_the_budget_only_as_far_as_needed():
    import pandas as pd

    pick = random.Random(3)
    for _ in range(6):
        n = pick.randint(1, 25)
        rows = pd.DataFrame({
            "number": range(n), "query_id": 1, "path": [f"p{i:02}" for i in range(n)], "start": 1, "end": 9,
            "cost": [pick.randint(5, 60) for _ in range(n)], "required": False, "anchor": False, "is_test": False, "affinity": True,
            "known": True, "connected": False, "rare": False, "score": [pick.random() * 90 for _ in range(n)],
            "worths": [[{"key": f"k{pick.randint(0, 9)}", "worth": 9.0}] for _ in range(n)], "strengths": None,
        })
        rows["bytes"] = rows["cost"] * 4 + 12
        ranges, budget = allocation.Ranges(rows), 300
        printed = lambda taken: -(-int(rows["bytes"].to_numpy()[list(taken)].sum()) // 4)  # noqa: B023, E731
        taken, _ = allocation.fitting(ranges, budget, False, None)
        assert printed(taken) <= budget
        best = max((printed(allocation.choose(ranges, b, False, None)[0]) for b in range(0, budget + 1, 4)
                    if printed(allocation.choose(ranges, b, False, None)[0]) <= budget))
        assert printed(taken) >= 0.8 * best


def lines(rows):
    return [(r.query_id, r.path, n) for r in rows for n in range(r.start, r.end + 1)]


def test_generations_never_repeat_a_line(spark, tree):
    ranked, symbols, files, edges = tree
    one = ranked.where("query_id = 'q1'").drop("query_id")
    kinds = spark.createDataFrame([(k,) for k in (*expansion.KINDS, "unknown")], "query_id string")
    ranked = kinds.crossJoin(one).select(*ranked.columns)
    packed = packing.pack(ranked.where("path = 'a.py'"), symbols, files, 400, edges=edges).where("taken")
    columns = ["query_id", "path", "start", "end", "priority", "sha256"]
    rows = packed.join(files.select("path", "sha256"), "path").select(*columns).collect()
    schema, seen = "query_id string, path string, start long, end long, priority double, sha256 string", set(lines(rows))
    assert {q for q, _, _ in seen} == {*expansion.KINDS, "unknown"}
    targets = {"symbol": "c.two", "file": "f.py"}
    text = {p: t.split("\n") for p, t, _ in FILES}
    for generation in (1, 2):
        asked = [(k, k if generation == 1 else "file", targets.get(k) if generation == 1 else "f.py", None) for k in (*expansion.KINDS, "unknown")]
        requests = spark.createDataFrame(asked, "query_id string, kind string, target string, lines int")
        packed, sent = expansion.expand(spark.createDataFrame(rows, schema), requests, ranked, symbols, files, edges, 150, generation)
        fresh, whole = sent.collect(), set(lines(packed.where("taken").collect()))
        got = lines(fresh)
        assert len(got) == len(set(got)) and not set(got) & seen
        assert set(got) | seen >= whole and seen <= whole
        wanted = {
            "next_candidates": {("b.py", 1)}, "symbol": {("c.py", n) for n in range(20, 29)},
            "related_imports": {(p, n) for p, k in (("b.py", 60), ("e.py", 200)) for n in range(1, k + 1)},
            "related_tests": {("d.py", n) for n in range(1, 121)}, "full_file": {("a.py", n) for n in range(1, 31)},
            "surrounding_lines": {("a.py", n) for n in range(1, 31)}, "file": {("f.py", n) for n in range(1, 81)}, "unknown": set(),
        }
        if generation == 2:
            wanted = {k: v | {("f.py", n) for n in range(1, 81)} for k, v in wanted.items()}
        assert all((k, *line) in whole for k, v in wanted.items() for line in v)
        assert all(r.excerpt == "\n".join(text[r.path][r.start - 1 : r.end]) for r in fresh)
        rows += [(r.query_id, r.path, r.start, r.end, 0.0, r.sha256) for r in fresh]
        seen |= set(got)


def test_changed_and_removed_files_are_sent_again(spark, tree):
    ranked, symbols, files, edges = tree
    rows = [("q1", "a.py", 1, 30, 0.0, "old"), ("q1", "gone.py", 1, 3, 0.0, "x")]
    held = spark.createDataFrame(rows, "query_id string, path string, start long, end long, priority double, sha256 string")
    status = {r.path: r.status for r in expansion.still_valid(held, files).collect()}
    assert status == {"a.py": "SOURCE_CHANGED", "gone.py": "SOURCE_REMOVED"}
    none = spark.createDataFrame([], "query_id string, kind string, target string, lines int")
    packed, sent = expansion.expand(held, none, ranked.where("query_id = 'q1'"), symbols, files, edges, 5000, 1)
    assert set(lines(sent.collect())) == set(lines(packed.where("taken").collect()))


def test_unsent_equals_sets_of_lines(spark):
    pick = random.Random(5)
    ranges = lambda n: [(f"k{pick.randint(0, 3)}", a, a + pick.randint(0, 9)) for a in (pick.randint(1, 60) for _ in range(n))]
    asked, had = ranges(40), ranges(25)
    frame = lambda rows: spark.createDataFrame(rows, "k string, start long, end long")
    flat = lambda rows: {(k, n) for k, a, b in rows for n in range(a, b + 1)}
    got = [tuple(r) for r in expansion.unsent(frame(asked), frame(had), ["k"]).collect()]
    assert flat(got) == flat(asked) - flat(had)
    assert len(flat(got)) == sum(b - a + 1 for _, a, b in got)
    assert flat(tuple(r) for r in expansion.unsent(frame(asked), frame([]), ["k"]).collect()) == flat(asked)
    assert expansion.unsent(frame([]), frame(had), ["k"]).count() == 0
