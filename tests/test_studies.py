"""Evidence in lines, cited spans, totals without a part, counters against traces: each against a slow version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import evidence, studies

DIGESTS = {f"src/f{i}.py": f"{i:064x}" for i in range(1, 5)}
OUTPUTS = "run_id string, output_id long, text string"


def expected_of(spark, digests=DIGESTS):
    return spark.createDataFrame(list(digests.items()), "path string, digest string")


def pairs(rows):
    return sorted((r.run_id, r.path) for r in rows.collect())


def named(text):
    return {p for p in DIGESTS if re.search(r"(?<![\w./\\-])(?:\./)*" + re.escape(p) + r"(?![\w/-])(?!\.\w)", text.lower().replace("\\", "/"))}


def test_printed_digests_against_every_line(spark):
    rng = random.Random(3)
    pieces = [*DIGESTS, *DIGESTS.values(), "./src/F1.py:", "src\\f2.py", "other/src/f1.py", "src/f1.pyc", "word", "ab" * 40, *[d.upper() for d in DIGESTS.values()]]
    outputs = []
    for n in range(60):
        lines = [" ".join(rng.choices(pieces, k=rng.choice((0, 1, 1, 2, 3)))) for _ in range(8)]
        outputs.append((f"r{n % 20}", n, "\n".join(lines)))
    slow = set()
    for run, _, text in outputs:
        lines = text.split("\n")
        for i, line in enumerate(lines):
            near = "\n".join(lines[max(0, i - 1) : i + 2])
            for p in named(line):
                for place in (line, near):
                    held = {d.lower() for d in re.findall(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64}(?![0-9A-Fa-f])", place)}
                    if DIGESTS[p] in held and len(named(place)) == 1:
                        slow.add((run, p))
    found = evidence.printed(spark.createDataFrame(outputs, OUTPUTS), expected_of(spark))
    assert pairs(found) == sorted(slow) and 10 < len(slow) < 75


def test_printed_below_a_root_and_verdicts(spark):
    a, b = list(DIGESTS)[:2]
    rows = [
        ("all", 1, f"/Work/x/{a}\r\n{DIGESTS[a]}\r\n\r\n{DIGESTS[b]} {b}"),
        ("elsewhere", 2, f"/work/y/{a} {DIGESTS[a]}"),
        ("swapped", 3, f"{a} {DIGESTS[b]}\n\n{b} {DIGESTS[a]}"),
        ("far", 4, f"{a}\n\n{DIGESTS[a]}"),
        ("parts", 5, a),
        ("parts", 6, DIGESTS[a]),
        ("null", 7, None),
        ("empty", 8, ""),
    ]
    outputs, wanted = spark.createDataFrame(rows, OUTPUTS), expected_of(spark, {p: DIGESTS[p].upper() for p in (a, b)})
    found = evidence.printed(outputs, wanted, root="/work/x")
    assert pairs(found) == [("all", a), ("all", b)]
    got = {r.run_id: (r.n_found, r.n_expected, r.valid) for r in evidence.verdicts(outputs, found, wanted).collect()}
    assert got == {r[0]: (2, 2, True) if r[0] == "all" else (0, 2, False) for r in rows}
    nothing = evidence.printed(outputs, wanted.where(F.lit(False)))
    assert nothing.count() == 0 and not any(r.valid for r in evidence.verdicts(outputs, nothing, wanted.where(F.lit(False))).collect())


def test_answers_name_a_path_on_one_line_with_one_digest(spark):
    a = "src/f1.py"
    d, other = DIGESTS[a], DIGESTS["src/f2.py"]
    texts = {
        "one": (f"- `{a}`: {d}", True),
        "twice the path on a line": (f"{a} {a} {d}", True),
        "on two lines": (f"{a} {d}\n{a}", False),
        "two digests": (f"{a} {d} {other}", False),
        "twice the digest": (f"{a} {d} {d}", False),
        "other digest": (f"{a} {other}", False),
        "next line": (f"{a}\n{d}", False),
        "longer digest": (f"{a} {d}0", False),
        "sentence": (f"The digest of {a.upper()} is {d.upper()}.", True),
    }
    rows = spark.createDataFrame([(n, i, t) for i, (n, (t, _)) in enumerate(texts.items())], OUTPUTS)
    assert {r.run_id for r in evidence.answered(rows, expected_of(spark)).collect()} == {n for n, (_, ok) in texts.items() if ok}


SPANS = "task int, area string, option int, path string, symbol string, start long, end long"


def test_spans_and_areas_against_all_pairs(spark):
    rng = random.Random(5)

    def span(width):
        start = rng.randint(1, 40)
        return rng.choice("pqr"), rng.choice("stC"), start, start + rng.randint(0, width)

    references = [(rng.randint(1, 12), rng.choice("xy"), rng.randint(1, 2), *span(5)) for _ in range(70)]
    hints = [(rng.randint(1, 12), *span(8)) for _ in range(60)] + [(3, "p", "s", 1, 50), (4, "q", "t", 1, 49)]
    lengths = {"p": 50, "q": 50}
    files = spark.createDataFrame(list(lengths.items()), "path string, line_count int")
    symbols = spark.createDataFrame([("p", "C", "class"), ("q", "C", "function"), ("r", "C", "class")], "path string, qualified_name string, kind string")
    broad = lambda h: h[1] in lengths and ((h[3] == 1 and h[4] >= lengths[h[1]]) or (h[1], h[2]) == ("p", "C"))
    slow = {}
    for task, _, _, path, symbol, start, end in references:
        on = [h for h in hints if h[:2] == (task, path)]
        over = [h for h in on if h[3] <= end and h[4] >= start]
        exact = any(h[2] == symbol for h in over)
        slow[task, path, symbol, start, end] = (
            bool(on), bool(over), any(h[2] == symbol for h in on), exact, not exact and any(map(broad, over)), bool(over) and not exact,
        )
    given = spark.createDataFrame(references, SPANS)
    scores = studies.span_scores(given, spark.createDataFrame(hints, "task int, path string, symbol string, start long, end long"), files, symbols).cache()
    assert {tuple(r)[:5]: tuple(r)[5:] for r in scores.collect()} == slow and scores.count() == len(slow)
    assert all(any(s[i] for s in slow.values()) for i in range(6))

    arms = {r.task: r for r in studies.arm_scores(given, scores, spark.createDataFrame([(1,), (1,)], "task int")).collect()}
    for task in {r[0] for r in references}:
        options = {}
        for r in references:
            if r[0] == task:
                options.setdefault(r[1], {}).setdefault(r[2], []).append(slow[(task, *r[3:])][3])
        areas = [any(map(all, o.values())) for o in options.values()]
        expected = (None, None, None) if task == 1 else (len(areas), sum(areas), all(areas))
        assert (arms[task].n_areas, arms[task].n_complete, arms[task].complete_task) == expected
        of_task = {s: m for s, m in slow.items() if s[0] == task}
        assert arms[task].cited_spans == len(of_task) and arms[task].n_paths_targeted == len({s[1] for s, m in of_task.items() if m[0]})
    none = studies.span_scores(given, given.where(F.lit(False)), files, symbols)
    assert none.where(" or ".join(studies.MEASURES)).count() == 0 and none.count() == len(slow)


def test_totals_without_a_part(spark):
    rows = [("a", 10, True), ("a", None, None), ("b", 2**62, False), ("b", 2**62, True), (None, 7, True)]
    got = studies.leave_one_out(spark.createDataFrame(rows, "g string, v long, ok boolean"), "g", {"v": F.col("v") % 1000, "ok": F.col("ok")})
    for r in got.collect():
        rest = [x for x in rows if x[0] != r.g]
        values, flags = [x[1] % 1000 for x in rest if x[1] is not None], [x[2] for x in rest if x[2] is not None]
        assert (r.n_others, r.v, r.ok) == (len(rest), pytest.approx(sum(values) / len(values)), pytest.approx(sum(flags) / len(flags)))
    one = studies.leave_one_out(spark.createDataFrame([("a", 1)], "g string, v long"), "g", {"v": F.col("v")}).first()
    assert (one.n_others, one.v) == (0, None)
    # Sums of several groups pass the range of a long.
    wide = studies.leave_one_out(spark.createDataFrame([(g, 2**62) for g in "abcd"], "g string, v long"), "g", {"v": F.col("v")})
    assert {r.v for r in wide.collect()} == {float(2**62)}
    areas = spark.createDataFrame([(1, "x", True), (1, "y", True), (2, "x", False)], "task int, area string, full boolean")
    assert tuple(studies.sensitivity(areas, areas.where("area = 'y'").select("task", "area")).first()) == (1, 2)


def test_parity_names_what_differs(spark):
    steps = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 0), ("e", 1)], "run string, reads long")
    counters = spark.createDataFrame([("a", 2, 3), ("b", 1, 2), ("d", 1, 0), ("e", 1, 1), ("e", 1, 1)], "run string, n long, reads long")
    found = studies.parity(steps, counters, "run", {"n": F.lit(1), "reads": F.col("reads")})
    assert {r.run: r.diverges for r in found.collect()} == {"a": [], "b": ["reads"], "c": ["n"], "d": ["n"], "e": ["repeated"]}
    rows, seen = studies.observed(found, "run", "parity")
    assert len(rows.collect()) == 5
    assert seen.get == {"n_runs": 5, "n_diverging": 4, "first_diverging": "b"}
    assert studies.required(found.where("run = 'a'"), "run").count() == 1
    with pytest.raises(Exception, match="run b differs in reads"):
        studies.required(found.where("run = 'b'"), "run").collect()


def test_summary_of_a_study(spark):
    rows = [(1, "bug", False, 2, 0, True), (2, "bug", True, 5, 5, True), (3, "docs", False, 0, 1, False), (4, None, False, 1, 0, True)]
    outcomes = spark.createDataFrame(rows, "task int, archetype string, partial boolean, n_gained int, n_lost int, within_budget boolean")
    got = {(r.archetype, r.is_total): tuple(r)[2:] for r in studies.study_summary(outcomes).collect()}
    assert got == {("bug", False): (2, 1, 2, 0, 2), ("docs", False): (1, 0, 0, 1, 0), (None, False): (1, 0, 1, 0, 1), (None, True): (4, 1, 3, 1, 3)}
