"""Commands of runs: words, nested shells, searches without a limit of length, files read by name."""

import re
import shlex

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallgrass.functions import commands
from tallgrass.operators import telemetry


def table(spark, rows):
    return spark.createDataFrame([("r", c) for c in rows], "run_id string, command string")


def test_words_are_those_of_a_shell(spark):
    cases = []

    @settings(max_examples=200, database=None)
    @given(st.text(alphabet="ab \"'-|;/.", min_size=1, max_size=20))
    def collect(command):
        cases.append(command)

    collect()
    cases = sorted(set(cases))
    got = table(spark, cases).select("command", commands.is_single("command").alias("single"), commands.words("command").alias("words")).collect()
    n_single = 0
    for row in got:
        open_quote, operators = None, False
        for c in row.command:
            if open_quote:
                open_quote = None if c == open_quote else open_quote
            elif c in "\"'":
                open_quote = c
            else:
                operators |= c in "|;&<>"
        assert row.single == (open_quote is None and not operators), row.command
        if row.single:
            lexer = shlex.shlex(row.command, posix=True)
            lexer.whitespace_split, lexer.commenters, lexer.escape = True, "", ""
            bare = [re.sub("\"([^\"]*)\"|'([^']*)'", lambda m: m[1] or m[2] or "", w) for w in row.words]
            assert bare == list(lexer), row.command
            n_single += 1
    assert n_single > 20


def test_one_level_of_a_nested_shell(spark):
    rows = {
        'powershell.exe -NoProfile -Command "rg -n word src"': "rg -n word src",
        "pwsh -c 'git grep word'": "git grep word",
        r'"C:\Windows\PowerShell.exe" -command "cat a b"': "cat a b",
        "pwsh -File run.ps1": None,
        "pwsh -c": None,
        "pwsh -c rg word": None,
        "pwsh -c 'rg word' | more": None,
        "bash -lc 'rg word'": "bash -lc 'rg word'",
        "": "",
    }
    got = table(spark, rows).select("command", commands.unwrapped("command").alias("inner")).collect()
    assert {r.command: r.inner for r in got} == rows


def test_searches_inside_a_shell_of_any_length_and_without_secrets(spark):
    long = "rg -n word " + " ".join(f"src/f{i}.py" for i in range(1000))
    rows = {
        "pwsh -Command \"rg -n 'two words' src\"": ["src"],
        "pwsh -Command \"pwsh -c 'rg word src'\"": None,
        "pwsh -Command \"rg word src | more\"": None,
        "rg -n 'a|b' src": ["src"],
        long: [f"src/f{i}.py" for i in range(1000)],
        "rg -n word src api_key=abcdef1234567890abcd": ["src"],
    }
    found = {r.command: r.targets for r in telemetry.searches(table(spark, rows)).collect()}
    assert len(found) == 4 and all("abcdef1234567890abcd" not in c for c in found)
    assert {c: t for c, t in found.items() if "REDACTED" not in c} == {c: t for c, t in rows.items() if t and "api_key" not in c}
    assert [t for c, t in found.items() if "REDACTED" in c] == [["src"]]
    assert long not in {r.command for r in telemetry.searches(table(spark, rows), longest=4096).collect()}


def test_files_read_by_name(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.py", "src/my file.py", "b.md", "it's.txt", "b.md")], "path string")
    rows = {
        "cat src/a.py b.md": ["src/a.py"],
        "cat ./src/../b.md; type src\\a.py": ["b.md", "src/a.py"],
        "pwsh -Command \"Get-Content -LiteralPath 'src/my file.py'\"": ["src/my file.py"],
        "Get-Content 'it''s.txt' | more": ["it's.txt"],
        "python -c \"Path('src/a.py').read_text(); open('b.md')\"": ["src/a.py", "b.md"],
        "python -c \"open('b.md', 'rb'); open(r'src/a.py', mode='r')\"": ["b.md", "src/a.py"],
        "python -c \"open('b.md', 'w')\"": [],
        "cat /work/x/b.md": ["b.md"],
        "cat /work/y/b.md ": [],
        "cat ../b.md": [],
        "cat src/../../b.md": [],
        "cat missing.py": [],
        "cat b.md; cat b.md": ["b.md"],
        "cat src": [],
        "": [],
    }
    given = table(spark, rows).union(spark.createDataFrame([("r", None)], "run_id string, command string"))
    got = telemetry.read_paths(given, files, root="/work/x/")
    assert got.columns == ["run_id", "command", "place", "path"]
    by = {}
    for r in got.orderBy("command", "place").collect():
        by.setdefault(r.command, []).append(r.path)
    assert by == {c: p for c, p in rows.items() if p}
    assert telemetry.read_paths(given.where(F.lit(False)), files).count() == 0
