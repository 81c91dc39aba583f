"""Evidence in printed lines: where a path and its digest stand together and nothing else is named.

A path is named by a run of letters, digits and `_ - . / \\ :` that equals it, without regard to case, after the root and
leading `./` are taken off. So names are looked up by a join of equality; paths with blanks cannot be named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NAME = r"([\w\-./\\:]+)"
_DIGEST = r"(?<![0-9A-Fa-f])([0-9A-Fa-f]{64})(?![0-9A-Fa-f])"
_ORDER = ("run_id", "output_id")


def _lines(outputs: DataFrame, text: str) -> DataFrame:
    return outputs.select(*_ORDER, F.posexplode(F.split(text, r"\r\n|[\r\n]")).alias("line_no", "line"))


def _names(line: Column, root: str | None) -> Column:
    """Different names of a line, as paths below root; a full stop or colon at the end is none of the name."""
    plain = lambda n: F.regexp_replace(F.replace(F.lower(n), F.lit("\\"), F.lit("/")), r"[.:]+$", "")
    prefix = None if root is None else root.replace("\\", "/").rstrip("/").lower() + "/"

    def below(name: Column) -> Column:
        name = plain(name)
        if prefix is not None:
            name = F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)
        return F.regexp_replace(name, r"^(?:\./)+", "")

    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(_NAME), 1), below))


def _named(lines: DataFrame, expected: DataFrame, root: str | None) -> DataFrame:
    """Rows (run_id, output_id, line_no, path): the expected paths that lines name, each once a line."""
    each = lines.select(*_ORDER, "line_no", F.explode(_names(F.col("line"), root)).alias("name"))
    return each.join(expected.select("path", F.lower("path").alias("name")), "name").select(*_ORDER, "line_no", "path")


def _digests(line: Column) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(_DIGEST), 1), lambda d: F.lower(d))


def printed(outputs: DataFrame, expected: DataFrame, root: str | None = None) -> DataFrame:
    """Rows (run_id, path) of expected (path, digest) that an output (run_id, output_id, text) shows with their digests.

    The digest stands on a line that names the path, or on the line before or after it; no other expected path is named on
    that line or, for a neighbour's digest, on any of the three. Only lines that name a path or hold an expected
    digest reach the window, which reads three lines of one output at a time.
    """
    expected = expected.select("path", F.lower("digest").alias("digest")).distinct()
    lines = _lines(outputs, "text")
    names = _named(lines, expected, root).withColumn("digest", F.lit(None).cast("string"))
    each = lines.select(*_ORDER, "line_no", F.explode(F.array_distinct(_digests(F.col("line")))).alias("digest"))
    known = each.join(expected.select("digest").distinct(), "digest", "left_semi")
    marks = names.unionByName(known.withColumn("path", F.lit(None).cast("string")), allowMissingColumns=True)
    line = marks.groupBy(*_ORDER, "line_no").agg(F.collect_set("path").alias("paths"), F.collect_set("digest").alias("digests"))
    near = Window.partitionBy(*_ORDER).orderBy("line_no").rangeBetween(-1, 1)
    around = lambda c: F.array_distinct(F.flatten(F.collect_list(c).over(near)))
    line = line.withColumns({"near_paths": around("paths"), "near_digests": around("digests")}).where(F.size("paths") > 0)
    alone = F.when(F.size("near_paths") == 1, F.col("near_digests")).when(F.size("paths") == 1, F.col("digests"))
    shown = line.where(alone.isNotNull()).select("run_id", F.col("paths")[0].alias("path"), F.explode(alone).alias("digest"))
    return shown.join(expected, ["path", "digest"], "left_semi").select("run_id", "path").distinct()


def answered(answers: DataFrame, expected: DataFrame, root: str | None = None) -> DataFrame:
    """Rows (run_id, path) of expected (path, digest) that an answer (run_id, output_id, text) states.

    Exactly one line of the answer names the path, and the path's digest is all that this line holds of digests, once.
    """
    expected = expected.select("path", F.lower("digest").alias("digest")).distinct()
    lines = _lines(answers, "text")
    once = _named(lines, expected.select("path").distinct(), root).groupBy(*_ORDER, "path").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    found = lines.select(*_ORDER, "line_no", _digests(F.col("line")).alias("held")).where(F.size("held") == 1)
    stated = once.where("n = 1").join(found, [*_ORDER, "line_no"]).select("run_id", "path", F.col("held")[0].alias("digest"))
    return stated.join(expected, ["path", "digest"], "left_semi").select("run_id", "path").distinct()


def verdicts(runs: DataFrame, found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row a run (run_id): how many of the expected paths it shows, and whether that is all of them.

    runs without any have zero. With nothing expected no run is valid.
    """
    total = F.count_distinct("path").alias("n_expected")
    counted = found.select("run_id", "path").distinct().groupBy("run_id").agg(F.count("*").alias("n_found"))
    joined = runs.select("run_id").distinct().join(counted, "run_id", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)).cast("long"))
    n = expected.agg(total).scalar()
    return joined.withColumn("n_expected", n).withColumn("valid", (F.col("n_found") == F.col("n_expected")) & (F.col("n_expected") > 0))
