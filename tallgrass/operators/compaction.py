"""Compaction of tool output, one row a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import windows


def lines_of(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, line_no, line), numbered from 1."""
    return texts.select(key, F.posexplode(T.split_lines(text)).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def collapsed(lines: DataFrame, key: str) -> DataFrame:
    """Neighbouring equal lines as one that says how often; a traceback's lines are never collapsed."""
    order = Window.partitionBy(key).orderBy("line_no")
    head = F.contains("line", F.lit("Traceback (most recent call last):"))
    ends = F.trim("line").rlike(r"^(?:[A-Za-z_][\w.]*(?:Error|Exception|Warning)|E\s+\w+|AssertionError)\b")
    opened = F.sum(head.cast("int")).over(order)
    blocks = lines.withColumn("block", opened)
    inside = Window.partitionBy(key, "block").orderBy("line_no")
    ended = F.coalesce(F.sum((ends & ~head).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = blocks.withColumn("atomic", (F.col("block") > 0) & (ended == 0))
    own = F.when(F.col("atomic"), F.struct(F.col("line_no").alias("n"), "line")).otherwise(F.struct(F.lit(0).alias("n"), "line"))
    counted = windows.runs(marked.withColumn("own", own), [key], "own", ["line_no"])
    mark = F.when(F.col("length") > 1, F.format_string("%s [repeated %dx]", "own.line", "length")).otherwise(F.col("own.line"))
    return counted.select(key, "run", mark.alias("line"), "length")


def passing_condensed(lines: DataFrame, key: str) -> DataFrame:
    """Counts of passing and progress-only lines, which go, and of the lines that stay."""
    passed = F.col("line").rlike(r"\bPASSED\s*$")
    progress = F.col("line").rlike(r"^[.sFExX\[\] 0-9%]+$")
    return lines.groupBy(key).agg(
        F.count_if(passed).alias("n_passed"),
        F.count_if(progress & ~passed).alias("n_progress"),
        F.count_if(~passed & ~progress).alias("n_kept"),
    )


def within_budget(lines: DataFrame, key: str, budget: int) -> DataFrame:
    """Lines with whether they stay: errors and warnings always, the others from both ends inwards while they fit."""
    whole = Window.partitionBy(key)
    placed = lines.withColumn("severity", T.severity("line")).withColumn("cost", T.token_estimate("line"))
    placed = placed.withColumn("from_end", F.least(F.col("line_no") - 1, F.count("*").over(whole) - F.col("line_no")))
    must = placed.where("severity >= 2").groupBy(key).agg(F.sum("cost").alias("fixed"))
    rest = placed.where("severity < 2").join(must, key, "left").withColumn("left_over", F.lit(budget) - F.coalesce("fixed", F.lit(0)))
    # A text's own allowance is charged as a first row that always comes.
    charge = must.select(key, F.lit(0).alias("line_no"), F.least("fixed", F.lit(budget)).alias("cost"), F.lit(-1).alias("from_end"))
    queue = rest.select(key, "line_no", "cost", "from_end").unionByName(charge)
    folded = windows.first_fit(queue, [key], "cost", ["from_end", "line_no"], budget)
    kept = folded.where("line_no > 0").select(key, "line_no", F.col("taken").alias("stays"))
    return kept.union(placed.where("severity >= 2").select(key, "line_no", F.lit(True)))


def status_groups(lines: DataFrame, key: str) -> DataFrame:
    """Paths of short status lines by kind: Untracked, Renamed, Deleted, Added or Modified."""
    flags, path = F.substring("line", 1, 2), F.substring("line", 4, 1 << 20)
    shaped = lines.where(F.col("line").rlike(r"^[ MADRCU?!]{2} .") & ~F.col("line").startswith("   "))
    kind = F.when(flags == "??", "Untracked")
    for letter, name in (("R", "Renamed"), ("D", "Deleted"), ("A", "Added")):
        kind = kind.when(F.contains(flags, F.lit(letter)), name)
    rows = shaped.select(key, kind.otherwise("Modified").alias("kind"), path.alias("path"))
    return rows.groupBy(key, "kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))
