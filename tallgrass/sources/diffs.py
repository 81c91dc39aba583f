"""Version control output as tables: status entries, and the lines of unified diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals


def status_entries(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, path, old_path, status) of NUL-separated status output; a rename's old path is the field after it."""
    fields = texts.select(key, F.posexplode(F.split(text, "\x00")).alias("at", "field")).where("field <> ''")
    order = Window.partitionBy(key).orderBy("at")
    flags = F.substring("field", 1, 2)
    is_rename = flags.rlike("[RC]") & (F.substring("field", 3, 1) == " ")
    # In a run of fields that look like renames, every second one is an old path.
    marked = fields.withColumn("renames", is_rename)
    runs = marked.withColumn("run", F.sum((~F.col("renames")).cast("int")).over(order))
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy("at")) - F.when(F.col("run") > 0, 2).otherwise(1)
    heads = runs.withColumn("head", F.col("renames") & (F.pmod(place, F.lit(2)) == 0))
    entries = heads.withColumn("old_path", F.lead("field").over(order)).withColumn("is_old", F.lag("head").over(order))
    own = F.col("head") | (~F.col("renames") & ~F.coalesce("is_old", F.lit(False)))
    status = F.when(flags == "??", "untracked")
    for letter, name in (("R", "renamed"), ("D", "deleted"), ("A", "added")):
        status = status.when(F.contains(flags, F.lit(letter)), name)
    return entries.where(own).select(
        key, F.substring("field", 4, 1 << 20).alias("path"), F.when(F.col("renames"), F.col("old_path")).alias("old_path"), status.otherwise("modified").alias("status")
    )


def diff_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, path, hunk, kind, old_line, new_line, line) for the added and removed lines of unified diffs.

    File and hunk headers are carried down to the lines below them by windows; line numbers count
    from the hunk's header.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    order = Window.partitionBy(key).orderBy("at")
    last = lambda c: F.last(c, ignorenulls=True).over(order)
    header = F.regexp_extract_all("line", F.lit(r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"), 0)
    is_hunk = F.size(header) > 0
    start = lambda i: F.regexp_extract("line", r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@", i).cast("long")
    name = F.when(F.col("line").startswith("diff --git "), F.regexp_extract("line", r" b/(.*)$", 1))
    marked = lines.select(
        "*", last(name).alias("path"), last(F.when(is_hunk, F.struct(F.col("at").alias("hunk_at"), start(1).alias("old"), start(2).alias("new")))).alias("h"),
        is_hunk.alias("is_hunk"), last(F.when(name.isNotNull(), F.col("at"))).alias("file_at"),
    ).where("h is not null and h.hunk_at > file_at and not is_hunk")
    kind = F.substring("line", 1, 1)
    inside = Window.partitionBy(key, "h.hunk_at").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda kinds: F.coalesce(F.sum(kind.isin(*kinds).cast("int")).over(inside), F.lit(0))
    numbered = marked.select(
        key, "path", F.col("h.hunk_at").alias("hunk"), kind.alias("kind"),
        F.when(kind != "+", F.col("h.old") + before(["-", " "])).alias("old_line"),
        F.when(kind != "-", F.col("h.new") + before(["+", " "])).alias("new_line"),
        F.substring("line", 2, 1 << 20).alias("line"),
    )
    return numbered.where(F.col("kind").isin("+", "-"))


def diff_files(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row a file of unified diffs, those without hunks too: key, path, old_path, is_binary, status, hunks and lines.

    old_path is what a rename or copy comes from, else null. Only lines above a file's first hunk are read as headers, so a
    changed line that looks like one is none. Repeated sections of a path are added up.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    order = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    opens = F.when(line.startswith("diff --git "), F.struct(F.col("at").alias("n"), F.regexp_extract("line", r" b/(.*)$", 1).alias("path")))
    marked = lines.withColumn("file", F.last(opens, ignorenulls=True).over(order)).where("file is not null")
    section = Window.partitionBy(key, "file.n").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    hunk = line.rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@")
    inside = F.max(hunk.cast("int")).over(section) == 1
    marked = marked.select(key, F.col("file.path").alias("path"), "line", hunk.alias("hunk"), inside.alias("inside"))
    head = lambda c: F.coalesce(F.bool_or(~F.col("inside") & c), F.lit(False))
    moved = F.max(F.when(~F.col("inside"), F.nullif(F.regexp_extract("line", r"^(?:rename|copy) from (.*)$", 1), F.lit(""))))
    named = (("renamed", "rename from "), ("copied", "copy from "), ("added", "new file mode "), ("deleted", "deleted file mode "))
    status = F.lit("modified")
    for name, start in reversed(named):
        status = F.when(head(line.startswith(start)), name).otherwise(status)
    signed = lambda c: F.count_if(F.col("inside") & line.startswith(c))
    return marked.groupBy(key, "path").agg(
        moved.alias("old_path"), head(line.rlike("^Binary files .* differ$") | line.startswith("GIT binary patch")).alias("is_binary"), status.alias("status"),
        F.count_if("hunk").alias("n_hunks"), signed("+").alias("n_added"), signed("-").alias("n_removed"),
    )


def affected_symbols(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each added line (path, new_line), the innermost symbol (path, qualified_name, start_line, end_line) that holds it."""
    added = changed.where("new_line is not null").select("path", "new_line")
    pairs = added.join(symbols.select("path", "qualified_name", "start_line", "end_line"), "path")
    held = pairs.where("new_line between start_line and end_line")
    return intervals.innermost(held, ["path", "new_line"], "start_line", "end_line", "qualified_name")
