"""Selecting line ranges of ranked files under a token budget, and printing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import affinity, allocation, intervals
from .storage import stored

KEYS = ["query_id", "path"]
#: Lines of a file's opening that stand for a file without a matched symbol.
OPENING = 40
#: A required range goes before any other; a range of a file matched directly before one of a neighbour.
REQUIRED, PRIMARY = 1000.0, 30.0


def proposals(ranked: DataFrame, symbols: DataFrame, files: DataFrame, context: int = 1) -> DataFrame:
    """Ranges (query_id, path, start, end) around the symbols that a ranked file was matched by, else its opening.

    ranked has query_id, path and signals (kind, key); files path and line_count.
    """
    lengths = files.select("path", F.col("line_count").cast("long").alias("length"))
    hits = ranked.select(*KEYS, F.explode("signals").alias("s")).where(F.col("s.kind") == "exact_symbol")
    hits = hits.select(*KEYS, F.substring("s.key", len("symbol:") + 1, 1 << 20).alias("qualified_name"))
    spans = symbols.select("path", "qualified_name", "start_line", "end_line")
    around = hits.join(spans, ["path", "qualified_name"]).join(lengths, "path").select(
        *KEYS,
        F.greatest(F.lit(1), F.col("start_line") - context).cast("long").alias("start"),
        F.least("length", F.col("end_line") + context).cast("long").alias("end"),
    )
    bare = ranked.select(*KEYS).join(around.select(*KEYS).distinct(), KEYS, "left_anti").join(lengths.where("length > 0"), "path")
    opening = bare.select(*KEYS, F.lit(1).cast("long").alias("start"), F.least(F.col("length"), F.lit(OPENING)).alias("end"))
    return around.union(opening)


def excerpts(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """Ranges with the text of their lines, secrets replaced, and its token estimate."""
    texts = files.where("text is not null").select("path", "text")
    # Lines are cut after the join: of the files with ranges only.
    lines = ranges.join(texts, "path").withColumn("lines", T.split_lines("text"))
    body = F.array_join(F.slice("lines", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")), "\n")
    cut = lines.withColumn("excerpt", T.redacted(body)).drop("lines", "text")
    return cut.withColumn("tokens", T.token_estimate("excerpt"))


def pack(
    ranked: DataFrame, symbols: DataFrame, files: DataFrame, budget: int = 6000, gap: int = 2,
    edges: DataFrame | None = None, forced: DataFrame | None = None, depth_limit: int | None = None,
) -> DataFrame:
    """Excerpts of each query with whether the budget takes them, and phase, place and reason of the choice.

    Near ranges of a file are merged, and one that covers most of a file becomes the whole. The choice is that of
    `allocation`: required ranges (of explicitly named files, and those in forced) always, the others by evidence for
    their cost, inside the cluster that `affinity` finds where edges are given. The budget holds for the pack as
    `rendered` prints it: where headings push it over, it is packed again under a smaller budget, so only required
    ranges alone can exceed it.

    ranked: (query_id, path, rank, score, role, signals); files: (path, text, line_count) and is_test if there is one;
    forced: (query_id, path, start, end), ranges of any file that have to be in. Files without text have no ranges.
    """
    lengths = files.select("path", F.col("line_count").cast("long").alias("length"))
    proposed = proposals(ranked, symbols, files).withColumn("must", F.lit(False))
    if forced is not None:
        inside = forced.join(lengths, "path").where("start <= length").select(
            *KEYS, F.greatest(F.lit(1), "start").cast("long").alias("start"),
            F.least("length", "end").cast("long").alias("end"), F.lit(True).alias("must"),
        )
        proposed = proposed.unionByName(inside)
    merged = intervals.merge(proposed, KEYS, gap, any_of=["must"])
    whole = proposed.select(*KEYS).distinct().join(lengths, "path")
    # Stored, so that Spark knows how few they are and texts need not be shuffled to meet them.
    chosen = excerpts(stored(intervals.promoted(merged, whole, KEYS, any_of=["must"])), files)
    named = F.exists("signals", lambda s: s["kind"].isin("explicit_path", "trace_path"))
    about = ranked.select(*KEYS, "score", "role", "signals", named.alias("named"))
    priced = chosen.join(about, KEYS, "left").withColumn("required", F.col("must") | F.coalesce("named", F.lit(False)))
    weight = F.coalesce("score", F.lit(0.0)) + F.when(F.col("required"), REQUIRED).otherwise(0.0)
    weight += F.when(F.col("role") == "PRIMARY", PRIMARY).otherwise(0.0)
    # Read for the choice and for the result; texts are cut out once.
    priced = stored(priced.withColumn("priority", -weight).drop("must", "named"))
    tests = files.select("path", "is_test") if "is_test" in files.columns else files.select("path", F.lit(False).alias("is_test"))
    if edges is None:
        pinned = F.exists("signals", lambda s: s["kind"].isin(*affinity.NAMED))
        cluster = ranked.select(*KEYS, pinned.alias("anchor"), F.lit(True).alias("affinity"))
    else:
        cluster = affinity.clusters(ranked, tests, edges)
    ranges = priced.join(cluster, KEYS, "left").join(tests.dropDuplicates(["path"]), "path", "left").select(
        *KEYS, "start", "end", F.col("tokens").alias("cost"), _printed_bytes().alias("bytes"), "required",
        F.coalesce("anchor", F.lit(False)).alias("anchor"), F.coalesce("is_test", F.lit(False)).alias("is_test"),
        F.coalesce("affinity", F.lit(False)).alias("affinity"), "score", allocation.matches(ranked).alias("signals"),
    )
    decided = allocation.allocate(ranges, budget, depth_limit=depth_limit, fit=True)
    joined = priced.drop("signals", "role").join(decided.drop("cost"), [*KEYS, "start", "end"])
    return joined.withColumn("taken", F.col("phase").isNotNull())


def _heading() -> Column:
    return F.format_string("## %s:%d-%d\n", "path", "start", "end")


def _printed_bytes() -> Column:
    """Bytes of an excerpt as `rendered` prints it, its line end included."""
    return (F.octet_length(_heading()) + F.octet_length("excerpt") + 1).cast("long")


def rendered(packed: DataFrame) -> DataFrame:
    """Each query's taken excerpts as one text, those of highest priority first, and its token estimate."""
    part = F.concat(_heading(), "excerpt", F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("priority", "path", "start", part.alias("part"))))
    texts = packed.where("taken").groupBy("query_id").agg(ordered.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    return texts.select("query_id", text.alias("text")).withColumn("tokens", T.token_estimate("text"))


def locator(packed: DataFrame) -> DataFrame:
    """One text a query that names the taken ranges: `- path:a-b; c-d`, a line for each file in order of priority."""
    span = F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))
    per_file = packed.where("taken").groupBy(*KEYS).agg(
        F.min("priority").alias("priority"), F.array_sort(F.collect_list(F.struct("start", span.alias("span")))).alias("spans")
    )
    spans = F.array_join(F.transform("spans", lambda s: s["span"]), "; ")
    line = F.format_string("- %s:%s", "path", spans)
    ordered = F.array_sort(F.collect_list(F.struct("priority", "path", line.alias("line"))))
    return per_file.groupBy("query_id").agg(ordered.alias("l")).select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("locator"))


def parsed_locator(locators: DataFrame) -> DataFrame:
    """Rows (query_id, path, start, end) of locator texts."""
    lines = locators.select("query_id", F.explode(F.split("locator", "\n")).alias("line")).where(F.col("line").startswith("- "))
    path = F.regexp_extract("line", r"^- (.*):[^:]*$", 1)
    spans = F.explode(F.regexp_extract_all("line", F.lit(r"(\d+-\d+)(?:;|$| )"), 1))
    cut = lines.select("query_id", path.alias("path"), spans.alias("span"))
    side = lambda i: F.split_part("span", F.lit("-"), F.lit(i)).cast("long")
    return cut.select("query_id", "path", side(1).alias("start"), side(2).alias("end"))


def pack_metrics(packed: DataFrame, candidate_tokens: Column | None = None) -> DataFrame:
    """Tokens offered, taken and avoided for each query, and the reduction in percent."""
    offered = F.sum("tokens").alias("candidate_tokens")
    taken = F.coalesce(F.sum(F.when(F.col("taken"), F.col("tokens"))), F.lit(0)).alias("selected_tokens")
    sums = packed.groupBy("query_id").agg(offered, taken, F.count_if("taken").alias("n_ranges"))
    avoided = F.col("candidate_tokens") - F.col("selected_tokens")
    return sums.withColumn("tokens_avoided", avoided).withColumn(
        "reduction_percent", F.when(F.col("candidate_tokens") > 0, avoided * 100.0 / F.col("candidate_tokens")).otherwise(0.0)
    )


def recall(packed: DataFrame, required: DataFrame) -> DataFrame:
    """Share of required (query_id, path, start, end) ranges inside taken ones, and of their files."""
    taken = packed.where("taken").select(*KEYS, F.col("start").alias("s"), F.col("end").alias("e"))
    inside = (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end"))
    found = required.join(taken, KEYS, "left").groupBy(*KEYS, "start", "end").agg(
        F.coalesce(F.bool_or(inside), F.lit(False)).alias("whole"), F.count("s").alias("n")
    )
    return found.groupBy("query_id").agg(
        F.avg(F.col("whole").cast("int")).alias("range_recall"), F.avg((F.col("n") > 0).cast("int")).alias("file_recall")
    )
