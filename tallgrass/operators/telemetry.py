"""Folding agent event logs and judging pairs of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import commands as C
from ..functions import numbers
from ..functions import text as T
from . import intervals

# Tool to action.
TOOL_KINDS = {
    "Read": "read", "Grep": "search", "Glob": "listing", "Edit": "edit", "MultiEdit": "edit", "Write": "write", "Bash": "bash",
}


def tool_kind(tool: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TOOL_KINDS.items() for x in pair])
    return F.coalesce(F.element_at(table, T.col(tool)), F.lit("other"))


def command_kind(command: Column | str) -> Column:
    """What a shell command does; of several, reading comes before listing, searching and version control."""
    c = T.col(command)
    return (
        F.when(c.rlike(r"(?i)\b(cat|type|get-content|head|tail|sed -n)\b|\.read_(text|bytes)\(|\bopen\("), "read")
        .when(c.rlike(r"(?i)\brg --files\b|\b(ls|dir|tree|get-childitem|find)\b"), "listing")
        .when(c.rlike(r"(?i)\b(rg|grep|select-string|findstr)\b"), "search")
        .when(c.rlike(r"(?i)\bgit\b"), "git")
        .otherwise("unclassified")
    )


def fold_runs(lines: DataFrame) -> DataFrame:
    """One row a run from rows (run_id, line_no, value), value being a line of JSON.

    Lines that are no JSON objects are counted as malformed and skipped. The last usage and the last
    message win; an item counts once, when it is completed.
    """
    field = lambda path: F.get_json_object("value", path)
    is_object = F.get_json_object("value", "$").startswith("{")
    usage = [
        numbers.json_count("value", f"$.usage.{n}_tokens").alias(n)
        for n in ("input", "cached_input", "output", "reasoning_output", "total")
    ]
    parsed = lines.select(
        "run_id", "line_no", F.coalesce(is_object, F.lit(False)).alias("ok"), field("$.type").alias("type"),
        field("$.item.type").alias("item"), field("$.item.command").alias("command"),
        field("$.item.text").alias("said"), F.struct(*usage).alias("usage"),
    )
    done = F.col("ok") & (F.col("type") == "item.completed")
    ran = done & (F.col("item") == "command_execution")
    turn = F.col("type") == "turn.completed"
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("line_no")))
    kinds = [F.count_if(ran & (command_kind("command") == k)).alias(f"n_{k}") for k in ("read", "listing", "search", "git", "unclassified")]
    folded = parsed.groupBy("run_id").agg(
        F.count_if("ok").alias("n_events"),
        F.count_if(~F.col("ok")).alias("n_malformed"),
        *kinds,
        F.count_if(done & (F.col("item") == "mcp_tool_call")).alias("n_tool_calls"),
        F.count_if(done & (F.col("item") == "file_change")).alias("n_file_changes"),
        F.count_if(F.col("type").isin("turn.failed", "error")).alias("n_errors"),
        last(F.col("usage"), turn).alias("usage"),
        last(F.col("said"), done & (F.col("item") == "agent_message")).alias("final_message"),
    )
    return folded.select("*", "usage.*").drop("usage").withColumn("final_message", T.redacted("final_message"))


def rereads(reads: DataFrame, run: str, path: str) -> DataFrame:
    """Reads of a run, distinct paths, and reads beyond the first of a path."""
    each = reads.groupBy(run, path).agg(F.count("*").alias("n"))
    return each.groupBy(run).agg(
        F.sum("n").alias("n_reads"), F.count("*").alias("n_unique"), F.sum(F.col("n") - 1).alias("n_rereads")
    )


def usage_summary(entries: DataFrame, counters: list[str]) -> DataFrame:
    """Calls by tool with successes and counters, and a row for all of them (tool null)."""
    return entries.rollup("tool").agg(
        F.count("*").alias("n_calls"),
        F.count_if("success").alias("n_success"),
        F.count_if(~F.col("success")).alias("n_errors"),
        *[F.sum(c).alias(c) for c in counters],
    )


def delivery_overlap(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes of source delivered first and again, from rows (keys, call, path, content_hash, start, line_bytes, end).

    A line is known by path, hash and number. If one entry of a key has not a size for each of its
    lines, the key's overlap is unavailable.
    """
    ok = F.bool_and(F.coalesce(F.size("line_bytes") == F.col("end") - F.col("start") + 1, F.lit(False)))
    available = entries.groupBy(*keys).agg(ok.alias("available"))
    lines = entries.select(*keys, "call", "path", "content_hash", F.posexplode("line_bytes").alias("at", "bytes"), "start")
    first = F.min_by("bytes", F.struct("call", "start"))
    each = lines.groupBy(*keys, "path", "content_hash", (F.col("start") + F.col("at")).alias("line")).agg(
        first.alias("unique_bytes"), (F.sum("bytes") - first).alias("repeated_bytes")
    )
    sums = each.groupBy(*keys).agg(F.sum("unique_bytes").alias("unique_bytes"), F.sum("repeated_bytes").alias("repeated_bytes"))
    known = lambda c: F.when(F.col("available"), F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    total = F.col("unique_bytes") + F.col("repeated_bytes")
    joined = available.join(sums, keys, "left").select(*keys, "available", *[known(c).alias(c) for c in ("unique_bytes", "repeated_bytes")])
    return joined.withColumn("overlap_ratio", F.when(F.col("available") & (total > 0), F.col("repeated_bytes") / total))


# The names of the verdicts.
INVALID, REGRESSION, FAILURE, LESS_EXPLORATION, NO_REDUCTION = (
    "INVALID_INFRASTRUCTURE",
    "CORRECTNESS_REGRESSION",
    "TASK_FAILURE",
    "CORRECT_WITH_LESS_NATIVE_EXPLORATION",
    "CORRECT_NO_MEASURED_EXPLORATION_REDUCTION",
)


def pair_verdict() -> Column:
    """Of a pair's columns valid, base_correct, correct, base_reads, reads, base_searches, searches: the first rule that holds."""
    less = (F.col("reads") < F.col("base_reads")) | (F.col("searches") < F.col("base_searches"))
    return (
        F.when(~F.col("valid"), INVALID)
        .when(F.col("base_correct") & ~F.col("correct"), REGRESSION)
        .when(~F.col("correct"), FAILURE)
        .when(less, LESS_EXPLORATION)
        .otherwise(NO_REDUCTION)
    )


def area_coverage(references: DataFrame) -> DataFrame:
    """Areas of tasks from rows (task, area, option, satisfied): full if one option has all its references, partial if any is."""
    options = references.groupBy("task", "area", "option").agg(F.bool_and("satisfied").alias("whole"), F.bool_or("satisfied").alias("some"))
    return options.groupBy("task", "area").agg(F.bool_or("whole").alias("full"), (F.bool_or("some") & ~F.bool_or("whole")).alias("partial"))


# How much of what a run read had been delivered to it, and whether a path had been named.
COMPLETE, PARTIAL, ABSENT = "COMPLETE_IN_MCP", "PARTIAL_IN_MCP", "ABSENT_FROM_MCP"
NAMED, NOT_NAMED = "LOCATOR_PATH", "NON_LOCATOR_PATH"


def read_coverage(reads: DataFrame, deliveries: DataFrame, files: DataFrame) -> DataFrame:
    """reads (run_id, path) with coverage: whether deliveries of successful calls hold all lines of the file, some or none.

    deliveries have run_id, path, start, end and success; files path and line_count. A file that is
    not there is absent, as is one of which nothing was delivered.
    """
    keys = ["run_id", "path"]
    merged = intervals.merge(deliveries.where("success").select(*keys, "start", "end"), keys)
    inside = F.greatest(F.lit(0), F.least("end", "line_count") - F.greatest("start", F.lit(1)) + 1)
    lengths = files.select("path", F.col("line_count").cast("long").alias("line_count"))
    covered = merged.join(lengths, "path").groupBy(*keys, "line_count").agg(F.sum(inside).alias("n"))
    known = covered.select(*keys, F.when(F.col("n") >= F.col("line_count"), COMPLETE).otherwise(PARTIAL).alias("coverage"))
    return reads.join(known, keys, "left").withColumn("coverage", F.coalesce("coverage", F.lit(ABSENT)))


def named_reads(reads: DataFrame, named: DataFrame) -> DataFrame:
    """reads (run_id, path) with membership: whether a run's locator names the path; named has run_id and path."""
    marked = named.select("run_id", "path").distinct().withColumn("membership", F.lit(NAMED))
    return reads.join(marked, ["run_id", "path"], "left").withColumn("membership", F.coalesce("membership", F.lit(NOT_NAMED)))


def samples_at(events: DataFrame, samples: DataFrame, time: str, order: list[str], values: list[str]) -> DataFrame:
    """events with the values of the last sample (by order) taken at the very time of each; null where there is none."""
    last = samples.groupBy(time).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last"))
    return events.join(last.select(time, "last.*"), time, "left")


def malformed(lines: DataFrame) -> DataFrame:
    """Rows (run_id, line_no, problem) of lines (run_id, line_no, value) that a strict reader refuses."""
    json_value = F.get_json_object("value", "$")
    problem = F.when(json_value.isNull(), "malformed").when(~json_value.startswith("{"), "not an object")
    return lines.where(F.trim("value") != "").select("run_id", "line_no", problem.alias("problem")).where("problem is not null")


_BLOCKS = "array<struct<type:string,name:string,input:string>>"
_COUNTERS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")


def fold_streams(lines: DataFrame) -> DataFrame:
    """One row a run from the second kind of log (run_id, line_no, value): messages with blocks, then a result.

    The last result and the last names win. Without usage in a result the messages' counters are
    added up, each null if no message has it. Lines that are no objects are counted and skipped.
    """
    field = lambda path: F.get_json_object("value", path)
    whole = lambda path: F.when(numbers.json_count("value", path) >= 0, numbers.json_count("value", path))
    usage = lambda at: [whole(f"{at}.{c}").alias(c) for c in _COUNTERS]
    blank = F.trim("value") == ""
    ok = F.coalesce(field("$").startswith("{"), F.lit(False))
    parsed = lines.where(~blank).select(
        "run_id", "line_no", ok.alias("ok"), field("$.type").alias("type"), field("$.session_id").alias("session"),
        field("$.message.model").alias("model"), F.struct(*usage("$.message.usage")).alias("said"), F.struct(*usage("$.usage")).alias("told"),
        field("$.message.usage").isNotNull().alias("says"), field("$.usage").isNotNull().alias("tells"),
        field("$.is_error").alias("is_error"), field("$.subtype").alias("subtype"), field("$.result").alias("result"),
        whole("$.duration_ms").alias("duration_ms"), whole("$.num_turns").alias("turns"),
        F.from_json(field("$.message.content"), _BLOCKS).alias("blocks"),
    )
    message, result = F.col("ok") & (F.col("type") == "assistant"), F.col("ok") & (F.col("type") == "result")
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("line_no")))
    failed = (F.col("is_error") == "true") | (F.coalesce("subtype", F.lit("success")) != "success")
    sums = [F.sum(F.when(message & F.col("says"), F.col(f"said.{c}"))).alias(c) for c in _COUNTERS]
    folded = parsed.groupBy("run_id").agg(
        F.count_if(~F.col("ok")).alias("n_malformed"),
        last(F.col("session"), F.col("ok") & F.col("session").isNotNull()).alias("session"),
        last(F.col("model"), message & F.col("model").isNotNull()).alias("model"),
        last(F.when(F.coalesce(failed, F.lit(False)), "error").otherwise("success"), result).alias("status"),
        last(F.struct("result", "duration_ms", "turns"), result).alias("end"),
        last(F.col("told"), result & F.col("tells")).alias("told"),
        F.struct(*sums).alias("said"),
    )
    actions = stream_actions(parsed.where(message))
    used = actions.groupBy("run_id").agg(
        F.count("*").alias("n_actions"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("read", "search", "listing", "edit", "write", "bash")]
    )
    again = rereads(actions.where("kind = 'read' and path is not null"), "run_id", "path").select("run_id", "n_rereads")
    counts = [c for c in used.columns if c != "run_id"] + ["n_rereads"]
    whole_run = folded.join(used, "run_id", "left").join(again, "run_id", "left")
    return whole_run.select(
        "run_id", "n_malformed", "session", "model", F.coalesce("status", F.lit("incomplete")).alias("status"), "end.*",
        F.coalesce("told", "said").alias("usage"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
    ).select("*", "usage.*").drop("usage")


def stream_actions(messages: DataFrame) -> DataFrame:
    """Rows (run_id, line_no, place, tool, kind, path): the tool calls among the blocks of messages."""
    each = messages.select("run_id", "line_no", F.posexplode("blocks").alias("place", "block"))
    calls = each.where("block.type = 'tool_use' and block.name is not null")
    kind = tool_kind(F.col("block.name"))
    path = F.get_json_object("block.input", "$.file_path")
    named = F.when(kind.isin("read", "edit", "write") & (path != ""), path)
    return calls.select("run_id", "line_no", "place", F.col("block.name").alias("tool"), kind.alias("kind"), named.alias("path"))


# Flags after which a search prints no lines, and flags that take no value.
SILENT_FLAGS = ("-l", "--files-with-matches", "-L", "--files-without-match", "-c", "--count", "-q", "--quiet", "--files")
PLAIN_FLAGS = ("-n", "--line-number", "-i", "--ignore-case", "--hidden", "--no-heading", "-F", "--fixed-strings", "--")


def searches(commands: DataFrame, longest: int | None = None) -> DataFrame:
    """Of rows (run_id, command) those that search: kind, whether lines are printed, targets, and whether all is searched.

    A shell's own command is looked into, one level deep. Commands that pipe, chain or redirect are left out, as are
    those of more than longest characters if it is given. A flag that is not known may take a value, so
    after it no word can be told to be a target; such a search has none and does not count as wide.
    Secrets are redacted in command, and a target that holds one is none.
    """
    run = commands.withColumn("run", C.unwrapped("command")).where(C.is_single("run"))
    if longest is not None:
        run = run.where(F.length("command") <= longest)
    cut = run.withColumn("tokens", C.words("run")).where(F.size("tokens") > 0)
    unquoted, verb = C.unquoted, C.program(F.col("tokens"))
    args = F.slice("tokens", 2, F.size("tokens"))
    is_git = (verb == "git") & (F.lower(F.col("tokens")[1]) == "grep")
    known = cut.withColumn("verb", F.when(F.get(F.col("tokens"), F.lit(1)).isNotNull() & is_git, "git grep").otherwise(verb))
    known = known.where(F.col("verb").isin("rg", "grep", "git grep", "select-string"))
    known = known.withColumn("args", F.when(F.col("verb") == "git grep", F.slice("tokens", 3, F.size("tokens"))).otherwise(args))
    lowered = F.transform("args", lambda a: F.lower(a))
    silent = F.arrays_overlap("args", F.array(*map(F.lit, SILENT_FLAGS)))
    listing = (F.col("verb") == "rg") & F.array_contains("args", "--files")
    unsure = F.exists("args", lambda a: a.startswith("-") & ~a.isin(*PLAIN_FLAGS))
    words = F.filter("args", lambda a: ~a.startswith("-"))
    split = F.array_position("args", F.lit("--"))
    given = F.filter(F.transform("args", lambda a, i: F.struct(a.alias("a"), F.get(lowered, i - 1).alias("before"))), lambda p: p["before"].isin("-path", "-literalpath"))
    by_verb = (
        F.when(F.col("verb") == "git grep", F.when(split > 0, F.slice("args", (split + 1).cast("int"), F.size("args"))))
        .when(F.col("verb") == "select-string", F.transform(given, lambda p: p["a"]))
        .when(~unsure & (F.size(words) > 0), F.slice(words, 2, F.size(words)))
    )
    none = F.array().cast("array<string>")
    prints = (
        F.when(F.col("verb") == "git grep", ~silent)
        .when(F.col("verb") == "select-string", F.array_contains(lowered, "-pattern") & ~F.arrays_overlap(lowered, F.array(F.lit("-quiet"), F.lit("-list"))))
        .otherwise(F.arrays_overlap("args", F.array(F.lit("-n"), F.lit("--line-number"))) & ~silent)
    )
    told = F.col("verb").isin("git grep", "select-string") | (~unsure & (F.size(words) > 0))
    found = known.select(
        "run_id", T.redacted("command").alias("command"), F.when(listing, "file_listing_search").otherwise("search").alias("kind"), (prints & ~listing).alias("prints"),
        F.when(listing, none).otherwise(F.coalesce(F.transform(by_verb, unquoted), none)).alias("targets"), (told & ~listing).alias("told"),
    )
    clean = F.filter("targets", lambda t: (t != "") & ~t.rlike(r"[*?\[\]$`%\r\n]") & ~t.rlike(r"(^|/)\.\.(/|$)") & (T.redacted(t) == t))
    wide = F.col("told") & ((F.size("targets") == 0) | F.array_contains("targets", "."))
    return found.withColumn("wide", wide).withColumn("targets", F.array_distinct(F.filter(clean, lambda t: t != "."))).drop("told")


def search_summary(found: DataFrame, paths: DataFrame) -> DataFrame:
    """For each run of searches how many print lines, name a file, cover everything or list files, and the paths they name.

    paths (path, is_folder) are those that exist; a folder's name ends with a slash here.
    """
    each = found.withColumn("id", F.monotonically_increasing_id()).select("*", F.explode_outer("targets").alias("target"))
    there = paths.select(F.col("path").alias("target"), F.when(F.col("is_folder"), F.concat("path", F.lit("/"))).otherwise(F.col("path")).alias("named"))
    each = each.withColumn("target", F.regexp_replace("target", r"^\./|/$", "")).join(there, "target", "left")
    one = each.groupBy("run_id", "id", "kind", "prints", "wide").agg(
        F.collect_set("named").alias("named"), F.coalesce(F.bool_or(~F.col("named").endswith("/")), F.lit(False)).alias("has_file")
    )
    return one.groupBy("run_id").agg(
        F.count_if("prints").alias("content_search_calls"), F.count_if("has_file").alias("file_targeted_searches"),
        F.count_if("wide").alias("repository_wide_searches"), F.count_if(F.col("kind") == "file_listing_search").alias("file_listing_searches"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("named")))).alias("searched_paths"),
    )


def read_paths(commands: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """commands (command, ...) with path and place for each different file (path) that one reads by name; others are left out.

    A name counts only if it means a file that is there, below root. place orders the paths of a command: by form, then
    as they are written. Names are looked up by a join of equality; null commands read nothing.
    """
    named = F.array_distinct(F.array_compact(F.transform(C.names_read(F.coalesce(C.unwrapped("command"), "command")), lambda n: C.inside(n, root))))
    each = commands.select("*", F.posexplode(named).alias("place", "path"))
    return each.join(files.select("path").distinct(), "path", "left_semi").select(*commands.columns, "place", "path")
