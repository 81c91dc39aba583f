"""Scores of studies: cited spans against hints, totals without parts of the data, and counters held against traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

# What a hint is that covers too much.
WHOLE_FILE, CLASS_RANGE = "WHOLE_FILE", "CLASS_RANGE"
SPAN = ("task", "path", "symbol", "start", "end")
MEASURES = ("path_targeted", "range_intersects", "exact_symbol_match", "precise_navigation", "broad_overlap_only", "imprecise_overlap_only")


def broadness(hints: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """hints (path, symbol, start, end, ...) with broad: the whole of a file, a class by name, or null.

    files have path and line_count, symbols path, qualified_name and kind; a hint on a path without a file is not broad.
    """
    lengths = files.groupBy("path").agg(F.max("line_count").alias("__lines"))
    classes = symbols.where("kind = 'class'").select("path", F.col("qualified_name").alias("symbol"), F.lit(True).alias("__class")).distinct()
    marked = hints.join(lengths, "path", "left").join(classes, ["path", "symbol"], "left")
    broad = F.when((F.col("start") == 1) & (F.col("end") >= F.col("__lines")), WHOLE_FILE)
    return marked.withColumn("broad", broad.when(F.col("__class") & F.col("__lines").isNotNull(), CLASS_RANGE)).select(*hints.columns, "broad")


def _touched(spans: DataFrame, hints: DataFrame, keys: list[str], name: str) -> DataFrame:
    """spans with a boolean name: whether a hint of the same keys overlaps.

    Hints sorted by start among spans sorted by end: a span is touched if the farthest end of the hints so far
    reaches its start. So no pair of span and hint is ever made.
    """
    ours = spans.withColumns({"__at": F.col("end"), "__hint": F.lit(0), "__reach": F.lit(None).cast("long")})
    theirs = hints.select(*keys, F.col("start").alias("__at"), F.lit(-1).alias("__hint"), F.col("end").cast("long").alias("__reach"))
    theirs = theirs.groupBy(*keys, "__at", "__hint").agg(F.max("__reach").alias("__reach"))
    so_far = Window.partitionBy(*keys).orderBy("__at", "__hint").rowsBetween(Window.unboundedPreceding, 0)
    both = ours.unionByName(theirs, allowMissingColumns=True).withColumn("__far", F.max("__reach").over(so_far))
    return both.where("__hint = 0").withColumn(name, F.coalesce(F.col("__far") >= F.col("start"), F.lit(False))).select(*spans.columns, name)


def span_scores(spans: DataFrame, hints: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each different cited span (task, path, symbol, start, end) with six booleans about the hints (same columns) of its task.

    Spans and hints hold no nulls. precise_navigation: a hint of the very symbol overlaps; broad_overlap_only: none does, but
    a whole file's or a class's hint overlaps.
    """
    each = spans.select(*SPAN).distinct()
    marked = broadness(hints.select(*SPAN).distinct(), files, symbols)
    each = _touched(each, marked, ["task", "path"], "range_intersects")
    each = _touched(each, marked, ["task", "path", "symbol"], "precise_navigation")
    each = _touched(each, marked.where("broad is not null"), ["task", "path"], "__broad")
    on_path = marked.select("task", "path").distinct().withColumn("path_targeted", F.lit(True))
    exact = marked.select("task", "path", "symbol").distinct().withColumn("exact_symbol_match", F.lit(True))
    each = each.join(on_path, ["task", "path"], "left").join(exact, ["task", "path", "symbol"], "left")
    each = each.fillna(False, ["path_targeted", "exact_symbol_match"]).withColumns({
        "broad_overlap_only": F.col("__broad") & ~F.col("precise_navigation"),
        "imprecise_overlap_only": F.col("range_intersects") & ~F.col("precise_navigation"),
    })
    return each.select(*SPAN, *MEASURES)


def arm_scores(references: DataFrame, scores: DataFrame, partial: DataFrame | None = None) -> DataFrame:
    """One row a task: its spans by measure, its paths, its areas, and whether all areas are complete.

    references are (task, area, option, and a span's columns); scores come from span_scores. An area is complete if one of its
    options has only precise spans. Tasks of partial (task) have null areas and no verdict.
    """
    keys = ["task", "path"]
    counts = [F.count_if(m).alias(f"{m}_spans") for m in MEASURES]
    paths = [F.count_distinct("path").alias("n_paths"), F.count_distinct(F.when(F.col("path_targeted"), F.col("path"))).alias("n_paths_targeted")]
    spans = scores.groupBy("task").agg(F.count("*").alias("cited_spans"), *counts, *paths)
    cited = references.select("task", "area", "option", *SPAN[1:]).join(scores.select(*SPAN, "precise_navigation"), list(SPAN))
    options = cited.groupBy("task", "area", "option").agg(F.bool_and("precise_navigation").alias("whole"))
    areas = options.groupBy("task", "area").agg(F.bool_or("whole").alias("complete"))
    tasks = areas.groupBy("task").agg(F.count("*").alias("n_areas"), F.count_if("complete").alias("n_complete"), F.bool_and("complete").alias("complete_task"))
    if partial is not None:
        tasks = tasks.join(partial.select("task").distinct(), "task", "left_anti")
    return spans.join(tasks, keys[:1], "left")


def sensitivity(areas: DataFrame, disputed: DataFrame) -> DataFrame:
    """One row: areas (task, area, full) that are full, and all of them, without the disputed (task, area)."""
    kept = areas.join(disputed.select("task", "area").distinct(), ["task", "area"], "left_anti")
    return kept.agg(F.count_if("full").alias("n_full"), F.count("*").alias("n_total"))


def leave_one_out(rows: DataFrame, group: str, sums: dict[str, Column]) -> DataFrame:
    """One row a group: how many rows the others have, and the mean of each of sums over the others.

    sums are whole numbers or booleans, so what is subtracted is exact; nulls count neither in sum nor in number. A mean
    over nothing is null. The others are never read again for a group: the totals are a
    subquery of one row over the groups' sums.
    """
    kept = {n: v.cast("long") for n, v in sums.items()}
    parts = [F.count("*").alias("__n"), *[f for n, v in kept.items() for f in (F.sum(v).alias(f"__s_{n}"), F.count(v).alias(f"__c_{n}"))]]
    each = rows.groupBy(group).agg(*parts)
    # Sums of all groups in wide decimals: they neither wrap nor round.
    wide = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)"))
    names = ["__n", *[f"__{k}_{n}" for n in kept for k in "sc"]]
    whole = each.agg(F.struct(*[wide(c).alias(c) for c in names]).alias("all")).scalar()
    each = each.withColumn("all", whole)
    rest = lambda c: F.col("all")[c] - F.coalesce(F.col(c), F.lit(0))
    means = [(F.when(rest(f"__c_{n}") > 0, rest(f"__s_{n}").cast("double") / rest(f"__c_{n}").cast("double"))).alias(n) for n in kept]
    return each.select(group, rest("__n").cast("long").alias("n_others"), *means)


def parity(steps: DataFrame, counters: DataFrame, run: str, sums: dict[str, Column]) -> DataFrame:
    """One row a run: each of sums over its steps, and the names of those that differ from the run's counters.

    counters have run and a column of each name. A run on one side only differs in all that is not zero or null there;
    repeated counters of a run are a fault of their own, named `repeated`.
    """
    traced = steps.groupBy(run).agg(*[F.sum(v).alias(f"__sum_{n}") for n, v in sums.items()])
    told = counters.groupBy(run).agg(F.count("*").alias("__told"), *[F.first(n).alias(n) for n in sums])
    both = traced.join(told, run, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    faults = [F.when(zero(f"__sum_{n}") != zero(n), F.lit(n)) for n in sums] + [F.when(F.col("__told") > 1, F.lit("repeated"))]
    return both.select(run, *[zero(f"__sum_{n}").alias(n) for n in sums], F.array_compact(F.array(*faults)).alias("diverges"))


def observed(rows: DataFrame, run: str, name: str) -> tuple[DataFrame, Observation]:
    """rows of parity, unchanged, and what is seen while an action reads them: n_runs, n_diverging and the first run that differs."""
    seen = Observation(name)
    differs = F.size("diverges") > 0
    return rows.observe(
        seen, F.count(F.lit(1)).alias("n_runs"), F.count_if(differs).alias("n_diverging"), F.min(F.when(differs, F.col(run))).alias("first_diverging")
    ), seen


def required(rows: DataFrame, run: str) -> DataFrame:
    """rows of parity; reading one that differs fails with the run and the counters by name."""
    said = F.concat(F.lit("run "), F.col(run).cast("string"), F.lit(" differs in "), F.concat_ws(", ", "diverges"))
    checked = F.when(F.size("diverges") > 0, F.raise_error(said).cast("array<string>")).otherwise(F.col("diverges"))
    return rows.withColumn("diverges", checked)


def study_summary(outcomes: DataFrame) -> DataFrame:
    """Rows by archetype and one over all (is_total) from outcomes (task, archetype, partial, n_gained, n_lost, within_budget).

    Gains and losses of partial tasks do not count.
    """
    whole = lambda c: F.coalesce(F.sum(F.when(~F.col("partial"), F.col(c))), F.lit(0)).cast("long").alias(c)
    return outcomes.rollup("archetype").agg(
        (F.grouping("archetype") == 1).alias("is_total"), F.count("*").alias("n_tasks"), F.count_if("partial").alias("n_partial"),
        whole("n_gained"), whole("n_lost"), F.count_if("within_budget").alias("n_within_budget"),
    )
