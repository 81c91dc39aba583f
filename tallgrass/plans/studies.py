"""Queries that weigh evidence: digests in printed lines, cited spans, totals without a part, counters against traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diagnostics, evidence, studies, telemetry
from ..operators.storage import stored
from ..sources.tables import table
from .packs import _part_edges
from .retrieval import _part_signals, range_allocation, sql_terms


def command_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Commands that read documents as files, a run a source: which file each reads."""
    docs = table(spark, sf, "documents")
    name = F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    forms = ("cat %s", "pwsh -Command \"Get-Content -Path './%s'\"", "python -c \"open('%s', 'w')\"", "type \"src/../%s\" | more", "cat ../%s", "python -c \"Path('%s').read_text()\"")
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("doc_id") % len(forms) + 1).cast("int"))
    commands = docs.select(F.col("source").alias("run_id"), F.replace(form, F.lit("%s"), name).alias("command"))
    found = telemetry.read_paths(commands, docs.select(name.alias("path")))
    return found.groupBy("run_id").agg(F.count("*").alias("n_reads"), F.count_distinct("path").alias("n_paths"), F.min("path").alias("first_path"))


COMMAND_READS = """
SELECT source AS run_id, count(*) AS n_reads, count(DISTINCT doc_id) AS n_paths, min('src/' || source || '/' || doc_id || '.txt') AS first_path
FROM documents WHERE source IS NOT NULL AND doc_id % 6 NOT IN (2, 4) GROUP BY source
"""

_LISTING = (
    "%d  %p",  # on one line
    "%p\n%d",  # on the next line
    "%p docs/0.txt %d",  # two paths on a line
    "\n.\\%P: %d\n",  # apart from others, in another spelling
)


def hash_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Listings of documents' digests, twenty documents each, printed in four ways: whose digest can be told to be theirs."""
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    way = F.element_at(F.array(*map(F.lit, _LISTING)), (F.col("doc_id") % len(_LISTING) + 1).cast("int"))
    shown = F.replace(F.replace(F.replace(way, F.lit("%P"), F.replace(F.upper(path), F.lit("/"), F.lit("\\"))), F.lit("%p"), path), F.lit("%d"), digest)
    lines = docs.select("doc_id", F.floor(F.col("doc_id") / 20).alias("output_id"), shown.alias("shown"))
    both = lines.groupBy("output_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "shown"))).alias("all"))
    outputs = both.select((F.col("output_id") % 5).alias("run_id"), "output_id", F.array_join("all.shown", "\n").alias("text"))
    return evidence.printed(outputs, docs.select(path.alias("path"), digest.alias("digest")))


HASH_EVIDENCE = r"""
WITH d AS (SELECT doc_id, doc_id // 20 AS output_id, 'docs/' || doc_id || '.txt' AS path, sha256(coalesce(text, '')) AS digest FROM documents),
o AS (SELECT output_id, string_agg(CASE doc_id % 4 WHEN 0 THEN digest || '  ' || path WHEN 1 THEN path || chr(10) || digest
        WHEN 2 THEN path || ' docs/0.txt ' || digest ELSE chr(10) || '.\' || replace(upper(path), '/', '\') || ': ' || digest || chr(10) END,
        chr(10) ORDER BY doc_id) AS text FROM d GROUP BY output_id),
l AS (SELECT output_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM o),
x AS (SELECT output_id, n, unnest(list_distinct(regexp_extract_all(replace(lower(line), '\', '/'), 'docs/[0-9]+\.txt'))) AS path FROM l),
p AS (SELECT x.output_id, n, list(path) AS paths FROM x JOIN d USING (path) GROUP BY x.output_id, n),
m AS (SELECT output_id, n, coalesce(paths, []) AS paths, regexp_extract_all(line, '[0-9a-f]{64}') AS digests FROM l LEFT JOIN p USING (output_id, n)),
w AS (SELECT *, list_distinct(flatten(list(paths) OVER near)) AS near_paths, flatten(list(digests) OVER near) AS near_digests
      FROM m WINDOW near AS (PARTITION BY output_id ORDER BY n ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT DISTINCT w.output_id % 5 AS run_id, d.path FROM w JOIN d ON list_contains(w.paths, d.path)
WHERE (len(paths) = 1 AND list_contains(digests, digest)) OR (len(near_paths) = 1 AND list_contains(near_digests, digest))
"""


def _cited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Line items as cited spans, and shifted ones as hints; suppliers are files of sixty lines with one class."""
    items = table(spark, sf, "lineitem").select("*", (F.col("l_orderkey") % 500).alias("task"), F.col("l_suppkey").alias("path"))
    start = F.col("l_linenumber").cast("long") * 8
    spans = items.select(
        "task", F.col("l_linestatus").alias("area"), (F.col("l_partkey") % 3).alias("option"), "path", F.col("l_returnflag").alias("symbol"),
        start.alias("start"), (start + F.col("l_quantity").cast("long") % 9).alias("end"),
    ).where("l_partkey % 5 = 0")
    first = F.when(F.col("l_partkey") % 11 == 0, 1).otherwise(start + F.col("l_partkey") % 17)
    symbol = F.when(F.col("l_linenumber") % 3 == 0, "R").otherwise(F.col("l_returnflag"))
    hints = items.where("l_partkey % 4 <> 0").select(
        "task", "path", symbol.alias("symbol"), first.alias("start"), F.when(F.col("l_partkey") % 11 == 0, 60).otherwise(first + 6).alias("end")
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"))
    return spans, hints, suppliers.withColumn("line_count", F.lit(60)), suppliers.select("path", F.lit("R").alias("qualified_name"), F.lit("class").alias("kind"))


def arm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Spans and areas of tasks by how well hints lead to them."""
    spans, hints, files, symbols = _cited(spark, sf)
    found = studies.arm_scores(spans, studies.span_scores(spans, hints, files, symbols), spans.where("task % 10 = 0").select("task"))
    return found


ARM_SCORES = """
WITH i AS (SELECT *, l_orderkey % 500 AS task, l_suppkey AS path, l_linenumber::BIGINT * 8 AS s FROM lineitem),
r AS (SELECT task, l_linestatus AS area, l_partkey % 3 AS option, path, l_returnflag AS symbol, s, s + l_quantity::BIGINT % 9 AS e FROM i WHERE l_partkey % 5 = 0),
h AS (SELECT DISTINCT task, path, CASE WHEN l_linenumber % 3 = 0 THEN 'R' ELSE l_returnflag END AS symbol,
             CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE s + l_partkey % 17 END AS s, CASE WHEN l_partkey % 11 = 0 THEN 60 ELSE s + l_partkey % 17 + 6 END AS e
      FROM i WHERE l_partkey % 4 <> 0),
u AS (SELECT DISTINCT task, path, symbol, s, e FROM r),
m AS (SELECT u.*, count(h.task) > 0 AS path_targeted, coalesce(bool_or(h.s <= u.e AND h.e >= u.s), false) AS range_intersects,
             coalesce(bool_or(h.symbol = u.symbol), false) AS exact_symbol_match,
             coalesce(bool_or(h.symbol = u.symbol AND h.s <= u.e AND h.e >= u.s), false) AS precise,
             coalesce(bool_or(h.s <= u.e AND h.e >= u.s AND (h.symbol = 'R' OR (h.s = 1 AND h.e >= 60))), false) AS broad
      FROM u LEFT JOIN h ON u.task = h.task AND u.path = h.path GROUP BY u.task, u.path, u.symbol, u.s, u.e),
a AS (SELECT task, area, bool_or(whole) AS complete FROM (
        SELECT task, area, option, bool_and(precise) AS whole FROM r JOIN m USING (task, path, symbol, s, e) GROUP BY task, area, option) GROUP BY task, area),
t AS (SELECT task, count(*) AS n_areas, count(*) FILTER (complete) AS n_complete, bool_and(complete) AS complete_task FROM a WHERE task % 10 <> 0 GROUP BY task)
SELECT m.task, count(*) AS cited_spans, count(*) FILTER (path_targeted) AS path_targeted_spans, count(*) FILTER (range_intersects) AS range_intersects_spans,
       count(*) FILTER (exact_symbol_match) AS exact_symbol_match_spans, count(*) FILTER (precise) AS precise_navigation_spans,
       count(*) FILTER (broad AND NOT precise) AS broad_overlap_only_spans, count(*) FILTER (range_intersects AND NOT precise) AS imprecise_overlap_only_spans,
       count(DISTINCT path) AS n_paths, count(DISTINCT CASE WHEN path_targeted THEN path END) AS n_paths_targeted,
       any_value(n_areas) AS n_areas, any_value(n_complete) AS n_complete, any_value(complete_task) AS complete_task
FROM m LEFT JOIN t ON m.task = t.task GROUP BY m.task
"""


def leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    """Mean length and share of English over all documents but those of each source."""
    return studies.leave_one_out(table(spark, sf, "documents"), "source", {"mean_chars": F.col("n_chars"), "share_en": F.col("lang") == "en"})


LEAVE_ONE_OUT = """
WITH s AS (SELECT DISTINCT source FROM documents)
SELECT s.source, count(d.doc_id) AS n_others, avg(d.n_chars)::DOUBLE AS mean_chars, avg(CASE d.lang WHEN 'en' THEN 1 ELSE CASE WHEN d.lang IS NOT NULL THEN 0 END END)::DOUBLE AS share_en
FROM s LEFT JOIN documents d ON d.source IS DISTINCT FROM s.source GROUP BY s.source
"""


def supplier_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' counters kept by orders no longer in progress, held against all of their line items."""
    items = table(spark, sf, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("long"))
    done = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    counters = items.join(done, "l_orderkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.sum("returned").alias("n_returned"))
    found = studies.parity(items, counters, "l_suppkey", {"n_lines": F.lit(1), "n_returned": F.col("returned")})
    return found.withColumn("diverges", F.array_join("diverges", ","))


SUPPLIER_PARITY = """
WITH t AS (SELECT l_suppkey, count(*) AS n_lines, count(*) FILTER (l_returnflag = 'R') AS n_returned,
                  count(*) FILTER (o_orderstatus <> 'P') AS told_lines, count(*) FILTER (l_returnflag = 'R' AND o_orderstatus <> 'P') AS told_returned
           FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey)
SELECT l_suppkey, n_lines, n_returned,
       concat_ws(',', CASE WHEN n_lines <> told_lines THEN 'n_lines' END, CASE WHEN n_returned <> told_returned THEN 'n_returned' END) AS diverges FROM t
"""


def locator_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """What the best twenty parts for each type rest on; parts are files in a folder a brand, names of theirs are symbols."""
    parts = table(spark, sf, "part")
    file = F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"))
    files = parts.select(F.col("p_partkey").cast("string").alias("path"), file.alias("file"), "p_type", "p_name", "p_size")
    words = _part_signals(spark, sf).select("query_id", "path", "kind", "key", "weight", "term")
    symbol = F.concat(F.lit("symbol:"), "p_name")
    exact = files.where("p_size % 10 = 0").select(
        F.col("p_type").alias("query_id"), "path", F.lit("exact_symbol").alias("kind"), symbol.alias("key"), F.lit(95.0).alias("weight"), F.lit(None).cast("string").alias("term")
    )
    signals = stored(words.unionByName(exact).join(files.select("path", "file", "p_size"), "path").drop("path").withColumnRenamed("file", "path"))
    candidates = signals.groupBy("query_id", "path").agg(F.sum("weight").alias("score"), F.first("p_size").alias("p_size"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    ranked = candidates.withColumn("place", place).where("place <= 20")
    role = F.when(F.col("place") <= 5, "PRIMARY").otherwise("RELATED")
    selected = stored(ranked.select("query_id", "path", "place", "score", role.alias("role"), (F.col("p_size") % 7 == 0).alias("is_test")))
    useful = parts.select(F.col("p_type").alias("query_id")).distinct().withColumn("term", F.explode(text.terms("query_id")))
    symbol_files = parts.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n_files"))
    named = files.select("path", "file")
    edges = _part_edges(spark, sf).join(named.toDF("source", "a"), "source").join(named.toDF("target", "b"), "target")
    edges = edges.select(F.col("a").alias("source"), F.col("b").alias("target"), "kind")
    return diagnostics.locator(selected, candidates, signals, useful, symbol_files, edges)


LOCATOR = f"""
WITH RECURSIVE f AS (SELECT p_partkey, p_brand || '/' || p_partkey AS path, p_type, p_name, p_size FROM part),
u AS (SELECT p_type AS query_id, unnest({sql_terms('p_type')}) AS term FROM (SELECT DISTINCT p_type FROM part)),
wd AS (SELECT path, 'filename_term' AS kind, 28.0::DOUBLE AS weight, unnest({sql_terms('p_name')}) AS term FROM f
       UNION ALL SELECT path, 'path_term', 8.0::DOUBLE, unnest({sql_terms('p_type')}) FROM f),
sg AS (SELECT query_id, path, max_by(kind, weight) AS kind, max(weight) AS weight, term FROM u JOIN wd USING (term) GROUP BY query_id, path, term
       UNION ALL SELECT p_type, path, 'exact_symbol', 95.0::DOUBLE, NULL FROM f WHERE p_size % 10 = 0),
nm AS (SELECT p_name, count(*) AS n_files FROM part GROUP BY p_name),
ex AS (SELECT p_type AS query_id, path, n_files FROM f JOIN nm USING (p_name) WHERE p_size % 10 = 0),
c AS (SELECT query_id, path, sum(weight) AS score FROM sg GROUP BY query_id, path),
s AS (SELECT query_id, path, score, place, p_size % 7 = 0 AS is_test FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS place FROM c) JOIN f USING (path) WHERE place <= 20),
pe AS (SELECT s.query_id, s.path, s.place, s.is_test, coalesce(bool_or(kind <> 'path_term'), false) AS direct, coalesce(bool_or(kind = 'path_term'), false) AS weak,
              coalesce(bool_or(kind = 'filename_term'), false) AS worded, coalesce(any_value(ex.n_files), 0) AS n_files, count(*) AS n_signals
       FROM s JOIN sg USING (query_id, path) LEFT JOIN ex USING (query_id, path) GROUP BY s.query_id, s.path, s.place, s.is_test),
pl AS (SELECT *, CASE WHEN n_files = 1 THEN 1 WHEN worded THEN 2 WHEN n_files > 1 THEN 3 WHEN weak THEN 4 ELSE 6 END AS level FROM pe),
k AS (SELECT query_id, count(*) FILTER (place <= 5) AS n_primary, count(*) FILTER (place > 5) AS n_related, count(*) FILTER (is_test) AS n_test,
             count(*) FILTER (direct) AS direct_paths, count(*) FILTER (NOT direct) AS weak_only_paths, 0::BIGINT AS graph_expanded,
             count(*) FILTER (n_files = 1) AS unique_symbol_paths, count(*) FILTER (n_files > 1) AS ambiguous_symbol_paths, count(*) FILTER (n_files > 1) AS ambiguous_only_paths,
             count(*) FILTER (level = 1) AS very_strong, count(*) FILTER (level = 2) AS strong, count(*) FILTER (level = 3) AS ambiguous_direct,
             count(*) FILTER (level = 4) AS weak, 0::BIGINT AS graph, count(*) FILTER (level = 6) AS none, sum(n_signals)::BIGINT AS n_signals FROM pl GROUP BY query_id),
tm AS (SELECT query_id, term, bool_or(kind = 'filename_term') AS direct, min(place) AS first FROM s JOIN sg USING (query_id, path) WHERE term IS NOT NULL GROUP BY query_id, term),
cv AS (SELECT query_id, count(*) AS n_useful, count(tm.term) AS n_supported, count(*) FILTER (direct) AS n_direct, count(DISTINCT first) AS n_novel_paths
       FROM (SELECT DISTINCT * FROM u) LEFT JOIN tm USING (query_id, term) GROUP BY query_id),
ct AS (SELECT query_id, count(*) AS n_candidates, max(score) AS top_score FROM c GROUP BY query_id),
sc AS (SELECT query_id, n_candidates, top_score, count(*) AS n_selected, quantile_cont(score, 0.5) AS median_score, min(score) AS least_score,
              count(*) FILTER (score >= top_score * 0.5) / count(*) AS within_50_percent, count(*) FILTER (score >= top_score * 0.75) / count(*) AS within_75_percent,
              count(*) FILTER (score >= top_score * 90 / 100) / count(*) AS within_90_percent, quantile_cont(score, 0.5) / top_score AS median_to_top
       FROM s JOIN ct USING (query_id) GROUP BY query_id, n_candidates, top_score),
fo AS (SELECT query_id, count(*) AS n_folders, count(*) / sum(n)::BIGINT AS dispersion, max(n) / sum(n)::BIGINT AS largest_folder_share
       FROM (SELECT query_id, split_part(path, '/', 1) AS folder, count(*) AS n FROM s GROUP BY ALL) GROUP BY query_id),
ln AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
e AS (SELECT DISTINCT x.path AS a, y.path AS b FROM ln JOIN f x ON x.p_partkey = a JOIN f y ON y.p_partkey = b WHERE ln.a <> ln.b),
g AS (SELECT query_id, e.a, e.b FROM e JOIN s ON s.path = e.a WHERE (query_id, e.b) IN (SELECT query_id, path FROM s)),
g2 AS (SELECT query_id, a, b FROM g UNION SELECT query_id, b, a FROM g),
r(query_id, path, seen) AS (SELECT query_id, path, path FROM s UNION SELECT r.query_id, r.path, g2.b FROM r JOIN g2 ON g2.query_id = r.query_id AND g2.a = r.seen),
cl AS (SELECT query_id, count(*) AS n_clusters, max(n) / sum(n)::BIGINT AS largest_cluster_share FROM (
         SELECT query_id, root, count(*) AS n FROM (SELECT query_id, path, min(seen) AS root FROM r GROUP BY ALL) GROUP BY ALL) GROUP BY query_id)
SELECT sc.*, k.* EXCLUDE query_id, cv.* EXCLUDE query_id, n_supported / n_useful AS coverage, n_direct / n_useful AS direct_coverage, fo.* EXCLUDE query_id, cl.* EXCLUDE query_id,
       direct_paths / n_selected AS direct_ratio, weak_only_paths / n_selected AS weak_only_ratio, n_novel_paths / n_selected AS novel_path_ratio
FROM sc JOIN k USING (query_id) JOIN cv USING (query_id) JOIN fo USING (query_id) JOIN cl USING (query_id)
"""


def path_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Why parts were left out of the allocation of their type, path by path."""
    return diagnostics.path_decisions(range_allocation(spark, sf)).withColumn("phases", F.array_join("phases", ","))


PLANS = {
    "command_reads": (command_reads, COMMAND_READS),
    "hash_evidence": (hash_evidence, HASH_EVIDENCE),
    "arm_scores": (arm_scores, ARM_SCORES),
    "leave_one_out": (leave_one_out, LEAVE_ONE_OUT),
    "locator_diagnostics": (locator_diagnostics, LOCATOR),
    "path_decisions": (path_decisions, None),
    "supplier_parity": (supplier_parity, SUPPLIER_PARITY),
}
