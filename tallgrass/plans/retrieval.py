"""Text, ranking, graph and snapshot queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import allocation, compaction, graph, packing, relevance, snapshots, windows
from ..operators.storage import stored
from ..sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def sql_terms(column: str) -> str:
    """The terms of a column in SQL, as functions.text.terms has them."""
    cut = rf"regexp_replace(regexp_replace({column}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    return f"list_filter(list_distinct(regexp_split_to_array(lower({cut}), '[^a-z0-9]+')), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"


def token_estimate_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(text.token_estimate("text")).alias("n_tokens"))


TOKEN_ESTIMATE = """
SELECT lang, count(*) AS n_docs, sum((strlen(text) + 3) // 4)::BIGINT AS n_tokens FROM documents GROUP BY lang
"""


def file_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    lines = F.size(F.split("text", "\n")) - F.when(F.col("text").endswith("\n"), 1).otherwise(0)
    return docs.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("size"),
        F.sha2("text", 256).alias("sha256"),
        F.when(F.col("text") == "", 0).otherwise(lines).cast("long").alias("line_count"),
        F.contains("text", F.lit("\0")).alias("is_binary"),
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
    )


FILE_FINGERPRINTS = r"""
SELECT doc_id, strlen(text)::BIGINT AS size, sha256(text) AS sha256,
       (CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - (CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END) END)::BIGINT AS line_count,
       contains(text, chr(0)) AS is_binary,
       source || '/' || lang || '/' || doc_id || '.txt' AS path
FROM documents
"""


def term_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(text.terms("text")).alias("term"))
    return relevance.document_frequency(words)


TERM_FREQUENCY = f"""
SELECT term, count(*) AS df FROM (SELECT unnest({sql_terms('text')}) AS term FROM documents) GROUP BY term
"""


def useful_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    words = docs.select(F.explode(text.terms("text")).alias("term"))
    asked = items.select("item_id", F.explode(text.terms("text")).alias("term"))
    counted = words.join(asked.select("term").distinct(), "term", "left_semi")
    return relevance.useful_terms(asked, relevance.document_frequency(counted), docs.count()).select("item_id", "term", "df")


_ASKED = f"""
WITH words AS (SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents),
frequency AS (SELECT term, count(*) AS df FROM words GROUP BY term),
asked AS (SELECT item_id, unnest({sql_terms('text')}) AS term FROM benchmark),
useful AS (
  SELECT item_id, a.term, coalesce(df, 0) AS df FROM asked a LEFT JOIN frequency USING (term)
  WHERE coalesce(df, 0) <= greatest(3, floor(0.3 * (SELECT count(*) FROM documents))))
"""
USEFUL_TERMS = _ASKED + "SELECT item_id, term, df FROM useful"


def relevance_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = relevance.passage_top_k(table(spark, sf, "benchmark"), table(spark, sf, "documents"))
    return found.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


RELEVANCE_TOPK = _ASKED + """,
scored AS (
  SELECT item_id, doc_id, sum(CASE WHEN df <= 2 THEN 12 ELSE 5 END)::BIGINT AS score
  FROM useful JOIN words USING (term) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 10
"""


def signal_dedupe_max(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files and types as queries: a term of the name outweighs one of the brand under the same key."""
    return _part_signals(spark, sf).groupBy("query_id", "path").agg(
        F.sum("weight").alias("score"), F.count("*").alias("n_signals"), F.max_by("kind", "weight").alias("best_kind")
    )


def _part_signals(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    asked = parts.select(F.col("p_type").alias("query_id")).distinct().withColumn("term", F.explode(text.terms("query_id")))
    in_name = parts.select(F.col("p_partkey").cast("string").alias("path"), F.explode(text.terms("p_name")).alias("term"))
    in_type = parts.select(F.col("p_partkey").cast("string").alias("path"), F.explode(text.terms("p_type")).alias("term"))
    kinds = {"filename_term": in_name, "path_term": in_type}
    rows = None
    for kind, words in kinds.items():
        found = relevance._signals(asked.join(words, "term"), kind, relevance._term_key())
        rows = found if rows is None else rows.unionByName(found)
    return relevance.strongest(rows)


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """Documents as source files in a folder a source: files, symbols (first words of documents), imports and edges between neighbours."""
    docs = table(spark, sf, "documents")
    path = lambda i: F.concat(F.lit("src/"), "source", F.lit("/part_"), i.cast("string"), F.lit(".py"))
    lines = F.size(F.split("text", "\n"))
    files = docs.select(path(F.col("doc_id")).alias("path"), "text", (F.col("doc_id") % 10 == 0).alias("is_test"), lines.alias("line_count"), "doc_id", "source")
    name = F.lower(F.regexp_extract("text", r"([A-Za-z]\w+)", 1))
    symbols = files.select(
        "path", name.alias("name"), F.concat_ws(".", "source", name).alias("qualified_name"), F.lit(1).alias("start_line"), F.least("line_count", F.lit(10)).alias("end_line")
    ).where("name <> ''")
    imports = files.select("path", F.col("source").alias("module"), F.lit(None).cast("string").alias("name"))
    back = files.select((F.col("doc_id") + 1).alias("doc_id"), F.col("path").alias("target"), F.col("is_test").alias("target_test"))
    near = files.join(back, "doc_id")
    edges = near.select(F.col("path").alias("source"), "target", F.lit("IMPORTS").alias("kind"))
    tests = near.where("is_test and not target_test").select(F.col("path").alias("source"), "target", F.lit("TESTS").alias("kind"))
    return files, symbols, imports, edges.union(tests)


def _ranked(spark: SparkSession, sf: str, tree: tuple[DataFrame, ...]) -> DataFrame:
    none = F.array().cast("array<string>")
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("task"), F.lit("").alias("error_text"), none.alias("paths"), none.alias("symbols"), none.alias("changed")
    )
    files, symbols, imports, edges = tree
    return relevance.rank(asked, files.select("path", "text", "is_test"), symbols, imports, edges)


def full_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as tasks over documents as files, by all kinds of matches."""
    found = _ranked(spark, sf, _tree(spark, sf))
    return found.select("query_id", "path", "score", "role", "rank", F.size("signals").alias("n_signals"))


def packed_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """What a budget takes of the ranges of full_ranking, and what it avoids, for each passage."""
    tree = _tree(spark, sf)
    ranked = stored(_ranked(spark, sf, tree))  # the pack reads it several times
    return packing.pack_metrics(packing.pack(ranked, tree[1], tree[0].select("path", "text", "line_count")))


def range_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best parts of each type as ranges of p_size lines, chosen under a budget; a choice step by step, beyond SQL."""
    ranked = relevance.top_k(_part_signals(spark, sf), 20)
    size = F.col("p_size").cast("long")
    parts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), size.alias("size"))
    ranges = ranked.join(parts, "path").select(
        "query_id", "path", F.lit(1).cast("long").alias("start"), F.col("size").alias("end"), (F.col("size") * 10).alias("cost"),
        (F.col("size") == 7).alias("required"), (F.col("size") % 5 == 0).alias("anchor"), F.lit(False).alias("is_test"),
        (F.col("size") % 11 != 0).alias("affinity"), "score", "signals",
    )
    return allocation.allocate(ranges, 1500)


SIGNAL_DEDUPE = f"""
WITH asked AS (SELECT p_type AS query_id, unnest({sql_terms('p_type')}) AS term FROM (SELECT DISTINCT p_type FROM part)),
words AS (
  SELECT p_partkey::VARCHAR AS path, 'filename_term' AS kind, 28.0::DOUBLE AS weight, unnest({sql_terms('p_name')}) AS term FROM part
  UNION ALL
  SELECT p_partkey::VARCHAR, 'path_term', 8.0::DOUBLE, unnest({sql_terms('p_type')}) FROM part),
best AS (
  SELECT query_id, path, term, max(weight) AS weight, max_by(kind, weight) AS kind
  FROM asked JOIN words USING (term) GROUP BY query_id, path, term)
SELECT query_id, path, sum(weight) AS score, count(*) AS n_signals, max_by(kind, weight) AS best_kind
FROM best GROUP BY query_id, path
"""


def exact_symbol_join(spark: SparkSession, sf: str) -> DataFrame:
    """Names that pages mark as code or headings and conversations mention: equality of identifiers."""
    said = table(spark, sf, "conversations").select("conv_id", F.explode(text.identifiers("text")).alias("identifier")).distinct()
    asked = table(spark, sf, "benchmark").select("item_id", F.explode(text.identifiers("text")).alias("identifier")).distinct()
    return asked.join(said, "identifier").groupBy("item_id").agg(
        F.count("*").alias("n_matches"), F.countDistinct("conv_id").alias("n_conversations"), F.min("identifier").alias("first_identifier")
    )


EXACT_SYMBOL = rf"""
WITH said AS (SELECT DISTINCT conv_id, identifier FROM (
    SELECT conv_id, unnest(regexp_extract_all(text, '[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*')) AS identifier FROM conversations) WHERE identifier NOT IN ({_STOP})),
asked AS (SELECT DISTINCT item_id, identifier FROM (
    SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*')) AS identifier FROM benchmark) WHERE identifier NOT IN ({_STOP}))
SELECT item_id, count(*) AS n_matches, count(DISTINCT conv_id) AS n_conversations, min(identifier) AS first_identifier
FROM asked JOIN said USING (identifier) GROUP BY item_id
"""


def lexical_family_join(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of passages with the terms of conversations that are of their family."""
    asked = table(spark, sf, "benchmark").select(F.explode(text.terms("text")).alias("term")).distinct()
    asked = asked.select(F.lit(0).alias("query_id"), "term", F.lit(0).alias("df"))
    words = table(spark, sf, "conversations").select(F.explode(text.terms("text")).alias("word")).distinct()
    return relevance.families(asked, words).groupBy("term").agg(
        F.count("*").alias("n_family"), F.min("word").alias("first_word"), F.max("word").alias("last_word")
    )


LEXICAL_FAMILY = f"""
WITH asked AS (SELECT DISTINCT unnest({sql_terms('text')}) AS term FROM benchmark),
words AS (SELECT DISTINCT unnest({sql_terms('text')}) AS word FROM conversations),
pairs AS (
  SELECT term, word, least(length(term), length(word)) AS shorter,
         len(list_filter(range(1, least(length(term), length(word)) + 1), lambda i: left(term, i) = left(word, i))) AS common
  FROM asked JOIN words ON left(term, 6) = left(word, 6) AND term <> word AND length(term) >= 6 AND length(word) >= 6)
SELECT term, count(*) AS n_family, min(word) AS first_word, max(word) AS last_word
FROM pairs WHERE common >= 6 AND common >= 0.7 * shorter GROUP BY term
"""


def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("path", F.regexp_replace("url", "^[a-z]+://", ""))
    return pages.select(
        "page_id",
        text.file_name("path").alias("file_name"),
        text.stem("path").alias("stem"),
        text.parent("path").alias("parent"),
        text.suffix("path").alias("suffix"),
        text.normalised_path("path").alias("normalised"),
        text.safe_name("url").alias("safe_name"),
    )


PATH_PARTS = r"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
q AS (SELECT *, string_split(path, '/')[-1] AS file_name FROM p)
SELECT page_id, file_name, regexp_replace(file_name, '(.)\.[^.]*$', '\1') AS stem,
       regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
       lower(regexp_extract(file_name, '.(\.[^.]*)$', 1)) AS suffix,
       regexp_replace(path, '^[./]+', '') AS normalised,
       regexp_replace(regexp_replace(lower(url), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') AS safe_name
FROM q
"""


def secret_redaction(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.redacted("text").alias("clean"), text.secret_categories("text").alias("kinds")).select(
        "doc_id", F.sha2("clean", 256).alias("sha256"), F.concat_ws(",", "kinds").alias("categories")
    )


# The rules once more, in SQL's own words: keys are cut out by splitting at their BEGIN lines, not by one pattern.
_KEY_HEAD = "-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_KEY_TAIL = "-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_RULES = {
    "credential URL": "[[:alpha:]][[:alnum:]+.-]*://[^[:space:]/:@]*:[^[:space:]/@]+@",
    "bearer token": "[Bb][Ee][Aa][Rr][Ee][Rr][[:space:]]+[[:alnum:]._~+/-]{8,}=*",
    "assigned secret": (
        "(?i:[[:word:]]*(?:password|passwd|secret|api_?key|access_key|token))[\"']?[ \\t]*[=:][ \\t]*"
        "(?:\"[^\"\\n]+\"|'[^'\\n]+'|[[:word:]/+.-]*[[:alpha:]][[:word:]/+.-]*|[[:digit:]]{4,})"
    ),
}
_CLEAN = "whole"
for _pattern in _RULES.values():
    _CLEAN = f"regexp_replace({_CLEAN}, $re${_pattern}$re$, '{text.REDACTED}', 'g')"
_CASES = ", ".join(f"CASE WHEN regexp_matches(text, $re${p}$re$) THEN '{c}' END" for c, p in _RULES.items())
SECRET_REDACTION = f"""
WITH pieces AS (
  SELECT doc_id, text, regexp_extract_all(text, $re${_KEY_HEAD}$re$) AS heads, regexp_split_to_array(text, $re${_KEY_HEAD}$re$) AS parts FROM documents),
-- A part after a head is a key up to its END line; without one, so is the rest of the text.
open AS (
  SELECT doc_id, text, parts[1] AS start, heads, list_transform(parts[2:], lambda p: regexp_extract(p, $re$^[\\s\\S]*?{_KEY_TAIL}$re$)) AS closed, parts[2:] AS rest FROM pieces),
joined AS (
  SELECT doc_id, text, start || array_to_string(list_transform(range(1, len(rest) + 1), lambda i:
    '{text.REDACTED}' || repeat(chr(10), len(CASE WHEN closed[i] = '' THEN rest[i] ELSE closed[i] END) - len(replace(CASE WHEN closed[i] = '' THEN rest[i] ELSE closed[i] END, chr(10), '')))
    || CASE WHEN closed[i] = '' THEN '' ELSE rest[i][len(closed[i]) + 1:] END), '') AS whole, len(heads) > 0 AS has_key FROM open)
SELECT doc_id, sha256({_CLEAN}) AS sha256,
       array_to_string(list_sort(list_filter([CASE WHEN has_key THEN 'private key' END, {_CASES}], lambda x: x IS NOT NULL)), ',') AS categories
FROM joined
"""


def line_collapse(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    runs = windows.runs(lines, ["doc_id"], "line", ["at"])
    return runs.groupBy("doc_id").agg(
        F.count("*").alias("n_runs"), F.sum(F.col("length") - 1).alias("n_removed"), F.max("length").alias("longest_run")
    )


LINE_COLLAPSE = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
marked AS (SELECT *, CASE WHEN line = lag(line) OVER w THEN 0 ELSE 1 END AS starts FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
numbered AS (SELECT doc_id, sum(starts) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM marked),
runs AS (SELECT doc_id, run, count(*) AS length FROM numbered GROUP BY doc_id, run)
SELECT doc_id, count(*) AS n_runs, sum(length - 1)::BIGINT AS n_removed, max(length) AS longest_run FROM runs GROUP BY doc_id
"""


def line_severity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    lines = docs.select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line"))
    marked = lines.withColumn("severity", text.severity("line"))
    return marked.groupBy("lang", "severity").agg(F.count("*").alias("n_lines"), F.sum(text.token_estimate("line")).alias("n_tokens"))


LINE_SEVERITY = r"""
WITH lines AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT lang, CASE WHEN contains(line, 'Traceback (most recent call last):') THEN 4
                  WHEN regexp_matches(line, '(?i)\b(?:ERROR|FATAL|FAILED|Exception|AssertionError)\b') THEN 3
                  WHEN regexp_matches(line, '(?i)\bWARN(?:ING)?\b') THEN 2 ELSE 0 END AS severity,
       count(*) AS n_lines, sum((strlen(line) + 3) // 4)::BIGINT AS n_tokens
FROM lines GROUP BY ALL
"""


def compacted_within_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents that a budget of 200 tokens keeps; a fold in order, beyond SQL."""
    lines = compaction.lines_of(table(spark, sf, "documents"), "doc_id")
    kept = compaction.within_budget(lines, "doc_id", 200)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("stays").alias("n_kept"))


def term_set_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Union, intersection and difference of the terms of both turns' sides of a conversation."""
    talk = table(spark, sf, "conversations").select("conv_id", "role", F.explode(text.terms("text")).alias("term"))
    sides = talk.groupBy("conv_id", "term").agg(
        F.bool_or(F.col("role") == "user").alias("asked"), F.bool_or(F.col("role") == "assistant").alias("answered")
    )
    return sides.groupBy("conv_id").agg(
        F.count_if(F.col("asked") | F.col("answered")).alias("n_union"),
        F.count_if(F.col("asked") & F.col("answered")).alias("n_both"),
        F.count_if(F.col("asked") & ~F.col("answered")).alias("n_only_asked"),
    )


TERM_SETS = f"""
WITH talk AS (SELECT conv_id, role, unnest({sql_terms('text')}) AS term FROM conversations),
sides AS (SELECT conv_id, term, bool_or(role = 'user') AS asked, bool_or(role = 'assistant') AS answered FROM talk GROUP BY ALL)
SELECT conv_id, count(*) FILTER (asked OR answered) AS n_union, count(*) FILTER (asked AND answered) AS n_both,
       count(*) FILTER (asked AND NOT answered) AS n_only_asked
FROM sides GROUP BY conv_id
"""


def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The first appearance of each event kind of a user, in order."""
    events = table(spark, sf, "events")
    first = events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    order = F.array_sort(F.collect_list(F.struct("first", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(order, lambda x: x["event_type"]), ",").alias("kinds"))


ORDERED_DISTINCT = """
WITH first AS (SELECT user_id, event_type, min((ts, event_id)) AS since FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, ',' ORDER BY since) AS kinds FROM first GROUP BY user_id
"""


def import_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Types of parts as dotted modules: a part imports type.brand; modules are the types' beginnings that nations' regions leave."""
    parts = table(spark, sf, "part")
    dotted = F.replace("p_type", F.lit(" "), F.lit("."))
    imports = parts.select(F.col("p_partkey").cast("string").alias("source"), dotted.alias("module"), F.col("p_brand").alias("name"))
    heads = parts.where("p_size > 25").select(F.concat_ws(".", dotted, "p_brand").alias("module"), F.lit("named").alias("kind"))
    firsts = parts.select(F.substring_index(dotted, ".", 1).alias("module"), F.lit("first").alias("kind"))
    modules = heads.union(firsts).distinct().select("module", F.concat_ws(":", "kind", "module").alias("path"))
    edges = graph.resolve_imports(imports, modules)
    return edges.groupBy("target").agg(F.countDistinct("source").alias("in_degree"))


IMPORT_RESOLUTION = r"""
WITH p AS (SELECT p_partkey::VARCHAR AS source, replace(p_type, ' ', '.') AS module, p_brand AS name, p_size FROM part),
modules AS (SELECT DISTINCT module || '.' || name AS module, 'named:' || module || '.' || name AS path FROM p WHERE p_size > 25
            UNION SELECT DISTINCT split_part(module, '.', 1), 'first:' || split_part(module, '.', 1) FROM p),
tried AS (SELECT source, module, name, 0 AS place, module || '.' || name AS candidate FROM p
          UNION ALL SELECT source, module, name, 1, module FROM p
          UNION ALL SELECT source, module, name, 2 + i, array_to_string(string_split(module, '.')[1:len(string_split(module, '.')) - 1 - i], '.')
          FROM p, range(0, 6) r(i) WHERE len(string_split(module, '.')) - 1 - i >= 1),
best AS (SELECT source, t.module, name, min_by(path, place) AS target FROM tried t JOIN modules m ON m.module = t.candidate GROUP BY ALL)
SELECT target, count(DISTINCT source) AS in_degree FROM best GROUP BY target
"""


def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the graph that joins suppliers and customers with large balances to their nations."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"))
    c = table(spark, sf, "customer").where("c_acctbal > 9000")
    c = c.select(F.concat(F.lit("c"), "c_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    n = table(spark, sf, "nation").where("n_regionkey < 2")
    n = n.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    labels = graph.components(s.union(c).union(n))
    return labels.groupBy("component").agg(F.count("*").alias("size"))


GRAPH_COMPONENTS = """
WITH links AS (
  SELECT 's' || s_suppkey AS node, s_nationkey AS nation FROM supplier
  UNION ALL SELECT 'c' || c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000),
used AS (SELECT nation FROM links UNION SELECT n_nationkey FROM nation WHERE n_regionkey < 2),
groups AS (SELECT nation, CASE WHEN n_regionkey < 2 THEN 'r' || n_regionkey ELSE 'n' || nation END AS grp
           FROM used JOIN nation ON nation = n_nationkey),
nodes AS (SELECT node, grp FROM links JOIN groups USING (nation)
          UNION SELECT 'n' || nation, grp FROM groups UNION SELECT grp, grp FROM groups WHERE grp LIKE 'r%')
SELECT component, count(*) AS size FROM (SELECT node, min(node) OVER (PARTITION BY grp) AS component FROM nodes) GROUP BY component
"""


def snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents before and after: one source gone, one new, German texts edited."""
    docs = table(spark, sf, "documents")
    old = docs.where("source <> 'src1'").select("doc_id", F.sha2("text", 256).alias("sha256"))
    edited = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("source <> 'src2'").select("doc_id", F.sha2(edited, 256).alias("sha256"))
    return snapshots.changes(old, new, "doc_id", "sha256")


SNAPSHOT_CHANGES = """
WITH old AS (SELECT doc_id, sha256(text) AS a FROM documents WHERE source <> 'src1'),
new AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS b FROM documents WHERE source <> 'src2')
SELECT doc_id, CASE WHEN a IS NULL THEN 'created' WHEN b IS NULL THEN 'deleted' WHEN a = b THEN 'unchanged' ELSE 'modified' END AS status
FROM old FULL JOIN new USING (doc_id)
"""


def stale_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as notes on documents: those whose document is gone from a source, or has changed."""
    docs = table(spark, sf, "documents")
    noted = table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.sha2("text", 256).alias("sha256"))
    now = F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))
    current = docs.where("source <> 'src3'").select("doc_id", F.sha2(now, 256).alias("sha256"))
    return snapshots.stale(noted, current, "doc_id", "sha256").select("doc_id", "reason")


STALE_NOTES = """
SELECT doc_id, CASE WHEN source = 'src3' THEN 'FILE_REMOVED' ELSE 'FILE_CHANGED' END AS reason
FROM labels JOIN documents USING (doc_id) WHERE source = 'src3' OR (lang = 'fr' AND upper(text) <> text)
"""


def query_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark")
    return items.select("item_id", numbers.fingerprint("item_id", text.squashed("text")).alias("fingerprint"))


QUERY_FINGERPRINTS = r"""
SELECT item_id, sha256('=' || item_id || chr(0) || '=' || trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS fingerprint FROM benchmark
"""

PLANS = {
    "token_estimate_by_lang": (token_estimate_by_lang, TOKEN_ESTIMATE),
    "file_fingerprints": (file_fingerprints, FILE_FINGERPRINTS),
    "term_document_frequency": (term_document_frequency, TERM_FREQUENCY),
    "useful_terms": (useful_terms, USEFUL_TERMS),
    "relevance_topk": (relevance_topk, RELEVANCE_TOPK),
    "signal_dedupe_max": (signal_dedupe_max, SIGNAL_DEDUPE),
    "full_ranking": (full_ranking, None),
    "packed_ranges": (packed_ranges, None),
    "range_allocation": (range_allocation, None),
    "exact_symbol_join": (exact_symbol_join, EXACT_SYMBOL),
    "lexical_family_join": (lexical_family_join, LEXICAL_FAMILY),
    "path_parts": (path_parts, PATH_PARTS),
    "secret_redaction": (secret_redaction, SECRET_REDACTION),
    "line_collapse": (line_collapse, LINE_COLLAPSE),
    "line_severity": (line_severity, LINE_SEVERITY),
    "compacted_within_budget": (compacted_within_budget, None),
    "term_set_overlap": (term_set_overlap, TERM_SETS),
    "ordered_distinct": (ordered_distinct, ORDERED_DISTINCT),
    "import_resolution": (import_resolution, IMPORT_RESOLUTION),
    "graph_components": (graph_components, GRAPH_COMPONENTS),
    "snapshot_changes": (snapshot_changes, SNAPSHOT_CHANGES),
    "stale_notes": (stale_notes, STALE_NOTES),
    "query_fingerprints": (query_fingerprints, QUERY_FINGERPRINTS),
}
