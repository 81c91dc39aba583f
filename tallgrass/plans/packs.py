"""Queries that grow clusters and packs, choose, and take digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, text
from ..operators import affinity, choices, expansion, packing, relevance, trees
from ..operators.storage import spread, stored
from ..sources.tables import table
from .retrieval import _part_signals, sql_terms

#: Scores of parts are lower than those of files with all kinds of matches.
_SPREADS = 8.0


def _part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of one order import the part on its next line; small parts test large ones."""
    following = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n_items = items.count()
    pairs = spread(items, n_items, "l_orderkey").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(following).alias("b"))
    size = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 7 == 0).alias("is_test"))
    near = spread(pairs.where("b is not null and a <> b"), n_items, "a", "b").distinct()
    both = near.join(size.toDF("a", "a_test"), "a").join(size.toDF("b", "b_test"), "b")
    named = both.select(F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), "a_test", "b_test")
    imports = named.select("source", "target", F.lit("IMPORTS").alias("kind"))
    return imports.unionByName(named.where("a_test and not b_test").select("source", "target", F.lit("TESTS").alias("kind")))


def affinity_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Types of parts as queries, their hundred best parts as files, orders as imports: anchors and clusters."""
    ranked = relevance.top_k(_part_signals(spark, sf), 100).withColumns(
        {"role": F.lit("PRIMARY"), "tests_requested": F.col("query_id").startswith("S")}
    )
    files = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") % 7 == 0).alias("is_test"))
    return affinity.clusters(ranked, files, _part_edges(spark, sf), _SPREADS)


AFFINITY = f"""
WITH RECURSIVE asked AS (SELECT p_type AS query_id, unnest({sql_terms('p_type')}) AS term FROM (SELECT DISTINCT p_type FROM part)),
words AS (
  SELECT p_partkey::VARCHAR AS path, 'filename_term' AS kind, 28.0::DOUBLE AS weight, unnest({sql_terms('p_name')}) AS term FROM part
  UNION ALL
  SELECT p_partkey::VARCHAR, 'path_term', 8.0::DOUBLE, unnest({sql_terms('p_type')}) FROM part),
best AS (
  SELECT query_id, path, term, max(weight) AS weight, max_by(kind, weight) AS kind
  FROM asked JOIN words USING (term) GROUP BY query_id, path, term),
scored AS (SELECT query_id, path, sum(weight) AS score, bool_or(kind = 'filename_term') AS strong FROM best GROUP BY query_id, path),
cand AS (
  SELECT query_id, path, score, strong, p_size % 7 = 0 AS is_test, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank
  FROM scored JOIN part ON p_partkey::VARCHAR = path QUALIFY rank <= 100),
pairs AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem),
imports AS (SELECT DISTINCT a::VARCHAR AS source, b::VARCHAR AS target FROM pairs WHERE b IS NOT NULL AND a <> b),
linked AS (
  SELECT x.query_id, x.path, y.path AS other, true AS reach FROM cand x JOIN imports ON source = x.path JOIN cand y ON y.query_id = x.query_id AND y.path = target
  UNION
  SELECT x.query_id, x.path, y.path, NOT y.is_test FROM cand x JOIN imports ON target = x.path JOIN cand y ON y.query_id = x.query_id AND y.path = source),
first AS (
  SELECT query_id, min_by(path, rank) AS path FROM cand WHERE strong AND NOT is_test GROUP BY query_id
  UNION
  SELECT query_id, min_by(path, rank) FROM cand WHERE strong AND is_test AND starts_with(query_id, 'S') GROUP BY query_id),
walk AS (  -- anchors, one rank after the other
  SELECT query_id, 0 AS rank, list(path) AS anchors FROM first GROUP BY query_id
  UNION ALL
  SELECT w.query_id, c.rank,
         CASE WHEN c.strong AND NOT c.is_test AND len(w.anchors) < 3 AND NOT list_contains(w.anchors, c.path)
                   AND EXISTS (SELECT 1 FROM linked l WHERE l.query_id = c.query_id AND l.path = c.path AND list_contains(w.anchors, l.other))
              THEN list_append(w.anchors, c.path) ELSE w.anchors END
  FROM walk w JOIN cand c ON c.query_id = w.query_id AND c.rank = w.rank + 1),
anchored AS (SELECT query_id, unnest(anchors) AS path FROM walk QUALIFY rank = max(rank) OVER (PARTITION BY query_id)),
anchors AS (
  SELECT * FROM anchored
  UNION ALL SELECT query_id, path FROM cand WHERE rank <= 2 AND query_id NOT IN (SELECT query_id FROM anchored)),
tests AS (
  SELECT a.query_id, min_by(t.path, (-t.score, t.path)) AS path
  FROM anchors a JOIN part p ON p.p_partkey::VARCHAR = a.path AND p.p_size % 7 <> 0 JOIN imports ON target = a.path
  JOIN cand t ON t.query_id = a.query_id AND t.path = source AND t.is_test GROUP BY a.query_id, a.path),
begun AS (
  SELECT query_id, path FROM anchors UNION SELECT query_id, path FROM tests
  UNION SELECT a.query_id, other FROM anchors a JOIN linked USING (query_id, path) WHERE reach),
grow AS (  -- the cluster, one rank after the other
  SELECT query_id, 0 AS rank, list(path) AS cluster FROM begun GROUP BY query_id
  UNION ALL
  SELECT g.query_id, c.rank,
         CASE WHEN c.score >= {_SPREADS} AND NOT c.is_test AND list_contains(g.cluster, c.path)
              THEN list_distinct(list_concat(g.cluster, coalesce((SELECT list(other) FROM linked l WHERE l.query_id = c.query_id AND l.path = c.path AND reach), [])))
              ELSE g.cluster END
  FROM grow g JOIN cand c ON c.query_id = g.query_id AND c.rank = g.rank + 1),
grown AS (SELECT query_id, cluster FROM grow QUALIFY rank = max(rank) OVER (PARTITION BY query_id))
SELECT c.query_id, c.path, EXISTS (SELECT 1 FROM anchors a WHERE a.query_id = c.query_id AND a.path = c.path) AS anchor,
       list_contains(g.cluster, c.path) AS affinity
FROM cand c JOIN grown g USING (query_id)
"""


def _order_requests(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """Orders as queries over parts as files of p_size lines: lines with a large quantity are held, the status asks."""
    items = table(spark, sf, "lineitem")
    path = F.col("l_partkey").cast("string").alias("path")
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_name")
    lines = items.join(size, "l_partkey").select(
        F.col("l_orderkey").alias("query_id"), path, F.col("l_linenumber").alias("rank"), "l_quantity", "p_size", "p_name"
    )
    held = lines.where("l_quantity > 30").select(
        "query_id", "path", F.floor((F.col("p_size") + 2) / 3).cast("long").alias("start"),
        F.floor((F.col("p_size") + 1) / 2).cast("long").alias("end"), F.col("rank").cast("double").alias("priority"),
    )
    orders = table(spark, sf, "orders")
    kind = F.element_at(F.array(*map(F.lit, expansion.KINDS)), (F.col("o_orderkey") % len(expansion.KINDS) + 1).cast("int"))
    target = F.when(kind == "symbol", F.substring_index("o_orderpriority", "-", 1))
    requests = orders.select(F.col("o_orderkey").alias("query_id"), kind.alias("kind"), target.alias("target"), F.lit(5).alias("lines"))
    parts = table(spark, sf, "part")
    named = F.element_at(F.split(F.lit("1,2,3,4,5"), ","), (F.col("p_partkey") % 5 + 1).cast("int"))
    symbols = parts.where("p_partkey <= 20").select(
        F.col("p_partkey").cast("string").alias("path"), named.alias("name"), F.concat_ws(".", "p_brand", named).alias("qualified_name"),
        F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"),
    )
    files = parts.select(F.col("p_partkey").cast("string").alias("path"), F.col("p_size").alias("line_count"))
    other = (F.col("p_partkey") + 1).cast("string")
    edges = parts.select(
        F.col("p_partkey").cast("string").alias("source"), other.alias("target"), F.when(F.col("p_partkey") % 2 == 0, "IMPORTS").otherwise("TESTS").alias("kind")
    )
    return requests, held, lines.select("query_id", "path", "rank"), symbols, files, edges


def expansion_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Every order asks for more of its parts in one of the seven ways."""
    return expansion.requested(*_order_requests(spark, sf))


EXPANSION = """
WITH lines AS (SELECT l_orderkey AS query_id, l_partkey AS part, l_linenumber AS rank, l_quantity, p_size FROM lineitem JOIN part ON p_partkey = l_partkey),
held AS (SELECT query_id, part, (p_size + 2) // 3 AS a, (p_size + 1) // 2 AS b, rank FROM lines WHERE l_quantity > 30),
first AS (SELECT query_id, min_by(part, (rank, part::VARCHAR)) AS part FROM held GROUP BY query_id),
asks AS (SELECT o_orderkey AS query_id, o_orderkey % 7 AS k, split_part(o_orderpriority, '-', 1) AS symbol, part FROM orders LEFT JOIN first ON query_id = o_orderkey),
unseen AS (SELECT query_id, min_by(part, (rank, part::VARCHAR)) AS part FROM lines
           WHERE (query_id, part) NOT IN (SELECT query_id, part FROM held) GROUP BY query_id)
SELECT query_id, u.part::VARCHAR AS path, 1::BIGINT AS start, 1::BIGINT AS "end", 'candidate_expansion' AS kind FROM asks JOIN unseen u USING (query_id) WHERE k = 0
UNION SELECT query_id, p_partkey::VARCHAR, 1, p_size, 'symbol' FROM asks JOIN part ON (p_partkey % 5 + 1)::VARCHAR = symbol AND p_partkey <= 20 WHERE k = 1
UNION SELECT query_id, p_partkey::VARCHAR, 1, p_size, 'related_expansion' FROM asks JOIN part ON p_partkey = asks.part + 1 WHERE k = 2 AND asks.part % 2 = 0
UNION SELECT query_id, p_partkey::VARCHAR, 1, p_size, 'related_expansion' FROM asks JOIN part ON p_partkey = asks.part - 1 WHERE k = 3 AND p_partkey % 2 = 1
UNION SELECT query_id, p_partkey::VARCHAR, 1, p_size, 'file_expansion' FROM asks JOIN part ON p_partkey = asks.part WHERE k = 4
UNION SELECT query_id, h.part::VARCHAR, greatest(1, a - 5), b + 5, 'expanded_surroundings' FROM asks JOIN held h USING (query_id) WHERE k = 5 AND h.part = asks.part
UNION SELECT query_id, p_partkey::VARCHAR, 1, least(80, p_size), 'file_expansion' FROM asks JOIN part ON p_partkey = asks.part WHERE k = 6
"""


def pack_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Two generations of packs for the benchmark's passages over documents: what each sends, and from where.

    The second asks for the lines around the best range. A choice step by step, beyond SQL; tests hold it against sets of lines.
    """
    docs = table(spark, sf, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    found = relevance.passage_top_k(table(spark, sf, "benchmark"), docs)
    signal = F.struct(
        F.lit("source_term").alias("kind"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"),
        F.lit(12.0).alias("weight"), F.lit(None).cast("string").alias("term"),
    )
    ranked = stored(found.select(
        F.col("item_id").alias("query_id"), path, "rank", F.col("score").cast("double").alias("score"),
        F.lit("PRIMARY").alias("role"), F.array(signal).alias("signals"),
    ))
    texts = docs.select(path, "text").join(ranked.select("path").distinct(), "path", "left_semi")
    files = stored(texts.select("path", "text", F.size(text.split_lines("text")).alias("line_count"), F.sha2("text", 256).alias("sha256")))
    symbols = files.select("path", F.lit("opening").alias("name"), F.lit("opening").alias("qualified_name"), F.lit(1).alias("start_line"), F.lit(3).alias("end_line"))
    edges = docs.select(path, F.col("doc_id") + 1).toDF("source", "target").select(
        "source", F.col("target").cast("string").alias("target"), F.lit("IMPORTS").alias("kind")
    )
    one = packing.pack(ranked, symbols, files, 1500, edges=edges).where("taken").join(files.select("path", "sha256"), "path")
    held = stored(one.select("query_id", "path", "start", "end", "priority", "excerpt", "sha256"))
    none = F.lit(None).cast("string")
    requests = ranked.select("query_id").distinct().select("query_id", F.lit("surrounding_lines").alias("kind"), none.alias("target"), F.lit(10).alias("lines"))
    _, sent = expansion.expand(held.drop("excerpt"), requests, ranked, symbols, files, edges, 3000, 1)
    both = held.select("query_id", "path", "start", "end", "excerpt", F.lit(0).alias("generation")).unionByName(sent.drop("sha256"))
    return both.select("query_id", "generation", "path", "start", "end", F.sha2("excerpt", 256).alias("sha256"))


def _document_tree(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf, "documents").select(path.alias("path"), F.sha2("text", 256).alias("sha256"))


def tree_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files below folders of source and language: the folders' digests."""
    return trees.tree_digests(_document_tree(spark, sf)).where("kind = 'folder'").select("path", "digest", "n_files")


TREE_DIGESTS = f"""
WITH files AS (SELECT source, lang, doc_id || '.txt' AS name, sha256(text) AS digest FROM documents),
sized AS (SELECT *, count(*) OVER (PARTITION BY source, lang) > {trees.WIDE} AS wide FROM files),
parts AS (
  SELECT source, lang, CASE WHEN wide THEN sha256(name)[1:{trees.PART_DIGITS}] ELSE '' END AS part, any_value(wide) AS wide, count(*) AS n,
         sha256(string_agg(name || chr(0) || 'file' || chr(0) || digest, chr(10) ORDER BY name)) AS digest FROM sized GROUP BY ALL),
langs AS (
  SELECT source, lang, sum(n)::BIGINT AS n,
         CASE WHEN any_value(wide) THEN sha256(string_agg(part || chr(0) || 'part' || chr(0) || digest, chr(10) ORDER BY part)) ELSE max(digest) END AS digest
  FROM parts GROUP BY source, lang),
sources AS (
  SELECT source, sum(n)::BIGINT AS n, sha256(string_agg(lang || chr(0) || 'folder' || chr(0) || digest, chr(10) ORDER BY lang)) AS digest FROM langs GROUP BY source)
SELECT source || '/' || lang AS path, digest, n AS n_files FROM langs
UNION ALL SELECT source, digest, n FROM sources
UNION ALL SELECT '', sha256(string_agg(source || chr(0) || 'folder' || chr(0) || digest, chr(10) ORDER BY source)), sum(n)::BIGINT FROM sources
"""


def order_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Each order with its lines as canonical JSON, whatever order they are read in, and its digest."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_returnflag").alias("flag")))).alias("lines")
    )
    rows = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("key"), "lines").alias("o")
    )
    return rows.select(F.col("o.key").alias("o_orderkey"), canonical.canonical_digest(F.col("o"), rows.schema["o"].dataType).alias("sha256"))


ORDER_DIGESTS = """
WITH lines AS (
  SELECT l_orderkey, string_agg('{"flag":"' || l_returnflag || '","l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}', ','
                                ORDER BY l_linenumber, l_partkey, l_returnflag) AS body FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, sha256('{"key":' || o_orderkey || ',"lines":' || coalesce('[' || body || ']', 'null') || ',"priority":"' || o_orderpriority || '"}') AS sha256
FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey
"""


def favourite_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of event that a user has most often, null where two kinds are equally frequent."""
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return choices.unique_best(counts, ["user_id"], "event_type", "n")


FAVOURITE_KIND = """
WITH counts AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
best AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS most FROM counts)
SELECT user_id, CASE WHEN count(*) = 1 THEN max(event_type) END AS event_type, any_value(n) AS n FROM best WHERE n = most GROUP BY user_id
"""


PLANS = {
    "affinity_expansion": (affinity_expansion, AFFINITY),
    "expansion_ranges": (expansion_ranges, EXPANSION),
    "pack_generations": (pack_generations, None),
    "tree_digests": (tree_digests, TREE_DIGESTS),
    "order_digests": (order_digests, ORDER_DIGESTS),
    "favourite_kind": (favourite_kind, FAVOURITE_KIND),
}
