"""Explainable ranking of files for queries.

Every match is a row (query_id, path, kind, key, weight, term). Matches of one key compete: the
heaviest counts. A file's score is the sum over its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .storage import spread, stored

# Weight of each kind of match, in the order in which equal weights win.
WEIGHTS = {
    "explicit_path": 120.0, "trace_path": 105.0, "filename_term": 28.0, "path_term": 8.0,
    "exact_symbol": 95.0, "symbol_term": 17.0, "import_term": 5.0, "family_term": 3.0,
    "import_neighbor": 13.0, "reverse_import_neighbor": 10.0, "related_test": 12.0, "tested_source": 12.0,
    "source_term": 5.0, "changed_relevant": 9.0,
}
FAMILY_FILENAME = 8.0
RARE_SOURCE, RARE_SOURCE_FAMILY = 12.0, 10.0
#: A file whose own matches weigh so much lends weight to its neighbours.
PROPAGATES = WEIGHTS["filename_term"]
SOURCE_HITS = 2
SIGNAL = ("query_id", "path", "kind", "key", "weight", "term")


def document_frequency(terms: DataFrame) -> DataFrame:
    """Rows (term, df) from distinct (path, term)."""
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def useful_terms(query_terms: DataFrame, frequency: DataFrame, n_files: int) -> DataFrame:
    """Query terms that at most three files, or 0.3 of all, have; a term that no file has is useful."""
    most = max(3, int(n_files * 0.3))
    joined = query_terms.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return joined.where(F.col("df") <= most)


def _signals(rows: DataFrame, kind: str, key: Column, weight: Column | None = None, term: str | None = "term") -> DataFrame:
    return rows.select(
        "query_id", "path", F.lit(kind).alias("kind"), key.alias("key"),
        (F.lit(WEIGHTS[kind]) if weight is None else weight).alias("weight"),
        (F.col(term) if term else F.lit(None).cast("string")).alias("term"),
    )


def _term_key() -> Column:
    return F.concat(F.lit("term:"), F.col("term"))


def exploded(texts: DataFrame, column: str | Column, name: str, *kept: str) -> DataFrame:
    """The kept columns with each term of a text. Outer, as Spark otherwise cuts every text twice: once to see if it has any."""
    return texts.select(*kept, F.explode_outer(T.terms(column)).alias(name)).where(F.col(name).isNotNull())


def families(useful: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (query_id, term, df, path, word) of one lexical family; joined on the six letters they share."""
    a = useful.where(F.length("term") >= 6).withColumn("head", F.substring("term", 1, 6))
    b = words.where(F.length("word") >= 6).withColumn("head", F.substring("word", 1, 6))
    return a.join(b, "head").where(T.is_family("term", "word")).drop("head")


def strongest(signals: DataFrame) -> DataFrame:
    """Of the signals that share query, path and key, the heaviest; of equal ones the kind listed first."""
    place = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(WEIGHTS) for x in (k, -i)]), F.col("kind"))
    best = F.max_by(F.struct("kind", "weight", "term"), F.struct(F.col("weight"), place))
    return signals.groupBy("query_id", "path", "key").agg(best.alias("best")).select("query_id", "path", "key", "best.*")


def direct_signals(queries: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, useful: DataFrame) -> DataFrame:
    """Matches of queries (query_id, task, error_text, paths, symbols) with what files hold themselves.

    files (path, text), symbols (path, name, qualified_name), imports (path, module, name).
    """
    out = []
    named = queries.select("query_id", F.explode("paths").alias("named")).select("query_id", T.normalised_path("named").alias("path"))
    # A path in running text: the candidates are the text's own path-like words, joined by equality.
    words = lambda c: F.explode(F.split(F.replace(c, F.lit("\\"), F.lit("/")), r"[^\w/.\-]+"))
    spoken = queries.select("query_id", words(F.col("task")).alias("word")).select("query_id", F.rtrim("word", F.lit(".")).alias("path"))
    explicit = named.union(spoken).distinct().join(files.select("path"), "path")
    out.append(_signals(explicit, "explicit_path", F.concat(F.lit("path:"), "path"), term=None))
    traced = queries.select("query_id", words(F.col("error_text")).alias("path")).distinct().join(files.select("path"), "path")
    out.append(_signals(traced, "trace_path", F.concat(F.lit("trace:"), "path"), term=None))
    in_name = exploded(files, T.stem("path"), "term", "path")
    in_path = exploded(files, "path", "term", "path").join(in_name, ["path", "term"], "left_anti")
    out.append(_signals(useful.join(in_name, "term"), "filename_term", _term_key()))
    out.append(_signals(useful.join(in_path, "term"), "path_term", _term_key()))
    everything = F.concat_ws(" ", "task", "error_text")
    asked = queries.select("query_id", F.explode(F.array_union(T.identifiers(everything), "symbols")).alias("identifier"))
    either = symbols.select("path", "qualified_name", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("identifier"))
    exact = asked.join(either, "identifier").select("query_id", "path", "qualified_name").distinct()
    out.append(_signals(exact, "exact_symbol", F.concat(F.lit("symbol:"), "qualified_name"), term=None))
    in_symbol = exploded(symbols, "name", "term", "path").distinct()
    out.append(_signals(useful.join(in_symbol, "term"), "symbol_term", _term_key()))
    in_import = exploded(imports, F.concat_ws(".", "module", "name"), "term", "path").distinct()
    unnamed = in_import.join(in_name, ["path", "term"], "left_anti")
    out.append(_signals(useful.join(unnamed, "term"), "import_term", _term_key()))
    file_words = in_name.select("path", F.col("term").alias("word"), F.lit(True).alias("of_name"))
    other_words = in_path.union(in_symbol).distinct().select("path", F.col("term").alias("word"), F.lit(False).alias("of_name"))
    related = families(useful, file_words.union(other_words)).join(in_name, ["path", "term"], "left_anti")
    related = related.groupBy("query_id", "path", "term").agg(F.bool_or("of_name").alias("of_name"))
    out.append(_signals(related, "family_term", _term_key(), F.when(F.col("of_name"), FAMILY_FILENAME).otherwise(WEIGHTS["family_term"])))
    signals = out[0]
    for more in out[1:]:
        signals = signals.unionByName(more)
    return strongest(signals)


def graph_signals(direct: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """What strong files lend their neighbours, once for each kind: edges (source, target, kind IMPORTS or TESTS).

    Strength counts a file's own matches only, so the result does not hang on the order of files.
    """
    strong = direct.groupBy("query_id", "path").agg(F.sum("weight").alias("own")).where(F.col("own") >= PROPAGATES)
    strong = strong.select("query_id", F.col("path").alias("near")).join(
        files.select(F.col("path").alias("near"), "is_test"), "near"
    )
    imports, tests = (edges.where(F.col("kind") == k) for k in ("IMPORTS", "TESTS"))
    to = lambda e, here, there: strong.join(e.select(F.col(here).alias("near"), F.col(there).alias("path")), "near")
    forward = to(imports, "source", "target")
    kinds = {
        "import_neighbor": (forward, "graph:import"),
        "reverse_import_neighbor": (to(imports, "target", "source"), "graph:reverse"),
        "related_test": (to(tests, "target", "source"), "graph:test"),
        "tested_source": (forward.where("is_test"), "graph:tested"),
    }
    out = None
    for kind, (rows, key) in kinds.items():
        found = _signals(rows.select("query_id", "path").distinct(), kind, F.lit(key), term=None)
        out = found if out is None else out.unionByName(found)
    return out


def source_signals(found: DataFrame, files: DataFrame, useful: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Of the files found, up to two further useful terms that their text has: rare ones first, then long ones.

    Files over max_bytes are not looked into if it is given.
    """
    readable = files.where(~T.language("path").isin("Markdown", "Other"))
    if max_bytes is not None:
        readable = readable.where(F.octet_length("text") <= max_bytes)
    wanted = useful.where(F.length("term") >= 6).select("query_id", "term", "df")
    # All that concerns a file meets in one task, however large the tree: its text, which queries found it and by which terms.
    n_found = found.count()
    term = F.when(F.col("key").startswith("term:"), F.struct("query_id", F.substring("key", 6, 1 << 20).alias("term")))
    candidates = spread(found.select("query_id", "path", term.alias("term")), n_found, "path").groupBy("path").agg(
        F.collect_set("query_id").alias("queries"), F.collect_set("term").alias("taken")
    )
    texts = candidates.join(spread(readable.select("path", "text"), n_found, "path"), "path")
    words = exploded(texts, "text", "word", "path", "queries", "taken").where(F.length("word") >= 6)
    # Equal words and families share six letters, so a text is cut once for both.
    wanted = wanted.withColumn("head", F.substring("term", 1, 6))
    hits = words.withColumn("head", F.substring("word", 1, 6)).join(wanted, "head").where(F.array_contains("queries", F.col("query_id")))
    hits = hits.where((F.col("term") == F.col("word")) | T.is_family("term", "word")).where(~F.array_contains("taken", F.struct("query_id", "term")))
    hits = hits.groupBy("query_id", "path", "term", "df").agg(F.bool_or(F.col("term") == F.col("word")).alias("exact"))
    order = Window.partitionBy("query_id", "path").orderBy("df", F.length("term").desc(), "term")
    best = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SOURCE_HITS)
    rare = F.col("df") <= 2
    weight = F.when(F.col("exact"), F.when(rare, RARE_SOURCE).otherwise(WEIGHTS["source_term"])).otherwise(
        F.when(rare, RARE_SOURCE_FAMILY).otherwise(WEIGHTS["family_term"])
    )
    kind = F.when(F.col("exact"), F.lit("source_term")).otherwise(F.lit("family_term"))
    return best.select("query_id", "path", kind.alias("kind"), _term_key().alias("key"), weight.alias("weight"), "term")


def top_k(signals: DataFrame, k: int, floor: float = 1.0) -> DataFrame:
    """The k files of greatest score for each query, with their matches in order of weight."""
    entry = F.struct((-F.col("weight")).alias("order"), "key", "kind", "weight", "term")
    scored = signals.groupBy("query_id", "path").agg(F.sum("weight").alias("score"), F.array_sort(F.collect_list(entry)).alias("signals"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return scored.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(
    queries: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, edges: DataFrame, k: int = 10
) -> DataFrame:
    """Rows (query_id, path, score, role, signals, rank): the full ranking with all kinds of matches.

    queries have query_id, task, error_text, paths, symbols and changed; files path, text and is_test.
    """
    asked = queries.select("query_id", F.explode(T.terms(F.concat_ws(" ", "task", "error_text"))).alias("term"))
    in_path = exploded(files, "path", "term", "path")
    in_symbol = exploded(symbols, "name", "term", "path")
    # Each of these is read several times below, so it is made once.
    useful = stored(useful_terms(asked, document_frequency(in_path.union(in_symbol).distinct()), files.count()))
    direct = stored(direct_signals(queries, files, symbols, imports, useful))
    found = stored(strongest(direct.unionByName(graph_signals(direct, edges, files))))
    changed = queries.select("query_id", F.explode("changed").alias("path")).select("query_id", T.normalised_path("path").alias("path"))
    # Sources add no file, so what they add is not asked for here; it is made once.
    touched = found.select("query_id", "path").distinct().join(changed.distinct(), ["query_id", "path"])
    found = found.unionByName(source_signals(found, files, useful)).unionByName(_signals(touched, "changed_relevant", F.lit("changed"), term=None))
    primary = direct.select("query_id", "path").distinct().withColumn("role", F.lit("PRIMARY"))
    return top_k(found, k).join(primary, ["query_id", "path"], "left").withColumn("role", F.coalesce("role", F.lit("RELATED")))


def passage_top_k(passages: DataFrame, texts: DataFrame, k: int = 10) -> DataFrame:
    """The k texts (doc_id, text) that share most with each passage (item_id, text): 12 for a rare term, 5 for another useful one."""
    words = exploded(texts, "text", "term", "doc_id")
    asked = passages.select("item_id", F.explode(T.terms("text")).alias("term"))
    # Only terms that are asked for are counted and joined; they are kept, as texts are read and cut once.
    wanted = stored(words.join(asked.select("term").distinct(), "term", "left_semi"))
    frequency = wanted.groupBy("term").agg(F.count("*").alias("df"))
    # Stored, so that Spark knows how few they are: what a text shares is added up where its terms are, and each task hands on its k best.
    useful = stored(useful_terms(asked, frequency, texts.count()))
    weight = F.when(F.col("df") <= 2, 12).otherwise(5)
    near = spread(wanted, wanted.count(), "doc_id")
    scored = near.join(useful, "term").groupBy("doc_id", "item_id").agg(F.sum(weight).cast("long").alias("score")).select("item_id", "doc_id", "score")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
