"""Plans that must not fill one task: how rows are dealt, and what is made once."""

import os

import pytest

from tallgrass import plans
from tallgrass.operators import diagnostics, graph, packing, relevance, storage

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_the_rows(spark, monkeypatch):
    assert storage.spread(spark.range(10), 10, "id").rdd.getNumPartitions() == 1
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    dealt = storage.spread(spark.range(5000), 5000, "id")
    assert dealt.rdd.getNumPartitions() == 51 and dealt.distinct().count() == 5000


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
@pytest.mark.parametrize("name", ["read_coverage", "full_file_promotion", "affinity_expansion"])
def test_ranges_are_dealt_by_their_keys_to_a_number_that_adaptive_execution_keeps(spark, name):
    assert "REPARTITION_BY_NUM" in plan_of(plans.QUERIES[name](spark, SF))


def test_imports_are_resolved_once_and_never_broadcast(spark):
    imports = spark.createDataFrame(
        [*((f"s{i}", "a.b", "c") for i in range(50)), ("t", "a.b", None), ("t", None, "c"), ("u", "a.x", "y"), ("a.py", "a", None), ("v", "z", "q")],
        "source string, module string, name string",
    )
    modules = spark.createDataFrame([("a", "a.py"), ("a.b", "a/b.py"), ("a.b.c", "a/b/c.py")], "module string, path string")
    edges = graph.resolve_imports(imports, modules)
    expected = {*((f"s{i}", "a/b/c.py") for i in range(50)), ("t", "a/b.py"), ("u", "a.py")}
    assert sorted(map(tuple, edges.collect())) == sorted(expected)
    first = plan_of(edges).split("Scan ExistingRDD[source")[0]
    assert "SortMergeJoin" in first and "BuildLeft" not in first


def test_clusters_read_their_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    selected = spark.createDataFrame([("q", p) for p in "abcd"], "query_id string, path string")
    rows = [("a", "b", "IMPORTS"), ("a", "b", "IMPORTS"), ("b", "a", "TESTS"), ("c", "x", "IMPORTS"), ("c", "c", "IMPORTS"), ("b", "d", "OTHER")]
    edges = spark.createDataFrame(rows, schema := "source string, target string, kind string").mapInArrow(count, schema)
    found = diagnostics.cluster_spread(selected, edges).collect()
    assert [tuple(r) for r in found] == [("q", 3, 0.5)] and read.value == len(rows)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_cut_once(spark):
    texts = [("a.py", "bandits banditry other kestrel"), ("b.py", "banditry"), ("c.md", "bandits"), ("d.py", "bandits")]
    files = spark.createDataFrame(texts, "path string, text string")
    useful = spark.createDataFrame([("q", "bandits", 1), ("q", "kestrel", 1), ("q", "other", 1), ("r", "bandits", 9)], "query_id string, term string, df long")
    found = spark.createDataFrame(
        [("q", "a.py", "term:kestrel"), ("q", "a.py", "graph:import"), ("q", "b.py", "graph:import"), ("q", "c.md", "path:c.md"), ("r", "a.py", "x")],
        "query_id string, path string, key string",
    )
    signals = relevance.source_signals(found, files, useful)
    assert sorted((r.query_id, r.path, r.kind, r.key, r.weight) for r in signals.collect()) == [
        ("q", "a.py", "source_term", "term:bandits", relevance.RARE_SOURCE),
        ("q", "b.py", "family_term", "term:bandits", relevance.RARE_SOURCE_FAMILY),
        ("r", "a.py", "source_term", "term:bandits", relevance.WEIGHTS["source_term"]),
    ]
    assert optimized(signals).count("regexp_replace(regexp_replace(text") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
def test_a_ranking_cuts_its_sources_once(spark):
    assert optimized(plans.QUERIES["full_ranking"](spark, SF)).count("regexp_replace(regexp_replace(text") == 1


def test_lines_are_cut_of_files_with_ranges_only(spark):
    files = spark.createDataFrame([("a", "1\n2\n3"), ("b", None), ("c", "x")], "path string, text string")
    ranges = spark.createDataFrame([("q", "a", 2, 3), ("q", "b", 1, 1)], "query_id string, path string, start long, end long")
    cut = packing.excerpts(ranges, files)
    assert [(r.path, r.excerpt, r.tokens) for r in cut.collect()] == [("a", "2\n3", 1)]
    plan = optimized(cut)
    assert plan.index("split(text") < plan.index("Join")


def test_passages_and_texts_meet_where_the_texts_are(spark):
    texts = spark.createDataFrame([(i, f"kestrel word{i % 7} other{i % 5}") for i in range(40)] + [(40, "kestrel rare"), (41, None)], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "word3 other2 rare kestrel")], "item_id long, text string")
    best = relevance.passage_top_k(passages, texts, 4)
    assert sorted((r["rank"], r.doc_id, r.score) for r in best.collect()) == [(1, 40, 12), (2, 17, 10), (3, 2, 5), (4, 3, 5)]
    plan = plan_of(best)
    assert "hashpartitioning(term" not in plan and "hashpartitioning(doc_id" in plan and "hashpartitioning(item_id" in plan
