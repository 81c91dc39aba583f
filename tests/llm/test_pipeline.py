from collections import Counter

import corpus_pipeline
from tallgrass.llm import common, sentencepiece_codec, simhash
from tests.llm.helpers import HARD, documents, sentences


def test_stages_keep_columns_and_their_decisions_take_effect(spark, tmp_path):
    rows = [(1000 + i, sentences(i, 80), "en", "ab"[i % 2]) for i in range(60)]
    rows += [(2000 + i, sentences(i, 80), "en", "a") for i in range(10)]
    near = sentences(70, 300)
    rows += [(3000 + i, near + f" tail{i}", "en", "b") for i in range(8)] + HARD
    table = documents(spark, rows, "digest size wide")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = common.documents(spark, str(tmp_path)), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == table.columns, name
        out.write.parquet(path := str(tmp_path / str(i)))
        docs = spark.read.parquet(path)
        seen[name] = [r.doc_id for r in docs.collect()]
    assert {i for i in seen["language ID"] if i and i >= 1000} == {r[0] for r in rows if r[0] and r[0] >= 1000}
    assert not {1, 2, 3} & set(seen["language ID"])
    assert not set(range(1000, 1010)) & set(seen["exact dedup"]) and set(range(2000, 2010)) <= set(seen["exact dedup"])
    assert {i for i in seen["SimHash near-dedup"] if i and i >= 3000} == {3000}
    assert len(seen["SimHash near-dedup"]) == len(set(seen["SimHash near-dedup"]))
    assert set(seen["mixing sources"]) <= set(seen["SimHash near-dedup"])
    assert Counter(seen["SentencePiece"]) == Counter(seen["mixing sources"])
    texts = {r[0]: r[1] for r in rows}
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Pieces.load())
    for r in docs.collect():
        assert r.round_trip and (r.doc_id is None or codec.encode(texts[r.doc_id]).tolist() == r.ids)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in whole.collect() if r.doc_id) == sorted(i for i in seen["SentencePiece"] if i)


def test_stages_stand_empty_tables(spark):
    empty = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_near_copies_are_those_whose_fingerprints_op6_links(spark):
    base = sentences(90, 400).split()
    rows = [*HARD, *((5000 + i, sentences(100 + i, 60)) for i in range(20))]
    rows += [(6000 - i, " ".join(base[: 20 * i] + ["changed"] + base[20 * i + 1 :])) for i in range(20)]
    docs = documents(spark, rows, "fp root wide component_id __row")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    printed = common.cut_lineage(simhash.fingerprints(docs.select("doc_id", "text"), 4))
    prints = {r.fp % 2**64 for r in printed.collect()}
    roots = {x: x for x in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if (a ^ b).bit_count() <= simhash.MAX_BITS and roots[a] != roots[b]:
                old, new = max(roots[a], roots[b]), min(roots[a], roots[b])
                roots = {x: new if r == old else r for x, r in roots.items()}
    least: dict = {}
    for r in printed.collect():
        least.setdefault(roots[r.fp % 2**64], []).append(r.doc_id)
    expected = [min((i for i in ids if i is not None), default=None) for ids in least.values()]
    key = lambda i: -1 if i is None else i
    assert sorted((r.doc_id for r in left.collect()), key=key) == sorted(expected, key=key)
    assert len(expected) < len(prints)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_a_template_of_near_copies_makes_no_more_links_than_keys(spark):
    base = sentences(91, 60).split()
    rows = [(i, " ".join([*base[:30], f"w{i}", *base[31:]])) for i in range(600)]
    nodes = simhash._nodes(simhash.fingerprints(documents(spark, rows), 4))
    n, made = nodes.count(), simhash.links(nodes).count()
    keys = simhash.signature_keys(nodes).count()
    assert made < keys and made <= 20 * n, (n, made)
