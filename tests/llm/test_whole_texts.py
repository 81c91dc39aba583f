"""Very long texts, clashing columns and empty tables for the operators on whole texts; toxicity row by row against a slow version."""

import hashlib
import math
import os
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tallgrass.llm import common, exact_dedup, lm_scoring, mixing, simhash, suffix_dedup, toxicity
from tests.llm.helpers import HARD, documents, sentences

SF = "/root/testdata/sf0.001"
LONG = sentences(5, 120_000)
COPY = LONG[:400_000] + " and an end of its own"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, [*HARD, (50, LONG), (51, COPY)], "fp size key uid spans n_bytes chunk digest component_id").cache()


def test_sizes_and_exact_classes_of_long_texts(spark, docs):
    found = {r.doc_id: r for r in mixing.mix(docs.select("doc_id", "source", "text")).select("__row.doc_id", "size", "taken").where("doc_id >= 50").collect()}
    assert found[50].size == 120_000 and found[51].size == len(COPY.split())
    same = exact_dedup.exact_dedup(docs.union(docs.where("doc_id = 50")).select("doc_id", F.sha2(common.text_or_empty(), 256).alias("text_sha256"))).where("doc_id = 50").collect()
    assert [r.group_size for r in same] == [2, 2] and sum(r.kept for r in same) == 1


def test_fingerprints_of_long_texts_and_of_nothing(spark, docs):
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs, width=4).where("doc_id >= 50").collect()}
    for doc_id, text in ((50, LONG), (51, COPY)):
        words = text.lower().split()
        counts, n = Counter(), len(words) - 3
        for i in range(n):
            h = xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest()
            counts.update(b for b in range(64) if h >> b & 1)
        assert got[doc_id] == sum(1 << b for b in range(64) if counts[b] * 2 > n)
    nothing = simhash.fingerprints(docs.limit(0), width=4)
    assert nothing.count() == 0 and simhash.components(nothing).count() == 0


def test_what_long_texts_repeat_is_removed(spark, docs):
    got = {r.doc_id: r for r in suffix_dedup.removed(docs).where("doc_id >= 50").collect()}
    shared = 400_000
    while shared < len(LONG) and LONG[shared] == COPY[shared]:
        shared += 1
    assert got[50].n_bytes == len(LONG) and got[51].n_bytes == len(COPY)
    assert (got[50].n_removed, got[50].n_spans) == (shared, 1) == (got[51].n_removed, got[51].n_spans)
    assert got[51].kept_sha256 == hashlib.sha256(COPY[shared:].encode()).hexdigest()
    assert suffix_dedup.removed(docs.limit(0)).count() == 0


def test_base_scores_of_long_texts(spark, docs):
    held = docs.where("doc_id >= 6").select("doc_id", "text", (F.col("doc_id") == 51).alias("held_out"))
    got = {r.doc_id: r for r in lm_scoring.score_documents(held).collect()}
    words = {r.doc_id: [*(r.text or "").lower().split(), None] for r in docs.where("doc_id >= 6").collect()}
    seen = Counter(w for d, ws in words.items() if d != 51 for w in ws)
    total = sum(seen.values())
    for d, ws in words.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(ws), sum(w in seen for w in ws), total)
        slow = math.fsum(math.log10((seen[w] + 1) / (total + (len(seen) + 1))) for w in ws)
        assert got[d].base_score == pytest.approx(slow, rel=1e-9) and got[d].score < 0


def slow_toxicity(text, weights, bias):
    """Score and offending sentences by products over sentences, words and features one by one."""
    clear, spans = 1.0, []
    for m in re.finditer(r"[^.!?\n]+", text or ""):
        words = re.findall(r"\w+", m[0].lower())
        if not words:
            continue
        odds = bias
        for w in words:
            odds += weights.get(w, 0.0) + sum(weights.get(w[:n] + "*", 0.0) for n in (4, 5, 6, 7) if len(w) > n)
        chance = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        clear *= 1 - chance
        if chance >= 0.5:
            spans.append((m.start(), m.end(), chance))
    return 1 - clear, spans


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
def test_toxicity_of_every_document_against_a_slow_version(spark):
    docs = common.documents(spark, SF).select("doc_id", "text", common.held_out(4).alias("held_out"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    scorer = toxicity.train(docs.where("not held_out"), labels)
    got = {r.doc_id: r for r in toxicity.op5_toxicity(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and scorer.weights
    n_spans = 0
    for r in rows:
        score, spans = slow_toxicity(r.text, scorer.weights, scorer.bias)
        assert got[r.doc_id].score == pytest.approx(score, abs=1e-9) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
        assert [(s.start, s.end) for s in got[r.doc_id].spans] == [s[:2] for s in spans]
        assert [s.score for s in got[r.doc_id].spans] == pytest.approx([s[2] for s in spans])
        n_spans += len(spans)
    assert n_spans > 0
