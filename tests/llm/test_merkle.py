"""The manifest against a plain tree built in memory."""

import hashlib
import zlib

import numpy as np
import pytest

from tallgrass.llm import merkle

from . import helpers


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(row, more=0):
    values = [row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def slow_tree(nodes):
    """All levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return levels


def siblings(levels, k):
    found = []
    for level in levels[:-1]:
        start = k // 2 * 2
        found.append([(j < k, level[j]) for j in range(start, min(start + 2, len(level))) if j != k])
        k //= 2
    return found


def slow_proofs(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row.lang, []).append(row)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    ordered = {v: sorted(by_lang[v], key=lambda r: (r.doc_id is not None, r.doc_id or 0, slow_leaf(r))) for v in langs}
    trees = {v: slow_tree([slow_leaf(r) for r in ordered[v]]) for v in langs}
    top = slow_tree([trees[v][-1][0] for v in langs])
    root = top[-1][0]
    out = []
    for at, lang in enumerate(langs):
        for k, row in enumerate(ordered[lang]):
            steps = siblings(trees[lang], k) + siblings(top, at)
            changed = row.doc_id is not None and row.n_chars is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0
            node = slow_leaf(row, int(changed))
            for step in steps:
                node = sha(*[h for left, h in step if left], node, *[h for left, h in step if not left])
            proof = sha(*(h for step in steps for _, h in step))
            out.append((row.doc_id, trees[lang][0][k], trees[lang][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def found(docs, block_height=merkle.BLOCK_HEIGHT):
    got = merkle.proofs(merkle.document_leaves(docs, merkle.tampered()), block_height)
    assert got.columns == [c.split()[0] for c in merkle.PROOF_SCHEMA.split(", ")]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("height", range(10))
def test_addresses_are_a_permutation_with_whole_subtrees(height):
    place = merkle.addresses(height)
    assert sorted(np.concatenate(place).tolist()) == list(range(2 ** (height + 1) - 1))
    assert [len(level) for level in place] == [2**d for d in range(height + 1)]
    if height:
        top = (height + 1) // 2
        assert sorted(np.concatenate(place[:top]).tolist()) == list(range(2**top - 1))
        size = 2 ** (height + 1 - top) - 1
        for hung, start in enumerate(range(2**top - 1, 2 ** (height + 1) - 1, size)):
            nodes = [a for d in range(top, height + 1) for a in np.split(place[d], 2**top)[hung].tolist()]
            assert sorted(nodes) == list(range(start, start + size))


@pytest.mark.parametrize("height", [1, 2, 3, 12])
def test_proofs_equal_a_plain_tree(spark, height):
    rows = [(i * 3 % 101, f"text {i} é", f"l{i % 3}" if i % 3 else "big", f"s{i % 4}") for i in range(101)]
    rows += [(200, "alone", "zz", "a"), (201, "x", "ß", "a"), (202, "y", None, None)]
    rows += [(300 + i, None, "big", "a") for i in range(64)]
    docs = helpers.documents(spark, rows)
    assert found(docs, height) == slow_proofs(docs.collect())


def test_hard_rows(spark):
    docs = helpers.documents(spark, helpers.HARD, "tree key leaf claim salt pos block path root")
    got, expected = found(docs, 2), slow_proofs(docs.collect())
    assert got == expected
    assert not all(r[-1] for r in expected) and any(r[-1] for r in expected)


def test_long_text_and_null_count(spark):
    docs = helpers.documents(spark, [(k, "word é " * 300_000, "en", "a") for k in range(8)])
    docs = docs.selectExpr("doc_id", "text", "lang", "source", "if(doc_id % 2 = 0, null, n_chars) as n_chars")
    assert found(docs, 2) == slow_proofs(docs.collect())


def test_no_rows_and_one_row(spark):
    assert found(helpers.documents(spark, [(1, "a")]).where("false")) == []
    docs = helpers.documents(spark, [(1, "a")])
    got = found(docs)
    assert got == slow_proofs(docs.collect())
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")


def test_many_trees(spark):
    docs = helpers.documents(spark, [(i, "t", f"lang{i % 37}", "a") for i in range(300)])
    assert found(docs, 3) == slow_proofs(docs.collect())
