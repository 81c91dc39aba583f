import hashlib
import random
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
import xxhash

from tallgrass.llm import common, exact_dedup, simhash, suffix_dedup
from tallgrass.operators.graph import star_components
from tests.llm.helpers import HARD, documents, sentences


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_cuckoo_index_inserts_deletes_and_grows():
    index, keys = exact_dedup.CuckooIndex(2), [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        assert index.find(k) < 0
        index.insert(k, i)
    assert index.mask + 1 > 512 and index.size == 3000
    assert all(index.values[index.find(k)] == i for i, k in enumerate(keys))
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.find(k) >= 0 for k in keys] == [False, True] * 1500


def test_exact_dedup_against_brute_force(spark):
    rows = [*HARD, *[(100 + i, f"copy {i % 5}") for i in range(60)]]
    docs = documents(spark, rows)
    found = exact_dedup.exact_dedup(docs.selectExpr("doc_id", "sha2(coalesce(text, ''), 256) as text_sha256"), 3).collect()
    groups = {}
    for r in rows:
        groups.setdefault(sha(r[1]), []).append(r[0])
    assert len(found) == len(rows)
    for r in found:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (max(known) if known else None, len(ids))
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in found if r.kept) == dict.fromkeys(groups, 1)


def test_kept_documents_have_all_columns_whatever_their_names(spark):
    docs = documents(spark, HARD, "digest keep_id kept __row top_rows")
    left = exact_dedup.kept_documents(docs)
    assert left.columns == docs.columns
    assert sorted(sha(r.text) for r in left.collect()) == sorted({sha(r[1]) for r in HARD})
    assert exact_dedup.kept_documents(docs.limit(0)).count() == 0


def components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_star_components_of_paths_stars_and_random_graphs(spark, seed):
    pick = random.Random(seed)
    pairs = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 25)]
    pairs += [(200 + pick.randrange(60), 200 + pick.randrange(60)) for _ in range(40)] + [(5, 5)]
    found = {r.node: r.root for r in star_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {k: v for k, v in components([p for p in pairs if p[0] != p[1]]).items()}
    assert star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_against_brute_force(spark):
    base = sentences(1, 400).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 400, 20)]
    rows = [*HARD, *[(1000 - i, t) for i, t in enumerate([" ".join(base), *near])], *[(2000 + i, sentences(i)) for i in range(30)]]
    printed = common.cut_lineage(simhash.fingerprints(documents(spark, rows), 4))
    found = [(r.doc_id, r.fp % 2**64, r.component_id) for r in printed.join(simhash.components(printed), "fp").collect()]
    prints = [fingerprint(r[1], 4) for r in rows]
    ids = [(i, r[0]) for i, r in enumerate(rows)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i, len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = components(pairs)
    least = {k: min((d for i, d in ids if root[i] == k and d is not None), default=None) for k in set(root.values())}
    expected = [(d, prints[i], least[root[i]]) for i, d in ids]
    order = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(found, key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("bits", [4, 9])
def test_search_in_a_crowded_bucket_keeps_every_connection(bits):
    pick = random.Random(3)
    values = {0}
    while len(values) < 300:
        value = pick.choice(sorted(values))
        for _ in range(pick.randint(1, 6)):
            value ^= 1 << pick.randrange(64)
        values.add(value)
    bucket = sorted(values)
    links = simhash._forest(np.array(bucket, np.uint64), bits)
    pairs = [(a, b) for a in bucket for b in bucket if a < b and (a ^ b).bit_count() <= bits]
    assert components([(int(a), int(b)) for a, b in links]) == components(pairs) and len(links) < len(bucket)


def test_near_duplicates_find_similar_texts_and_leave_others_alone(spark):
    rows, groups = [], 12
    for g in range(groups):
        base = [f"{w}{g}" for w in sentences(g, 300).split()]
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 4):
            copy = list(base)
            copy[50 * k] = copy[50 * k + 70] = "other"
            rows.append((10 * g + k, " ".join(copy)))
    docs = documents(spark, [*rows, *HARD], "fp root wide component_id")
    left = simhash.representatives(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert [i for i in ids if i is not None and i % 10 == 0 and i < 120 and i] == sorted(range(10, 120, 10), key=ids.index)
    assert not {10 * g + k for g in range(1, groups) for k in (1, 2, 3)} & set(ids)
    assert simhash.representatives(docs.limit(0)).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def changed(words, count, pick):
    words = list(words)
    for place in pick.sample(range(len(words)), count):
        words[place] = f"new{pick.random()}"
    return words


def test_near_duplicates_in_crowded_buckets_against_brute_force(spark):
    pick, rows = random.Random(4), []
    base = [f"w{pick.random()}" for _ in range(300)]
    for i in range(60):
        # Two of them share about 0.75; every third has a near copy.
        rows.append((2 * i, changed(base, 4, pick)))
        if i % 3 == 0:
            rows.append((2 * i + 1, changed(rows[-1][1], 3, pick)))
    rows = [(i, " ".join(words)) for i, words in rows]
    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a <= b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = simhash.near_duplicates(documents(spark, rows)).select("__row.doc_id", "component_id").collect()
    assert dict(map(tuple, found)) == components(near)


def test_pairs_at_the_threshold_are_joined_and_pairs_below_it_are_not(spark):
    pick, rows, near, far = random.Random(5), [], set(), set()
    for i in range(400):
        base = [f"w{pick.random()}" for _ in range(pick.randint(40, 300))]
        other = list(base)
        # One word is changed at a time; half of the pairs are the last above 0.8, half the first below.
        while len(shingles(" ".join(base)) & shingles(" ".join(other))) * 9 > 8 * (len(base) - 4):
            before, other = other, changed(other, 1, pick)
        a, b = (shingles(" ".join(x)) for x in (base, before if i % 2 else other))
        (near if len(a & b) >= 0.8 * len(a | b) else far).add(2 * i)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(before if i % 2 else other))]
    found = simhash.near_duplicates(documents(spark, rows)).select("__row.doc_id", "component_id").collect()
    joined = {c for d, c in found if d != c}
    print("joined", len(joined & near), "of", len(near), "near,", len(joined & far), "of", len(far), "far")
    assert len(near) > 150 and len(far) > 150
    assert not joined & far and len(joined & near) >= 0.97 * len(near), (len(joined & near), len(near), len(joined & far), len(far))


@pytest.mark.parametrize("alphabet,size", [(1, 60), (2, 300), (4, 500), (26, 900)])
def test_suffix_array_and_prefixes_against_sorting(alphabet, size):
    pick = random.Random(size)
    data = bytes(97 + pick.randrange(alphabet) for _ in range(size))
    data = data + data[: size // 2] + b"\xff"
    order = suffix_dedup.suffix_array(data, len(data))
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])

    def shared(a, b):
        n = 0
        while n < 400 and max(a, b) + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        return n

    assert suffix_dedup.common_prefixes(data, order).tolist() == [shared(a, b) for a, b in zip(order[:-1], order[1:], strict=True)]


def removal(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        yield len(t), int(gone.sum()), sum(k for k, _ in groupby(gone.tolist())), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("crowd", [1500, 1])
def test_suffix_dedup_against_all_windows(spark, crowd):
    passage, line = sentences(50, 120), "say it again. " * 90
    rows = [*HARD, (20, passage), (21, "x" + passage + "y"), (22, sentences(51, 80) + passage), (23, line), (24, "z" * 900)]
    rows += [(30 + i, f"{i} " + passage[: 380 + 5 * i] + f" {i}") for i in range(20)]
    found = suffix_dedup.removed(documents(spark, rows), group_items=crowd).collect()
    expected = list(removal([(r[1] or "").encode() for r in rows], 400))
    order = lambda t: str(t)
    assert sorted(((r.doc_id, *r[1:]) for r in found), key=order) == sorted(((r[0], *e) for r, e in zip(rows, expected, strict=True)), key=order)
    assert suffix_dedup.removed(documents(spark, []), group_items=crowd).count() == 0
