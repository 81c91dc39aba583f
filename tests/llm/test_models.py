import hashlib
import os
import random
import re
import zlib
from collections import Counter
from math import exp, log, log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyarrow import dataset

from tallgrass.llm import common, language_id, lm_scoring, mixing, sentencepiece_codec, sketch, token_counts, toxicity
from tests.llm.helpers import HARD, documents, sentences

SYLLABLES = {"en": "the and of ing er th", "de": "der und sch ung ein ch", "es": "que ción el la os ado"}


def test_mix_meets_targets_and_repeats_itself(spark):
    rows = [(i, sentences(i, 5 + i % 7), "en", "abcdefg"[min(i % 13, 6)]) for i in range(400)] + HARD + [(900, "word", "en", "z")]
    docs = documents(spark, rows, "size target taken range key")
    found = mixing.mix(docs).select("__row.doc_id", "__row.source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix(docs.repartition(3)).select("__row.doc_id", "__row.source", "size", "source_size", "target", "taken").collect()
    assert Counter(found) == Counter(again) and len(found) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[(r[3] if len(r) > 2 else "a")] += len((r[1] or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    targets, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        scale = left / max(1, sum(weights[s] for s in open_))
        over = {s for s in open_ if scale * weights[s] > 3 * sizes[s]}
        if not over:
            break
        targets |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    targets |= {s: scale * weights[s] for s in open_}
    taken = Counter()
    for r in found:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(targets[s] + 1e-9) for s in sizes)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def language_docs():
    rows, pick = [], random.Random(1)
    for i in range(240):
        lang = sorted(SYLLABLES)[i % 3]
        rows.append((1000 + i, sentences(i, pick.randint(4, 60), SYLLABLES[lang]), lang, "a"))
    return rows


def test_language_id_finds_held_out_languages_and_rejects_the_rest(spark):
    rows = language_docs()
    strange = [(900, "漢字仮名交文字列" * 20, None, "a"), (901, "12 34 !?", "en", "a"), *HARD]
    docs = documents(spark, [*rows, *strange], "lang_pred score").withColumn("held_out", common.held_out(4))
    models = language_id.train(docs.where("not held_out"))
    found = {r.doc_id: r for r in language_id.predict(docs, models).collect() if r.doc_id is not None}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([found[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 901))
    assert found[900].rejected and not any(found[r[0]].rejected for r in rows)
    kept = language_id.accepted(docs.drop("held_out"), models)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns[:-1] and all(ids[r[0]] == 1 for r in rows) and not {1, 2, 3, 900, 901} & set(ids)


def test_junk_is_rejected_whatever_a_few_odd_rows_say_and_clean_texts_stay(spark):
    pick = random.Random(9)
    rows = [(i, sentences(i, pick.randint(3, 60), SYLLABLES[sorted(SYLLABLES)[i % 3]]), sorted(SYLLABLES)[i % 3], "a") for i in range(1500)]
    noise = lambda n: "".join(pick.choice("bcdfghjklmnpqrstvwxz ") for _ in range(n))
    # Some labelled rows are noise, or belong to another language.
    rows += [(3000 + i, noise(200), "en", "a") for i in range(6)] + [(3100 + i, sentences(i, 40, SYLLABLES["es"]), "de", "a") for i in range(6)]
    junk = [(5000 + i, noise(pick.randint(40, 400)), None, "a") for i in range(60)]
    junk += [(6000 + i, "漢字仮名交文字列"[: 4 + i % 5] * pick.randint(5, 30), None, "a") for i in range(20)]
    docs = documents(spark, rows + junk).withColumn("held_out", common.held_out(4))
    models = language_id.train(docs.where("not held_out"))
    rejected = {r.doc_id: r.rejected for r in language_id.predict(docs, models).collect()}
    assert np.mean([rejected[r[0]] for r in junk]) >= 0.9
    assert np.mean([rejected[r[0]] for r in rows[:1500]]) <= 0.01


def test_limits_of_languages_with_few_texts_come_from_the_others():
    rows = [{"lang": "a", "band": 2, "n": 500, "q": [2.0, 2.1, 2.3]}, {"lang": "b", "band": 2, "n": 3, "q": [3.0, 9.0, 9.0]}]
    wide = [{"lang": "a", "band": 2, "n": 2000, "q": [2.0, 2.4, 4.9]}]
    assert language_id.limits_from(["a"], wide)[0, 2] == pytest.approx(4.9)
    assert language_id.limits_from(["a"], [{**wide[0], "n": 500}])[0, 2] == pytest.approx(4.4)
    limits = language_id.limits_from(["a", "b", "c"], rows)
    assert limits[:, 2] == pytest.approx([3.2, 4.8, 4.8]) and limits[0, 0] == pytest.approx(3.2)
    assert np.isinf(language_id.limits_from(["a"], [])).all()


class SlowKneserNey:
    """Interpolated Kneser-Ney over the characters of some normalised texts, from dictionaries."""

    def __init__(self, texts, floor):
        self.floor, n = floor, language_id.ORDER
        self.counts = {n: Counter(t[i - n + 1 : i + 1] for t in texts for i in range(n - 1, len(t)))}
        for order in range(n - 1, 0, -1):
            self.counts[order] = Counter(g[1:] for g in self.counts[order + 1])

    def p(self, gram):
        order = len(gram)
        if not order:
            return self.floor
        counts = self.counts[order]
        once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once else 0.5
        after = {g: v for g, v in counts.items() if g[:-1] == gram[:-1]}
        lower = self.p(gram[1:])
        if not after:
            return lower
        total = sum(after.values())
        return max(counts.get(gram, 0) - discount, 0) / total + discount * len(after) / total * lower


def test_cross_entropies_against_dictionaries():
    texts = {x: [sentences(10 * i + k, 12, SYLLABLES[x]) for k in range(4)] for i, x in enumerate(sorted(SYLLABLES))}
    plain = {x: ["".join(map(chr, language_id.normalised(t))) for t in ts] for x, ts in texts.items()}
    counted = {}
    for x, ts in texts.items():
        counted[x] = np.unique(np.concatenate([language_id.grams(language_id.normalised(t)) for t in ts]), return_counts=True)
    models = language_id.build(sorted(texts), counted)
    slow = {x: SlowKneserNey(ts, np.exp(models.floor)) for x, ts in plain.items()}
    for text in ("the river", texts["de"][0], "zq überall 漢字"):
        codes = "".join(map(chr, language_id.normalised(text)))
        n = language_id.ORDER
        expected = [-np.mean([np.log(slow[x].p(codes[i - n + 1 : i + 1])) for i in range(n - 1, len(codes))]) for x in models.languages]
        found, length = models.cross_entropies(text)
        assert length == len(codes) - n + 1 and found.tolist() == pytest.approx(expected, rel=1e-4)
        assert models.decide(text)[0] == models.languages[int(np.argmin(expected))]
    # Equal entropies: the first language by name.
    twin = language_id.build(["x", "y"], {"x": counted["en"], "y": counted["en"]})
    assert twin.decide("the ring")[0] == "x" and twin.decide("the ring")[1] == pytest.approx(0.5)


def test_kneser_ney_probabilities_sum_to_one():
    codes = [language_id.normalised(t) for t in ("abra cadabra", "banana band")]
    counted = {x: np.unique(language_id.grams(c), return_counts=True) for x, c in zip("xy", codes, strict=True)}
    models = language_id.build(["x", "y"], counted)
    letters = np.unique(np.concatenate(codes))
    for context in ("abr", "dab", " ba", "zzz"):
        head = sum(np.uint64(ord(c)) << np.uint64(16 * (3 - i)) for i, c in enumerate(context))
        sums = np.exp(models.log_probabilities(head | letters)).sum(axis=0)
        # One share of the floor is left for a character never seen, and each language leaves the other's letters theirs.
        assert (sums <= 1.0001).all() and (sums > 0.8).all()


def test_lm_scores_and_base_against_counts(spark):
    rows = [(i, sentences(i % 40, 30) + ". " + sentences(500 + i, 20) + ".", "en", "a") for i in range(150)] + HARD
    docs = documents(spark, rows, "score chunk key").withColumn("held_out", common.held_out(7))
    found = lm_scoring.score_documents(docs, chunk_bytes=20_000, table_bits=18).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for r in rows:
        words = tokens(r[1])
        base = sum(log10((counts[w] + 1) / (n + v + 1)) for w in words)
        expected[r[0], held(r[0]), len(words), sum(counts[w] > 0 for w in words), n, f"{base:.6f}"] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}") for r in found) == expected
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)
    better = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 150]
    # Words are drawn evenly from 90 here, so the base is nearly the source itself.
    assert sum(r.score for r in better) > 1.02 * sum(r.base_score for r in better)
    assert lm_scoring.score_documents(docs.limit(0), table_bits=16).count() == 0
    unlearned = lm_scoring.score_documents(docs.where("held_out"), table_bits=16).collect()
    assert len(unlearned) == sum(held(r[0]) for r in rows) and all(r.train_tokens == 0 and r.score < 0 for r in unlearned)


def test_lm_slices_of_a_chunk_ask_as_the_whole(monkeypatch):
    texts = [sentences(i % 5, 30) + ". " + sentences(i, 20) + "." for i in range(30)] + [None, ""]
    rows = pa.table({"chunk": pa.array([7] * 32, pa.int32()), "doc_id": list(range(32)), "text": texts, "held_out": [i % 3 == 0 for i in range(32)]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    blob = pa.table({"chunk": pa.array([7], pa.int32()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    whole = lm_scoring._ask(blob)
    monkeypatch.setattr(lm_scoring, "SLICE_CHARS", 500)
    assert len(list(lm_scoring.slices(rows.column("text")))) > 5
    assert Counter(map(str, lm_scoring._ask(blob).to_pylist())) == Counter(map(str, whole.to_pylist()))


def slow_slots(before, word, short, last, table_bits):
    """The slots of all contexts after the bytes before, the word so far, the last short word and the word before it."""
    top, base = 1 << 64, 0x9E3779B97F4A7C15
    keys = [int.from_bytes(before[-n:], "little") for n in lm_scoring.ORDERS]
    sums = [sum((b + 1) * pow(base, i, top) for i, b in enumerate(w)) % top for w in (word, short, last)]
    keys += [sums[0], (sums[0] + 0xA0761D6478BD642F * (sums[1] + 1)) % top, (sums[0] + 0xD6E8FEB86659FD93 * (sums[2] + 1)) % top]
    out = []
    for k, key in enumerate(keys, 1):
        key = ((key ^ key >> 32) + k) * 0x94D049BB133111EB % top
        key = (key ^ key >> 29) * 0x9E3779B97F4A7C15 % top
        out.append(key >> 64 - table_bits + lm_scoring.HALVED[k - 1])
    return out


def slow_coder(text, model, table_bits):
    """log10 of a coded text's probability, one bit after the other."""
    m, code = lm_scoring, model.code
    total, count, word, short, last = 0.0, 0, b"", b"", b""
    for i, byte in enumerate(text):
        before = (b"\n" * 8 + text[:i])[-8:]
        slots, pair = slow_slots(before, word, short, last, table_bits), before[-1] * 256 + byte
        path = range(code.offsets[pair], code.offsets[pair] + code.lengths[pair])
        for node, bit in zip(code.nodes[path].tolist(), code.bits[path].tolist(), strict=True):
            if count % m.SEGMENT == 0:
                own, refined = [0.0] * m.CONTEXTS, [float(x) for x in model.refined]
            count += 1
            stored = [int(model.odds[k][slot ^ node]) for k, slot in enumerate(slots)]
            gate = (stored[-2] & 3) * 4 + (stored[-1] & 3)
            x = [s / m.SCALE for s in stored]
            z = sum((float(model.weights[k][gate]) + own[k]) * x[k] for k in range(m.CONTEXTS))
            z = min(max(z, -m.MOST), m.MOST)
            p, step = 1 / (1 + exp(-z)), int((z + m.MOST) / m.STEP + 0.5)
            final = (p + refined[step]) / 2
            total += log10(final if bit else 1 - final)
            refined[step] += (bit - refined[step]) * m.REFINE_RATE
            own = [w + m.RATE * (bit - p) * v for w, v in zip(own, x, strict=True)]
        if byte in (m.SPACE, m.END):
            short = word if 0 < len(word) <= m.SHORT else short
            word, last = b"", word
        else:
            word += bytes([byte])
    return total


def small_model(texts, table_bits=16):
    coded = [lm_scoring.coded(common.words_of(t)) for t in texts]
    learner = lm_scoring.Learner(lm_scoring.Code.of(lm_scoring.pairs_in(np.frombuffer(b"".join(coded), np.uint8))), table_bits)
    learner.wait = 1000
    learner.add(coded)
    learner.close()
    odds = [lm_scoring.stored_odds(c) for c in learner.counts]
    refined = (learner.steps[:, 1] + 1) / (learner.steps.sum(axis=1) + 2)
    return lm_scoring.Model(learner.code, odds, learner.weights.astype(np.float32), refined.astype(np.float32)), coded, learner


def test_mixed_bits_equal_those_of_a_slow_coder(monkeypatch):
    monkeypatch.setattr(lm_scoring, "SEGMENT", 300)
    model, coded, learner = small_model([sentences(i, 40) for i in range(40)])
    assert learner.learned and np.ptp(learner.weights) > 0.001
    texts = [*coded[:3], *(lm_scoring.coded(common.words_of(t)) for t in (None, "", "one", "naïve 漢字 \x00 😀", sentences(90, 200)))]
    expected = [slow_coder(t, model, 16) for t in texts]
    assert model.log10(texts) == pytest.approx(expected, rel=1e-4)
    # Neither neighbours in an array nor their order matter.
    assert model.log10(texts[::-1])[::-1] == pytest.approx(model.log10(texts), rel=1e-6)
    assert [model.log10([t])[0] for t in texts] == pytest.approx(model.log10(texts), rel=1e-6)


def test_counts_are_those_of_every_bit_of_every_text():
    texts = [sentences(i, 15) for i in range(12)] + ["", "ends here"]
    model, coded, learner = small_model(texts)
    counts = [np.zeros_like(c) for c in learner.counts]
    for text in coded:
        word = short = last = b""
        for i, byte in enumerate(text):
            before = (b"\n" * 8 + text[:i])[-8:]
            pair = before[-1] * 256 + byte
            for j in range(model.code.offsets[pair], model.code.offsets[pair] + model.code.lengths[pair]):
                for k, slot in enumerate(slow_slots(before, word, short, last, 16)):
                    counts[k][slot ^ int(model.code.nodes[j]), model.code.bits[j]] += 1
            short = word if byte in (lm_scoring.SPACE, lm_scoring.END) and 0 < len(word) <= lm_scoring.SHORT else short
            word, last = (b"", word) if byte in (lm_scoring.SPACE, lm_scoring.END) else (word + bytes([byte]), last)
    assert all((a == b).all() for a, b in zip(counts, learner.counts, strict=True))


def test_codes_are_prefix_codes_with_nodes_from_the_root():
    pairs = np.random.default_rng(1).poisson(1, (256, 256)) ** 4
    pairs[7] = 0
    code = lm_scoring.Code.of(pairs)
    for before in (0, 7, 255):
        spent = 0.0
        for byte in range(256):
            at, n = int(code.offsets[before * 256 + byte]), int(code.lengths[before * 256 + byte])
            spent += 2.0**-n
            assert code.nodes[at] == 0 and (np.diff(code.nodes[at : at + n].astype(int)) > 0).all()
        assert spent == 1.0


def test_text_probabilities_sum_to_one_at_most():
    model, _, _ = small_model([sentences(i, 20) for i in range(20)])
    single = [lm_scoring.coded([bytes([b])]) for b in range(256) if b not in b" \t\n\v\f\r"]
    assert (10 ** model.log10([lm_scoring.coded([]), *single])).sum() < 1.0


def test_lm_mixing_beats_even_odds_and_knows_copies(spark):
    pick = random.Random(2)
    rows = [(i, " ".join("".join(pick.choices("aeilnorst", k=6)) for _ in range(80)), "en", "a") for i in range(200)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 2]
    trained = next(r for r in rows if r not in held)
    rows[held[0][0]] = (held[0][0], trained[1], "en", "a")
    docs = documents(spark, rows).withColumn("held_out", common.held_out(7))
    found = {r.doc_id: r for r in lm_scoring.score_documents(docs, table_bits=18).collect()}
    bits = [found[r[0]].bits_per_byte for r in held]
    assert bits[0] < 0.7 * min(bits[1:]) and max(bits[1:]) < 4


TABLE = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(TABLE), reason="needs the provided tables")
def test_held_out_documents_are_better_mixed_than_counted(monkeypatch):
    table = dataset.dataset(TABLE).to_table(columns=["doc_id", "text"])
    words = [common.words_of(t) for t in table.column("text").to_pylist()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in table.column("doc_id").to_pylist()]
    counts = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in [*ws, b""])
    n, kinds = sum(counts.values()), len(counts)
    other = [ws for ws, h in zip(words, held, strict=True) if h][::3]
    base = sum(log10((counts[w] + 1) / (n + kinds + 1)) for ws in other for w in [*ws, b""])
    model, _, _ = small_model([" ".join(w.decode() for w in ws) for ws, h in zip(words, held, strict=True) if not h], lm_scoring.TABLE_BITS)
    texts = [lm_scoring.coded(ws) for ws in other]
    each = model.log10(texts)
    mixed = each.sum()
    assert mixed > 0.95 * base
    single = [sum(log10((counts[w] + 1) / (n + kinds + 1)) for w in [*ws, b""]) for ws in other]
    assert (each >= np.array(single)).mean() >= 0.5
    monkeypatch.setattr(lm_scoring, "RATE", 0.0)
    monkeypatch.setattr(lm_scoring, "REFINE_RATE", 0.0)
    frozen = model.log10(texts).sum()
    even = lm_scoring.Model(model.code, model.odds, np.full_like(model.weights, 0.25), model.refined).log10(texts).sum()
    bits = lm_scoring.Model(model.code, model.odds, np.zeros_like(model.weights), np.full_like(model.refined, 0.5)).log10(texts).sum()
    assert mixed > 0.99 * frozen and frozen > even and mixed > 0.8 * bits, (mixed, frozen, even, bits, base)


def test_weights_are_learned_from_every_bit_of_every_text(monkeypatch):
    monkeypatch.setattr(lm_scoring, "HASHED_BYTES", 5000)
    model, coded, learner = small_model([sentences(i, 40) for i in range(400)])
    many = lm_scoring.Learner(learner.code, 16)
    for start in range(0, len(coded), 7):  # far more than a task's first texts
        for _ in range(25):
            many.add(coded[start : start + 7])
    many.close()
    bits = len(lm_scoring.Bits.of(coded, model.code, 16).value)
    assert learner.learned == learner.counted == learner.steps.sum() == bits
    assert many.learned == many.counted == 25 * bits


def test_weights_equal_those_of_a_slow_learner(monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEARN_BITS", 500)
    m, bits = lm_scoring, 16
    coded = [m.coded(common.words_of(sentences(i, 25))) for i in range(12)]
    learner = m.Learner(m.Code.of(m.pairs_in(np.frombuffer(b"".join(coded), np.uint8))), bits)
    learner.wait = 600
    learner.add(coded)
    learner.close()
    counts = [np.zeros_like(c) for c in learner.counts]
    weights, steps = np.full((m.CONTEXTS, m.GATES), 0.35), np.zeros((m.STEPS, 2))
    rest, wait = iter(coded), 600
    while group := next(m.in_groups(rest, wait), None):
        wait = min(2 * wait, m.HASHED_BYTES)
        found = m.Bits.of(group, learner.code, bits)
        slots, values = np.array([found.at(k) for k in range(m.CONTEXTS)]).T.tolist(), found.value.tolist()
        for begin in range(0, len(values), 500):
            moves, times = np.zeros_like(weights), np.zeros(m.GATES)
            for at, bit in zip(slots[begin : begin + 500], values[begin : begin + 500], strict=True):
                pairs = [counts[k][i].tolist() for k, i in enumerate(at)]
                gate = 0
                for pair in pairs[-2:]:
                    gate = gate * 4 + sum(sum(pair) >= n for n in m.SEEN)
                x = np.clip([log((b + m.PRIOR) / (a + m.PRIOR)) for a, b in pairs], -m.MOST, m.MOST)
                z = min(max(weights[:, gate] @ x, -m.MOST), m.MOST)
                steps[int((z + m.MOST) / m.STEP + 0.5), bit] += 1
                moves[:, gate] += (bit - 1 / (1 + exp(-z))) * x
                times[gate] += 1
            weights += m.LEARNING_RATE * moves / np.maximum(times, 500 // 64)
        for at, bit in zip(slots, values, strict=True):
            for k, i in enumerate(at):
                counts[k][i, bit] += 1
    assert all((a == b).all() for a, b in zip(counts, learner.counts, strict=True)) and np.ptp(weights) > 0.001
    assert learner.weights == pytest.approx(weights, abs=1e-4)
    assert learner.steps.sum() == steps.sum() and np.abs(learner.steps - steps).sum() <= 4


def test_learning_reads_the_slots_of_a_group_once(monkeypatch):
    _, coded, learner = small_model([sentences(i, 40) for i in range(20)])
    looked_up, at = [], lm_scoring.Bits.at
    monkeypatch.setattr(lm_scoring.Bits, "at", lambda bits, k: looked_up.append(k) or at(bits, k))
    monkeypatch.setattr(lm_scoring, "stored_odds", None)
    before = learner.learned
    learner.add(coded)
    learner.close()
    assert learner.learned == 2 * before
    # One group: learning and counting share what is looked up.
    assert looked_up == list(range(lm_scoring.CONTEXTS))


def test_bit_counts_are_not_cut_at_16_bits():
    text = lm_scoring.coded([b"aaaaaaaa"] * 20_000)
    learner = lm_scoring.Learner(lm_scoring.Code.of(lm_scoring.pairs_in(np.frombuffer(text, np.uint8))), 16)
    learner._count([text])
    assert max(c.max() for c in learner.counts) >= 70_000


def test_printed_fingerprints_hold_whole_hashes():
    hashes = sketch.sketch(sentences(3, 200))
    text = sketch.printed(hashes)
    assert [int(text[i : i + 16], 16) for i in range(0, len(text), 16)] == hashes.tolist()


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.Pieces.load())


def test_viterbi_finds_the_best_segmentation(codec):
    pieces = sentencepiece_codec.Pieces.load()
    score = {t: s for t, s in zip(pieces.texts, pieces.scores, strict=True) if t}
    longest = max(map(len, score))
    for text in ("▁The", "▁internationalisation", "▁naïve😀x", "▁aaaaaaaa", "\x00\x01", "▁▁▁x"):
        best = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - longest), end):
                if text[begin:end] in score:
                    best[end] = max(best[end], best[begin] + score[text[begin:end]])
            if text[end - 1] not in score:
                best[end] = max(best[end], best[end - 1] + codec.unknown)
        total, spelt = 0.0, bytearray()
        for i in codec.best_path(text):
            if pieces.texts[i] is None:
                spelt.append(pieces.bytes_[i])
            else:
                total += pieces.scores[i]
        # What is spelt in bytes is whole characters, each of which costs as much as an unknown one.
        assert total + codec.unknown * len(spelt.decode()) == pytest.approx(best[-1]), text


def test_encoding_round_trips(spark, codec):
    texts = [r[1] for r in HARD] + [" lead", "trail ", "a  b", "\n\n", "▁", " ▁ ", "tab\tx", "é" * 50, "0123456789abcdef" * 20]
    assert all(codec.decode(codec.encode(t)) == (t or "") for t in texts)
    whole = codec.best_path("▁some▁words▁again")
    assert codec.encode("some words again").tolist() == whole
    docs = documents(spark, list(enumerate(texts)), "ids n_tokens")
    found = sentencepiece_codec.encode_documents(docs).collect()
    assert len(found) == len(texts) and all(r.round_trip and r.n_tokens == len(r.ids) for r in found)
    assert sentencepiece_codec.encode_documents(docs.limit(0)).count() == 0


def test_token_counts_against_greedy_matching(spark):
    vocabulary = token_counts.load_vocabulary()
    known, longest = set(vocabulary), max(map(len, vocabulary))

    def greedy(word):
        count, at = 0, 0
        while at < len(word):
            at = next(end for end in range(min(len(word), at + longest), at, -1) if word[at:end] in known)
            count += 1
        return count

    rows = [*HARD, (50, "naïve 漢字 internationalization!!! aaaaaaaaaaaaaaaa"), (51, "ab" * 3000)]
    found = token_counts.count_tokens(documents(spark, rows, "n_words")).collect()
    expected = Counter()
    for r in rows:
        words = (r[1] or "").encode().split()
        expected[r[0], len(words), sum(greedy(b" " + w) for w in words)] += 1
    assert Counter(tuple(r) for r in found) == expected


@pytest.mark.parametrize("seed", range(4))
def test_longest_match_automaton_on_random_vocabularies(seed):
    pick = random.Random(seed)
    pieces = [bytes([b]) for b in range(256)] + [bytes(pick.choice(b"ab") for _ in range(pick.randint(2, 7))) for _ in range(25)]
    counter, known = token_counts.PieceCounter(pieces), set(pieces)
    for _ in range(200):
        word, at, n = bytes(pick.choice(b"abc") for _ in range(pick.randint(0, 30))), 0, 0
        while at < len(word):
            at = next(e for e in range(len(word), at, -1) if word[at:e] in known)
            n += 1
        assert counter.match(word) == n


def test_toxicity_slope_is_that_of_the_likelihood():
    pick = np.random.default_rng(3)
    sentence_of, feature_of, doc_of = pick.integers(0, 9, 40), pick.integers(0, 5, 40), np.array([0, 0, 1, 1, 1, 2, 3, 3, 3])
    times, labels = pick.integers(1, 3, 40).astype(float), np.array([1.0, 0, 1, 0])
    bags = toxicity.Bags(sentence_of, feature_of, times, doc_of, labels, np.array([0.1, 0.4, 0.3, 0.2]))
    w = pick.normal(size=6) / 3
    slope = bags.slope(w)
    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-5
        assert slope[i] == pytest.approx((bags.loss(w + step) - bags.loss(w - step)) / 2e-5, rel=1e-4, abs=1e-7)


def test_operators_stand_empty_tables_long_texts_and_clashing_names(spark):
    long = sentences(1, 60_000)
    docs = documents(spark, [*HARD, (77, long)], "score size n_words fingerprint spans held wide chunk word count")
    held = docs.withColumn("held_out", common.held_out(4))
    scorer = toxicity.Scorer({"ring": 0.1}, -3.0)
    models = language_id.train(held.where("doc_id <> 77"))
    by_name = {
        "op4": token_counts.count_tokens(docs),
        "op5": toxicity.score_documents(held, scorer),
        "op8": sketch.with_next(docs.select("doc_id", "text"), 3).mapInArrow(sketch._edits, sketch.EDIT_SCHEMA),
        "op10": language_id.predict(held, models),
        "op3": sentencepiece_codec.encode_documents(docs),
    }
    for name, found in by_name.items():
        rows = found.collect()
        assert len(rows) == len(HARD) + 1 and sum(r.doc_id == 77 for r in rows) == 1, name
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    assert toxicity.score_documents(held.limit(0), scorer).count() == 0
    assert language_id.predict(held.limit(0), models).count() == 0
    assert sketch.with_next(docs.select("doc_id", "text").limit(0)).mapInArrow(sketch._edits, sketch.EDIT_SCHEMA).count() == 0


def test_toxicity_learns_from_document_labels_and_locates_sentences(spark):
    rows, labels = [], []
    for i in range(300):
        parts = [sentences(1000 * i + k, 8) for k in range(6)]
        if i % 5 == 0:
            parts[i % 6] += " scumbag"
        rows.append((i, ". ".join(parts) + ".", "en", "a"))
        labels.append((i, int(i % 5 == 0)))
    docs = documents(spark, [*rows, *HARD], "score toxic").withColumn("held_out", common.held_out(4))
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (4, None)], "doc_id long, toxic int")
    scorer = toxicity.train(docs.where("not held_out"), marks)
    found = toxicity.score_documents(docs.select("doc_id", "text", "held_out"), scorer).collect()
    assert len(found) == len(rows) + len(HARD)
    for r in found:
        if r.doc_id is not None and r.doc_id >= 10 and r.doc_id < 300:
            assert r.predicted == (r.doc_id % 5 == 0)
            assert [rows[r.doc_id][1][s.start : s.end].count("scumbag") for s in r.spans] == [1] * (r.doc_id % 5 == 0)
        assert 0 <= r.score <= 1
    assert toxicity.train(docs.limit(0), marks).score("any words")[0] < 1e-6


def test_sketches_against_brute_force_and_merging():
    texts = [sentences(i, 400) for i in range(3)]
    a, b, c = map(sketch.sketch, texts)
    both = sketch.sketch(texts[0] + " " + texts[1])
    assert sketch.containment(a, sketch.merged([a, b])) == 1 and sketch.containment(a, both) > 0.9
    assert sketch.containment(a, c) < 0.1 and sketch.containment(sketch.sketch(""), sketch.sketch(None)) == 1
    words = texts[0].split()
    half = sketch.sketch(" ".join(words[:200]))
    assert sketch.containment(half, a) > 0.95 and abs(sketch.containment(a, half) - 0.5) < 0.2


def slow_sketch(text):
    words = text.encode().lower().split()
    shingles = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    hashes = {xxhash.xxh64_intdigest(s, 42) for s in shingles}
    return {h for h in hashes if h < 2**62 or h == min(hashes)}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_next_document_in_falling_order(spark, parts):
    rows = [*HARD, *[(20 + 3 * i, sentences(i, 12)) for i in range(40)]]
    docs = documents(spark, rows).select("doc_id", "text")
    found = sketch.with_next(docs, parts).mapInArrow(sketch._edits, sketch.EDIT_SCHEMA).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    expected = Counter()
    for r, following in zip(order, order[1:] + order[:1], strict=True):
        text = r[1] or ""
        edited = sketch.edited(text, following[1] or "")
        assert text[: len(text) - len(text) // 3] + (following[1] or "")[: len(text) // 3] == edited
        sets = [slow_sketch(t) for t in (text, edited, following[1] or "")]
        shares = [1.0 if not sets[0] and not s else len(sets[0] & s) / max(1, len(sets[0])) for s in sets[1:]]
        prints = ["".join(f"{h:016x}" for h in sorted(s)) for s in sets[:2]]
        expected[r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints, *shares] += 1
    assert Counter(tuple(r) for r in found) == expected


def test_counts_of_tasks_add_up_beyond_32_bits(spark, monkeypatch):
    texts = [sentences(i, 12) for i in range(30)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    pairs = lm_scoring.pairs_in(np.frombuffer(b"".join(lm_scoring.coded(common.words_of(t)) for t in texts), np.uint8))
    code = lm_scoring.Code.of(pairs)
    whole = lm_scoring.learned(frame, code, 16, 1)
    learner = lm_scoring.Learner(code, 16)
    learner.add([lm_scoring.coded(common.words_of(t)) for t in texts[:5]])
    learner.close()
    before = [c.copy() for c in learner.handed_on()]
    assert learner.counted == 0 and not any(c.any() for c in learner.counts) and any(c.any() for c in before)
    monkeypatch.setattr(lm_scoring, "FULL", 1000)
    # Handing on in parts changes weights that are learned in between, never the sums.
    parts = lm_scoring.learned(frame, code, 16, 1)
    assert all((a == b).all() for a, b in zip(whole.odds, parts.odds, strict=True))
    most = np.array([[0, 2**32 - 2]] * 2, np.uint32).astype(np.int64).sum(axis=0)
    assert most[1] == 2 * (2**32 - 2) and lm_scoring.stored_odds(np.array([most]))[0] >> 2 == round(lm_scoring.MOST * lm_scoring.SCALE / 4)
