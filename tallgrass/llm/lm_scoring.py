"""Language-model scoring by online logistic context mixing.

A text is coded byte by byte, a byte as the bits of a Huffman code that the training texts give for
the byte before it: even odds for every bit are thus a model of byte pairs. Predictors look up hashed
contexts of the running text: the last three and five bytes, the word so far, the word so far with the
last word of three bytes at most (which tells the language), and the word so far with the word before
it. Each knows how often a bit was set in its context in all training texts, and gives log-odds. A
gate, chosen by how often the last two contexts have been seen, picks a set of weights, and the weighted sum of the log-odds is the prediction. Each bit then moves the text's own
share of the weights by its error, and a refining table of the text, indexed by the mixed log-odds,
corrects the prediction and is moved as well. The sum of the logarithms over all bits is the log
probability of the text.

Bits are counted in all training texts, in tables of bounded size that are added up on the executors;
the weights and the refining table that a text starts from are learned online, from every training text,
by the tasks that count.
A text runs in segments of SEGMENT bits that each start from what was learned; all segments of a
slice run side by side, so each step is an operation on arrays, and a text's score depends on
nothing but the text and the model.

The base score takes each word's training count. Texts are gathered into chunks of bounded size; a
chunk asks once for each of its distinct words, whatever their number of occurrences, and is
answered by a join.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK_BYTES = 10 << 20
#: Characters of a chunk whose tokens and bits are held as arrays at a time.
SLICE_CHARS = 1 << 20
#: Bytes whose contexts are hashed at a time, so that their arrays stay in the processor's cache.
HASHED_BYTES = 1 << 17
#: Slots of the largest table, two to this power: the model's size is bounded by this, not by the corpus.
TABLE_BITS, LEAST_TABLE_BITS = 22, 16
#: Training bytes for each task that counts bits; no more tasks than LEAST_TASKS or an eighth of the shuffle partitions.
TASK_BYTES, LEAST_TASKS = 8 << 20, 12
#: Weights are learned from all training texts, so many bits at a time; a task's first group has FIRST_BYTES, later ones up to HASHED_BYTES.
FIRST_BYTES, LEARN_BITS = 1 << 15, 1 << 12
#: Contexts: so many bytes before, then the word so far, alone, with the last short word, and with the word before it.
ORDERS = (3, 5)
CONTEXTS = len(ORDERS) + 3
#: Bytes of a short word at most.
SHORT = 3
#: By so many halves a context's table is smaller than the largest.
HALVED = (2, 1, 1, 1, 0)
#: Bits after which a task hands on its counts and starts anew, so that none of its 32 bits wraps.
FULL = 1 << 31
#: The last two contexts choose the gate by how often they were seen: never, once, 4 or 32 times.
GATES, SEEN = 16, (1, 4, 32)
PRIOR = 0.1
MOST, STEPS = 12.0, 33
STEP = 2 * MOST / (STEPS - 1)
#: Log-odds are stored as whole numbers of 1 / SCALE; their last two bits say how often the slot was seen.
SCALE = 2560
SEGMENT, BLOCK = 2048, 64
RATE, LEARNING_RATE, REFINE_RATE = 0.01, 0.1, 0.02
SPACE, END = 0x20, 0x0A
_LEAD = 8
_LN10 = float(np.log(10))


# --- bits and their contexts ---------------------------------------------------------------


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each of the counted symbols its path of nodes and bits. Nodes are numbered from the root downwards.

    Each symbol counts once more than it occurs, so that every one has a path.
    """
    size = len(counts)
    heap = [(int(n) + 1, symbol, None) for symbol, n in enumerate(counts)]
    heapq.heapify(heap)
    for new in range(size, 2 * size - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], new, (a, b)))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(size)]
    number, level = 0, [(heap[0], [])]
    while level:
        below = []
        for (_, symbol, children), path in level:
            if children is None:
                paths[symbol] = path
                continue
            below += [(child, [*path, (number, bit)]) for bit, child in enumerate(children)]
            number += 1
        level = below
    return paths


@dataclass
class Code:
    """Huffman codes of the bytes, one for each byte that may come before: paths of nodes and bits, laid end to end."""

    lengths: np.ndarray
    offsets: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray) -> Code:
        """From how often each byte (column) follows each byte (row); rows without counts share one code."""
        known, rare = np.flatnonzero(pairs.any(axis=1)), huffman(np.zeros(256))
        trees = [rare, *(huffman(pairs[b]) for b in known)]
        lengths = np.array([[len(path) for path in tree] for tree in trees], np.int64)
        offsets = (np.cumsum(lengths) - lengths.ravel()).reshape(lengths.shape)
        flat = np.array([step for tree in trees for path in tree for step in path], np.uint8)
        tree = np.zeros(256, np.int64)
        tree[known] = np.arange(1, len(trees))
        return cls(lengths[tree].ravel(), offsets[tree].ravel(), flat[:, 0].copy(), flat[:, 1].copy())


def coded(words: list[bytes]) -> bytes:
    """What is coded of a text: every word and a space, then the end, a byte that no word has."""
    return b" ".join([*words, b"\n"])


_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        base = 0x9E3779B97F4A7C15
        _powers = tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))
    return _powers[0][:n], _powers[1][:n]


def context_slots(data: np.ndarray, table_bits: int) -> list[np.ndarray]:
    """For each context, its slot at every place of data; only places with _LEAD bytes before them count."""
    n = len(data)
    before = np.zeros(n, np.uint64)
    before[_LEAD:] = np.ndarray((n - _LEAD,), "<u8", data.tobytes(), strides=(1,))
    keys = [before >> np.uint64(64 - 8 * k) for k in ORDERS]
    # A word so far: the sum of powers over its bytes, from running sums.
    power, back = _powers_to(n)
    sums = np.zeros(n, np.uint64)
    np.cumsum((data[:-1] + np.uint64(1)) * power[:-1], out=sums[1:])
    starts = np.zeros(n, np.int64)
    breaks = (data[:-1] == SPACE) | (data[:-1] == END)
    np.maximum.accumulate(np.where(breaks, np.arange(1, n), 0), out=starts[1:])
    word = (sums - sums[starts]) * back[starts]
    # Where the last short word ended; an END is no word, and nothing before it counts.
    first = np.flatnonzero(breaks) + 1
    size = first - 1 - starts[first - 1]
    first = first[(size > 0) & (size <= SHORT) | (data[first - 1] == END)]
    ended = np.zeros(n, np.int64)
    ended[first] = first
    np.maximum.accumulate(ended, out=ended)
    keys += [word]
    for other, factor in ((word[ended - 1], 0xA0761D6478BD642F), (word[starts - 1], 0xD6E8FEB86659FD93)):
        keys += [word + np.uint64(factor) * (other + np.uint64(1))]
    out = []
    for k, key in enumerate(keys, 1):
        key ^= key >> np.uint64(32)
        key += np.uint64(k)
        key *= np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0x9E3779B97F4A7C15)
        key >>= np.uint64(64 - table_bits + HALVED[k - 1])
        out.append(key.view(np.int64))
    return out


@dataclass
class Bits:
    """The bits of some coded texts, one after the other: the place of each bit's byte, its node, its value, how many a text has, and each place's slots."""

    slots: list[np.ndarray]
    place: np.ndarray
    node: np.ndarray
    value: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], code: Code, table_bits: int) -> Bits:
        lead = b"\n" * _LEAD
        data = np.frombuffer(b"".join([lead + t for t in texts]), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(sizes + _LEAD) - sizes
        pair = data.astype(np.int64)
        pair[1:] += pair[:-1] << 8
        lengths = code.lengths.take(pair)
        lengths[(first[:, None] - np.arange(1, _LEAD + 1)).ravel()] = 0
        ends = np.cumsum(lengths)
        place = np.repeat(np.arange(len(data)), lengths)
        step = _taken(code.offsets.take(pair) - ends + lengths, place)
        step += np.arange(len(step))
        in_text = np.diff(ends[first + sizes - 1], prepend=0)
        return cls(context_slots(data, table_bits), place, _taken(code.nodes, step), _taken(code.bits, step), in_text)

    def at(self, k: int) -> np.ndarray:
        """The slot of each bit in the table of context k."""
        slots = _taken(self.slots[k], self.place)
        slots ^= self.node
        return slots


def _taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """values[at] for places that are known to be there."""
    return values.take(at, mode="clip")


def in_groups(texts: Iterable[bytes], size: int) -> Iterator[list[bytes]]:
    """texts in order, in groups of at least size bytes but for the last."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def _log_odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds of counts (..., bit), held within MOST."""
    found = counts.astype(np.float32)
    found += np.float32(PRIOR)
    odds = found[..., 1] / found[..., 0]
    np.log(odds, out=odds)
    return np.minimum(np.maximum(odds, -MOST, out=odds), MOST, out=odds)


def _often(counts: np.ndarray) -> np.ndarray:
    """How many of the steps of SEEN the counts (..., bit) have reached; counts of 32 bits are of FULL bits at most."""
    seen = counts[..., 0] + counts[..., 1]
    often = (seen >= SEEN[0]).astype(np.int8)
    for n in SEEN[1:]:
        often += seen >= n
    return often


def stored_odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds of counts (..., bit) as whole numbers of 1 / SCALE, with how often they were seen in the last two bits."""
    whole = np.rint(_log_odds(counts) * np.float32(SCALE / 4)).astype(np.int16)
    return whole * np.int16(4) + _often(counts)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    p = np.exp(-z)
    p += 1
    return np.reciprocal(p, out=p)


class Lanes:
    """Segments of texts side by side, the longest first: where each begins among the bits, its length and its text."""

    def __init__(self, sizes: np.ndarray):
        counts = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        lengths = np.minimum(sizes[text] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-lengths, kind="stable")
        self.text, self.lengths = text[order], lengths[order]
        self.starts = ((np.cumsum(sizes) - sizes)[text] + nth * SEGMENT)[order]

    def blocks(self) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Bits (step, lane) of BLOCK steps at a time, and how many lanes each step has; a lane's last bit fills up its column."""
        most = int(self.lengths[0]) if len(self.lengths) else 0
        for begin in range(0, most, BLOCK):
            steps = np.arange(begin, min(begin + BLOCK, most))
            active = np.searchsorted(-self.lengths, -steps, side="left").tolist()
            lanes = slice(0, active[0])
            yield self.starts[lanes] + np.minimum(steps[:, None], self.lengths[lanes] - 1), active


@dataclass
class Model:
    """Stored log-odds of each context's slots, and the weights (context, gate) and refining table (step) that a text starts from."""

    code: Code
    odds: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray

    def log10(self, texts: list[bytes]) -> np.ndarray:
        """log10 of each coded text's probability."""
        parts = [self._inputs(group) for group in in_groups(texts, HASHED_BYTES)]
        if not parts:
            return np.zeros(0)
        # Each context's parts are dropped as soon as they are joined.
        odds = [np.concatenate([p[0].pop(0) for p in parts]) for _ in range(CONTEXTS)]
        mixed, value, sizes = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        parts.clear()
        lanes = Lanes(sizes)
        logs = np.zeros(len(lanes.starts))
        shift = np.zeros((CONTEXTS, len(logs)), np.float32)
        refined, row = np.tile(self.refined, len(logs)), np.arange(len(logs)) * STEPS
        products, errors, steps = np.empty_like(shift), np.empty(len(logs), np.float32), np.empty(len(logs), np.int64)
        for at, active in lanes.blocks():
            inputs, given = side_by_side(odds, at), _taken(mixed, at)
            bits = _taken(value, at).astype(np.float32)
            # The chance of a set bit; a step that a lane lacks counts as certain.
            mixed_chance, refined_chance = bits.copy(), bits.copy()
            for t, n in enumerate(active):
                x, bit, z, own, moved = inputs[t, :, :n], bits[t, :n], given[t, :n], shift[:, :n], products[:, :n]
                p, r, e, step = mixed_chance[t, :n], refined_chance[t, :n], errors[:n], steps[:n]
                np.multiply(own, x, out=moved)
                z += np.add.reduce(moved, axis=0, out=e)
                np.minimum(np.maximum(z, -MOST, out=z), MOST, out=z)
                np.exp(np.negative(z, out=p), out=p)
                p += 1
                np.reciprocal(p, out=p)
                z *= 1 / STEP
                z += MOST / STEP + 0.5
                np.floor(z, out=step, casting="unsafe")
                step += row[:n]
                refined.take(step, out=r, mode="clip")
                np.subtract(bit, p, out=e)
                e *= RATE
                own += np.multiply(x, e, out=moved)
                np.subtract(bit, r, out=e)
                e *= REFINE_RATE
                e += r
                refined[step] = e
            hit = mixed_chance
            hit += refined_chance
            hit *= np.float32(0.5)
            hit += bits
            hit -= 1
            np.log(np.abs(hit, out=hit), out=hit)
            logs[: active[0]] += hit.sum(axis=0, dtype=np.float64)
        return np.bincount(lanes.text, logs, len(sizes)) / _LN10

    def _inputs(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Of every bit the stored log-odds, one array a context, their sum by the gate's weights, and its value; bits a text."""
        bits = Bits.of(texts, self.code, len(self.odds[-1]).bit_length() - 1)
        odds = [_taken(self.odds[k], bits.at(k)) for k in range(CONTEXTS)]
        gate = gate_of(odds)
        mixed = np.zeros(len(gate), np.float32)
        for k in range(CONTEXTS):
            part = _taken(self.weights[k], gate)
            part *= odds[k]
            mixed += part
        mixed *= np.float32(1 / SCALE)
        return odds, mixed, bits.value, bits.sizes


def gate_of(odds: list[np.ndarray]) -> np.ndarray:
    return (odds[-2] & 3).astype(np.int64) * 4 + (odds[-1] & 3)


def side_by_side(odds: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Log-odds (step, context, lane) of the bits at (step, lane)."""
    out = np.empty((at.shape[0], CONTEXTS, at.shape[1]), np.float32)
    for k in range(CONTEXTS):
        np.multiply(_taken(odds[k], at), np.float32(1 / SCALE), out=out[:, k])
    return out


class Learner:
    """Bit counts of a task's training texts, and weights learned online from the counts of the texts before."""

    def __init__(self, code: Code, table_bits: int):
        self.code, self.table_bits = code, table_bits
        self.counts = [np.zeros((1 << table_bits - halved, 2), np.uint32) for halved in HALVED]
        self.weights = np.full((CONTEXTS, GATES), 0.35)
        self.steps = np.zeros((STEPS, 2))
        self.learned = self.counted = 0
        self.held: list[bytes] = []
        self.wait, self.size = FIRST_BYTES, 0

    def add(self, texts: list[bytes]) -> None:
        """Every group of coded texts is predicted by the counts of those before it, which moves the weights, and then counted."""
        self.held += texts
        self.size += sum(map(len, texts))
        if self.size >= self.wait:
            self.close()

    def close(self) -> None:
        """Takes what is still held back."""
        rest, self.held, self.size = iter(self.held), [], 0
        while group := next(in_groups(rest, self.wait), None):
            bits = Bits.of(group, self.code, self.table_bits)
            self._learn(bits, *self._count_bits(bits))
            self.wait = min(2 * self.wait, HASHED_BYTES)

    def handed_on(self) -> list[np.ndarray]:
        """The counts so far; those that follow begin at zero."""
        found, self.counts, self.counted = self.counts, [np.zeros_like(c) for c in self.counts], 0
        return found

    def _count(self, texts: list[bytes]) -> None:
        if texts:
            self._count_bits(Bits.of(texts, self.code, self.table_bits))

    def _count_bits(self, bits: Bits) -> tuple[np.ndarray, np.ndarray]:
        """Counts the bits; returns the log-odds (context, bit) and the gates that the counts before them gave."""
        self.counted += len(bits.value)
        odds, gates = np.empty((CONTEXTS, len(bits.value)), np.float32), np.zeros(len(bits.value), np.int64)
        for k, table in enumerate(self.counts):
            at = bits.at(k)
            # Both counts of a slot are read as one number; its line is then at hand for the counting.
            before = _taken(table.view(np.uint64).reshape(-1), at).view(np.uint32).reshape(-1, 2)
            at *= 2
            at += bits.value
            np.add.at(table.reshape(-1), at, np.uint32(1))
            odds[k] = _log_odds(before)
            if k >= CONTEXTS - 2:
                gates *= 4
                gates += _often(before)
        return odds, gates

    def _learn(self, bits: Bits, x: np.ndarray, gates: np.ndarray) -> None:
        values = bits.value.astype(np.float32)
        for begin in range(0, len(gates), LEARN_BITS):
            part = slice(begin, begin + LEARN_BITS)
            gate, bit, inputs = gates[part], values[part], x[:, part]
            weights = self.weights.astype(np.float32).take(gate, axis=1, mode="clip")
            z = np.einsum("kn,kn->n", weights, inputs)
            np.minimum(np.maximum(z, -MOST, out=z), MOST, out=z)
            error = bit - _sigmoid(z)
            z += np.float32(MOST + STEP / 2)
            z *= np.float32(1 / STEP)
            steps = z.astype(np.int64)
            steps *= 2
            steps += bits.value[part]
            self.steps += np.bincount(steps, minlength=2 * STEPS).reshape(STEPS, 2)
            times = np.maximum(np.bincount(gate, minlength=GATES), LEARN_BITS // 64)
            for k in range(CONTEXTS):
                self.weights[k] += LEARNING_RATE * np.bincount(gate, error * inputs[k], GATES) / times
            self.learned += len(z)


# --- what the corpus gives -----------------------------------------------------------------


def packed(docs: DataFrame) -> DataFrame:
    """docs (chunk, doc_id, text, held_out) as rows (chunk, blob): compressed Arrow streams, about half of what a shuffle of texts writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            order = np.argsort(chunks, kind="stable")
            blobs, found = [], np.unique(chunks)
            for rows in np.split(order, np.searchsorted(chunks[order], found)[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.take(pa.array(rows)))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], ["chunk", "blob"])

    return docs.select("chunk", "doc_id", "text", "held_out").mapInArrow(run, "chunk int, blob binary")


def unpacked(table: pa.Table) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("blob"))


class Words:
    """The distinct words of a chunk by number; the end token b"" is one of them."""

    def __init__(self, known: Iterable[bytes] = ()):
        self.index: defaultdict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        for word in known:
            self.index[word]
        self.end = self.index[b""]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of a text's tokens: its words, then the end."""
        return np.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)), np.int32(self.end))


def slices(texts: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about SLICE_CHARS characters."""
    start = size = 0
    for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
        size += n or 0
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _ask(table: pa.Table) -> pa.Table:
    """The distinct words of a chunk, with their occurrences in its training texts."""
    number = table.column("chunk")[0].as_py()
    table = unpacked(table)
    held = table.column("held_out").to_pylist()
    known, counts = Words(), np.zeros(1, np.int64)
    for a, b in slices(table.column("text")):
        texts = table.column("text").slice(a, b - a).to_pylist()
        parts = [known.numbers(common.words_of(t)) for t in texts]
        trained = [p for p, h in zip(parts, held[a:b], strict=True) if not h]
        grown = np.bincount(np.concatenate([*trained, np.empty(0, np.int32)]), minlength=len(known.index))
        grown[: len(counts)] += counts
        counts = grown
    n = len(known.index)
    return pa.table({"word": pa.array(list(known.index), pa.binary()), "chunk": pa.array(np.full(n, number, np.int32)), "trained": counts})


def asked(chunked: DataFrame) -> DataFrame:
    """Rows (word, chunk, trained): the distinct words of each chunk and how often its training texts have them."""
    return packed(chunked).groupBy("chunk").applyInArrow(_ask, "word binary, chunk int, trained long")


def pairs_in(data: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """How often each byte (column) follows each byte (row) in data, each place counted so many times."""
    times = None if times is None else times[1:]
    return np.bincount(data[:-1].astype(np.int64) * 256 + data[1:], times, 1 << 16).reshape(256, 256)


def byte_pairs(words: DataFrame) -> np.ndarray:
    """How often each byte follows each byte in the coded texts whose words (word, count) these are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((256, 256))
        for batch in batches:
            found, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            # What precedes a word is a space, but for a text's first one.
            data = np.frombuffer(b"".join([b" " + w + b" " if w else b" \n" for w in found]), np.uint8)
            sizes = np.array([len(w) + 2 for w in found])
            times = np.repeat(n, sizes).astype(np.float64)
            times[np.cumsum(sizes) - sizes] = 0
            total += pairs_in(data, times)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["pair", "n"])

    rows = words.select("word", "count").mapInArrow(count, "pair long, n double")
    out = np.zeros(1 << 16)
    for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(256, 256)


def learned(texts: DataFrame, code: Code, table_bits: int, tasks: int) -> Model:
    """The model of training texts (text): counts and weights of every task, added up block by block on the executors."""
    sizes = [1 << table_bits - halved for halved in HALVED]
    block = min(1 << 16, *sizes)

    def rows(blocks: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
        blobs = [pa.compress(np.ascontiguousarray(v).tobytes(), codec="zstd", asbytes=True) for v in values]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(blobs, pa.binary())], ["block", "counts"])

    def opened(blob: bytes, kind: type, size: int) -> np.ndarray:
        return np.frombuffer(pa.decompress(blob, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)

    learnt = CONTEXTS * GATES + 2 * STEPS + 1

    def tables(counted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        blocks = [part for counts in counted for part in np.split(counts, len(counts) // block)]
        for i in range(0, len(blocks), 16):
            part = blocks[i : i + 16]
            yield rows(list(range(i, i + len(part))), part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(code, table_bits)
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                learner.add([coded(common.words_of(t)) for t in part.column(0).to_pylist()])
                if learner.counted >= FULL:
                    yield from tables(learner.handed_on())
        learner.close()
        weights = np.r_[learner.weights.ravel() * learner.learned, learner.steps.ravel(), learner.learned]
        yield rows([-1], [weights])
        yield from tables(learner.counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = opened(blob, np.float64, learnt) if i < 0 else opened(blob, np.uint32, 2 * block).astype(np.int64)
                sums[i] = sums[i] + part if i in sums else part
        for i, found in sums.items():
            yield rows([i], [found if i < 0 else stored_odds(found.reshape(-1, 2))])

    counted = texts.coalesce(tasks).mapInArrow(count, "block int, counts binary")
    summed = counted.repartition(max(tasks, common.partitions(texts.sparkSession)), "block").mapInArrow(add, "block int, counts binary")
    odds, weights = np.zeros((sum(sizes) // block, block), np.int16), np.zeros(learnt)
    for i, blob in zip(*(c.to_pylist() for c in summed.toArrow().columns), strict=True):
        if i < 0:
            weights = opened(blob, np.float64, learnt)
        else:
            odds[i] = opened(blob, np.int16, block)
    n, steps = weights[-1], weights[CONTEXTS * GATES : -1].reshape(STEPS, 2)
    mean = weights[: CONTEXTS * GATES].reshape(CONTEXTS, GATES) / n if n else np.full((CONTEXTS, GATES), 0.35)
    refined = (steps[:, 1] + _sigmoid(np.linspace(-MOST, MOST, STEPS))) / (steps.sum(axis=1) + 1)
    tables = np.split(odds.ravel(), np.cumsum(sizes)[:-1])
    return Model(code, tables, mean.astype(np.float32), refined.astype(np.float32))


# --- scoring -------------------------------------------------------------------------------

SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double, bits_per_byte double"
)


def score_texts(texts: list[str | None], known: Words, counts: np.ndarray, model: Model, n: int, kinds: int) -> dict[str, np.ndarray]:
    """Scores of some texts by the model, and by the training counts of known words; n tokens of so many kinds were counted."""
    words = [common.words_of(t) for t in texts]
    ids = [known.numbers(w) for w in words]
    sizes = np.array([len(x) for x in ids])
    starts = np.cumsum(sizes) - sizes
    seen = counts[np.concatenate(ids)]
    whole = [coded(w) for w in words]
    score = model.log10(whole)
    return {
        "n_tokens": sizes,
        "n_known": np.add.reduceat((seen > 0).astype(np.int64), starts),
        "train_tokens": np.full(len(texts), n),
        "base_score": np.add.reduceat(np.log10((seen + 1) / (n + kinds + 1)), starts),
        "score": score,
        "bits_per_byte": -score * np.log2(10) / np.array([len(t) for t in whole]),
    }


def score_documents(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, table_bits: int = TABLE_BITS) -> DataFrame:
    """A row for each row of docs (doc_id, text, held_out); the model learns from those not held out.

    A null text is an empty one, which has only the end token. Repeated rows are scored, and
    learned from, one by one. A training text's own words and bits are among the counts that
    score it. Without training texts every bit is even odds. Other columns of docs are left out,
    whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "held_out")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // chunk_bytes)).cast("int")
    chunked = docs.withColumn("chunk", chunk)
    found = common.stored(asked(chunked))
    counts = common.stored(found.groupBy("word").agg(F.sum("trained").alias("count")))
    trained = counts.where("count > 0")
    n, kinds = trained.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    tasks = min(1 + size // TASK_BYTES, max(LEAST_TASKS, common.partitions(spark) // 8))
    table_bits = min(table_bits, max(LEAST_TABLE_BITS, 1 + math.ceil(math.log2(1 + size))))
    training = docs.where("not held_out").select("text")
    shared = spark.sparkContext.broadcast(learned(training, Code.of(byte_pairs(trained)), table_bits, tasks))
    answers = found.select("word", "chunk").join(counts, "word").select("chunk", "word", "count")

    def score(texts: pa.Table, answered: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in out_schema})
        texts = unpacked(texts)
        known, seen = Words(answered.column("word").to_pylist()), answered.column("count").to_numpy()
        out = []
        for a, b in slices(texts.column("text")):
            rows = texts.slice(a, b - a)
            columns = score_texts(rows.column("text").to_pylist(), known, seen, shared.value, n, kinds)
            out.append(pa.table([rows.column("doc_id"), rows.column("held_out"), *map(pa.array, columns.values())], schema=out_schema))
        del texts, answered, known, seen, rows
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    out_schema = pa.schema([(a, types[b]) for a, b in (x.split() for x in SCORES.split(", "))])
    return packed(chunked).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORES)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, null texts included, scored by a model of the documents that are not held out."""
    docs = common.documents(spark, sf_dir)
    return score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.held_out(7).alias("held_out")))
