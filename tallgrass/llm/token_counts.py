"""Word-piece counts by a linear longest-match automaton.

The vocabulary's trie has, at each node, a failure link and the number of pieces that greedy
longest match pops when it follows the link. A word is read once, byte by byte; a byte that the
node cannot continue with pops pieces and follows links until it can. Counts add up without any
piece being built.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class PieceCounter:
    """Counts the pieces of words; a word is matched with a space before it, as word-initial pieces are stored."""

    REMEMBERED = 300_000

    def __init__(self, vocabulary: list[bytes]):
        pieces = set(vocabulary)
        if any(bytes([b]) not in pieces for b in range(256)):
            raise ValueError("the vocabulary needs each single byte, so that every word can be cut")
        self.children: list[dict[int, int]] = [{}]
        parents, whole = [(0, 0)], [False]
        for piece in sorted(pieces):
            node = 0
            for b in piece:
                child = self.children[node].get(b)
                if child is None:
                    child = self.children[node][b] = len(self.children)
                    self.children.append({})
                    parents.append((node, b))
                    whole.append(False)
                node = child
            whole[node] = True
        # A node is visited after its parent; its link is no deeper than its parent's, plus one.
        self.failure, self.popped, self.rest = [[0] * len(self.children) for _ in range(3)]
        order = [0]
        for node in order:
            order += self.children[node].values()
        for node in order[1:]:
            parent, b = parents[node]
            if whole[node]:
                self.failure[node], self.popped[node] = 0, 1
            else:
                count, back = self.popped[parent], self.failure[parent]
                while b not in self.children[back]:
                    count += self.popped[back]
                    back = self.failure[back]
                self.failure[node], self.popped[node] = self.children[back][b], count
            self.rest[node] = self.popped[node] + self.rest[self.failure[node]]
        self.known: dict[bytes, int] = {}

    def match(self, word: bytes) -> int:
        """Pieces of the byte string by greedy longest match."""
        children, failure, popped = self.children, self.failure, self.popped
        node = count = 0
        for b in word:
            while b not in children[node]:
                count += popped[node]
                node = failure[node]
            node = children[node][b]
        return count + self.rest[node]

    def word(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            found = self.match(b" " + word)
            if len(word) <= 64:
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def count(self, text: str | None) -> tuple[int, int]:
        """Words (runs without ASCII white space) and their pieces."""
        words = text.encode().split() if text else []
        return len(words), sum(map(self.word, words))


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """A row for each row of docs (doc_id, text): n_words and n_tokens; a null or empty text has none of either."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shared.value)
        for batch in batches:
            counts = np.array([counter.count(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 2)
            columns = [batch.column(0), pa.array(counts[:, 0].copy()), pa.array(counts[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and piece counts of every document; none for a null or empty text."""
    return count_tokens(common.documents(spark, sf_dir))
