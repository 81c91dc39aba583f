"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once. At each position the output links
list every piece that ends there, and each relaxes the best score of that position from the
position where it starts: a Viterbi search in a single pass. A character without a piece of its
own is spelt in byte pieces. No piece has a space inside, so the search may stop at spaces and
words that come again are looked up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Log score of a character without a piece, below the least piece.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Pieces:
    """The vocabulary by id: the text of a normal piece (else None), its score, the byte of a byte piece (else -1)."""

    texts: tuple[str | None, ...]
    scores: tuple[float, ...]
    bytes_: tuple[int, ...]

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in ids]
        return cls(
            tuple(None if special[i] else model.id_to_piece(i) for i in ids),
            tuple(model.get_score(i) for i in ids),
            tuple(int(model.id_to_piece(i)[1:-1], 16) if model.is_byte(i) else -1 for i in ids),
        )


class Codec:
    REMEMBERED = 300_000

    def __init__(self, pieces: Pieces):
        self.byte_id = {b: i for i, b in enumerate(pieces.bytes_) if b >= 0}
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary needs a piece for each byte")
        self.printed = [
            bytes([b]) if b >= 0 else (t or "").replace(SPACE, " ").encode()
            for t, b in zip(pieces.texts, pieces.bytes_, strict=True)
        ]
        normal = [(t, i) for i, t in enumerate(pieces.texts) if t]
        self.unknown = min(pieces.scores[i] for _, i in normal) - UNKNOWN_PENALTY
        self._build(normal, pieces.scores)
        # Where no piece joins a space to what is before it, or a line end to anything, texts may be cut.
        line = "" if any("\n" in t and len(t) > 1 for t, _ in normal) else "\n"
        joined = any(SPACE in t.lstrip(SPACE) for t, _ in normal)
        self.cut = re.compile(f"(?s:.+)" if joined else f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+|\n")
        self.known: dict[str, bytes] = {}

    def _build(self, normal: list[tuple[str, int]], scores: tuple[float, ...]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.depth, self.piece, self.score = [0], [-1], [0.0]
        for text, i in normal:
            node = 0
            for c in text:
                child = self.children[node].get(c)
                if child is None:
                    child = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.depth.append(self.depth[node] + 1)
                    self.piece.append(-1)
                    self.score.append(0.0)
                node = child
            self.piece[node], self.score[node] = i, scores[i]
        self.failure, self.output = [0] * len(self.children), [0] * len(self.children)
        queue = list(self.children[0].values())
        for node in queue:
            for c, child in self.children[node].items():
                back = self.failure[node]
                while back and c not in self.children[back]:
                    back = self.failure[back]
                back = self.children[back].get(c, 0)
                self.failure[child] = back
                self.output[child] = back if self.piece[back] >= 0 else self.output[back]
                queue.append(child)

    def best_path(self, text: str) -> list[int]:
        """Ids of the segmentation with the greatest sum of scores; of equal ones the longest last piece wins."""
        children, failure, output, piece, depth, score = (
            self.children, self.failure, self.output, self.piece, self.depth, self.score,
        )
        best, start, chosen = [0.0], [0], [-1]
        node = 0
        for end, c in enumerate(text, 1):
            while node and c not in children[node]:
                node = failure[node]
            node = children[node].get(c, 0)
            top, where, what, single = -np.inf, end - 1, -1, False
            at = node if piece[node] >= 0 else output[node]
            while at:
                begin = end - depth[at]
                single = begin == end - 1
                value = best[begin] + score[at]
                if value > top:
                    top, where, what = value, begin, piece[at]
                at = output[at]
            if not single and best[end - 1] + self.unknown > top:
                top, where, what = best[end - 1] + self.unknown, end - 1, -1
            best.append(top)
            start.append(where)
            chosen.append(what)
        ids, end = [], len(text)
        while end:
            begin = start[end]
            if chosen[end] >= 0:
                ids.append(chosen[end])
            else:
                ids += [self.byte_id[b] for b in reversed(text[begin:end].encode())]
            end = begin
        return ids[::-1]

    def _part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            found = np.array(self.best_path(part), np.int32).tobytes()
            if len(part) <= 64:
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                self.known[part] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the text, a space put before it; none for a null or empty text.

        A literal U+2581 is spelt in bytes, so that decoding gives it back.
        """
        if not text:
            return np.empty(0, np.int32)
        parts, literal = [], np.array([self.byte_id[b] for b in SPACE.encode()], np.int32).tobytes()
        for i, plain in enumerate((" " + text).split(SPACE)):
            parts += [literal] if i else []
            parts += map(self._part, self.cut.findall(plain.replace(" ", SPACE)))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that encode puts first."""
        text = b"".join(map(self.printed.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


ENCODED = "doc_id long, n_chars long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean"


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """A row for each row of docs (doc_id, text): its ids, and what they decode to as a digest.

    A null text has no ids and decodes to the empty text. The model file is read on the driver;
    tasks get its pieces, whose number is fixed. Columns other than doc_id and text are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                decoded = [codec.decode(x) for x in ids]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = [
                    part.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                    pa.array([a == b for a, b in zip(texts, decoded, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_tokens", "ids", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to; none for a null or empty text."""
    return encode_documents(common.documents(spark, sf_dir))
