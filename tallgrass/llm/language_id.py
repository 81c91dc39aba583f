"""Language identification with interpolated Kneser-Ney character models.

Each language has a character 4-gram model. The models lie side by side in sorted key arrays, one
for each order: a row has the gram's log-probability in every language, so one binary search
serves all of them. A text gets the language of least cross-entropy a character, and is rejected
if that lies far beyond what texts of its language and length reach that were kept out of the
counts: SPREADS times as far above their median as their ninth decile is, and above all but one in
200 of them, and at least LEAST_FACTOR times the median. Neither moves for a few odd or mislabelled texts.

Counting runs on a bounded sample of labelled texts (whole texts, chosen by hash): MAX_TRAIN_CHARS
for each language, less where there are so many languages that MODEL_CELLS is passed. A character
has one gram at most, so the arrays, which are broadcast, have no more than MODEL_CELLS cells each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 4
MAX_TRAIN_CHARS = 2_000_000
#: Log-probabilities in an array at most: grams times languages.
MODEL_CELLS = 1 << 26
#: A text is rejected beyond so many times the calibration texts' distance from median to ninth decile.
SPREADS = 6.0
#: No text is rejected below so many times the median: mixed languages and inserted passages stay.
LEAST_FACTOR = 1.6
#: Lengths in characters from which on texts are compared with each other.
BANDS = (1, 20, 50, 200, 1000)
#: A language's texts of a band speak for themselves from this number on; else all languages' do. Their tail counts from FULL_BAND on.
OWN_BAND, FULL_BAND = 30, 1000
#: Of the sample, the share that is not counted but sets the limits of rejection.
CALIBRATION_SHARE = 0.2
#: Characters that count for the confidence of a long text.
CONFIDENT_CHARS = 40
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def normalised(text: str) -> np.ndarray:
    """Code points in lower case, runs of other than letters as one space, led by ORDER - 1 spaces; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    # 16 bits a character: exact for the Basic Multilingual Plane, a hash beyond it.
    codes = np.where(letter, (codes ^ (codes >> 16)) & 0xFFFF, 32)[keep]
    lead = ORDER - (0 if codes[0] == 32 else 1)
    return np.r_[np.full(max(lead - int(codes[0] == 32), 0), 32), codes].astype(np.uint64)


def grams(codes: np.ndarray) -> np.ndarray:
    """The packed 4-gram that ends at each character after the leading spaces."""
    n = len(codes) - (ORDER - 1)
    packed = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER):
        packed = (packed << np.uint64(16)) | codes[i : i + n]
    return packed


def _lower(keys: np.ndarray, order: int) -> np.ndarray:
    """The last order characters of packed grams."""
    return keys & np.uint64((1 << (16 * order)) - 1)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, keys)
    np.minimum(at, len(sorted_keys) - 1, out=at)
    return at, sorted_keys[at] == keys


@dataclass
class Models:
    """languages, and for each order: sorted grams with log-probabilities, sorted contexts with log back-off weights."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = -16 * np.log(2.0)
    limits: np.ndarray | None = None

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """A row for each packed gram: log P(last character | the others) in every language."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), self.floor, np.float32)
        at, found = _find(self.grams[order - 1], keys)
        out = self.logp[order - 1][at]
        missing = np.flatnonzero(~found)
        if len(missing):
            rest = self.log_probabilities(_lower(keys[missing], order - 1), order - 1)
            at, found = _find(self.contexts[order - 1], keys[missing] >> np.uint64(16))
            out[missing] = rest + np.where(found[:, None], self.backoff[order - 1][at], np.float32(0))
        return out

    def cross_entropies(self, text: str | None) -> tuple[np.ndarray, int]:
        """Nats a character in every language, and the number of characters; none without letters."""
        keys = grams(normalised(text)) if text else np.empty(0, np.uint64)
        if not len(keys) or not self.languages:
            return np.zeros(len(self.languages)), len(keys)
        return -self.log_probabilities(keys).sum(axis=0, dtype=np.float64) / len(keys), len(keys)

    def decide(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, confidence, nats a character, and whether the text is rejected."""
        entropies, n = self.cross_entropies(text)
        if not n or not self.languages:
            return UNDETERMINED, 0.0, None, not n
        best = int(entropies.argmin())
        spread = np.exp((entropies[best] - entropies) * min(n, CONFIDENT_CHARS))
        rejected = self.limits is not None and bool(entropies[best] > self.limits[best, band(n)])
        return self.languages[best], float(1 / spread.sum()), float(entropies[best]), rejected


def band(n: int) -> int:
    """The number of the band of texts with n characters."""
    return max(0, sum(n >= b for b in BANDS) - 1)


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


def _groups(sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
    return sorted_ids[starts], starts


def build(languages: list[str], counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from each language's distinct packed 4-grams and their counts."""
    models = Models(languages)
    counts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for i, language in enumerate(languages):
        keys, n = counted[language]
        by_key = np.argsort(keys)
        counts[ORDER, i] = keys[by_key], n[by_key].astype(np.float64)
        for order in range(ORDER - 1, 0, -1):
            # Below the top, a gram counts once for each distinct character before it.
            lower, n = np.unique(_lower(counts[order + 1, i][0], order), return_counts=True)
            counts[order, i] = lower, n.astype(np.float64)
    characters = max(len(counts[1, i][0]) for i in range(len(languages))) + 1
    models.floor = -float(np.log(characters))
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([counts[order, i][0] for i in range(len(languages))]))
        contexts = np.unique(union >> np.uint64(16))
        logp, backoff = np.empty((len(union), len(languages)), np.float32), np.zeros((len(contexts), len(languages)), np.float32)
        lower = np.exp(models.log_probabilities(_lower(union, order - 1), order - 1).astype(np.float64))
        for i in range(len(languages)):
            keys, n = counts[order, i]
            discount = _discount(n)
            own, starts = _groups(keys >> np.uint64(16))
            total, kinds = np.add.reduceat(n, starts), np.diff(np.r_[starts, len(keys)])
            place = np.searchsorted(contexts, own)
            weight = np.ones(len(contexts))
            weight[place] = discount * kinds / total
            sums = np.ones(len(contexts))
            sums[place] = total
            context = np.searchsorted(contexts, union >> np.uint64(16))
            seen = np.zeros(len(union))
            seen[np.searchsorted(union, keys)] = np.maximum(n - discount, 0)
            logp[:, i] = np.log(seen / sums[context] + weight[context] * lower[:, i])
            backoff[:, i] = np.log(weight)
        models.grams.append(union)
        models.logp.append(logp)
        models.contexts.append(contexts)
        models.backoff.append(backoff)
    return models


def train(docs: DataFrame, max_train_chars: int = MAX_TRAIN_CHARS) -> Models:
    """Models of docs' languages (columns doc_id, text, lang), from about max_train_chars characters of each.

    Rows without text or lang are left out. Whole texts are taken, by a hash of doc_id and text.
    Without any row there is no language, and every text is undetermined.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "text", "doc_id")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect() if r["n"]}
    languages = sorted(sizes)
    if not languages:
        return Models([])
    most = min(max_train_chars, MODEL_CELLS // len(languages) ** 2)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, most / sizes[k])))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / (1 << 20) / F.element_at(share, F.col("lang"))
    sample = known.where(draw < 1 - CALIBRATION_SHARE).select("lang", "text")
    other = known.where((draw >= 1 - CALIBRATION_SHARE) & (draw < 1)).select("lang", "text")

    def count(batch: pa.RecordBatch) -> dict:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: dict[str, list] = {"lang": [], "gram": [], "n": []}
        for language in sorted(set(langs)):
            keys = np.concatenate([grams(normalised(t)) for x, t in zip(langs, texts, strict=True) if x == language])
            keys, n = np.unique(keys, return_counts=True)
            out["lang"] += [language] * len(keys)
            out["gram"].append(keys.view(np.int64))
            out["n"].append(n)
        return {k: v if k == "lang" else np.concatenate(v) for k, v in out.items()}

    counted = common.map_rows(sample, "lang string, gram long, n long", count)
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(found.column("lang").to_pylist(), object)
    keys, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    languages = [x for x in languages if (langs == x).any()]
    if not languages:
        return Models([])
    models = build(languages, {x: (keys[langs == x], n[langs == x]) for x in languages})
    models.limits = _limits(models, other)
    return models


def limits_from(languages: list[str], found: list[dict]) -> np.ndarray:
    """Limits (language, band) from rows (lang, band, n, q), q being the median, ninth decile and 0.995 quantile.

    Where a language has too few texts of a band, the other languages' spread there is put on its
    own median; a band that all of them have too few texts of takes the next longer band's, the longest
    one that of all texts.
    """
    out = np.full((len(languages), len(BANDS)), np.inf)
    by_place = {(r["lang"], r["band"]): r for r in found}

    def usual(rows: list[dict], default: float) -> float:
        if sum(r["n"] for r in rows) < OWN_BAND:
            return default
        rows = [r for r in rows if r["n"] >= OWN_BAND] or rows
        return max(float(np.average([r["q"][1] - r["q"][0] for r in rows], weights=[r["n"] for r in rows])), 0.02)

    shared, middles = [usual(found, np.nan)] * (len(BANDS) + 1), {}
    for b in reversed(range(len(BANDS))):
        shared[b] = usual([r for r in found if r["band"] == b], shared[b + 1])
    for language in languages:
        rows = [r for r in found if r["lang"] == language]
        if rows:
            middles[language] = max(rows, key=lambda r: r["n"])["q"][0]
    for i, language in enumerate(languages):
        for b in range(len(BANDS)):
            row = by_place.get((language, b))
            own = row is not None and row["n"] >= OWN_BAND
            middle = row["q"][0] if own else middles.get(language, max(middles.values(), default=np.nan))
            spread = max(row["q"][1] - row["q"][0], 0.02) if own else shared[b]
            if not np.isnan(middle + spread):
                out[i, b] = max(middle + SPREADS * spread, LEAST_FACTOR * middle)
                if own and row["n"] >= FULL_BAND:
                    out[i, b] = max(out[i, b], row["q"][2])
    return out


def _limits(models: Models, other: DataFrame) -> np.ndarray:
    """For each language and band, the cross-entropy beyond which a text is rejected, from texts that were not counted."""
    shared = other.sparkSession.sparkContext.broadcast(models)

    def entropies(batch: pa.RecordBatch) -> dict:
        place = {x: i for i, x in enumerate(shared.value.languages)}
        rows = [(x, *shared.value.cross_entropies(t)) for x, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if x in place]
        rows = [(x, band(n), float(e[place[x]])) for x, e, n in rows if n]
        kinds = (pa.string(), pa.int32(), pa.float64())
        return {name: pa.array([r[i] for r in rows], kinds[i]) for i, name in enumerate(("lang", "band", "h"))}

    spread = common.map_rows(other, "lang string, band int, h double", entropies).groupBy("lang", "band")
    found = spread.agg(F.count("*").alias("n"), F.percentile_approx("h", [0.5, 0.9, 0.995]).alias("q")).collect()
    return limits_from(models.languages, [r.asDict() for r in found])


PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double, nats double, rejected boolean"


def predict(docs: DataFrame, models: Models) -> DataFrame:
    """A row for each row of docs (doc_id, text, held_out), null texts included."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def per_batch(batch: pa.RecordBatch) -> dict:
        rows = [shared.value.decide(t) for t in batch.column(1).to_pylist()]
        return {
            "doc_id": batch.column(0),
            "held_out": batch.column(2),
            "lang_pred": pa.array([r[0] for r in rows], pa.string()),
            "score": np.array([r[1] for r in rows]),
            "nats": pa.array([r[2] for r in rows], pa.float64()),
            "rejected": pa.array([r[3] for r in rows], pa.bool_()),
        }

    return common.map_rows(docs.select("doc_id", "text", "held_out"), PREDICTION, per_batch)


def accepted(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of docs whose text the models do not reject, with all columns of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("boolean")
    def keep(texts):
        return texts.map(lambda t: not shared.value.decide(t)[3]).astype(bool)

    return docs.where(keep(common.text_or_empty()))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text is null or has no letter get `und` with score 0. Repeated rows get equal rows."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang", common.held_out(4).alias("held_out"))
    return predict(docs, train(docs.where("not held_out")))
