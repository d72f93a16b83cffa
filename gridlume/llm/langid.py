"""Language identification: multinomial naive Bayes over hashed character n-grams.

A slice of texts becomes one sparse matrix of (row, bucket, count), counted once; its product with
the dense, broadcast matrix of log probabilities scores all its rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import bounded_sample, held_out, may_learn
from .textbatch import U, mixed

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
MAX_TRAINING_ROWS = 20_000  #: labelled documents that a model is fitted on, whole texts
EVIDENCE = 32  #: n-grams that count as independent for the score
MAX_LANGUAGES = 1024  #: that a model can tell apart: its matrix, which is broadcast, has so many columns at most
SLICE = 1 << 16  #: characters counted at a time, longer texts in blocks of that size


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about SLICE characters; null is empty."""
    first, out, size = 0, [], 0
    for row, text in enumerate(texts):
        out.append(text or "")
        size += len(out[-1])
        if size >= SLICE or row == len(texts) - 1:
            yield first, out
            first, out, size = row + 1, [], 0


def counted(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bucket, count): the sparse matrix of the hashed n-grams of the lower-cased texts, each between two spaces; of a long text block by block."""
    lowered = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(t) for t in lowered])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    for low in range(0, len(codes), 2 * SLICE):
        part = codes[low : low + 2 * SLICE + max(ORDERS) - 1].astype(U)
        owner = np.searchsorted(ends, np.arange(low, low + len(part)), "right")
        left = ends[owner] - np.arange(low, low + len(part))  # characters to the row's end
        keys = []
        for n in ORDERS:
            at = np.flatnonzero(left[: min(2 * SLICE, len(part) - n + 1)] >= n)
            key = np.full(len(at), n, U)
            for k in range(n):
                key = key << U(21) ^ part[at + k]
            keys.append(owner[at] * buckets + (mixed(key) >> U(40)).astype(np.int64) % buckets)
        key = np.sort(np.concatenate(keys))
        if len(key):
            first = np.flatnonzero(np.diff(key, prepend=-1))
            yield key[first] // buckets, key[first] % buckets, np.diff(np.append(first, len(key)))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  #: log probability of (language, bucket)
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text: the sparse counts of a slice times the log probabilities."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for low, part in _slices(texts):
            total, n = np.zeros((len(part), len(self.languages))), np.zeros(len(part))
            for row, bucket, count in counted(part, self.weights.shape[1]):
                n += np.bincount(row, count, len(part))
                for k, weights in enumerate(self.weights):
                    total[:, k] += np.bincount(row, weights[bucket] * count, len(part))
            total = (total + self.prior) / np.maximum(1.0, n / EVIDENCE)[:, None]
            best = total.argmax(1)  # ties to the first language by code point
            sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for k, text in enumerate(part):
                if has_letter(text):
                    names[low + k], scores[low + k] = self.languages[best[k]], sure[k]
        return names, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_TRAINING_ROWS) -> LanguageModel:
    """Counts of n-grams by language over at most ``most`` whole documents that may be learned from.

    Only (language, bucket, count) rows reach the driver, at most MAX_LANGUAGES x BUCKETS of them; a
    sample with more languages is an error. Null texts and languages and null ids teach nothing;
    rows that share an id teach what each of them says. Without any row the model knows no language.
    """
    chosen = bounded_sample(docs.where(may_learn(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id")).distinct(), "id", most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL").join(F.broadcast(chosen), "id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, other in zip(texts, langs) if other == lang and has_letter(t)]
                if own:
                    if len(found) == MAX_LANGUAGES and lang not in found:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    total = found.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    total[BUCKETS] += len(own)
                    for _, part in _slices(own):
                        for _, bucket, n in counted(part):
                            total[:BUCKETS] += np.bincount(bucket, n, BUCKETS).astype(np.int64)
        for lang, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    sums = rows.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = sums.limit(MAX_LANGUAGES * (BUCKETS + 1) + 1).toArrow()
    languages = sorted(pc.unique(counts.column("lang")).to_pylist())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((len(languages), BUCKETS + 1))
    if languages:
        table[pc.index_in(counts.column("lang"), pa.array(languages)).to_numpy(), counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    smooth = table[:, :BUCKETS] + 0.5
    weights = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
    return LanguageModel(languages, weights, np.log(table[:, BUCKETS] / max(1.0, table[:, BUCKETS].sum())))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``lang_pred`` (a learned language, or ``und`` for a null text or one without letters), ``score`` (0 to 1; 0 for ``und``).

    One row per input row, whole texts, repeated rows and null ids (never held out) included; other
    columns are ignored, so names can't clash. Ties go to the first language by code point.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                names, scores = shared.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores)], ["id", "held_out", "lang_pred", "score"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
