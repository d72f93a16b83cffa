"""Toxicity: a factorization machine over the hashed terms of whole texts.

score = sigmoid(bias + sum of term weights + sum over pairs of present terms of the dot product of
their factors), so that a pair, such as an insult with a group's name, can weigh more than its parts.
Terms that tell by themselves and the most frequent others are fitted; the others' penalty is so
much larger that only what many documents show, such as a pair that tells, gives them weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import bounded_sample, held_out, may_learn
from .scratch import Scratch
from .textbatch import PUNCTUATION, U, slices, words_and_prefixes

BUCKET_BITS = 18
PREFIXES = (5, 8)  #: bytes of a word's beginnings that are terms too, for words formed from the same stem
FACTORS = 4
MAX_TRAINING_ROWS = 20_000  #: labelled documents that a model is fitted on, whole texts
MIN_DOCUMENTS = 5  #: a term must be in that many of them
MIN_EVIDENCE = 3.0  #: terms whose share of toxic documents is that many standard errors from the rest's go first, then the most frequent ones
MAX_TERMS = 20_000  #: of the model
MAX_ENTRIES = 1_000_000  #: documents of all its terms together: what the driver fits on is bounded whatever the texts' lengths
STEPS, RATE, PENALTY = 400, 0.05, 5e-5
DOUBT = 200  #: times the penalty for terms of less evidence, which only strong pairs overcome
ROWS, STEP_ENTRIES = 2048, 250_000  #: documents, and entries, of a step, about


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the words and their beginnings."""
    values, row = words_and_prefixes(data, offsets, PUNCTUATION, PREFIXES)
    return (values >> U(64 - BUCKET_BITS)).astype(np.int64), row


def _distinct(bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row << BUCKET_BITS | bucket)
    return key & (1 << BUCKET_BITS) - 1, key >> BUCKET_BITS


@dataclass
class FactorizationMachine:
    place: np.ndarray  #: of each bucket's term among the weights, -1 if it has none
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, term: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Log odds of n rows; (term, row) are the present terms by row."""
        out = self.bias + np.bincount(row, self.weights[term], n)
        for f in self.factors.T:
            v = f[term]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, row = terms(data, offsets)
        n = len(offsets) - 1
        known = self.place[bucket] >= 0
        bucket, row = _distinct(bucket[known], row[known])
        return 1 / (1 + np.exp(-np.clip(self.raw(self.place[bucket], row, n), -30, 30)))


def screened(seen: np.ndarray, toxic: np.ndarray, share: float, entries: int | None = None) -> tuple[np.ndarray, int]:
    """(place, telling): the place of each bucket's term in the model, -1 for those that have none, and how many tell by themselves; ``seen`` and ``toxic`` count documents by bucket.

    Terms that tell by themselves come first, by their evidence. Terms that don't may tell together
    with others, so the rest of the room goes to the most frequent ones, of which pairs are found.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        evidence = np.abs(toxic - seen * share) / np.sqrt(seen * share * (1 - share))
    evidence[~np.isfinite(evidence) | (evidence < MIN_EVIDENCE)] = 0
    order = np.lexsort((np.arange(len(seen)), -seen, -evidence))
    chosen = order[seen[order] >= MIN_DOCUMENTS][:MAX_TERMS]
    chosen = chosen[np.cumsum(seen[chosen]) <= (MAX_ENTRIES if entries is None else entries)]
    place = np.full(len(seen), -1)
    place[chosen] = np.arange(len(chosen))
    return place, int(np.count_nonzero(evidence[chosen]))


def train(term: np.ndarray, row: np.ndarray, label: np.ndarray, place: np.ndarray, telling: int | None = None) -> FactorizationMachine:
    """Fit on the present terms, as places, of the rows, both by row; the same input gives the same model.

    Steps of Adam on parts of the rows, dealt out in a fixed order. Terms from place ``telling`` on
    are doubted. Without rows of both labels the score is the labels' share of 1 everywhere (0
    without rows).
    """
    n, m = len(label), int(place.max(initial=-1)) + 1
    share = float(label.mean()) if n else 0.0
    if not 0 < share < 1:
        return FactorizationMachine(np.full(len(place), -1), 30.0 if share else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    random = np.random.default_rng(7)
    model = FactorizationMachine(place, float(np.log(share / (1 - share))), np.zeros(m), random.normal(0, 0.05, (m, FACTORS)))
    turn = random.permutation(n) % max(-(-n // ROWS), -(-len(term) // STEP_ENTRIES))
    batches = []
    for k in range(turn.max() + 1):
        own = turn == k
        kept = own[row]
        batches.append((term[kept], (np.cumsum(own) - 1)[row[kept]], label[own]))
    penalty = PENALTY * np.where(np.arange(m) < (m if telling is None else telling), 1.0, DOUBT)
    values = [model.weights, *(model.factors[:, f] for f in range(FACTORS))]
    first, second = [np.zeros(m) for _ in values], [np.zeros(m) for _ in values]
    for step in range(1, STEPS + 1):
        term, row, label = batches[step % len(batches)]
        n = len(label)
        looked = [f[term] for f in model.factors.T]
        sums = [np.bincount(row, v, n) for v in looked]
        raw = model.bias + np.bincount(row, model.weights[term], n) + 0.5 * sum(s * s - np.bincount(row, v * v, n) for s, v in zip(sums, looked))
        error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label
        model.bias -= RATE * error.mean()
        e = error[row]
        gradients = [np.bincount(term, e, m), *(np.bincount(term, e * (s[row] - v), m) for s, v in zip(sums, looked))]
        for k, g in enumerate(gradients):
            g = g / n + penalty * values[k] * (1 if k == 0 else 4)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            values[k] -= RATE * min(1, 2 - 2 * step / STEPS) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAINING_ROWS) -> FactorizationMachine:
    """Learn from at most ``most`` labelled documents that may be learned from.

    A document labelled more than once takes the largest label, and one of several rows its
    smallest text, so that no id adds rows; null labels, ids and texts teach nothing. The driver
    gets two counts for each bucket, from which it screens the terms, and then the sample's lists of
    screened terms, at most MAX_ENTRIES in all.
    """
    known = labels.where(may_learn(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(bounded_sample(known, "id", most)), "id")
    texts = Scratch(docs.sparkSession, "toxicity").save(texts.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")), "sample")
    kind = texts.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, 1 << BUCKET_BITS), np.int64)  # documents by bucket and label, and in all
        for batch in batches:
            toxic = batch.column(1).to_numpy() == 1
            sums[2, 0], sums[3, 0] = sums[2, 0] + len(toxic), sums[3, 0] + toxic.sum()
            for first, data, offsets in slices(batch.column(2)):
                bucket, row = _distinct(*terms(data, offsets))
                sums[0] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
                sums[1] += np.bincount(bucket[toxic[first + row]], minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[0, at], sums[2, 0])), pa.array(np.append(sums[1, at], sums[3, 0]))], ["bucket", "seen", "toxic"])

    counts = texts.mapInArrow(count, "bucket long, seen long, toxic long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow()
    bucket, seen, toxic = (counts.column(c).to_numpy() for c in ("bucket", "seen", "toxic"))
    sums = np.zeros((2, 1 << BUCKET_BITS))
    sums[:, bucket[bucket >= 0]] = seen[bucket >= 0], toxic[bucket >= 0]
    n = max(1, int(seen[bucket < 0].sum()))
    place, telling = screened(*sums, int(toxic[bucket < 0].sum()) / n)
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[np.ndarray] = []
            for _, data, offsets in slices(batch.column(2)):
                bucket, row = _distinct(*terms(data, offsets))
                known = shared.value[bucket] >= 0
                term, at = shared.value[bucket[known]].astype(np.int32), np.searchsorted(row[known], np.arange(len(offsets)))
                lists += [term[a:b] for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["id", "label", "terms"])

    table = texts.mapInArrow(run, f"id {kind}, label int, terms array<int>").toArrow().sort_by([("id", "ascending")])
    lists = table.column("terms").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if table.num_rows else np.zeros(0, np.int64)
    return train(lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(table.num_rows), sizes), table.column("label").to_numpy().astype(float), place, telling)


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """All columns and ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5); a null or empty text has the score of no terms.

    Columns of those names are replaced; repeated rows and null ids stay as they are.
    """
    docs = docs.drop("score", "predicted")
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    place, names = docs.columns.index(text_col), [*docs.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(data, offsets) for _, data, offsets in slices(batch.column(place))]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values), pa.array((values >= 0.5).astype(np.int32))], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


__all__ = ["FactorizationMachine", "fit", "held_out", "score", "train"]
