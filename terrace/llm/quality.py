"""Quality grades by an ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import body, map_batches, mix64, text_slices, words_of, written
from terrace.llm.toxicity import held_out

#: Bound of what training looks at: rated rows (about).
TRAINING_ROWS = 20_000
#: Hashed features: words, and triples of character classes.
WORDS, SHAPES = 4096, 4096
STEPS, PACE, RIDGE = 80, 8.0, 1e-6
#: Texts that are described at once, however short; bounds their dense features.
SLICE_ROWS = 256
#: A document is kept if its grade reaches ``KEPT_GRADE`` with at least this probability.
KEPT_GRADE, KEPT_CHANCE = 1, 0.5

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def text_features(texts: list[str | None]) -> np.ndarray:
    """Unit rows: damped counts of hashed words, and of hashed triples of character classes."""
    n = len(texts)
    hashes, owner = words_of(texts)
    cells = owner.astype(np.int64) * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64)
    words = np.bincount(cells, minlength=n * WORDS).reshape(n, WORDS)
    raw = [(t or "").encode() for t in texts]
    # Two blanks between texts keep triples of one text from those of the next.
    data = _CLASS[np.frombuffer(b"  ".join(raw) + b"  ", dtype=np.uint8)]
    owner = np.repeat(np.arange(n), [len(r) + 2 for r in raw])[: max(0, len(data) - 2)]
    triples = mix64(data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) % np.uint64(SHAPES)
    shapes = np.bincount(owner.astype(np.int64) * SHAPES + triples.astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)

    def unit(x: np.ndarray) -> np.ndarray:
        x = np.log1p(x)
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    return np.hstack([unit(words), unit(shapes)])


@dataclass
class OrdinalModel:
    """One weight vector for all grades; ``P(grade <= k) = sigmoid(thresholds[k] - weights . x)``, thresholds in order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for each threshold."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - (x @ self.weights)[:, None], -30, 30)))


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """The first threshold, then positive gaps: the order holds by construction."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def likelihood_slopes(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood, and its slopes by each score and each threshold."""
    bounds = np.concatenate([[-40.0], thresholds, [40.0]])

    def below(k: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(bounds[k] - score, -35, 35)))

    high, low = below(grade + 1), below(grade)
    p = np.maximum(high - low, 1e-9)
    up, down = high * (1 - high) / p, low * (1 - low) / p
    by_threshold = np.bincount(grade, weights=down, minlength=len(thresholds) + 1)[1:] - np.bincount(grade, weights=up, minlength=len(thresholds) + 1)[:-1]
    return float(-np.log(p).sum()), up - down, by_threshold


def fit(docs: DataFrame, ratings: DataFrame, grades: int, limit: int = TRAINING_ROWS) -> OrdinalModel:
    """Full-batch accelerated gradient; every step sums the slopes of the training rows over the tasks.

    ``ratings`` has ``doc_id, grade`` (0 to ``grades - 1``); null grades and
    held-out ids don't teach; the lowest grade of an id counts. About ``limit``
    rows at most, chosen by a hash of the id. Without ratings all texts get
    the same even chances.
    """
    usable = ratings.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    share = min(1.0, limit / max(1, usable.count()))
    chosen = usable.where(F.col("grade").between(0, grades - 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000))
    rows = docs.select("doc_id", body().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "grade")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_slices(batch, rows=SLICE_ROWS):
                part = batch.slice(start, end - start)
                x = text_features(part.column("text").to_pylist())
                places = [np.flatnonzero(r).astype(np.int32) for r in x]
                values = [r[p].astype(np.float32) for r, p in zip(x, places, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["grade", "places", "values"])

    table = written(map_batches(rows, describe, "grade int, places array<int>, values array<float>"), "quality-training")
    counts = {r.grade: r.n for r in table.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    size = WORDS + SHAPES
    if not total:
        return OrdinalModel(np.zeros(size), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)))
    shares = (np.cumsum([counts.get(g, 0) for g in range(grades)])[:-1] + 0.5) / (total + 1)
    start = np.log(shares / (1 - shares))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    point = np.concatenate([np.zeros(size), free])
    look, last, momentum = point.copy(), point.copy(), 1.0
    for _ in range(STEPS):
        weights, cuts = look[:size], thresholds_of(look[size:])

        def slopes(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights, cuts: np.ndarray = cuts) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size + len(cuts))
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch.column("places")
                owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                places, values = lists.flatten().to_numpy(), batch.column("values").flatten().to_numpy()
                score = np.bincount(owner, weights=values * weights[places], minlength=batch.num_rows)
                _, by_score, by_cut = likelihood_slopes(score, batch.column("grade").to_numpy(), cuts)
                sums[:size] += np.bincount(places, weights=values * by_score[owner], minlength=size)
                sums[size:] += by_cut
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["slopes"])

        found = np.sum([np.array(r.slopes) for r in map_batches(table, slopes, "slopes array<double>").collect()], axis=0) / total
        # Slopes of the free form: the first threshold moves all, a gap moves those after it.
        tail = np.cumsum(found[size:][::-1])[::-1]
        slope = np.concatenate([found[:size] + RIDGE * weights, tail[:1], tail[1:] * np.exp(look[size + 1 :])])
        slope[size:] = np.clip(slope[size:], -0.2, 0.2) / PACE
        point = look - PACE * slope
        ahead = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = point + (momentum - 1) / ahead * (point - last)
        last, momentum = point, ahead
    return OrdinalModel(point[:size], thresholds_of(point[size:]))


def grade_documents(docs: DataFrame, ratings: DataFrame, grades: int = 3, kept_grade: int = KEPT_GRADE, chance: float = KEPT_CHANCE) -> DataFrame:
    """``doc_id, held_out, expected_grade, tail_probability, kept``, one row per input row.

    ``tail_probability`` is that of a grade of ``kept_grade`` or more; the
    document is kept from ``chance`` on. Null and empty texts are graded by the
    thresholds alone. Repeated rows are graded as often as they come; a null
    ``doc_id`` is not held out; other columns are ignored; an empty table gives none.
    """
    model = fit(docs, ratings, grades)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in text_slices(batch, rows=SLICE_ROWS):
                part = batch.slice(start, end - start)
                tails = model.tails(text_features(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, kept_grade - 1])], ["doc_id", "expected_grade", "tail_probability"])

    graded = map_batches(docs.select("doc_id", body().alias("text")), grade, f"doc_id {kind}, expected_grade double, tail_probability double")
    return graded.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= chance).alias("kept"))
