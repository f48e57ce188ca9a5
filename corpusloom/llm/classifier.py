"""Quality classifier: naive Bayes log-count ratios of n-gram indicators, then a linear hinge-loss model by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.rows import map_slices, octets, sliced, unused
from corpusloom.staging import stage

# Features are hashed to 2 ** WIDTH places.
WIDTH = 18
# Labelled documents that the ratios are counted on, at most, and those of them that the hinge-loss model is fitted on;
# the latter have at most so many features in all.
SAMPLE = 200_000
FITTED = 4000
FITTED_PLACES = 1 << 24
# Words of the table from words to hashes that a task keeps.
_REMEMBERED = 1 << 19
# Multipliers that keep the kinds of features apart.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


# A letter is A, a or é and a digit 0.
_KINDS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 233 if c >= 128 else c for c in range(256))


def shape(word: bytes) -> bytes:
    """The kinds of bytes that a word has, in the order in which they first come."""
    return bytes(dict.fromkeys(word.translate(_KINDS)))


class Grams:
    """The n-grams of a text as places: words in lower case and pairs of them, shapes of words and pairs of those.

    Of a pair of equal words the second has a shape of its own, so that repetition is seen in words never met before.
    Indicators: a place counts once however often it occurs.
    """

    def __init__(self, width: int = WIDTH):
        self.shift, self.flags = np.uint64(64 - width), np.zeros(1 << width, bool)
        self.numbers: dict[bytes, int] = {}
        self.hashes = np.zeros((1024, 2), np.uint64)
        self.hash = xxhash.xxh64_intdigest

    def _number(self, word: bytes) -> int:
        n = self.numbers.get(word)
        if n is None:
            n = self.numbers[word] = len(self.numbers)
            if n == len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[n] = self.hash(word.lower()), self.hash(shape(word), 1)
        return n

    def of(self, text: bytes) -> np.ndarray:
        """Ascending places of the features of a text; its length in octaves is one, so every text has some."""
        words = text.split()
        if len(self.numbers) > _REMEMBERED:
            self.numbers.clear()
        ids = list(map(self.numbers.get, words))
        if None in ids:
            ids = list(map(self._number, words))
        ids = np.array(ids, np.int64)
        word, form = self.hashes[ids].T
        form = form.copy()
        form[1:][ids[1:] == ids[:-1]] = np.uint64(1)
        with np.errstate(over="ignore"):
            found = [word * _ODD[0], form * _ODD[1], (word[:-1] * _ODD[2] + word[1:]) * _ODD[0], (form[:-1] * _ODD[3] + form[1:]) * _ODD[1],
                     np.array([len(words).bit_length() + 2], np.uint64) * _ODD[2]]
        for f in found:
            self.flags[f >> self.shift] = True
        places = np.flatnonzero(self.flags)
        self.flags[places] = False
        return places


@dataclass(frozen=True)
class Model:
    """weights by place (ratio times learned weight), bias, and the line that makes a probability of a margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum(dtype=np.float64) / np.sqrt(len(places)) + self.bias)

    def score(self, places: np.ndarray) -> float:
        """The probability of label 1; rounded, so that the order of additions does not show."""
        return round(float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.offset, -500, 500)))), 9)


def ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the counts (places, 2) of texts with label 0 and 1 that have a place."""
    p, q = smooth + counts[:, 1], smooth + counts[:, 0]
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, costs: np.ndarray, passes: int = 40, enough: float = 0.01) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise |w|^2 / 2 + sum of costs * hinge loss, over indicators times ratio / sqrt(number).

    One dual variable per row is optimised at a time in a fixed random order, within 0 and its cost, until no
    projected gradient of a pass exceeds `enough`. The bias is a feature that is always 1.
    """
    n, rng = len(rows), np.random.default_rng(0)
    scale = np.array([1 / np.sqrt(len(r)) for r in rows])
    weights, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(n)
    squares = np.array([np.square(ratio[r]).sum() for r in rows]) * scale**2 + 1
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(n):
            r = rows[i]
            gradient = signs[i] * (scale[i] * weights[r].dot(ratio[r]) + bias) - 1
            projected = min(gradient, 0) if alpha[i] == 0 else max(gradient, 0) if alpha[i] == costs[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / squares[i], 0.0), costs[i])
                step = (new - alpha[i]) * signs[i]
                alpha[i] = new
                weights[r] += step * scale[i] * ratio[r]
                bias += step
        if worst < enough:
            break
    return weights * ratio, bias


def sigmoid_line(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Platt's (slope, offset): the logistic fit of labels on margins, by Newton steps on smoothed targets."""
    hi, lo = (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2)
    target, ab = np.where(good, hi, lo), np.array([0.0, np.log((good.sum() + 1) / ((~good).sum() + 1))])
    x = np.stack([margins, np.ones_like(margins)], 1)

    def loss(ab: np.ndarray) -> float:
        z = x @ ab
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ ab)))
        gradient = x.T @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while loss(ab - size * step) > loss(ab) and size > 1e-6:
            size /= 2
        ab = ab - size * step
        if np.abs(gradient).max() < 1e-6:
            break
    return float(ab[0]), float(ab[1])


def fit(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, cost: float = 0.1, folds: int = 3) -> Model:
    """A model of rows of places. Each class has half of the cost. Margins for the line come from rows left out of a fit."""
    share = np.where(good, good.mean(), (~good).mean())
    signs, costs = np.where(good, 1.0, -1.0), cost * 0.5 / np.maximum(share, 1e-9)
    fold, margins = np.arange(len(rows)) % folds, np.zeros(len(rows))
    for k in range(folds):
        inside, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        model = Model(*dual_descent([rows[i] for i in inside], signs[inside], ratio, costs[inside]), 1.0, 0.0)
        margins[out] = [model.margin(rows[i]) for i in out]
    return Model(*dual_descent(rows, signs, ratio, costs), *sigmoid_line(margins, good))


_LEARNED = "place int, n0 long, n1 long, doc_id long, turn long, quality int, places array<int>"


def _statistics(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """For texts with a chosen label: per task the number of texts of either label that have a place, and for texts to fit on
    their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(width), np.zeros((2, 1 << width), np.int64)
        for batch in batches:
            for part in sliced(batch, "text"):
                fitted = []
                for text, doc_id, turn, quality, fit_on in zip(*(part.column(c).to_pylist() for c in ("text", "doc_id", "turn", "quality", "fit_on"))):
                    places = grams.of(text)
                    counts[quality, places] += 1
                    if fit_on:
                        fitted.append((doc_id, turn, quality, places.astype(np.int32)))
                if fitted:
                    n = len(fitted)
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                         *(pa.array([f[i] for f in fitted], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))))], names)
        there = np.flatnonzero(counts.any(0))
        for at in range(0, len(there), 1 << 16):
            some = there[at:at + (1 << 16)]
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(counts[0, some]), pa.array(counts[1, some]), pa.nulls(n, pa.int64()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int32()))], names)

    names = [f.split(" ")[0] for f in _LEARNED.split(", ")]
    # The sample bounds the broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), octets().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.select("text", "doc_id", "turn", "quality", "fit_on").mapInArrow(run, _LEARNED)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fitted: int = FITTED, width: int = WIDTH, **options) -> Model:
    """A model from documents with a label `quality` of 0 or 1; other labels and those without an id are left out.

    At most `sample` labels, chosen by a hash of their id, give the ratios, counted in the tasks that read the
    texts; the first `fitted` of them, one text each (the first by its places), are the rows of the hinge-loss fit on the
    driver, fewer if they had over FITTED_PLACES features in all. If an id has several labels the least counts. With no
    label of one kind the score is the smoothed share of label 1 for every text.
    """
    chosen = (labels.where("quality in (0, 1) and doc_id is not null")
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
              .withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(sample))
    chosen = stage(chosen)
    first = chosen.orderBy("turn", "doc_id").limit(fitted).select("doc_id", F.lit(True).alias("fit_on"))
    chosen = stage(chosen.join(F.broadcast(first), "doc_id", "left").fillna(False, ["fit_on"]))
    found = stage(_statistics(docs, chosen, width))
    # At most 2 ** width rows.
    sums = found.where("place is not null").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.zeros((1 << width, 2))
    counts[sums["place"]] = sums[["n0", "n1"]]
    rows = found.where("place is null").groupBy("doc_id", "turn", "quality").agg(F.min("places").alias("places"))
    sizes = rows.select("turn", "doc_id", "quality", F.size("places").alias("n")).toPandas().sort_values(["turn", "doc_id"])
    sizes = sizes[sizes["n"].cumsum() <= FITTED_PLACES]
    good = sizes["quality"].to_numpy() == 1
    if not good.any() or good.all():
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(1 << width), 0.0, 0.0, float(np.log(share / (1 - share))))
    end = sizes.iloc[-1]
    taken = rows.where((F.col("turn") < int(end["turn"])) | (F.col("turn") == int(end["turn"])) & (F.col("doc_id") <= int(end["doc_id"])))
    listed = taken.select("turn", "doc_id", "places").toPandas().sort_values(["turn", "doc_id"])["places"]
    return fit([np.asarray(p, np.int64) for p in listed], good, ratios(counts), **options)


def with_score(docs: DataFrame, model: Model, width: int = WIDTH) -> DataFrame:
    """The documents with all their columns and score, the model's probability of label 1; a column of that name is replaced."""
    kept = [f for f in docs.schema if f.name.lower() != "score"]
    names, probe = [f.name for f in kept], unused("_octets", docs)

    def make():
        grams = Grams(width)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [model.score(grams.of(t)) for t in batch.column(probe).to_pylist()]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], [*names, "score"])
        return each

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])
    return map_slices(docs.select(*names, octets().alias(probe)), probe, schema, make)


def held_out(doc_id: str = "doc_id") -> Column:
    """A fifth of the documents by their id, never learned from; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by a model of the labels that are not held out.

    score is the probability that labels.quality is 1, predicted 1 from the threshold on. Only texts are looked at: a null
    text scores like an empty one, repeated rows alike, other columns do not matter. Empty documents give an
    empty result, without labels all scores are 0.5.
    """
    model = learn(docs, labels.where(~held_out()), **options)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
