"""Toxicity of texts: logistic regression on hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features are the distinct words, word pairs and pairs with one word between, each hashed into ``1 << bits`` buckets.
Every coordinate has a learning rate of its own, and an L1 penalty leaves most weights at exactly zero, so the model is a
short sorted list of buckets and weights. Its size is bounded by the number of buckets whatever the corpus, and it is
broadcast. Scoring reads every whole text once, where it lies.

Training is online and goes through the rows one by one. It takes a bounded sample of the labelled rows, ``max_rows``,
chosen by a hash of their keys; each row's features are made where the row lies, and one task steps through them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import REMEMBERED, mix

#: Marks around a word.
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class PlainHashes(dict):
    """Word -> hash of the word in lower case without marks around it, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        plain = _EDGES.sub("", word.decode("utf-8", "replace").lower())
        number = self[word] = xxhash.xxh64_intdigest(plain.encode("utf-8", "replace")) if plain else 0
        return number


_HASHES = PlainHashes()


def features(text: bytes, bits: int) -> np.ndarray:
    """Buckets of a text, with repeats: words, pairs of neighbours, pairs with one word between."""
    words = text.split()
    numbers = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    numbers = numbers[numbers != 0]
    pairs = numbers[:-1] * np.uint64(0x9E3779B97F4A7C15) + numbers[1:]
    skips = numbers[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + numbers[2:] + np.uint64(1)
    return (mix(np.concatenate([numbers, pairs, skips])) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Settings:
    """``alpha`` and ``beta`` shape the rates per coordinate, ``l1`` and ``l2`` the penalties."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    epochs: int = 4
    max_rows: int = 16_000


@dataclass(frozen=True)
class Model:
    """Nonzero weights by bucket, in rising order."""

    bits: int
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        """Probability of label 1; that of the bias alone for a text without known features."""
        total = self.bias
        if len(self.buckets):
            found = features(text, self.bits)
            place = np.minimum(np.searchsorted(self.buckets, found), len(self.buckets) - 1)
            total += float(self.weights[np.unique(place[self.buckets[place] == found])].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def ftrl(rows: list[tuple[np.ndarray, int]], settings: Settings) -> Model:
    """Weights after stepping through (distinct buckets, label) rows, ``epochs`` times."""
    size = (1 << settings.bits) + 1  # the last place is the bias, which has no penalty
    z, n = np.zeros(size), np.zeros(size)

    def weight(places: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[places]) * np.maximum(np.abs(z[places]) - np.where(places == size - 1, 0.0, settings.l1), 0)
        return -shrunk / ((settings.beta + np.sqrt(n[places])) / settings.alpha + np.where(places == size - 1, 0.0, settings.l2))

    for _ in range(settings.epochs):
        for buckets, label in rows:
            places = np.append(buckets, size - 1)
            now = weight(places)
            gradient = 1 / (1 + np.exp(-np.clip(now.sum(), -35, 35))) - label
            seen = n[places]
            z[places] += gradient - (np.sqrt(seen + gradient * gradient) - np.sqrt(seen)) / settings.alpha * now
            n[places] = seen + gradient * gradient
    everything = weight(np.arange(size))
    kept = np.flatnonzero(everything[:-1])
    return Model(settings.bits, kept, everything[kept], float(everything[-1]))


def remainder(key: Column, parts: int = 5) -> Column:
    """crc32 of a key as text, modulo ``parts``; 0 for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def train(
    df: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", settings: Settings = Settings()  # noqa: B008
) -> Model:
    """A model of ``label`` (0 or 1) in ``labels``, joined by ``key`` with the texts in ``df``.

    Of the labelled keys the ``max_rows`` least by hash are used: that many keys and labels are broadcast, and no text
    is shuffled. A key with several labels counts with the highest; labels other than 0 and 1, and null keys, are left out;
    of rows that repeat a key one is used. Null texts count as empty. Without any row the model scores everything 0.5.
    """
    chosen = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    chosen = chosen.groupBy("key").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(settings.max_rows)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    rows = rows.select("text", "label", F.col("key").cast("string").alias("key"))
    bits = settings.bits

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(value.as_py() or b"", bits)).astype(np.int32) for value in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["buckets", "label", "key"])

    # Features are made where the texts lie; one task steps through one row per key in a fixed order.
    made_rows = rows.mapInArrow(made, "buckets array<int>, label int, key string").groupBy("key").agg(F.min(F.struct("buckets", "label")).alias("row"))

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for buckets, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows.append((np.array(buckets.values, np.int32), label))
        model = ftrl(rows, settings)
        buckets = np.append(model.buckets, -1)
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.append(model.weights, model.bias))], ["bucket", "weight"])

    ordered = made_rows.select("row.buckets", "row.label", F.xxhash64("key").alias("order")).repartition(1).sortWithinPartitions("order", "label")
    weights = ordered.select("buckets", "label").mapInArrow(stepped, "bucket bigint, weight double").toPandas().sort_values("bucket")
    kept = weights[weights["bucket"] >= 0]
    return Model(bits, kept["bucket"].to_numpy(np.int64), kept["weight"].to_numpy(float), float(weights.loc[weights["bucket"] < 0, "weight"].sum()))


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all if None) and the probability of label 1 as ``into``, which replaces a column of that name.

    Null texts count as empty. Every row comes back once.
    """
    kept = [name for name in (df.columns if columns is None else columns) if name != into]
    schema = df.select(*[F.col(f"`{name}`") for name in kept]).schema.add(into, "double", False)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([shared.value.score(value.as_py() or b"") for value in batch.column(0).cast(pa.binary())], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], [*kept, into])

    given = df.select(F.col(f"`{text}`").alias("_scored_text"), *[F.col(f"`{name}`") for name in kept])
    return given.mapInArrow(run, schema)
