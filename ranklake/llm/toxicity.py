"""Toxicity scores by FTRL-proximal logistic regression (operator 3).

Features are hashed and binary: single words, word stems (the first four and five
bytes, for inflected forms), pairs of neighbouring words, and skip-grams of words
two apart. FTRL-proximal keeps a rate for each coordinate, and its L1 term leaves
most weights at exactly zero, so the model is a short sparse vector.

Training takes at most ``TRAIN_ROWS`` labelled rows (a documented bound: those of the
smallest hash of doc_id) and runs in one streaming task, whose memory is two dense
vectors and a slice of texts; each epoch reads the sample once more. Rows with crc32(doc_id) % 4 = 2 are held out and
never train. Scoring reads each whole text once, without a shuffle.

Defined cases: a null text is empty; an empty text has the score of the bias alone;
null labels and labels other than 0 and 1 don't train; several labels of one
document all train; no labels at all give a score of 0.5;
null doc_ids score like others and are not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .exchange import bounded, tidy

U64 = np.uint64
BITS = 22
TRAIN_ROWS = 16_000
THRESHOLD = 0.3
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 4.0, 1.0, 2
SLICE = 512 << 10
_BREAKS = np.zeros(256, bool)
_BREAKS[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _BREAKS[_a:_b] = False


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of every feature occurrence; feature 0 is the bias, which every document has."""
    data, offsets = S.text_buffers(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    n = len(offsets) - 1
    ids, owners = [np.zeros(n, np.int64)], [np.arange(n)]
    starts, ends, first = S.words(data, offsets, _BREAKS)
    if len(starts):
        owner = np.repeat(np.arange(n), np.diff(first))
        sums = S.prefix(data)
        word = S.mix(S.range_hash(sums, starts, ends) + (ends - starts).astype(U64))
        found = [(word, owner)]
        for size in (4, 5):
            stem = S.mix(S.range_hash(sums, starts, np.minimum(starts + size, ends)) + U64(1000 + size))
            found.append((stem, owner))
        for gap in (1, 2):
            pair = S.mix(word[:-gap] * U64(0x9E3779B97F4A7C15) + word[gap:] + U64(gap))
            same = owner[:-gap] == owner[gap:]
            found.append((pair[same], owner[:-gap][same]))
        for h, o in found:
            ids.append((h >> U64(64 - BITS)).astype(np.int64) | 1)
            owners.append(o)
    return np.concatenate(ids), np.concatenate(owners)


def by_document(ids: np.ndarray, owners: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct features of each document."""
    key = np.unique(owners * (1 << BITS) + ids)
    return np.split(key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(1, n) << BITS))


def train(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight) of the nonzero weights, from the bounded columns doc_id, text, toxic of ``training_rows``."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

        def weight(i: np.ndarray) -> np.ndarray:
            zi = z[i]
            l1 = np.where(i == 0, 0.0, L1)
            return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

        for b in batches:
            for part in S.slices(b, "text", SLICE):
                docs = by_document(*features(part.column("text")), part.num_rows)
                for i, y in zip(docs, part.column("toxic").to_pylist(), strict=True):
                    w = weight(i)
                    g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                    more = np.sqrt(n[i] + g * g) - np.sqrt(n[i])
                    z[i] += g - more / ALPHA * w
                    n[i] += g * g
        i = np.flatnonzero(n)
        w = weight(i)
        kept = w != 0
        yield pa.RecordBatch.from_arrays([pa.array(i[kept]), pa.array(w[kept])], names=["feature", "weight"])

    # each epoch's rows stream by in order: the task holds the model and a slice of texts
    sample = labelled.where("text is not null").select("doc_id", "text", "toxic").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).repartition(1)
    sample = sample.sortWithinPartitions("epoch", F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "toxic")
    with bounded(labelled.sparkSession):
        model = sample.select("text", "toxic").mapInArrow(tidy(fit), "feature long, weight double").toArrow()
    return model.column("feature").to_numpy(), model.column("weight").to_numpy()


def _scorer(model: tuple[np.ndarray, np.ndarray]):
    """A function from texts to scores, to be called on the executors."""
    at, weights = model

    def make():
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = weights

        def rate(texts: pa.Array) -> np.ndarray:
            ids, owners = features(texts)
            live = dense[ids] != 0
            key = np.unique(owners[live] * (1 << BITS) + ids[live])
            margin = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))

        return rate

    return make


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row."""
    make = _scorer(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = make()
        for b in batches:
            for part in S.slices(b, "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rate(part.column("text")))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(rows), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score under the threshold, all columns as they are."""
    make = _scorer(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = make()
        for b in batches:
            for part in S.slices(b, "text", SLICE):
                yield part.filter(pa.array(rate(part.column("text")) < threshold))

    return docs.mapInArrow(tidy(rows), docs.schema)


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The texts of at most ``rows`` labels that are not held out; only those few labels are broadcast."""
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, train(training_rows(docs, labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
