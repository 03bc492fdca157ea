"""Quality of texts, learned: vectors of words and character n-grams.

Every word, and every run of ``SIZES`` characters of a word with its ends marked, is
hashed to one of ``BUCKETS`` vectors; so is the pair of a word and the same word right
after it, whatever the word. A document is the average of the vectors of all of them, softmax over a linear layer gives the probability of each
label, and vectors and layer are learned together from labelled documents.

Learning takes a bounded sample: of either label the ``SAMPLE`` documents not held out
whose ids have the smallest hash. Spark deals them to at most ``PARTS`` groups of
``PART_ROWS`` or more; in each of ``EPOCHS`` rounds every group walks its documents by
stochastic gradient descent in numpy, from the model of the round before (several
times if it has fewer than ``STEPS`` steps), and the groups' models are averaged,
weighted by their documents. The driver sees models, which have a fixed size. Where the sample
has the labels in another proportion than all labelled documents, the layer's offset
is moved by the difference. All is drawn from hashes, so a rerun gives the same model.

With two labels a document's log odds are linear in its average, so for scoring each
bucket is reduced to one number.

Null and empty texts have no words; they get what the offset alone says. Texts are read
whole, however long: what training keeps of one is at most a number for each bucket.
Null ids are held out. Several labels of one document count as bad if one is; null
labels are left out; of rows that share an id the sample takes the smallest text. With
documents of one label only, or of none, there is nothing to tell apart: that label's
share, or a half. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import load, registered, written
from strata.llm.tokens import Words, byte_sums, mix, pack, slices, spans, unpack

SAMPLE = 5_000
BUCKETS = 1 << 16
WIDTH = 10
SIZES = (2, 3, 4)
PARTS, PART_ROWS = 8, 400
EPOCHS = 8
BATCH, STEPS = 8, 50
RATE = 4.0
THRESHOLD = 0.3
_U = np.uint64
_BEGIN, _END = 0x02, 0x03  # what marks the ends of a word
AGAIN = BUCKETS  # the place of a word that is repeated at once


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


class Features:
    """The different words of several texts, and what is hashed of them: ``bucket``,
    with the number of its word, ``of``; ``word`` is the number of the word at each
    place of the texts, ``doc`` the text; ``again`` how many words of each text repeat
    the one before."""

    def __init__(self, column: pa.Array):
        words = Words(column)
        _, one, self.word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.doc, self.texts = words.doc, len(column)
        same = (self.word[1:] == self.word[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.again = np.bincount(self.doc[1:][same], minlength=self.texts)
        data, start, end = _marked(words.data, words.start[one], words.end[one])
        sums = byte_sums(data)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        inside = np.repeat(np.arange(len(one)), end - start)[at]
        at = np.append(at, len(data))
        found, number = [mix(spans(sums, start, end))], [np.arange(len(one))]
        for size in SIZES:
            begin = np.flatnonzero(inside[: max(len(inside) - size + 1, 0)] == inside[size - 1 :])
            found.append(mix(spans(sums, at[begin], at[begin + size]) + _U(size)))
            number.append(inside[begin])
        self.of = np.concatenate(number)
        self.bucket = (np.concatenate(found) % _U(BUCKETS)).astype(np.int64)
        self.counts = np.bincount(self.of, minlength=len(one))

    def averages(self, value: np.ndarray) -> np.ndarray:
        """The average, over all places, of a number given for each bucket; 0 for
        texts without words."""
        if not len(self.word):
            return np.zeros(self.texts)
        of_word = np.bincount(self.of, weights=value[self.bucket])
        total = np.bincount(self.doc, weights=of_word[self.word], minlength=self.texts) + self.again * value[AGAIN]
        places = np.bincount(self.doc, weights=self.counts[self.word], minlength=self.texts) + self.again
        return total / np.maximum(places, 1)

    def texts_in_numbers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The buckets of each text and how often it has each."""
        pair, times = np.unique(self.doc * np.int64(len(self.counts)) + self.word, return_counts=True)
        doc, word = np.divmod(pair, max(len(self.counts), 1))
        size, bucket = self.counts[word], self.bucket[np.argsort(self.of, kind="stable")]
        first = (np.cumsum(self.counts) - self.counts)[word]
        at = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        key = np.append(np.repeat(doc, size) * (BUCKETS + 1) + bucket[at], np.arange(self.texts) * (BUCKETS + 1) + AGAIN)
        times = np.append(np.repeat(times, size), self.again)
        key, place = np.unique(key, return_inverse=True)
        times = np.bincount(place, weights=times, minlength=len(key)).astype(np.int64)
        key, times = key[times > 0], times[times > 0]
        ends = np.searchsorted(key, np.arange(self.texts + 1) * (BUCKETS + 1))
        return [(key[i:j] % (BUCKETS + 1), times[i:j]) for i, j in zip(ends, ends[1:])]


def _marked(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words one after another, each with a mark before and after it."""
    size = end - start + 2
    to = np.cumsum(size)
    begin = to - size
    at = np.arange(to[-1] if len(to) else 0) + np.repeat(start - begin - 1, size)
    copied = np.append(data, np.uint8(0))[np.clip(at, 0, len(data))]
    copied[begin], copied[to - 1] = _BEGIN, _END
    return copied, begin, to


@dataclass
class Model:
    """A vector for each bucket, the layer's weights and offsets for both labels."""

    vectors: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls) -> Model:
        drawn = mix(np.arange(1, (BUCKETS + 1) * WIDTH + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) >> _U(11)
        vectors = (drawn.astype(np.float64) / 2**53 * 2 - 1) / WIDTH
        return cls(vectors.reshape(BUCKETS + 1, WIDTH).astype(np.float32), np.zeros((WIDTH, 2)), np.zeros(2))

    def packed(self) -> bytes:
        return pack(self.vectors, self.weights, self.offset)

    @classmethod
    def unpacked(cls, blob: bytes) -> Model:
        vectors, weights, offset = unpack(blob, np.float32, np.float64, np.float64)
        return cls(vectors.reshape(BUCKETS + 1, WIDTH).copy(), weights.reshape(WIDTH, 2).copy(), offset.copy())

    def learn(self, documents: list[tuple[np.ndarray, np.ndarray, int]], rate: float) -> None:
        """One walk over (buckets, shares, label), a few documents a step."""
        for start in range(0, len(documents), BATCH):
            some = documents[start : start + BATCH]
            bucket = np.concatenate([d[0] for d in some])
            share = np.concatenate([d[1] for d in some])
            size = [len(d[0]) for d in some]
            row = np.repeat(np.arange(len(some)), size)
            hidden = np.zeros((len(some), WIDTH))
            for column in range(WIDTH):
                hidden[:, column] = np.bincount(row, weights=self.vectors[bucket, column] * share, minlength=len(some))
            odds = hidden @ self.weights + self.offset
            likely = np.exp(odds - odds.max(axis=1, keepdims=True))
            likely /= likely.sum(axis=1, keepdims=True)
            likely[np.arange(len(some)), [d[2] for d in some]] -= 1
            wrong = likely * (rate / len(some))
            back = (wrong @ self.weights.T) * len(some)
            self.weights -= hidden.T @ wrong
            self.offset -= wrong.sum(axis=0)
            # a document's step is spread over its features by their shares
            np.subtract.at(self.vectors, bucket, (back[row] * share[:, None]).astype(np.float32))

    def of_buckets(self) -> tuple[np.ndarray, float]:
        """The log odds that one bucket speaks for, and those of the offset."""
        apart = self.weights[:, 1] - self.weights[:, 0]
        return self.vectors.astype(np.float64) @ apart, float(self.offset[1] - self.offset[0])


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(id, label) of the documents that may be learned from."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))


def sample(documents: DataFrame, known: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(id, label, text) of at most ``size`` documents of either label."""
    ordered = known.select("id", "label", F.xxhash64("id").alias("order"))
    both = [ordered.where(F.col("label") == side).orderBy("order", "id").limit(size) for side in (0, 1)]
    # 2 * size ids and labels at most, so they can go to every task
    chosen = F.broadcast(both[0].union(both[1]).select("id", "label"))
    rows = documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("id"))
    return rows.groupBy("id", "label").agg(F.min("text").alias("text"))


def featured(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """A row for each part: its labelled texts as numbers, written once."""

    def look(batches):
        for batch in slices(batches):
            # steps between buckets and small counts pack well
            found = [
                pack(np.diff(bucket, prepend=0).astype(np.uint32), times.astype(np.uint32))
                for bucket, times in Features(batch.column("text")).texts_in_numbers()
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "order", "label")), pa.array(found)], ["part", "order", "label", "features"])

    order = F.xxhash64(F.col("id"), F.lit("order"))
    dealt = rows.select(F.pmod(order, F.lit(parts)).alias("part"), order.alias("order"), "label", "text")
    numbers = dealt.mapInArrow(look, "part long, order long, label int, features binary")
    return written(numbers.repartition(parts, "part").groupBy("part").applyInArrow(_gathered, "part long, labels array<int>, features array<binary>"), "features")


def _gathered(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("order", "ascending"), ("label", "ascending")])
    return pa.table(
        {"part": [rows.column("part")[0].as_py()], "labels": [rows.column("label").to_pylist()], "features": [rows.column("features").to_pylist()]},
        pa.schema([("part", pa.int64()), ("labels", pa.list_(pa.int32())), ("features", pa.list_(pa.binary()))]),
    )


def _walked(batches, before: bytes, rate: float):
    """The model of each part after a round."""
    for batch in batches:
        for part, labels, features in zip(*(batch.column(c).to_pylist() for c in ("part", "labels", "features"))):
            model, documents = Model.unpacked(before), []
            for label, blob in zip(labels, features):
                steps, times = unpack(blob, np.uint32, np.uint32)
                if len(steps):
                    documents.append((np.cumsum(steps, dtype=np.int64), times / times.sum(), label))
            for _ in range(-(-STEPS * BATCH // len(documents)) if documents else 0):
                model.learn(documents, rate)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([len(documents)]), pa.array([model.packed()])], ["part", "n", "model"])


def trained(features: DataFrame, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    spark = features.sparkSession
    model = Model.fresh()
    for epoch in range(epochs):
        shared, step = spark.sparkContext.broadcast(model.packed()), rate * (1 - epoch / epochs)
        walked = features.mapInArrow(lambda batches: _walked(batches, shared.value, step), "part long, n long, model binary")
        found = sorted(walked.collect(), key=lambda row: row["part"])  # ``parts`` models
        total = sum(row["n"] for row in found)
        if not total:
            break
        models = [(row["n"] / total, Model.unpacked(row["model"])) for row in found]
        model = Model(*(sum(w * getattr(m, name) for w, m in models) for name in ("vectors", "weights", "offset")))
        model.vectors = model.vectors.astype(np.float32)
        shared.destroy()
    return model


def quality(documents: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id and the probability of label 1 for each document."""
    spark = documents.sparkSession
    known = labelled(labels, label)
    all_of = dict(known.groupBy("label").count().collect())
    rows = sum(min(n, SAMPLE) for n in all_of.values())
    features = featured(sample(documents, known), max(1, min(PARTS, rows // PART_ROWS)))
    taken = dict(features.select(F.explode("labels").alias("label")).groupBy("label").count().collect())
    if len(taken) == 2:
        value, offset = trained(features).of_buckets()
        offset += np.log(all_of[1] / all_of[0]) - np.log(taken[1] / taken[0])
    else:
        only = next(iter(taken), None)
        value, offset = np.zeros(BUCKETS + 1), {None: 0.0, 0: -500.0, 1: 500.0}[only]
    shared = spark.sparkContext.broadcast((value, offset))  # a number for each bucket

    def score(batches):
        value, offset = shared.value
        for batch in slices(batches):
            odds = np.clip(Features(batch.column("text")).averages(value) + offset, -500, 500)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-odds)))], ["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id long, score double")


@registered("op11_quality_classifier")
def op11_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """How likely every document is a good one."""
    found = quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
