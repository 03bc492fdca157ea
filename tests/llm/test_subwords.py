"""The quality classifier: its features and gradients against plain ones, and what it
makes of held-out documents."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from strata.llm import subwords
from strata.llm.subwords import AGAIN, BUCKETS, Features, Model, held_out, quality
from tests.llm.cases import WORD, no_documents, odd_documents, odd_texts

SF = "/root/testdata/sf0.01"


def plain(text):
    """[(what is hashed, how often)] by words and n-grams as strings."""
    found = {}
    words = WORD.findall(text or "")
    for before, word in zip([None, *words], words):
        marked = f"\x02{word}\x03"
        grams = [marked, *(marked[i : i + n] + f"#{n}" for n in subwords.SIZES for i in range(len(marked) - n + 1))]
        for gram in [*grams, *(["again"] if word == before else [])]:
            found[gram] = found.get(gram, 0) + 1
    return found


def test_features_are_words_and_their_runs_of_characters():
    texts = odd_texts()
    features = Features(pa.array(texts, pa.string()))
    place = {"again": AGAIN}  # which bucket each gram has, learned from texts of one word
    for (bucket, times), text in zip(features.texts_in_numbers(), texts):
        wanted = plain(text)
        assert times.sum() == sum(wanted.values())
        assert times[bucket == AGAIN].sum() == wanted.get("again", 0)
        for gram in [g for g in wanted if g.startswith("\x02") and g.endswith("\x03")][:20]:
            alone = Features(pa.array([gram[1:-1]], pa.string()))
            place[gram] = int(alone.bucket[0])
            assert place[gram] in bucket
    assert len({place[g] for g in place}) > 0.97 * len(place)  # few words share a bucket


def test_equal_runs_share_a_bucket_wherever_they_are():
    one, two = (set(Features(pa.array([t], pa.string())).bucket.tolist()) for t in ("straße", "Xraßy"))
    assert len(one & two) == 3  # "ra", "aß" and "raß"


def test_averages_do_not_depend_on_the_company_of_a_text():
    texts, value = odd_texts(), np.random.default_rng(1).normal(size=BUCKETS + 1)
    together = Features(pa.array(texts, pa.string())).averages(value)
    for text, found in zip(texts, together):
        alone = Features(pa.array([text], pa.string()))
        assert alone.averages(value)[0] == found
        bucket, times = alone.texts_in_numbers()[0]
        assert found == pytest.approx((value[bucket] * times).sum() / max(times.sum(), 1), abs=1e-9)


def test_a_step_goes_down_the_gradient():
    draw = np.random.default_rng(2)
    documents = [(np.sort(draw.choice(BUCKETS, 30, replace=False)), np.full(30, 1 / 30), int(i % 3 == 0)) for i in range(subwords.BATCH)]
    model = Model.fresh()
    model.vectors = model.vectors.astype(np.float64)
    model.weights, model.offset = draw.normal(size=model.weights.shape), draw.normal(size=2)

    def loss(m):
        total = 0
        for bucket, share, label in documents:
            odds = (m.vectors[bucket] * share[:, None]).sum(axis=0) @ m.weights + m.offset
            total += np.log(np.exp(odds - odds[label]).sum())
        return total / len(documents)

    after = Model(model.vectors.copy(), model.weights.copy(), model.offset.copy())
    after.learn(documents, 1e-3)
    for name, scale in (("weights", 1), ("offset", 1), ("vectors", len(documents))):  # vectors take each document's own step
        moved = getattr(model, name) - getattr(after, name)
        at = np.unravel_index(np.abs(moved).argmax(), moved.shape)
        high, low = (Model(model.vectors.copy(), model.weights.copy(), model.offset.copy()) for _ in range(2))
        getattr(high, name)[at] += 1e-4
        getattr(low, name)[at] -= 1e-4
        assert moved[at] == pytest.approx(1e-3 * scale * (loss(high) - loss(low)) / 2e-4, rel=1e-2)


def test_log_odds_per_bucket_are_those_of_the_softmax():
    model = Model.fresh()
    draw = np.random.default_rng(4)
    model.weights, model.offset = draw.normal(size=model.weights.shape), draw.normal(size=2)
    value, offset = model.of_buckets()
    features = Features(pa.array(["some words of a text", "", "again again"], pa.string()))
    for average, (bucket, times) in zip(features.averages(value), features.texts_in_numbers()):
        odds = (model.vectors[bucket] * (times / max(times.sum(), 1))[:, None]).sum(axis=0) @ model.weights + model.offset
        share = np.exp(odds[1]) / np.exp(odds).sum()
        assert 1 / (1 + np.exp(-(average + offset))) == pytest.approx(share, abs=1e-6)


@pytest.fixture(scope="module")
def scored(spark):
    return {row["doc_id"]: row for row in contract.queries()["op11_quality_classifier"](spark, SF).collect()}


def test_held_out_documents(spark, scored):
    labels = {row["doc_id"]: row["quality"] for row in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, row in scored.items())
    assert all(0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3) for row in scored.values())
    kept = [(labels[i], row["predicted"]) for i, row in scored.items() if row["held_out"] and i in labels]
    good, bad = [p for label, p in kept if label == 1], [p for label, p in kept if label == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_a_rerun_and_other_labels_of_held_out_documents_change_nothing(spark, scored):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality(documents.repartition(5).withColumns({"lang": F.lit("xx"), "source": F.lit(None)}), flipped.repartition(3))
    assert {row["doc_id"]: row["score"] for row in again.collect()} == {i: row["score"] for i, row in scored.items()}


def test_odd_rows(spark):
    frame, rows = odd_documents(spark)
    marks = [(row[0], i % 2) for i, row in enumerate(rows)] + [(5, None), (None, 1), (7, 0), (7, 1), (10**9, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    found = quality(frame, labels).collect()
    assert sorted(str(row["doc_id"]) for row in found) == sorted(str(row[0]) for row in rows)
    assert all(0 <= row["score"] <= 1 for row in found)
    empty = {row["score"] for row in found if row["doc_id"] in (0, 1, 2, 3)}  # null, "", white space
    assert len(empty) == 1


def test_one_label_none_and_no_documents(spark):
    frame, rows = odd_documents(spark, ["a text", "another", None])
    ids = [row[0] for row in rows if row[0] is not None]
    for marks, score in (([(i, 1) for i in ids], 1.0), ([(i, 0) for i in ids], 0.0), ([], 0.5), ([(i, None) for i in ids], 0.5)):
        labels = spark.createDataFrame(marks, "doc_id long, quality int")
        assert [row["score"] for row in quality(frame, labels).collect()] == pytest.approx([score] * len(rows))
    assert quality(no_documents(spark), labels).collect() == []
