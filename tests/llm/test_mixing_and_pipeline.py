import collections
import math

import pytest

import corpus_pipeline
from strata.llm import decontaminate, mixing, pii, quality
from tests.llm.cases import WORD, key, linked, no_documents, odd_documents, shingles

SF = "/root/testdata/sf0.001"


def plain_targets(words, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = share * sum(words.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > cap * words[s]}
        for s in full or free:
            target[s] = cap * words[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        free -= full or free
    return target


def check_mix(rows, got, tolerance=0.02):
    size = lambda t: len(WORD.findall(t or ""))
    words = collections.Counter()
    for row in rows:
        words[row[3]] += size(row[1])
    target = plain_targets(words)
    wanted = sorted(((r[0], size(r[1]), r[3], words[r[3]]) for r in rows), key=key)
    assert sorted(((g["doc_id"], g["size"], g["source"], g["source_size"]) for g in got), key=key) == wanted
    taken = collections.Counter()
    for g in got:
        assert 0 <= g["taken"] <= 2 * g["size"] and abs(g["target"] - target[g["source"]]) < 1e-6 * max(1, target[g["source"]])
        taken[g["source"]] += g["taken"]
    for source, n in words.items():
        assert abs(taken[source] - target[source]) <= max(1, tolerance * target[source])


def test_mix_of_odd_rows(spark):
    frame, rows = odd_documents(spark)
    got = mixing.mixed(frame).collect()
    check_mix(rows, got)
    assert sorted(map(tuple, mixing.mixed(frame).collect()), key=key) == sorted(map(tuple, got), key=key)
    assert mixing.mixed(no_documents(spark)).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mixed(none).collect()] == [0, 0]


def test_mix_of_copies_and_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 7)
    rows = [(i, "word " * (30 if i % 3 else 1 + i % 90), "en", "hot" if i % 3 else f"s{i % 5}", 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check_mix(rows, mixing.mixed(frame).collect())


def test_rates_are_tilted_exponentially(spark):
    """The odds of a source's rates are an exponential of the size, and give the target."""
    rows = [(i, "w " * (i % 40 + 1), "b" if i % 2 else "a") for i in range(400)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(3.0, 2.0)).collect()
    for source in "ab":
        odds = {r["size"]: r["rate"] / (2 - r["rate"]) for r in got if r["source"] == source and 0 < r["rate"] < 2}
        logs = [math.log(odds[s]) / s for s in sorted(odds)]
        assert max(logs) - min(logs) < 1e-4
        total = sum(r["rate"] * r["size"] for r in got if r["source"] == source)
        assert abs(total - next(r["target"] for r in got if r["source"] == source)) < 1e-3 * total


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage makes of the documents, on its own input."""
    docs, made = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF), "stage")
        made.append((name, docs, after))
        docs = after
    return made


def test_every_stage_keeps_the_columns(stages, spark):
    assert [name for name, _, _ in stages] == ["quality rules", "n-gram jaccard join", "benchmark decontamination", "pii", "mixing sources"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_each_stage_does_what_it_says(stages):
    rows = [({r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}) for _, before, after in stages]
    quality_in, quality_out = rows[0]
    for i, row in quality_in.items():
        words = len(WORD.findall(row["text"] or ""))
        if words < quality.MIN_WORDS:
            assert i not in quality_out
    good = [i for i, r in quality_in.items() if len(WORD.findall(r["text"] or "")) >= 100]
    assert len(quality_out) >= 0.6 * len(good)
    pairs_in, pairs_out = rows[1]
    assert set(pairs_out) == set(linked({i: shingles(r["text"]) for i, r in pairs_in.items()}).values())
    clean_in, clean_out = rows[2]
    assert all(clean_out[i] == clean_in[i] for i in clean_out)
    pii_in, pii_out = rows[3]
    assert set(pii_in) == set(pii_out) and all(r["n_chars"] == len(r["text"]) for r in pii_out.values())
    assert any("[" in r["text"] and r["text"] != pii_in[i]["text"] for i, r in pii_out.items())
    mix_in, mix_out = rows[4]
    assert set(mix_in) == set(mix_out)
    check_mix([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in mix_in.values()], list(mix_out.values()), tolerance=0.05)


def test_nothing_dirty_is_left(stages, spark):
    kept = stages[-2][2]
    found = decontaminate.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert found.where("contaminated").count() == 0
    assert pii.spans(kept).where("size(email) > 0").count() == 0


def test_the_pipeline_takes_odd_rows(spark, folder):
    frame, _ = odd_documents(spark, ["a few words that are said here and there again " * 8 + str(i) * 3 for i in range(30)] + [None, ""])
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    result = corpus_pipeline.run(spark, folder)
    assert "taken" in result.columns
    result.collect()


def test_rows_are_told_apart_by_text_not_by_id(spark):
    text = lambda start: " ".join(f"w{i}" for i in range(start, start + 60))
    rows = [
        (1, text(0)), (1, text(100)), (1, text(200)), (2, text(100) + " more"), (3, text(300)), (0, text(300)),
        (3, text(400)), (None, text(500)), (None, text(500)), (None, text(0)), (None, text(600)), (4, None), (4, None),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, frame, SF)
    wanted = [rows[i] for i in (0, 1, 2, 5, 6, 7, 10, 11, 12)]
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(wanted, key=key)


def test_near_duplicates_leave_columns_of_any_name_alone(spark):
    names = ["doc_id", "text", "__row", "row", "class", "a.b"]
    rows = [(1, "some words " * 5, "mine", 7, "x", "y"), (2, "some words " * 5, "yours", 8, "x", "y"), (3, None, "ours", 9, None, "y")]
    frame = spark.createDataFrame(rows, names)
    kept = corpus_pipeline.near_duplicates(spark, frame, SF)
    assert kept.columns == names
    assert sorted(map(tuple, kept.collect()), key=key) == [rows[0], rows[2]]
