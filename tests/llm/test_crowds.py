"""What is made on the way where very many texts have to do with each other."""

import random

import pyarrow as pa
import pytest

from strata.llm import jaccard, wordmodel
from tests.llm.test_pairs import links_of, wanted_links


def near_copies(count, words, changed, seed=3):
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for number in range(count):
        copy = list(base)
        for at in draw.sample(range(words), changed):
            copy[at] = f"x{draw.randrange(10**9)}"
        rows.append((number, " ".join(copy)))
    return rows


def counted(monkeypatch, module):
    """The rows of each table that the module writes, by purpose."""
    made, write = {}, module.written

    def written(frame, purpose):
        table = write(frame, purpose)
        made.setdefault(purpose, []).append(table.count())
        return table

    monkeypatch.setattr(module, "written", written)
    return made


@pytest.mark.parametrize("sets", [256, 7])
def test_no_row_is_made_for_a_pair_of_near_copies(spark, monkeypatch, sets):
    # every signature is crowded, so all sets are short of signatures
    monkeypatch.setattr(jaccard, "CROWD", -1)
    monkeypatch.setattr(jaccard, "PACK_SETS", sets, raising=False)
    monkeypatch.setattr(jaccard, "_with_company", lambda texts, short: short)
    rows = near_copies(150, 150, 5) + [(1000 + i, t) for i, t in near_copies(20, 150, 1, seed=4)] + [(2000, None), (2001, "")]
    rows += [(3000, rows[0][1]), (3001, "one two three four five six"), (3002, "one two three four five six")]
    made = counted(monkeypatch, jaccard)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert links_of(frame) == wanted_links(rows)
    pairs = sum(n for purpose, counts in made.items() if purpose.startswith("pairs") for n in counts)
    assert pairs <= 400  # 25 packs with each other and themselves; of sets there are over 10,000 pairs


def test_packs_find_what_pairs_find():
    draw = random.Random(5)
    texts = [t for _, t in near_copies(40, 60, 2)] + [" ".join(f"v{draw.randrange(9)}" for _ in range(n)) for n in range(0, 30)]
    classes = [draw.randrange(4) for _ in texts]
    packs = [draw.choice([8, 9]) for _ in texts]
    docs = list(range(len(texts)))
    columns = {"one": [8] * len(docs), "other": [9] * len(docs), "pack": packs, "doc": docs, "class": classes, "text": texts}
    found = jaccard._compare_packs(pa.table(columns)).to_pylist()
    sets = jaccard.shingle_sets(pa.array(texts))
    linked = {
        (min(classes[a], classes[b]), max(classes[a], classes[b]))
        for a in docs
        for b in docs
        if packs[a] < packs[b] and classes[a] != classes[b] and jaccard.similar(sets[a], sets[b])
    }
    assert {tuple(sorted((classes[r["a"]], classes[r["b"]]))) for r in found} == linked
    assert len(found) == len(linked) > 0
    assert all(jaccard.similar(sets[r["a"]], sets[r["b"]]) for r in found)


def test_word_grams_meet_a_part_at_a_time(spark, monkeypatch):
    made = counted(monkeypatch, wordmodel)
    draw = random.Random(6)
    rows = [(" ".join(f"w{draw.randrange(50)}" for _ in range(30)), "en") for _ in range(320)]
    # each task makes a block of its own
    wordmodel.word_scores(spark.createDataFrame(rows, "text string, lang string").repartition(32)).collect()
    blocks = made["blocks"][0]
    assert blocks == 32
    # a block and its sixteen answers at most; of all blocks at once these are 17 times as many
    assert max(made["answers"][1:]) < 0.6 * made["answers"][0]


def test_sums_of_word_grams_are_sent_in_the_bytes_they_need():
    import numpy as np

    values = [np.array([1, 300, 0]), np.array([1, 1, 0]), np.array([0, 0, 0])]
    bodies = [wordmodel._small(v).tobytes() for v in values]
    assert [len(b) for b in bodies] == [6, 3, 3]
    assert [v.tolist() for v in wordmodel._numbers(bodies, 3)] == [v.tolist() for v in values]
    assert wordmodel._numbers([wordmodel._small(np.array([1 << 40])).tobytes()], 1)[0].tolist() == [1 << 40]
