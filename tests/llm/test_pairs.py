"""Near duplicates, repeated passages and benchmark passages against plain versions."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import components, decontaminate, jaccard, substrings
from strata.llm.rows import told_apart
from tests.llm.cases import ALNUM, LOWER, digest, key, linked, no_documents, odd_documents, shingles, without_repeats


@pytest.mark.parametrize("settings", [{}, {"fine_bits": 1, "bucket_bytes": 1 << 30}])
def test_repeated_passages(spark, settings):
    """The second setting takes all minimisers for frequent ones."""
    frame, rows = odd_documents(spark)
    got = sorted((tuple(r) for r in substrings.repeated_passages(frame, **settings).collect()), key=key)
    plain = without_repeats([r[:2] for r in rows])
    assert got == sorted(((r[0], n, gone, digest(kept), kept) for r, (n, gone, kept) in zip(rows, plain)), key=key)
    assert sum(gone for _, gone, _ in plain) > 1000


def test_frequent_minimisers_are_found_and_spread(spark):
    frame, rows = odd_documents(spark, ["same words again and again " * 40 + str(i) for i in range(30)])
    hot = substrings._frequent(frame.select("doc_id", "text", frame["n_chars"].cast("int").alias("mark")), 20, 4, 4, 1000)
    assert len(hot) > 0


def links_of(frame):
    return sorted((tuple(r) for r in jaccard.linked(frame).collect()), key=key)


def wanted_links(rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    joined = linked(sets)
    return sorted(((r[0], len(shingles(r[1])), joined.get(r[0])) for r in rows), key=key)


def test_near_duplicates(spark):
    frame, rows = odd_documents(spark)
    assert links_of(frame) == wanted_links(rows)


def test_near_duplicates_where_every_signature_is_crowded(spark, monkeypatch):
    """No signature may make pairs, so all links come from one-deletion neighbourhoods."""
    frame, rows = odd_documents(spark)
    monkeypatch.setattr(jaccard, "CROWD", -1)
    monkeypatch.setattr(jaccard, "MEMBERS", 3)
    assert links_of(frame) == wanted_links(rows)


def test_similar_sets_share_a_signature():
    draw = np.random.default_rng(3)
    for _ in range(400):
        size = int(draw.integers(1, 120))
        one = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
        other = np.concatenate([one[draw.random(len(one)) > 0.1], draw.integers(0, 2**63, int(draw.integers(0, size // 9 + 1))).astype(np.uint64)])
        other = np.unique(other)
        if not jaccard.similar(one, other):
            continue
        (a, x), (b, y) = jaccard.signatures(one), jaccard.signatures(other)
        if max(x, y) >= 0:
            assert len(np.intersect1d(a, b)) > max(x, y)
        else:
            assert len(np.intersect1d(jaccard.neighbourhoods(one), jaccard.neighbourhoods(other)))


def test_near_duplicates_that_share_no_signature(spark):
    """Nine words and the first eight of them: similarity 4/5, all in one segment."""
    nine = [
        "w282164 w887317 w119237 w19160 w655608 w489798 w729330 w526237 w589717",
        "w521731 w736548 w777779 w80706 w711852 w246567 w195563 w975792 w382300",
        "w170325 w238903 w495480 w729563 w151913 w524795 w193 w501465 w836060",
    ]
    texts = [t for text in nine for t in (text, text.rsplit(" ", 1)[0])]
    signs = [set(jaccard.signatures(s)[0].tolist()) for s in jaccard.shingle_sets(pa.array(texts))]
    assert not any(signs[i] & signs[i + 1] for i in (0, 2, 4))
    frame, rows = odd_documents(spark, [*texts, "quite another text that has nothing to do with it"])
    assert links_of(frame) == wanted_links(rows)


def test_similarity_is_exact_at_the_threshold():
    one = np.arange(9, dtype=np.uint64)
    assert jaccard.similar(one, one[:8]) and not jaccard.similar(one, one[:7])
    assert not jaccard.similar(one[:0], one[:0])


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def hits(text, items, window=10):
    words = ALNUM.findall((text or "").translate(LOWER))
    hit, met = set(), set()
    for name, item in items:
        given = ALNUM.findall((item or "").translate(LOWER))
        size = min(window, len(given))
        for i in range(len(given) - size + 1 if given else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == given[i : i + size]:
                    hit.update(range(at, at + size))
                    met.add("" if name is None else str(name))
    return len(words), len(hit), sorted(met)


@pytest.mark.parametrize("block", [1_000_000, 5])
def test_benchmark_passages(spark, block):
    frame, rows = odd_documents(spark)
    long = next(r[1] for r in rows if r[1] and len(r[1].split()) > 100 and len(r[1]) < 5000).split()
    items = [(10, " ".join(long[5:30])), (9, "Two WORDS"), (2, "x, " + " ".join(long[20:29])), (3, None), (4, "..."), (5, "one"), (None, "a b c d e"), (9, "again " * 12), (9, "two words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:6] for r in decontaminate.contaminated(frame, benchmark, block_windows=block).collect()), key=key)
    plain = [(r[0], *hits(r[1], items)) for r in rows]
    assert got == sorted(((i, n, h, len(m), digest(",".join(m)), h > 0) for i, n, h, m in plain), key=key)
    assert collections.Counter(h > 0 for _, _, h, _ in plain)[True] > 5
    kept = decontaminate.keep_clean(frame, benchmark, block_windows=block)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _, h, _ in plain if not h), key=str)


def test_empty_tables(spark):
    empty = no_documents(spark)
    assert substrings.repeated_passages(empty).collect() == []
    assert links_of(empty) == []
    assert decontaminate.contaminated(empty, spark.createDataFrame([], "item_id long, text string")).collect() == []
    frame, rows = odd_documents(spark, ["some text", None])
    nothing = decontaminate.contaminated(frame, spark.createDataFrame([], "item_id long, text string")).collect()
    assert [r["contaminated"] for r in nothing] == [False] * len(rows)


def same_hash(spark):
    """Pairs of different texts whose 32-bit hashes are equal."""
    texts = spark.range(400_000).select(F.format_string("%07d xxxxxxxx", "id").alias("t"))
    pairs = texts.groupBy(F.hash("t").alias("h")).agg(F.sort_array(F.collect_list("t")).alias("t")).where("size(t) > 1")
    return pairs.orderBy("h").first()["t"][:2]


@pytest.mark.parametrize("name", [None, 7])
def test_rows_of_one_id_are_told_apart_whatever_their_hashes(spark, name):
    passage = " ".join(f"p{i}" for i in range(40))
    # appending the same words keeps hashes of equal length texts equal or not; either way rows must not mix
    short, other = same_hash(spark)
    rows = [(1, passage), (name, short), (name, other), (name, passage + " tail"), (name, "clean " * 3 + passage[:30]), (name, short), (name, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substrings.repeated_passages(frame).collect()), key=key)
    plain = without_repeats(rows)
    assert got == sorted(((r[0], n, gone, digest(kept), kept) for r, (n, gone, kept) in zip(rows, plain)), key=key)
    apart = told_apart(frame)
    assert apart.count() == len(rows) == apart.select("doc_id", "mark").distinct().count()
    items = [(1, passage), (2, "p3 p4 p5"), (3, short)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(frame, benchmark, block_windows=3)
    wanted = [(r[0], *hits(r[1], items)) for r in rows]
    assert sorted((tuple(r)[:6] for r in found.collect()), key=key) == sorted(((i, n, h, len(m), digest(",".join(m)), h > 0) for i, n, h, m in wanted), key=key)
