"""Sketches, digests, posting lists and user functions against plain versions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from strata import query
from strata.errors import InvalidArgument, NotFound
from strata.operators import digests, postings, userfunctions
from strata.operators.digests import changed_ranges, diff_by_digests
from strata.operators.history import snapshot_diff
from strata.operators.postings import posted, search_many
from strata.operators.sketches import ROWS, SketchTable, estimate_distinct, estimate_quantile, merged, sketched
from tests.conftest import as_set


def test_merged_sketches_estimate_what_one_of_all_rows_would(spark, folder):
    rows = spark.range(20_000).select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 5 * 86400).alias("ts"), F.when(F.col("id") % 3 > 0, "a").alias("k"),
        (F.col("id") % 4000).alias("user"), (F.col("id") * 7919 % 20_000).cast("double").alias("value"),
    )
    table = SketchTable(spark, folder, ["k"], ["user"], ["value"])
    with pytest.raises(NotFound):
        table.between("2024-01-01", "2024-01-02")
    for part in (0, 1, 1):
        table.add(rows.where(F.col("user") % 2 == part), "ts", f"b{part}")
    columns = [F.col(ROWS), estimate_distinct("user").alias("users"), estimate_quantile("value", 0.25).alias("low")]
    for _ in range(2):
        [whole] = table.between("2024-01-01", "2024-01-05").select(*columns).collect()
        assert whole[0] == 20_000 and abs(whole.users - 4000) < 200 and abs(whole.low - 5000) < 400
        some = {r.k: r for r in table.between("2024-01-02", "2024-01-03", ["k"]).select("k", *columns).collect()}
        days = [i for i in range(20_000) if i % 5 in (1, 2)]
        assert {k: r[1] for k, r in some.items()} == {"a": sum(i % 3 > 0 for i in days), None: sum(i % 3 == 0 for i in days)} and abs(some["a"].low - 5000) < 600
        table.compact()
    assert table.table.read().count() == 10


def test_sketches_of_nothing(spark):
    nothing = spark.createDataFrame([("a", None, None), ("b", float("nan"), "x")], "k string, v double, u string")
    made = sketched(nothing, ["k"], {"u": F.col("u")}, {"v": F.col("v")})
    found = merged(made, [], ["u"], ["v"]).select(ROWS, estimate_distinct("u"), estimate_quantile("v", 0.5)).first()
    assert tuple(found) == (2, 1, None)
    with pytest.raises(InvalidArgument):
        sketched(nothing, ["k"], {"v": F.col("v")}, {"v": F.col("v")})


def snapshots(spark, seed=1, rows=400):
    draw = random.Random(seed)
    old = [(i % 7 if i % 9 else None, i, draw.choice(["x", None, "y"]), draw.choice([1.5, None, 2.5])) for i in range(rows)]
    new = [r if draw.random() > 0.03 else (r[0], r[1], None if r[2] else "z", r[3]) for r in old if draw.random() > 0.01]
    new += [(None, -1, None, None), (3, -2, "n", 0.0)]
    schema = "a int, b int, v string, w double"
    return spark.createDataFrame(old, schema), spark.createDataFrame(new, schema).repartition(3)


@pytest.mark.parametrize("ranges", [1, 50, 3000])
def test_diff_by_digests_is_the_diff(spark, ranges):
    old, new = snapshots(spark)
    every = as_set(snapshot_diff(old, new, ["a", "b"], ["v", "w"]))
    kept = digests.digests(old, ["a", "b"], ["v", "w"], ranges)
    assert as_set(diff_by_digests(old, new, ["a", "b"], ["v", "w"], ranges, old_digests=kept, unchanged=True)) == every
    assert as_set(diff_by_digests(old, new, ["a", "b"], ["v", "w"], ranges)) == [row for row in every if row[2] != "unchanged"]
    assert diff_by_digests(old, old, ["a", "b"], ["v", "w"], ranges).collect() == []


def test_few_rows_are_joined_where_few_changed(spark):
    old = spark.range(20_000).select(F.col("id"), (F.col("id") % 10).alias("v"))
    new = old.withColumn("v", F.when(F.col("id") % 100 == 0, -1).otherwise(F.col("v")))
    ranges = digests.ranges_for(20_000)
    made = [digests.digests(side, ["id"], ["v"], ranges) for side in (old, new)]
    joined = digests._placed(old, ["id"], ranges).join(changed_ranges(*made).withColumnRenamed("range", "_range"), "_range", "left_semi").count()
    assert 200 <= joined < 0.12 * 20_000


def test_a_value_that_moves_to_another_column_is_a_change(spark):
    old = spark.createDataFrame([(1, "x", None)], "id int, v string, w string")
    new = spark.createDataFrame([(1, None, "x")], "id int, v string, w string")
    assert [r.change for r in diff_by_digests(old, new, ["id"], ["v", "w"], 1).collect()] == ["changed"]


@pytest.mark.parametrize("slice_rows", [3, postings.SLICE_ROWS])
def test_searches_find_what_a_scan_finds(spark, slice_rows):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abAB éß日") for _ in range(n))
    listings = [(i, draw.choice([None, "", word(3), word(12), word(30)]), draw.choice([None, word(6)]), i % 3) for i in range(80)]
    needles = [None, "", "a", "B", " ", "ab", "é日", "aba", "zz", "z"] + [word(draw.randint(1, 6)) for _ in range(60)]
    frame = spark.createDataFrame(listings, "id int, name string, about string, kind int")
    asked = spark.createDataFrame([(n, q, n % 3) for n, q in enumerate(needles)], "request_id int, query string, wanted int")
    found = search_many(asked, frame, "id", ["name", "about"], posted(frame, "id", ["name", "about"]), F.col("kind") == F.col("wanted"), slice_rows)
    wanted = [
        (n, i) for n, q in enumerate(needles) for i, name, about, kind in listings
        if kind == n % 3 and ((q or "") == "" or any((q or "").lower() in (t or "").lower() for t in (name, about)))
    ]
    assert as_set(found, "request_id", "id") == sorted(wanted, key=repr)
    nobody = search_many(asked.limit(0), frame, "id", ["name"])
    assert nobody.collect() == [] and search_many(asked, frame.limit(0), "id", ["name"]).collect() == []


@pytest.mark.parametrize("whole", [2, postings.WHOLE])
def test_totals_of_searches_are_those_of_their_pairs(spark, monkeypatch, whole):
    monkeypatch.setattr(postings, "WHOLE", whole)
    draw = random.Random(6)
    word = lambda n: "".join(draw.choice("abAB éß日") for _ in range(n))
    listings = [(i, draw.choice([None, "", word(3), word(12), word(30)]), draw.choice([None, word(6)]), draw.choice([0, 1, None])) for i in range(80)]
    needles = [None, "", "a", "B", " ", "ab", "aba", listings[3][1], word(11)] + [(listings[n][1] or "x")[1:11] for n in range(40)]
    frame = spark.createDataFrame(listings, "id int, name string, about string, kind int")
    asked = spark.createDataFrame([(n, q, draw.choice([0, 1, None])) for n, q in enumerate(needles)], "request_id int, query string, wanted int")
    totals = {"n": ("count", F.lit(1)), "abouts": ("count", F.col("about")), "first": ("min", F.col("id")), "last": ("max", F.col("id"))}
    found = search_many(asked, frame, "id", ["name", "about"], totals=totals, same={"wanted": "kind"})
    pairs = search_many(asked, frame, "id", ["name", "about"], same={"wanted": "kind"})
    wanted = pairs.groupBy("request_id", "query", "wanted").agg(
        F.count(F.lit(1)).alias("n"), F.count("about").alias("abouts"), F.min("id").alias("first"), F.max("id").alias("last")
    )
    assert found.columns == wanted.columns and as_set(found) == as_set(wanted) != []


def test_totals_of_searches_make_no_pairs(spark):
    """Every request finds every listing: 4 million pairs, of which none is made."""
    frame = spark.range(2000).select("id", F.lit("abc").alias("name"))
    asked = frame.select(F.col("id").alias("request_id"), F.lit("b").alias("query"))
    found = search_many(asked, frame, "id", ["name"], totals={"n": ("count", F.lit(1))})
    assert found.agg(F.min("n"), F.max("n"), F.count("n")).first() == (2000, 2000, 2000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "listing" not in plan


def test_no_cross_product_in_a_search(spark, capsys):
    frame = spark.createDataFrame([(1, "abc")], "id int, name string")
    search_many(spark.createDataFrame([(1, "b")], "request_id int, query string"), frame, "id", ["name"]).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sessions_take_any_table(spark):
    userfunctions.install(spark)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(0), 1.5), ("a", at(10), None), ("a", at(21), 2.5), ("b", at(5), 0.0), (None, at(5), 0.0), (None, at(16), 0.0), ("a", None, 9.0)]
    events = spark.createDataFrame(rows, "who string, at timestamp, x double")
    call = "SELECT * FROM sessions(TABLE(events) PARTITION BY (who) ORDER BY (at), '{}', 10)"
    found = query(spark, call.format("at"), {"events": events})
    assert found.columns == ["who", "at", "x", "session"]
    sessions = {(r.who, r.at, r.x): r.session for r in found.collect()}
    assert list(map(sessions.get, rows)) == [1, 1, 2, 1, 1, 2, None]
    with pytest.raises(InvalidArgument, match="no column"):
        query(spark, call.format("gone"), {"events": events})
    taken = events.withColumnRenamed("x", "session")
    with pytest.raises(InvalidArgument, match="has a column session"):
        query(spark, call.format("at"), {"events": taken})


def test_gini(spark):
    userfunctions.install(spark)
    rows = [("even", 2.0), ("even", 2.0), ("one", 0.0), ("one", 5.0), ("one", None), ("none", None), ("zero", 0.0)]
    found = query(spark, "SELECT k, gini(v) AS g FROM t GROUP BY k", {"t": spark.createDataFrame(rows, "k string, v double")})
    assert as_set(found) == [("even", 0.0), ("none", None), ("one", 0.5), ("zero", None)]


def test_unique_checks_share_one_shuffle(spark, capsys):
    from strata.plans.quality import report, unique

    rows = [(1, "a", 0.0), (1, "b", -0.0), (2, None, float("nan")), (2, "b", float("nan")), (None, "b", None), (3, "b", 7.0)]
    frame = spark.createDataFrame(rows, "i int, s string, d double")
    checks = [unique("i"), unique("s"), unique("i", "s"), unique("d"), unique("i", "s", "d", severity="warn")]
    found = report(frame, checks)
    assert as_set(found, "test", "violations", "severity", "passed") == sorted(
        [
            ("unique_i", 2, "error", False), ("unique_s", 1, "error", False), ("unique_i_s", 0, "error", True),
            ("unique_d", 2, "error", False), ("unique_i_s_d", 0, "warn", True),
        ],
        key=repr,
    )
    found.explain()
    assert capsys.readouterr().out.count("Scan ExistingRDD") <= 1
