"""Moving frames against DuckDB's windows, and how rows are spread."""

import datetime
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.errors import InvalidArgument
from strata.operators import frames
from strata.operators.frames import range_frame, rows_frame
from strata.operators.ordered import numbered
from tests.conftest import as_set



def measures(*kinds):
    x = F.col("x")
    every = {
        "total": ("sum", x), "n": ("count", x), "rows": ("count", F.lit(1)), "low": ("min", x), "high": ("max", x), "mean": ("avg", x),
    }
    return {name: of for name, of in every.items() if not kinds or of[0] in kinds}


SQL = "sum(x) OVER w, count(x) OVER w, count(*) OVER w, min(x) OVER w, max(x) OVER w, round(avg(x) OVER w, 9)"


def table(seed, n):
    draw = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(i, draw.choice(keys), draw.choice([None, draw.randint(-30, 30)]), draw.choice([None, *range(-9, 9)])) for i in range(n)]
    return rows + [(n, "alone", 5, 7), (n + 1, "empty", None, None)]


def by_sql(rows, select, window):
    data = pd.DataFrame(rows, columns=["i", "k", "v", "x"]).astype({"i": "int64", "v": "Int64", "x": "Int64"})  # noqa: F841
    return sorted(duckdb.sql(f"SELECT i, {select} FROM data WINDOW w AS ({window})").fetchall(), key=repr)


def framed(spark, rows):
    return spark.createDataFrame(rows, "i long, k string, v long, x long")


def found(frame, *columns):
    return as_set(frame.withColumn("mean", F.round("mean", 9)), "i", *columns)


@pytest.mark.parametrize(("before", "after", "block_rows"), [(0, 0, 1), (3, 0, 16), (0, 4, 1), (6, 5, 16), (40, 13, 16), (6, 5, 1000), (500, 500, 16)])
def test_frames_of_rows(spark, before, after, block_rows):
    rows = table(1, 200)
    moved = rows_frame(framed(spark, rows).repartition(3), ["k"], ["v", "i"], measures(), before, after, block_rows)
    window = f"PARTITION BY k ORDER BY v NULLS FIRST, i ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING"
    assert found(moved, *measures()) == by_sql(rows, SQL, window)


@pytest.mark.parametrize(("below", "above", "block_rows"), [(0, 0, 1), (5, 0, 16), (0, 7, 16), (9, 4, 16), (9, 4, 1000), (1000, 1000, 16)])
def test_frames_of_values(spark, below, above, block_rows):
    rows = table(2, 120)
    some = measures("sum", "count", "avg")
    moved = range_frame(framed(spark, rows).repartition(3), ["k"], "v", some, below, above, block_rows)
    window = f"PARTITION BY k ORDER BY v NULLS FIRST RANGE BETWEEN {below} PRECEDING AND {above} FOLLOWING"
    select = SQL.replace("min(x) OVER w, max(x) OVER w, ", "")
    assert found(moved, *some) == by_sql(rows, select, window)


def test_times_dates_and_fractions(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(days=i // 2), i / 4, i) for i in range(20)]
    frame = spark.createDataFrame(rows, "i long, d date, f double, x long")
    week = range_frame(frame, [], "d", {"n": ("count", F.col("x"))}, datetime.timedelta(days=2))
    assert as_set(week, "i", "n") == sorted(((i, min(i // 2 * 2 + 2, 6)) for i in range(20)), key=repr)
    half = range_frame(frame, [], "f", {"n": ("sum", F.col("x"))}, 0.5, 0.25)
    assert as_set(half, "i", "n") == sorted(((i, sum(range(max(i - 2, 0), min(i + 2, 20)))) for i in range(20)), key=repr)
    assert frame.columns == week.columns[:-1]


def test_no_rows_and_wrong_frames(spark):
    nothing = framed(spark, [])
    assert rows_frame(nothing, ["k"], ["v"], measures(), 2, 2).collect() == []
    assert range_frame(nothing, ["k"], "v", {"n": ("count", F.col("x"))}, 2).collect() == []
    for wrong in (lambda: rows_frame(nothing, [], ["v"], measures(), -1), lambda: range_frame(nothing, [], "v", measures(), 1)):
        with pytest.raises(InvalidArgument):
            wrong()


def test_rows_are_numbered_in_order_without_gaps(spark):
    rows = table(3, 500)
    at = {i: n for i, n in as_set(numbered(framed(spark, rows).repartition(4), ["k", "v", "i"], "n", 37), "i", "n")}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, r[0]))
    assert [at[r[0]] for r in order] == list(range(len(rows)))


def test_short_blocks_do_not_make_many_ranges(spark):
    """Tasks and range bounds go through the driver; blocks need not be ranges."""
    rows = spark.range(3000).withColumn("v", F.col("id") * 7919 % 3001)
    placed = numbered(rows, ["v"], "n", 10)
    assert len(placed.inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [n for _, n in sorted(as_set(placed, "v", "n"))] == list(range(3000))


def test_no_task_holds_a_hot_key(spark, monkeypatch):
    """One key has all rows; blocks, with their halos, hold few of them."""
    rows, seen = spark.range(3000).select(F.col("id").alias("i"), F.col("id").alias("v"), F.lit(1).alias("x")), []
    real = frames.numbered

    def spy(log, order, name, block_rows):
        placed = real(log, order, name, block_rows)
        seen.append(placed.groupBy(F.floor(F.col(name) / block_rows)).count().agg(F.max("count")).first()[0])
        return placed

    monkeypatch.setattr(frames, "numbered", spy)
    counted = {"n": ("sum", F.col("x"))}
    assert range_frame(rows, [], "v", counted, 2000, 0, 100).agg(F.sum("n")).first()[0] == sum(min(i, 2000) + 1 for i in range(3000))
    assert rows_frame(rows, [], ["v"], counted, 9, 0, 100).agg(F.sum("n")).first()[0] == sum(min(i, 9) + 1 for i in range(3000))
    assert max(seen) <= 100
