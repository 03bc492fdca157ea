"""Looking back along an ordered log without putting a whole key in one task.

A log row has a whole sequence number that no other row of its key shares, so
``floor(number / block_rows)`` cuts every key, however hot, into blocks of at
most ``block_rows`` rows. Windows run inside blocks. What a block has to know of
the ones before it is a single summary row, which is put in front of its rows;
summaries come from an aggregate that shrinks the data before any shuffle, and a
key has one of them per block. Where numbers have gaps or are missing (time stamps,
say), ``numbered`` gives every row a number without gaps first, so that blocks are
cut by rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import workspace

BLOCK_ROWS = 1_000_000
_AGGREGATES = {"sum": F.sum, "max": F.max}


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "_at", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the number of each row, from 0 on, in ``order`` over all rows; equal rows are
    put in some order, too.

    Rows are dealt to ranges, sorted there and written; what comes before a range is
    known from the sizes of the others, one number each. A range is about ``block_rows``
    long, or longer where these would be more than the session's shuffles have
    partitions: sorts spill, and the driver hears of every range from every task.
    """
    spark, folder = rows.sparkSession, workspace(rows.sparkSession, "numbered")
    count = rows.count()
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // BLOCK_ROWS))
    ranges = max(1, min(-(-count // block_rows), most))
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(ranges, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = dealt.withColumn("_place", F.monotonically_increasing_id())  # range * 2**33 + place in it
    placed.write.parquet(folder)
    found = spark.read.schema(placed.schema).parquet(folder)
    part = F.shiftright("_place", 33)
    sizes = found.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    joined = found.withColumn("_range", part).join(starts, "_range")
    return joined.select(*rows.columns, (F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)).alias(name))


def _blocked(rows: DataFrame, order: str, block_rows: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(order) / F.lit(block_rows))).withColumn("_real", F.lit(True))


def _inside(keys: Sequence[str], order: str):
    """A block's rows in order, its summary row (whose number is null) first."""
    return Window.partitionBy(*keys, "_block").orderBy(F.col(order).asc_nulls_first())


def previous(
    rows: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``values`` as seen on the row just before in ``order`` of the same key;
    null on a key's first row."""
    seen = F.struct(*[column.alias(name) for name, column in values.items()])
    blocked = _blocked(rows.withColumn("_seen", seen), order, block_rows)
    last = blocked.groupBy(*keys, "_block").agg(F.max_by("_seen", order).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_block")
    summaries = last.select(*keys, "_block", F.lag("_last").over(across).alias("_seen")).where(F.col("_seen").isNotNull())
    stepped = blocked.unionByName(summaries, allowMissingColumns=True).withColumn(
        "_before", F.lag("_seen").over(_inside(keys, order))
    )
    found = stepped.where("_real")
    return found.select(*rows.columns, *[F.col("_before")[name].alias(name) for name in values])


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Mapping[str, tuple[str, Column]],
    block_rows: int = BLOCK_ROWS,
    before_only: bool = False,
) -> DataFrame:
    """Add running "sum" or "max" measures per key, up to and including each row,
    or with ``before_only`` over the rows strictly before it."""
    inputs = {f"_in_{name}": (_AGGREGATES[kind], column) for name, (kind, column) in measures.items()}
    blocked = _blocked(rows.select("*", *[c.alias(n) for n, (_, c) in inputs.items()]), order, block_rows)
    totals = blocked.groupBy(*keys, "_block").agg(*[total(n).alias(n) for n, (total, _) in inputs.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summaries = totals.select(*keys, "_block", *[total(n).over(earlier).alias(n) for n, (total, _) in inputs.items()])
    frame = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1 if before_only else Window.currentRow)
    summed = blocked.unionByName(summaries, allowMissingColumns=True).select(
        *rows.columns, "_real", *[total(n).over(frame).alias(n[4:]) for n, (total, _) in inputs.items()]
    )
    return summed.where("_real").drop("_real")


def positions(rows: DataFrame, keys: Sequence[str], order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number the rows of each key 1, 2, 3, ... in ``order``."""
    return running(rows, keys, order, {"position": ("sum", F.lit(1).cast("bigint"))}, block_rows)
