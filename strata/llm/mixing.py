"""Mixing sources to target weights by entropy balancing.

Of all rates between 0 and ``cap`` that make every source give its target number
of words, the ones closest to an even draw in entropy are
``cap / (1 + exp(-lambda * size))``, the odds being tilted exponentially in the
document's size. ``lambda`` of each source solves a convex dual; Newton steps for
all sources are taken at once, each step being one aggregate over the table of
(source, size, documents). Sums are decimals, so that reruns agree to the bit.

Rates become whole copies by systematic rounding along the sizes of a source,
which keeps its words within one document of the target; one document of a source
is then cut, or read on, by the words still missing. No row is drawn at random.

A null text has size 0; documents of size 0 are taken 0 times. A null source is a
source of its own, the last. Repeated rows are documents of their own. Other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.registry import load, registered, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
ROUNDS = 80
CELL_ROWS = 20_000
_SUM = "decimal(38,9)"
_FIXED = 1 << 30


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; null has none."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Add ``place``, 0, 1, 2, ... in ``order``. The rows are sorted across tasks; what
    one task adds up is a count per task."""
    at = written(rows.orderBy(order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    at = at.withColumn("_task", F.shiftright("_id", 33))
    counts = at.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(offsets, "_task").withColumn("place", F.col("_before") + inside).drop("_id", "_task", "_before")


def weighted_targets(
    totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """Add ``target`` to (key, words): ``share`` of all words by weight, the weights
    repeating along the keys; what is above ``cap`` times a source's words is dealt
    again among the others."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = written(numbered(totals, "key").withColumn("weight", weight).drop("place"), "weights")
    full = F.col("words") * F.lit(cap)
    to_deal = (ranked.agg(F.sum("words")).first()[0] or 0) * share
    level, above = 0.0, -1
    while True:
        # a source that is full stays full, as the level only rises
        is_full = F.col("weight") * F.lit(level) >= full
        seen = ranked.agg(
            F.sum(F.when(is_full, full)).alias("full"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("weight"),
            F.count(F.when(is_full, 1)).alias("n"),
        ).first()
        if seen["n"] == above or not seen["weight"]:
            break
        above = seen["n"]
        level = (to_deal - (seen["full"] or 0.0)) / seen["weight"]
    return ranked.withColumn("target", F.least(full, F.col("weight") * F.lit(level))).drop("weight")


def rate_of(tilt: Column, size: Column, cap: float = CAP) -> Column:
    """The rate of a document; a null ``tilt`` takes everything ``cap`` times."""
    return F.coalesce(F.lit(cap) / (F.exp(-tilt * size) + 1), F.lit(cap))


def balanced(cells: DataFrame, targets: DataFrame, cap: float = CAP, rounds: int = ROUNDS) -> DataFrame:
    """(key, scale, tilt): the solution of the dual for each source, from (key, size,
    n) and (key, words, documents, target)."""
    spark = cells.sparkSession
    state = written(
        targets.select(
            "key",
            "target",
            F.greatest(F.col("words") / F.col("documents"), F.lit(1.0)).alias("scale"),
            F.when(F.col("target") < F.col("words") * F.lit(cap * (1 - 1e-12)), F.lit(0.0)).alias("tilt"),
            F.lit(-1e9).alias("low"),
            F.lit(1e9).alias("high"),
            F.lit(1.0).alias("off"),
        ),
        "tilts",
    )
    for _ in range(rounds):
        if not state.where(F.col("tilt").isNotNull() & (F.col("off") > 1e-9)).limit(1).count():
            break
        x = F.col("size") / F.col("scale")
        rate = rate_of(F.col("tilt"), x, cap)
        words = F.col("size") * F.col("n")
        sums = cells.join(state, "key").groupBy("key").agg(
            F.sum((words * rate).cast(_SUM)).cast("double").alias("given"),
            F.sum((words * x * rate * (F.lit(cap) - rate) / F.lit(cap)).cast(_SUM)).cast("double").alias("slope"),
        )
        missing = F.col("target") - F.col("given")
        low = F.when(missing > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(missing < 0, F.col("tilt")).otherwise(F.col("high"))
        reach = F.abs("tilt") + 2
        step = F.greatest(-reach, F.least(reach, F.coalesce(missing / F.nullif("slope", F.lit(0.0)), F.signum(missing) * reach)))
        wanted = F.col("tilt") + step
        inside = (wanted > low) & (wanted < high)
        state = written(
            state.join(sums, "key").select(
                "key",
                "target",
                "scale",
                F.when(missing == 0, F.col("tilt")).otherwise(F.when(inside, wanted).otherwise((low + high) / 2)).alias("tilt"),
                low.alias("low"),
                high.alias("high"),
                (F.abs(missing) / F.greatest("target", F.lit(1.0))).alias("off"),
            ),
            "tilts",
        )
    return state.select("key", "scale", "tilt")


def mixed(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, and source, rate and copies."""
    key = F.when(F.col("source").isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col("source").cast("string")))
    sizes = written(
        documents.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size")), "sizes"
    )
    cells = written(sizes.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    totals = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("documents"))
    targets = written(weighted_targets(totals, weights, share, cap), "targets")
    tilts = balanced(cells.where("size > 0"), targets.where("words > 0"), cap)
    return _rounded(sizes, cells, targets, tilts, cap)


def _rounded(sizes: DataFrame, cells: DataFrame, targets: DataFrame, tilts: DataFrame, cap: float) -> DataFrame:
    rows = cells.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-rows // CELL_ROWS))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")
    # rates in whole units, so that sums along the sizes are exact
    unit = F.when(
        F.col("size") > 0, F.round(rate_of(F.col("tilt"), F.col("size") / F.col("scale"), cap) * F.lit(_FIXED))
    ).otherwise(0)
    rated = cells.join(tilts, "key", "left").withColumn("unit", unit.cast("decimal(20,0)"))
    along = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum(F.col("unit") * F.col("n")).over(along), F.lit(0)))
    split = sizes.groupBy("key", "size", part).agg(F.count(F.lit(1)).alias("m"))
    inside = Window.partitionBy("key", "size").orderBy("part")
    split = split.join(rated.select("key", "size", "unit", "before"), ["key", "size"]).withColumn(
        "end", F.col("before") + F.sum(F.col("unit") * F.col("m")).over(inside)
    )
    whole = lambda x: F.floor((x + F.lit(_FIXED // 2)) / F.lit(_FIXED)).cast("long")
    dealt = split.select(
        "key", "size", "part", "m", "unit", (whole(F.col("end")) - whole(F.col("end") - F.col("unit") * F.col("m"))).alias("dealt")
    )
    rank = Window.partitionBy("key", "size", "part").orderBy(F.xxhash64(F.lit("rank"), F.col("doc_id")), "doc_id")
    ranked = sizes.withColumn("part", part).withColumn("rank", F.row_number().over(rank))
    copies = F.floor(F.col("dealt") / F.col("m")) + (F.col("rank") <= F.col("dealt") % F.col("m")).cast("long")
    copied = written(
        ranked.join(dealt, ["key", "size", "part"]).select(
            "doc_id", "source", "key", "size", "part", "rank", (F.col("unit") / _FIXED).cast("double").alias("rate"),
            copies.cast("long").alias("copies"),
        ),
        "copies",
    )
    taken = F.col("size") * F.col("copies")
    most = (F.col("size") * F.lit(cap)).cast("long")
    place = [F.col(c) for c in ("size", "part", "rank")]
    given = copied.groupBy("key").agg(
        F.sum(taken).alias("given"),
        F.max(F.struct((most - taken).alias("words"), *place)).alias("room"),
        F.max(F.struct(taken.alias("words"), *place)).alias("most"),
    )
    missing = F.round("target").cast("long") - F.col("given")
    # written, so that Spark knows its size and a large source is no task of its own
    mended = written(given.join(targets, "key").select(
        "key",
        F.col("words").alias("source_size"),
        "target",
        F.when(missing > 0, F.least(missing, F.col("room.words"))).otherwise(F.greatest(missing, -F.col("most.words"))).alias("more"),
        F.when(missing > 0, F.col("room")).otherwise(F.col("most")).alias("at"),
    ), "mended")
    here = (F.col("at.size") == F.col("size")) & (F.col("at.part") == F.col("part")) & (F.col("at.rank") == F.col("rank"))
    return copied.join(mended, "key").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (taken + F.when(here, F.col("more")).otherwise(0)).alias("taken"),
        "source",
        "rate",
        "copies",
    )


@registered("op1_source_mixing")
def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150% of their words by source weights 5, 2, 1."""
    return mixed(load(spark, sf_dir, "documents"))
