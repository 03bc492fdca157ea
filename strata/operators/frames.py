"""Moving sums, counts, averages and extremes over keys of any size.

A window in SQL works through a key in one task, and through a frame row by row. Here
rows are numbered in order first (``ordered.numbered``), and no task holds more than a
block of them.

Frames of rows: a block gets the rows before and after it that its frames reach, as a
halo. Inside a block each aggregate is run from the start and from the end of
stretches as long as a frame; a frame lies in two of them, so two values make it up,
whatever its length.

Frames of values (7 days, say) may hold any part of all rows. Their sums and counts are
differences of running totals: every row asks for the total before its frame and the
one at its end, and questions travel in one log with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.errors import InvalidArgument
from strata.operators.bands import _distance, number_of
from strata.operators.ordered import BLOCK_ROWS, numbered, running
from strata.session import workspace

Measures = Mapping[str, tuple[str, Column]]
_EITHER: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "count": (F.count, lambda a, b: a + b),
}


def _plain(measures: Measures, known: Sequence[str]) -> tuple[dict[str, tuple[str, Column]], dict[str, Column]]:
    """Averages as sums and counts: what to work out, and the columns made of that."""
    wanted, made = {}, {}
    for name, (kind, column) in measures.items():
        if kind not in (*known, "avg"):
            raise InvalidArgument(f"{kind} is none of {', '.join([*known, 'avg'])}")
        parts = ["sum", "count"] if kind == "avg" else [kind]
        wanted |= {f"_{name}_{part}": (part, column) for part in parts}
        columns = [F.col(f"_{name}_{part}") for part in parts]
        made[name] = columns[0] / F.nullif(columns[1], F.lit(0)) if kind == "avg" else columns[0]
    return wanted, made


def rows_frame(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    measures: Measures,
    preceding: int,
    following: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add "sum", "count", "avg", "min" or "max" over the rows from ``preceding`` before
    each to ``following`` after it, of the same keys (null is one) in ``order``. A block
    is at least as long as a frame."""
    if preceding < 0 or following < 0:
        raise InvalidArgument("a frame holds its own row")
    wanted, made = _plain(measures, list(_EITHER))
    inputs = rows.select("*", *[column.alias(f"_in{name}") for name, (_, column) in wanted.items()])
    placed = numbered(inputs, [*[F.col(f"`{k}`") for k in keys], *order], "_at", block_rows)
    size, width = max(block_rows, preceding + following), preceding + following + 1
    at = F.col("_at")
    first, last = F.greatest(F.floor((at - following) / size), F.lit(0)), F.floor((at + preceding) / size)
    halo = placed.withColumn("_block", F.explode(F.sequence(first, last)))

    group = [F.col("_block"), *[F.col(f"`{k}`") for k in keys]]
    along, whole = Window.partitionBy(*group).orderBy("_at"), Window.partitionBy(*group)
    stretches = halo.withColumns({"_spot": F.row_number().over(along) - 1, "_rows": F.count(F.lit(1)).over(whole)})
    stretches = stretches.withColumn("_stretch", F.floor(F.col("_spot") / width))
    up, down = (Window.partitionBy(*group, "_stretch").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (at.asc(), at.desc()))
    runs = stretches.withColumns(
        {f"_{side}{name}": _EITHER[kind][0](f"_in{name}").over(way) for name, (kind, _) in wanted.items() for side, way in (("up", up), ("down", down))}
    )
    start, end = F.greatest(F.col("_spot") - preceding, F.lit(0)), F.least(F.col("_spot") + following, F.col("_rows") - 1)
    together = F.floor(start / width) == F.floor(end / width)
    from_start = start % width == 0
    everything = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = {}
    for name, (kind, _) in wanted.items():
        tail = F.lag(f"_down{name}", preceding).over(along)
        clipped = F.col("_spot") + following >= F.col("_rows")
        head = F.when(clipped, F.last(f"_up{name}").over(everything)).otherwise(F.lead(f"_up{name}", following).over(along))
        found[name] = F.when(together & from_start, head).when(together, tail).otherwise(_EITHER[kind][1](tail, head))
    done = runs.withColumns(found).where(F.col("_block") == F.floor(at / size))
    return done.select(*[F.col(f"`{c}`") for c in rows.columns], *[column.alias(name) for name, column in made.items()])


def range_frame(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: Measures,
    below,
    above=0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add "sum", "count" or "avg" over the rows of the same keys (null is one) whose
    ``value`` lies from ``below`` under each row's to ``above`` over it, ends included:
    numbers, or timedeltas between dates or times. Rows without a value are a frame of
    their own. Sums of whole numbers and decimals are exact; of floating-point ones they
    are as good as the running total they are taken from.
    """
    below, above = _distance(below), _distance(above)
    if below < 0 or above < 0:
        raise InvalidArgument("a frame holds its own row")
    wanted, made = _plain(measures, ["sum", "count"])
    folder = workspace(rows.sparkSession, "frames")
    number = number_of(F.col(f"`{value}`"), rows.schema[value].dataType)
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    inputs = {f"_in{name}": column for name, (_, column) in wanted.items()}
    key = {f"_k{i}": F.col(f"`{k}`") for i, k in enumerate(keys)}
    base = rows.select(row.alias("_row"), F.monotonically_increasing_id().alias("_id"), number.alias("_value"), *[c.alias(n) for n, c in (key | inputs).items()])
    base.write.parquet(folder)
    base = rows.sparkSession.read.schema(base.schema).parquet(folder)

    # at the same value: starts of frames, rows, ends of frames
    nothing = [F.lit(None).cast(base.schema[n].dataType).alias(n) for n in inputs]
    at = lambda v, kind, id: [*key, v.alias("_value"), F.lit(kind).alias("_kind"), id.alias("_id")]
    none = F.lit(None).cast("bigint")
    reach = lambda distance: (F.col("_value") + F.lit(distance)).cast(_wide(base.schema["_value"].dataType))
    log = base.select(*at(reach(0), 1, none), *inputs)
    log = log.union(base.select(*at(reach(-below), 0, F.col("_id")), *nothing)).union(base.select(*at(reach(above), 2, F.col("_id")), *nothing))
    placed = numbered(log, [*key, "_value", "_kind"], "_at", block_rows)
    sums = {f"_s{name}": ("sum", F.col(f"_in{name}") if kind == "sum" else F.col(f"_in{name}").isNotNull().cast("bigint")) for name, (kind, _) in wanted.items()}
    some = {f"_n{name}": ("sum", F.col(f"_in{name}").isNotNull().cast("bigint")) for name, (kind, _) in wanted.items() if kind == "sum"}
    totals = running(placed, list(key), "_at", sums | some, block_rows).where("_id IS NOT NULL")
    ends = [F.sum(F.when(F.col("_kind") == kind, F.col(n))).alias(f"{n}{kind}") for n in [*sums, *some] for kind in (0, 2)]
    asked = totals.groupBy("_id").agg(*ends)
    between = lambda n: F.coalesce(F.col(f"{n}2"), F.lit(0)) - F.coalesce(F.col(f"{n}0"), F.lit(0))
    found = asked.select(
        "_id",
        *[(F.when(between(f"_n{n}") > 0, between(f"_s{n}")) if kind == "sum" else between(f"_s{n}")).alias(n) for n, (kind, _) in wanted.items()],
    )
    joined = base.select("_id", "_row").join(found, "_id")
    return joined.select("_row.*", *[column.alias(name) for name, column in made.items()])


def _wide(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.DoubleType()
