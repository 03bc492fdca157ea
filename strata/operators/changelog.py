"""A key/value change log as a table: (key, value, revision).

Revisions grow over the whole log. Current state is an aggregate over the log,
and conditional writes are judged a batch at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strata.operators.matching import join_on
from strata.operators.ordered import BLOCK_ROWS, numbered, running
from strata.session import workspace


def current(log: DataFrame) -> DataFrame:
    """The entry with the highest revision of every key."""
    latest = log.groupBy("key").agg(F.max("revision").alias("revision"), F.max_by("value", "revision").alias("value"))
    return latest.select("key", "value", "revision")


def list_keys(log: DataFrame, prefix: str = "") -> DataFrame:
    """Keys under a prefix, sorted."""
    return log.where(F.startswith("key", F.lit(prefix))).select("key").distinct().orderBy("key")


def since(log: DataFrame, from_revision: int, prefix: str = "") -> DataFrame:
    """Log entries from a revision on, in order; 0 means from now, so none."""
    if from_revision == 0:
        return log.limit(0)
    wanted = (F.col("revision") >= from_revision) & F.startswith("key", F.lit(prefix))
    return log.where(wanted).orderBy("revision")


def number_changes(changes: DataFrame, order: str, after: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Give the changes revisions after + 1, after + 2, ... in ``order``, whatever it
    is; equal ones in some order. Blocks of rows are numbered apart and then shifted."""
    placed = numbered(changes, [order], "position", block_rows)
    return placed.withColumn("revision", F.col("position") + after + 1).drop("position")


def create_if_absent(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Judge creates of (seq, key, value): the first request for a key that
    ``state`` (key, revision) lacks wins and its seq becomes the revision. Null is a
    key like any other."""
    first = requests.groupBy("key").agg(F.min("seq").alias("first_seq"))
    present = state.select("key", F.col("revision").alias("present"))
    owners = join_on(first, present, ["key"], "left")
    judged = join_on(requests, owners, ["key"])
    created = F.col("present").isNull() & (F.col("seq") == F.col("first_seq"))
    return judged.select("seq", "key", created.alias("created"), F.coalesce("present", "first_seq").alias("revision"))


def compare_and_set(writes: DataFrame, state: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Judge conditional writes of (seq, key, if_revision) in seq order.

    A write with ``if_revision`` 0 always commits; another commits if the key is
    then at exactly that revision. A committed write's revision is its seq, a
    refused one reports the revision it met. Seqs are above every revision in
    ``state`` (key, revision).

    A key passes through its writes one by one, but no task has to. Revision r is
    replaced by the first write that names r, provided no unconditional write came
    in between, so each conditional write depends on just one write (or on the
    stored state). Where that is the write right before it, it shares that write's
    fate; such runs are found with a running maximum. What remains are the heads
    of runs that name an older write: they follow pointers that double every
    round, so n of them in a row need log2(n) joins on unique numbers.
    """
    spark = writes.sparkSession
    folder = workspace(spark, "conditional")
    writes = writes.select("seq", "key", "if_revision")
    stored = state.select("key", F.col("revision").alias("stored"))

    def kept_in(name: str, frame: DataFrame) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # the last unconditional write and the last write before each write of the key
    free = F.when(F.col("if_revision") == 0, F.col("seq"))
    looking_back = {"free_before": ("max", free), "before": ("max", F.col("seq"))}
    behind = running(writes, ["key"], "seq", looking_back, block_rows, before_only=True)
    seen = kept_in("writes", join_on(behind, stored, ["key"], "left"))

    # only the first write naming a revision can take it
    conditional = seen.where((F.col("if_revision") > 0) & (F.col("if_revision") < F.col("seq")))
    claims = conditional.groupBy("key", "if_revision").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct("free_before", "stored"), "seq").alias("met")
    )
    claims = claims.select("key", "seq", "if_revision", "met.free_before", "met.stored")
    claims = claims.where(F.col("free_before").isNull() | (F.col("free_before") <= F.col("if_revision")))
    from_state = F.col("free_before").isNull() & F.col("if_revision").eqNullSafe(F.col("stored"))
    from_free = F.col("if_revision").eqNullSafe(F.col("free_before"))
    claims = claims.select("key", "seq", F.when(from_state | from_free, 0).otherwise(F.col("if_revision")).alias("claim"))

    # fate 0 commits, -1 does not, and any other number is the write it depends on
    fate = F.when(F.col("if_revision") == 0, 0).otherwise(F.coalesce("claim", F.lit(-1))).cast("bigint")
    fated = join_on(seen, claims, ["key", "seq"], "left").withColumn("fate", fate).drop("claim")
    heading = F.when(~((F.col("fate") > 0) & F.col("fate").eqNullSafe(F.col("before"))), F.struct("seq", "fate"))
    runs = running(fated, ["key"], "seq", {"run": ("max", heading)}, block_rows)
    runs = kept_in(
        "runs", runs.select("key", "seq", "if_revision", "stored", F.col("run.seq").alias("head"), F.col("run.fate").alias("fate"))
    )

    # round n holds the heads still open after round n - 1, moved on; pointer 0
    # commits, and a head whose pointer leads to a write that did not drops out
    heads = runs.where((F.col("seq") == F.col("head")) & (F.col("fate") > 0))
    heads = heads.select("key", "seq", F.col("fate").alias("pointer"))
    target = F.when(F.col("fate") == 0, 0).otherwise(F.col("head")).cast("bigint")
    ahead = runs.where(F.col("fate") >= 0).select("key", F.col("seq").alias("pointer"), target.alias("next"))
    rounds: list[str] = []
    while True:
        step = join_on(heads, ahead, ["key", "pointer"]).select("key", "seq", F.col("next").alias("pointer"))
        rounds.append(f"{folder}/round={len(rounds)}")
        moved = Observation()
        step.observe(moved, F.count_if(F.col("pointer") > 0).alias("open")).write.parquet(rounds[-1])
        settled = spark.read.parquet(*rounds).where(F.col("pointer") == 0)
        if not moved.get.get("open"):
            break
        heads = spark.read.parquet(rounds[-1]).where(F.col("pointer") > 0)
        ahead = settled.unionByName(heads).select("key", F.col("seq").alias("pointer"), F.col("pointer").alias("next"))

    taken = settled.select("key", F.col("seq").alias("head"), F.lit(True).alias("taken"))
    committed = (F.col("fate") == 0) | F.coalesce("taken", F.lit(False))
    judged = join_on(runs, taken, ["key", "head"], "left").withColumn("committed", committed)
    at = F.when(F.col("committed"), F.col("seq"))
    met = running(judged, ["key"], "seq", {"met": ("max", at)}, block_rows, before_only=True)
    revision = F.when(F.col("committed"), F.col("seq")).otherwise(F.coalesce("met", "stored", F.lit(0)))
    return met.select("seq", "key", "committed", revision.cast("bigint").alias("revision"))
