"""Verifying batches of hash-linked audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.matching import join_on
from strata.operators.ordered import BLOCK_ROWS, previous
from strata.session import workspace

# Acknowledgement codes.
COMMITTED = "COMMITTED"
DUPLICATE = "DUPLICATE"
CHAIN_BREAK = "REJECTED:CHAIN_BREAK"


def verify_chain(
    batch: DataFrame,
    heads: DataFrame | None = None,
    committed: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Acknowledge each record of one batch per chain.

    ``batch`` has chain_id, seq (whole, unique per chain), id, prev_hash and
    record_hash. ``heads`` (chain_id, head_hash) holds the last committed hash per
    chain and ``committed`` (chain_id, id) the ids already stored. A known id is a
    duplicate; a record that does not continue the chain is rejected together
    with everything after it. A null id or chain is a value like any other, so every
    record gets a verdict.

    The chain is walked in blocks, and "everything after" is a comparison with the
    chain's first break, so a single long chain still spreads over many tasks.
    """
    first_use = batch.groupBy("chain_id", "id").agg(F.min("seq").alias("first_seq"))
    if committed is None:
        first_use = first_use.withColumn("stored", F.lit(False))
    else:
        stored = committed.select("chain_id", "id").distinct().withColumn("stored", F.lit(True))
        first_use = join_on(first_use, stored, ["chain_id", "id"], "left")
    marked = join_on(batch, first_use, ["chain_id", "id"]).withColumn(
        "repeated", F.coalesce("stored", F.lit(False)) | (F.col("seq") > F.col("first_seq"))
    )
    # read three times below, so kept
    folder = workspace(batch.sparkSession, "audit")
    marked.select("chain_id", "seq", "id", "prev_hash", "record_hash", "repeated").write.parquet(folder)
    marked = batch.sparkSession.read.parquet(folder)
    fresh = marked.where(~F.col("repeated")).select("chain_id", "seq", "prev_hash", "record_hash")
    linked = previous(fresh, ["chain_id"], "seq", {"before_hash": F.col("record_hash")}, block_rows)
    if heads is None:
        linked = linked.withColumn("head_hash", F.lit(""))
    else:
        linked = join_on(linked, heads.select("chain_id", "head_hash"), ["chain_id"], "left")
    expected = F.coalesce("before_hash", "head_hash", F.lit(""))
    breaks = (
        linked.where(~F.col("prev_hash").eqNullSafe(expected)).groupBy("chain_id").agg(F.min("seq").alias("broken_at"))
    )
    judged = join_on(marked, breaks, ["chain_id"], "left")
    status = (
        F.when(F.col("seq") >= F.col("broken_at"), CHAIN_BREAK)
        .when(F.col("repeated"), DUPLICATE)
        .otherwise(COMMITTED)
    )
    return judged.select("chain_id", "seq", "id", status.alias("status"))


def chain_heads(batch: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Last committed id and hash per chain, for the next batch to start from."""
    kept = verdicts.where(F.col("status") == COMMITTED).select("chain_id", "seq", "id")
    rows = join_on(batch.select("chain_id", "seq", "record_hash"), kept, ["chain_id", "seq"])
    return rows.groupBy("chain_id").agg(
        F.max_by("id", "seq").alias("last_id"), F.max_by("record_hash", "seq").alias("head_hash")
    )
