"""Hashed text vectors and exact cosine search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import InvalidArgument
from strata.functions.hashing import HASH_DIM, bucket_entries, text_embedding, text_weights, token_codes
from strata.operators.selection import top_per_group
from strata.session import workspace

# Queries travel in chunks of about this many rows x 256 numbers, twice that at
# most: ids are spread by hash, so only repeated ids could make a chunk larger.
QUERY_CHUNK = 2048
CORPUS_STEP = 1024


def bucket_weights(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, bucket, weight): signed token counts, buckets that cancel out left out."""
    # "outer" because otherwise Spark first filters by the array's size, which
    # would work every text twice; empty texts come out as one null entry
    some = rows.select(id_column, F.explode_outer(bucket_entries(token_codes(F.col(text_column)))).alias("entry"))
    return some.where(F.col("entry").isNotNull()).select(id_column, "entry.bucket", "entry.weight")


def hash_256(text: Column) -> Column:
    return text_embedding(token_codes(text))


# Embedding models by name: functions from a text column to a vector column. A
# pandas UDF over a model of one's own can be added.
MODELS = {"hash-256": hash_256}


def embed(rows: DataFrame, text_column: str, model: str = "hash-256", into: str = "embedding") -> DataFrame:
    """Add the text's vector; hash-256 gives 256 floats of length 1, all zero for
    an empty text. Each row is embedded where it is; nothing is shuffled."""
    if model not in MODELS:
        raise InvalidArgument(f"unknown model {model}, there are {sorted(MODELS)}")
    return rows.withColumn(into, MODELS[model](F.col(text_column)))


def nearest_texts(
    queries: DataFrame,
    query_id: str,
    query_text: str,
    corpus: DataFrame,
    corpus_id: str,
    corpus_text: str,
    k: int,
) -> DataFrame:
    """The ``k`` corpus texts of highest cosine with each query text; ties go to
    the smaller corpus id. Returns (query id, corpus id, score, rank).

    Every score is computed, but never stored: queries travel to the corpus as a
    matrix of bounded size, one chunk after another, each batch of the corpus is
    one matrix product, and a task passes on ``k`` rows per query. Dot products
    are whole numbers, so scores do not depend on the order of adding up. Query
    ids are unique.
    """
    asked = _weighted(queries, query_id, query_text)
    vectors = _weighted(corpus, corpus_id, corpus_text)
    chunks = -(-queries.count() // QUERY_CHUNK)
    if chunks > 1:
        # every chunk reads all vectors and some queries, so both are kept
        asked = _kept(asked.withColumn("_chunk", F.pmod(F.xxhash64(query_id), F.lit(chunks))), "_chunk")
        vectors = _kept(vectors)
    schema = (
        f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, "
        f"`{corpus_id}` {corpus.schema[corpus_id].dataType.simpleString()}, score double"
    )
    found = queries.sparkSession.createDataFrame([], schema)
    for chunk in range(chunks):
        part = asked.where(F.col("_chunk") == chunk) if chunks > 1 else asked
        found = found.unionByName(vectors.mapInPandas(_scorer(part, query_id, corpus_id, k), schema))
    return top_per_group(found, [query_id], [F.desc("score"), F.asc(corpus_id)], k)


def _weighted(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return rows.select(id_column, text_weights(token_codes(F.col(text_column))).alias("weights"))


def _kept(rows: DataFrame, *partition_by: str) -> DataFrame:
    folder = workspace(rows.sparkSession, "vectors")
    rows.write.partitionBy(*partition_by).parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _scorer(part: DataFrame, query_id: str, corpus_id: str, k: int):
    rows = part.select(query_id, "weights").limit(2 * QUERY_CHUNK + 1).toPandas()
    if len(rows) > 2 * QUERY_CHUNK or rows[query_id].duplicated().any():
        raise InvalidArgument(f"{query_id} is not unique")
    shared = part.sparkSession.sparkContext.broadcast((rows[query_id].to_numpy(), _matrix(rows)))

    def score(batches):
        names, matrix = shared.value
        squares = (matrix * matrix).sum(axis=1)
        best = None
        for batch in batches:
            for start in range(0, len(batch), CORPUS_STEP):
                some = batch.iloc[start : start + CORPUS_STEP]
                texts = _matrix(some)
                lengths = np.sqrt(np.outer(squares, (texts * texts).sum(axis=1)))
                dots = matrix @ texts.T
                scores = np.divide(dots, lengths, out=np.zeros(dots.shape), where=lengths > 0)
                best = _keep_best(best, some[corpus_id].to_numpy(), scores, k)
        if best is not None:
            ids, scores = best
            yield pd.DataFrame(
                {query_id: np.repeat(names, ids.shape[1]), corpus_id: ids.ravel(), "score": scores.ravel()}
            )

    return score


def _keep_best(best, ids, scores, k):
    """Merge a batch's scores into the best ``k`` (ids, scores) per query."""
    ids = np.broadcast_to(ids, scores.shape)
    if best is not None:
        ids = np.concatenate([best[0], ids], axis=1)
        scores = np.concatenate([best[1], scores], axis=1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["weights"]).astype("float64") if len(rows) else np.zeros((0, HASH_DIM))
