"""SHA-256 expressions: record hashes and hashed text features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the hash-256 text model.
HASH_DIM = 256
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def record_hash(columns: Sequence[Column]) -> Column:
    """Hex SHA-256 over the columns' text, in order, nulls kept apart from ""."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])), 256)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def token_codes(text: Column) -> Column:
    """Bytes 3 and 4 of each token's SHA-256, all in one hex string."""
    return F.array_join(F.transform(tokens(text), lambda token: F.substring(F.sha2(token, 256), 7, 4)), "")


def bucket_sums(codes: Sequence[str]) -> np.ndarray:
    """Signed token counts, one row of 256 per text. The first byte of a code is
    the bucket; the lowest bit of the second gives the sign, 1 for plus."""
    pairs = [np.frombuffer(bytes.fromhex(some), dtype="uint8").reshape(-1, 2) for some in codes]
    flat = np.concatenate([*pairs, np.zeros((0, 2), "uint8")]).astype("int64")
    cell = np.repeat(np.arange(len(pairs)) * HASH_DIM, [len(some) for some in pairs]) + flat[:, 0]
    sums = np.bincount(cell, weights=(flat[:, 1] & 1) * 2 - 1, minlength=len(pairs) * HASH_DIM)
    return sums.reshape(len(pairs), HASH_DIM)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def text_weights(codes: pd.Series) -> pd.Series:
    """256 whole numbers per text."""
    return pd.Series(list(bucket_sums(codes).astype("int32")))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def text_embedding(codes: pd.Series) -> pd.Series:
    """256 floats of length 1 per text, all zero for a text without tokens."""
    sums = bucket_sums(codes)
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return pd.Series(list(np.divide(sums, length, out=np.zeros(sums.shape), where=length > 0).astype("float32")))


_ENTRIES = T.ArrayType(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("weight", T.IntegerType())]))


@F.arrow_udf(_ENTRIES)
def bucket_entries(codes: pa.Array) -> pa.Array:
    """The buckets of a text whose counts do not cancel out, in order."""
    sums = bucket_sums(codes.to_pylist()).astype("int32")
    text, bucket = np.nonzero(sums)
    ends = np.append(0, np.cumsum(np.bincount(text, minlength=len(sums)))).astype("int32")
    entries = pa.StructArray.from_arrays([pa.array(bucket.astype("int32")), pa.array(sums[text, bucket])], ["bucket", "weight"])
    return pa.ListArray.from_arrays(pa.array(ends), entries)
