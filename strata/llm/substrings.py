"""Removal of passages that repeat: every word under a run of ``window`` words
that also starts earlier in the corpus goes.

Super-k-mer partitioning. The minimiser of a window is the least hash among its
runs of ``piece`` words, so equal windows have equal minimisers. Consecutive
windows with the same minimiser travel as one string of words to the
minimiser's bucket; there the windows are sorted and compared word for word.

* Windows that already repeat inside a slice of the input are settled there and
  do not travel, so a passage shared by many texts is shipped once a slice.
* Minimisers are counted first. Windows of a frequent one are dealt by the hash
  of the whole window instead, so no bucket grows with a single minimiser.
* Buckets are as many as the text needs at ``bucket_bytes`` each.

"Earlier" is by (doc_id, word number), null ids last. Rows that share an id share
its positions: the same place in two rows is not earlier than itself; what is
found in a row is taken from that row (``rows.told_apart``). Null and
empty texts have no words. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import load, registered, written
from strata.llm.rows import told_apart
from strata.llm.tokens import Words, mix, pack, slices, sliding_min, unpack

WINDOW = 20
PIECE = 4
BUCKET_BYTES = 5 << 20
FLUSH_BYTES = 24 << 20
FINE_BITS = 16
NO_ID = np.iinfo(np.int64).max
_U = np.uint64


def repeated_passages(
    documents: DataFrame,
    window: int = WINDOW,
    piece: int = PIECE,
    bucket_bytes: int = BUCKET_BYTES,
    fine_bits: int = FINE_BITS,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, one space apart)."""
    rows = told_apart(documents)
    # a super-k-mer carries window - 1 words besides those its windows start with
    spread = 1 + 2 * (window - 1) / (window - piece + 2)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, int(size * spread / bucket_bytes))
    hot = _frequent(rows, window, piece, fine_bits, buckets)
    sent = rows.mapInArrow(_sender(window, piece, fine_bits, hot, buckets), "bucket int, blob binary")
    found = sent.groupBy("bucket").applyInArrow(_finder(window), "doc_id long, mark long, at long, n long")
    repeats = found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.mark") == F.col("f.mark"))
    joined = rows.alias("r").join(repeats.alias("f"), same, "left").select("r.doc_id", "text", "gone")
    return joined.mapInArrow(
        _remover(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )


def _in_order(batch: pa.RecordBatch):
    """Ids and marks of a slice, and its rows in order of id."""
    ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    order = np.lexsort((batch.column("mark").to_numpy(zero_copy_only=False), ids))
    batch = batch.take(pa.array(order))
    return batch, ids[order], batch.column("mark").to_numpy(zero_copy_only=False)


class _Windows:
    """The windows of a slice, their minimisers, and which repeat inside it."""

    def __init__(self, words: Words, ids: np.ndarray, window: int, piece: int):
        hashes = words.hashes()
        self.at, self.hash = words.windows(hashes, window)
        if not len(self.at):
            self.least = self.hash
            self.repeat = np.zeros(0, dtype=bool)
            return
        _, pieces = _everywhere(words, hashes, piece)
        self.least = sliding_min(pieces, window - piece + 1)[self.at]
        self.doc = words.doc[self.at]
        self.start = self.at - words.first[self.doc]
        order = np.argsort(self.hash, kind="stable")
        self.repeat = later(words, window, self.at, self.hash, ids[self.doc], self.start, order)


def _everywhere(words: Words, hashes: np.ndarray, size: int):
    """Hashes of all runs of ``size`` words, also those over a text's end."""
    from strata.llm.tokens import running, spans

    at = np.arange(len(words) - size + 1)
    return at, mix(spans(running(hashes), at, at + size))


def later(words: Words, window: int, at, hashes, ids, starts, order) -> np.ndarray:
    """Which windows also occur at an earlier (id, start). ``order`` sorts the
    windows by hash and equal ones by (id, start). Windows with equal hashes are
    compared word for word."""
    found = np.zeros(len(at), dtype=bool)
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return found
    data, begin, end = words.spaced()
    text = data.tobytes()
    begins, ends = begin[at], end[at + window - 1]
    group = np.cumsum(np.append(True, ~same))
    touched = np.append(same, False) | np.append(False, same)
    where = order[touched]
    leaders: dict[bytes, tuple[int, int]] = {}
    last = -1
    for place, number, a, b, key in zip(
        where.tolist(), group[touched].tolist(), begins[where].tolist(), ends[where].tolist(),
        zip(ids[where].tolist(), starts[where].tolist()),
    ):
        if number != last:
            leaders, last = {}, number
        held = leaders.setdefault(text[a:b], key)
        found[place] = held < key
    return found


def _frequent(rows: DataFrame, window: int, piece: int, fine_bits: int, buckets: int) -> np.ndarray:
    """Classes of minimisers with several buckets' share of all windows. At most
    2**fine_bits numbers reach the driver."""

    def count(batches):
        total = np.zeros(1 << fine_bits, dtype=np.int64)
        for batch in slices(batches):
            batch, ids, _ = _in_order(batch)
            made = _Windows(Words(batch.column("text")), ids, window, piece)
            total += np.bincount(_class(made.least[~made.repeat], fine_bits), minlength=len(total))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["class", "n"])

    counted = written(rows.mapInArrow(count, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")), "minimisers")
    total = counted.agg(F.sum("n")).first()[0] or 0
    limit = 4 * max(total / buckets, total / (1 << fine_bits))
    return np.array([r[0] for r in counted.where(F.col("n") > limit).select("class").collect()], dtype=np.int64)


def _class(least: np.ndarray, fine_bits: int) -> np.ndarray:
    return (mix(least ^ _U(0x5851F42D4C957F2D)) >> _U(64 - fine_bits)).astype(np.int64)


def _sender(window: int, piece: int, fine_bits: int, hot: np.ndarray, buckets: int):
    def send(batches):
        held: dict[int, list] = {}
        waiting = 0
        for batch in slices(batches):
            batch, ids, marks = _in_order(batch)
            words = Words(batch.column("text"))
            made = _Windows(words, ids, window, piece)
            if not len(made.at):
                continue
            waiting += _send_runs(held, words, made, ids, marks, window, fine_bits, hot, buckets)
            if waiting >= FLUSH_BYTES:
                yield _flushed(held)
                held, waiting = {}, 0
        if held:
            yield _flushed(held)

    return send


def _send_runs(held, words, made, ids, marks, window, fine_bits, hot, buckets) -> int:
    key = made.least
    if len(hot):
        spread = np.zeros(1 << fine_bits, dtype=bool)
        spread[hot] = True
        key = np.where(spread[_class(key, fine_bits)], made.hash, key)
    # windows that repeat here stay: they go straight to the removals
    key = np.where(made.repeat, _U(0), key)
    begin = np.append(True, (np.diff(made.at) != 1) | (key[1:] != key[:-1]) | (made.repeat[1:] != made.repeat[:-1]))
    run = np.flatnonzero(begin)
    size = np.diff(np.append(run, len(key)))
    doc, start, local = made.doc[run], made.start[run], made.repeat[run]
    bucket = (mix(key[run]) % _U(buckets)).astype(np.int64)
    bucket = np.where(local, (mix(ids[doc].astype(_U)) % _U(buckets)).astype(np.int64), bucket)
    data, begins, ends = words.spaced()
    text = data.tobytes()
    first, last = begins[made.at[run]], ends[made.at[run] + size + window - 2]
    last = np.where(local, first, last)
    order = np.lexsort((local, bucket))
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        lines = [text[a:b] for a, b in zip(first[part].tolist(), last[part].tolist())]
        held.setdefault(int(bucket[part[0]]), []).append(
            (ids[doc[part]], marks[doc[part]], start[part], size[part], local[part], b"\n".join(lines))
        )
    return int((last - first).sum()) + 24 * len(run)


def _flushed(held: dict[int, list]) -> pa.RecordBatch:
    buckets, blobs = [], []
    for bucket, parts in held.items():
        columns = list(zip(*parts))
        blobs.append(pack(*[np.concatenate(c) for c in columns[:5]], b"\n".join(columns[5]), level=6))
        buckets.append(bucket)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _finder(window: int):
    """All windows of a bucket that start earlier elsewhere, as runs of windows."""

    def find(table: pa.Table) -> pa.Table:
        kinds = (np.int64, np.int64, np.int64, np.int64, np.bool_, None)
        parts = [unpack(blob.as_py(), *kinds) for blob in table.column("blob")]
        ids, marks, starts, sizes, local = (np.concatenate([p[i] for p in parts]) for i in range(5))
        text = np.frombuffer(b"\n".join(p[5] for p in parts), dtype=np.uint8)
        lines = np.append(0, np.flatnonzero(text == 0x0A) + 1)
        words = Words.of(text, np.append(lines, len(text)))
        at, hashes = words.windows(words.hashes(), window)
        row = words.doc[at]
        start = starts[row] + at - words.first[row]
        order = np.lexsort((start, ids[row], hashes))
        gone = later(words, window, at, hashes, ids[row], start, order)
        row, start = row[gone], start[gone]
        begin = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(start) != 1))) if len(row) else row
        size = np.diff(np.append(begin, len(row)))
        kept = np.flatnonzero(local)
        row = np.concatenate([row[begin], kept])
        start = np.concatenate([start[begin], starts[kept]])
        names = pa.array(ids[row], mask=ids[row] == NO_ID)
        return pa.Table.from_arrays(
            [names, pa.array(marks[row]), pa.array(start), pa.array(np.concatenate([size, sizes[kept]]))],
            ["doc_id", "mark", "at", "n"],
        )

    return find


def _remover(window: int):
    def remove(batches):
        for batch in slices(batches):
            words = Words(batch.column("text"))
            keep = np.ones(len(words), dtype=bool)
            gone = batch.column("gone")
            whose = np.repeat(np.arange(len(gone)), np.asarray(gone.value_lengths().fill_null(0)))
            if len(whose):
                runs = gone.flatten()
                at = words.first[whose] + runs.field("at").to_numpy()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, at + runs.field("n").to_numpy() + window - 1, -1)
                keep = np.cumsum(change[:-1]) == 0
            data, _, _ = words.spaced(keep)
            sizes = np.bincount(words.doc[keep], minlength=batch.num_rows)
            lengths = np.bincount(
                words.doc[keep], weights=(words.end - words.start + 1)[keep], minlength=batch.num_rows
            ).astype(np.int64)
            ends = np.cumsum(lengths)
            text = data.tobytes()
            texts = [text[e - n : max(e - n, e - 1)] for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words.counts),
                    pa.array(words.counts - sizes),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return remove


@registered(
    "op8_substring_dedup",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS t
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) > 19)),
again AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM again),
words AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
)
def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 words removed from all documents."""
    return repeated_passages(load(spark, sf_dir, "documents")).drop("kept")
