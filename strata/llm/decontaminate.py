"""Documents that hold passages of benchmark items.

Prefix-filtered set join. A window is ``window`` consecutive words of an item (a
shorter item is one window) and is looked at as the set of its three-word
shingles. All of them have to be in a document that holds the window, so the
prefix that is necessary is one shingle, and the cheapest is the rarest: shingles
of the benchmark are counted in the documents first. Only places where a window's
rarest shingle occurs are candidates; its position in the window says where the
window has to begin, which must lie inside the document with the whole length;
then the words are compared one by one.

The benchmark goes to all tasks in blocks of at most ``block_windows`` windows, as
many passes as there are blocks; documents are not shuffled. Null texts have no
words; a null item_id counts as the empty string; repeated rows give repeated
results and repeated items count once; other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import load, registered, written
from strata.llm.rows import told_apart
from strata.llm.tokens import Words, mix, slices

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 1_000_000
_SIEVE = 1 << 20
_U = np.uint64
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


class Windows:
    """The distinct windows of a block of the benchmark and their shingles."""

    def __init__(self, texts: list[str], items: list[list[str]]):
        self.texts = [t.encode() for t in texts]
        self.items = items
        words = Words(pa.array(texts, pa.string()), "alnum")
        hashes = words.hashes()
        self.sizes = words.counts
        shingle, window, offset = [], [], []
        for size in range(1, SHINGLE + 1):
            # windows of fewer words are one shingle themselves
            chosen = self.sizes == size if size < SHINGLE else self.sizes >= SHINGLE
            at, grams = grams_of(words, hashes, size)
            here = chosen[words.doc[at]]
            shingle.append(grams[here])
            window.append(words.doc[at][here])
            offset.append((at - words.first[words.doc[at]])[here])
        self.shingle, self.window, self.offset = (np.concatenate(x) for x in (shingle, window, offset))
        self.known, self.which = np.unique(self.shingle, return_inverse=True)
        self.lengths = sorted({min(int(n), SHINGLE) for n in self.sizes})

    def keep_rarest(self, counts: np.ndarray) -> None:
        """Of each window leave the shingle that is met least often; ties go to the first."""
        order = np.lexsort((self.offset, counts[self.which], self.window))
        first = order[np.append(True, np.diff(self.window[order]) != 0)]
        first = first[np.argsort(self.shingle[first], kind="stable")]
        self.shingle, self.window, self.offset = self.shingle[first], self.window[first], self.offset[first]
        self.known, self.begin = np.unique(self.shingle, return_index=True)
        self.begin = np.append(self.begin, len(self.shingle))

    def sieve(self) -> np.ndarray:
        sieve = np.zeros(_SIEVE, dtype=bool)
        sieve[(self.known % _U(_SIEVE)).astype(np.int64)] = True
        return sieve


def grams_of(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at, grams = words.windows(hashes, size)
    return at, mix(grams ^ _U(size))


def _met(block: Windows, sieve: np.ndarray, words: Words):
    """Places where a known shingle occurs, and its number."""
    hashes = words.hashes()
    for size in block.lengths:
        at, grams = grams_of(words, hashes, size)
        maybe = np.flatnonzero(sieve[(grams % _U(_SIEVE)).astype(np.int64)])
        found = np.minimum(np.searchsorted(block.known, grams[maybe]), len(block.known) - 1)
        real = block.known[found] == grams[maybe]
        yield at[maybe[real]], found[real]


def _counted(rows: DataFrame, block: Windows) -> np.ndarray:
    """How often each shingle of the block occurs in the documents."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        block = shared.value
        sieve, counts = block.sieve(), np.zeros(len(block.known), dtype=np.int64)
        for batch in slices(batches):
            for _, found in _met(block, sieve, Words(batch.column("text"), "alnum", lower=True)):
                counts += np.bincount(found, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["shingle", "n"])

    total = np.zeros(len(block.known), dtype=np.int64)
    met = rows.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    total[met.column("shingle").to_numpy()] = met.column("n").to_numpy()
    shared.destroy()
    return total


def _hits(block: Windows, sieve: np.ndarray, words: Words) -> tuple[dict[int, list], dict[int, set]]:
    """For each text with a window of the block: where its windows lie, and the items."""
    hits: dict[int, list] = {}
    items: dict[int, set] = {}
    data, starts, ends = words.spaced()
    text = data.tobytes()
    for at, found in _met(block, sieve, words):
        for place, shingle in zip(at.tolist(), found.tolist()):
            doc = int(words.doc[place])
            begin, end = int(words.first[doc]), int(words.first[doc + 1])
            for entry in range(block.begin[shingle], block.begin[shingle + 1]):
                window = int(block.window[entry])
                first = place - int(block.offset[entry])
                last = first + int(block.sizes[window])
                if first < begin or last > end:
                    continue
                if text[starts[first] : ends[last - 1]] == block.texts[window]:
                    hits.setdefault(doc, []).append((first - begin, last - begin))
                    items.setdefault(doc, set()).update(block.items[window])
    return hits, items


def _searched(rows: DataFrame, block: Windows) -> DataFrame:
    """Each row with the runs of words (start, end) that the block's windows cover,
    merged and in order, and the items they belong to."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def search(batches):
        block = shared.value
        sieve = block.sieve()
        for batch in slices(batches):
            words = Words(batch.column("text"), "alnum", lower=True)
            hits, items = _hits(block, sieve, words)
            runs = [_merged(hits.get(i, ())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array(words.counts),
                    pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], _RUNS),
                    pa.array([sorted(items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string())),
                ],
                ["doc_id", "mark", "n_words", "runs", "items"],
            )

    kinds = "doc_id long, mark long, n_words long, runs array<struct<start: long, end: long>>, items array<string>"
    return rows.mapInArrow(search, kinds)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(runs) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(set(runs)):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, items): the distinct windows of all items, words one space apart."""

    def cut(batches):
        for batch in batches:
            names, made = [], []
            for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = _WORD.findall((text or "").translate(_LOWER))
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    names.append(name or "")
                    made.append(" ".join(words[i : i + window]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.string())], ["item", "window"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(cut, "item string, window string").groupBy("window").agg(F.collect_set("item").alias("items"))


def _blocks(rows: DataFrame, benchmark: DataFrame, window: int, block_windows: int):
    """The benchmark's windows in blocks, each with its rarest shingles, and whether
    there are several blocks."""
    windows = written(benchmark_windows(benchmark, window), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    for number in range(blocks):
        part = windows.where(F.col("block") == number).orderBy("window").toArrow()
        if part.num_rows:
            block = Windows(part.column("window").to_pylist(), [sorted(x) for x in part.column("items").to_pylist()])
            block.keep_rarest(_counted(rows, block))
            yield block, blocks > 1


def keep_clean(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """The documents without any window of the benchmark, all columns as they came."""
    left = documents
    for block, _ in _blocks(documents, benchmark, window, block_windows):
        left = left.mapInArrow(_sifter(documents.sparkSession.sparkContext.broadcast(block)), documents.schema)
    return left


def _sifter(shared):
    def sift(batches):
        block = shared.value
        sieve = block.sieve()
        for batch in slices(batches):
            hits, _ = _hits(block, sieve, Words(batch.column("text"), "alnum", lower=True))
            yield batch.filter(pa.array([i not in hits for i in range(batch.num_rows)]))

    return sift


def contaminated(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and runs (the hit
    words as start and end) and items."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("mark"))
    found = []
    for block, several in _blocks(rows, benchmark, window, block_windows):
        if several and not found:
            rows = told_apart(documents)  # what blocks find in a row is put together
        made = _searched(rows, block)
        found.append(written(made, "hits") if several else made)
    if not found:
        found = [_searched(rows, _nothing())]
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    if len(found) > 1:
        # one row for each block and document
        hits = hits.groupBy("doc_id", "mark", "n_words").agg(
            F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
    return hits.select(
        "doc_id",
        "n_words",
        _covered(F.sort_array("runs")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
        "runs",
        "items",
    )


def _nothing() -> Windows:
    block = Windows(["\x01"], [[]])
    block.known, block.begin, block.lengths = np.zeros(0, dtype=_U), np.zeros(1, dtype=np.int64), []
    return block


def _covered(runs):
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(held, run):
        fresh = F.greatest(F.lit(0), run["end"] - F.greatest(run["start"], held["end"])).cast("long")
        return F.struct(F.greatest(held["end"], run["end"]).alias("end"), (held["n"] + fresh).alias("n"))

    return F.aggregate(runs, zero, add)["n"]


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@registered(
    "op7_benchmark_decontamination",
    rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_SQL} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
    FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS t
    FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
)
def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words in all documents."""
    found = contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.drop("runs", "items")
