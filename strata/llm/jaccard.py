"""Documents linked by the Jaccard similarity of their word shingles, exactly.

Universe partition and pigeonhole. The hash space of shingles is cut into segments,
their number depending on the size band of the sets. Two sets that are similar
enough differ in at most H elements, so of H + 1 segments one holds the same
elements in both. What a set holds in a segment is summed into a signature; sets
that share a signature are candidates, and candidates are verified by their whole
shingle sets.

Cost-based allocation. Signatures that say nothing are not used: empty segments,
and those shared by too many unlinked sets. For each such loss a set spends one of
the spare segments it has, which is its margin. Only two sets that have both spent
more than their margin can miss each other. They meet a second time on half as many
segments, each with its one-deletion neighbourhood (the signatures with one element
left out), which finds segments that differ in one element; there every signature
is used, and sets that still have too few share one of their own. Before that, sets
go whose elements rule out that any other one is similar. As many sets share those
signatures, they are put in packs, and packs with a signature in common are compared
as a whole, so no row is made for a pair of sets.

Work is kept linear. Equal sets inside a slice of the input travel once, and are one
set once they have met. Sets that share too few signatures to be similar to any are
left out. Of each signature's sets all are first compared with one of them only, a
few times over, and linked ones become one class; pairs are made between classes.

Rows with a null id are linked with nothing and have no component; rows that share
an id share its links. Null and empty texts have no shingles. Other columns are not
looked at.
"""

from __future__ import annotations

import bisect
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.components import components
from strata.llm.registry import load, registered, written
from strata.llm.tokens import Words, mix, pack, running, slices, spans, unpack

WORDS = 5
BAND = 1.5
FLUSH_SIGNATURES = 1 << 19
SLICE_BYTES = 1 << 20  # of text that is cut into shingles at once
BUCKET_SIGNATURES = 1 << 19
SPARE = 5  # segments a set uses beyond what it needs
CROWD = 32  # pairs a signature may make for each of its sets
ROUNDS = 4  # of comparing with one set per signature, before all pairs are made
MEMBERS = 2000  # sets compared with one leader in one task
PACK_SETS = 256  # sets compared with those of another pack at once
PACK_BYTES = 1 << 20  # of their text
PACK_COLUMNS = 1 << 12
FILTER_BITS = 1 << 24
_U = np.uint64


# similar means 100 * common >= 80 * union, that is 9 * common >= 4 * (sum of sizes)
def _differ(sizes):
    """How many elements two similar sets of these sizes in all differ in at most."""
    return sizes // 9


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = Words(column, lower=True)
    hashes = found.hashes()
    at, grams = found.windows(hashes, words)
    firsts = np.searchsorted(at, found.first)
    sets = []
    whole = spans(running(hashes), found.first[:-1], found.first[1:]) if len(hashes) else None
    for i, count in enumerate(found.counts.tolist()):
        if count >= words:
            sets.append(np.unique(grams[firsts[i] : firsts[i + 1]]))
        elif count:
            sets.append(mix(whole[i : i + 1] + _U(count)))
        else:
            sets.append(np.zeros(0, dtype=_U))
    return sets


class Band:
    """Sets whose larger partner has ``low`` to ``high`` elements."""

    def __init__(self, number: int, low: int, high: int):
        self.number, self.low, self.high = number, low, high
        most = _differ(2 * high) + 1
        self.segments = math.ceil((most + SPARE + 2.5 * math.sqrt(most * 0.02)) / 0.98) + 1
        self.paired = max(1, math.ceil(most * 0.53) + (most > 2))
        self.least = -(-4 * low // 5)
        sizes = np.arange(self.least, high + 1)
        need = _differ(sizes + np.minimum(5 * sizes // 4, high)) + 1
        empty = np.exp(-sizes / self.segments)
        wanted = np.ceil((need + SPARE + 2.5 * np.sqrt(need * empty)) / (1 - empty))
        # how many segments a set of each size uses
        self.used = np.minimum(wanted, self.segments).astype(np.int64)

    def uses(self, size: int) -> int:
        return int(self.used[size - self.least])

    def partners(self, size: int) -> np.ndarray:
        low = max(-(-4 * size // 5), self.least if size >= self.low else self.low)
        return np.arange(low, min(5 * size // 4, self.high) + 1)

    def key(self, level: int, count: int) -> np.ndarray:
        return mix(np.arange(count, dtype=_U) + _U((self.number << 40) + (level << 32) + 1))


@cache
def _bands(most: int) -> tuple[Band, ...]:
    made, low = [], 1
    while low <= most:
        high = max(low, int(low * BAND))
        made.append(Band(len(made), low, high))
        low = high + 1
    return tuple(made)


def bands_of(size: int) -> list[Band]:
    """The bands in which a set of this size can be one of a similar pair."""
    most = 1 << max(4, (5 * size // 4).bit_length())
    return [band for band in _bands(most) if band.least <= size <= band.high]


def _cut(elements: np.ndarray, count: int) -> np.ndarray:
    """Where each of ``count`` segments begins among sorted elements."""
    segment = ((elements >> _U(32)) * _U(count)) >> _U(32)
    return np.searchsorted(segment, np.arange(count + 1, dtype=_U))


def signatures(elements: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's segment signatures in all its bands, and the margin: how many of
    them, at least, it has beyond what any similar set needs."""
    size, made, margin = len(elements), [], 1 << 14
    sums = np.append(_U(0), np.cumsum(elements))
    for band in bands_of(size):
        edge = _cut(elements, band.segments)
        used = band.uses(size)
        filled = edge[1 : used + 1] > edge[:used]
        signs = mix((sums[edge[1 : used + 1]] - sums[edge[:used]]) ^ band.key(0, used))
        made.append(signs[filled])
        partners = band.partners(size)
        if len(partners):
            have = np.append(0, np.cumsum(filled))[np.minimum(band.used[partners - band.least], used)]
            margin = min(margin, int((have - _differ(partners + size) - 1).min()))
    return np.concatenate(made), margin


def neighbourhoods(elements: np.ndarray) -> np.ndarray:
    """Signatures of half as many segments, each also with every one element left
    out; with one for all sets that have too few, if this is one of them."""
    size, made = len(elements), []
    sums = np.append(_U(0), np.cumsum(elements))
    for band in bands_of(size):
        edge = _cut(elements, band.paired)
        held = np.diff(edge)
        total = sums[edge[1:]] - sums[edge[:-1]]
        key = band.key(1, band.paired)
        made.append(mix(total[held > 0] ^ key[held > 0]))
        whose = np.repeat(np.arange(band.paired), held)
        several = held[whose] > 1
        made.append(mix((total[whose] - elements)[several] ^ key[whose[several]]))
        if np.minimum(held, 2).sum() <= _differ(size + min(5 * size // 4, band.high)):
            made.append(band.key(2, 1))
    return np.unique(np.concatenate(made))


def _digest(elements: np.ndarray) -> int:
    return int(mix(np.array([mix(elements ^ _U(0xA5A5A5A5)).sum() + _U(len(elements))], dtype=_U))[0])


_SENT = "bucket int, blob binary"
_MET = "sign long, doc long, n int, margin int, digest long"


def _sender(buckets: int):
    """Signatures travel to their buckets, and each document's facts with them."""

    def send(batches):
        held = _Waiting()
        for batch in slices(batches, limit=SLICE_BYTES):
            for name, elements in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"))):
                held.add(name, elements)
            if held.waiting >= FLUSH_SIGNATURES:
                yield held.flushed(buckets)
                held = _Waiting()
        if held.facts:
            yield held.flushed(buckets)

    return send


class _Waiting:
    def __init__(self):
        self.facts: list[tuple] = []
        self.signs: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.known: dict[tuple[int, int], int] = {}
        self.margins: dict[tuple[int, int], int] = {}
        self.waiting = 0

    def add(self, name: int | None, elements: np.ndarray) -> None:
        key = _digest(elements), len(elements)
        margin = self.margins.get(key, 0)
        first = self.known.get(key)
        # of equal sets only the smallest id's signatures go on
        if len(elements) and name is not None and (first is None or name < first):
            self.known[key] = name
            made, margin = signatures(elements)
            self.margins[key] = margin
            self.signs.append(made)
            self.owners.append(np.full(len(made), name, dtype=np.int64))
            self.waiting += len(made)
        self.facts.append((name is not None, name or 0, key[1], margin, key[0]))

    def flushed(self, buckets: int) -> pa.RecordBatch:
        sign, owner = (np.concatenate(x) if x else np.zeros(0, dtype=_U) for x in (self.signs, self.owners))
        current = np.isin(owner, np.fromiter(self.known.values(), dtype=np.int64, count=len(self.known)))
        sign, owner = sign[current], owner[current]
        bucket = (sign % _U(buckets)).astype(np.int64)
        order = np.lexsort((owner, bucket))
        sign, owner, bucket = sign[order], owner[order], bucket[order]
        columns = list(zip(*self.facts))
        facts = [np.array(c, dtype=k) for c, k in zip(columns, (np.bool_, np.int64, np.int32, np.int32, _U))]
        empty = [f[:0] for f in facts]
        # the facts go with the first signature, or to any bucket
        carrier = int(bucket[0]) if len(bucket) else int(facts[4][0] % _U(buckets))
        made, blobs = [], []
        for part in np.split(np.arange(len(sign)), np.flatnonzero(np.diff(bucket)) + 1):
            made.append(int(bucket[part[0]]) if len(part) else carrier)
            blobs.append(pack(sign[part], owner[part], *(facts if made[-1] == carrier else empty)))
        return pa.RecordBatch.from_arrays([pa.array(made, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _meet(table: pa.Table) -> pa.Table:
    """The signatures of a bucket that several documents have, one row for each
    document, and all facts that came along, whose signature is null."""
    kinds = (_U, np.int64, np.bool_, np.int64, np.int32, np.int32, _U)
    parts = [unpack(blob.as_py(), *kinds) for blob in table.column("blob")]
    sign, owner, named, name, size, margin, digest = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((owner, sign))
    sign, owner = sign[order], owner[order]
    fresh = np.append(True, (sign[1:] != sign[:-1]) | (owner[1:] != owner[:-1]))[: len(sign)]
    sign, owner = sign[fresh], owner[fresh]
    same = sign[1:] == sign[:-1]
    several = (np.append(same, False) | np.append(False, same))[: len(sign)]
    sign, owner = sign[several], owner[several]
    none = len(sign)
    columns = [
        pa.concat_arrays([pa.array(sign.view(np.int64)), pa.nulls(len(name), pa.int64())]),
        pa.concat_arrays([pa.array(owner), pa.array(name, mask=~named)]),
        pa.concat_arrays([pa.nulls(none, pa.int32()), pa.array(size)]),
        pa.concat_arrays([pa.nulls(none, pa.int32()), pa.array(margin)]),
        pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(digest.view(np.int64))]),
    ]
    return pa.Table.from_arrays(columns, ["sign", "doc", "n", "margin", "digest"])


def linked(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of (doc_id, text)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one signature for every 15 bytes
    buckets = max(16, int(size / 15 / BUCKET_SIGNATURES))
    met = rows.mapInArrow(_sender(buckets), _SENT).groupBy("bucket").applyInArrow(_meet, _MET)
    met = written(met, "signatures")
    facts = met.where("sign is null").drop("sign")
    sets = facts.where("doc is not null and n > 0")
    first = sets.groupBy("digest", "n").agg(F.min("doc").alias("first"))
    # equal sets are one node from here on, named by their smallest id
    nodes = written(
        sets.join(first, ["digest", "n"]).select("doc", "first", "n", "margin").distinct(), "nodes"
    )
    joined = _classes(rows, met.where("sign is not null").select("sign", "doc"), nodes)
    found = joined.groupBy("doc").agg(F.min("class").alias("class"))
    return facts.join(found, "doc", "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("class", "doc").alias("component_id"),
    )


def _classes(rows: DataFrame, met: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, class) for the documents of ``nodes``."""
    members = nodes.select("doc", "first")
    facts = nodes.groupBy(F.col("first").alias("doc")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("margin").alias("margin")
    )
    shared = written(met.join(members, "doc").select("sign", F.col("first").alias("doc")).distinct(), "met")
    shared = written(_promising(shared, facts), "shared")
    # sets with a negative margin can be similar to one with which they share no signature
    poor = written(facts.where("margin < 0").select("doc", "low", "high", "margin"), "poor")
    texts = written(_texts(rows, shared.select(F.col("doc").alias("wanted")).union(poor.select("doc"))), "texts")
    links, judged = _stars(texts, shared)

    # what each signature would make of the classes that are left
    open_ = written(_several(_with_classes(shared, links), "class"), "open")
    left = open_.groupBy("sign", "class").agg(F.count(F.lit(1)).alias("m")).groupBy("sign").agg(
        F.sum("m").alias("sets"), F.sum(F.col("m") * F.col("m")).alias("squares")
    )
    crowded = left.where(F.col("sets") * F.col("sets") - F.col("squares") > 2 * CROWD * F.col("sets")).select("sign")
    spent = open_.join(crowded, "sign").groupBy("doc").agg(F.count(F.lit(1)).alias("spent"))
    spare = shared.select("doc", "low", "high", "margin").union(poor).distinct().join(spent, "doc", "left")
    spare = written(
        spare.select("doc", "low", "high", (F.col("margin") - F.coalesce("spent", F.lit(0))).alias("spare")), "spare"
    )
    usable = open_.join(crowded, "sign", "left_anti").select("sign", "doc", "class").join(spare, "doc")
    pairs = _pairs_of(usable).where(F.col("common") > F.col("spare")).select("a", "b")
    more = written(pairs.join(judged, ["a", "b"], "left_anti"), "pairs")
    links = written(links.union(_verified(texts, more)), "verified")

    short = spare.where("spare < 0")
    if short.limit(2).count() > 1:
        short = _with_company(texts, short)
        near = _with_classes(_neighbourhood_rows(texts, short), links)
        links = links.union(_packs_compared(texts, _several(near, "class")))
    found = components(links).withColumnRenamed("component", "class")
    return members.join(found, members["first"] == found["node"], "left").select(
        "doc", F.coalesce("class", "first").alias("class")
    )


def _promising(met: DataFrame, facts: DataFrame) -> DataFrame:
    """Without the sets that share no more signatures than they have to spare (two
    similar sets share more), and without signatures that only one set has then."""
    counts = met.groupBy("doc").agg(F.count(F.lit(1)).alias("signs"))
    likely = counts.join(facts, "doc").where(F.col("signs") > F.col("margin")).drop("signs")
    return _several(met.join(written(likely, "likely"), "doc"), "doc")


def _several(rows: DataFrame, by: str) -> DataFrame:
    """The rows of signatures under which there are several of ``by``."""
    ends = rows.groupBy("sign").agg(F.min(by).alias("_a"), F.max(by).alias("_z")).where("_a < _z")
    return rows.join(ends.select("sign"), "sign")


def _stars(texts: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links found by comparing the sets of each signature with one of them only, and
    the pairs compared. Sets that are linked by then are one class, and only sets of
    different classes are compared; which set leads is drawn anew each round, by a
    hash of its id. This finds most links, the rest is left to the pairs."""
    spark = shared.sparkSession
    links = judged = spark.createDataFrame([], "a long, b long")
    classes = spark.createDataFrame([], "doc long, class long")
    for number in range(ROUNDS):
        open_ = shared.join(classes, "doc", "left").withColumn("class", F.coalesce("class", "doc"))
        order = F.struct(F.xxhash64(F.lit(number), "doc") if number else F.lit(0).cast("long"), "doc", "class", "low", "high", "margin")
        leaders = open_.groupBy("sign").agg(F.min(order).alias("l"))
        met = open_.join(leaders, "sign").where(F.col("class") != F.col("l.class"))
        fits = (5 * F.col("high") >= 4 * F.col("l.low")) & (5 * F.col("l.high") >= 4 * F.col("low"))
        stars = met.where(fits).groupBy(F.col("l.doc").alias("a"), F.col("doc").alias("b")).agg(
            F.count(F.lit(1)).alias("common"), F.max(F.greatest("margin", "l.margin")).alias("margin")
        )
        stars = stars.where(F.col("common") > F.col("margin")).select("a", "b", F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"))
        fresh = stars.join(judged.select(F.col("a").alias("_x"), F.col("b").alias("_y")), ["_x", "_y"], "left_anti")
        fresh = written(fresh, "stars")
        asked = fresh.count()
        if not asked:
            break
        new = written(_verified(texts, fresh.select("a", "b")), "links")
        links = written(links.union(new), "verified")
        judged = written(judged.union(fresh.select(F.col("_x").alias("a"), F.col("_y").alias("b"))), "judged")
        if 50 * new.count() < asked:
            break
        classes = written(_joined_classes(classes, new), "classes")
    return links, judged


def _joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, class) once every class has gone over to the smallest it is linked with.
    One step only: chains of classes are left for later."""
    linked_ = links.select(F.col("a").alias("doc")).union(links.select(F.col("b").alias("doc"))).distinct()
    known = classes.union(linked_.join(classes, "doc", "left_anti").select("doc", F.col("doc").alias("class")))
    known = written(known, "known")
    ends = links.join(known.select(F.col("doc").alias("a"), F.col("class").alias("_x")), "a").join(
        known.select(F.col("doc").alias("b"), F.col("class").alias("_y")), "b"
    )
    moves = ends.where("_x <> _y").groupBy(F.greatest("_x", "_y").alias("class")).agg(F.min(F.least("_x", "_y")).alias("_to"))
    return known.join(moves, "class", "left").select("doc", F.coalesce("_to", "class").alias("class"))


def _with_classes(shared: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("node").alias("doc"), F.col("component").alias("class"))
    return shared.join(found, "doc", "left").withColumn("class", F.coalesce("class", "doc"))


def _pairs_of(shared: DataFrame) -> DataFrame:
    """Pairs of different classes under each signature: (a, b), the smaller id first,
    of sizes that can be similar; how many signatures they share, and the larger of
    what the two have to spare."""
    left = shared.select("sign", *[F.col(c).alias(f"_{c}") for c in ("doc", "class", "low", "high", "spare")])
    fits = (5 * F.col("_high") >= 4 * F.col("low")) & (5 * F.col("high") >= 4 * F.col("_low"))
    made = left.join(shared, "sign").where((F.col("_doc") < F.col("doc")) & (F.col("_class") != F.col("class")) & fits)
    return made.groupBy(F.col("_doc").alias("a"), F.col("doc").alias("b")).agg(
        F.count(F.lit(1)).alias("common"), F.max(F.greatest("_spare", "spare")).alias("spare")
    )


KIND = 1.02  # sizes of one kind differ by that factor at most
KINDS = sorted({int(KIND**k) for k in range(1, 1100)})


def _with_company(texts: DataFrame, short: DataFrame) -> DataFrame:
    """Those of the sets that can be similar to another one at all. A set of n elements
    is similar to one of m only if 4/9 of n + m of its elements are in sets of that kind
    of size, so elements that no other set has rule out whole kinds, most often all of
    them. Elements travel packed, and each bucket sends back numbers."""
    if not short.where("low <> high").isEmpty():  # ids that several texts share
        return short
    total = short.agg(F.sum("low")).first()[0]
    buckets = max(16, total // (1 << 16))

    def send(batches):
        elements, owners, kinds, waiting = [], [], [], 0
        for batch in slices(batches, limit=SLICE_BYTES):
            for name, found in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"))):
                elements.append(found)
                owners.append(np.full(len(found), name, dtype=np.int64))
                kinds.append(np.full(len(found), _kind(len(found)), dtype=np.int32))
                waiting += len(found)
            if waiting > FLUSH_SIGNATURES:
                yield _packed(buckets, *map(np.concatenate, (elements, owners, kinds)))
                elements, owners, kinds, waiting = [], [], [], 0
        if waiting:
            yield _packed(buckets, *map(np.concatenate, (elements, owners, kinds)))

    wanted = texts.join(short.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    met = wanted.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(_company, "doc long, kind int, n long")
    counts = met.groupBy("doc", F.col("kind").alias("other")).agg(F.sum("n").alias("n")).join(short, "doc")
    steps = F.array(*map(F.lit, KINDS))
    likely = counts.where(9 * F.col("n") >= 4 * (F.col("low") + F.element_at(steps, F.col("other") + 1)))
    return written(short.join(likely.select("doc").distinct(), "doc", "left_semi"), "company")


def _kind(size: int) -> int:
    return bisect.bisect_right(KINDS, size) - 1


def _packed(buckets: int, elements: np.ndarray, owners: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
    bucket = (mix(elements) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    blobs = [pack(elements[part], owners[part], kinds[part]) for part in parts]
    numbers = [int(bucket[part[0]]) for part in parts]
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _company(table: pa.Table) -> pa.Table:
    """For each set and kind, how many of its elements are in another set of the kind."""
    parts = [unpack(blob.as_py(), _U, np.int64, np.int32) for blob in table.column("blob")]
    element, owner, kind = (np.concatenate(x) for x in zip(*parts))
    pairs = np.stack([element, kind.astype(_U)])
    pairs, sets = np.unique(pairs, axis=1, return_counts=True)
    begin = np.searchsorted(pairs[0], element, "left")
    count = np.searchsorted(pairs[0], element, "right") - begin
    row = np.repeat(np.arange(len(element)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[row]
    other = pairs[1][at].astype(np.int32)
    company = (other != kind[row]) | (sets[at] > 1)
    met, times = np.unique(np.stack([owner[row[company]], other[company].astype(np.int64)]), axis=1, return_counts=True)
    return pa.Table.from_arrays([pa.array(met[0]), pa.array(met[1].astype(np.int32)), pa.array(times)], ["doc", "kind", "n"])


def _neighbourhood_rows(texts: DataFrame, short: DataFrame) -> DataFrame:
    def make(batches):
        for batch in slices(batches, limit=SLICE_BYTES):
            sets = [neighbourhoods(x) for x in shingle_sets(batch.column("text"))]
            names = np.repeat(batch.column("doc_id").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sets).view(np.int64)), pa.array(names)], ["sign", "doc"]
            )

    wanted = texts.join(short.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    made = wanted.mapInArrow(make, "sign long, doc long").distinct()
    return written(made.join(short, "doc"), "neighbourhoods")


def _packs(texts: DataFrame, near: DataFrame) -> DataFrame:
    """(doc, class, pack) for the sets of ``near``. Sets of the same smallest signature
    lie side by side, as most similar ones do."""
    bytes_ = texts.groupBy(F.col("doc_id").alias("doc")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    sets = near.groupBy("doc", "class").agg(F.min("sign").alias("least")).join(bytes_, "doc")

    def weigh(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            weight = np.maximum(1, batch.column("bytes").to_numpy() * PACK_SETS // PACK_BYTES)
            begin = before + np.cumsum(weight) - weight
            before += int(weight.sum())
            columns = [batch.column("doc"), batch.column("class"), pa.array(np.full(len(weight), part)), pa.array(begin), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "class", "part", "begin", "weight"])

    placed = sets.repartitionByRange("least", "doc").sortWithinPartitions("least", "doc")
    placed = written(placed.mapInArrow(weigh, "doc long, class long, part long, begin long, weight long"), "placed")
    # packs go on from one partition into the next, so many partitions don't make small packs
    sizes = sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("weight")).collect())
    starts = [(part, sum(n for _, n in sizes[:i])) for i, (part, _) in enumerate(sizes)]
    starts = texts.sparkSession.createDataFrame(starts, "part long, start long")
    pack = F.floor((F.col("start") + F.col("begin")) / PACK_SETS).alias("pack")
    return written(placed.join(starts, "part").select("doc", "class", pack), "packs")


def _packs_compared(texts: DataFrame, near: DataFrame) -> DataFrame:
    """A link (a, b) for each two classes that have similar sets in two packs, of the
    packs that share a signature at all. ``near`` has the signatures of the sets."""
    packs = _packs(texts, near)
    signs = near.select("sign", "doc", "low", "high").join(packs, "doc").groupBy("sign", "pack").agg(
        F.min("class").alias("first"), F.max("class").alias("last"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    signs = written(signs, "signs-of-packs")
    left = signs.select("sign", *[F.col(c).alias(f"_{c}") for c in ("pack", "first", "last", "low", "high")])
    fits = (5 * F.col("_high") >= 4 * F.col("low")) & (5 * F.col("high") >= 4 * F.col("_low"))
    several = F.least("_first", "first") < F.greatest("_last", "last")
    met = left.join(signs, "sign").where((F.col("_pack") <= F.col("pack")) & fits & several)
    pairs = written(met.select(F.col("_pack").alias("one"), F.col("pack").alias("other")).distinct(), "pairs-of-packs")
    sides = pairs.select("one", "other", F.col("one").alias("pack")).union(
        pairs.where("one <> other").select("one", "other", F.col("other").alias("pack"))
    )
    placed = sides.join(packs, "pack").join(texts, F.col("doc") == F.col("doc_id"))
    placed = placed.select("one", "other", "pack", "doc", "class", "text")
    return placed.groupBy("one", "other").applyInArrow(_compare_packs, "a long, b long")


def _compare_packs(table: pa.Table) -> pa.Table:
    one, other = table.column("one")[0].as_py(), table.column("other")[0].as_py()
    sets, columns = [], {"pack": [], "doc": [], "class": []}
    for batch in slices(table.to_batches(), limit=SLICE_BYTES):
        sets += shingle_sets(batch.column("text"))
        for name, held in columns.items():
            held.append(batch.column(name).to_numpy())
    pack, doc, kind = (np.concatenate(held) for held in columns.values())
    found: dict[tuple[int, int], tuple[int, int]] = {}
    left, right = (
        [part[i : i + PACK_SETS] for i in range(0, len(part), PACK_SETS)]
        for part in (np.flatnonzero(pack == one), np.flatnonzero(pack == other))
    )
    for rows in left:
        for others in right:
            common = _common([sets[i] for i in rows], [sets[i] for i in others])
            total = np.add.outer([len(sets[i]) for i in rows], [len(sets[i]) for i in others])
            fits = (9 * common >= 4 * total) & (total > 0) & (kind[rows][:, None] != kind[others])
            for i, j in zip(*np.nonzero(fits)):
                x, y = rows[i], others[j]
                found.setdefault((min(kind[x], kind[y]), max(kind[x], kind[y])), (doc[x], doc[y]))
    ends = np.array(list(found.values()), dtype=np.int64).reshape(-1, 2)
    return pa.Table.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _common(some: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of some sets shares with each of the others."""
    sets = some + others
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = often > 1
    held = several[which]
    owner, column = owner[held], (np.cumsum(several) - 1)[which[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(some), len(others)), dtype=np.int64)
    for low in range(0, int(several.sum()), PACK_COLUMNS):
        begin, end = np.searchsorted(column, [low, low + PACK_COLUMNS])
        has = np.zeros((len(sets), PACK_COLUMNS), dtype=np.float32)
        has[owner[begin:end], column[begin:end] - low] = 1
        common += (has[: len(some)] @ has[len(some) :].T).astype(np.int64)
    return common


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id is ``wanted``. A bitmap of fixed size keeps most others out
    of the join."""
    size = FILTER_BITS

    def places(names: np.ndarray) -> np.ndarray:
        return (mix(names.astype(_U)) % _U(size)).astype(np.int64)

    def mark(batches):
        bits = np.zeros(size // 64, dtype=_U)
        for batch in batches:
            at = places(batch.column("wanted").to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, at >> 6, _U(1) << (at & 63).astype(_U))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bits[some].view(np.int64))], ["word", "bits"])

    words = wanted.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    known = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint8))

    def sift(batches):
        held = np.unpackbits(known.value, bitorder="little").astype(bool)
        for batch in batches:
            names = batch.column("doc_id")
            yield batch.filter(pa.array(held[places(names.fill_null(0).to_numpy(zero_copy_only=False))]))

    some = rows.mapInArrow(sift, rows.schema)
    return some.join(wanted.distinct(), some["doc_id"] == wanted["wanted"], "left_semi")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those (a, b) whose whole shingle sets are similar. Sets to compare with the
    same one follow it through a task, at most about ``MEMBERS`` of them."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).cast("int").alias("parts"))
    leaders = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc"))
    others = pairs.join(counts, "a").select(
        "a", F.pmod(F.hash("b"), F.col("parts")).alias("part"), F.col("b").alias("doc")
    )
    asked = leaders.withColumn("leads", F.lit(True)).union(others.withColumn("leads", F.lit(False)))
    placed = asked.join(texts, F.col("doc") == F.col("doc_id")).select("a", "part", "leads", "doc", "text")
    follow = placed.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("leads"))
    return follow.mapInArrow(_compare, "a long, b long").distinct()


def _compare(batches):
    key, leaders = None, []
    for batch in slices(batches, limit=SLICE_BYTES):
        found = []
        columns = [batch.column(c).to_pylist() for c in ("a", "part", "leads", "doc")]
        for a, part, leads, doc, elements in zip(*columns, shingle_sets(batch.column("text"))):
            if (a, part) != key:
                key, leaders = (a, part), []
            if leads:
                leaders.append(elements)
            elif any(similar(leader, elements) for leader in leaders):
                found.append((a, doc))
        if found:
            left, right = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    total = len(one) + len(other)
    if not total or 5 * min(len(one), len(other)) < 4 * max(len(one), len(other)):
        return False
    at = np.searchsorted(one, other)
    at[at == len(one)] = 0
    return 9 * int((one[at] == other).sum()) >= 4 * total


@registered(
    "op10_jaccard_join",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS t
    FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT doc_id, b FROM reached JOIN links ON a = other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN n USING (doc_id) GROUP BY ALL
""",
)
def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five words, similarity 0.8."""
    return linked(load(spark, sf_dir, "documents"))
