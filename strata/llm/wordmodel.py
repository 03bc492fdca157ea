"""How unlike its language a text reads: modified Kneser-Ney trigrams over words.

Counted by Spark over all documents, each language (null counts as empty) for itself;
what is gathered grows with the input and never passes the driver. Words are runs
between white space, ASCII lower-cased, as 64-bit hashes; two marks stand before a
text's first word. A text is scored by the other documents only: its own counts are
taken off before, so words and word orders that nothing else has cost it. Equal texts
count as often as they are there.

Texts are kept in blocks of about ``FLUSH_WORDS`` words in the shared folder. A block
sends the hash of each gram it has once, whatever the number of its texts that have it,
to the gram's bucket, in order and as differences. Buckets add up and answer with the
sums, and name one block of each gram's as its owner. With the answers on trigrams the
owners know what there is to say of pairs (how often one is followed by what, after how
many words it comes) and send that, and with those on pairs of words. No bucket gets
more than its share of different grams, and a gram that all texts have comes once from
each block. Blocks then put their texts' scores together from all answers. To the
driver go sums of counts of counts, eighteen numbers for each language.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import discard, written
from strata.llm.tokens import Words, mix, pack, running, slices, spans, unpack

FLUSH_WORDS = 1 << 19
BUCKET_GRAMS = 1 << 20
PARTS = 4  # in which tables meet, so that shuffle files are a part of them at a time
TEXTS, TOTALS = 9, 0  # kinds of rows beside orders (1 to 3) and answers (-1 to -3)
_U = np.uint64
_ROWS = "kind int, bucket int, block long, blob binary"
_FIELDS = 5  # of a gram: how often it is followed, by how many once, twice, more often, and what comes before


@cache
def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def sequences(text: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its language and number of words, the words of all, and a key that
    texts of the same words in the same language share."""
    words = Words(text, lower=True)
    language = np.array([_language(n) for n in names], dtype=_U)
    terms = mix(words.hashes() ^ language[words.doc]) if len(words) else np.zeros(0, dtype=_U)
    keys = mix(language + words.counts.astype(_U))
    if len(terms):
        keys = mix(keys ^ mix(spans(running(terms), words.first[:-1], words.first[1:])))
    return language, words.counts, terms, keys


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """A gram's hash, of 48 bits."""
    key = mix(columns[0] + _U(len(columns)))
    for column in columns[1:]:
        key = mix(key * _U(0x9E3779B97F4A7C15) + column)
    return key >> _U(16)


def _rows(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [[]] * 4, kinds)]


def _narrow(values: np.ndarray, wide: int) -> np.ndarray:
    """Numbers of ``wide`` bytes at most, all first bytes first, which packs better."""
    return np.ascontiguousarray(np.ascontiguousarray(values, dtype=np.uint64).view(np.uint8).reshape(-1, 8)[:, :wide].T)


def _small(values: np.ndarray) -> np.ndarray:
    """Numbers that are mostly small, in as many bytes as the largest needs."""
    return _narrow(values, max(1, -(-int(values.max(initial=0)).bit_length() // 8)))


def _widened(body: bytes, wide: int) -> np.ndarray:
    data = np.frombuffer(body, dtype=np.uint8).reshape(wide, -1)
    made = np.zeros((data.shape[1], 8), dtype=np.uint8)
    made[:, :wide] = data.T
    return made.view(np.uint64).ravel()


def _numbers(bodies: list[bytes], count: int) -> list[np.ndarray]:
    """The ``count`` numbers of each of what ``_small`` made."""
    return [_widened(body, len(body) // count).view(np.int64) for body in bodies]


def _routed(columns: list[np.ndarray], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The grams' hashes and places, in order, bucket by bucket."""
    key = _key(columns)
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.searchsorted((key >> _U(16)) * _U(buckets) >> _U(32), np.arange(1, buckets).astype(_U))
    return list(zip(np.split(key, edges), np.split(order, edges)))


def _sent(order: int, columns: list[np.ndarray], values: list[np.ndarray], buckets: int, block: int):
    for number, (key, part) in enumerate(_routed(columns, buckets)):
        if len(part):
            steps = np.diff(key, prepend=_U(0))
            yield order, number, block, pack(_narrow(steps, 6), *[_small(v[part]) for v in values], level=3)


class Grams:
    """The different words, pairs and trigrams of a block's texts."""

    def __init__(self, terms, language, seq, counts, times):
        self.terms, self.language = terms, language
        size, lengths = len(terms), counts + 2
        seq = seq.astype(np.int64)
        place = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        second, self.at = np.flatnonzero(place > 0), np.flatnonzero(place > 1)
        self.pairs, which = np.unique(seq[second - 1] * size + seq[second], return_inverse=True)
        pair = np.zeros(len(seq), dtype=np.int64)
        pair[second] = which
        self.doc = np.repeat(np.arange(len(counts)), counts)
        codes, first, self.tri = np.unique(pair[self.at - 1] * size + seq[self.at], return_index=True, return_inverse=True)
        self.before, self.last = codes // size, codes % size  # of each trigram the first pair and the last word
        self.after = pair[self.at][first]
        self.left, self.right = self.pairs // size, self.pairs % size
        self.times = np.bincount(self.tri, weights=times[self.doc], minlength=len(codes)).astype(np.int64)

    def columns(self, order: int) -> list[np.ndarray]:
        if order == 1:
            return [self.terms]
        if order == 2:
            return [self.terms[self.left], self.terms[self.right]]
        return [self.terms[self.left[self.before]], self.terms[self.right[self.before]], self.terms[self.last]]


# words and marks, their languages, texts as numbers of words, and of each text: words, key, times
_BLOCK = (_U, _U, None, np.int64, _U, np.int64)


def _block(languages, counts, terms, keys) -> list[np.ndarray]:
    """The different texts that have words, with two marks in front."""
    starts = np.cumsum(counts) - counts
    _, first, times = np.unique(keys, return_index=True, return_counts=True)
    languages, counts, keys, starts = languages[first], counts[first], keys[first], starts[first]
    lengths = counts + 2
    begin = np.cumsum(lengths) - lengths
    index = np.arange(lengths.sum()) - np.repeat(begin, lengths) - 2
    mark = index < 0
    seq = mix(np.repeat(languages, lengths) + _U(1))
    seq[~mark] = terms[(index + np.repeat(starts, lengths))[~mark]]
    known, which, often = np.unique(seq, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")  # small numbers for frequent words pack better
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    which = rank[which]
    of = np.zeros(len(known), dtype=_U)
    of[which] = np.repeat(languages, lengths)
    return [known[order], of, _narrow(which, 4), counts.astype(np.int64), keys, times.astype(np.int64)]


def _read(blob: bytes) -> list[np.ndarray]:
    block = unpack(blob, *_BLOCK)
    block[2] = _widened(block[2], 4)
    return block


def _kept(batches):
    """Blocks of texts."""
    number, held, waiting = TaskContext.get().partitionId() << 32, [], 0
    for batch in slices(batches):
        language, counts, terms, keys = sequences(batch.column("text"), batch.column("lang").to_pylist())
        some = counts > 0
        if not some.any():
            continue
        held.append((language[some], counts[some], terms, keys[some]))
        waiting += len(terms)
        if waiting >= FLUSH_WORDS:
            yield _made([(TEXTS, 0, number, pack(*_block(*(np.concatenate(c) for c in zip(*held))), level=3))])
            number, held, waiting = number + 1, [], 0
    if held:
        yield _made([(TEXTS, 0, number, pack(*_block(*(np.concatenate(c) for c in zip(*held))), level=3))])


def _made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_rows(rows), ["kind", "bucket", "block", "blob"])


def _kinds(counts: np.ndarray) -> list[np.ndarray]:
    return [counts == 1, counts == 2, counts > 2]


def _meeting(order: int):
    """Adds up what is said of the grams of a bucket, and answers: the sums, and
    whether the block is a gram's owner."""
    fields = 1 if order == 3 else _FIELDS

    def meet(table: pa.Table) -> pa.Table:
        number, blocks = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
        sizes, keys, values = [], [], []
        by = np.argsort(blocks)
        for i in by.tolist():
            steps, *body = unpack(table.column("blob")[i].as_py(), *[None] * (fields + 1))
            keys.append(np.cumsum(_widened(steps, 6)))
            values.append(np.stack(_numbers(body, len(keys[-1]))))
            sizes.append(len(keys[-1]))
        _, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        owner = np.zeros(len(which), dtype=np.int64)
        owner[first] = 1
        values = np.concatenate(values, axis=1)
        sums = [np.bincount(which, weights=v, minlength=len(first)).astype(np.int64) for v in values]
        ends = np.cumsum(sizes).tolist()
        rows = [
            (-order, number, blocks[i], pack(*[_small(s[which[end - size : end]]) for s in sums], _small(owner[end - size : end]), level=3))
            for i, size, end in zip(by.tolist(), sizes, ends)
        ]
        return pa.Table.from_arrays(_rows(rows), ["kind", "bucket", "block", "blob"])

    return meet


def _known(table: pa.Table, buckets: int):
    """A block, its grams and the answers to it by order: sums, and whether it is the owner."""
    block, told = None, {}
    for kind, bucket, blob in zip(table.column("kind").to_pylist(), table.column("bucket").to_pylist(), table.column("blob")):
        if kind == TEXTS:
            block = _read(blob.as_py())
        else:
            told.setdefault(-kind, {})[bucket] = unpack(blob.as_py(), *[None] * (2 if kind == -3 else _FIELDS + 1))
    grams, answers = Grams(*block[:4], block[5]), {}
    for order, parts in told.items():
        columns = grams.columns(order)
        answers[order] = [np.zeros(len(columns[0]), dtype=np.int64) for _ in next(iter(parts.values()))]
        for number, (_, part) in enumerate(_routed(columns, buckets)):
            if number in parts:
                for to, values in zip(answers[order], _numbers(parts[number], len(part))):
                    to[part] = values
    return block, grams, answers


def _first_asking(buckets: int):
    def ask(batches):
        for batch in batches:
            for number, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                block = _read(blob.as_py())
                grams = Grams(*block[:4], block[5])
                yield _made(list(_sent(3, grams.columns(3), [grams.times], buckets, number)))

    return ask


def _asking(order: int, buckets: int):
    """What the owners of longer grams know of a block's grams of this order; at order
    0 only counts of counts. Those of the order above go along."""

    def ask(table: pa.Table) -> pa.Table:
        _, grams, answers = _known(table, buckets)
        number = table.column("block")[0].as_py()
        *_, count, owner = answers[order + 1]
        front, back, last = {
            2: lambda: (grams.before, grams.after, grams.last),
            1: lambda: (grams.left, grams.right, grams.right),
            0: lambda: (None, None, np.arange(len(grams.terms))),
        }[order]()
        mine = (owner == 1) & (count > 0)
        language, count = grams.language[last[mine]], count[mine]
        rows = []
        for name in np.unique(language):
            some = count[language == name]
            told = [int((some == i).sum()) for i in (1, 2, 3, 4)] + [len(some), int(some.sum())]
            rows.append((TOTALS, order + 1, int(name.view(np.int64)), pack(np.array(told, dtype=np.int64))))
        if order:
            columns = grams.columns(order)
            size = len(columns[0])
            said = [np.bincount(front[mine], weights=v, minlength=size) for v in (count, *_kinds(count))]
            rows += _sent(order, columns, [*said, np.bincount(back[mine], minlength=size)], buckets, number)
        return pa.Table.from_arrays(_rows(rows), ["kind", "bucket", "block", "blob"])

    return ask


def _discounts(times) -> np.ndarray:
    """What is taken off grams seen once, twice and more often."""
    if min(times) > 0:
        base = times[0] / (times[0] + 2 * times[1])
        return np.array([min(max(0.05, i + 1 - (i + 2) * base * times[i + 1] / times[i]), (i + 1) * 0.95) for i in range(3)])
    return np.array([0.5, 0.75, 1.0])  # too few to estimate them


def _grouped(doc: np.ndarray, item: np.ndarray, items: int):
    """The different (doc, item), and which of them each row is."""
    codes, which = np.unique(doc * items + item, return_inverse=True)
    return codes // items, codes % items, which


def _left(held: np.ndarray, own: np.ndarray, which: np.ndarray, groups: int, context, item: np.ndarray):
    """Counts of a text's grams and of their contexts once its own are taken off:
    (count, how often the context is followed, by how many once, twice, more often)."""
    count = held - own
    total = context[0][item] - np.bincount(which, weights=own, minlength=groups)
    kinds = [
        context[1 + k][item] + np.bincount(which, weights=after.astype(np.int64) - before, minlength=groups)
        for k, (before, after) in enumerate(zip(_kinds(held), _kinds(count)))
    ]
    return count, total, kinds


def _smoothed(count, total, kinds, which, off, lower):
    """``off`` has the three discounts for each row."""
    cut = np.select(_kinds(count), list(off.T), 0.0)
    rest = sum(off[:, k] * kinds[k][which] for k in range(3))
    whole = np.maximum(total[which], 1)
    return np.where(total[which] > 0, (np.maximum(count - cut, 0) + rest * lower) / whole, lower)


def _scores(block: list[np.ndarray], grams: Grams, answers: dict[int, list[np.ndarray]], totals: dict) -> np.ndarray:
    """Mean negative log probability per word of each text of a block."""
    counts = block[3]
    texts = len(counts)
    names, of = np.unique(block[1][block[2][np.cumsum(counts + 2) - 1].astype(np.int64)], return_inverse=True)
    held = [[totals.get((int(n.view(np.int64)), order), np.zeros(6, dtype=np.int64)) for n in names] for order in (1, 2, 3)]
    off = [np.array([_discounts(t[:4]) for t in part]) for part in held]
    n, pair, word = answers[3][0], answers[2], answers[1]
    # trigrams: each text's own, and the pairs they follow
    doc3, tri, token = _grouped(grams.doc, grams.tri, len(n))
    own = np.bincount(token, minlength=len(tri))
    doc_b, before, in_before = _grouped(doc3, grams.before[tri], len(grams.pairs))
    count3, total3, kinds3 = _left(n[tri], own, in_before, len(before), pair, before)
    # pairs, less the trigrams that only this text has
    doc2, after, in_after = _grouped(doc3, grams.after[tri], len(grams.pairs))
    gone = np.bincount(in_after, weights=count3 == 0, minlength=len(after))
    doc_l, left, in_left = _grouped(doc2, grams.left[after], len(grams.terms))
    count2, total2, kinds2 = _left(pair[4][after], gone, in_left, len(left), word, left)
    # words, less the pairs that only this text has
    doc1, term, in_term = _grouped(doc2, grams.right[after], len(grams.terms))
    gone = np.bincount(in_term, weights=count2 == 0, minlength=len(term))
    whole = np.array([[t[5], t[0], t[1], t[4] - t[0] - t[1]] for t in held[0]])[of].T
    count1, total1, kinds1 = _left(word[4][term], gone, doc1, texts, whole, np.arange(texts))
    even = 1 / (np.array([t[4] for t in held[0]])[of[doc1]] + 1)
    one = _smoothed(count1, total1, kinds1, doc1, off[0][of[doc1]], even)
    two = _smoothed(count2, total2, kinds2, in_left, off[1][of[doc2]], one[in_term])
    three = _smoothed(count3, total3, kinds3, in_before, off[2][of[doc3]], two[in_after])
    return -np.bincount(doc3, weights=own * np.log(three), minlength=texts) / counts


def _finisher(buckets: int, totals: dict):
    def finish(table: pa.Table) -> pa.Table:
        block, grams, answers = _known(table, buckets)
        scores = np.round(_scores(block, grams, answers, totals), 9)
        return pa.Table.from_arrays([pa.array(block[4].view(np.int64)), pa.array(scores)], ["key", "score"])

    return finish


def _in_parts(rows: DataFrame, by: str, work, kinds: str, purpose: str) -> list[DataFrame]:
    """Tables of what ``work`` makes of the rows of each ``by``, one part of them after
    another."""
    part = F.pmod(F.hash(by), F.lit(PARTS))
    return [written(rows.where(part == n).groupBy(by).applyInArrow(work, kinds), purpose) for n in range(PARTS)]


def _union(tables: list[DataFrame]) -> DataFrame:
    made = tables[0]
    for more in tables[1:]:
        made = made.union(more)
    return made


def word_scores(documents: DataFrame) -> DataFrame:
    """(key, score) of all different texts of (text, lang) that have words."""
    rows = documents.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, size // 6 // BUCKET_GRAMS)
    blocks = written(rows.mapInArrow(_kept, _ROWS), "blocks")
    first = blocks.mapInArrow(_first_asking(buckets), _ROWS)  # is no table, so it meets at once
    answers = [written(first.groupBy("bucket").applyInArrow(_meeting(3), _ROWS), "answers")]
    totals: dict[tuple[int, int], np.ndarray] = {}
    latest = answers
    for order in (2, 1, 0):
        # what is said of shorter grams comes from the answers on these alone
        asked = _in_parts(_union([blocks, *latest]), "block", _asking(order, buckets), _ROWS, "asked")
        for name, number, blob in _union(asked).where(F.col("kind") == TOTALS).select("block", "bucket", "blob").toLocalIterator():
            totals[name, number] = totals.get((name, number), 0) + unpack(bytes(blob), np.int64)[0]
        if order:
            latest = _in_parts(_union(asked).where(F.col("kind") == order), "bucket", _meeting(order), _ROWS, "answers")
            answers += latest
        for table in asked:
            discard(table)
    found = _in_parts(_union([blocks, *answers]), "block", _finisher(buckets, totals), "key long, score double", "scores-of-blocks")
    made = written(_union(found).groupBy("key").agg(F.min("score").alias("score")), "word-scores")
    for table in (blocks, *answers, *found):
        discard(table)
    return made
