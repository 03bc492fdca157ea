"""Which tokens of one tokenizer stand for which of another, cut at white space.

Every text is tokenised as a whole by both: a byte-level vocabulary (A), given a space
and the text, and a piece vocabulary (B), which adds that space itself. Where a token
of A and one of B both begin with a space and at the same byte, both sides end there
too; such verified shared ends cut the tokens into windows, about a word each. How a
window's tokens line up hangs on its ids alone, so it is worked out once for each pair
of id tuples and kept in a table: its groups (cut where tokens of both end), its links
(all A and B tokens of a group) and the text of its groups.

Tasks work through blocks of ``BLOCK_BYTES`` of text. A block keeps for each text
which windows it uses how often, for each window its links, and for each id pair in
how many of its texts it is linked. Spark adds those up over all blocks, finds the
best partners of each id, and gives each block the counts of its own pairs, with which
it sums up its texts. So what is shuffled is a row for each pair of a block, not for
each pair of a text, and no group is larger than a block (or the one text it holds).

A text that is null or empty, or whose joined token bytes of A or B are not the space
and the text (a U+2581 in it, say), has no tokens: zeros and ''. Strings of special
tokens are plain text. Texts may be of any length; runs of white space over
``LONG_SPACE`` go through the slower of two equal encoders of A. Repeated rows and
rows that share an id or have none are documents of their own and count as such; other
columns are not looked at. Of an empty table there are no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.registry import load, registered, written
from strata.llm.tokens import mix, pack, running, slices, spans, unpack

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 19  # of text that is tokenised at once
PAIRS_A_ROW = 50_000
LONG_SPACE = 5_000
_LONG = re.compile(rf"\s{{{LONG_SPACE}}}")
_U = np.uint64


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    ones for themselves, the others numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A: a byte-level vocabulary file. It is run as ranks where its ids follow the
    order of its merges, else (and on very long white space) as it is."""

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, file: str):
        self.file = file

    def __reduce__(self):
        return ByteLevel, (self.file,)

    @cached_property
    def _model(self) -> dict:
        return json.loads(self.file)

    @cached_property
    def pieces(self) -> list[bytes]:
        """The bytes of each id."""
        character, vocabulary = byte_characters(), self._model["model"]["vocab"]
        special = {t["id"]: t["content"].encode() for t in self._model.get("added_tokens") or []}
        found = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for piece, number in vocabulary.items():
            found[number] = special.get(number) or bytes(character[c] for c in piece)
        return found

    @cached_property
    def _ranks(self):
        """The same tokenizer as ranks, None if its file says anything else."""
        import tiktoken

        model, split = self._model["model"], self._model["pre_tokenizer"]
        vocabulary, merges = model["vocab"], model["merges"]
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not self._model["normalizer"]
        if not plain or any(vocabulary[piece] != 256 + i for i, piece in enumerate(joined)):
            return None
        special = {t["content"] for t in self._model.get("added_tokens") or []}
        ranks = {self.pieces[number]: number for piece, number in vocabulary.items() if piece not in special}
        return tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def _whole(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_str(self.file)
        found.encode_special_tokens = True
        return found

    def encode(self, text: str) -> list[int]:
        if self._ranks is None or _LONG.search(text):
            return self._whole.encode(text, add_special_tokens=False).ids
        return self._ranks.encode_ordinary(text)


class PieceModel:
    """B: a piece model file, which puts a space before every text."""

    def __init__(self, file: bytes):
        self.file = file

    def __reduce__(self):
        return PieceModel, (self.file,)

    @cached_property
    def _model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.file)

    @cached_property
    def pieces(self) -> list[bytes]:
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        return [bytes([int(n[3:5], 16)]) if self._model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1) if texts else []


class Side:
    """The tokens of several texts, one after another."""

    def __init__(self, tokens: list[list[int]], pieces: list[bytes]):
        self.counts = np.array([len(t) for t in tokens], dtype=np.int64)
        self.ids = np.fromiter((i for t in tokens for i in t), dtype=np.int32, count=int(self.counts.sum()))
        self.length, self.spaced = _looks(pieces)
        self.end = np.cumsum(self.length[self.ids])
        self.start = self.end - self.length[self.ids]
        self.marked = np.flatnonzero(self.spaced[self.ids])


_LOOKS: dict[int, tuple[list, np.ndarray, np.ndarray]] = {}


def _looks(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes each piece has, and whether it begins with a space."""
    held = _LOOKS.get(id(pieces))
    if held is None or held[0] is not pieces:
        held = pieces, np.array([len(p) for p in pieces], dtype=np.int64), np.array([p[:1] == b" " for p in pieces])
        _LOOKS[id(pieces)] = held
    return held[1], held[2]


def tokenised(texts: list[str | None], a: ByteLevel, b: PieceModel) -> tuple[Side, Side]:
    """The tokens of each text, none where their bytes are not the text's."""
    found = [([], [])] * len(texts)
    some = [i for i, text in enumerate(texts) if text]
    for i, of_b in zip(some, b.encode([texts[i] for i in some])):
        spaced = " " + texts[i]
        wanted = spaced.encode()
        if b"".join([b.pieces[t] for t in of_b]) == wanted:
            of_a = a.encode(spaced)
            if b"".join([a.pieces[t] for t in of_a]) == wanted:
                found[i] = (of_a, of_b)
    return Side([f[0] for f in found], a.pieces), Side([f[1] for f in found], b.pieces)


class Cut:
    """The windows of several texts: where each begins and ends on both sides, and
    the text it is in."""

    def __init__(self, a: Side, b: Side):
        _, in_a, in_b = np.intersect1d(a.start[a.marked], b.start[b.marked], assume_unique=True, return_indices=True)
        self.a_from, self.b_from = a.marked[in_a], b.marked[in_b]
        self.a_to = np.append(self.a_from[1:], len(a.ids))[: len(in_a)]
        self.b_to = np.append(self.b_from[1:], len(b.ids))[: len(in_b)]
        self.text = np.repeat(np.arange(len(a.counts)), a.counts)[self.a_from]

    def __len__(self) -> int:
        return len(self.a_from)

    def different(self, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
        """One window of each kind, in the order of the texts, and the kind of every
        window, as numbers."""
        key = np.zeros(len(self), dtype=_U)
        for seed, ids, start, end in ((1, a.ids, self.a_from, self.a_to), (2, b.ids, self.b_from, self.b_to)):
            sums = running(mix(ids.astype(_U) * _U(2) + _U(seed << 40)))
            key = mix(key + spans(sums, start, end) + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))
        _, one, kind = np.unique(key, return_index=True, return_inverse=True)
        order = np.argsort(one)
        one, kind = one[order], np.argsort(order)[kind]
        if self._as(one[kind], a.ids, self.a_from, self.a_to) and self._as(one[kind], b.ids, self.b_from, self.b_to):
            return one, kind
        # hashes that collide: told apart by the ids themselves
        seen: dict[tuple, int] = {}
        windows = zip(self.a_from, self.a_to, self.b_from, self.b_to)
        kind = np.array([seen.setdefault((a.ids[i:j].tobytes(), b.ids[k:m].tobytes()), len(seen)) for i, j, k, m in windows])
        return np.unique(kind, return_index=True)[1], kind

    def _as(self, like: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
        """Whether every window has the ids of the one it is taken for."""
        size = end - start
        if not np.array_equal(size, size[like]):
            return False
        return np.array_equal(ids, ids[np.arange(len(ids)) + np.repeat(start[like] - start, size)])


class Aligned:
    """The groups and links of windows that follow each other on both sides."""

    def __init__(self, a: Side, b: Side, cut: Cut, chosen: np.ndarray, names: tuple[list[str], list[str]], width: int):
        self.windows = len(chosen)
        at_a, of_a = _ranges(cut.a_from[chosen], cut.a_to[chosen])
        at_b, of_b = _ranges(cut.b_from[chosen], cut.b_to[chosen])
        ends_a, ends_b = a.end[at_a], b.end[at_b]
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        count_a, count_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
        window = of_a[first_a] if len(shared) else np.zeros(0, dtype=np.int64)
        self.groups = np.bincount(window, minlength=self.windows)
        self.links = np.bincount(window, weights=count_a * count_b, minlength=self.windows).astype(np.int64)
        self._link(group_a, a.ids[at_a], group_b, b.ids[at_b], window, width)
        self._describe(a.ids[at_a], b.ids[at_b], first_a, first_a + count_a, first_b, first_b + count_b, names)

    def _link(self, group_a, ids_a, group_b, ids_b, window, width: int) -> None:
        """The id pairs of each window and how often each is linked in it. Equal ids
        of a group are taken together first."""
        key_a, times_a = np.unique(group_a.astype(np.int64) << 32 | ids_a, return_counts=True)
        key_b, times_b = np.unique(group_b.astype(np.int64) << 32 | ids_b, return_counts=True)
        of_b = key_b >> 32
        begin, end = np.searchsorted(of_b, key_a >> 32, "left"), np.searchsorted(of_b, key_a >> 32, "right")
        at, row = _ranges(begin, end)
        pair = (key_a[row] & 0xFFFFFFFF) * width + (key_b[at] & 0xFFFFFFFF)
        in_window, times = window[key_a[row] >> 32], times_a[row] * times_b[at]
        order = np.lexsort((pair, in_window))
        pair, in_window, times = pair[order], in_window[order], times[order]
        fresh = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (in_window[1:] != in_window[:-1]))[: len(pair)])
        self.pairs, self.times = pair[fresh], np.add.reduceat(times, fresh) if len(fresh) else times
        self.pair_counts = np.bincount(in_window[fresh], minlength=self.windows)

    def _describe(self, ids_a, ids_b, from_a, to_a, from_b, to_b, names) -> None:
        a, b = [names[0][i] for i in ids_a.tolist()], [names[1][i] for i in ids_b.tolist()]
        bounds = zip(from_a.tolist(), to_a.tolist(), from_b.tolist(), to_b.tolist())
        said = [f"{a[i] if j - i == 1 else ','.join(a[i:j])}|{b[k] if m - k == 1 else ','.join(b[k:m])}" for i, j, k, m in bounds]
        last = np.cumsum(self.groups)
        self.said = [said[i] if j - i == 1 else ";".join(said[i:j]) for i, j in zip((last - self.groups).tolist(), last.tolist())]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of [start, end) one range after another, and the range of each."""
    size = end - start
    which = np.repeat(np.arange(len(start)), size)
    return np.arange(len(which)) + np.repeat(start - (np.cumsum(size) - size), size), which


_FOUND = pa.schema(
    [
        ("block", pa.int64()), ("base", pa.int64()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
        ("part", pa.int32()), ("packed", pa.binary()),
    ]
)
_FOUND_SQL = "block long, base long, pairs array<long>, docs array<long>, part int, packed binary"


class Block:
    """Texts whose windows share one table."""

    def __init__(self, a: ByteLevel, b: PieceModel):
        self.a, self.b, self.width = a, b, len(b.pieces)
        self.names = [str(i) for i in range(len(a.pieces))], [str(i) for i in range(len(b.pieces))]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}  # (ids of A, ids of B): window
        self.said: list[str] = []
        self.tables: list[Aligned] = []
        self.parts: list[tuple] = []
        self.bytes = 0

    def add(self, doc_id: pa.Array, texts: list[str | None]) -> None:
        a, b = tokenised(texts, self.a, self.b)
        cut = Cut(a, b)
        one, kind = cut.different(a, b)
        window = self._windows(a, b, cut, one)[kind]
        groups, links = (np.concatenate([getattr(t, name) for t in self.tables] or [np.zeros(0, dtype=np.int64)]) for name in ("groups", "links"))
        total = lambda of: np.bincount(cut.text, weights=of[window], minlength=len(texts)).astype(np.int64)
        ends = np.searchsorted(cut.text, np.arange(len(texts) + 1)).tolist()
        said = [self.said[w] for w in window.tolist()]
        digests = b"".join(hashlib.sha256(";".join(said[i:j]).encode()).digest() for i, j in zip(ends, ends[1:]))
        uses, times = np.unique(cut.text * np.int64(1 << 32) + window, return_counts=True)
        empty = np.array(doc_id.is_null().to_pylist(), dtype=np.uint8)
        numbers = doc_id.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.parts.append((numbers, empty, a.counts, b.counts, total(groups), total(links), digests, uses, times.astype(np.int32)))
        self.bytes += int(a.length[a.ids].sum()) + len(texts)

    def _windows(self, a: Side, b: Side, cut: Cut, one: np.ndarray) -> np.ndarray:
        """The number of each of these windows in the block's table; those it does
        not have yet are aligned, all at once."""
        bytes_a, bytes_b = a.ids.tobytes(), b.ids.tobytes()
        places = zip(*((4 * p[one]).tolist() for p in (cut.a_from, cut.a_to, cut.b_from, cut.b_to)))
        before = len(self.known)
        number = [self.known.setdefault((bytes_a[i:j], bytes_b[k:m]), len(self.known)) for i, j, k, m in places]
        number = np.array(number, dtype=np.int64)
        self.tables.append(Aligned(a, b, cut, one[number >= before], self.names, self.width))
        self.said += self.tables[-1].said
        return number

    def rows(self, number: int):
        """What the block found, and an empty block again."""
        zero = np.zeros(0, dtype=np.int64)
        pairs, times, size = (np.concatenate([zero, *(getattr(t, name) for t in self.tables)]) for name in ("pairs", "times", "pair_counts"))
        pairs, place = np.unique(pairs, return_inverse=True)
        first = np.append(0, np.cumsum(size))
        docs = np.zeros(len(pairs), dtype=np.int64)
        for *_, uses, _times in self.parts:
            window = uses & 0xFFFFFFFF
            at, row = _ranges(first[window], first[window + 1])
            once = np.unique((uses[row] >> 32) * max(len(pairs), 1) + place[at])
            docs += np.bincount(once % max(len(pairs), 1), minlength=len(pairs))
        for base in range(0, len(pairs), PAIRS_A_ROW):
            some = slice(base, base + PAIRS_A_ROW)
            yield number, base, pairs[some], docs[some], None, None
        yield number, None, None, None, -1, pack(first, place.astype(np.int32), times, np.array([len(pairs)]))
        for part, found in enumerate(self.parts):
            yield number, None, None, None, part, pack(*found)
        self._clear()


def _found(batches, a: ByteLevel, b: PieceModel, block_bytes: int):
    block, number = Block(a, b), TaskContext.get().partitionId() << 32
    for batch in slices(batches, limit=SLICE_BYTES):
        block.add(batch.column("doc_id"), batch.column("text").to_pylist())
        if block.bytes >= block_bytes:
            yield from _batches(block.rows(number))
            number += 1
    if block.parts:
        yield from _batches(block.rows(number))


def _batches(rows):
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(row, _FOUND.types)], schema=_FOUND)


_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _summed(found: pa.Table, counted: pa.Table) -> pa.Table:
    """The texts of a block, from what it found and the counts of its pairs."""
    parts = dict(zip(found.column("part").to_pylist(), found.column("packed").to_pylist()))
    first, place, times, (pairs,) = unpack(parts.pop(-1), np.int64, np.int32, np.int64, np.int64)
    count, best = np.zeros(pairs, dtype=np.int64), np.zeros(pairs, dtype=np.int64)
    at = counted.column("place").to_numpy()
    count[at], best[at] = counted.column("count").to_numpy(), counted.column("best").to_numpy().astype(np.int64)
    up_to = [np.append(0, np.cumsum(times * of[place])) for of in (best, count)]
    of_window = [total[first[1:]] - total[first[:-1]] for total in up_to]
    tables = []
    for part in sorted(parts):
        doc_id, empty, n_a, n_b, groups, links, digests, uses, often = unpack(
            parts[part], np.int64, np.uint8, np.int64, np.int64, np.int64, np.int64, None, np.int64, np.int32
        )
        text, window = uses >> 32, uses & 0xFFFFFFFF
        sums = []
        for value in of_window:
            # whole numbers: a sum of floats would lose some
            running_sum = np.append(0, np.cumsum(value[window] * often))
            edge = np.searchsorted(text, np.arange(len(doc_id) + 1))
            sums.append(running_sum[edge[1:]] - running_sum[edge[:-1]])
        hashes = [digests[32 * i : 32 * i + 32].hex() if n else "" for i, n in enumerate(n_a.tolist())]
        columns = [pa.array(doc_id, mask=empty.astype(bool)), *map(pa.array, (n_a, n_b, groups, links, *sums)), pa.array(hashes, pa.string())]
        tables.append(pa.Table.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")]))
    return pa.concat_tables(tables)


def aligned(
    documents: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """What each document's tokens link, and (a, b, count, best) for every linked id
    pair: in how many documents, and whether no partner of ``a`` is linked in more."""
    spark = documents.sparkSession
    with open(byte_level, encoding="utf-8") as lines:
        a = ByteLevel(lines.read())
    with open(pieces, "rb") as lines:
        b = PieceModel(lines.read())
    width = len(b.pieces)
    shared = spark.sparkContext.broadcast((a, b))  # two vocabulary files
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(rows.mapInArrow(lambda batches: _found(batches, *shared.value, block_bytes), _FOUND_SQL), "aligned")

    listed = found.where("part IS NULL").select("block", "base", F.posexplode(F.arrays_zip("pairs", "docs")).alias("offset", "pair"))
    listed = listed.select("block", (F.col("base") + F.col("offset")).alias("place"), F.col("pair.pairs").alias("pair"), F.col("pair.docs").alias("docs"))
    a_id, b_id = F.floor(F.col("pair") / width), F.pmod("pair", F.lit(width))
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", a_id)
    # an id has at most as many partners as B has pieces
    best = F.col("count") == F.max("count").over(Window.partitionBy("a"))
    counts = written(counts.select("pair", "a", b_id.alias("b"), "count", best.alias("best")), "pairs")
    counted = listed.select("block", "place", "pair").join(counts, "pair").select("block", "place", "count", "best")
    blocks = found.where("part IS NOT NULL").select(F.col("block").alias("of_block"), "part", "packed")
    summed = blocks.groupBy("of_block").cogroup(counted.groupBy("block")).applyInArrow(_summed, _RESULT)
    return summed, counts.select("a", "b", "count", "best")


@registered("op13_cross_tokenizer_alignment")
def op13_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """How the tokens of every document line up between two public vocabularies."""
    return aligned(load(spark, sf_dir, "documents"))[0]
