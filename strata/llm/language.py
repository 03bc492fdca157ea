"""Language identification by unigrams over a fixed public vocabulary, with the
segmentation summed out.

Each language has a probability for every piece of the vocabulary. A word's
probability is the sum over all ways to cut it into pieces, by the forward
algorithm; a text's is the product over its words. Training is expectation-
maximisation: the forward-backward algorithm gives the expected number of uses of each
piece in each word, Spark adds them up per language over all training texts, and they
are smoothed with those of all languages together. The first step takes the
vocabulary's own (rank) probabilities, each other one those of the step before, until
no language's change by more than ``SETTLED`` in all, or ``STEPS`` steps. Spark counts
the different words of each language once, and the steps read those.

Words are runs of letters, lower-cased, of at most ``WORD`` letters (longer runs are
cut), with a space in front. Equal words of a slice are worked out once, for all of
them at once as arrays, and kept for later slices up to ``CACHE`` words.

A text that is null or has no letter is ``und`` with score 0, as is every text if
nothing was learned. Ties go to the first language by name. A null doc_id counts as
held out. Repeated rows are learned from as often as they are there; other columns
are not looked at. A vocabulary has a fixed size, so has what goes to the tasks for
each language.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import load, registered, written
from strata.llm.tokens import Words, mix, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
WORD = 20
CACHE = 400_000
RANK_OFFSET = 500
SMOOTHING = 200.0
SETTLED = 0.02  # sum of what the probabilities of a language change by
STEPS = 30
UNDECIDED = "und"
_U = np.uint64
_SCALE = 4096.0  # per byte, so that products of small probabilities stay in range
_LETTERS = re.compile(r"[\W\d_]+")
_LONG = re.compile(rf"(\w{{{WORD}}})(?=\w)")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


class Pieces:
    """The pieces that can be part of a word, found by hash."""

    def __init__(self, pieces: list[bytes], ranks: list[int]):
        self.weight = 1.0 / (np.array(ranks, dtype=np.float64) + RANK_OFFSET)
        self.weight /= self.weight.sum()
        self.length = np.array([len(p) for p in pieces])
        self.lengths = sorted({len(p) for p in pieces})
        base = _U(0x9E3779B97F4A7C15)
        self.byte = mix(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D))
        inverse = _U(pow(int(base), -1, 1 << 64))
        steps = 4 * WORD + 2
        self.up = np.multiply.accumulate(np.append(_U(1), np.full(steps, base, dtype=_U)))
        self.down = np.multiply.accumulate(np.append(_U(1), np.full(steps, inverse, dtype=_U)))
        keys = np.array([self._hash(p) for p in pieces], dtype=_U)
        self.keys = np.append(keys, _U(0))
        # two tables of places: pieces that collide in the first are in the second
        self.first = np.full(1 << 20, len(keys), dtype=np.int32)
        self.first[(keys >> _U(44)).astype(np.int64)[::-1]] = np.arange(len(keys))[::-1]
        missed = np.flatnonzero(self.first[(keys >> _U(44)).astype(np.int64)] != np.arange(len(keys)))
        order = np.argsort(keys[missed])
        self.rest, self.rest_at = keys[missed][order], missed[order].astype(np.int32)

    def __len__(self) -> int:
        return len(self.length)

    def _hash(self, piece: bytes) -> np.uint64:
        data = np.frombuffer(piece, dtype=np.uint8)
        return mix((self.byte[data] * self.up[: len(data)]).sum(keepdims=True))[0]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece with each hash, or one past the last."""
        at = self.first[(keys >> _U(44)).astype(np.int64)]
        wrong = np.flatnonzero((self.keys[at] != keys) & (at < len(self)))
        at[wrong] = len(self)
        if len(self.rest) and len(wrong):
            place = np.minimum(np.searchsorted(self.rest, keys[wrong]), len(self.rest) - 1)
            real = self.rest[place] == keys[wrong]
            at[wrong[real]] = self.rest_at[place[real]]
        return at


def read_pieces(path: str = VOCABULARY, longest: int = 4 * WORD + 1) -> Pieces:
    """The pieces of a vocabulary file (base64 and rank per line) that can occur in a
    lower-cased word; all single bytes are among them."""
    pieces, ranks = [], []
    with open(path, "rb") as lines:
        for line in lines:
            piece, rank = line.split()
            piece = base64.b64decode(piece)
            if len(piece) > longest or re.search(rb"[\x00-\x1f\x21-\x60\x7b-\x7f]|.\x20|^\x20$", piece, re.S) and len(piece) > 1:
                continue
            pieces.append(piece)
            ranks.append(int(rank))
    return Pieces(pieces, ranks)


def letters(texts: list[str | None]) -> list[str]:
    """Texts reduced to lower-cased words with one space between."""
    found = []
    for text in texts:
        text = _LETTERS.sub(" ", (text or "").lower())
        found.append(_LONG.sub(r"\1 ", text))
    return found


class Lattice:
    """Distinct words as rows of bytes, longest first, and the pieces that end at
    each place."""

    def __init__(self, pieces: Pieces, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start
        self.order = np.argsort(-size, kind="stable")
        start, self.size = start[self.order], size[self.order] + 1
        longest = int(self.size[0]) if len(size) else 0
        self.rows = np.full((len(start), longest), 0x20, dtype=np.uint8)
        padded = np.append(data, np.zeros(longest, dtype=np.uint8))
        for place in range(1, longest):
            alive = self.alive(place + 1)
            self.rows[:alive, place] = padded[start[:alive] + place - 1]
        self.pieces = pieces
        self.sums = np.zeros((longest + 1, len(start)), dtype=_U)
        for place in range(longest):
            self.sums[place + 1] = self.sums[place] + pieces.byte[self.rows[:, place]] * pieces.up[place]

    def alive(self, place: int) -> int:
        """How many words have at least ``place`` bytes."""
        return int(np.searchsorted(-self.size, -place, "right"))

    def arcs(self):
        """(from, to, words, piece of each word) for all stretches, in order of their end."""
        longest = self.rows.shape[1]
        for to in range(1, longest + 1):
            alive = self.alive(to)
            for begin in [to - length for length in reversed(self.pieces.lengths) if length <= to]:
                keys = mix((self.sums[to, :alive] - self.sums[begin, :alive]) * self.pieces.down[begin])
                yield begin, to, alive, self.pieces.find(keys)


def forward(lattice: Lattice, scaled: np.ndarray) -> np.ndarray:
    """Log probability of each word (in the order given) for each column of
    ``scaled``, the pieces' probabilities times the scale per byte, with a row of
    zeros for no piece."""
    words, longest = lattice.rows.shape
    alpha = np.zeros((longest + 1, words, scaled.shape[1]))
    if words:
        alpha[0] = 1.0
    for begin, to, alive, found in lattice.arcs():
        some = np.flatnonzero(found < len(lattice.pieces))
        alpha[to, some] += alpha[begin, some] * scaled[found[some]]
    total = np.maximum(alpha[lattice.size, np.arange(words)], 1e-300)
    logs = np.empty((words, scaled.shape[1]))
    logs[lattice.order] = np.log(total) - lattice.size[:, None] * np.log(_SCALE)
    return logs


def expected(lattice: Lattice, scaled: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, (pieces, columns), where ``weights`` says how often
    each word (in the order given) occurs in each column."""
    words, longest = lattice.rows.shape
    alpha, beta = np.zeros((longest + 1, words)), np.zeros((longest + 1, words))
    alpha[0], beta[lattice.size, np.arange(words)] = 1.0, 1.0
    arcs = list(lattice.arcs())
    for begin, to, alive, found in arcs:
        alpha[to, :alive] += alpha[begin, :alive] * scaled[found]
    for begin, to, alive, found in reversed(arcs):
        beta[begin, :alive] += beta[to, :alive] * scaled[found]
    total = np.maximum(beta[0], 1e-300)
    uses = np.zeros((len(lattice.pieces) + 1, weights.shape[1]))
    weights = weights[lattice.order]
    for begin, to, alive, found in arcs:
        some = np.flatnonzero(found < len(lattice.pieces))
        share = alpha[begin, some] * scaled[found[some]] * beta[to, some] / total[some]
        for column in range(weights.shape[1]):
            uses[:, column] += np.bincount(found[some], weights=share * weights[some, column], minlength=len(uses))
    return uses[:-1]


def _scaled(pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """Probabilities by piece (and column) with the scale, and the row for no piece."""
    factor = _SCALE ** pieces.length
    factor = factor if probabilities.ndim == 1 else factor[:, None]
    return np.concatenate([probabilities * factor, np.zeros((1, *probabilities.shape[1:]))])


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n): the different words of each language, over all rows of (text, lang)."""

    def count(batches):
        for batch in slices(batches):
            names, which = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
            words = Words(pa.array(letters(batch.column("text").to_pylist()), pa.string()))
            if not len(words):
                continue
            _, first, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
            codes, times = np.unique(word * len(names) + which[words.doc], return_counts=True)
            raw, at = words.data.tobytes(), first[codes // len(names)]
            said = [raw[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[codes % len(names)], pa.string()), pa.array(said, pa.binary()).cast(pa.string()), pa.array(times)],
                ["lang", "word", "n"],
            )

    made = labelled.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    counted = made.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return written(counted.sortWithinPartitions("lang", "word"), "words")  # sums must not depend on the order rows came in


def piece_uses(words: DataFrame, pieces: Pieces, names: list[str], probabilities: np.ndarray) -> np.ndarray:
    """Expected uses, (pieces, languages), over (lang, word, n) under each language's
    probabilities; Spark adds them up in millionths."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, _scaled(pieces, probabilities)))

    def count(batches):
        pieces, scaled = shared.value
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches, "word"):
            said, times = batch.column("word"), batch.column("n").to_numpy().astype(np.float64)
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            for name in np.unique(lang):
                mine = np.flatnonzero(lang == name)
                found = Words(said.take(pa.array(mine)))
                lattice = Lattice(pieces, found.data, found.start, found.end)
                uses = expected(lattice, scaled[:, names.index(name)], times[mine][:, None])
                held[name] = held.get(name, 0.0) + uses[:, 0]
        for name, uses in held.items():
            whole = np.round(uses * 1e6).astype(np.int64)
            some = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(whole[some])],
                ["lang", "piece", "uses"],
            )

    made = words.mapInArrow(count, "lang string, piece int, uses long")
    table = made.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
    shared.destroy()
    uses = np.zeros((len(pieces), len(names)))
    place = {name: i for i, name in enumerate(names)}
    column = [place[name] for name in table.column("lang").to_pylist()]
    uses[table.column("piece").to_numpy(), column] = table.column("uses").to_numpy() / 1e6
    return uses


def learn(labelled: DataFrame, pieces: Pieces, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """The languages and the pieces' probabilities in each, (pieces, languages)."""
    words = word_counts(labelled)
    names = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    probabilities = np.repeat(pieces.weight[:, None], len(names), axis=1)
    for _ in range(STEPS if names else 0):
        before, probabilities = probabilities, improved(words, pieces, names, probabilities, smoothing)
        if np.abs(probabilities - before).sum(axis=0).max() <= SETTLED:
            break
    return names, probabilities


def improved(words: DataFrame, pieces: Pieces, names: list[str], probabilities: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """The probabilities after one step."""
    uses = piece_uses(words, pieces, names, probabilities)
    everywhere = uses.sum(axis=1) + 1000 * pieces.weight
    everywhere /= everywhere.sum()
    return (uses + smoothing * everywhere[:, None]) / (uses.sum(axis=0) + smoothing)


class _Known:
    """Log probabilities of the words met so far, by hash."""

    def __init__(self, pieces: Pieces, scaled: np.ndarray):
        self.pieces, self.scaled = pieces, scaled
        self.hash, self.logs = np.zeros(0, dtype=_U), np.zeros((0, scaled.shape[1]))

    def of(self, words: Words) -> np.ndarray:
        """The log probabilities of all words, in order."""
        hashes, first, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        if len(self.hash):
            known = self.hash[np.minimum(at, len(self.hash) - 1)] == hashes
        logs = np.empty((len(hashes), self.scaled.shape[1]))
        logs[known] = self.logs[at[known]]
        new = first[~known]
        logs[~known] = forward(Lattice(self.pieces, words.data, words.start[new], words.end[new]), self.scaled)
        if len(self.hash) + len(new) > CACHE:
            self.hash, self.logs = hashes, logs
        else:
            self.hash = np.insert(self.hash, at[~known], hashes[~known])
            self.logs = np.insert(self.logs, at[~known], logs[~known], axis=0)
        return logs[word]


def predict(documents: DataFrame, pieces: Pieces, names: list[str], probabilities: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score: the language of highest probability, and that among
    all languages, taken to be equally frequent."""
    shared = documents.sparkSession.sparkContext.broadcast((pieces, _scaled(pieces, probabilities)))

    def decide(batches):
        known = _Known(*shared.value)
        for batch in slices(batches):
            texts = batch.num_rows
            words = Words(pa.array(letters(batch.column("text").to_pylist()), pa.string()))
            sums = np.zeros((texts, len(names)))
            if len(words) and names:
                logs = known.of(words)
                for column in range(len(names)):
                    sums[:, column] = np.bincount(words.doc, weights=logs[:, column], minlength=texts)
            said, score = [UNDECIDED] * texts, np.zeros(texts)
            if names:
                best = sums.argmax(axis=1)
                share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                score = np.where(words.counts > 0, share, 0.0)
                said = [names[b] if n else UNDECIDED for b, n in zip(best.tolist(), words.counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(said, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(decide, "doc_id long, lang_pred string, score double")


def identified(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, lang_pred, score for all documents, learned from the ``lang`` of those
    not held out."""
    pieces = read_pieces(vocabulary)
    labelled = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    names, probabilities = learn(labelled.select("text", F.col("lang").cast("string").alias("lang")), pieces)
    return predict(documents, pieces, names, probabilities)


@registered("op4_language_id")
def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    found = identified(load(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
