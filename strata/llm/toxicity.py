"""Toxicity of texts, also where words are disguised.

Noisy channel. Tokens that may be disguised (look-alike characters among letters, a
letter three times in a row, letters set apart by spaces or marks) become lattices:
each character may stand for several letters, repeated letters for one or two, marks
for nothing. Viterbi decoding under a character trigram model, counted by Spark over
all documents, picks the reading; restored words are scored along with the text's
own. Tokens whose lattice has a single path are left alone.

Learning uses a bounded sample: of the toxic and of the other labelled documents not
held out, the ``SAMPLE`` with the smallest hash of their id. Words, and beginnings of
words, met in at least ``LEAST_DOCUMENTS`` and a ``LEAST_SHARE`` of the toxic sample
are the candidates (that share bounds their number); those clearly more frequent in
it make the lexicon. A logistic regression on what a text's lexicon words say is the
score.

Null and empty texts are scored like a text without such words. Null ids are held
out. Several labels of one document count as toxic if one does; null labels are
left out. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.language import held_out, letters
from strata.llm.quality import KneserNey
from strata.llm.registry import load, registered
from strata.llm.tokens import Words, byte_hashes, byte_sums, mix, slices, spans, utf8

SAMPLE = 20_000
LEAST_DOCUMENTS = 4
LEAST_SHARE = 0.002
CERTAIN = 4.5  # standard errors by which a lexicon word is in more toxic texts than by chance
SAYS = 1.2  # and the log of how many times more
BEGINNINGS = (4, 5, 6, 7, 8, 9)  # bytes
THRESHOLD = 0.7
_U = np.uint64
_SIEVE = 1 << 20

# What a character may stand for.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e",
}
MARKS = ".-_*~'"
# Costs in nats; a plain letter costs nothing.
AS_READ, ONE, TWO, HALVED = 1.0, 0.5, 0.8, 2.0
LEFT_OUT, AT_EDGE = 12.0, 1.0  # signs at a token's edge are often punctuation
OTHER, GAP = 0x80, 0x20  # letters beyond a-z, and what is between words

_KNOWN = np.array([*range(ord("a"), ord("z") + 1), OTHER, GAP], dtype=np.uint32)
_PLACE = np.zeros(256, dtype=np.int64)
_PLACE[_KNOWN] = np.arange(len(_KNOWN))
_LOOK_BYTES = np.zeros(256, dtype=bool)
_LOOK_BYTES[[ord(c) for c in LOOKS if ord(c) < 128]] = True
_MARK_BYTES = np.zeros(256, dtype=bool)
_MARK_BYTES[[ord(c) for c in MARKS]] = True
_LETTER_BYTES = np.zeros(256, dtype=bool)
_LETTER_BYTES[ord("a") : ord("z") + 1] = True
_LETTER_BYTES[0xC0:] = True
_EDGE = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$|^[#%&<>?,;:\"()\[\]{}/\\.]+|[#%&<>?,;:\"()\[\]{}/\\.]+$")


def _symbols(data: np.ndarray) -> np.ndarray:
    """Lower-cased text as symbols of the character model."""
    data = data[(data & 0xC0) != 0x80]
    made = np.where((data >= ord("a")) & (data <= ord("z")), data, np.where(data >= 0xC0, OTHER, GAP)).astype(np.uint8)
    gap = made == GAP
    return made[~(gap & np.append(False, gap[:-1]))] if len(made) else made


def character_model(documents: DataFrame) -> np.ndarray:
    """Log probability of a symbol after two others, as a cube over all symbols."""

    def count(batches):
        counts = np.zeros(len(_KNOWN) ** 3, dtype=np.int64)
        for batch in slices(batches):
            data, _ = utf8(pa.array([(t or "").lower() + " " for t in batch.column("text").to_pylist()], pa.string()))
            place = _PLACE[_symbols(data)]
            if len(place) > 2:
                codes = (place[:-2] * len(_KNOWN) + place[1:-1]) * len(_KNOWN) + place[2:]
                counts += np.bincount(codes, minlength=len(counts))
        some = np.flatnonzero(counts)
        first, second, third = (_KNOWN[x].astype(np.int64) for x in np.unravel_index(some, (len(_KNOWN),) * 3))
        grams = (first << 16) | (second << 8) | third
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts[some])], ["gram", "n"])

    table = documents.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    model = KneserNey(table.column("gram").to_numpy().astype(np.uint32), table.column("n").to_numpy())
    first, second, third = np.meshgrid(_KNOWN, _KNOWN, _KNOWN, indexing="ij")
    grams = ((first << 16) | (second << 8) | third).astype(np.uint32)
    return model.log(grams.ravel()).reshape(grams.shape)


class Channel:
    """Reads disguised tokens."""

    def __init__(self, cube: np.ndarray):
        self.cube = cube.tolist()
        self.number = {chr(c): i for i, c in enumerate(range(ord("a"), ord("z") + 1))}
        self.other, self.gap = len(self.number), len(self.number) + 1
        self.read: dict[str, str] = {}

    def restore(self, token: str) -> str:
        """The likeliest reading of a lower-cased token, letters only."""
        held = self.read.get(token)
        if held is None:
            held = self._decode(_EDGE.sub("", token))
            if len(self.read) < 200_000:
                self.read[token] = held
        return held

    def _choices(self, token: str):
        """(letters, cost) choices for each run of equal characters."""
        for run in re.finditer(r"(.)\1*", token, re.S):
            char, times = run.group(1), len(run.group())
            if char in LOOKS:
                edge = not char.isdigit() and (run.start() == 0 or run.end() == len(token))
                copies = sorted({1, min(times, 2)})
                yield [(c * n, AS_READ) for c in LOOKS[char] for n in copies] + [("", AT_EDGE if edge else LEFT_OUT)]
            elif not char.isalpha():
                yield [("", 0.0 if char in MARKS else LEFT_OUT)]
            elif times > 2:
                yield [(char, ONE), (char * 2, TWO)]
            elif times == 2:
                yield [(char * 2, 0.0), (char, HALVED)]
            else:
                yield [(char, 0.0)]

    def _decode(self, token: str) -> str:
        best = {(self.gap, self.gap): (0.0, "")}
        for choices in self._choices(token):
            reached: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, said) in best.items():
                for text, price in choices:
                    x, y, total = a, b, cost + price
                    for char in text:
                        z = self.number.get(char, self.other)
                        total -= self.cube[x][y][z]
                        x, y = y, z
                    key = (x, y)
                    if key not in reached or (total, said + text) < reached[key]:
                        reached[key] = (total, said + text)
            best = reached
        ends = [(cost - self.cube[x][y][self.gap], said) for (x, y), (cost, said) in best.items()]
        return min(ends)[1]


def disguised(column: pa.Array) -> list[list[str]]:
    """Of each lower-cased text, the tokens whose lattice has several paths; letters
    standing alone one after another are one token."""
    words = Words(column)
    made: list[list[str]] = [[] for _ in range(len(column))]
    if not len(words):
        return made
    data = words.data

    def per_word(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return sums[words.end] - sums[words.start]

    letter = _LETTER_BYTES[data]
    letters_in, looks, marks = per_word(letter), per_word(_LOOK_BYTES[data]), per_word(_MARK_BYTES[data])
    triple = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        triple[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    chosen = (letters_in >= 2) & (looks > 0)
    chosen |= (letters_in > 2) & (per_word(triple) > 0)
    chosen |= (letters_in > 2) & (marks >= letters_in - 1)
    raw = data.tobytes()
    for i in np.flatnonzero(chosen).tolist():
        made[words.doc[i]].append(raw[words.start[i] : words.end[i]].decode())
    # letters (or look-alikes) standing alone
    points = per_word((data & 0xC0) != 0x80)
    alone = ((points <= 2) & (letters_in == 1) & (looks == 0)) | ((points == 1) & (looks == 1))
    begin = np.flatnonzero(alone & ~np.append(False, alone[:-1] & (words.doc[1:] == words.doc[:-1])))
    ends = np.flatnonzero(alone & ~np.append(alone[1:] & (words.doc[1:] == words.doc[:-1]), False)) + 1
    for a, b in zip(begin.tolist(), ends.tolist()):
        if b - a > 2:
            made[words.doc[a]].append("".join(raw[words.start[i] : words.end[i]].decode() for i in range(a, b)))
    return made


def restored(texts: list[str | None], channel: Channel) -> list[str]:
    """Texts as their words, with what disguised tokens were read as at the end."""
    lower = [(t or "").lower() for t in texts]
    found = disguised(pa.array(lower, pa.string()))
    return [
        " ".join([plain, *filter(None, map(channel.restore, tokens))])
        for plain, tokens in zip(letters(lower), found)
    ]


def _features(words: Words):
    """Hashes of all words and of their beginnings: (word numbers, hashes)."""
    sums = byte_sums(words.data)
    yield np.arange(len(words)), byte_hashes(sums, words.start, words.end)
    for size in BEGINNINGS:
        at = np.flatnonzero(words.end - words.start > size)
        yield at, mix(spans(sums, words.start[at], words.start[at] + size) ^ _U(size))


class Lexicon:
    """Feature hashes in order, and what each says (log of how much more frequent it is
    in toxic texts), with how certain that is."""

    def __init__(self, known: np.ndarray, says: np.ndarray, certain: np.ndarray):
        order = np.argsort(known)
        self.known, self.says, self.certain = known[order], says[order], certain[order]
        self.sieve = np.zeros(_SIEVE, dtype=bool)
        self.sieve[(self.known % _U(_SIEVE)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their places here."""
        maybe = np.flatnonzero(self.sieve[(hashes % _U(_SIEVE)).astype(np.int64)])
        if not len(self.known):
            return maybe[:0], maybe[:0]
        place = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        real = self.known[place] == hashes[maybe]
        return maybe[real], place[real]

    def looks(self, words: Words, texts: int) -> np.ndarray:
        """What is known of each text: the sum, the most and the number of what its
        words say, and how many words it has."""
        says, certain = np.zeros(len(words)), np.zeros(len(words))
        for at, hashes in _features(words):
            which, place = self.find(hashes)
            word = at[which]
            better = self.certain[place] > certain[word]
            certain[word[better]], says[word[better]] = self.certain[place[better]], self.says[place[better]]
        most = np.zeros(texts)
        np.maximum.at(most, words.doc, says)
        total = np.bincount(words.doc, weights=says, minlength=texts)
        hits = np.bincount(words.doc, weights=says > 0, minlength=texts)
        return np.stack([np.ones(texts), np.log1p(total), most, np.log1p(hits), np.log1p(words.counts)], axis=1)


def _once(values: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value and document that come together, once."""
    order = np.lexsort((documents, values))
    values, documents = values[order], documents[order]
    fresh = np.append(True, (values[1:] != values[:-1]) | (documents[1:] != documents[:-1]))[: len(values)]
    return values[fresh], documents[fresh]


_LOOKS = "label int, looks array<double>"


def sample(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(text, label) of at most ``size`` documents of either label, none held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("label")
    )
    known = known.select(F.col("doc_id").alias("_id"), "label", F.xxhash64("doc_id").alias("_order"))
    both = [known.where(F.col("label") == side).orderBy("_order", "_id").limit(size) for side in (0, 1)]
    # 2 * size ids and labels at most, so they can go to every task
    chosen = F.broadcast(both[0].union(both[1]).select("_id", "label"))
    return documents.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("text", "label")


def learn_lexicon(labelled: DataFrame, channel: Channel) -> Lexicon:
    """The words and beginnings that are clearly more frequent in toxic texts."""
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(channel)

    def met(batches):
        channel = shared.value
        for batch in slices(batches):
            words = Words(pa.array(restored(batch.column("text").to_pylist(), channel), pa.string()))
            found = [_once(hashes, words.doc[at])[0] for at, hashes in _features(words)]
            hashes, documents = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(documents)], ["feature", "documents"])

    toxic = labelled.where("label = 1")
    least = max(LEAST_DOCUMENTS, math.ceil(LEAST_SHARE * toxic.count()))
    candidates = (
        toxic.mapInArrow(met, "feature long, documents long")
        .groupBy("feature").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= least).select("feature").toArrow()
    )
    known = np.sort(candidates.column("feature").to_numpy().view(_U)) if candidates.num_rows else np.zeros(0, dtype=_U)
    wanted = spark.sparkContext.broadcast(Lexicon(known, np.zeros(len(known)), np.zeros(len(known))))

    def count(batches):
        channel, lexicon = shared.value, wanted.value
        times, total = np.zeros((2, len(lexicon.known)), dtype=np.int64), [0, 0]
        for batch in slices(batches):
            words = Words(pa.array(restored(batch.column("text").to_pylist(), channel), pa.string()))
            label = batch.column("label").to_numpy()
            for side in (0, 1):
                total[side] += int((label == side).sum())
            for at, hashes in _features(words):
                which, place = lexicon.find(hashes)
                place, document = _once(place, words.doc[at[which]])
                for side in (0, 1):
                    times[side] += np.bincount(place[label[document] == side], minlength=times.shape[1])
        for side in (0, 1):
            some = np.flatnonzero(times[side])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some) + 1, side)), pa.array(np.append(-1, some)), pa.array(np.append(total[side], times[side][some]))],
                ["label", "feature", "n"],
            )

    counts = labelled.mapInArrow(count, "label long, feature long, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow()
    times = np.zeros((2, len(known) + 1))
    times[counts.column("label").to_numpy(), counts.column("feature").to_numpy()] = counts.column("n").to_numpy()
    clean, dirty = times[0, :-1], times[1, :-1]
    texts = np.maximum(times[:, -1], 1)
    says = np.log((dirty + 0.5) / (texts[1] + 1)) - np.log((clean + 0.5) / (texts[0] + 1))
    both, share = dirty + clean, texts[1] / texts.sum()
    certain = (dirty - both * share) / np.sqrt(np.maximum(both, 1) * share * (1 - share))
    kept = (certain > CERTAIN) & (says > SAYS)
    return Lexicon(known[kept], says[kept], certain[kept])


def fit(looks: np.ndarray, label: np.ndarray, rounds: int = 30, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton's method; the penalty keeps it finite."""
    weights = np.zeros(looks.shape[1])
    for _ in range(rounds):
        odds = np.clip(looks @ weights, -30, 30)
        share = 1 / (1 + np.exp(-odds))
        slope = looks.T @ (label - share) - ridge * weights
        bend = (looks * (share * (1 - share))[:, None]).T @ looks + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score for each document."""
    spark = documents.sparkSession
    channel = Channel(character_model(documents))
    labelled = sample(documents, labels)
    lexicon = learn_lexicon(labelled, channel)
    shared = spark.sparkContext.broadcast((channel, lexicon))

    def look(batches):
        channel, lexicon = shared.value
        for batch in slices(batches):
            words = Words(pa.array(restored(batch.column("text").to_pylist(), channel), pa.string()))
            looks = lexicon.looks(words, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(looks))], ["label", "looks"])

    table = labelled.mapInArrow(look, _LOOKS).toArrow()
    if table.num_rows:
        looks = np.array(table.column("looks").to_pylist())
        order = np.lexsort(looks.T)  # sums must not depend on the order rows came in
        weights = fit(looks[order], table.column("label").to_numpy()[order].astype(np.float64))
    else:
        weights = np.zeros(5)  # nothing learned: every score is a half

    def score(batches):
        channel, lexicon = shared.value
        for batch in slices(batches):
            words = Words(pa.array(restored(batch.column("text").to_pylist(), channel), pa.string()))
            odds = np.clip(lexicon.looks(words, batch.num_rows) @ weights, -500, 500)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-odds)))], ["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id long, score double")


@registered("op6_toxicity")
def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    found = toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
