"""Quality rules: text statistics, and perplexity bands for each language.

Word choice and word order are judged by modified Kneser-Ney trigrams over words, which
grow with the input (``wordmodel``); spelling and signs by such a model over UTF-8
bytes, one for each value of ``lang`` (null counts as empty), counted by Spark over all
documents. The latter has at most 2**24 trigrams a language; it is kept as sorted arrays
of packed trigrams that are looked up by binary search, and goes to the tasks in
blocks of at most ``block_grams`` trigrams or one language, one pass for each.

A document's scores are its mean negative log probability per byte, and per word under
the other documents. The byte band of a language is its median, give or take ``spread``
robust deviations (at least ``least`` nats), over the documents that pass the base
rules; the word band likewise, with ``WORD_SPREAD`` and ``WORD_LEAST``, but has no lower
end: a document is only too likely there if others are like it, which is no fault of
the one that stays. Medians are exact: scores are rounded to 1/1000 and counted.

Null and empty texts have no words and fail the base rule. Repeated rows count as
often as they are there; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import load, registered, written
from strata.llm.tokens import Words, byte_hashes, byte_sums, mix, slices
from strata.llm.wordmodel import sequences, word_scores

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
REPEATED = 3
SPREAD = 6.0
LEAST = 0.12
# chosen by the labels that are not held out
WORD_SPREAD = 2.0
WORD_LEAST = 0.5
BLOCK_GRAMS = 1 << 24
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_U = np.uint64


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[offsets])


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = Words(column)
    data, offsets, texts = words.data, words.offsets, len(words.offsets) - 1
    letters = words.inside & ((data & 0xC0) != 0x80)
    sums = byte_sums(data)
    return {
        "n_words": words.counts,
        "word_chars": _per_text(letters, offsets),
        "n_symbols": _per_text(_SYMBOLS[data], offsets),
        "n_dup_lines": _repeated_lines(words, sums, texts),
        "n_repeat_words": _repeated_words(words, byte_hashes(sums, words.start, words.end), texts),
    }


def _repeated_lines(words: Words, sums, texts: int) -> np.ndarray:
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 0x0A)
    start = np.union1d(offsets[:-1], breaks + 1)
    start = start[start < len(data)]
    text = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start)], offsets[text + 1])
    said = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, text = start[said], end[said], text[said]
    key = mix(byte_hashes(sums, start, end) ^ mix(text.astype(_U) + _U(1)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(text, minlength=texts) - np.bincount(text[first], minlength=texts)


def _repeated_words(words: Words, hashes: np.ndarray, texts: int) -> np.ndarray:
    at, grams = words.windows(hashes, REPEATED)
    if not len(at):
        return np.zeros(texts, dtype=np.int64)
    key = mix(grams ^ mix(words.doc[at].astype(_U) + _U(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = at[order[np.append(same, False) | np.append(False, same)]]
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + REPEATED, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=texts)


def _codes(data: np.ndarray) -> np.ndarray:
    """The packed trigrams of a text."""
    wide = data.astype(np.uint32)
    return (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]


def _language():
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def trigram_counts(documents: DataFrame) -> DataFrame:
    """(lang, gram, n) over all documents; added up in each task first."""

    def count(batches):
        held: dict[str, list] = {}
        size = 0
        for batch in slices(batches):
            text = batch.column("text")
            for name, chosen in _by_language(batch.column("lang")).items():
                words = [t for t in text.take(pa.array(chosen)).to_pylist() if t]
                # three zero bytes keep texts apart; grams with one are left out
                data = np.frombuffer("\0\0\0".join(words).encode(), dtype=np.uint8)
                if len(data) < 3:
                    continue
                held.setdefault(name, []).append(np.unique(_codes(data), return_counts=True))
                size += len(held[name][-1][0])
            if size > 1 << 21:
                held = {name: [_added(parts)] for name, parts in held.items()}
                size = 0
        for name, parts in held.items():
            grams, counts = _added(parts)
            real = ((grams & 0xFF) > 0) & ((grams >> 8 & 0xFF) > 0) & ((grams >> 16) > 0)
            grams, counts = grams[real], counts[real]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(counts)],
                ["lang", "gram", "n"],
            )

    counted = documents.select(_language().alias("lang"), "text").mapInArrow(
        count, "lang string, gram int, n long"
    )
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _by_language(column: pa.Array) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for i, name in enumerate(column.to_pylist()):
        found.setdefault(name, []).append(i)
    return found


def _added(parts):
    grams = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    known, which = np.unique(grams, return_inverse=True)
    return known, np.bincount(which, weights=counts, minlength=len(known)).astype(np.int64)


class KneserNey:
    """Log probabilities of a modified Kneser-Ney trigram model over bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, counts = grams[order].astype(np.uint32), counts[order].astype(np.float64)
        pairs, n_pairs = np.unique(self.grams & 0xFFFF, return_counts=True)  # kinds of what comes before
        singles, n_singles = np.unique(pairs & 0xFF, return_counts=True)
        # lowest order: how many pairs a byte ends, smoothed with an even draw
        self.one = np.zeros(256)
        rest = _discounted(n_singles)
        self.one[singles] = rest[0] / max(n_singles.sum(), 1)
        self.one += rest[1] / max(n_singles.sum(), 1) / 256 if len(singles) else 1 / 256
        self.one /= self.one.sum()
        self.pairs, self.two, self.weight_two = self._order(pairs, n_pairs.astype(np.float64), 256, lambda g: self.one[g & 0xFF])
        lower = lambda g: self._pair(g & 0xFFFF)
        self.grams, self.three, self.weight_three = self._order(self.grams, counts, 1 << 16, lower)
        self.three = np.log(self.three)

    @staticmethod
    def _order(grams, counts, contexts, lower):
        """Probabilities of the grams seen, and each context's weight of the order below."""
        context = (grams >> 8).astype(np.int64)
        total = np.bincount(context, weights=counts, minlength=contexts)
        kept, _, cut = _discounted(counts, each=True)
        weight = np.bincount(context, weights=cut, minlength=contexts)
        weight = np.divide(weight, total, out=np.ones(contexts), where=total > 0)
        return grams, kept / total[context] + weight[context] * lower(grams), weight

    def _pair(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        backed = self.weight_two[pairs >> 8] * self.one[pairs & 0xFF]
        return np.where(self.pairs[at] == pairs, self.two[at], backed)

    def log(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each trigram after the other two."""
        if not len(self.grams):
            return np.log(self.one[grams & 0xFF])
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        found = self.three[at]
        new = np.flatnonzero(self.grams[at] != grams)
        found[new] = np.log(self.weight_three[grams[new] >> 8] * self._pair(grams[new] & 0xFFFF))
        return found


def _discounted(counts: np.ndarray, each: bool = False):
    """Counts less their discount, and what was taken off: in all, or of each."""
    times = [np.count_nonzero(counts == i) for i in (1, 2, 3, 4)]
    if min(times) > 0:
        base = times[0] / (times[0] + 2 * times[1])
        off = [max(0.05, i + 1 - (i + 2) * base * times[i + 1] / times[i]) for i in range(3)]
    else:
        off = [0.5, 0.75, 1.0]  # too few counts to estimate them
    cut = np.minimum(np.select([counts == 1, counts == 2], off[:2], off[2]), counts * 0.95)
    return (counts - cut, cut.sum(), cut) if each else (counts - cut, cut.sum())


def scored(documents: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """The documents, all columns, with ``__measured``: base counts and the mean
    negative log probability per byte (null under three bytes) and per word (null
    without words)."""
    counts = written(trigram_counts(documents), "trigrams")
    sizes = sorted(tuple(r) for r in counts.groupBy("lang").agg(F.count(F.lit(1))).collect())
    blocks: list[list[str]] = [[]]
    held = 0
    for name, n in sizes:
        if held and held + n > block_grams:
            blocks.append([])
            held = 0
        blocks[-1].append(name)
        held += n
    language = _language()
    results = []
    for number, names in enumerate(blocks):
        mine = language.isin(names)
        if number == 0:  # languages whose texts are all but empty have no model
            mine = mine | ~language.isin([name for name, _ in sizes])
        results.append(_measured(documents.where(mine), _models(counts.where(F.col("lang").isin(names)))))
    made = results[0]
    for more in results[1:]:
        made = made.union(more)
    found = word_scores(documents).select(F.col("key").alias("__key"), F.col("score").alias("__words"))
    made = made.join(found, F.col("__measured.key") == F.col("__key"), "left")
    measured = F.col("__measured").dropFields("key").withField("word_score", F.col("__words"))
    return made.withColumn("__measured", measured).drop("__key", "__words")


def _models(counts: DataFrame) -> dict[str, KneserNey]:
    table = counts.toArrow()
    models = {}
    grams, times = table.column("gram").to_numpy().astype(np.uint32), table.column("n").to_numpy()
    for name, chosen in _by_language(table.column("lang")).items():
        models[name] = KneserNey(grams[chosen], times[chosen])
    return models


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = "struct<" + ", ".join(f"{c}: long" for c in _COUNTS) + ", score: double, lang: string, key: long>"


def _measured(documents: DataFrame, models: dict) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(models)
    columns = [c for c in documents.columns if c != "__measured"]

    def measure(batches):
        models = shared.value
        for batch in slices(batches):
            text = batch.column("text")
            names = batch.column("lang").cast(pa.string()).fill_null("")
            counts = base_counts(text)
            scores = [_score(models.get(name), t) for name, t in zip(names.to_pylist(), text.to_pylist())]
            keys = sequences(text, names.to_pylist())[3]
            fields = [pa.array(counts[c]) for c in _COUNTS] + [pa.array(scores, pa.float64()), names, pa.array(keys.view(np.int64))]
            made = pa.StructArray.from_arrays(fields, [*_COUNTS, "score", "lang", "key"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], made], [*columns, "__measured"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*[f"`{c}`" for c in columns]).schema)
    return documents.select(*[f"`{c}`" for c in columns]).mapInArrow(measure, f"{kinds}, __measured {_MEASURED}")


def _score(model: KneserNey | None, text: str | None) -> float | None:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if model is None or len(data) < 3:
        return None
    grams, times = np.unique(_codes(data), return_counts=True)
    return float(-(model.log(grams) * times).sum() / times.sum())


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def bands(measured: DataFrame, spread: float = SPREAD, least: float = LEAST) -> DataFrame:
    """(lang, low, high, word_high) from the ``__measured`` of documents that pass the
    base rules."""
    m = F.col("__measured")
    good = measured.where(~base_failed(m["n_words"], m["n_repeat_words"]))
    letters = _band(good, "score", spread, least)
    words = _band(good, "word_score", WORD_SPREAD, WORD_LEAST).select(F.col("lang").alias("_lang"), F.col("high").alias("word_high"))
    both = letters.join(words, letters["lang"] == words["_lang"], "left").drop("_lang")
    return written(both, "bands")


def _band(measured: DataFrame, score: str, spread: float, least: float) -> DataFrame:
    """(lang, low, high): the median, give or take."""
    m = F.col("__measured")
    counted = written(
        measured.where(m[score].isNotNull())
        .groupBy(m["lang"].alias("lang"), F.round(m[score] * 1000).cast("int").alias("score"))
        .agg(F.count(F.lit(1)).alias("n")),
        "scores",
    )
    middle = counted.groupBy("lang").agg(F.percentile("score", 0.5, F.col("n")).alias("middle"))
    away = counted.join(middle, "lang").select(
        "lang", "middle", F.abs(F.col("score") - F.col("middle")).alias("away"), "n"
    )
    wide = away.groupBy("lang", "middle").agg(F.percentile("away", 0.5, F.col("n")).alias("away"))
    half = F.greatest(F.lit(least), F.lit(spread * 1.4826) * F.col("away") / 1000)
    return wide.select("lang", (F.col("middle") / 1000 - half).alias("low"), (F.col("middle") / 1000 + half).alias("high"))


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows with ``__kept``: base rules passed and the scores inside their bands."""
    m = F.col("__measured")
    limits = limits.select(*[F.col(c).alias(f"__{c}") for c in ("lang", "low", "high", "word_high")])
    fits = m["score"].between(F.col("__low"), F.col("__high")) & (m["word_score"] <= F.col("__word_high"))
    kept = ~base_failed(m["n_words"], m["n_repeat_words"]) & F.coalesce(fits, F.lit(False))
    joined = measured.join(limits, m["lang"] == F.col("__lang"), "left")
    return joined.withColumn("__kept", kept).drop("__lang")


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with. They are measured
    twice, so that no text is written or shuffled for the bands; it is once, to meet the
    word scores, where these are too many to go to every task."""
    texts = scored(documents)
    limits = bands(texts.select("__measured"))
    found = judged(texts, limits).where("__kept")
    return found.select(*[f"`{c}`" for c in documents.columns])


@registered("op5_quality_rules")
def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on all documents."""
    measured = written(scored(load(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text"), "measured")
    found = judged(measured, bands(measured))
    m = F.col("__measured")
    return found.select(
        "doc_id",
        *[m[c].alias(c) for c in _COUNTS],
        base_failed(m["n_words"], m["n_repeat_words"]).alias("base_failed"),
        F.col("__kept").alias("kept"),
        m["score"].alias("log_perplexity"),
        F.col("__low").alias("low"),
        F.col("__high").alias("high"),
        m["word_score"].alias("word_log_perplexity"),
        F.col("__word_high").alias("word_high"),
    )
