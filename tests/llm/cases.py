"""Small tables with every odd row, and plain versions of what the operators do."""

import collections
import hashlib
import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(_UPPER, _UPPER.lower())

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for columns of their own
        *[T.StructField(n, T.StringType()) for n in ("size", "class", "sign", "n_words", "spans", "score", "bucket", "key")],
    ]
)


def odd_texts(seed: int = 1) -> list[str | None]:
    """Texts with copies, near copies, shared passages, odd white space and letters."""
    draw = random.Random(seed)
    vocabulary = ["the", "Of", "é", "ñandú", "straße", "x1", "a.b", "don't", "日本", "😀", "THE"] + [
        "".join(draw.choice("aeinorst") for _ in range(draw.randint(2, 7))) for _ in range(300)
    ]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    passage, line = some(60), some(8)
    texts: list[str | None] = [None, "", " ", "\n\t \x0b\x0c\r", "one", "one", "Two words", "a b c d", "a b c d e", "😀"]
    for i in range(40):
        body = some(draw.randint(20, 200))
        if i % 3 == 0:
            at = draw.randint(0, len(body))
            body[at:at] = passage[draw.randint(0, 20) : draw.randint(30, 60)]
        if i % 4 == 0:
            body = line + body
        texts.append(draw.choice([" ", "  ", "\n", "\t"]).join(body))
    base = some(150)
    texts.append(" ".join(base))
    texts.append(" ".join(base))
    for i in range(25):  # near copies, some over the threshold, some under it
        changed = list(base)
        for _ in range(1 + i % 8):
            changed[draw.randrange(len(changed))] = draw.choice(vocabulary)
        texts.append(" ".join(changed))
    texts.append(" ".join(some(30) + ["again"] * 200))
    texts.append("ab " * 30_000 + "end")
    texts.append("x" * 20_000)
    return texts


def odd_documents(spark, texts=None):
    texts = odd_texts() if texts is None else texts
    langs, sources = ["en", "de", None, "fr"], ["s2", None, "s10", "é", ""]
    rows = [
        (i, t, langs[i % 4], sources[i % 5], len(t or ""), *["x"] * 8)
        for i, t in enumerate(texts)
    ]
    rows.append((None, "a row without an id " * 10, "en", "s2", 5, *["x"] * 8))
    rows.append(rows[len(rows) // 2])  # a repeated row
    return spark.createDataFrame(rows[::-1], DOCUMENTS), rows


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def linked(sets: dict) -> dict:
    """The smallest id each id is linked with, straight or over others."""
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: find(i) for i in sets}


def without_repeats(rows, window=20):
    """(n_words, n_removed, kept) of (doc_id, text) rows; null ids come last."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first: dict[tuple, tuple] = {}
    held = {}
    for i in order:
        words = WORD.findall(rows[i][1] or "")
        held[i] = words
        place = (rows[i][0] is None, rows[i][0] or 0)
        for at in range(len(words) - window + 1):
            gram = tuple(words[at : at + window])
            first[gram] = min(first.get(gram, (place, at)), (place, at))
    made = []
    for i in range(len(rows)):
        words, place = held[i], (rows[i][0] is None, rows[i][0] or 0)
        keep = [True] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < (place, at):
                keep[at : at + window] = [False] * window
        kept = " ".join(w for w, k in zip(words, keep) if k)
        made.append((len(words), len(words) - sum(keep), kept))
    return made


def key(value):
    """Sorts rows with nulls."""
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in value)
