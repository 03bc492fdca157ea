"""Tokens of two vocabularies against comparing every pair of tokens."""

import collections
import random

import numpy as np
import pytest

from strata.llm import alignment
from strata.llm.alignment import BYTE_LEVEL, PIECES, Block, ByteLevel, PieceModel, aligned, tokenised
from tests.llm.cases import digest, no_documents, odd_documents, odd_texts


def read():
    with open(BYTE_LEVEL, encoding="utf-8") as lines:
        a = ByteLevel(lines.read())
    with open(PIECES, "rb") as lines:
        return a, PieceModel(lines.read())


A, B = read()


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


FILE_A, FILE_B = encoders()


def plain_groups(text):
    """[(ids of A, ids of B)] of each group, by walking over both sides."""
    if not text:
        return []
    character = alignment.byte_characters()
    encoded = FILE_A.encode(" " + text, add_special_tokens=False)
    of_a = [(i, bytes(character[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens)]
    of_b = []
    for i in FILE_B.encode(text):
        piece = FILE_B.id_to_piece(i)
        of_b.append((i, bytes([int(piece[3:5], 16)]) if FILE_B.is_byte(i) else piece.replace("▁", " ").encode()))
    wanted = (" " + text).encode()
    if b"".join(t for _, t in of_a) != wanted or b"".join(t for _, t in of_b) != wanted:
        return []
    groups, here, i, j, at_a, at_b = [], ([], []), 0, 0, 0, 0
    while i < len(of_a) or j < len(of_b):
        if at_a <= at_b:
            here[0].append(of_a[i][0])
            at_a, i = at_a + len(of_a[i][1]), i + 1
        else:
            here[1].append(of_b[j][0])
            at_b, j = at_b + len(of_b[j][1]), j + 1
        if at_a == at_b:
            groups.append(here)
            here = ([], [])
    return groups


def plain(rows):
    """What the operator returns for (doc_id, text) rows, link by link."""
    groups = [plain_groups(text) for _, text in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    count = collections.Counter(pair for pairs in links for pair in set(pairs))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    said = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g) for g in groups]
    found = [
        (
            doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(pairs),
            sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), digest(s) if g else "",
        )
        for (doc_id, _), g, pairs, s in zip(rows, groups, links, said)
    ]
    return sorted(found, key=repr), sorted((x, y, n, n == best[x]) for (x, y), n in count.items())


STRANGE = [
    "</s> <s> <unk> <|endoftext|> <0x41>", "a▁b", "▁", "  two  spaces ", "\t\ttabs\r\n\n  x", " ", "   ", "\x00nul\x00", "  nbsp　wide",
    "é é ﬁ Å", "日本語のテキスト です", "🙂🙃 👩‍👩‍👧‍👦 ok", "١٢٣ ४५", "don't WE'LL it's I'd", "a" * 500, "ab1" * 300, "'" * 50, "กำ ก", "﻿bom", "12345 67,890.12",
    "x " * 400, " " * 300 + "y", "naïve façade — “quoted” …", "https://a.b/c?d=e&f=%20", "​‍", "𝒳𝒴 𐍈", "def f(x):\n    return x  # no\n", "\u0085next line",
]


@pytest.mark.parametrize("block", [1, 20_000, alignment.BLOCK_BYTES])
def test_links_are_those_of_all_pairs_of_tokens(spark, block):
    frame, rows = odd_documents(spark, odd_texts() + STRANGE + STRANGE[:3])
    documents, pairs = aligned(frame.repartition(3), block_bytes=block)
    wanted, wanted_pairs = plain([row[:2] for row in rows])
    assert sorted(map(tuple, documents.collect()), key=repr) == wanted
    assert sorted(map(tuple, pairs.collect())) == wanted_pairs


def test_no_documents(spark):
    documents, pairs = aligned(no_documents(spark))
    assert documents.collect() == [] and pairs.collect() == []
    documents, pairs = aligned(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"))
    assert sorted(map(tuple, documents.collect()), key=repr) == sorted([(1, *[0] * 6, ""), (None, *[0] * 6, "")], key=repr)
    assert pairs.collect() == []


def test_both_encoders_of_a_are_one():
    draw = random.Random(11)
    letters = [*map(chr, range(0x250)), *"日本語🙂́‍ 　  '’1२٣"]
    texts = STRANGE + ["".join(draw.choice(letters) for _ in range(200)) for _ in range(300)]
    assert A._ranks is not None
    for text in texts:
        assert A._ranks.encode_ordinary(text) == FILE_A.encode(text, add_special_tokens=False).ids
    long_space = "a" + " " * 400_000 + "b" + "\n" * 9_000
    assert A.encode(long_space) == FILE_A.encode(long_space, add_special_tokens=False).ids


def test_windows_are_worked_out_once(monkeypatch):
    made = []
    real = alignment.Aligned
    monkeypatch.setattr(alignment, "Aligned", lambda a, b, cut, chosen, *rest: made.append(len(chosen)) or real(a, b, cut, chosen, *rest))
    block = Block(A, B)
    ids = alignment.pa.array([1, 2], alignment.pa.int64())
    block.add(ids, ["the cat and the dog and the cat", "the dog"])
    block.add(ids, ["the cat", "a dog"])
    assert made == [4, 1]  # the, cat, and, dog; a


def test_windows_whose_hashes_collide_are_told_apart(monkeypatch):
    a, b = tokenised(["one two three one", "two one"], A, B)
    cut = alignment.Cut(a, b)
    wanted = [0, 1, 2, 0, 1, 0]
    assert cut.different(a, b)[1].tolist() == wanted
    monkeypatch.setattr(alignment, "mix", lambda x: np.zeros_like(x))
    monkeypatch.setattr(alignment, "spans", lambda sums, start, end: np.zeros(len(start), dtype=np.uint64))
    one, kind = cut.different(a, b)
    assert kind.tolist() == wanted and one.tolist() == [0, 1, 2]
