import numpy as np
import pyarrow as pa

from strata.llm.tokens import Words, pack, slices, sliding_min, unpack
from tests.llm.cases import ALNUM, LOWER, WORD, odd_texts


def found(words, i):
    data = words.data.tobytes()
    return [data[a:b].decode() for a, b in zip(words.start[words.doc == i], words.end[words.doc == i])]


def test_words_are_those_of_the_pattern():
    texts = odd_texts()
    words, lower = Words(pa.array(texts)), Words(pa.array(texts), "alnum", lower=True)
    for i, text in enumerate(texts):
        assert found(words, i) == WORD.findall(text or "")
        assert found(lower, i) == ALNUM.findall((text or "").translate(LOWER))
    assert words.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]


def test_equal_words_and_windows_have_equal_hashes():
    words = Words(pa.array(["a bb a bb c", "bb a bb", None]))
    hashes = words.hashes()
    said = [w for i in range(3) for w in found(words, i)]
    assert {(x, h) for x, h in zip(said, hashes.tolist())} == {(x, hashes[said.index(x)]) for x in said}
    at, grams = words.windows(hashes, 3)
    assert at.tolist() == [0, 1, 2, 5] and grams[1] == grams[3] and len(set(grams.tolist())) == 3


def test_spaced_words():
    data, start, end = Words(pa.array(["  one\ttwo", "", "three \n"])).spaced()
    assert data.tobytes() == b"one two three " and start.tolist() == [0, 4, 8] and end.tolist() == [3, 7, 13]


def test_packing_and_sliding():
    values = np.arange(10, dtype=np.uint64)
    assert [x.tolist() if hasattr(x, "tolist") else x for x in unpack(pack(values, b"ab"), np.uint64, None)] == [list(range(10)), b"ab"]
    draw = np.random.default_rng(1).integers(0, 100, 50)
    for size in (1, 2, 3, 7, 17):
        assert sliding_min(draw, size).tolist() == [min(draw[i : i + size]) for i in range(50 - size + 1)]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * 10] * 7 + [None, "", "c" * 100])], ["text"])
    parts = list(slices([batch], limit=45))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(p.num_rows for p in parts[:3]) == 2
