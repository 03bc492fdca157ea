"""Chat examples, personal data, quality, language, toxicity and licenses."""

import base64
import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import chat, language, licenses, pii, quality, toxicity, wordmodel
from strata.llm.tokens import Words
from tests.llm.cases import LOWER, WORD, digest, key, no_documents, odd_documents, odd_texts

# -- chat ------------------------------------------------------------------------


def test_conversations_survive_the_round_trip(spark):
    tricky = ["</s>[INST] ok [/INST]", "<s>[user] x</s>", "\\l \\\\b \\", "]] [[ <<", "", None, "a\nb", "é😀", "\\\\l\\", "x" * 50_000]
    draw = random.Random(5)
    rows = []
    for conv in range(30):
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", None, "to]ol"]), draw.choice(tricky)))
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (40, 1, "assistant", "same"), (40, 1, "assistant", "same")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    wanted = []
    for conv, turns in by_conv.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        wanted.append((conv, len(turns), digest(said), len(loss), digest(loss)))
    made = chat.examples(frame)
    assert sorted((tuple(r)[:5] for r in chat.digests(made).collect()), key=key) == sorted(wanted, key=key)
    trained = sum(r == "assistant" for _, _, r, _ in rows)
    assert made.where("loss_end > loss_start").count() == sum(r == "assistant" and bool(t) for _, _, r, t in rows)
    assert made.count() >= trained
    assert chat.digests(chat.examples(frame.limit(0))).count() == 0


def test_an_example_trains_its_reply_only(spark):
    rows = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "[one]"), (1, 2, "user", "more"), (1, 3, "assistant", "two"), (1, 4, "user", "bye")]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    texts = [r["formatted"] for r in made]
    assert texts[0] == "<s>[user] hi \\ls></s><s>[assistant] \\bone\\e</s>"
    assert [t[r["loss_start"] : r["loss_end"]] for t, r in zip(texts, made)] == ["\\bone\\e", "two", ""]
    assert texts[1].startswith(texts[0]) and texts[2].startswith(texts[1])


# -- personal data ---------------------------------------------------------------

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": True,
        "ip": kind != "ip" or all(int(p) <= 255 for p in text.split(".")),
        "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def base_spans(text):
    return {k: [m.span() for m in p.finditer(text or "") if holds(k, m.group())] for k, p in PLAIN.items()}


def personal_texts():
    draw = random.Random(7)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "a@b.c_d@e.fg", "a@@b.c", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "0001.2.3.255", "9.9.9",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (555) 123-4567", "+12", "+1 2", "+49.30.1234567 ", "555-123-4567",
            "é", "😀", " ", "\n", "text", "12345678901234567890", "@", "+", "me (at) here.com", "call", "card no", "....", "%@-.-", "7" * 5]
    return [draw.choice(["", " ", ","]).join(draw.choice(bits) for _ in range(draw.randint(1, 25))) for _ in range(300)]


def test_personal_data(spark):
    texts = [*personal_texts(), *odd_texts(), "1 " * 20_000, "a" * 50_000, "5" * 30_000, "a@b.c " * 3000, "1.2" * 10_000]
    frame, rows = odd_documents(spark, texts)
    found = sorted(((r[0], *[[(s["start"], s["end"]) for s in r[k] if s["base"]] for k in pii.KINDS]) for r in pii.spans(frame).collect()), key=repr)
    plain = [(r[0], base_spans(r[1])) for r in rows]
    assert found == sorted(((i, *[s[k] for k in pii.KINDS]) for i, s in plain), key=repr)
    assert pii.spans(no_documents(spark)).count() == 0


def test_redaction_covers_what_was_found(spark):
    frame, rows = odd_documents(spark, [*personal_texts(), None, ""])
    hidden = pii.redacted(frame)
    assert hidden.columns == frame.columns and hidden.count() == len(rows)
    # base spans only: kind after kind, each in what the one before left
    def plain(text):
        for kind, pattern in PLAIN.items():
            text = pattern.sub(lambda m, k=kind: f"[{k.upper()}]" if holds(k, m.group()) else m.group(), text)
        return text

    only_base = sorted(str(r["text"]) for r in pii.redacted(frame, threshold=2.0).collect())
    assert only_base == sorted("None" if r[1] is None else plain(r[1]) for r in rows)
    clean, kept = odd_documents(spark, ["no data here", "one two, 3 four"] * 10)
    assert sorted(r["text"] for r in pii.redacted(clean).collect()) == sorted(r[1] for r in kept)


def test_labelers_that_agree_are_believed():
    pattern = lambda *votes: sum(v * 3**i for i, v in enumerate(votes))
    counts = [(pattern(1, 1, 1, 1), 80), (pattern(0, 1, 1, 1), 4), (pattern(0, 0, 0, 0), 60), (pattern(0, 1, 2, 0), 30)]
    _, chances, belief = pii.reliabilities(counts)
    assert belief[pattern(0, 1, 1, 1)] > belief[pattern(0, 1, 2, 0)] and belief[pattern(0, 0, 0, 0)] < 0.05
    assert chances[0][1][1] > 0.8 and all(abs(sum(row) - 1) < 1e-9 for two in chances for row in two)


# -- quality ---------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words, seen, repeated = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)} if len(grams) < 3000 else None
    if covered is None:
        twice = {g for g in set(grams)} - {g for g, n in itertools.groupby(sorted(grams)) if len(list(n)) == 1}
        covered = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def test_base_counts():
    texts = [*odd_texts(), "a\na\n a\n\n\na", "b b b b", "x|<>#", "\na\n", "a b c a b c", "#\n#"]
    counts = quality.base_counts(pa.array(texts))
    got = list(zip(*[counts[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]))
    assert got == [plain_counts(t) for t in texts]


def test_the_model_is_a_distribution():
    text = np.frombuffer(("the cat sat on the mat and then the rat " * 20 + "é ñ").encode(), dtype=np.uint8)
    grams, counts = np.unique(quality._codes(text), return_counts=True)
    model = quality.KneserNey(grams, counts)
    for context in (b"th", b"e ", b"zz", b"\xc3\xa9"):
        codes = (np.uint32(context[0] << 16 | context[1] << 8) + np.arange(256)).astype(np.uint32)
        assert math.isclose(np.exp(model.log(codes)).sum(), 1, abs_tol=0.02)
    assert model.log(np.array([0x746865], dtype=np.uint32)) > model.log(np.array([0x746878], dtype=np.uint32))


@pytest.mark.parametrize("block", [1 << 24, 10])
def test_bands_reject_what_reads_unlike_its_language(spark, block):
    draw = random.Random(3)
    words = ["".join(draw.choice("aeionrst") for _ in range(draw.randint(2, 6))) for _ in range(200)]
    texts = [" ".join(draw.choice(words) for _ in range(200)) for _ in range(300)]
    signs = [chr(c) for c in range(33, 127)]
    junk = [" ".join("".join(draw.choice(signs) for _ in range(4)) for _ in range(60)) for _ in range(3)]
    short = ["too short", None, "", "again " * 100]
    rows = [(i, t, ["en", None][i % 2]) for i, t in enumerate(texts + junk + short)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    measured = quality.scored(frame, block_grams=block)
    kept = {r["doc_id"] for r in quality.judged(measured, quality.bands(measured)).where("__kept").collect()}
    assert len(kept) >= 297 and not kept & set(range(300, 307))
    left = quality.keep_good(frame)
    assert left.columns == frame.columns and {r["doc_id"] for r in left.collect()} == kept


def plain_word_scores(rows):
    """Mean negative log probability per word under the other rows, by dictionaries."""
    said = [(lang or "", WORD.findall((text or "").translate(LOWER))) for _, text, lang in rows]
    told = {}

    def counts(skip):
        found = collections.defaultdict(collections.Counter)
        for i, (lang, words) in enumerate(said):
            if i != skip:
                for gram in zip(["<", "<", *words], ["<", *words], words):
                    found[lang][gram] += 1
        return found

    def orders(grams):
        pairs = collections.Counter(g[1:] for g in grams)
        return [collections.Counter(g[1:] for g in pairs), pairs, grams]

    whole = {lang: orders(grams) for lang, grams in counts(None).items()}
    for i, (lang, words) in enumerate(said):
        if not words:
            continue
        off = [wordmodel._discounts([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]) for c in whole[lang]]
        known = orders(counts(i)[lang])

        def chance(gram, order):
            lower = chance(gram[1:], order - 1) if order else 1 / (len(whole[lang][0]) + 1)
            met = [n for g, n in known[order].items() if g[:-1] == gram[:-1] and n]
            if not met:
                return lower
            n = known[order][gram]
            cut = off[order][min(n, 3) - 1] if n else 0
            return (n - cut + sum(off[order][min(m, 3) - 1] for m in met) * lower) / sum(met)

        logs = [math.log(chance(g, 2)) for g in zip(["<", "<", *words], ["<", *words], words)]
        told[i] = -sum(logs) / len(words)
    return told


@pytest.mark.parametrize("flush", [1 << 20, 60])
def test_word_scores_are_those_under_the_other_documents(spark, monkeypatch, flush):
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["a", "B", "b", "cé", "d.", "e"]) for _ in range(draw.randint(1, 25))) for _ in range(24)]
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate([*texts, texts[0], texts[0].upper(), None, "", "a"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    monkeypatch.setattr(wordmodel, "FLUSH_WORDS", flush)
    measured = quality.scored(frame)
    got = {r["doc_id"]: r["__measured"]["word_score"] for r in measured.collect()}
    wanted = plain_word_scores(rows)
    assert len(got) == len(rows)
    assert all((got[i] is None) == (i not in wanted) for i in got)
    assert all(math.isclose(got[i], wanted[i], abs_tol=1e-8) for i in wanted)


def test_word_salad_and_odd_words_are_rejected(spark):
    """Both are spelled like the other documents and have their letters."""
    draw = random.Random(5)
    words = ["".join(draw.choice("aeionrst") for _ in range(draw.randint(3, 6))) for _ in range(400)]
    follows = {w: draw.sample(words, 8) for w in words}

    def text():
        said = [draw.choice(words)]
        while len(said) < 200:
            said.append(draw.choice(follows[said[-1]]))
        return said

    good = [" ".join(text()) for _ in range(200)]
    salad = [" ".join(draw.sample(said, len(said))) for said in (text() for _ in range(3))]
    odd = [" ".join("".join(draw.sample(w, len(w))) + w[0] for w in text()) for _ in range(3)]
    rows = [(i, t, "en") for i, t in enumerate([*good, *salad, *odd])]
    kept = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(200))


def test_quality_of_odd_tables(spark):
    frame, rows = odd_documents(spark)
    measured = quality.scored(frame)
    assert measured.count() == len(rows)
    empty = quality.scored(no_documents(spark))
    assert quality.judged(empty, quality.bands(empty)).count() == 0


# -- language --------------------------------------------------------------------


def test_the_forward_sum_counts_every_segmentation():
    pieces = language.Pieces([b" ", b"a", b"b", b" a", b"ab", b"ba", b"bab"], [0, 1, 2, 3, 4, 5, 6])
    chance = np.linspace(0.05, 0.2, 7)
    table = dict(zip([b" ", b"a", b"b", b" a", b"ab", b"ba", b"bab"], chance))

    def total(word):
        return 1.0 if not word else sum(p * total(word[len(s) :]) for s, p in table.items() if word.startswith(s))

    def uses(word):
        if not word:
            return [({}, 1.0)]
        return [({**c, s: c.get(s, 0) + 1}, p * q) for s, p in table.items() if word.startswith(s) for c, q in uses(word[len(s) :])]

    said = ["abab", "b", "babab", "aaa"]
    words = Words(pa.array([" ".join(said)]))
    lattice = language.Lattice(pieces, words.data, words.start, words.end)
    scaled = language._scaled(pieces, chance)
    assert np.allclose(language.forward(lattice, scaled[:, None])[:, 0], [math.log(total(b" " + w.encode())) for w in said])
    weights = np.array([[1.0], [2.0], [0.5], [3.0]])
    wanted = np.zeros(7)
    for word, (n,) in zip(said, weights):
        ways = uses(b" " + word.encode())
        for counts, p in ways:
            for piece, times in counts.items():
                wanted[list(table).index(piece)] += n * times * p / sum(q for _, q in ways)
    assert np.allclose(language.expected(lattice, scaled, weights)[:, 0], wanted)


def test_pieces_are_found_by_hash():
    pieces = language.read_pieces()
    assert 256 < len(pieces) < 60_000
    spelled = [b"the", b" the", b"zzzzqq"]
    keys = np.array([pieces._hash(p) for p in spelled], dtype=np.uint64)
    at = pieces.find(keys)
    assert pieces.length[at[:2]].tolist() == [3, 4] and at[2] == len(pieces)


def test_no_piece_of_a_word_is_left_out():
    pieces = language.read_pieces()
    held = set()
    with open(language.VOCABULARY, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            if len(piece) > 8 and re.fullmatch(rb" ?[a-z\x80-\xff]+", piece):
                held.add(piece)
    keys = np.array([pieces._hash(p) for p in sorted(held)], dtype=np.uint64)
    assert len(held) > 5000 and (pieces.length[pieces.find(keys)] == [len(p) for p in sorted(held)]).all()
    long = language.Pieces([b" ", b"a", b"b", b" " + b"ab" * 9], [0, 1, 2, 3])
    words = Words(pa.array(["ab" * 9]))
    lattice = language.Lattice(long, words.data, words.start, words.end)
    got = language.forward(lattice, language._scaled(long, np.array([0.1, 0.1, 0.1, 0.7]))[:, None])[0, 0]
    assert math.isclose(got, math.log(0.7 + 0.1**19))


def test_the_probabilities_have_settled(spark):
    rows = [("the cat and the other cat are there then", "en"), ("die katze und die andere katze sind da", "de")] * 20
    labelled, pieces = spark.createDataFrame(rows, "text string, lang string"), language.read_pieces()
    words = language.word_counts(labelled)
    assert {(r["lang"], r["word"]): r["n"] for r in words.collect()}["en", "cat"] == 40
    names, learned = language.learn(labelled, pieces)
    assert names == ["de", "en"] and np.allclose(learned.sum(axis=0), 1)
    again = language.improved(words, pieces, names, learned)
    assert np.abs(again - learned).sum(axis=0).max() <= language.SETTLED


def test_languages_of_held_out_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language.identified(frame).join(frame.withColumnRenamed("lang", "real"), "doc_id")
    rows = found.where(language.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 30 and sum(r["lang_pred"] == r["real"] for r in rows) >= 0.95 * len(rows)


def test_language_of_odd_rows(spark):
    frame, rows = odd_documents(spark, [*odd_texts(), "123 !!", "a" * 3000])
    found = language.identified(frame)
    got = {(r["doc_id"], r["lang_pred"]) for r in found.collect()}
    assert found.count() == len(rows) and all(0 <= r["score"] <= 1 for r in found.collect())
    lettered = {r[0]: bool(re.search(r"[^\W\d_]", r[1] or "")) for r in rows}
    assert all((said != "und") == lettered[i] for i, said in got)
    assert {r["lang_pred"] for r in language.identified(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identified(no_documents(spark)).count() == 0


def test_labels_of_held_out_documents_do_not_matter(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang")
    wrong = frame.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    one, other = (sorted(map(tuple, language.identified(f).collect())) for f in (frame, wrong))
    assert one == other and zlib.crc32(b"0") % 3 != 1


# -- toxicity --------------------------------------------------------------------


def test_viterbi_finds_the_cheapest_reading():
    draw = np.random.default_rng(2)
    channel = toxicity.Channel(np.log(draw.dirichlet(np.ones(28), size=(28, 28))))

    def cost(choice):
        x = y = channel.gap
        total = sum(price for _, price in choice)
        for char in "".join(text for text, _ in choice):
            z = channel.number.get(char, channel.other)
            total -= channel.cube[x][y][z]
            x, y = y, z
        return total - channel.cube[x][y][channel.gap]

    for token in ("1d10t", "sss0", "a.b!!", "bb1", "é3ss"):
        ways = list(itertools.product(*channel._choices(token)))
        best = min(ways, key=cost)
        read = channel.restore(token)
        assert math.isclose(min(cost(w) for w in ways if "".join(t for t, _ in w) == read), cost(best))


def test_disguised_tokens():
    texts = ["an 1d10t is", "so looong", "s t u p i d, yes", "plain words 123 a b", "", "l.o.s.e.r"]
    assert toxicity.disguised(pa.array(texts)) == [["1d10t"], ["looong"], ["stupid,"], [], [], ["l.o.s.e.r"]]


def test_toxic_documents_are_found_also_when_disguised(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    hidden = [(10_000, "Than the 1d10t of the and it is w0rthless and pathetiiiic."), (10_001, "Than the the of the and it is and ".strip())]
    more = documents.union(spark.createDataFrame(hidden, "doc_id long, text string"))
    found = toxicity.toxicity(more, labels).join(labels, "doc_id", "left").collect()
    assert all(0 <= r["score"] <= 1 for r in found)
    score = {r["doc_id"]: r["score"] for r in found}
    assert score[10_000] > toxicity.THRESHOLD > score[10_001]
    known = [r for r in found if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    clean = [r["score"] for r in known if r["toxic"] == 0]
    assert sum(s < toxicity.THRESHOLD for s in clean) >= 0.97 * len(clean)
    toxic = [r["score"] for r in known if r["toxic"] == 1]
    assert np.mean(toxic) > np.mean(clean) + 0.4


def test_toxicity_of_odd_rows(spark):
    frame, rows = odd_documents(spark)
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1), (7, 0), (12, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(frame, labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in toxicity.toxicity(frame, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(no_documents(spark), labels).count() == 0


# -- licenses --------------------------------------------------------------------


def test_alignment_matches_in_order():
    draw = random.Random(1)
    for _ in range(200):
        left = [draw.choice("abcdefghij") + draw.choice("xyz") for _ in range(draw.randint(0, 30))]
        right = [w for w in left if draw.random() > 0.2] + [draw.choice("kl") for _ in range(draw.randint(0, 5))]
        pairs = licenses.aligned(left, right)
        assert all(left[i] == right[j] for i, j in pairs)
        assert all(a < b and c < d for (a, c), (b, d) in itertools.pairwise(pairs))
        unique = [w for w in left if left.count(w) == 1 and right.count(w) == 1]
        assert len(pairs) >= len(unique) * 0.5
    assert licenses.aligned(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]
    assert licenses._increasing([(0, 5), (1, 2), (2, 3), (3, 1), (4, 4)]) == [(1, 2), (2, 3), (4, 4)]


def test_notices(spark):
    mit = licenses.TEMPLATES["MIT-notice"]
    damaged = " ".join(w for i, w in enumerate(mit.split()) if i % 12 != 5)
    texts = ["before " * 50 + "Released under the MIT License. And Licensed under CC BY-NC 4.0.", mit, damaged, "mit license", None, "",
             "Released under the MIT License. " * 3, "All rights reserved", "the rights of all are reserved"]
    frame, rows = odd_documents(spark, texts)
    found = {r["doc_id"]: [n["license"] for n in r["notices"]] for r in licenses.scanned(frame).collect()}
    assert [found[i] for i in range(9)] == [["MIT", "CC-BY-NC-4.0"], ["MIT-notice"], ["MIT-notice"], [], [], [], ["MIT"] * 3, ["All-rights-reserved"], []]
    assert licenses.scanned(no_documents(spark)).count() == 0


def longest(left, right):
    row = [0] * (len(right) + 1)
    for a in left:
        row, before = [0], row
        for j, b in enumerate(right):
            row.append(before[j] + 1 if a == b else max(before[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_notices_whatever_part_is_damaged(name):
    """Verbatim, without the opening, with other words there, and with holes: found if
    some region of the text reaches the coverage in full alignment, and only then."""
    known = licenses.Templates(licenses.TEMPLATES, licenses.COVERAGE)
    template = licenses.words_of(licenses.TEMPLATES[name])
    tenth, filler = len(template) // 10, ["zebra"] * 7
    texts = [
        template, template[tenth:], ["other"] * tenth + template[tenth:], template[2 * tenth + 1 :], template[3 * tenth + 1 :],
        [w for i, w in enumerate(template) if i % 9 != 1], template[:tenth] + filler + template[tenth:], template[: len(template) // 2],
    ]
    for words in texts:
        words = filler + words + filler
        most = max(longest(template, words[i : i + 2 * len(template)]) for i in range(len(words)))
        found = [(c, words[a], words[b - 1]) for a, b, n, c in known.notices(" ".join(words)) if n == name]
        assert bool(found) == (most >= licenses.COVERAGE * len(template))
        assert all(abs(c - most / len(template)) < 1e-9 and "zebra" not in ends for c, *ends in found)
    twice = [w for i, w in enumerate(template) if i % 9 != 1 or len(template) < 9] * 2
    assert [n for _, _, n, _ in known.notices(" ".join(twice))] == [name] * 2
