"""Personal data in texts: e-mail addresses, IP addresses, card and phone numbers.

Weak supervision. Each kind's pattern proposes spans; what meets the kind's base
rule always stays. Four labelers vote on every proposal: the base rule itself, a
gazetteer (top-level domains, reserved networks, card issuers, dialling codes),
the words just before it, and its length. Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is; a naive Bayes classifier
of the span's own looks (digits, separators, votes) is then trained on the
resulting probabilities and adds the proposals it believes. What reaches the driver
is a table of vote patterns and looks, whose size does not depend on the data.

Spans are code points, end exclusive. Null texts are empty. Rows are looked at one
by one, so repeated rows give repeated results; other columns are not looked at.
All of it is Spark SQL: a text's places come from what lies between its matches,
and patterns only ever move forward, so long texts take time in proportion.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import load, registered, written

KINDS = ("email", "ip", "card", "phone")

# Fixed values. The first branch of each pattern is the base one, written so that no
# quantifier gives back what it took; the second only proposes.
_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
    rf"|(?<!{_LOCAL}){_LOCAL}++ ?[(\[]at[)\]] ?{_HOST}++(?: ?(?:[(\[]dot[)\]]|\.) ?{_HOST}++)++(?!{_LOCAL}*+@)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"
    r"|(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
TRIGGERS = {"email": r"@|[(\[]at[)\]]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|eu|uk|de|fr|es|it|nl|pl|se|ch|at|be|pt|ru|cn|jp|kr|in|br|mx|ar|ca|us|au|nz|za)$",
    "ip": r"^(?!0+\.|127\.|2[3-5][0-9]\.|22[4-9]\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[0-9]|6)",
    "phone": r"^(\+[1-9]|\(?[2-9])",
}
SPEAKS_FOR = {
    "email": r"(?i)(e-?mail|contact|write|mailto|from|cc)\W*$",
    "ip": r"(?i)\b(ip|host|server|address|client|peer|from)\W*$",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|pay|paid)\b\W*(number|no|nr)?\W*$",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|dial|whatsapp)\b\W*(number|no|nr)?\W*$",
}
SPEAKS_AGAINST = r"(?i)\b(version|release|v|isbn|order|invoice|serial|id|ref|build|sku|section|total|page)\b\W*(number|no|nr)?\W*$"
BEFORE = 30
LABELERS = 4
ABSTAINS = 2
ROUNDS = 50


def _positions(lengths: Column) -> Column:
    """Running sums of an array, by adding it to itself shifted 1, 2, 4, ... places."""
    shifts = F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda d: d < F.size(lengths))

    def add(sums: Column, shift: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0), shift), F.slice(sums, F.lit(1), F.size(sums) - shift))
        return F.zip_with(sums, moved, lambda a, b: a + b)

    return F.aggregate(shifts, lengths, add)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_rule(kind: str, text: Column) -> Column:
    """Whether a match of the kind's pattern is one of the base spans."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "ip":
        return text.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = _digits(text)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.startswith(text, F.lit("+")) & F.length(digits).between(8, 15)


def _votes(kind: str, text: Column, before: Column) -> list[Column]:
    digits = F.length(_digits(text))
    fits = {
        "email": F.length(text) <= 254,
        "ip": ~text.rlike(r"(^|\.)0[0-9]"),
        "card": digits.isin(13, 14, 15, 16, 19),
        "phone": digits.between(7, 15),
    }[kind]
    says = F.when(before.rlike(SPEAKS_FOR[kind]), 1).when(before.rlike(SPEAKS_AGAINST), 0).otherwise(ABSTAINS)
    return [base_rule(kind, text).cast("int"), text.rlike(GAZETTEER[kind]).cast("int"), says, fits.cast("int")]


def _split(text: Column, kind: str) -> tuple[Column, Column]:
    """What lies between a text's matches, and the matches."""
    pattern = PATTERNS[kind]
    seen = text.rlike(TRIGGERS[kind])
    return (
        F.when(seen, F.split(text, pattern, -1)).otherwise(F.array(text)),
        F.when(seen, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(F.array().cast("array<string>")),
    )


def _judged(kind: str, matched: Column, before: Column) -> list[Column]:
    votes = _votes(kind, matched, F.right(before, F.lit(BEFORE)))
    pattern = sum((vote * 3**i for i, vote in enumerate(votes)), F.lit(0))
    separators = sum((F.contains(matched, F.lit(c)).cast("int") * 2**i for i, c in enumerate(" -.(")), F.lit(0))
    return [
        votes[0].cast("boolean").alias("base"),
        pattern.cast("int").alias("votes"),
        F.least(F.length(_digits(matched)), F.lit(31)).alias("digits"),
        separators.alias("separators"),
    ]


def _pair(kind: str):
    def pair(between: Column, matched: Column) -> Column:
        both = F.length(between) + F.length(matched)
        return F.struct(both.alias("both"), F.length(matched).alias("length"), *_judged(kind, matched, between))

    return pair


def proposals(documents: DataFrame) -> DataFrame:
    """doc_id and one array of judged spans per kind; no text."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        between, matches = _split(F.col("text"), kind)
        texts = texts.withColumns({f"{kind}_between": between, f"{kind}_matches": matches})
    for kind in KINDS:
        before = F.slice(f"{kind}_between", F.lit(1), F.size(f"{kind}_matches"))
        texts = texts.withColumn(f"{kind}_pairs", F.zip_with(before, f"{kind}_matches", _pair(kind)))
    for kind in KINDS:
        name = f"{kind}_pairs"
        ends = _positions(F.transform(name, lambda pair: pair["both"]))
        spans = F.zip_with(
            name,
            ends,
            lambda pair, end: F.struct(
                (end - pair["length"]).alias("start"), end.alias("end"), *[pair[c].alias(c) for c in _LOOKS]
            ),
        )
        texts = texts.withColumn(kind, spans)
    return texts.select("doc_id", *KINDS)


_LOOKS = ("base", "votes", "digits", "separators")


def _vote(votes: int, labeler: int) -> int:
    return votes // 3**labeler % 3


def reliabilities(counts: list[tuple[int, float]], rounds: int = ROUNDS) -> tuple[float, list, dict[int, float]]:
    """Expectation-maximisation over (vote pattern, count): the share of personal
    data, each labeler's chance of each vote given yes and no, and the probability
    of yes for each pattern. Spans of the base rule are known to be personal data;
    others begin as doubtful, the more so the fewer labelers speak for them."""

    def doubt(votes: int) -> float:
        cast = [v for v in (_vote(votes, i) for i in range(1, LABELERS)) if v != ABSTAINS]
        return 0.2 * (sum(cast) + 0.5) / (len(cast) + 1)

    belief = {votes: 1.0 if _vote(votes, 0) == 1 else doubt(votes) for votes, _ in counts}
    prior, chances = 0.5, []
    for _ in range(rounds):
        total = sum(n for _, n in counts)
        yes = sum(n * belief[v] for v, n in counts)
        prior = (yes + 1) / (total + 2)
        chances = []
        for labeler in range(LABELERS):
            given = [[1.0] * 3, [1.0] * 3]
            # a labeler is taken to be right rather than wrong until data say otherwise
            given[1][1] = given[0][0] = 3.0
            for votes, n in counts:
                for answer, weight in ((1, belief[votes]), (0, 1 - belief[votes])):
                    given[answer][_vote(votes, labeler)] += n * weight
            chances.append([[x / sum(row) for x in row] for row in given])
        for votes in (votes for votes, _ in counts if _vote(votes, 0) != 1):
            odds = math.log(prior / (1 - prior))
            for labeler in range(LABELERS):
                vote = _vote(votes, labeler)
                odds += math.log(chances[labeler][1][vote] / chances[labeler][0][vote])
            belief[votes] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
    return prior, chances, belief


def train(found: DataFrame) -> dict[str, dict[tuple[int, int, int], float]]:
    """For each kind, the probability that a span with these (votes, digits,
    separators) is personal data."""
    looks = [
        (kind, *row)
        for kind in KINDS
        for row in found.select(F.explode(kind).alias("s")).groupBy("s.votes", "s.digits", "s.separators").count().collect()
    ]
    believed: dict[str, dict[tuple[int, int, int], float]] = {}
    for kind in KINDS:
        rows = sorted(row[1:] for row in looks if row[0] == kind)
        if not rows:
            continue
        patterns: dict[int, float] = {}
        for votes, _, _, n in rows:
            patterns[votes] = patterns.get(votes, 0) + n
        prior, _, belief = reliabilities(sorted(patterns.items()))
        tables: list[dict] = [{} for _ in range(3)]
        sums = [2.0, 2.0]
        for *values, n in rows:
            yes = belief[values[0]]
            sums[1] += n * yes
            sums[0] += n * (1 - yes)
            for table, value in zip(tables, values):
                cell = table.setdefault(value, [1.0, 1.0])
                cell[1] += n * yes
                cell[0] += n * (1 - yes)
        believed[kind] = {}
        for *values, _ in rows:
            odds = math.log(sums[1] / sums[0])
            for table, value in zip(tables, values):
                no, yes = table[value]
                odds += math.log(yes / sums[1]) - math.log(no / sums[0])
            believed[kind][tuple(values)] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
    return believed


def _believed(kind: str, span, model: Mapping[str, Mapping], threshold: float) -> Column:
    """Base spans, and those whose looks the classifier believes."""
    yes = [v + 81 * (d + 32 * s) for (v, d, s), p in sorted(model.get(kind, {}).items()) if p >= threshold]
    looks = span("votes") + 81 * (span("digits") + 32 * span("separators"))
    return span("base") | looks.isin(yes) if yes else span("base")


def _kept(kind: str, model: Mapping[str, Mapping], threshold: float):
    return lambda span: _believed(kind, span.__getitem__, model, threshold)


def spans(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and for each kind an array of (start, end, base), in order of start."""
    found = written(proposals(documents), "spans")
    model = train(found)
    return found.select(
        "doc_id",
        *[
            F.transform(
                F.filter(kind, _kept(kind, model, threshold)),
                lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")),
            ).alias(kind)
            for kind in KINDS
        ],
    )


def redacted(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with every span replaced by its kind, such as ``[EMAIL]``, kind
    after kind; all other columns stay. A null text stays null."""
    model = train(written(proposals(documents), "spans"))
    rows = documents
    names = ["__between", "__matches"]
    for kind in KINDS:
        between, matches = _split(F.coalesce("text", F.lit("")), kind)
        rows = rows.withColumns(dict(zip(names, (between, matches))))

        def said(matched: Column, before: Column, kind: str = kind) -> Column:
            looks = dict(zip(_LOOKS, _judged(kind, matched, before)))
            return F.when(_believed(kind, looks.__getitem__, model, threshold), f"[{kind.upper()}]").otherwise(matched)

        pieces = F.zip_with(
            "__between", "__matches", lambda b, m: F.concat(b, F.when(m.isNull(), "").otherwise(said(m, b)))
        )
        text = F.when(F.size("__matches") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
        rows = rows.withColumn("text", text).drop(*names)
    return rows


def _listed(kind: str, keep=None) -> Column:
    chosen = F.filter(kind, keep) if keep else F.col(kind)
    return F.transform(
        chosen, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
    )


def _joined(keep=None) -> Column:
    return F.array_join(F.concat(*[_listed(kind, keep) for kind in KINDS]), ",")


@registered("op2_pii")
def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = spans(load(spark, sf_dir, "documents"))
    is_base = lambda s: s["base"]
    return found.select(
        "doc_id",
        *[F.size(F.filter(kind, is_base)).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(_joined(is_base), 256).alias("base_sha256"),
        _joined().alias("spans"),
    )
