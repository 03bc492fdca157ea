"""Conversations as training examples, one for each assistant turn: all turns
before it are context, and only that reply is under the loss mask.

A turn is written ``<s>[role] text</s>``. Inside roles and texts ``\\``, ``<``, ``[``
and ``]`` are written ``\\\\``, ``\\l``, ``\\b`` and ``\\e``, so no control string can
come from a text, and reading back is exact. Turns after the last reply (and
conversations without one) end up in a last example that trains nothing.

Rows are ordered by turn, then role, then text; null turns come first. Null
roles and texts count as empty, a null conv_id is a conversation of its own,
repeated rows are turns of their own, and other columns are not looked at. A
conversation is one training text, so it is put together in one row; its
examples are as long, taken together, as the method makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.registry import load, registered

BEGIN, MIDDLE, END = "<s>[", "] ", "</s>"
TRAINED = "assistant"
ESCAPES = (("<", "\\l"), ("[", "\\b"), ("]", "\\e"))  # after the backslash itself


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    def restore(part: Column) -> Column:
        for plain, written in ESCAPES:
            part = F.replace(part, F.lit(written), F.lit(plain))
        return part

    # every run of backslashes starts an escape, so pairs are found from the left
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), restore), "\\")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example and n_examples (from 1), formatted, loss_start, loss_end
    (code points of ``formatted``, end exclusive; equal where nothing is trained)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = whole.select(
        "conv_id",
        F.transform("turns", lambda t: escape(t["text"])).alias("texts"),
        F.transform("turns", lambda t: F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(MIDDLE))).alias("heads"),
        F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["role"] == TRAINED).alias("replies"),
    )
    pieces = pieces.select(
        "*",
        F.zip_with("heads", "texts", lambda h, t: F.concat(h, t, F.lit(END))).alias("written"),
        # the turns after the last reply, as an example that ends with no reply
        F.when(F.coalesce(F.array_max("replies"), F.lit(0)) == F.size("texts"), F.col("replies"))
        .otherwise(F.concat("replies", F.array((F.size("texts") + 1).cast("int"))))
        .alias("ends"),
    )
    each = pieces.select(
        "conv_id", "heads", "texts", "written", F.size("ends").alias("n_examples"), F.posexplode("ends").alias("example", "at")
    )
    parts = each.select(
        "conv_id",
        (F.col("example") + 1).alias("example"),
        "n_examples",
        F.concat(
            F.array_join(F.slice("written", F.lit(1), F.col("at") - 1), ""),
            F.coalesce(F.get("heads", F.col("at") - 1), F.lit("")),
        ).alias("context"),
        F.get("texts", F.col("at") - 1).alias("reply"),
    )
    return parts.select(
        "conv_id",
        "example",
        "n_examples",
        F.concat("context", F.coalesce(F.concat("reply", F.lit(END)), F.lit(""))).alias("formatted"),
        F.length("context").alias("loss_start"),
        (F.length("context") + F.coalesce(F.length("reply"), F.lit(0))).alias("loss_end"),
    )


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted example."""
    ended = F.filter(F.split(formatted, END, -1), lambda piece: piece != "")

    def parse(piece: Column) -> Column:
        halves = F.split(F.substr(piece, F.lit(len(BEGIN) + 1)), r"\] ", 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(ended, parse)


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, what its formatted examples say when read back."""
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    seen = made.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("example") == F.col("n_examples"), F.col("formatted")).alias("last"),
        F.when(F.col("loss_end") > F.col("loss_start"), loss).otherwise("").alias("loss"),
    )
    held = seen.groupBy("conv_id").agg(
        F.max("last").alias("last"),
        F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
    )
    held = held.select(
        "*",
        read_back(F.col("last")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return held.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


_SAID = "</s>[INST] ok [/INST]"


# A written turn has 10 characters around its role and text, each escape one more.
_LENGTH = "length({0}) + length(regexp_replace({0}, '[^\\\\<\\[\\]]', '', 'g'))"


@registered(
    "op9_chat_formatting",
    f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, turn, role, '{_SAID}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
t AS (SELECT *, row_number() OVER o AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
        sum(10 + {_LENGTH.format("role")} + {_LENGTH.format("text")}) OVER (o ROWS UNBOUNDED PRECEDING) AS upto
    FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR n = turns) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
)
def op9_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, read back from
    their examples."""
    extra = spark.sql(
        f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{_SAID}' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    columns = ["conv_id", "turn", "role", "text"]
    return digests(examples(load(spark, sf_dir, "conversations").select(*columns).unionByName(extra)))
