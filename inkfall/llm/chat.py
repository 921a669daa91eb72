r"""Chat formatting with built-in expressions only.

A conversation's turns, sorted, become blocks of adjacent turns of one role:

    ### {role}: {text}{</part>text ...}</turn>\n

In roles and texts every backslash is doubled, a number sign after another, the slash of a control
string and the space after a role's colon get a backslash before them, so neither `##` nor a
control string stands in them, and dropping one backslash of each escape gives them back.
The loss mask is a list of spans, in code points, that cover each assistant text and nothing else.

Defined results: turns sort by number (null first), then role, then text; a null role or text
counts as empty, and an empty text is a turn all the same. Rows with a null conv_id form one
conversation. Rows that repeat are turns of their own. A conversation becomes one row, so it must
fit into one, as it does in any reader of such data; conversations with equal texts, however many,
never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_END, PART_END = "</turn>", "</part>"


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(text, "(?<=#)#", r"\\#"), "<(?=/(?:turn|part)>)", r"<\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escaped_role(role: Column) -> Column:
    return F.regexp_replace(escaped(role), ":(?= )", r":\\")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, end>>), a row for each conversation."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sorted_ = F.sort_array(F.collect_list(F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(sorted_.alias("turns"))
    # Positions at which a block begins, then the slice of turns up to the next one.
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    turn = lambda i: F.element_at("turns", i.cast("int") + 1)
    chats = chats.withColumn("begins", F.filter(at, lambda i: (i == 0) | (turn(F.greatest(i - 1, F.lit(0)))["role"] != turn(i)["role"])))
    after = lambda k: F.when(k + 1 < F.size("begins"), F.element_at("begins", F.least(k + 2, F.size("begins")))).otherwise(F.size("turns"))
    blocks = F.transform("begins", lambda b, k: F.struct(turn(b)["role"].alias("role"), F.transform(F.slice("turns", b + 1, after(k) - b), lambda t: escaped(t["text"])).alias("parts")))
    chats = chats.withColumn("blocks", blocks)

    def pieces(block: Column) -> Column:
        """The block as pieces of text, each with whether the loss counts it."""
        head = F.concat(F.lit("### "), _escaped_role(block["role"]), F.lit(": "))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        last = F.size(block["parts"]) - 1
        body = F.transform(block["parts"], lambda p, i: F.array(piece(p, block["role"] == loss_role), piece(F.when(i < last, PART_END).otherwise(f"{TURN_END}\n"), F.lit(False))))
        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(body))

    chats = chats.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")

    def walk(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece["text"])
        span = F.struct(state["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(piece["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), none.alias("spans")), walk, lambda s: s["spans"])
    return chats.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array<struct<role, text>>, loss_text) read back from format_chats."""
    blocks = F.expr(f"filter(split(formatted, '{TURN_END}\\n', -1), b -> b != '')")

    def parsed(block: Column) -> Column:
        colon = F.locate(": ", block)
        role = unescaped(F.substring(block, F.lit(5), colon - 5))
        body = F.substring(block, colon + 2, F.length(block))
        return F.transform(F.split(body, PART_END, -1), lambda p: F.struct(role.alias("role"), unescaped(p).alias("text")))

    under = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, parsed)).alias("turns"), F.array_join(under, "").alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what reading the formatted conversations gives back."""
    back = read_chats(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
