"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context
and the reply as the only trainable part. Turns after a conversation's last reply
make one more example without a trainable part, so that no turn is lost. A turn is

    <|im_start|>role\\ntext<|im_end|>\\n

and what texts and roles hold of control strings is escaped: & becomes &amp; and <|
becomes &lt;| (in roles a line feed also becomes &#10;), so a text can neither open
nor close a turn, and unescaping gives it back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(f"{END}\n"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, formatted, loss_start, loss_end: a row for each assistant turn,
    and one for the turns after the last.

    example counts from 0 within a conversation; loss_start and loss_end are the code
    points of formatted between which the reply's escaped text stands, the only part
    that is trained on (equal where nothing is). Input columns are conv_id, turn, role
    and text; others don't matter. Null role or text: empty. Rows are ordered by turn
    (null first), then role and text; repeated rows are turns of their own; rows of
    null conv_id are one conversation. A conversation is put together in one task: it
    is the unit that its examples' contexts need, and its examples are sized by it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # array_sort puts null structs last but null fields first, as asked
    said = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), format_turn(t["role"], t["text"]).alias("line"), F.length(escape(t["text"])).alias("chars")))
    talks = talks.select("conv_id", said.alias("turns"))
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["role"] == ASSISTANT)
    ends = F.when(F.element_at("turns", -1)["role"] == ASSISTANT, replies).otherwise(F.concat(replies, F.array(n)))
    talks = talks.select("conv_id", "turns", F.posexplode(ends).alias("example", "n_turns"))
    last = F.element_at("turns", F.col("n_turns"))
    formatted = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n_turns")), lambda t: t["line"]), "")
    made = talks.select("conv_id", F.col("example").cast("long").alias("example"), F.col("n_turns").cast("long").alias("n_turns"), formatted.alias("formatted"), last.alias("last"))
    end = F.length("formatted") - len(END) - 1
    trained = F.col("last.role") == ASSISTANT
    return made.select(
        "conv_id", "example", "n_turns", "formatted",
        F.when(trained, end - F.col("last.chars")).otherwise(0).cast("long").alias("loss_start"), F.when(trained, end).otherwise(0).cast("long").alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    return F.transform(
        F.transform(parts, body),
        lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")),
    )


def digest(made: DataFrame) -> DataFrame:
    """What examples() wrote, read back from it: a row for each conversation.

    turns_sha256 is of every turn's role, line feed, text, line feed; loss_sha256 of
    all trainable texts in order; formatted_chars counts all examples' code points.
    """
    trained = F.substring("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = made.select("conv_id", "example", "formatted", F.length("formatted").cast("long").alias("chars"), unescape(trained).alias("trained"))
    whole = rows.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "trained"))), lambda x: x["trained"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = read_turns(F.col("whole"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.withColumn("turns", turns).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
