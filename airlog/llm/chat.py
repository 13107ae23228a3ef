"""Chat formatting with DataFrame operations only.

A conversation becomes one text:

    <|im_start|>role NEWLINE first text of the role<|im_sep|>its next text ...<|im_end|> NEWLINE

Turns are gathered as structs and sorted; adjacent turns of one role are merged into one message, their texts parted by a mark.
A `<` with any number of backslashes and a `|` gets one backslash more wherever it stands in a text or role, so no text can hold
a mark, and taking one away restores it. A line end in a role is written as a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|im_line|>"
#: Characters of a block in which positions of a long text are looked up.
BLOCK = 4096
#: Pieces whose lengths are added up together.
SPAN_BLOCK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of every conversation of a table (conv_id, turn, role, text).

    loss_spans are the (start, length) in characters, from 0, of the texts of the role `trained` in formatted. Turns follow their
    number, null last, then role and text, so ties and repeated rows have one order. Null texts and roles count as empty; a null
    conv_id is a conversation. An empty table has no conversation.
    """
    rows = turns.select(
        F.col("conv_id"), F.struct(
            F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
            escape(F.coalesce(F.col("text"), F.lit(""))).alias("text")).alias("turn"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def role_at(position: Column) -> Column:
        return F.element_at("turns", position)["role"]

    # first turns of messages; a message runs to the next first turn
    numbered = sorted_turns.withColumn("starts", F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (role_at(i) != role_at(F.greatest(i - 1, F.lit(1))))))
    messages = F.transform("starts", lambda start, k: F.struct(
        role_at(start).alias("role"),
        F.transform(
            F.slice("turns", start, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - start), lambda t: t["text"]
        ).alias("texts")))
    merged = numbered.select("conv_id", messages.alias("messages"))

    def head(role: Column) -> Column:
        return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))

    # a piece is a stretch of the formatted text: whether it is trained on, and its characters
    pieces = F.flatten(F.transform("messages", lambda m: F.flatten(F.transform(m["texts"], lambda text, k: F.array(
        F.struct(F.lit(False).alias("loss"), F.when(k == 0, head(m["role"])).otherwise(F.lit(SEPARATOR)).alias("text")),
        F.struct((m["role"] == trained).alias("loss"), text.alias("text")),
        F.struct(F.lit(False).alias("loss"), F.when(k == F.size(m["texts"]) - 1, F.lit(END + "\n")).otherwise(F.lit("")).alias(
            "text")))))))
    cut = merged.select("conv_id", pieces.alias("pieces")).select(
        "conv_id", "pieces", F.transform("pieces", lambda p: F.struct(p["loss"].alias("loss"), F.length(p["text"]).alias(
            "length"))).alias("lengths"))
    # the spans: running sums of the lengths, first inside blocks of pieces and then over blocks, so no long array is copied often
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    inside = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("lengths") - 1) / SPAN_BLOCK).cast("int")),
        lambda b: F.aggregate(
            F.slice("lengths", b * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK)), nothing,
            lambda done, piece: F.struct(
                (done["at"] + piece["length"]).alias("at"),
                F.when(piece["loss"], F.concat(done["spans"], F.array(F.struct(
                    done["at"].alias("start"), piece["length"].cast("long").alias("length"))))
                ).otherwise(done["spans"]).alias("spans"))))
    cut = cut.select("conv_id", "pieces", inside.alias("blocks")).select("conv_id", "pieces", "blocks", F.aggregate(
        "blocks", F.array(F.lit(0).cast("long")),
        lambda starts, b: F.concat(starts, F.array(F.element_at(starts, -1) + b["at"]))).alias("starts"))
    spans = F.flatten(F.transform("blocks", lambda b, k: F.transform(b["spans"], lambda s: F.struct(
        (s["start"] + F.get("starts", k)).alias("start"), s["length"].alias("length")))))
    return cut.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds, in order: the inverse of the format."""
    messages = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda m: m != "")
    cut = F.transform(messages, lambda m: F.split(F.substr(m, F.lit(len(START) + 1)), "\n", 2))
    return F.flatten(F.transform(cut, lambda m: F.transform(
        F.split(m[1], r"<\|im_sep\|>", -1), lambda text: F.struct(
            unescape(F.replace(m[0], F.lit(LINE), F.lit("\n"))).alias("role"), unescape(text).alias("text")))))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the spans, in order. The text is cut into blocks once, so long texts cost no more for each span."""
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def under(known: Column) -> Column:
        return F.transform(spans, lambda s: unescape(F.substr(
            F.array_join(F.slice(known, (F.floor(s["start"] / BLOCK) + 1).cast("int"),
                                 (F.floor((s["start"] + s["length"]) / BLOCK) - F.floor(s["start"] / BLOCK) + 1).cast("int")), ""),
            (s["start"] % BLOCK + 1).cast("int"), s["length"].cast("int"))))

    return F.flatten(F.transform(F.array(blocks), under))
