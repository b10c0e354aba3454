"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is written as

    <|im_start|>ROLE newline TEXT<|im_end|> newline

and a conversation as its turns in order. The parser is deterministic: it cuts
at the control strings, which the grammar allows at these places only, and undoes
escapes. A turn is rendered, parsed and compared with its source; text that
does not come back is escaped, and so on until it does. The escape puts one
backslash after the `<` of a control string, or of one that was escaped before, so
it adds to what is there and the parser takes exactly one away: one round always
ends it. The finished conversation is parsed once more; a difference fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"<(\\*)\|(im_start|im_end)\|>"
_ESCAPED = r"<\\(\\*)\|(im_start|im_end)\|>"
#: Rounds of render, parse, compare and escape; the second finds nothing to do.
ROUNDS = 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<\\$1|$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<$1|$2|>")


def escape_role(role: Column) -> Column:
    """A role is one line: percent signs and line ends are percent-encoded, control strings escaped."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(role: Column, text: Column) -> Column:
    """A turn from its escaped role and text."""
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation; null where the grammar does not hold."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    bodies = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.split(p, r"<\|im_end\|>", -1))
    whole = (pieces[0] == "") & F.forall(bodies, lambda b: (F.size(b) == 2) & (F.element_at(b, -1) == "\n") & F.contains(b[0], F.lit("\n")))

    def turn(body):
        first = F.instr(body[0], "\n")
        return F.struct(
            unescape_role(F.substring(body[0], F.lit(1), first - 1)).alias("role"),
            unescape(F.substring(body[0], first + 1, F.length(body[0]))).alias("text"),
        )

    return F.when(whole, F.transform(bodies, turn))


def _comes_back(role: Column, written: Column, source: Column) -> Column:
    turns = parse(render(role, written))
    return F.coalesce((F.size(turns) == 1) & (turns[0]["text"] == source), F.lit(False))


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length), turns.

    Turns are in order of turn, then role, then text. `loss_spans` are the places
    (from 1, in code points) of the trained role's texts in `formatted`; `turns`
    is what the parser reads back. A null role or text is empty; a null turn comes
    first; rows with a null conv_id are one conversation; repeated rows are
    repeated turns. Other columns are ignored; an empty table gives no rows.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"written": F.col("text"), "named": escape_role(F.col("role"))})
    for _ in range(ROUNDS):
        again = ~_comes_back(F.col("named"), F.col("written"), F.col("text"))
        rows = rows.withColumn("written", F.when(again, escape(F.col("written"))).otherwise(F.col("written")))
    rows = rows.withColumn("line", render(F.col("named"), F.col("written")))
    place = F.length(F.concat(F.lit(START), F.col("named"), F.lit("\n")))
    whole = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "line", place.alias("before"), F.length("written").alias("n"), F.length("line").alias("size")))).alias("t")
    )
    formatted = F.array_join("t.line", "")
    # A running sum of the turns' lengths gives each text's place.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state, t):
        span = F.struct((state["at"] + t["before"] + 1).alias("start"), t["n"].alias("length"))
        spans = F.when(t["role"] == trained_role, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + t["size"]).alias("at"), spans.alias("spans"))

    spans = F.aggregate("t", start, step, lambda s: s["spans"])
    whole = whole.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    whole = whole.withColumn("read", parse(F.col("formatted")))
    same = F.coalesce(F.col("read") == F.col("source"), F.lit(False))
    checked = F.when(same, F.col("read")).otherwise(F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return whole.select("conv_id", "formatted", "loss_spans", checked.alias("turns"))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"])))
