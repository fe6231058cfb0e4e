"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become one block by an array
aggregation; blocks are concatenated. A block reads ``### role: text</turn>`` and a line feed; the texts of a merged block
are kept apart by ``</part>``. Inside roles and texts ``\\``, ``#`` and ``</`` are escaped with a backslash (``:`` in roles
as well), so no text can forge a mark and every text comes back exactly.

The output carries the spans of the assistant's texts as code points of the formatted string (the loss mask). ``read_back``
parses the string alone. Turns are ordered by turn, then role, then text, nulls first, so ties and repeated rows have one
order; null texts and roles count as empty; rows with a null conversation form one conversation of their own. A conversation
is one output row and is held whole, as the format needs it; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNT = "assistant"
HEAD, MIDDLE, PART, END = "### ", ": ", "</part>", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    out = text
    for plain in ("\\", "#", *([":"] if role else [])):
        out = F.replace(out, F.lit(plain), F.lit("\\" + plain))
    return F.replace(out, F.lit("</"), F.lit("<\\/"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#:/])", "$1")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", learnt: str = LEARNT) -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, end>>): one row for each conversation."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    sorted_turns = F.array_sort(F.collect_list(turn)).alias("turns")
    rows = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(sorted_turns)
    # nulls first: array_sort puts null fields of structs first already
    blocks = rows.select(
        "conv_id",
        F.expr("""
            aggregate(turns, CAST(array() AS array<struct<role: string, texts: array<string>>>), (blocks, t) ->
              CASE WHEN size(blocks) > 0 AND element_at(blocks, -1).role = t.role
                THEN concat(slice(blocks, 1, size(blocks) - 1),
                            array(named_struct('role', t.role, 'texts', concat(element_at(blocks, -1).texts, array(t.text)))))
                ELSE concat(blocks, array(named_struct('role', t.role, 'texts', array(t.text)))) END)
        """).alias("blocks"),
    )
    safe = blocks.select(
        "conv_id",
        F.transform(
            "blocks",
            lambda b: F.struct(
                b["role"].alias("role"),
                F.concat(F.lit(HEAD), escaped(b["role"], role=True), F.lit(MIDDLE)).alias("head"),
                F.transform(b["texts"], lambda t: escaped(t)).alias("texts"),
            ),
        ).alias("blocks"),
    )
    pieces = F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], PART), F.lit(END)))
    spans = F.expr(f"""
        aggregate(blocks, named_struct('at', 0, 'spans', CAST(array() AS array<struct<start: int, end: int>>)), (s, b) ->
          aggregate(b.texts, named_struct('at', s.at + char_length(b.head), 'spans', s.spans), (x, t) ->
            named_struct('at', x.at + char_length(t) + {len(PART)},
                         'spans', CASE WHEN b.role = '{learnt}' THEN concat(x.spans, array(named_struct('start', x.at, 'end', x.at + char_length(t)))) ELSE x.spans END),
            x -> named_struct('at', x.at - {len(PART)} + {len(END)}, 'spans', x.spans)),
          s -> s.spans)
    """)
    return safe.select("conv_id", F.array_join(pieces, "").alias("formatted"), spans.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds ``turns`` array<struct<role, text>> and ``learnt`` array<string>, both parsed from the formatted string."""
    blocks = F.filter(F.split("formatted", END, -1), lambda b: b != "")
    parsed = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_extract(b, r"(?s)^### (?:[^\\:]|\\.)*: (.*)$", 1), PART, -1),
                lambda t: F.struct(unescaped(F.regexp_extract(b, r"(?s)^### ((?:[^\\:]|\\.)*): ", 1)).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )
    masked = F.transform("loss", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return chats.withColumns({"turns": parsed, "learnt": masked})
