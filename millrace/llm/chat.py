r"""Chat formatting that is proved by reading it back.

Grammar of a formatted conversation, turn after turn:

    <s>ROLE[\]\nBODY</s>

BODY of a user turn is wrapped as [INST] BODY [/INST]. A backslash at the end of the
header says that the body is escaped. Roles and bodies are first set as they are; the
text of each turn is parsed again, and where the parser does not find the very role and
text, the turn is escaped: level 1 escapes control strings, level 2 every character that
a control string begins with. The first level that reads back identical is used.

Escapes: \0 is a backslash, \1 is <, \2 is [, \3 is a line feed (in roles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
#: role, the escape mark, body of one turn.
TURN = r"(?s)<s>([^\n]*?)(\\?)\n(.*?)</s>"
USER = "user"


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(text: Column, level: int) -> Column:
    if not level:
        return text
    out = _replace(text, "\\", "\\0")
    for s in CONTROL if level == 1 else ("<", "["):
        out = _replace(out, s, {"<": "\\1", "[": "\\2"}[s[0]] + s[1:])
    return out


def unescape(text: Column) -> Column:
    return _replace(_replace(_replace(_replace(text, "\\3", "\n"), "\\2", "["), "\\1", "<"), "\\0", "\\")


def escape_role(role: Column) -> Column:
    return _replace(escape(role, 2), "\n", "\\3")


def render_turn(role: Column, text: Column, level: int) -> Column:
    # a role is escaped whenever it holds a character that could matter; the mark then follows it
    head = F.when(role.rlike(r"[\\<\[\n]"), escape_role(role)).otherwise(role)
    body = escape(text, level)
    body = F.when(role == USER, F.concat(F.lit("[INST] "), body, F.lit(" [/INST]"))).otherwise(body)
    return F.concat(F.lit("<s>"), head, F.lit("\\\n" if level else "\n"), body, F.lit("</s>"))


def read_body(role: Column, mark: Column, body: Column) -> Column:
    inner = F.when(role == USER, F.substring(body, 8, F.greatest(F.length(body) - 15, F.lit(0)))).otherwise(body)
    return F.when(mark == "\\", unescape(inner)).otherwise(inner)


def parse_turns(formatted: Column) -> Column:
    """An array of (role, text, raw, mark) read from a formatted conversation."""
    roles, marks, bodies = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(k)) for k in (1, 2, 3))
    rows = F.arrays_zip(roles.alias("role"), marks.alias("mark"), bodies.alias("body"))
    return F.transform(rows, lambda r: F.struct(unescape(r["role"]).alias("role"), read_body(unescape(r["role"]), r["mark"], r["body"]).alias("text")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans and turns.

    Rows are ordered by turn, then role and text; null roles and texts are empty. A row
    of a null conv_id is a conversation of its own, so that rows of no conversation are
    no group. Rows that repeat are turns of their own.
    loss_spans are the (start, length, escaped) of the assistant bodies, in bytes of
    ``formatted`` from 0. turns is what the parser reads from ``formatted``: it equals
    the source, else the query fails. Further columns are not read; an empty table gives
    an empty table. A conversation is one row, so it is built in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    piece = render_turn(F.col("role"), F.col("text"), 2)
    for level in (1, 0):
        tried = render_turn(F.col("role"), F.col("text"), level)
        got = parse_turns(tried)
        fits = (F.size(got) == 1) & (got[0]["role"] == F.col("role")) & (got[0]["text"] == F.col("text"))
        if not level:  # control strings are escaped even where the parser would cope with them
            fits = ~F.col("text").rlike("|".join(x.replace("[", "\\[").replace("]", "\\]") for x in CONTROL)) & fits
        piece = F.when(fits, tried).otherwise(piece)
    t = t.withColumn("piece", piece)
    t = t.withColumn("n", F.octet_length("piece"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    escaped = F.regexp_extract("piece", r"^<s>[^\n]*?(\\?)\n", 1) == "\\"
    head = F.locate("\n", F.col("piece"))  # roles without line feeds end there; all of it ASCII or not, count bytes
    lead = F.octet_length(F.left(F.col("piece"), head))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("at") + lead).alias("start"), (F.col("n") - lead - 4).cast("long").alias("length"), escaped.alias("escaped")))
    row = F.struct("turn", "role", "text", "at", "piece", span.alias("span"))
    named = t.filter("conv_id is not null").withColumn("at", F.coalesce(F.sum("n").over(order), F.lit(0).cast("long")))
    c = named.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    alone = t.filter("conv_id is null").withColumn("at", F.lit(0).cast("long")).select("conv_id", F.array(row).alias("rows"))
    c = c.union(alone)
    c = c.withColumn("formatted", F.array_join(F.col("rows.piece"), "")).withColumn("turns", parse_turns(F.col("formatted")))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    checked = F.when(F.col("turns") == source, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back as it was")))
    spans = F.filter(F.col("rows.span"), lambda x: x.isNotNull())
    return c.select("conv_id", checked.alias("formatted"), spans.alias("loss_spans"), "turns")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped. ``formatted``: its bytes, so that each span is cut without a walk."""
    each = F.transform(spans, lambda s: F.when(s["escaped"], unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))).otherwise(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string")))
    return F.array_join(each, "")


def chat_report(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    chats = format_chats(turns).withColumn("bytes", F.col("formatted").cast("binary"))
    chats = chats.withColumn("loss", loss_text(F.col("bytes"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
