r"""Chat formatting with a proof by parsing: what is rendered reads back as the turns that it was made of.

A turn is rendered as `### role: text`, a line end, `</turn>` and a line end.  The parser knows
two controls, `###` and `</turn>`, where no backslash stands before them: the first begins a
turn wherever it is, the second ends it.  Then it takes one backslash off each run of them
before a control in the text.  A turn is rendered as it is and parsed; if that does not give
back its role and text, the content that conflicts is escaped, by one more backslash before
each control, and it is tried again.  Texts without controls stay as they are, whatever
backslashes they hold.  At last the whole conversation is parsed and compared; a difference
would be an error (`escape` is reversible, so none is known to be possible).

Of roles, the characters of ROLE_CODES are written as codes, so that a role holds no control.

All is done by expressions: a window by conversation finds where turns begin, and a group puts
them together, by one shuffle.  A conversation is one row of the result, so it has to fit into
one; no two are put together.  Turns go by turn, null first, equal ones by role and text; null
roles and texts are empty ones; rows without a conv_id are one conversation without id.  An
empty table gives an empty result.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "###", "</turn>"
CONTROL = f"{BEGIN}|{END}"
TAIL = f"\n{END}\n"
ROUNDS = 2  # as it is, and escaped

#: The codes that stand for characters of a role; the percent sign is coded first and decoded last.
ROLE_CODES = {"%": "%25", ":": "%3A", "\n": "%0A", "#": "%23", "<": "%3C", "\\": "%5C"}


def coded(role: Column) -> Column:
    for plain, code in ROLE_CODES.items():
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def decoded(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES.items()):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def escape(text: Column) -> Column:
    """One more backslash before each control; runs of backslashes are gone over once."""
    return F.regexp_replace(text, rf"(?<!\\)(\\*+)({CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+)({CONTROL})", "$1$2")


def opening(role: Column) -> Column:
    return F.concat(F.lit(f"{BEGIN} "), coded(role), F.lit(": "))


def parsed(rendered: Column) -> Column:
    """The turns (role, text) of rendered text; a turn that breaks the grammar is null."""
    pieces = F.split(rendered, rf"(?<![\\#]){BEGIN}")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ": ", 1)
        rest = F.substr(piece, F.length(role) + 3)
        parts = F.split(rest, rf"(?<!\\){END}")
        fits = piece.startswith(" ") & (F.length(role) + 2 <= F.length(piece)) & (F.size(parts) == 2) & parts[0].endswith("\n") & (F.get(parts, F.lit(1)) == "\n")
        text = F.substr(parts[0], F.lit(1), F.length(parts[0]) - 1)
        return F.when(fits, F.struct(decoded(F.substr(role, F.lit(2))).alias("role"), unescape(text).alias("text")))

    turns = F.transform(F.slice(pieces, 2, F.size(pieces)), turn)
    return F.when(pieces[0] == "", turns).otherwise(F.array(F.lit(None).cast("struct<role:string,text:string>")))


def written(turns: DataFrame) -> DataFrame:
    """Turns with `content`, their text as it is written: escaped if it reads back otherwise as it is."""
    source = F.array(F.struct("role", "text"))
    out = turns.withColumn("content", F.col("text"))
    for _ in range(ROUNDS - 1):
        same = parsed(F.concat(opening(F.col("role")), "content", F.lit(TAIL))).eqNullSafe(source)
        out = out.withColumn("content", F.when(same, F.col("content")).otherwise(escape(F.col("content"))))
    return out


def format_chats(conversations: DataFrame, learned: str = "assistant") -> DataFrame:
    """For each conversation its rendered text, the spans of it that are learned from (in code points), and the turns read back from it."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    w = Window.partitionBy("conv_id").orderBy(*order)
    length = F.length(opening(F.col("role"))) + F.length("content") + len(TAIL)
    placed = written(turns).withColumn("nth", F.row_number().over(w)).withColumn("at", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)) - length)
    begin = F.col("at") + F.length(opening(F.col("role")))
    span = F.when(F.col("role") == learned, F.struct(begin.alias("start"), (begin + F.length("content")).alias("end")))
    rows = placed.select("conv_id", F.struct("nth", "role", "text", F.concat(opening(F.col("role")), "content", F.lit(TAIL)).alias("frame"), span.alias("span")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    formatted = F.array_join(F.transform("ts", lambda t: t["frame"]), "")
    spans = F.filter(F.transform("ts", lambda t: t["span"]), lambda s: s.isNotNull())
    source = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = whole.select("conv_id", formatted.alias("formatted"), spans.alias("learned"), source.alias("source")).withColumn("turns", parsed(F.col("formatted")))
    proven = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(F.raise_error(F.lit("rendered turns do not read back")))
    return out.select("conv_id", "formatted", "learned", proven.alias("turns"))


def learned_text(formatted: Column, spans: Column) -> Column:
    """The text under the spans, unescaped, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Sizes and hashes of formatted conversations, as read back from them."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = learned_text(F.col("formatted"), F.col("learned"))
    return formatted.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
