"""Chat formatting with a grammar round trip, DataFrame operations only.

The template marks a turn as ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``.  A
deterministic parser splits at the two control strings and nothing else.  Each turn
is rendered plainly, parsed again and compared with its source; where they differ
it is rendered anew at the next level of escaping, until they are identical:

0. plain;
1. in the text, ``<``, any backslashes, ``|`` gets one more backslash, so that no control
   string is left; reading takes one off;
2. the role, too, is written with ``%25``, ``%0A`` and ``%3C`` for its percent signs, line
   ends and opening angles.

Reading undoes both at every level, and is the identity on what level 0 lets
through.  The joined conversation is parsed once more; were it ever to differ
from its source, an error is raised instead of a wrong record.

Spans of the loss mask are code points of the formatted string and cover the texts
of assistant turns, nothing between.  They are running sums of turn lengths in a
window.  A conversation is one output string, so its turns meet in one task;
tables aren't bounded by that, single conversations are (by a string's 2 GB).

Defined cases: a null role or text is empty.  Turns with equal numbers (or null ones,
which come first) stand in order of role, then text; repeated rows are turns of
their own.  A null conversation id is an id.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the template.
START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
_CONTROL = r"<\|im_start\|>|<\|im_end\|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string; null if the string isn't of the grammar."""
    parts = F.split(formatted, _CONTROL, -1)
    between = F.filter(parts, lambda x, i: (i % 2 == 0) & (x != F.when(i == 0, F.lit("")).otherwise(F.lit("\n"))))
    bodies = F.filter(parts, lambda x, i: i % 2 == 1)
    turn = lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape_text(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text"),
    )
    return F.when((F.size(parts) % 2 == 1) & (F.size(between) == 0), F.transform(bodies, turn))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (array of start, end), levels (largest escape level)."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # Escapes of one turn: the first level whose rendering reads back as the source.
    role, text = F.col("role"), F.col("text")
    source = F.array(F.struct(role.alias("role"), text.alias("text")))
    levels = [(role, text), (role, escape_text(text)), (escape_role(role), escape_text(text))]
    level = F.lit(len(levels) - 1)
    for k in reversed(range(len(levels) - 1)):
        level = F.when(F.coalesce(parse(render(*levels[k])) == source, F.lit(False)), F.lit(k)).otherwise(level)
    rows = rows.withColumn("level", level)
    rows = rows.withColumns({
        "out_role": F.when(F.col("level") == 2, escape_role(role)).otherwise(role),
        "out_text": F.when(F.col("level") >= 1, escape_text(text)).otherwise(text),
    })
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("piece", render(F.col("out_role"), F.col("out_text")))
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    start = F.col("before") + F.lit(len(START) + 1) + F.length("out_role")
    span = F.when(F.col("role") == TRAINED, F.struct(start.alias("start"), (start + F.length("out_text")).alias("end")))
    kept = F.struct("place", "piece", span.alias("span"), F.struct("role", "text").alias("source"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(kept)).alias("all"), F.max("level").alias("levels"))
    whole = whole.select("conv_id", F.array_join(F.col("all.piece"), "").alias("formatted"), F.filter(F.col("all.span"), lambda x: x.isNotNull()).alias("loss_spans"), F.col("all.source").alias("source"), "levels")
    same = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    return whole.select("conv_id", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't read back")).cast("string")).alias("formatted"), "loss_spans", "levels")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns, as parsed, and loss_text, the unescaped text under the mask, to what format_conversations() returned."""
    masked = F.transform("loss_spans", lambda s: unescape_text(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": parse(F.col("formatted")), "loss_text": F.array_join(masked, "")})
