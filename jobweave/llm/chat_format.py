"""Chat formatting into budgeted windows, with DataFrame functions only.

Prefix sums of the turns' token counts choose turn-aligned spans: a turn opens
in the window given by where its prefix sum starts, in strides of half the
budget.  Every window begins with the conversation's opening system turn,
repeats the turns that end the window before it as far as the history budget
reaches, and then holds its own turns.  The loss mask covers the texts of the
window's own assistant turns; repeated turns are never targets, so each
assistant text is a target once.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts a
backslash is doubled and ``<|`` becomes ``<\\|``; in roles ``%``, ``<`` and line
feeds are written as ``%25``, ``%3C`` and ``%0A``.  Both can be undone, and neither
can leave a control string in a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 512
HISTORY = 128
#: A token is taken as up to four characters between white space.
TOKEN = r"[^ \t\n\r]{1,4}"
#: Tokens that the marks around a turn take.
TURN_TOKENS = 4


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text).

    One row per window: conv_id, window (long, increasing), n_system, n_history,
    n_new (long: turns of each kind, in that order in the text), text, loss_spans
    (array of start, end in code points, end exclusive), n_tokens and over_budget
    (true where one turn alone is longer than half the budget and so the window
    is longer than allowed; turns are never cut).

    - Null texts and roles count as empty; a null turn number sorts last; turns
      with the same number are ordered by role and text, repeated rows stay.
    - A null conv_id is a conversation of its own; other columns are ignored.
    - An empty table gives no windows.
    """
    if history > budget // 2:
        raise ValueError("the history may take half of the budget at most")
    stride = budget // 2
    rows = turns.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    body = escape_text(F.col("text"))
    numbered = (
        rows.withColumn("pos", F.row_number().over(ordered))
        .withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)) + TURN_TOKENS)
        .withColumn("opening", (F.col("pos") == 1) & (F.col("role") == "system"))
        .withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
        .withColumn("seg", F.concat("head", body, F.lit(END + "\n")))
        .withColumn("head_chars", F.length("head").cast("long"))
        .withColumn("body_chars", F.length(body).cast("long"))
        .drop("text", "head")
    )
    placed = numbered.withColumn(
        "begin", F.coalesce(F.sum(F.when(F.col("opening"), 0).otherwise(F.col("tokens"))).over(before), F.lit(0))
    ).withColumn("window", F.floor(F.col("begin") / stride))
    conv = Window.partitionBy("conv_id")
    system = F.struct("seg", "tokens")
    placed = (
        placed.withColumn("system", F.max(F.when(F.col("opening"), system)).over(conv))
        .withColumn("alone", F.count(F.lit(1)).over(conv) == 1)
        .withColumn("next_begin", F.min("begin").over(conv.orderBy("window").rangeBetween(1, 1)))
    )
    # A turn is in its own window, and once more in the next one if that begins within the history budget.
    own = F.struct(F.col("window").alias("w"), F.lit(True).alias("new"))
    again = F.struct((F.col("window") + 1).alias("w"), F.lit(False).alias("new"))
    repeats = ~F.col("opening") & (F.col("next_begin") - F.col("begin") <= history)
    # The opening system turn rides along in `system`; only a conversation of nothing else needs a row for it.
    members = placed.where(~F.col("opening") | F.col("alone")).withColumn(
        "copy", F.explode(F.when(repeats, F.array(own, again)).otherwise(F.array(own)))
    )
    target = F.col("copy.new") & (F.col("role") == "assistant")
    in_window = Window.partitionBy("conv_id", "copy.w").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.when(F.col("opening"), 0).otherwise(F.coalesce(F.length("system.seg"), F.lit(0))).cast("long")
    members = members.withColumn(
        "offset", F.coalesce(F.sum(F.length("seg")).over(in_window), F.lit(0)) + lead + F.col("head_chars")
    )
    span = F.struct(F.col("offset").alias("start"), (F.col("offset") + F.col("body_chars")).alias("end"))
    grouped = members.groupBy("conv_id", F.col("copy.w").alias("window")).agg(
        F.max("system").alias("system"),
        F.max("opening").alias("only_system"),
        F.count_if(~F.col("copy.new")).alias("n_history"),
        F.count_if(F.col("copy.new") & ~F.col("opening")).alias("n_new"),
        F.array_sort(F.collect_list(F.struct("pos", "seg"))).alias("segs"),
        F.array_sort(F.collect_list(F.when(target, span))).alias("loss_spans"),
        F.sum(F.when(F.col("opening"), 0).otherwise(F.col("tokens"))).alias("own_tokens"),
    )
    joined = F.concat_ws("", F.transform("segs", lambda x: x["seg"]))
    tokens = F.col("own_tokens") + F.coalesce(F.col("system.tokens"), F.lit(0))
    return grouped.select(
        "conv_id", "window",
        F.when(F.col("system").isNotNull(), 1).otherwise(0).cast("long").alias("n_system"),
        "n_history", "n_new",
        F.when(F.col("only_system"), joined).otherwise(F.concat(F.coalesce("system.seg", F.lit("")), joined)).alias("text"),
        "loss_spans", tokens.alias("n_tokens"), (tokens > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations as the formatted windows hold them: conv_id, turns (array of role
    and text), loss_text and formatted_chars; the first window's system turn counts, repeated turns don't."""
    marked = F.split("text", r"\Q" + START + r"\E", -1)
    pieces = F.slice(marked, 2, F.size(marked))
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape_text(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + F.lit(2), F.length(p) - F.length(F.substring_index(p, "\n", 1)) - F.lit(2 + len(END)))).alias("text"),
    )
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("window")) == 1
    parsed = windows.withColumn("first", first).withColumn("all", F.transform(pieces, turn))
    skipped = (F.col("n_system") + F.col("n_history") + 1).cast("int")
    fresh = F.slice("all", skipped, F.size("all") + 1)
    opened = F.when(F.col("first") & (F.col("n_system") == 1), F.slice("all", 1, 1)).otherwise(F.slice("all", 1, 0))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape_text(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
    rows = parsed.select("conv_id", "window", F.concat(opened, fresh).alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    return rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars")
    ).select(
        "conv_id",
        F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
        F.concat_ws("", F.transform("w", lambda x: x["loss"])).alias("loss_text"),
        "formatted_chars",
    )
