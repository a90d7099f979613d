"""Chat formatting in budgeted windows, in DataFrame functions only.

Each turn becomes <|im_start|>role<|im_sep|>text<|im_end|>. Control strings inside roles and texts are
escaped by a backslash after their first sign, and backslashes are doubled, so a marker in the output
is always the template's own and unescaping gives the text back. Prefix sums of turn tokens cut a
conversation into windows that start and end with whole turns; a window repeats the system turn and a
limited history before its new turns, and only new assistant texts stand under the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import let, running

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: The control strings of common templates, by what follows their first sign.
CONTROL = r"<(?=\||s>|/s>|<SYS>>|</SYS>>|unk>|pad>)|\[(?=/?INST\]|/?TOOL_CALLS\]|/?AVAILABLE_TOOLS\])"
TOKEN = r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]"
#: Tokens a turn's markers take.
OVERHEAD = 4
BUDGET = 2048
HISTORY_TURNS = 2
HISTORY_TOKENS = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """Tokens of a text by a rule: runs of letters and digits, and single other signs."""
    return F.regexp_count(text, F.lit(TOKEN))


def windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv_id, window, n_tokens, n_repeated (turns at its front that an earlier window has), formatted,
    loss (array of start, end: code points of formatted that count for the loss).

    New turns are taken while they, the system turn and the history fit the budget; a single turn that doesn't fit
    stands in a window of its own. Turns go by turn, then role, then text; null roles and texts are empty, null turns
    come first, and all rows without conv_id are one conversation. Repeated rows are turns of their own. An empty table
    gives no rows; other columns are not read.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", tokens(F.col("text")) + tokens(F.col("role")) + OVERHEAD)
    of = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("i", F.row_number().over(of)).withColumn("system", (F.col("i") == 1) & (F.col("role") == "system"))
    cost = F.when(~F.col("system"), F.col("n")).otherwise(0)
    rows = rows.withColumn("upto", F.sum(cost).over(of))  # prefix sums, the system turn apart
    # What a window that starts here would repeat: the most turns before it within both limits.
    back, hist = F.lit(0), F.lit(0).cast("bigint")
    for h in range(1, history_turns + 1):
        total = (F.col("upto") - cost) - F.lag("upto", h + 1, 0).over(of)
        fits = (F.col("i") > h) & ~F.coalesce(F.lag("system", h).over(of), F.lit(False)) & (total <= history_tokens)
        back, hist = F.when(fits, h).otherwise(back), F.when(fits, total).otherwise(hist)
    rows = rows.withColumn("back", back).withColumn("hist", hist)
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "role", "text", "n", "system", "upto", "back", "hist"))).alias("turns"))
    first = F.col("turns")[0]
    system = F.when(first["system"], first["n"]).otherwise(0)

    # State of the cut: tokens before the window, its history's tokens, the starts so far.
    zero = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("hist"), F.array(F.lit(1)).alias("starts"))

    def step(s, t):
        over = ~t["system"] & (t["upto"] - s["before"] + s["hist"] + system > budget) & (t["i"] > F.element_at(s["starts"], -1)) & (t["upto"] - t["n"] > s["before"])
        return F.when(over, F.struct((t["upto"] - t["n"]).alias("before"), t["hist"].alias("hist"), F.concat(s["starts"], F.array(t["i"])).alias("starts"))).otherwise(s)

    conv = conv.withColumn("starts", F.aggregate("turns", zero, step, lambda s: s["starts"]))
    # Each window takes its own turns before rows are made of windows, so bytes follow the turns and not turns times windows.
    def window(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        begin = F.element_at("turns", start)
        # A turn longer than the budget keeps its window to itself: no history then.
        own = F.element_at("turns", end - 1)["upto"] - (begin["upto"] - F.when(begin["system"], 0).otherwise(begin["n"]))
        repeated = F.when((start > 1) & (own + begin["hist"] + system <= budget), begin["back"]).otherwise(0)
        front = F.when((start > 1) & first["system"], F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
        return F.struct(F.concat(front, F.slice("turns", start - repeated, repeated)).alias("repeated"), F.slice("turns", start, end - start).alias("new"))

    one = conv.select("conv_id", F.posexplode(F.transform("starts", window)).alias("window", "turns")).select("conv_id", "window", "turns.*")
    n_rep = F.size("repeated")
    shown = F.transform(F.concat("repeated", "new"), lambda t, i: F.struct(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("body"), ((t["role"] == "assistant") & (i >= n_rep)).alias("learn"), t["n"].alias("n")))
    one = one.select("conv_id", "window", n_rep.alias("n_repeated"), shown.alias("shown"))
    size = F.transform("shown", lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + len(END))
    spans = F.zip_with("shown", running(size), lambda x, at: F.struct((at + F.char_length(x["head"])).alias("start"), (at + F.char_length(x["head"]) + F.char_length(x["body"])).alias("end"), x["learn"].alias("learn")))
    return one.select(
        "conv_id", "window", F.aggregate("shown", F.lit(0), lambda s, x: s + x["n"]).alias("n_tokens"), "n_repeated",
        F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter(spans, lambda x: x["learn"]), lambda x: F.struct(x["start"], x["end"])).alias("loss"),
    )


def read_back(formatted: Column, skip: Column) -> Column:
    """array<struct<role, text>> of the turns of a window after the first skip, from its text alone."""
    parts = F.split(formatted, r"<\|im_end\|>", -1)
    mine = let(parts, lambda p: F.slice(p, skip + 1, F.size(p) - 1 - skip))
    return F.transform(mine, lambda x: let(F.split(F.substr(x, F.lit(len(START) + 1)), r"<\|im_sep\|>", 2), lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text"))))


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, nothing between."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substr(formatted, x["start"] + 1, x["end"] - x["start"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = read_back(F.col("formatted"), F.col("n_repeated"))
    x = formatted.select("conv_id", "window", turns.alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("learned"), F.char_length("formatted").alias("chars"))
    x = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "learned", "chars"))).alias("w"))
    told = F.array_join(F.transform(F.flatten("w.turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.col("w.learned"), "")
    return x.select(
        "conv_id", F.size(F.flatten("w.turns")).cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.aggregate("w.chars", F.lit(0).cast("bigint"), lambda s, c: s + c).alias("formatted_chars"),
    )
