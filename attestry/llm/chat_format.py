r"""Chat formatting in budgeted windows.

A turn is written ``### role: text</turn>`` and a line feed. Inside roles and texts ``\`` becomes ``\b``, ``</turn>`` ``\e`` and ``### `` ``\h`` (in roles
also ``:`` ``\c``), so that marks never stand in a text and all of it can be read back.

Turns of a conversation are cut into blocks of ``block`` turn numbers, each a task's work, so that no conversation is too long for one. In a block,
prefix sums of the turns' tokens choose windows: with ``room`` for new turns (the budget without history and system turn, a quarter of it
at least) cells of three quarters of the room are laid over the sums; a window is the turns that begin in one cell, and the turn that
crosses the cell's end is one of them if it fits into the room, else a window of its own. Each window begins with the conversation's system
turn and repeats the turns before it that begin at most ``history`` tokens earlier (from the block before as well, for a block's first window). The
loss mask covers texts of the target role, in the window in which they are new; where they are repeated they are masked out.

Tokens are words, and ``marks`` more for each turn. A turn is never cut or dropped: one that is longer than the budget is a window that exceeds it.

Defined cases: turns are in the order of turn, role and text, a null turn first; null texts and roles are empty; rows with a null
conversation are one conversation; repeated rows are turns of their own; a system turn is the first row of a conversation if its role is
``system``; an empty table gives no rows; other columns are not looked at. Turn numbers with gaps beyond a block leave no history across the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SPACES = r"[\x20\x09-\x0D]+"
END = "</turn>\n"
_TEXT = (("\\", "\\b"), ("</turn>", "\\e"), ("### ", "\\h"))
_ROLE = (*_TEXT, (":", "\\c"))


def _replaced(text: Column, pairs) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escaped(text: Column) -> Column:
    return _replaced(text, _TEXT)


def unescaped(text: Column) -> Column:
    """Every backslash of an escaped text begins one of the three pairs, so that they can be put back one after another, the backslash last."""
    return _replaced(text, [(b, a) for a, b in reversed(_TEXT)])


def written(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), _replaced(role, _ROLE), F.lit(": "), escaped(text), F.lit(END))


def read(formatted: Column) -> Column:
    """The turns of a window as structs (role, text)."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substring(p, 5, 2**31 - 1), ": ", 1)
        text = F.substring(p, F.length(role) + 7, F.lit(2**31 - 1))
        return F.struct(_replaced(role, [(b, a) for a, b in reversed(_ROLE)]).alias("role"), unescaped(text).alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, as they were."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def word_tokens(text: Column, marks: int = 4) -> Column:
    """Words between spaces, and what the marks of the turn take."""
    parts = F.split(text, SPACES)
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0) + marks).cast("bigint")


def windows(rows: DataFrame, budget: int = 1024, history: int = 128, block: int = 256, marks: int = 4, target: str = "assistant", system: str = "system") -> DataFrame:
    """One row per window: conv_id, block, start (tokens before it in the block), formatted, loss (spans in code points, end exclusive), tokens,
    repeated (turns at its beginning that an earlier window has too)."""
    conv, number = F.col("conv_id").cast("string"), F.col("turn").try_cast("bigint")
    turns = rows.select(
        F.when(conv.isNull(), "n").otherwise(F.concat(F.lit("v"), conv)).alias("conv"), "conv_id", F.coalesce(F.floor(number / block), F.lit(-(2**62))).alias("block"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("tokens", word_tokens(F.col("text"), marks))
    # the first row of each conversation, with its text if it is the system turn
    head = turns.groupBy("conv").agg(F.min(F.struct("turn", "role", F.when(F.col("role") == system, F.col("text")).otherwise("").alias("text"), "block", "tokens")).alias("head"))
    head = head.filter(F.col("head.role") == system).select("conv", F.struct(written(F.col("head.role"), F.col("head.text")).alias("written"), F.col("head.tokens").alias("tokens"), F.col("head.block").alias("block")).alias("system"))
    blocks = turns.groupBy("conv", "block").agg(F.sum("tokens").alias("total")).join(head, "conv", "left")

    in_order = W.partitionBy("conv", "block").orderBy("turn", "role", "text")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    # all that follows stays in the tasks of (conv, block), but for the tails that a block hands to the next one
    placed = turns.withColumn("place", F.row_number().over(in_order)).join(blocks, ["conv", "block"])
    is_system = F.col("system").isNotNull() & (F.col("place") == 1) & (F.col("system.block") == F.col("block"))
    placed = placed.withColumns({"is_system": is_system, "text": F.when(is_system, F.lit("")).otherwise(F.col("text"))})
    taken = F.when(F.col("is_system"), F.lit(0).cast("bigint")).otherwise(F.col("tokens"))
    new = F.when(F.col("is_system"), F.lit("")).otherwise(written(F.col("role"), F.col("text")))
    placed = placed.withColumns({"tokens": taken, "written": new, "total": F.col("total") - F.when(F.col("system.block") == F.col("block"), F.col("system.tokens")).otherwise(0)})
    placed = placed.withColumn("chars", F.length("written").cast("bigint"))
    placed = placed.withColumns({"s": F.coalesce(F.sum("tokens").over(W.partitionBy("conv", "block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "at": F.coalesce(F.sum("chars").over(W.partitionBy("conv", "block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    room = F.greatest(F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0)), F.lit(budget // 4))
    placed = placed.withColumn("cell", F.floor(room * 3 / 4))
    cell = F.floor(F.col("s") / F.col("cell"))
    alone = (F.col("s") + F.col("tokens") > (cell + 1) * F.col("cell")) & (F.col("tokens") > room - F.col("cell"))
    placed = placed.withColumns({"alone": alone, "cell": cell})
    # the system turn stands in the window of the turn after it
    following = F.lead("alone").over(W.partitionBy("conv", "block").orderBy("place"))
    placed = placed.withColumn("alone", F.when(F.col("is_system"), F.coalesce(following, F.lit(False))).otherwise(F.col("alone")))

    own = F.struct("place", "s", "at", "tokens", "role", "written", "is_system")
    groups = placed.groupBy("conv", "block", "cell", "alone").agg(
        F.first("conv_id").alias("conv_id"), F.first("system").alias("system"), F.first("total").alias("total"), F.min("s").alias("start"), F.sort_array(F.collect_list(own)).alias("turns")
    )
    groups = groups.withColumns({"turns": F.filter("turns", lambda t: ~t["is_system"]), "had_system": F.exists("turns", lambda t: t["is_system"])})
    reach = W.partitionBy("conv", "block").orderBy("start").rangeBetween(-(history + budget), -1)
    groups = groups.withColumn("back", F.filter(F.flatten(F.collect_list("turns").over(reach)), lambda t: t["s"] >= F.col("start") - history))
    # a block's last turns, for the first window of the block after it
    tail = groups.filter(F.col("start") >= F.col("total") - (history + budget)).select("conv", (F.col("block") + 1).alias("block"), F.explode(F.filter("turns", lambda t: t["s"] >= F.col("total") - history)).alias("t"))
    tail = tail.groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("tail"))
    groups = groups.join(tail, ["conv", "block"], "left")
    back = F.when((F.col("start") == 0) & F.col("tail").isNotNull(), F.col("tail")).otherwise(F.col("back"))
    groups = groups.withColumn("back", back)

    kept = F.coalesce("system.written", F.lit(""))
    past = F.array_join(F.transform("back", lambda t: t["written"]), "")
    groups = groups.withColumns({"prefix": F.concat(kept, past)})
    base = F.length("prefix") - F.get(F.col("turns")["at"], F.lit(0))
    targets = F.filter("turns", lambda t: t["role"] == target)
    head_of = len(f"### {target}: ")  # the target role has no control strings

    def span(t: Column) -> Column:
        return F.struct((base + t["at"] + head_of).alias("start"), (base + t["at"] + F.length(t["written"]) - len(END)).alias("end"))

    system_again = F.when(F.col("system").isNotNull() & ~F.col("had_system"), 1).otherwise(0)
    return groups.select(
        "conv_id", "conv", "block", "start", F.col("alone"), F.concat("prefix", F.array_join(F.transform("turns", lambda t: t["written"]), "")).alias("formatted"),
        F.transform(targets, span).alias("loss"), (F.aggregate(F.concat("back", "turns"), F.lit(0).cast("bigint"), lambda n, t: n + t["tokens"]) + F.coalesce("system.tokens", F.lit(0))).alias("tokens"),
        (F.size("back") + system_again).alias("repeated"), F.col("had_system"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Conversations as they stand in the windows: conv_id, turns (role, text) in order, targets (texts under the mask, in order), formatted_chars."""
    turns = read(F.col("formatted"))
    one = formatted.select(
        "conv_id", "conv", "block", "start", "alone", F.length("formatted").cast("bigint").alias("chars"), turns.alias("turns"), "repeated", "had_system", under_mask(F.col("formatted"), F.col("loss")).alias("targets")
    )
    # the system turn stands before what is repeated: where it is new, it stays
    again = F.col("repeated")
    mine = F.when(F.col("had_system"), F.concat(F.slice("turns", 1, 1), F.slice("turns", again + 2, F.size("turns")))).otherwise(F.slice("turns", again + 1, F.size("turns")))
    one = one.select("conv_id", "conv", F.struct("block", "start", "alone", mine.alias("turns"), "targets").alias("w"), "chars")
    all_ = one.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    return all_.select("conv_id", F.flatten(F.col("w.turns")).alias("turns"), F.flatten(F.col("w.targets")).alias("targets"), "formatted_chars")
