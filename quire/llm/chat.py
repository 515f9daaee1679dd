"""Chat formatting with cumulative-snapshot collapse, in DataFrame operators only.

Logs often hold a conversation many times, each time a few turns longer.  A rolling hash
of every turn prefix tells which logged conversation is a prefix of another; an anti-join
keeps the maximal ones, and only those are rendered.

Turns are put in order once, by ranges of (conversation, turn, role, text), and written with
a number each.  A conversation of any length, with turns tied or without numbers, is a run of
such ranges: what goes from one to the next is a sum per range.  Rendering goes by BLOCK turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import parts_for, stash

BLOCK = 4096
#: Turns per range; the characters of a text by which ranges are told apart.
RANGE, LEAD = 200_000, 64
# The markers of the rendered format.
START, END = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame, each: int = RANGE) -> DataFrame:
    """(conv_id, run, seq, role, text), written once: run is the number of a range, seq counts inside it.

    Null ids are left out; a null turn comes first, null role and text are empty.  Turns go by
    (turn, role, text).
    """
    c = conversations
    rows = c.select(
        c["conv_id"].cast("long").alias("conv_id"),
        F.coalesce(c["turn"].cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(c["text"].cast("string"), F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull())
    ranged = rows.repartitionByRange(parts_for(rows.count(), each), "conv_id", "turn", "role", F.left("text", F.lit(LEAD)))
    number = F.monotonically_increasing_id()
    return stash(ranged.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", F.shiftright(number, 33).alias("run"), number.alias("seq"), "role", "text"))


def _earlier(per_run: DataFrame, *columns: tuple[str, Column]) -> DataFrame:
    """per_run (conv_id, run, ...) with the columns aggregated over the conversation's earlier runs."""
    w = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return per_run.withColumns({name: F.coalesce(agg.over(w), F.lit(0)) for name, agg in columns})


def shifts(rows: DataFrame) -> DataFrame:
    """(conv_id, run, shift): seq + shift is a turn's place in its conversation, from 1."""
    per_run = rows.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    placed = _earlier(per_run, ("before", F.sum("n")))
    return placed.select("conv_id", "run", (F.col("before") - F.col("first") + 1).alias("shift"))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, k, h1, h2): a 128-bit rolling hash of the first k turns, for every k.

    The hash of a prefix is the exclusive or of hashes of (place, role, text), so it rolls
    forward turn by turn and carries over from run to run.
    """
    light = rows.select(
        "conv_id", "run", "seq", F.xxhash64("role", "text").alias("c1"), F.xxhash64(F.lit(7), "text", F.lit(11), "role").alias("c2")
    )
    placed = light.join(shifts(rows.select("conv_id", "run", "seq")), ["conv_id", "run"]).withColumn("k", F.col("seq") + F.col("shift"))
    placed = placed.select("conv_id", "run", "k", F.xxhash64("k", "c1", "c2").alias("g1"), F.xxhash64("c2", "k", "c1").alias("g2"))
    so_far = Window.partitionBy("conv_id", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = stash(placed.select("conv_id", "run", "k", F.bit_xor("g1").over(so_far).alias("r1"), F.bit_xor("g2").over(so_far).alias("r2")))
    # a run's own hash is that of its last turn
    totals = rolled.groupBy("conv_id", "run").agg(F.max_by("r1", "k").alias("x1"), F.max_by("r2", "k").alias("x2"))
    sums = _earlier(totals, ("b1", F.bit_xor("x1")), ("b2", F.bit_xor("x2"))).select("conv_id", "run", "b1", "b2")
    return rolled.join(sums, ["conv_id", "run"]).select(
        "conv_id", "k", F.col("r1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("b2")).alias("h2")
    )


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no prefix of another; of equal ones the smallest conv_id.

    Ends that share a prefix become one row before they meet the prefixes that go on, of which
    each is one row too: however often a conversation is logged, no key of the anti-join is hot.
    """
    heads = stash(prefixes(rows))
    length = heads.groupBy("conv_id").agg(F.max("k").alias("n"))
    full = heads.join(length, "conv_id")
    prefix = ["k", "h1", "h2"]
    ends = full.where("k = n").groupBy(*prefix).agg(F.min("conv_id").alias("conv_id"))
    longer = full.where("k < n").select(*prefix).distinct()
    return ends.join(longer, prefix, "left_anti").select("conv_id", F.col("k").alias("n_turns"))


def render(rows: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, part_turns, rendered) of the kept (conv_id, n_turns): turns in order between
    markers, `block` of them to a part.

    A marker's opening "<|" inside a role or text is set apart as "< |".
    """
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit(START), safe("role"), F.lit("\n"), safe("text"), F.lit(END), F.lit("\n"))
    wanted = shifts(rows.select("conv_id", "run", "seq")).join(kept, "conv_id")
    placed = rows.join(wanted, ["conv_id", "run"]).withColumn("k", F.col("seq") + F.col("shift"))
    listed = placed.groupBy("conv_id", F.floor((F.col("k") - 1) / F.lit(block)).cast("long").alias("part")).agg(
        F.first("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("part_turns"), F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("lines")
    )
    return listed.select("conv_id", "part", "n_turns", "part_turns", F.array_join(F.col("lines.line"), "").alias("rendered"))


def format_chats(conversations: DataFrame, block: int = BLOCK, each: int = RANGE) -> DataFrame:
    """Maximal conversations, rendered: conv_id, part, n_turns, part_turns, rendered.

    A conversation all of whose turns open another, longer one is left out, and of equal
    conversations the one with the smallest conv_id stays.  Turns go by (turn, role, text);
    a repeated row is a turn of its own.  Prefixes are equal when their 128-bit hashes are.
    An empty table gives an empty result.
    """
    rows = turns(conversations, each)
    return render(rows, stash(maximal(rows)), block)
