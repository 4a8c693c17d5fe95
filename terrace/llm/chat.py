"""Chat formatting after collapsing cumulative snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.common import written

#: Turn numbers per block; a block is the largest thing that one row holds.
BLOCK = 256


def turn_blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Conversations cut into blocks of ``block`` turn numbers, with rolling prefix hashes.

    The prefix hash of ``k`` turns is the xor of a 128-bit hash of (position,
    role, text) over the first ``k`` turns. It rolls along a block inside a
    row, and along a conversation by a window over its blocks, so even a
    conversation with a third of all rows is never gathered in one row.
    """
    number = F.floor(F.col("turn") / block)
    items = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.coalesce(number, F.lit(-(1 << 62))).alias("block"),
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("item"),
    )
    blocks = items.groupBy("conv_id", "block").agg(F.array_sort(F.collect_set("item")).alias("items"))
    conv = W.partitionBy("conv_id")
    before = conv.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    placed = blocks.select(
        "*", F.coalesce(F.sum(F.size("items")).over(before), F.lit(0)).alias("offset"),
        F.row_number().over(conv.orderBy("block")).cast("int").alias("part"),
    )

    def marks(x: Column, i: Column) -> Column:
        at = F.col("offset") + i + 1
        return F.struct(F.xxhash64(at, x["role"], x["text"]).alias("a"), F.xxhash64(x["text"], at, x["role"], F.lit("b")).alias("b"))

    hashed = placed.withColumn("marks", F.transform("items", marks))
    for side in "ab":
        total = F.aggregate(F.col("marks")[side], F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
        hashed = hashed.withColumn(f"all_{side}", total)
    rolled = hashed.select(
        "conv_id", "part", "offset", "items", "marks",
        F.coalesce(F.bit_xor("all_a").over(before), F.lit(0)).alias("seed_a"),
        F.coalesce(F.bit_xor("all_b").over(before), F.lit(0)).alias("seed_b"),
        F.sum(F.size("items")).over(conv).alias("n_turns"),
    )
    start = F.struct(F.col("seed_a").alias("a"), F.col("seed_b").alias("b"))

    def roll(done: Column, m: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), start)
        return F.concat(done, F.array(F.struct(last["a"].bitwiseXOR(m["a"]).alias("a"), last["b"].bitwiseXOR(m["b"]).alias("b"))))

    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return rolled.select("conv_id", "part", "offset", "items", "n_turns", F.aggregate("marks", empty, roll).alias("prefixes"))


def maximal_conversations(blocks: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that no other one continues or repeats.

    Prefix keys and whole-conversation keys are combined on the map side
    before they meet, so a first turn or a conversation that is logged many
    times is one row on either side of the anti join.
    """
    keys = blocks.select("conv_id", "n_turns", "offset", F.posexplode("prefixes").alias("i", "hash")).select(
        "conv_id", "n_turns", (F.col("offset") + F.col("i") + 1).alias("k"), "hash.a", "hash.b"
    )
    whole = keys.where("k = n_turns").groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    longer = keys.where("k < n_turns").select("k", "a", "b").distinct()
    return whole.join(longer, ["k", "a", "b"], "left_anti").select("conv_id", F.col("k").alias("n_turns"))


def render(items: Column) -> Column:
    """Turns as ``<|im_start|>role``, a line feed, the text and ``<|im_end|>``; markers inside texts lose their shape."""

    def one(x: Column) -> Column:
        role = F.lower(F.trim(x["role"]))
        name = F.when(role == "", F.lit("user")).otherwise(F.replace(role, F.lit("<|"), F.lit("< |")))
        return F.concat(F.lit("<|im_start|>"), name, F.lit("\n"), F.replace(x["text"], F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))

    return F.array_join(F.transform(items, one), "")


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, part, first_turn, n_turns, rendered`` of the maximal conversations.

    A conversation logged again with more turns replaces its snapshots; of
    equal conversations the smallest ``conv_id`` stays. ``part`` counts the
    blocks of a conversation from 1: one for up to ``block`` turn numbers, and
    the parts joined in order are the whole text. ``first_turn`` is the
    position of the part's first turn, from 1; ``n_turns`` counts the whole
    conversation.

    Rows without ``conv_id`` belong to no conversation and are left out. Null
    roles and texts count as empty, an empty role is shown as ``user``. A null
    ``turn`` comes first. Repeated rows count once; different rows with one
    turn number follow each other by role, then text. Other columns are ignored.
    """
    blocks = written(turn_blocks(turns, block), "chats")
    kept = maximal_conversations(blocks).select("conv_id")
    return blocks.join(kept, "conv_id", "left_semi").select(
        "conv_id", "part", (F.col("offset") + 1).alias("first_turn"), "n_turns", render(F.col("items")).alias("rendered")
    )
