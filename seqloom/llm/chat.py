"""Chat formatting by quotation linking: replies find what they quote, and conversations lose their quotes.

A line's quote level is the number of ``>`` marks before its text. Runs of lines of one level are passages;
a passage, its paragraphs and its lines are units, and each unit is normalised (case
and white space) and hashed. The text that is a message's own (level 0) gives units in the same way, and
a quoted unit links to the first message that has it: the first of the same conversation if it is earlier,
otherwise, if it has ``MIN_WORDS`` words or more, the first of all messages, if that is earlier in the order of
(conv_id, turn). So a link always points back, and a line that a third of all messages have leads to one message, not to all of them.

A message replies to the one of which it quotes most words at the lowest level. Chains of replies
are followed by doubling up to their first message, in whose conversation they stand: by its turn, then
by depth, then by their own conv_id and turn. Places are counted in ranges, and ranges of ranges, of turns and of those who reply. So neither a
conversation of any length nor all replies to one message are ever in one task.

Defined results: null text has no units and stays null; a text of quotes alone becomes empty; a null
conv_id or turn neither quotes nor is quoted, and such rows come last in their conversation, in the order of a hash; equal rows get places
of their own; texts are parsed whole, in time in proportion to their length; other columns take no part; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Words of a unit that links across conversations, at least; a shorter one says too little outside its own.
MIN_WORDS = 3
_MARKS = re.compile(r"(?:[ \t]*>)+ ?")
_SAID = re.compile(r"(?:wrote|writes|schrieb|écrit|escribió)\s*:\s*$", re.IGNORECASE)
#: Turns of a block, conversations and turns of a cell, in which places are counted.
BLOCK = 1024


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of every line; a line that announces a quote belongs to it."""
    out = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        out.append((marks.group().count(">"), line[marks.end() :]) if marks else (0, line))
    follow = 0  # the level of the next line that says something
    for i in range(len(out) - 1, -1, -1):
        level, line = out[i]
        if follow > level and _SAID.search(line):
            out[i] = (-1, line)
        if level or line.strip():
            follow = level
    return out


def units(lines: list[str]) -> dict[int, int]:
    """Hash -> words, of the whole, its paragraphs and its lines."""
    parts = [" ".join(lines), *lines]
    paragraph: list[str] = []
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
        elif paragraph:
            parts.append(" ".join(paragraph))
            paragraph = []
    out = {}
    for part in {" ".join(x.casefold().split()) for x in parts}:
        if part:
            out[int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)] = part.count(" ") + 1
    return out


def parse(text: str) -> tuple[str, dict[int, int], list[tuple[int, int, int]], int]:
    """Own text, own units, quoted units (level, hash, words), and the number of quoted lines."""
    lines = levels(text)
    own = [line for level, line in lines if level == 0]
    quoted: dict[tuple[int, int], int] = {}
    run: list[str] = []
    for i, (level, line) in enumerate(lines):
        run.append(line)
        if i + 1 == len(lines) or lines[i + 1][0] != level:
            if level > 0:
                quoted |= {(level, h): n for h, n in units(run).items()}
            run = []
    n_quoted = sum(level > 0 for level, _ in lines)
    clean = "\n".join(own).strip() if n_quoted else text
    return clean, units(own), [(level, h, n) for (level, h), n in sorted(quoted.items())], n_quoted


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, units, quotes, n_quoted) of (conv_id, turn, role, text)."""
    pair = pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, mine, quotes, counts = [], [], [], []
            for text in batch.column(3).to_pylist():
                clean, has, quoted, n = parse(text) if text is not None else (None, {}, [], 0)
                own.append(clean)
                mine.append(list(has))
                quotes.append([{"level": a, "hash": b, "words": c} for a, b, c in quoted])
                counts.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.string()), pa.array(mine, pa.list_(pa.int64())), pa.array(quotes, pa.list_(pair)), pa.array(counts, pa.int32())], names=["conv_id", "turn", "role", "own", "units", "quotes", "n_quoted"])

    return messages.mapInArrow(run, "conv_id bigint, turn bigint, role string, own string, units array<bigint>, quotes array<struct<level:int,hash:bigint,words:int>>, n_quoted int")


def links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, to_conv, to_turn): what each message that quotes replies to."""
    placed = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = placed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.words").distinct()
    asked = quoted.select("hash").distinct()
    has = placed.select("conv_id", "turn", F.explode("units").alias("hash")).join(asked, "hash", "left_semi")
    near = has.groupBy("hash", "conv_id").agg(F.min("turn").alias("near_turn"))
    first = near.groupBy("hash").agg(F.min(F.struct("conv_id", "near_turn")).alias("first"))
    found = quoted.join(near, ["hash", "conv_id"], "left").join(first, "hash", "left")
    here = F.when(F.col("near_turn") < F.col("turn"), F.struct("conv_id", F.col("near_turn")))
    back = (F.col("first.conv_id") < F.col("conv_id")) | ((F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.near_turn") < F.col("turn")))
    found = found.withColumn("to", F.coalesce(here, F.when(back & (F.col("words") >= MIN_WORDS), F.col("first")))).where("to IS NOT NULL")
    weighed = found.groupBy("conv_id", "turn", "level", F.col("to.conv_id").alias("to_conv"), F.col("to.near_turn").alias("to_turn")).agg(F.sum("words").alias("words"))
    best = weighed.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "words", F.col("to_turn"), F.col("to_conv"))).alias("best"))
    return best.select("conv_id", "turn", F.col("best.to_conv").alias("to_conv"), F.col("best.to_turn").alias("to_turn"))


def roots(replies: DataFrame, rounds: int = 64) -> DataFrame:
    """``replies`` with the first message of each chain (root_conv, root_turn) and the ``depth`` below it; by doubling."""
    known = cut(replies.select("conv_id", "turn", F.col("to_conv").alias("root_conv"), F.col("to_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")))
    for _ in range(rounds):
        up = known.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("up_conv"), F.col("root_turn").alias("up_turn"), F.col("depth").alias("up_depth"))
        moved = known.join(up, ["root_conv", "root_turn"], "left")
        known = cut(moved.select("conv_id", "turn", F.coalesce("up_conv", "root_conv").alias("root_conv"), F.coalesce("up_turn", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), F.col("up_conv").isNotNull().alias("moved")))
        if not known.where("moved").limit(1).count():
            return known.drop("moved")
        known = known.drop("moved")
    raise RuntimeError("reply chains did not end")


def _range(name: str):
    return F.coalesce(F.floor(F.col(name) / BLOCK), F.lit(2**62))


def _ranges() -> dict:
    """Where a row stands in its conversation, from coarse to fine: ``block`` (a range of root turns), ``cell`` (one root turn, one depth
    and a range of the conversations that reply) and ``row`` (one of them and a range of its turns).

    Each level's values stand in the order of the rows. Rows without a turn, which have no order of their own, are dealt by a hash.
    """
    last = F.lit(2**62)
    spread = F.when(F.col("turn").isNull(), F.pmod(F.xxhash64("role", "own"), F.lit(4096))).otherwise(F.lit(0)).cast("long")
    return {
        "block": _range("root_turn"),
        "cell": F.struct(F.coalesce("root_turn", last).alias("root"), F.col("depth"), _range("conv_id").alias("convs")),
        "row": F.struct(F.coalesce("conv_id", last).alias("conv"), _range("turn").alias("turns"), spread.alias("hash")),
    }


def _starts(placed: DataFrame) -> DataFrame:
    """(of, of_block, of_cell, of_row, start): the rows of a conversation before each ``row``, summed up level by level."""
    sums = placed.groupBy("conversation_id", "block", "cell", "row").agg(F.count("*").alias("n"))
    names = ["conversation_id", "block", "cell", "row"]
    out = None
    for depth in (3, 2, 1):
        keys = names[: depth + 1]
        upto = W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
        level = sums.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        level = level.select(F.col("conversation_id").alias("of"), *[F.col(k).alias(f"of_{k}") for k in keys[1:]], F.col("before").alias("start"))
        if out is None:
            out = level
        else:
            a, b = out.alias("a"), level.withColumnRenamed("start", "more").alias("b")
            meets = F.col("a.of").eqNullSafe(F.col("b.of"))
            for k in keys[1:]:
                meets &= F.col(f"a.of_{k}") == F.col(f"b.of_{k}")
            out = a.join(b, meets).select("a.of", *[f"a.of_{k}" for k in names[1:]], (F.col("start") + F.col("more")).alias("start"))
    return out


def format_chats(messages: DataFrame) -> DataFrame:
    """One row a message: its conversation, place and depth there, what it replies to, and its text without quotes.

    ``chat`` is the message as a training record has it: a role line, then the text.
    """
    rows = cut(parsed(messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "text")))
    replies = cut(links(rows))
    chains = roots(replies).join(replies, ["conv_id", "turn"])
    placed = rows.select("conv_id", "turn", "role", "own", "n_quoted").join(chains, ["conv_id", "turn"], "left")
    placed = placed.withColumns({"conversation_id": F.coalesce("root_conv", "conv_id"), "root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0))})
    placed = cut(placed.withColumns(_ranges()))
    starts = _starts(placed)
    levels_ = ["block", "cell", "row"]
    nth = F.row_number().over(W.partitionBy("conversation_id", *levels_).orderBy(F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), "role", "own"))
    meets = F.col("conversation_id").eqNullSafe(F.col("of"))
    for level in levels_:
        meets &= F.col(level) == F.col(f"of_{level}")
    numbered = placed.withColumn("nth", nth - 1).join(starts, meets)
    return numbered.select(
        "conv_id", "turn", "role", "conversation_id", (F.col("start") + F.col("nth")).cast("long").alias("place"), "depth",
        F.col("to_conv").alias("reply_conv"), F.col("to_turn").alias("reply_turn"), "n_quoted", F.col("own").alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("own", F.lit(""))).alias("chat"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all conversations in reply order, without quotes."""
    return format_chats(table(spark, sf_dir, "conversations"))
