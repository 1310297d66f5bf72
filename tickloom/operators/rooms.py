"""Message rooms: numbering, history, transcripts and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.text import decode_messages
from tickloom.operators.bars import last_n
from tickloom.plans.ranking import number_rows

TRANSCRIPT_CHARS = 3000
# Fixed value: the mark after a cut transcript.
TRUNCATED = "...[truncated]"
MAX_ROOMS = 100
# A transcript line has at least "[] " and its line break.
_SHORTEST_LINE = 4


def assign_turns(msgs: DataFrame, order: Sequence, room: str = "room_id") -> DataFrame:
    """0-based turn of each message in its room, for rooms of any size."""
    return number_rows(msgs, [room], order, out="turn").withColumn("turn", F.col("turn").cast("int"))


def drop_orphans(msgs: DataFrame, rooms: DataFrame, room: str = "room_id") -> DataFrame:
    """Messages of registered rooms only."""
    return msgs.join(rooms.select(room).distinct(), room, "left_semi")


def room_history(msgs: DataFrame, room_id=None, room: str = "room_id") -> DataFrame:
    """Messages in order, one row each; of one room if given. An unknown room has none.

    The history stays in rows: a room of any size is sorted over the cluster, not put in a list.
    """
    chosen = msgs if room_id is None else msgs.filter(F.col(room) == F.lit(room_id))
    return chosen.select(room, "turn", "sender", "type", "text").orderBy(room, "turn")


def room_transcript(msgs: DataFrame, max_chars: int = TRANSCRIPT_CHARS, room: str = "room_id") -> DataFrame:
    """``[sender] text`` lines of each room, cut at ``max_chars`` with a marker.

    A line has at least four characters, so no more than ``max_chars`` / 4 + 1 messages per room can
    show up in the cut text, whatever their turn numbers are: only those are kept (limited before the
    shuffle) and collected, while the full length is summed over every message.
    """
    line = F.concat(F.lit("["), F.col("sender"), F.lit("] "), F.coalesce(F.col("text"), F.lit("")))
    lines = msgs.select(room, "turn", F.substring(line, 1, max_chars + 1).alias("line"))
    first = last_n(lines, [room], ["turn", "line"], max_chars // _SHORTEST_LINE + 1)
    heads = first.groupBy(room).agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("_head"))
    sizes = msgs.groupBy(room).agg(F.sum(F.length(line).cast("long") + 1).alias("_len"), F.count(F.lit(1)).alias("n_messages"))
    heads = heads.withColumnRenamed(room, "_room")
    rooms = sizes.join(heads, F.col(room).eqNullSafe(F.col("_room"))).drop("_room")
    joined = F.array_join(F.transform("_head", lambda m: m["line"]), "\n")
    n_chars = F.col("_len") - 1
    cut = F.concat(F.substring(joined, 1, max_chars), F.lit(TRUNCATED))
    return rooms.select(
        room,
        "n_messages",
        n_chars.alias("n_chars"),
        F.when(n_chars > max_chars, cut).otherwise(joined).alias("transcript"),
    )


def keep_newest_rooms(msgs: DataFrame, n: int = MAX_ROOMS, room: str = "room_id") -> DataFrame:
    """Messages of the ``n`` newest rooms. Rooms named ``room_<n>`` are ordered by number."""
    number = F.regexp_extract(F.col(room).cast("string"), r"(\d+)$", 1).try_cast("bigint")
    newest = (
        msgs.select(room).distinct().orderBy(F.desc_nulls_last(number), F.desc(room)).limit(n)
    )
    return msgs.join(newest, room, "left_semi")


def contributions_for(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages stored with the given ledger rows, one row each; none for unknown ids."""
    rows = ledger.join(ids.select("row_id").distinct(), "row_id", "left_semi")
    return rows.select("row_id", F.explode(decode_messages("agent_contributions")).alias("_m")).select(
        "row_id", "_m.turn", "_m.sender", "_m.type", "_m.text"
    )
