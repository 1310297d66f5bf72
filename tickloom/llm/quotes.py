"""Quotation linking: replies tied to what they quote, in reply order, without quotes (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.llm.common import prefix_max, text_or_empty
from tickloom.plans.ranking import number_rows
from tickloom.session import stage

#: Marks in front of a quoted line: one ">" per level, with blanks between them.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
MESSAGE = ("conv_id", "turn", "hash")
#: Words that a sentence needs to be a key, and any passage to be sought in other conversations.
MIN_WORDS = 3


def normalised(text: Column) -> Column:
    """What stays of a passage when it is quoted and wrapped anew: its words in lower case."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """One row per line: message, ``line``, quote ``level`` (0: the message's own) and ``body``."""
    rows = messages.select(*MESSAGE, F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    marks = F.regexp_extract("raw", MARKS, 0)
    return rows.select(
        *MESSAGE, "line", F.regexp_count(marks, F.lit(">")).alias("level"), F.regexp_replace("raw", MARKS, "").alias("body")
    )


def quoted_passages(messages: DataFrame) -> DataFrame:
    """Runs of consecutive lines of one level above 0: message, ``passage`` number, ``level`` and ``body``."""
    some = messages.where(F.col("text").rlike(r"(?m)" + MARKS))
    lines = quoted_lines(some)
    order = W.partitionBy(*MESSAGE).orderBy("line")
    starts = (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")
    runs = lines.withColumn("new", starts).withColumn("passage", F.sum("new").over(order))
    texts = runs.where("level > 0").groupBy(*MESSAGE, "passage", "level").agg(F.sort_array(F.collect_list(F.struct("line", "body"))).alias("l"))
    return texts.select(*MESSAGE, "passage", "level", F.array_join(F.transform("l", lambda x: x["body"]), "\n").alias("body"))


def own_text(text: Column) -> Column:
    """The lines of a message that are not quoted."""
    own = F.filter(F.split(text, r"\r?\n"), lambda x: ~x.rlike(MARKS))
    return F.when(text.rlike(r"(?m)" + MARKS), F.trim(F.array_join(own, "\n"))).otherwise(text)


def passage_keys(body: Column) -> Column:
    """Keys by which a passage can be known, as structs of ``key`` (hash) and ``words``.

    These are the whole, its paragraphs, its lines, and its sentences, which may run over lines; all normalised. A
    key met twice counts at its first place.
    """
    parts = F.concat(F.array(body), F.split(body, r"\r?\n[ \t]*\r?\n"), F.split(body, r"\r?\n"))
    sentences = F.transform(F.split(body, r"(?<=[.!?])\s+"), normalised)
    words = lambda x: F.size(F.split(x, " "))
    some = F.filter(F.transform(parts, normalised), lambda x: x != "")
    keys = F.array_distinct(F.concat(some, F.filter(sentences, lambda x: words(x) >= MIN_WORDS)))
    return F.transform(keys, lambda x: F.struct(F.xxhash64(x).alias("key"), words(x).alias("words")))


def far_holders(owned: DataFrame) -> DataFrame:
    """Per ``key`` the first own message (``far``) and that of the next conversation (``next_far``; null: none).

    Whoever quotes the key finds another conversation's message among the two. Turns are reduced per conversation and the
    two conversations picked before they are shuffled, so a key that all say costs no more than others.
    """
    first = owned.groupBy("key", "conv_id").agg(F.min("turn").alias("turn"))
    place = F.row_number().over(W.partitionBy("key").orderBy("conv_id"))
    two = first.withColumn("place", place).where("place <= 2")
    holder = lambda n: F.min(F.when(F.col("place") == n, F.struct("conv_id", "turn")))
    return two.groupBy("key").agg(holder(1).alias("far"), holder(2).alias("next_far"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """The message behind each quoted passage: message, ``passage``, ``level``, ``to_conv``, ``to_turn``.

    A key of the passage is sought among the own passages of earlier turns of the same conversation (the
    latest counts), else, if it has MIN_WORDS words, among all other conversations, whether their ids are smaller or larger
    (the first by conversation and turn). Of a passage's keys the one of the whole passage decides, then paragraphs, then
    lines, then sentences. Both sides are ordered by a range sort over (conversation, key) instead of joined, so frequent
    passages make no pairs and spread over many tasks.
    """
    quotes = quoted_passages(messages)
    quotes = quotes.select(*MESSAGE, "passage", "level", F.posexplode(passage_keys(F.col("body"))).alias("rank", "k"))
    quotes = stage(quotes.select("*", "k.key", "k.words").drop("k"), "quotes")
    wanted = quotes.select("key").distinct()
    owned = messages.select("conv_id", "turn", F.explode(passage_keys(own_text(F.col("text")))["key"]).alias("key"))
    owned = stage(owned.join(wanted, "key", "left_semi").distinct(), "owned")
    both = quotes.withColumn("own", F.lit(None).cast("long")).unionByName(
        owned.select("conv_id", "turn", "key", F.col("turn").cast("long").alias("own")), allowMissingColumns=True
    )
    # Quotes of a turn come before what that turn says itself.
    order = ["turn", F.col("rank").isNull()]
    near = stage(prefix_max(stage(both, "said"), ["conv_id", "key"], order, "own", "near").where("rank is not null"), "near")
    here = near.where("near is not null").select(
        *MESSAGE, "passage", "level", "rank", F.lit(0).alias("away"), F.col("conv_id").alias("to_conv"), F.col("near").alias("to_turn")
    )
    sought = near.where((F.col("near").isNull()) & (F.col("words") >= MIN_WORDS))
    other = F.when(~F.col("far.conv_id").eqNullSafe(F.col("conv_id")), F.col("far")).otherwise(F.col("next_far"))
    away = sought.join(far_holders(owned), "key").withColumn("t", other).where("t is not null").select(
        *MESSAGE, "passage", "level", "rank", F.lit(1).alias("away"), F.col("t.conv_id").alias("to_conv"), F.col("t.turn").cast("long").alias("to_turn")
    )
    best = here.unionByName(away).groupBy(*MESSAGE, "passage", "level").agg(F.min(F.struct("away", "rank", "to_conv", "to_turn")).alias("b"))
    return best.select(*MESSAGE, "passage", "level", "b.to_conv", "b.to_turn")


def thread_depths(links: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``root`` (turn) and ``depth`` of the messages that reply within their conversation.

    ``links`` (``conv_id``, ``turn``, ``up`` < turn). Pointers are doubled until all reach a message
    without a link; the rounds grow with the logarithm of the longest chain.
    """
    now = stage(links.select("conv_id", "turn", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        step = now.join(up, ["conv_id", "root"], "left")
        step = stage(step, "chains")
        if step.where("_root is not null").isEmpty():
            return step.select("conv_id", "turn", "root", "depth")
        now = step.select("conv_id", "turn", F.coalesce("_root", "root").alias("root"),
                          (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))


def format_chats(messages: DataFrame) -> DataFrame:
    """Conversations in reply order without quotes, one row per row of ``messages``.

    ``messages`` has ``conv_id``, ``turn``, ``role`` and ``text``. Columns: ``conv_id``,
    ``position`` (from 0), ``turn``, ``role``, ``text`` (own lines), ``reply_to_conv`` and
    ``reply_to_turn`` (of the first quoted passage of the lowest level that is found), ``root_turn``
    and ``depth`` in the thread, ``n_quoted`` passages and ``n_linked`` of them. Threads follow each
    other by the turn of their root; in a thread answers come after what they answer.

    Null texts stay null and quote nothing; a quote that is found nowhere is taken out all the
    same. Quotes of other conversations are linked but start no thread. Null conversations, turns and
    roles are kept, nulls first. Repeated rows are kept, each at a position of its own, and rows that share
    conversation, turn and text share their links. An empty table gives an empty result; other columns
    are ignored. Positions come from a range sort, so one long conversation spreads over tasks.
    """
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.xxhash64("text").alias("hash"))
    distinct = rows.select("conv_id", "turn", "hash", text_or_empty("text").alias("text")).dropDuplicates(list(MESSAGE))
    links = stage(link_quotes(distinct), "links")
    counted = quoted_passages(distinct).groupBy(*MESSAGE).agg(F.count(F.lit(1)).alias("n_quoted"))
    chosen = links.groupBy(*MESSAGE).agg(
        F.count(F.lit(1)).alias("n_linked"), F.min(F.struct("level", "passage", "to_conv", "to_turn")).alias("b")
    )
    counted = counted.select(*[F.col(c).alias(f"_{c}") for c in MESSAGE], "n_quoted")
    chosen = stage(counted.join(chosen, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in MESSAGE], "left").select(
        *[f"_{c}" for c in MESSAGE], "n_quoted", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
        F.col("b.to_conv").alias("reply_to_conv"), F.col("b.to_turn").alias("reply_to_turn"),
    ), "chosen")
    inside = chosen.where(F.col("reply_to_conv") == F.col("_conv_id")).groupBy("_conv_id", "_turn").agg(F.max("reply_to_turn").alias("up"))
    chains = thread_depths(inside.select(F.col("_conv_id").alias("conv_id"), F.col("_turn").alias("turn"), "up"))
    same = lambda *names: [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    met = rows.join(chosen, same(*MESSAGE), "left").drop(*[f"_{c}" for c in MESSAGE])
    chains = chains.select(F.col("conv_id").alias("_conv_id"), F.col("turn").alias("_turn"), F.col("root").alias("_root"), "depth")
    met = met.join(chains, same("conv_id", "turn"), "left")
    zero = F.lit(0).cast("long")
    out = met.select(
        "conv_id", "turn", "role", own_text(F.col("text")).alias("text"), "reply_to_conv", "reply_to_turn",
        F.coalesce("_root", "turn").alias("root_turn"), F.coalesce("depth", zero).alias("depth"),
        F.coalesce("n_quoted", zero).alias("n_quoted"), F.coalesce("n_linked", zero).alias("n_linked"), "hash",
    )
    placed = number_rows(stage(out, "chats"), ["conv_id"], ["root_turn", "depth", "turn", "role", "hash"], out="position")
    return placed.drop("hash")
