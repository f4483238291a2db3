"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that begin with one or more ``>`` are quotes, nested as deep as there are marks. Runs of quoted lines of
one level are passages. A passage, and each of its lines, is normalised, hashed and joined to the message
that first wrote it: in the same conversation before the quoting message, or else the first of all other
conversations, whose ids say nothing of time. So a hash leads to one message, and however often a line was
written or quoted, rows are never paired with each other. A message replies to the original of its shallowest quotes, or without one to the opening
message of its conversation. Where replies form a cycle, the least message in it goes back to its
opening. So replies form trees, whose roots and order pointer doubling finds; a tree is a
conversation without quotes, depth first: each message, then each reply to it with all that follows from it, by conversation and turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlab.llm.store import numbered, possibly, running, spread_join, written

_MARKS = r"^(?:\s*>)+"
#: A line that introduces the quote below it.
_INTRODUCES = r"(?i)\bwrote:\s*$"


def level(line: Column) -> Column:
    """The number of quotation marks that the line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", ""))


def normalised(text: Column) -> Column:
    """Without marks, in lower case, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, _MARKS, "")), r"\s+", " "))


def _parsed(messages: DataFrame) -> DataFrame:
    """row, conv_id, turn, role, lines, own_text, quoted_lines, max_level."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = messages.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", lines.alias("lines"))
    levels = rows.withColumn("levels", F.transform("lines", level))
    quoted_below = lambda i: F.coalesce(F.get("levels", i + 1), F.lit(0)) > 0
    own = F.filter("lines", lambda line, i: (F.get("levels", i) == 0) & ~(line.rlike(_INTRODUCES) & quoted_below(i)))
    return levels.select(
        "row", "conv_id", "turn", "role", "lines",
        F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "").alias("own_text"),
        F.size(F.filter("levels", lambda n: n > 0)).alias("quoted_lines"),
        F.array_max("levels").alias("max_level"),
    )


def _quotes(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, whole, hash, words: the passages and the lines that messages quote."""
    lines = parsed.where("quoted_lines > 0").select("row", "conv_id", "turn", F.posexplode("lines").alias("at", "line"))
    lines = lines.withColumn("level", level(F.col("line"))).where("level > 0").withColumn("text", normalised(F.col("line")))
    run = F.col("at") - F.row_number().over(Window.partitionBy("row", "level").orderBy("at"))
    passages = lines.withColumn("run", run).groupBy("row", "conv_id", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    passages = passages.select("conv_id", "turn", "level", F.lit(True).alias("whole"), normalised(F.array_join("parts.text", " ")).alias("text"))
    both = passages.unionByName(lines.select("conv_id", "turn", "level", F.lit(False).alias("whole"), "text")).where("text <> ''")
    return both.select("conv_id", "turn", "level", "whole", F.md5("text").alias("hash"), F.size(F.split("text", " ")).alias("words"))


def _written_first(parsed: DataFrame, quotes: DataFrame) -> DataFrame:
    """conv_id, hash, turn: the first message of each conversation with a text or line of its own, for those that may be quoted: only
    they are shuffled."""
    texts = F.array_distinct(F.concat(F.array(normalised(F.regexp_replace("own_text", "\n", " "))), F.transform(F.split("own_text", "\n"), normalised)))
    hashes = parsed.select("conv_id", "turn", F.explode(F.filter(texts, lambda t: t != "")).alias("text")).select("conv_id", "turn", F.md5("text").alias("hash"))
    return possibly(hashes, "hash", quotes)[0].groupBy("conv_id", "hash").agg(F.min("turn").alias("turn"))


def _replies(quotes: DataFrame, first: DataFrame) -> DataFrame:
    """conv_id, turn, to_conv, to_turn: the message that a quoting message answers."""
    place, number = F.struct("conv_id", "hash").alias("place"), F.count(F.lit(1)).alias("n")
    here = first.select(place, F.col("turn").alias("here"))
    ever = first.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("ever"))
    counts = written(quotes.groupBy("hash").agg(number), "quote-hashes")
    asked = spread_join(spread_join(quotes.select("*", place), here, "place", "turn", "left").drop("place"), ever, "hash", "conv_id", "left", counts)
    same = F.coalesce(F.col("here") < F.col("turn"), F.lit(False))
    own = F.col("ever.conv_id") == F.col("conv_id")  # the first of all is in the quoting conversation, but not before
    skipped = asked.where(~same & own).groupBy("hash").agg(F.first("conv_id").alias("skipped"))  # one: that of the first of all
    others = spread_join(first, skipped, "hash", "conv_id").where("conv_id <> skipped").groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("other"))
    elsewhere = F.when(own, F.col("other")).otherwise(F.col("ever"))
    found = spread_join(asked, others, "hash", "conv_id", "left", counts).withColumn("to", F.when(same, F.struct("conv_id", F.col("here").alias("turn"))).otherwise(elsewhere))
    found = found.where("to is not null").groupBy("conv_id", "turn", "level", same.alias("same"), "whole", "to").agg(F.sum("words").alias("words"))
    best = F.min(F.struct("level", (~F.col("same")).alias("s"), (~F.col("whole")).alias("w"), (-F.col("words")).alias("n"), F.col("to.conv_id").alias("c"), F.col("to.turn").alias("t"))).alias("b")
    return found.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("b.c").alias("to_conv"), F.col("b.t").alias("to_turn"))


def _without_cycles(nodes: DataFrame) -> DataFrame:
    """nodes (conv_id, turn, opens, linked, to_conv, to_turn) whose replies form trees.

    Of each cycle the least message, whose reply is a quote of a greater one, loses this link and hangs under its
    opening. That may close another cycle, so it is repeated; without a link to a greater message there is none.
    """
    node, to = F.struct("conv_id", "turn"), F.struct(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn"))
    while nodes.where(F.col("linked") & (to > node)).limit(1).count():
        at, reach, before = nodes.where("to_conv is not null").select(node.alias("node"), to.alias("to"), node.alias("least")), 1, -1
        while True:
            at = written(at, "reply-cycles")
            left = at.count()
            if not left or (left == before and reach >= left):
                break
            up = at.select(F.col("node").alias("to"), F.col("to").alias("up_to"), F.col("least").alias("up_least"))
            at = spread_join(at, up, "to", "node").select("node", F.col("up_to").alias("to"), F.least("least", "up_least").alias("least"))  # what ends in a root leaves
            reach, before = 2 * reach, left
        if not left:
            break
        cut = at.join(at.select(F.col("to").alias("node")).distinct(), "node").select(F.col("least.conv_id").alias("conv_id"), F.col("least.turn").alias("turn"), F.lit(True).alias("cut")).distinct()
        kept, opening = F.col("cut").isNull(), F.col("turn") == F.col("opens")
        nodes = nodes.join(cut, ["conv_id", "turn"], "left").select(
            "conv_id", "turn", "opens", (F.col("linked") & kept).alias("linked"),
            F.when(kept, F.col("to_conv")).when(~opening, F.col("conv_id")).alias("to_conv"),
            F.when(kept, F.col("to_turn")).when(~opening, F.col("opens")).alias("to_turn"),
        )
        nodes = written(nodes, "replies")
    return nodes


def _threads(nodes: DataFrame) -> DataFrame:
    """node, root, steps (to the root) and preorder (messages of the thread before it, depth first) of nodes (conv_id, turn, to_conv, to_turn).

    By pointer doubling: in each round a message learns the root pointer of the message that it points to, and what is
    exactly so far above it gains the messages below. A message then stands behind the one it replies to and the whole branches of
    the earlier replies to that; these offsets are summed on the way to the root, again by doubling. What points to a
    message that very many point to is dealt out.
    """
    own, to = F.struct("conv_id", "turn"), F.struct(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn"))
    answers = F.col("to_conv").isNotNull()
    at = written(nodes.select(own.alias("node"), F.when(answers, to).otherwise(own).alias("root"), answers.cast("long").alias("steps"), F.lit(1).cast("long").alias("below")), "threads")
    replies, reach, moved = at.where("steps > 0").select("node", F.col("root").alias("to")), 1, True
    first = at
    while moved:
        gains = at.where(F.col("steps") == reach).groupBy(F.col("root").alias("node")).agg(F.sum("below").alias("gain"))
        up = at.select(F.col("node").alias("root"), F.col("root").alias("up_root"), F.col("steps").alias("up_steps"))
        further = spread_join(at.join(gains, "node", "left"), up, "root", "node")
        then = further.select("node", F.col("up_root").alias("root"), (F.col("steps") + F.col("up_steps")).alias("steps"), (F.col("below") + F.coalesce("gain", F.lit(0))).alias("below"), (F.col("up_steps") > 0).alias("moved"))
        at = written(then, "threads", *([] if at is first else [at]))
        moved, reach = bool(at.where("moved").limit(1).count()), 2 * reach
    deepest = at.agg(F.max("steps")).first()[0] or 0
    sized = replies.join(at.select("node", "below"), "node")
    offsets = running(sized, ["to"], ["node"], "below", "before").select("node", F.col("to").alias("up"), (F.col("before") + 1).alias("preorder"))
    place = written(offsets.unionByName(at.where("steps = 0").select("node", F.col("node").alias("up"), F.lit(0).cast("long").alias("preorder"))), "thread-places", first)
    reach = 1
    while reach < deepest:
        above = place.select(F.col("node").alias("up"), F.col("up").alias("up_up"), F.col("preorder").alias("more"))
        further = spread_join(place, above, "up", "node")
        place = written(further.select("node", F.col("up_up").alias("up"), (F.col("preorder") + F.col("more")).alias("preorder")), "thread-places", place)
        reach *= 2
    return at.select("node", "root", "steps").join(place.select("node", "preorder"), "node")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, quoted_lines, max_level, linked (by a quote), reply_conv, reply_turn,
    thread_conv, thread_turn (the tree's root), reply_level and position (from 0 in the thread), a row for each of messages.

    A null text is empty. Rows with one conv_id and turn are one message: it replies to the first that any of
    them quotes. Rows without conv_id or turn have no thread, reply or position, but are parsed. Columns other
    than conv_id, turn, role and text are not read. conv_id and turn may have any type that has an order.
    """
    parsed = written(_parsed(messages), "messages")
    placed = parsed.where("conv_id is not null and turn is not null")
    quotes = written(_quotes(placed), "quotes")
    replies = _replies(quotes, written(_written_first(placed, quotes), "written-first"))
    opening = placed.groupBy("conv_id").agg(F.min("turn").alias("opens"))
    nodes = spread_join(placed.select("conv_id", "turn").distinct().join(replies, ["conv_id", "turn"], "left"), opening, "conv_id", "turn")
    linked, opens = F.col("to_conv").isNotNull(), F.col("turn") == F.col("opens")
    nodes = nodes.select(
        "conv_id", "turn", "opens", linked.alias("linked"),
        F.when(linked, F.col("to_conv")).when(~opens, F.col("conv_id")).alias("to_conv"),
        F.when(linked, F.col("to_turn")).when(~opens, F.col("opens")).alias("to_turn"),
    )
    nodes = _without_cycles(written(nodes, "replies"))
    place = F.struct("conv_id", "turn").alias("place")
    threads = nodes.select(place, "linked", F.col("to_conv").alias("reply_conv"), F.col("to_turn").alias("reply_turn")).join(_threads(nodes).withColumnRenamed("node", "place"), "place")
    threads = threads.select("place", "linked", "reply_conv", "reply_turn", F.col("root.conv_id").alias("thread_conv"), F.col("root.turn").alias("thread_turn"), F.col("steps").alias("reply_level"), "preorder")
    found = spread_join(parsed.drop("lines").select("*", place), threads, "place", "row", "left").drop("place")
    inside = numbered(found.where("thread_conv is not null"), ["thread_conv", "thread_turn"], ["preorder", "row"], "position")
    out = inside.unionByName(found.where("thread_conv is null"), allowMissingColumns=True)
    columns = ("conv_id", "turn", "role", "own_text", "quoted_lines", "max_level", "linked", "reply_conv", "reply_turn", "thread_conv", "thread_turn", "reply_level", "position")
    return out.select(*columns)


def conversations(linked: DataFrame, part_messages: int = 1000) -> DataFrame:
    """thread_conv, thread_turn, part and messages (position, role, own_text) in reply order; a long thread
    is cut into parts of so many messages."""
    message = F.struct("position", "role", "own_text")
    part = F.floor(F.col("position") / part_messages).alias("part")
    return linked.where("thread_conv is not null").groupBy("thread_conv", "thread_turn", part).agg(F.array_sort(F.collect_list(message)).alias("messages"))
