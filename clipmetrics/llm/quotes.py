"""Conversations without quotes, in reply order, by quotation linking. DataFrame expressions only.

A line that begins with `>` quotes a message, one level for each mark. Runs of lines of one level are passages. Quoted
passages and their lines are normalised and hashed; the same hashes of the messages' own words lead to the original,
which is the first message that says so, in the same conversation if there is one. The original of the shallowest
quotes is what a message replies to; following these links gives its thread, and threads are laid out in reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmetrics.session import written

MARKS = r"^\s*(?:>\s?)+"
#: A line of this form only announces a quote.
ANNOUNCES = r"(?i)^\s*on\b.{1,200}\bwrote:\s*$"
PASSAGES = "array<struct<level:int,text:string>>"


def normalised(text: Column) -> Column:
    """Lower-cased words and numbers, one space apart."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def lines(text: Column) -> Column:
    """Every line with its quote level and without its marks; announcements of quotes are left out."""
    rows = F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\r?\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), r"[^>]", "")).alias("level"),
            F.regexp_replace(line, MARKS, "").alias("text")))
    return F.filter(rows, lambda x: (x["level"] > 0) | ~x["text"].rlike(ANNOUNCES))


def passages(of_lines: Column) -> Column:
    """Runs of lines of one level, as one text each."""

    def add(found: Column, line: Column) -> Column:
        last = F.element_at(found, -1)
        longer = F.concat(
            F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))),
            F.array(F.struct(last["level"].alias("level"), F.concat_ws("\n", last["text"], line["text"]).alias("text"))))
        return F.when((F.size(found) > 0) & (F.try_element_at(found, F.lit(-1))["level"] == line["level"]), longer).otherwise(
            F.concat(found, F.array(line)))

    return F.aggregate(of_lines, F.array().cast(PASSAGES), add)


def messages(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per distinct message with its own words, passages and an id of its content."""
    rows = df.select(
        df[conversation].cast("long").alias("conv_id"), df[turn].cast("long").alias("turn"), df[role].cast("string").alias("role"),
        df[text].cast("string").alias("text")).distinct()
    rows = rows.withColumn("lines", lines(F.col("text")))
    own = F.filter("lines", lambda x: x["level"] == 0)
    content = F.trim(F.concat_ws("\n", F.transform(own, lambda x: x["text"])))
    return rows.select(
        "conv_id", "turn", F.xxhash64("conv_id", "turn", "role", "text").alias("message"), "role",
        F.regexp_replace(content, r"\n{3,}", "\n\n").alias("content"), "lines", passages(F.col("lines")).alias("passages"))


def _hashes(rows: DataFrame, quoted: bool) -> DataFrame:
    """Hashes of the passages and of the single lines of either the quotes or a message's own words."""
    level = (lambda x: x["level"] > 0) if quoted else (lambda x: x["level"] == 0)
    pieces = F.array_distinct(F.concat(
        F.transform(F.filter("passages", level), lambda x: F.struct(x["level"].alias("level"), F.lit(True).alias("whole"), normalised(x["text"]).alias("text"))),
        F.transform(F.filter("lines", level), lambda x: F.struct(x["level"].alias("level"), F.lit(False).alias("whole"), normalised(x["text"]).alias("text")))))
    return (
        rows.select("conv_id", "turn", "message", F.inline(F.filter(pieces, lambda x: x["text"] != "")))
        .withColumn("hash", F.sha2("text", 256)).drop("text")
    )


def replies(rows: DataFrame) -> DataFrame:
    """message, parent (a struct), linked: the message that each quoting message replies to.

    Of a hash only its first holder counts, found by an aggregate, so a passage that very many messages hold is one
    row to join and no pair of its holders is formed. Whole passages go before single lines, shallow quotes before
    deep ones, and of several originals the latest is replied to.
    """
    place = F.struct("conv_id", "turn", "message")
    own = _hashes(rows, quoted=False)
    inside = own.where("conv_id is not null").groupBy("conv_id", "hash").agg(F.min(place).alias("near"))
    anywhere = own.where("conv_id is not null").groupBy("hash").agg(F.min(place).alias("far"))
    quoted = _hashes(rows, quoted=True)
    found = (
        quoted.join(inside, ["conv_id", "hash"], "left").join(anywhere, "hash", "left")
        .withColumn("near", F.when(F.col("near.turn") < F.col("turn"), F.col("near")))
        .withColumn("far", F.when((F.col("far.conv_id") < F.col("conv_id")), F.col("far")))
        .withColumn("original", F.coalesce("near", "far")).where("original is not null")
    )
    rank = F.struct((F.col("near").isNotNull()).alias("near"), F.col("whole").alias("whole"), (-F.col("level")).alias("shallow"), F.col("original").alias("original"))
    return found.groupBy("message").agg(F.max(rank)["original"].alias("parent"), F.count_distinct("hash").alias("linked"))


def threads(links: DataFrame) -> DataFrame:
    """message, root, depth of every message with a parent, by doubling the reach of the links in every round.

    A parent is an earlier message, so links have no cycle and the rounds end after the logarithm of the longest chain.
    """
    now = written(links.select("message", "parent", F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        above = now.select(F.col("message").alias("m"), F.col("parent").alias("up"), F.col("depth").alias("more"))
        joined = now.join(above, F.col("parent.message") == F.col("m"), "left")
        if joined.where("m is not null").isEmpty():
            return now.select("message", F.col("parent").alias("root"), "depth")
        now = written(joined.select(
            "message", F.coalesce("up", "parent").alias("parent"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")


def linked_messages(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per distinct message, without its quotes and with what it replies to.

    conv_id, turn, role, content; quote_depth and quotes (levels and number of quoted passages), linked (quoted
    passages and lines whose original was found); parent_conv, parent_turn and depth of the reply; thread_conv and
    thread_turn, the first message of its thread. A message whose quotes lead to another conversation joins the
    thread there; one without linked quotes stays in its conversation's own thread at depth 0.

    Repeated rows are one message. A null text is empty, a null role stays null. Messages without conversation or
    turn cannot be placed: they link to nothing and nothing links to them unless both are given. An empty table gives
    no rows; other columns are ignored.
    """
    rows = written(messages(df, conversation, turn, role, text), "messages")
    links = written(replies(rows.where("conv_id is not null and turn is not null")), "quotes")
    found = links.join(threads(links.select("message", "parent")), "message")
    quotes = F.filter("passages", lambda x: (x["level"] > 0) & (normalised(x["text"]) != ""))
    return rows.join(found, "message", "left").select(
        "conv_id", "turn", "role", "content",
        F.coalesce(F.array_max(F.transform(quotes, lambda x: x["level"])), F.lit(0)).alias("quote_depth"),
        F.size(quotes).alias("quotes"), F.coalesce("linked", F.lit(0)).cast("int").alias("linked"),
        F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("root.conv_id", "conv_id").alias("thread_conv"),
        F.when(F.col("root").isNotNull(), F.col("root.turn")).alias("thread_turn"), "message")


def conversations(linked: DataFrame, segment: int = 64) -> DataFrame:
    """thread_conv, segment, n_messages, n_replies, chat: conversations in reply order, quotes removed.

    A thread holds a conversation's messages and those of other conversations that reply to it, by conversation and
    turn, so every original comes before its replies. A conversation beyond `segment` turns is cut into segments by
    turn, so no group grows with it. Each message is a line with its role in brackets, what it replies to as
    @conversation:turn, and its words below. Messages without a place are conversations of their own.
    """
    own = F.coalesce("thread_conv", F.lit(None).cast("long"))
    reply = F.when(F.col("parent_turn").isNotNull(), F.concat(F.lit(" @"), "parent_conv", F.lit(":"), "parent_turn")).otherwise("")
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("]"), reply, F.lit("\n"), "content")
    alone = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), F.col("message"))
    part = F.coalesce(F.floor(F.col("turn") / segment), F.lit(0))
    grouped = linked.groupBy(own.alias("thread_conv"), F.col("conv_id"), alone.alias("alone"), part.alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), line.alias("line")))).alias("lines"),
        F.count(F.lit(1)).alias("n_messages"), F.count("parent_turn").alias("n_replies"))
    return grouped.select(
        "thread_conv", "conv_id", "segment", "n_messages", "n_replies",
        F.concat_ws("\n\n", F.transform("lines", lambda x: x["line"])).alias("chat"))
