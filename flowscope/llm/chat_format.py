"""Conversations in reply order without quotes, from messages that quote each other.

Lines of a message have a quote level, the number of ``>`` before them.  Runs of lines of one
level are passages; those above level 0 are quotes.  A passage is one sequence of normalised
words, wherever its lines break.  Its runs of ``SHINGLE`` words and its whole lines are hashed
and joined to the first earlier message of the conversation that wrote the same itself; a
quoted line comes from the message that has most of its words, ``SHARE`` of them at least.
A message replies to the message it quotes most, or to the one before it.  A first reply
carries on its parent's thread, every further one begins a thread of its own; a message's
place in its thread comes from pointer doubling.  Everything is built-in column functions.

Defined results: rows with a null conversation or turn quote and continue nothing: each is
a thread of its own.  Messages with the same conversation and turn share their links.  A null
text is empty.  Of equally quoted messages the latest is replied to.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.llm.tables import cut, only

QUOTE = r"^(?:[ \t]*>)+[ \t]?"
# Turns of a conversation are numbered in pieces, so that no task sorts a whole one.
PIECE = 1024
MAX_ROUNDS = 64
SHINGLE = 3
SHARE = 0.75


def lines_of(text: Column) -> Column:
    """(level, text) of every line."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", ""))
    return F.transform(
        lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("text"))
    )


def passages_of(lines: Column) -> Column:
    """(level, lines) of every run of lines of one level."""
    last = F.size(lines) - 1
    starts = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, F.greatest(i - 1, F.lit(0)))["level"]),
    )
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(last + 1))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda r: F.struct(
            F.get(lines, r["a"])["level"].alias("level"),
            F.transform(F.slice(lines, r["a"] + 1, r["b"] - r["a"]), lambda x: x["text"]).alias("lines"),
        ),
    )


def normalised(text: Column) -> Column:
    """Lower case, words apart by one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def body_of(passages: Column) -> Column:
    """What the message itself says: its passages of level 0, without blank lines at either end."""
    own = F.flatten(F.transform(F.filter(passages, lambda p: p["level"] == 0), lambda p: p["lines"]))
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s*\n|\s+$", "")


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, passages."""
    lined = messages.select("conv_id", "turn", "role", lines_of(F.col("text")).alias("lines"))
    return lined.select("conv_id", "turn", "role", passages_of(F.col("lines")).alias("passages")).select(
        "conv_id", "turn", "role", body_of(F.col("passages")).alias("body"), "passages"
    )


def _units(rows: DataFrame, quoted: bool) -> DataFrame:
    """conv_id, turn, message, passage, level and what is compared of each passage, of quotes or of the message itself.

    A unit has a ``hash`` and ``cells``, the words under it as (pos, line, of), the place in the
    passage, the line and that line's number of words.  Units are whole lines (``whole``) and runs
    of ``SHINGLE`` words; a shorter passage is one run.
    """
    p = rows.select("conv_id", "turn", F.xxhash64("passages").alias("message"), F.posexplode("passages").alias("passage", "p"))
    p = p.filter(F.col("p.level") > 0 if quoted else F.col("p.level") == 0)
    keys = ["conv_id", "turn", "message", "passage", "level"]
    split = F.transform("p.lines", lambda x: F.filter(F.split(normalised(x), " "), lambda w: w != ""))
    # Exploded single elements are worked out once, not anew for each word.
    p = p.select("conv_id", "turn", "message", "passage", F.col("p.level").alias("level"), F.explode(F.array(split)).alias("lines"))
    at = F.flatten(F.transform("lines", lambda ws, i: F.transform(ws, lambda w: F.struct(i.alias("line"), F.size(ws).alias("of")))))
    p = p.select(*keys, "lines", F.explode(F.array(F.struct(F.flatten("lines").alias("words"), at.alias("at")))).alias("f"))
    p = p.select(*keys, "lines", F.col("f.words").alias("words"), F.col("f.at").alias("at")).filter(F.size("words") > 0)

    def unit(start: Column, n: Column, whole: bool) -> Column:
        cell = lambda j: F.struct(j.alias("pos"), F.get("at", j)["line"].alias("line"), F.get("at", j)["of"].alias("of"))
        cells = F.transform(F.sequence(start, start + n - 1), cell)
        text = F.array_join(F.slice("words", start + 1, n), " ")
        return F.struct(F.xxhash64(text).alias("hash"), F.lit(whole).alias("whole"), cells.alias("cells"))

    n = F.least(F.size("words"), F.lit(SHINGLE))
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: unit(i, n, False))
    # A line begins where the word before it belongs to another.
    begins = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: (i == 0) | (F.get("at", i)["line"] != F.get("at", F.greatest(i - 1, F.lit(0)))["line"]),
    )
    whole = F.transform(begins, lambda i: unit(i, F.get("at", i)["of"], True))
    return p.select(*keys, F.explode(F.concat(runs, whole)).alias("u")).select(*keys, "u.hash", "u.whole", "u.cells")


def quote_links(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, source, lines: how many quoted lines of a level came from which earlier message."""
    quoting = rows.filter(F.exists("passages", lambda p: p["level"] > 0))
    quotes = cut(_units(quoting, True), "quoted")
    copies = quoting.groupBy("conv_id", "turn", F.xxhash64("passages").alias("message")).agg(F.count(F.lit(1)).alias("copies"))
    wanted = quotes.select("conv_id", "hash").distinct()
    own = rows.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi")
    written = _units(own, False).select("conv_id", "turn", "hash", "whole").join(wanted, ["conv_id", "hash"], "left_semi")
    origin = written.groupBy("conv_id", "hash").agg(
        F.min("turn").alias("first"), F.min(F.when(F.col("whole"), F.col("turn"))).alias("first_whole")
    )
    # A whole line comes from the first that wrote it as a line, if there is one.
    exact = F.coalesce(F.col("whole") & (F.col("first_whole") < F.col("turn")), F.lit(False))
    met = quotes.join(origin, ["conv_id", "hash"]).withColumn("exact", exact)
    met = met.withColumn("source", F.when(F.col("exact"), F.col("first_whole")).otherwise(F.col("first"))).filter("source < turn")
    line = ["conv_id", "turn", "message", "passage", "level", "line"]
    words = met.select("conv_id", "turn", "message", "passage", "level", "exact", "source", F.explode("cells").alias("c"))
    words = words.select(*line[:-1], "exact", "source", "c.pos", "c.line", "c.of")
    shares = words.groupBy(*line, "of", "source").agg(
        F.size(F.collect_set("pos")).alias("covered"), F.max("exact").alias("exact")
    ).filter(F.col("covered") >= SHARE * F.col("of"))
    most = F.max(F.struct("covered", "exact", (-F.col("source")).alias("s")))["s"]
    linked = shares.groupBy(*line).agg((-most).alias("source")).join(copies, ["conv_id", "turn", "message"])
    return linked.groupBy("conv_id", "turn", "level", "source").agg(F.sum("copies").alias("lines"))


def _before(turns: DataFrame) -> DataFrame:
    """conv_id, turn, before: the preceding turn of the conversation, null for its first."""
    piece = F.floor(F.col("turn") / PIECE)
    inside = turns.withColumn("piece", piece).withColumn(
        "near", F.lag("turn").over(Window.partitionBy("conv_id", "piece").orderBy("turn"))
    )
    ends = turns.groupBy("conv_id", piece.alias("piece")).agg(F.max("turn").alias("end"))
    far = F.lag("end").over(Window.partitionBy("conv_id").orderBy("piece"))
    ends = ends.select("conv_id", "piece", far.alias("far"))
    return inside.join(ends, ["conv_id", "piece"]).select("conv_id", "turn", F.coalesce("near", "far").alias("before"))


def _places(nodes: DataFrame) -> DataFrame:
    """conv_id, turn, thread, position from (conv_id, turn, reply_to): pointers doubled until all are at heads."""
    first = nodes.filter("reply_to is not null").groupBy("conv_id", "reply_to").agg(F.min("turn").alias("first"))
    told = nodes.join(first, ["conv_id", "reply_to"], "left")
    carries_on = F.coalesce(F.col("turn") == F.col("first"), F.lit(False))
    at = cut(
        told.select(
            "conv_id", "turn", F.when(carries_on, F.col("reply_to")).otherwise(F.col("turn")).alias("thread"),
            carries_on.cast("long").alias("position"),
        ),
        "threads",
    )
    done, open_ = at.filter("position = 0"), at.filter("position > 0")
    for _ in range(MAX_ROUNDS):
        if open_.isEmpty():
            return done
        every = done.unionByName(open_)
        up = every.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("to"), F.col("position").alias("more"))
        moved = open_.join(up, ["conv_id", "thread"]).select(
            "conv_id", "turn", F.col("to").alias("thread"), (F.col("position") + F.col("more")).alias("position"), "more"
        )
        # Only what has not yet come to its head goes on.
        moved = cut(moved, "threads")
        done = done.unionByName(moved.filter("more = 0").drop("more"))
        open_ = moved.filter("more > 0").drop("more")
    raise RuntimeError("threads did not settle")


def reply_order(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, thread, position, turn, role, text (without quotes), reply_to, n_quotes, n_linked.

    Sorted by conv_id, thread and position the rows are the conversations in reply order.
    """
    source = only(messages, conv_id=conv_id, turn=turn, role=role, text=text)
    rows = cut(parsed(source).withColumn("turn", F.col("turn").cast("long")), "messages")
    keyed = rows.filter("conv_id is not null and turn is not null")
    links = cut(quote_links(keyed), "quotes")
    # What is quoted at the lowest level is what is answered; then the most lines, then the latest.
    answer = F.max(F.struct((-F.col("level")).alias("l"), "lines", "source"))["source"].alias("quoted")
    answered = links.groupBy("conv_id", "turn").agg(answer, F.sum("lines").alias("n_linked"))
    turns = keyed.select("conv_id", "turn").distinct()
    nodes = _before(turns).join(answered, ["conv_id", "turn"], "left")
    nodes = cut(nodes.select("conv_id", "turn", F.coalesce("quoted", "before").alias("reply_to"), "n_linked"), "replies")
    places = _places(nodes).join(nodes, ["conv_id", "turn"])
    joined = rows.join(places, ["conv_id", "turn"], "left")
    return joined.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), F.coalesce("position", F.lit(0)).alias("position"),
        "turn", "role", F.col("body").alias("text"), "reply_to",
        F.size(F.filter("passages", lambda p: p["level"] > 0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )


def conversations(ordered: DataFrame) -> DataFrame:
    """conv_id, thread, messages: each thread's (role, text) in order, from ``reply_order``."""
    message = F.struct("position", "turn", "role", "text")
    gathered = ordered.groupBy("conv_id", "thread").agg(F.sort_array(F.collect_list(message)).alias("m"))
    return gathered.select("conv_id", "thread", F.transform("m", lambda x: x.dropFields("position", "turn")).alias("messages"))
