"""Chat formatting: quotation linking (1), JVM expressions only.

A message's lines carry their quote level, the number of ``>`` they start
with; level 0 is the message's own text.  Consecutive lines of one level are
a passage: without their marks they are joined and normalised (A-Z
lower-cased, white space collapsed), so a quote that a mail program has
wrapped anew is the same passage.  Its pieces are hashed: the whole
passage, its sentences (up to ``.``, ``!`` or ``?`` before a blank) and its lines.
A piece's original is the first message of the same conversation that
has it in its own text, and is earlier; failing that, the first such message
anywhere.  Of the originals at a message's lowest linked quote level the one
with most quoted characters (over distinct pieces) is what it replies to
(ties: the earlier message).  A quote that is cut inside its sentences and
lines is not linked.  Reply
chains are followed to their first message by pointer doubling, which gives
each message its thread and depth; ordered by depth and turn, a thread is a
conversation in reply order, and ``own_text`` has no quotes or attribution
lines.

Originals are reduced to one message per piece (and conversation) by partial
aggregates before any join, and the joins run on written tables, so a piece
that a third of all messages quote is split by the adaptive skew-join rule.

A null text has no lines.  Messages with a null conversation or turn reply to
nothing.  Repeated rows are messages of their own; the first of them is the
original.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import evaluate_once
from ._common import stage, text_or_empty, unstage

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = r"^[>\x20]*>"
#: Words a line of the quotes that :func:`as_mail` wraps anew.
WRAP_WORDS = 9


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, _MARKS, 0), " ", ""))


def quote_lines(text: Column) -> Column:
    """Array of (level, content) of a text's lines.  Attribution lines, those
    that end in ``wrote:`` before a deeper level, are left out."""
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.struct(
        _level(x).alias("level"), F.regexp_replace(F.regexp_replace(x, _MARKS, ""), r"^\x20", "").alias("content")))
    deeper = lambda x, i: F.coalesce(F.get(lines, i + 1)["level"] > x["level"], F.lit(False))
    return F.filter(lines, lambda x, i: ~(F.regexp_like(x["content"], F.lit(r"wrote:\x20*$")) & deeper(x, i)))


def normalised(content: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(content, _LETTERS, _LETTERS.lower()), r"[\x09-\x0D\x20]+", " "))


def run_starts(lines: Column) -> Column:
    """Places of the lines whose level is not that of the line before."""
    return F.filter(F.transform(lines, lambda x, i: i), lambda i: (i == 0) | (
        F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))


def passages(lines: Column, starts: Column) -> Column:
    """Array of (level, lines, whole) of the runs of lines of one level that
    have words, normalised."""

    def passage(start: Column, k: Column) -> Column:
        run = F.slice(lines, start + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - start)
        held = F.filter(F.transform(run, lambda x: normalised(x["content"])), lambda x: x != "")
        return F.struct(F.get(lines, start)["level"].alias("level"), held.alias("lines"), F.array_join(held, " ").alias("whole"))

    return F.filter(F.transform(starts, passage), lambda p: p["whole"] != "")


def pieces(whole: Column, lines: Column) -> Column:
    """Distinct (hash, size) of a passage, its sentences and its lines."""
    sentences = F.split(F.regexp_replace(whole, r"([.!?])\x20", "$1\n"), "\n")
    return F.transform(F.array_distinct(F.concat(F.array(whole), sentences, lines)), lambda x: F.struct(
        F.unhex(F.md5(x)).alias("hash"), F.length(x).alias("size")))


def own_text(lines: Column) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["content"]), "\n")


def _follow(replies: DataFrame) -> DataFrame:
    """(mid, root, depth) from (mid, parent), by pointer doubling."""
    now = stage(replies.select("mid", F.coalesce("parent", "mid").alias("root"),
                               F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "chains")
    while True:
        step = now.select(F.col("mid").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        doubled = stage(now.join(step, "root").select("mid", F.col("next").alias("root"),
                                                      (F.col("depth") + F.col("more")).alias("depth")), "chains")
        moved = doubled.agg(F.sum("depth")).first()[0] != now.agg(F.sum("depth")).first()[0]
        unstage(now)
        now = doubled
        if not moved:
            return now


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message of ``messages`` (conv_id, turn, text): conv_id,
    turn, reply_conv, reply_turn, thread_conv, thread_turn, depth,
    max_level, n_quoted, n_linked (quoted passages, those with a linked
    piece), own_text."""
    texts = stage(messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        quote_lines(text_or_empty()).alias("lines"), F.monotonically_increasing_id().alias("mid")), "quote-lines")
    # a generator below each use keeps what lambdas read from being inlined into them
    runs = evaluate_once(texts, "starts", run_starts(F.col("lines")))
    passage = stage(runs.select("mid", "conv_id", "turn", F.posexplode(passages(F.col("lines"), F.col("starts"))).alias("place", "p")), "passages")
    piece = (passage.select("mid", "conv_id", "turn", "place", "p.level", F.explode(pieces(F.col("p.whole"), F.col("p.lines"))).alias("piece"))
             .select("mid", "conv_id", "turn", "place", "level", "piece.hash", "piece.size"))
    # struct order: the earliest message first
    who = F.struct("turn", "conv_id", "mid")
    own = piece.filter("level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL")
    here = stage(own.groupBy("conv_id", "hash").agg(F.min(who).alias("here")), "own-pieces")
    anywhere = stage(here.groupBy("hash").agg(F.min(F.struct("here.conv_id", "here.turn", "here.mid")).alias("first")), "first-pieces")
    quoted = stage(piece.filter("level > 0"), "quoted-pieces")
    # only earlier messages (by conversation, then turn): replies form no ring
    near = stage(quoted.join(here, ["conv_id", "hash"], "left").withColumn(
        "here", F.when(F.col("here.turn") < F.col("turn"), F.col("here"))), "near-links")
    to = F.coalesce("here", F.when((F.col("first.conv_id") < F.col("conv_id")) & F.col("turn").isNotNull(), F.struct(
        F.col("first.turn").alias("turn"), F.col("first.conv_id").alias("conv_id"), F.col("first.mid").alias("mid"))))
    linked = stage(near.join(anywhere, "hash", "left").select("mid", "place", "level", "hash", "size", to.alias("to")), "links")
    # a piece that a message quotes twice at one level counts once
    votes = (linked.filter("to IS NOT NULL").select("mid", "level", "to", "hash", "size").distinct()
             .groupBy("mid", "level", "to").agg(F.sum("size").alias("size")))
    best = votes.groupBy("mid").agg(F.min(F.struct(
        "level", (-F.col("size")).alias("less"), "to")).alias("best"))
    found = linked.groupBy("mid", "place").agg(F.max("level").alias("level"), F.count("to").alias("hits"))
    totals = found.groupBy("mid").agg(F.max("level").alias("max_level"), F.count("*").alias("n_quoted"),
                                      F.count_if(F.col("hits") > 0).alias("n_linked"))
    replies = stage(texts.select("mid", "conv_id", "turn").join(best, "mid", "left").join(totals, "mid", "left").select(
        "mid", "conv_id", "turn", F.col("best.to.mid").alias("parent"), F.col("best.to.conv_id").alias("reply_conv"),
        F.col("best.to.turn").alias("reply_turn"), F.coalesce("max_level", F.lit(0)).alias("max_level"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")), "replies")
    chains = _follow(replies)
    roots = replies.select(F.col("mid").alias("root"), F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"))
    threads = stage(chains.join(roots, "root").drop("root"), "threads")
    return (replies.join(threads, "mid").join(texts.select("mid", own_text(F.col("lines")).alias("own_text")), "mid")
            .select("conv_id", "turn", "reply_conv", "reply_turn", "thread_conv", "thread_turn", "depth",
                    "max_level", "n_quoted", "n_linked", "own_text"))


def as_mail(turns: DataFrame) -> DataFrame:
    """Conversations as a mailing list shows them: each message quotes the
    one before it and, one level deeper, the one before that; every other
    message's mail program wraps a text with a long line anew when quoting it."""
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        text_or_empty().alias("text"))
    said = base.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    once = stage(said.select("conv_id", "turn", "said", F.split(F.trim(F.regexp_replace(
        "said", r"[\x09-\x0D\x20]+", " ")), " ").alias("words")), "said")

    def quoted(side: str, marks: str) -> Column:
        words, kept = F.col(f"{side}.words"), F.split(F.col(f"{side}.said"), "\n")
        long = F.exists(kept, lambda x: F.size(F.split(x, " ")) > WRAP_WORDS)
        wraps = long & (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(2)) == 0)
        last = F.greatest(F.ceil(F.size(words) / WRAP_WORDS).cast("int") - 1, F.lit(0))
        anew = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * WRAP_WORDS + 1, WRAP_WORDS), " "))
        lines = F.when(wraps, anew).otherwise(kept)
        return F.when(F.col(side).isNull(), F.array().cast("array<string>")).otherwise(
            F.transform(lines, lambda x: F.concat(F.lit(marks), x)))

    said = F.struct("said", "words")
    one = once.select("conv_id", (F.col("turn") + 1).alias("turn"), said.alias("one"))
    two = once.select("conv_id", (F.col("turn") + 2).alias("turn"), said.alias("two"))
    joined = base.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    head = F.when(F.col("one").isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("On turn "), F.col("turn") - 1, F.lit(" they wrote:"))))
    return joined.select("conv_id", "turn", F.array_join(F.concat(
        head, quoted("two", "> > "), quoted("one", "> "), F.array("text")), "\n").alias("text"))
