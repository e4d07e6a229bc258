"""Chat formatting by quotation linking: who replies to whom, read from quoted passages.

A line's quote level is the number of ``>`` marks it starts with.  Lines are normalised (marks off, lower case, blanks
collapsed) and hashed; hashes and bodies of quoted lines meet those of the unquoted lines of earlier messages of the same
conversation, and each quoted line names the latest earlier message that says it.  A message replies to the message that
most of the lines it quotes at level 1 name (at any level, where none of level 1 is found), the later one of several.  Following replies up gives each message its thread's first turn and its depth;
sorting by ``order_key`` within a conversation puts every reply behind what it answers, thread by thread, and ``text`` is
what is left without quotes and the lines that introduce them.

DataFrame code only.  Conversations are never gathered: each message stays a row, so one of any size does no harm.  A line
that m messages quote and n say makes m + n rows, dealt by ranges of ``RANGE`` turns.  ``order_key`` holds turns with all
digits a long may have, negative ones before the others.  Defined results: null texts give empty ones; messages without a conversation or turn are never linked; equal rows are kept; of
several messages with one turn the thread follows the turn; an empty table gives no rows; other columns but role are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: How mail programs introduce a quotation, in the languages of the corpus.
INTRODUCTION = r"(?i)^.{0,200}\b(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"
#: Turns of one range; a common line's rows of a range are one window.
RANGE = 4096
QUOTE = r"^[ \t]*(?:>[ \t]*)+"


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, QUOTE, 0), " \t", ""))


def _plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, QUOTE, "")), r"[\s\x{A0}]+", " "))


def _own_text(lines: Column) -> Column:
    """Unquoted lines without introductions of quotes; at most one empty line in a row."""
    quoted = F.transform(lines, lambda x: x.rlike(QUOTE))
    kept = F.filter(
        F.arrays_zip(lines.alias("line"), F.transform(lines, lambda x, i: (F.get(quoted, i) | (x.rlike(INTRODUCTION) & F.coalesce(F.get(quoted, i + 1), F.lit(False))))).alias("gone")),
        lambda x: ~x["gone"],
    )
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"\n\s*\n\s*\n", "\n\n"), r"^\s+|\s+$", "")


def _lines(df: DataFrame) -> DataFrame:
    parts = df.select("conv", "turn", F.explode(F.transform("lines", lambda x: F.struct(_level(x).alias("level"), _plain(x).alias("body")))).alias("x"))
    return parts.where("length(x.body) > 0").select("conv", "turn", "x.level", F.xxhash64("x.body").alias("h"), "x.body")


def replies(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent, linked): the turn that each quoting message answers, and how many quoted lines say so."""
    with_quotes = messages.where(F.col("text").rlike("(?m)" + QUOTE) & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    quoted = _lines(with_quotes).where("level > 0")
    # only conversations that quote at all need their lines; the semi join moves whole messages, before any explode
    own = _lines(messages.where("turn is not null").join(with_quotes.select("conv").distinct(), "conv", "left_semi")).where("level = 0")
    said = own.groupBy("conv", "h", "body", "turn").agg(F.lit(None).cast("int").alias("level"), F.lit(0).cast("long").alias("n"))
    asked = quoted.groupBy("conv", "h", "body", "turn").agg(F.min("level").alias("level"), F.count("*").alias("n"))
    both = asked.unionByName(said).withColumn("range", F.expr(f"turn div {RANGE}"))
    # the latest earlier turn that says a line: of the same range of turns, or else of the ranges before
    near = Window.partitionBy("conv", "h", "body", "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    line = both.withColumn("near", F.max(F.expr("if(n = 0, turn, null)")).over(near)).where("n > 0")
    ends = both.groupBy("conv", "h", "body", "range").agg(F.max(F.expr("if(n = 0, turn, null)")).alias("last"))
    before = Window.partitionBy("conv", "h", "body").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("far", F.max("last").over(before)).where("far is not null").drop("last")
    line = line.join(ends, ["conv", "h", "body", "range"], "left").withColumn("parent", F.coalesce("near", "far")).where("parent is not null")
    votes = line.groupBy("conv", "turn", "parent").agg(F.sum(F.when(F.col("level") == 1, F.col("n")).otherwise(0)).alias("direct"), F.sum("n").alias("linked"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct("direct", "linked", "parent")).alias("v"))
    return best.select("conv", "turn", F.col("v.parent").alias("parent"), F.col("v.linked").alias("linked"))


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) by pointer doubling: rounds grow with the logarithm of the longest chain."""
    now = settle(links.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        step = settle(now.join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("moved")), "threads")
        now = step.drop("moved")
        if not step.where("moved").take(1):
            return now


def _sortable(turn: Column) -> Column:
    """A turn as text whose order is that of the numbers."""
    low = F.concat(F.lit("-"), F.lpad(turn.bitwiseXOR(F.lit(-(2**63))).cast("string"), 19, "0"))
    return F.when(turn < 0, low).otherwise(F.lpad(turn.cast("string"), 19, "0"))


def link_quotations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conversation, turn, role, parent_turn, root_turn, depth, n_quoted, n_linked, order_key, text."""
    messages = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    messages = messages.withColumn("lines", F.split("text", "\r?\n"))
    links = settle(replies(messages), "replies")
    tree = threads(links).join(links, ["conv", "turn"])
    out = messages.join(tree, ["conv", "turn"], "left")
    root = F.coalesce("root", "turn")
    return out.select(
        F.col("conv").alias(conv),
        F.col("turn").alias(turn),
        F.col("role").alias(role),
        F.col("parent").alias("parent_turn"),
        root.alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
        F.size(F.filter("lines", lambda x: x.rlike(QUOTE) & (F.length(_plain(x)) > 0))).cast("int").alias("n_quoted"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"),
        F.concat_ws("/", _sortable(root), _sortable(F.col("turn"))).alias("order_key"),
        _own_text(F.col("lines")).alias(text),
    )
