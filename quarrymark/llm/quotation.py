"""Quotation linking: conversations in reply order, without the passages they quote.

A line is quoted when it begins with ``>`` marks; their number is its nesting level.  A passage is a whole run of lines of one
level, normalised across line breaks (lower case, letters and digits only) and hashed.  It is linked to the latest earlier message
that says the same as a run, a paragraph, a sentence or a line of its own text.  A passage that nobody says as a whole is linked
by its paragraphs, a paragraph by its sentences, and one without any by its lines; sentences and lines only link when one message
alone has said them.  A message replies to the latest of the messages that its first-level quotes come from; quotes of deeper
levels are linked and removed too, but name no parent.  A line that announces a quote ("On Monday b wrote:") goes with it.
Messages of one thread are ordered by their root, then by turn, so that every reply comes after what it answers.

The latest earlier sayer is a running maximum over (conversation, passage), cut into turn ranges that hand on one row each, so no
pair of rows is made and a greeting of every message is no hot key.  Positions are counted in ranges of roots and, inside a thread,
ranges of turns, so a thread of any length is numbered by many tasks.  Roots are found by pointer jumping, each round cut off by a
written table, until no pointer moves.

Defined cases: a null or empty text is an empty message; passages without letters or digits never link; a null conversation id
forms a conversation of its own, a null turn comes first in it; a quote of a later or equal turn, or of no known message, is removed
and stays unlinked; repeated rows are separate messages; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.llm.store import temporary, written

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
ANNOUNCED = r"(?i)\b(?:wrote|writes|said|schrieb|schreibt|a écrit|écrit|escribió|escreveu|ha scritto)\s*:\s*$"
RUN, PARAGRAPH, SENTENCE, LINE = range(4)
NO_PARAGRAPH = -1
ROOT_RANGE = 64
TURN_RANGE = 4096
LOWEST = -(2**63)


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, MARKS, 1), " \t", ""))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(conversations: DataFrame) -> DataFrame:
    """Messages with their runs (level, text), their own text and the number of quoted lines."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r\n?", "\n")

    def line(raw: Column) -> Column:
        body = F.regexp_replace(raw, MARKS, "")
        return F.struct(raw.alias("raw"), _level(raw).alias("level"), body.alias("body"), F.trim(body, F.lit(" \t")).alias("bare"))

    def announces(x: Column, i: Column) -> Column:
        """Whether a line announces the deeper quote right after it, or after one blank line."""
        second, third = F.get("lines", i + 1), F.get("lines", i + 2)
        deeper = (second["level"] > x["level"]) | ((second["bare"] == "") & (third["level"] > x["level"]))
        return F.coalesce(deeper, F.lit(False)) & x["body"].rlike(ANNOUNCED)

    read = conversations.select(
        F.monotonically_increasing_id().alias("mid"),
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        "role",
        F.transform(F.split(text, "\n"), line).alias("lines"),
    )
    kept = read.withColumn("said", F.filter("lines", lambda x, i: ~announces(x, i)))
    numbers = F.sequence(F.lit(0), F.size("said") - 1)
    first = F.filter(
        F.when(F.size("said") > 0, numbers).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 0) | (F.get("said", i)["level"] != F.get("said", i - 1)["level"]),
    )

    def run(begin: Column, k: Column) -> Column:
        end = F.coalesce(F.get("first", k + 1), F.size("said"))
        bodies = F.transform(F.slice("said", begin + 1, end - begin), lambda x: x["body"])
        return F.struct(F.get("said", begin)["level"].alias("level"), F.array_join(bodies, "\n").alias("text"))

    own = F.transform(F.filter("said", lambda x: x["level"] == 0), lambda x: x["raw"])
    return kept.withColumn("first", first).select(
        "mid",
        "conv_id",
        "turn",
        "role",
        F.transform("first", run).alias("runs"),
        F.trim(F.array_join(own, "\n"), F.lit(" \t\n")).alias("text"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
    )


def _runs(messages: DataFrame) -> DataFrame:
    return messages.select(
        "mid",
        F.col("conv_id").isNull().alias("none"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.coalesce("turn", F.lit(LOWEST)).alias("at"),
        F.posexplode("runs").alias("run", "r"),
    )


def _units(runs: DataFrame) -> DataFrame:
    """(mid, none, conv, at, level, run, par, kind, passage): every run, paragraph, sentence and line with a letter or digit."""

    def part(kind: int, par: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), par.alias("par"), _plain(text).alias("plain"))

    def inside(text: Column, par: Column) -> Column:
        sentences = F.split(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"([.!?]) ", "$1\n"), "\n")
        return F.concat(
            F.array(part(PARAGRAPH, par, text)),
            F.transform(sentences, lambda s: part(SENTENCE, par, s)),
            F.transform(F.split(text, "\n"), lambda s: part(LINE, par, s)),
        )

    paragraphs = F.split(F.col("r.text"), r"\n[ \t]*\n")
    whole = part(RUN, F.lit(NO_PARAGRAPH), F.col("r.text"))
    parts = F.concat(F.array(whole), F.flatten(F.transform(paragraphs, inside)))
    each = runs.select("mid", "none", "conv", "at", F.col("r.level").alias("level"), "run", F.explode(parts).alias("u"))
    return each.where(F.length("u.plain") > 0).select(
        "mid", "none", "conv", "at", "level", "run", "u.par", "u.kind", F.xxhash64("u.plain").alias("passage")
    )


def links(messages: DataFrame) -> DataFrame:
    """(mid, level, run, kind, passage, from_mid, from_at): quoted passages and the latest earlier message that says them itself."""
    runs = _runs(messages)
    key = ["none", "conv", "passage"]
    asked = written(_units(runs.where("r.level > 0")).distinct(), "quoted")
    # nothing is read of conversations without quotes
    own = runs.where("r.level = 0").join(asked.select("none", "conv").distinct(), ["none", "conv"], "left_semi")
    said = _units(own).groupBy(*key, "at", "mid").agg(F.lit(True).alias("own"))
    wanted = asked.select(*key).distinct()
    sayers = said.join(wanted, key, "left_semi")
    alone = sayers.groupBy(*key).agg(F.count(F.lit(1)).alias("sayers"))

    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("run", "int"), ("par", "int"), ("kind", "int"))]
    columns = [*key, "at", "mid", "own", "level", "run", "par", "kind"]
    both = sayers.select(*key, "at", "mid", "own", *nothing).unionByName(asked.withColumn("own", F.lit(False)).select(*columns))
    rows = both.withColumn("range", F.floor(F.col("at") / TURN_RANGE))
    sayer = F.max(F.when(F.col("own"), F.struct("at", "mid")))
    order = Window.partitionBy(*key, "range").orderBy("at", "own").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("latest", sayer.over(order))
    handed = rows.groupBy(*key, "range").agg(sayer.alias("last"))
    before = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = handed.select(*key, "range", F.max("last").over(before).alias("carried"))
    found = local.where("NOT own").join(carried, [*key, "range"]).withColumn("from", F.coalesce("latest", "carried"))
    known = found.where("from IS NOT NULL").join(alone, key).where(f"kind < {SENTENCE} OR sayers = 1")
    coarsest = known.withColumns(
        {
            "of_run": F.min("kind").over(Window.partitionBy("mid", "run")),
            "of_par": F.min("kind").over(Window.partitionBy("mid", "run", "par")),
        }
    )
    kept = coarsest.where(f"kind = {RUN} OR (of_run > {RUN} AND kind = of_par)")
    return kept.select("mid", "level", "run", "kind", "passage", F.col("from.mid").alias("from_mid"), F.col("from.at").alias("from_at"))


def _roots(parents: DataFrame) -> DataFrame:
    """(mid, root): the message at the top of each reply chain; parents are always earlier, so there are no cycles."""
    with temporary(parents.sparkSession):
        state = written(parents.select("mid", F.col("parent").alias("root")), "quote-roots")
        moved = True
        while moved:
            up = state.select(F.col("mid").alias("u_mid"), F.col("root").alias("u_root"))
            step = state.join(up, F.col("root") == F.col("u_mid"), "left").select(
                "mid", F.coalesce("u_root", "root").alias("root"), F.col("u_root").isNotNull().alias("moved")
            )
            state = written(step, "quote-roots")
            moved = not state.where("moved").isEmpty()
            state = state.select("mid", "root")
        return written(state, "quote-roots", up=1)


def _positions(rows: DataFrame) -> DataFrame:
    """Add ``position`` by (root_at, root, at, mid) inside (none, conv): offsets of root ranges, then of threads' turn ranges."""
    key = ["none", "conv"]
    ranged = rows.withColumns({"roots": F.floor(F.col("root_at") / ROOT_RANGE), "turns": F.floor(F.col("at") / TURN_RANGE)})
    fine = [*key, "roots", "root_at", "root", "turns"]
    counts = written(ranged.groupBy(*fine).agg(F.count(F.lit(1)).alias("n")), "thread-counts")

    def before(frame: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
        earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return frame.select(*keys, *order, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(name))

    coarse = before(counts.groupBy(*key, "roots").agg(F.sum("n").alias("n")), key, ["roots"], "far")
    inner = before(counts, [*key, "roots"], ["root_at", "root", "turns"], "near")
    offsets = inner.join(coarse, [*key, "roots"]).select(*fine, (F.col("far") + F.col("near")).alias("offset"))
    place = F.row_number().over(Window.partitionBy(*fine).orderBy("at", "mid"))
    return ranged.withColumn("place", place).join(offsets, fine).withColumn("position", F.col("offset") + F.col("place"))


def conversations_in_reply_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quoted, n_linked, parent_turn, root_turn, position) of every message."""
    messages = written(parsed(conversations), "messages")
    found = written(links(messages), "quote-links")
    parent = F.max(F.when(F.col("level") == 1, F.struct("from_at", "from_mid")))
    replies = found.groupBy("mid").agg(F.count(F.lit(1)).alias("n_linked"), parent.alias("parent"))
    parents = replies.where("parent IS NOT NULL").select("mid", F.col("parent.from_mid").alias("parent"))
    turns = messages.select(F.col("mid").alias("root"), F.coalesce("turn", F.lit(LOWEST)).alias("root_at"))
    rooted = _roots(parents).join(turns, "root")
    at = F.coalesce("turn", F.lit(LOWEST))
    rows = (
        messages.select(
            "mid", F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
            "conv_id", "turn", at.alias("at"), "role", "text", "n_quoted",
        )
        .join(replies, "mid", "left")
        .join(rooted, "mid", "left")
        .withColumns({"root_at": F.coalesce("root_at", "at"), "root": F.coalesce("root", "mid")})
    )

    def turn(value: Column) -> Column:
        return F.when(value != LOWEST, value)

    return _positions(rows).select(
        "conv_id",
        "turn",
        "role",
        "text",
        "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        turn(F.col("parent.from_at")).alias("parent_turn"),
        turn(F.col("root_at")).alias("root_turn"),
        "position",
    )
