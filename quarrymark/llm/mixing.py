"""Mixing sources to target weights by Pfair scheduling.

A block is a fixed number of documents of one source.  With target weight w, block j (from 0) of a source is released at slot
floor(j / w) and must run before its deadline ceil((j + 1) / w).  Running the released block with the earliest deadline in every
slot keeps each source within less than one block of its target after any number of slots, as long as it has blocks: releases and
deadlines come from the weight itself, so no rounding adds up however long the mix is.

Sources with the same weight and the same number of blocks form a group, whose blocks run round by round: that is the very
schedule of its members, ties by their place in the group.  So the fold over the slots carries one number a group.  There are no
more groups than distinct numbers of blocks and weights together: weights derived from document counts step by half a percent, and
distinct block counts of b blocks are fewer than the root of 2b.  A mix has at most about ``MOST_BLOCKS`` blocks, since a block
grows with the table where none is given; with that the fold, which is one task, is bounded at any size of the table.

Documents are numbered inside their source by (hash range, hash, id): ranges are counted first and their offsets added, so that
a source with a third of all rows is numbered by many tasks; the number of ranges follows the number of documents.

Defined cases: null sources form one source of their own; weights that are given for sources without documents are ignored and
missing ones count as zero, which leaves their documents out of the mix (target, slot null, in_mix false); the mix ends when the
sources that the target favours have run out, later blocks have no slot; a slot in which no source may run stays empty; equal ids,
nulls among them, stand together in any order; an empty table gives an empty result; other columns are passed through or not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarrymark.llm.store import written

BLOCK = 16
MOST_BLOCKS = 1 << 18
FLATTEN = 0.9
STEP = 1.005
CELL_ROWS = 1 << 17
LEAST_CELLS = 256
SLOTS = 1000
EDGE = 1e-9


def _weights(counts: DataFrame, target: dict[str, float] | None, flatten: float, block: int) -> DataFrame:
    """(source, n, w, blocks) of the sources that take part; w sums to one."""
    if target is None:
        step = F.lit(STEP)
        given = counts.withColumn("raw", F.pow(step, F.round(F.log("n") * flatten / F.log(step))))
    else:
        kinds = StructType([StructField("t_source", counts.schema["source"].dataType), StructField("raw", DoubleType())])
        asked = counts.sparkSession.createDataFrame([(name, float(w)) for name, w in target.items()], kinds)
        given = counts.join(asked, F.col("source").eqNullSafe(F.col("t_source")))
    positive = written(given.where("raw > 0").select("source", "n", "raw"), "mix-weights")
    all_raw, all_n = positive.agg(F.sum("raw"), F.sum("n")).first()
    w = F.col("raw") / F.lit(all_raw or 1.0)
    favoured = w >= F.col("n") / F.lit(all_n or 1) * (1 - EDGE)
    return positive.select("source", "n", w.alias("w"), F.ceil(F.col("n") / block).alias("blocks"), favoured.alias("favoured"))


def _release(round_: Column, w: Column) -> Column:
    return F.floor(round_ / w + EDGE)


def _deadline(round_: Column, w: Column) -> Column:
    return F.ceil((round_ + 1) / w - EDGE)


def schedule(groups: DataFrame, slots: int) -> DataFrame:
    """(grp, turn, slot): earliest deadline first over groups of (grp, w, members, blocks, favoured), until favoured ones end.

    The fold is one row; its lists grow by stretches, so that nothing long is copied for every slot.
    """
    kind = F.struct("grp", "w", "members", "blocks", "favoured")
    row = groups.agg(F.sort_array(F.collect_list(kind)).alias("groups"))  # bounded: see the module
    none = F.array().cast("array<int>")

    def window(done: Column, i: Column, slot: Column) -> Column:
        g = F.get("groups", i)
        round_ = F.floor(done / g["members"])
        ready = (round_ < g["blocks"]) & (_release(round_, g["w"]) <= slot)
        return F.when(ready, F.struct(_deadline(round_, g["w"]).alias("deadline"), i.alias("i")))

    def step(state: Column, slot: Column) -> Column:
        def take(pick: Column) -> Column:
            done = F.transform(state["done"], lambda d, i: d + F.when(i == pick, 1).otherwise(0))
            return F.struct(done.alias("done"), F.concat(state["picks"], F.array(pick)).alias("picks"))

        ready = F.filter(F.transform(state["done"], lambda d, i: window(d, i, slot)), lambda x: x.isNotNull())
        return F.get(F.transform(F.array(F.array_min(ready)["i"]), take), F.lit(0))

    def stretch(state: Column, first: Column) -> Column:
        run = F.aggregate(
            F.sequence(first, F.least(first + SLOTS, F.lit(slots)) - 1),
            F.struct(state["done"].alias("done"), none.alias("picks")),
            step,
        )

        def joined(end: Column) -> Column:
            return F.struct(end["done"].alias("done"), F.concat(state["parts"], F.array(end["picks"])).alias("parts"))

        open_ = F.exists(
            F.arrays_zip(state["done"].alias("done"), F.col("groups").alias("g")),
            lambda x: x["g"]["favoured"] & (x["done"] < x["g"]["members"] * x["g"]["blocks"]),
        )
        return F.when(open_, F.get(F.transform(F.array(run), joined), F.lit(0))).otherwise(state)

    start = F.struct(
        F.transform("groups", lambda g: F.lit(0).cast("long")).alias("done"), F.array().cast("array<array<int>>").alias("parts")
    )
    firsts = F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"), F.lit(SLOTS).cast("long"))
    picks = row.select("groups", F.flatten(F.aggregate(firsts, start, stretch)["parts"]).alias("picks"))
    runs = picks.select("groups", F.posexplode("picks").alias("slot", "pick")).where("pick IS NOT NULL")
    named = runs.select(F.get("groups", F.col("pick"))["grp"].alias("grp"), F.col("slot").cast("long").alias("slot"))
    turn = F.row_number().over(Window.partitionBy("grp").orderBy("slot")) - 1
    return named.select("grp", turn.cast("long").alias("turn"), "slot")


def _numbered(docs: DataFrame, key: str, source: str, cells: int) -> DataFrame:
    """(doc_id, source, seq): documents numbered from 0 inside each source in hash order."""
    h = F.xxhash64(docs[key])
    rows = docs.select(
        docs[key].alias("doc_id"),
        docs[source].alias("source"),
        h.alias("h"),
        F.pmod(F.shiftright(h, 24), F.lit(cells)).alias("cell"),
    )
    counts = rows.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("source", "cell").orderBy("h", "doc_id")) - 1
    local = rows.withColumn("place", place)
    o = offsets.select(F.col("source").alias("o_source"), F.col("cell").alias("o_cell"), "offset")
    same = local["source"].eqNullSafe(o["o_source"]) & (local["cell"] == o["o_cell"])
    return local.join(o, same).select("doc_id", "source", (F.col("offset") + F.col("place")).alias("seq"))


def mixed(
    docs: DataFrame,
    target: dict[str, float] | None = None,
    block: int | None = None,
    flatten: float = FLATTEN,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """Every document with its block, release, deadline, slot and position, and whether the mix takes it.

    Without ``target``, a source of n documents weighs n ** flatten, to half a percent.  The mix lasts until the sources that the
    target favours (target share at least their natural share) have run out; what other sources have left over then is not taken.
    Without ``block``, a block has 16 documents, or more where that would make more than ``MOST_BLOCKS``.
    """
    counts = docs.select(docs[source].alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "mix-sources")
    total, largest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    block = block or max(BLOCK, -(-total // MOST_BLOCKS))
    sources = written(_weights(counts, target, flatten, block), "mix-targets")
    kinds = sources.groupBy("w", "blocks").agg(F.count(F.lit(1)).alias("members"), F.max("favoured").alias("favoured"))
    numbers = F.row_number().over(Window.orderBy("w", "blocks"))  # one row a group, bounded: see the module
    groups = written(kinds.select(numbers.alias("grp"), "w", "blocks", "members", "favoured"), "mix-groups")
    named = sources.join(groups.select("grp", "w", "blocks", "members"), ["w", "blocks"])
    ranks = _numbered(named, "source", "grp", max(LEAST_CELLS, largest // CELL_ROWS))
    ranks = ranks.select(F.col("doc_id").alias("s_source"), F.col("seq").alias("rank"))
    placed = written(named.join(ranks, F.col("source").eqNullSafe(F.col("s_source"))).drop("source", "n", "favoured"), "mix-places")

    # every favoured block is released within the natural length of the mix, and what waits then runs without a pause
    blocks = groups.agg(F.coalesce(F.sum(F.col("members") * F.col("blocks")), F.lit(0))).first()[0]
    plan = written(schedule(groups, -(-total // block) + blocks + 2), "mix-schedule")
    end = plan.join(groups.where("favoured"), "grp", "left_semi").agg(F.max("slot")).first()[0]
    plan = plan.where(F.col("slot") <= F.lit(end)).select(F.col("grp").alias("p_grp"), F.col("turn").alias("p_turn"), "slot")

    numbered = _numbered(docs, key, source, max(LEAST_CELLS, total // CELL_ROWS))
    shared = numbered.join(placed, F.col("source").eqNullSafe(F.col("s_source")), "left")
    number = F.floor(F.col("seq") / block)
    timed = shared.withColumns({"block": number, "turn": number * F.col("members") + F.col("rank")})
    found = timed.join(plan, (F.col("grp") == F.col("p_grp")) & (F.col("turn") == F.col("p_turn")), "left")
    return found.select(
        "doc_id",
        "source",
        F.col("w").alias("target_weight"),
        "block",
        _release(F.col("block"), F.col("w")).alias("release"),
        _deadline(F.col("block"), F.col("w")).alias("deadline"),
        "slot",
        (F.col("slot") * block + F.col("seq") % block).alias("position"),
        F.col("slot").isNotNull().alias("in_mix"),
    )


def taken(docs: DataFrame, target: dict[str, float] | None = None, flatten: float = FLATTEN) -> DataFrame:
    """The documents that the mix takes, with the columns they came with; rows of one id go together."""
    plan = mixed(docs, target, flatten=flatten).where("in_mix").select(F.col("doc_id").alias("mix_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"))
    return rows.join(plan, F.col("id").eqNullSafe(F.col("mix_id")), "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
