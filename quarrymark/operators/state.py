"""Versioned session state: query lineage, evidence lifecycle, delta plans, caches, version differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymark.functions.sets import containment, jaccard
from quarrymark.operators.joins import attach
from quarrymark.operators.ordered import Split
from quarrymark.session import durable

REFINES = 0.6
USABLE = ("ACTIVE", "RETAINED")

# What a status means for the plan.
DECISION = {
    "ACTIVE": "RETAIN", "RETAINED": "RETAIN", "REVALIDATION_REQUIRED": "REVALIDATE", "SUPERSEDED": "SUPERSEDE",
    "STALE": "SUPERSEDE", "INVALID": "DISCARD",
}


def lineage(queries: DataFrame, key: str, order: str, bucket: Column, terms: str = "terms") -> DataFrame:
    """Version, relation to the previous query, successor and root of every query of a need."""
    split = Split([key], [order], bucket)
    rows = split.lag(split.position(queries, "version"), prev_terms=terms, supersedes=order)
    rows = split.lead(rows, superseded_by=order)
    first = queries.groupBy(key).agg(F.min(order).alias("root"), F.count(F.lit(1)).alias("n"))
    relation = (
        F.when(F.col("prev_terms").isNull(), "initial")
        .when(containment(F.col("prev_terms"), F.col(terms)) >= REFINES, "refines")
        .otherwise("replaces")
    )
    return attach(rows, first, [key]).select(
        *queries.columns,
        "version",
        relation.alias("relation"),
        "supersedes",
        "superseded_by",
        F.col("superseded_by").isNotNull().alias("stale"),
        "root",
    )


def recent_similarity(queries: DataFrame, key: str, order: str, terms: str = "terms", least: float = 0.0) -> DataFrame:
    """Highest Jaccard of every query to all earlier ones of its key that is at least ``least``, and which one that was.

    Queries meet on shared terms only, and what meets is narrow: no set travels with a term.  Sets that reach ``least`` share a term
    among the first ``n - ceil(least * n) + 1`` of each in any common order, so only those terms are looked up, and only sets of
    fitting sizes make a pair; the sets are fetched once a pair.  With ``least`` 0 every term is looked up, so the meetings of a pair
    are its shared terms.  Empty sets equal each other.
    """
    listed = F.when(F.size(terms) == 0, F.array(F.lit(""))).otherwise(F.array_sort(F.array_distinct(terms)))
    # a hash tells apart sets that stand at the same place of a key
    sets = queries.select(key, order, listed.alias("_set")).distinct().withColumns({"_n": F.size("_set"), "_id": F.xxhash64("_set")})
    head = F.slice("_set", 1, F.least(F.col("_n") - F.ceil(F.lit(least) * F.col("_n")) + 1, F.col("_n")).cast("int"))
    asked = sets.select(key, order, "_id", "_n", F.explode(head).alias("_term"))
    theirs = {order: "_other", "_id": "_their_id", "_n": "_their_n", "_set": "_their_set"}
    fits = F.least("_n", "_their_n") >= F.lit(least) * F.greatest("_n", "_their_n")
    # the plan takes exploded rows for as small as the table they come from: neither side is to be broadcast
    known = asked.withColumnsRenamed(theirs).hint("merge")
    met = asked.join(known, [key, "_term"]).where((F.col("_other") < F.col(order)) & fits)
    pair = [key, order, "_id", "_n", "_other", "_their_id", "_their_n"]
    if least > 0:
        found = met.select(*pair).distinct()
        mine = sets.select(key, order, "_id", "_set").hint("merge")
        both = found.join(mine, [key, order, "_id"]).join(mine.withColumnsRenamed(theirs).hint("merge"), [key, "_other", "_their_id"])
        counted = both.withColumn("_common", F.size(F.array_intersect("_set", "_their_set")))
    else:
        counted = met.groupBy(*pair).agg(F.count(F.lit(1)).alias("_common"))
    common = F.col("_common")
    scored = counted.withColumn("_s", common / (F.col("_n") + F.col("_their_n") - common)).where(F.col("_s") >= least)
    best = scored.groupBy(key, order).agg(
        F.max("_s").alias("_top"), F.max_by("_other", F.struct(F.col("_s"), -F.col("_other"))).alias("most_similar")
    )
    return queries.select(key, order).join(best, [key, order], "left").select(
        key, order, F.round(F.coalesce("_top", F.lit(0.0)), 6).alias("similarity"), "most_similar"
    )


def semantic_key(terms: Column, index: str, options: str) -> Column:
    """Sixteen hex digits over the index, the options and the sorted distinct terms."""
    listed = F.array_join(F.array_sort(F.array_distinct(terms)), " ")
    return F.left(F.sha1(F.concat_ws("|", F.lit(index), F.lit(options), listed)), F.lit(16))


def cache_lookup(queries: DataFrame, key: str, order: Column) -> DataFrame:
    """First query of every key fills the cache, later ones hit it."""
    rows = queries.withColumn("_at", order)
    puts = rows.groupBy(key).agg(F.min("_at").alias("source"), F.count(F.lit(1)).alias("n"))
    found = attach(rows, puts, [key])
    return found.withColumn("hit", F.col("_at") > F.col("source")).drop("_at", "n")


def delta_plan(queries: DataFrame, need: str, order: str, bucket: Column, at: Column, key: str = "key") -> DataFrame:
    """reuse_active (same key as the need's active query), cache_hit (key seen before), or retrieve."""
    rows = Split([need], [order], bucket).lag(queries, active_key=key)
    looked = cache_lookup(rows, key, at)
    action = (
        F.when(F.col("active_key") == F.col(key), "reuse_active").when(F.col("hit"), "cache_hit").otherwise("retrieve")
    )
    supersede = F.col("active_key").isNotNull() & (F.col("active_key") != F.col(key))
    return looked.withColumn("action", action).withColumn("supersedes_active", supersede)


def lifecycle(
    change: Column, evidence: Column, constraint: Column, added: Column, topic: Column, status: Column
) -> tuple[Column, Column]:
    """(new status, rule) of usable evidence after a change of its need; all sets are term arrays."""
    has_all = lambda part: F.size(F.array_except(part, evidence)) == 0
    has_any = lambda part: F.arrays_overlap(part, evidence)
    covered = (F.size(constraint) > 0) & has_all(constraint)
    head = F.array_contains(evidence, F.try_element_at(constraint, F.lit(-1)))
    refined_topic = F.arrays_overlap(added, topic) & ~has_any(topic)
    table = (
        ("CONSTRAINT_ADDITION", covered, "ACTIVE", "constraint_covered"),
        ("CONSTRAINT_ADDITION", head, "REVALIDATION_REQUIRED", "constraint_dimension_other_value"),
        ("CONSTRAINT_ADDITION", F.lit(True), "RETAINED", "general_evidence_still_applicable"),
        ("CONSTRAINT_REMOVAL", covered, "REVALIDATION_REQUIRED", "specific_to_removed_constraint"),
        ("CONSTRAINT_REMOVAL", F.lit(True), "RETAINED", "general_evidence_still_applicable"),
        ("REFINEMENT", has_any(added), "ACTIVE", "covers_refinement"),
        ("REFINEMENT", refined_topic, "REVALIDATION_REQUIRED", "does_not_cover_refined_topic"),
        ("REFINEMENT", F.lit(True), "RETAINED", "general_evidence_still_applicable"),
        ("QUESTION_CHANGE", F.lit(True), "REVALIDATION_REQUIRED", "question_changed"),
        ("ENTITY_CHANGE", has_any(topic), "REVALIDATION_REQUIRED", "mentions_new_entity"),
        ("ENTITY_CHANGE", F.lit(True), "SUPERSEDED", "specific_to_replaced_entity"),
        ("CORRECTION", F.lit(True), "SUPERSEDED", "intent_superseded"),
        ("INTENT_REMOVAL", F.lit(True), "STALE", "intent_removed"),
    )
    usable = status.isin(*USABLE) | (
        change.isin("CORRECTION", "INTENT_REMOVAL") & (status == "REVALIDATION_REQUIRED")
    )
    new, rule = F.when(~usable, status), F.when(~usable, F.lit("not_usable"))
    for kind, test, to, why in table:
        applies = (change == kind) & F.coalesce(test, F.lit(False))
        new, rule = new.when(applies, to), rule.when(applies, why)
    return new.otherwise(status), rule.otherwise("no_change")


def carried(change: Column, evidence: Column, topic: Column) -> Column:
    """After a correction, evidence that mentions the new need's topic moves to it for revalidation."""
    return (change == "CORRECTION") & F.arrays_overlap(topic, evidence)


def confirmed(status: Column, again: Column) -> Column:
    """After the delta retrieval: found again -> ACTIVE, otherwise STALE."""
    return F.when(status == "REVALIDATION_REQUIRED", F.when(again, "ACTIVE").otherwise("STALE")).otherwise(status)


def decision(status: Column) -> Column:
    table = F.create_map(*[x for k, v in DECISION.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, status)


def change_type(superseded: Column, added: Column, vanished: Column, plus: Column, minus: Column, removed: Column,
                topics_meet: Column, aspect_changed: Column) -> Column:
    """Kind of change between two versions of a need, first rule that applies."""
    return (
        F.when(superseded, "CORRECTION")
        .when(added, "NEW_INTENT")
        .when(vanished, "INTENT_REMOVAL")
        .when(plus, "CONSTRAINT_ADDITION")
        .when(minus, "CONSTRAINT_REMOVAL")
        .when(F.size(removed) == 0, "REFINEMENT")
        .when(~topics_meet, "ENTITY_CHANGE")
        .when(aspect_changed, "QUESTION_CHANGE")
        .otherwise("REFINEMENT")
    )


def version_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """kept / modified / added / retracted per key."""
    a = old.select(*keys, F.col(value).alias("before"))
    b = new.select(*keys, F.col(value).alias("after"))
    kind = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "retracted")
        .when(F.col("before") == F.col("after"), "kept")
        .otherwise("modified")
    )
    return a.join(b, keys, "full_outer").withColumn("change", kind)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, group): connected components, named after their smallest node.

    Large-star and small-star steps alternate: each rewires nodes to the smallest neighbour they know.  Every step keeps at most
    as many edges as the one before, a hub's neighbours are reduced to their minimum before they are joined, and each round is
    written to the checkpoint folder.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    start = links = durable(pairs.distinct())
    links = links.where("u <> v")
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        # large star: neighbours above u move to the smallest node u knows
        large = attach(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u <> v").distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        below = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = attach(large, below, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = durable(small.union(below.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        moved = after.exceptAll(links).limit(1).count() or links.exceptAll(after).limit(1).count()
        links = after
        if not moved:
            break
    nodes = start.select(F.col("u").alias("node")).union(start.select("v")).distinct()
    return nodes.join(links.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("group"))
