"""Claim register: versions of claims under a stable key, and what new evidence makes of them.

A claim is known by its lineage (the line of versions of one need), the evidence it is taken from and its span there.  Seen again, it
is the same claim in a new version; the version it replaces ends where the new one begins.  ``history`` works out a register from all
observations at once; ``merged`` brings one into an existing register.  Merging batch after batch in the order of their time gives
the register of all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("lineage", "evidence", "start", "end")
USABLE = ("VALID", "PARTIAL")


def history(observations: DataFrame) -> DataFrame:
    """(key, version, at, until, created, relevance): every version of every claim; of one key and time the most relevant counts."""
    once = observations.groupBy(*KEY, "at").agg(F.max("relevance").alias("relevance"))
    order = Window.partitionBy(*KEY).orderBy("at")
    return once.select(
        *KEY,
        F.row_number().over(order).cast("long").alias("version"),
        "at",
        F.lead("at").over(order).alias("until"),
        F.min("at").over(Window.partitionBy(*KEY)).alias("created"),
        "relevance",
    )


def merged(register: DataFrame, batch: DataFrame) -> DataFrame:
    """The register after a batch of later observations: open versions are closed, new ones opened, nothing else changes.

    Only keys of the batch are looked up; an observation that is not later than the open version of its claim is left out.
    """
    opened = register.where("until IS NULL")
    last = opened.select(*KEY, F.col("version").alias("last_version"), F.col("at").alias("last_at"), F.col("created").alias("first_at"))
    fresh = history(batch).join(last, list(KEY), "left").where("last_at IS NULL OR at > last_at")
    # an observation left out changes the numbers of those behind it
    order = Window.partitionBy(*KEY).orderBy("at")
    number = F.coalesce("last_version", F.lit(0)) + F.row_number().over(order)
    added = fresh.select(
        *KEY, number.cast("long").alias("version"), "at", "until", F.coalesce("first_at", F.min("at").over(Window.partitionBy(*KEY))).alias("created"), "relevance"
    )
    begins = added.groupBy(*KEY).agg(F.min("at").alias("next_at"))
    kept = register.join(begins, list(KEY), "left").withColumn("until", F.coalesce("until", "next_at")).drop("next_at")
    return kept.unionByName(added)


def current(register: DataFrame) -> DataFrame:
    return register.where("until IS NULL")


def revalidated(claims: DataFrame, lineages: DataFrame, evidence: DataFrame, constraints: DataFrame) -> DataFrame:
    """(key, status, reason) of every current claim, by the first rule that applies.

    ``claims`` are open versions with their ``terms``; ``lineages`` (lineage, state, latest): state of the need, and the time of its latest
    version; ``evidence`` (evidence, evidence_state); ``constraints`` (lineage, constraint, terms).  A claim that the latest version has not
    seen is stale; one without usable evidence is unsupported, or waits where the evidence is to be looked at again; one that says
    nothing of a constraint is partial.
    """
    asked = constraints.select("lineage", "constraint", F.col("terms").alias("wanted"))
    missing = F.size(F.array_except("wanted", "terms")) > 0
    uncovered = (
        claims.join(asked, "lineage")
        .where(missing)
        .groupBy(*KEY)
        .agg(F.array_join(F.array_sort(F.collect_set(F.col("constraint").cast("string"))), ",").alias("uncovered"))
    )
    rows = claims.join(lineages, "lineage", "left").join(evidence, "evidence", "left").join(uncovered, list(KEY), "left")
    state = F.coalesce("evidence_state", F.lit("MISSING"))

    def says(status: str, reason: Column | str) -> Column:
        return F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    verdict = (
        F.when(F.col("state").isNull() | (F.col("state") == "SUPERSEDED"), says("SUPERSEDED", "intent_superseded"))
        .when(F.col("state") != "ACTIVE", says("STALE", "intent_removed"))
        .when(F.col("at") < F.col("latest"), says("STALE", "not_selected_for_version"))
        .when(state == "REVALIDATION_REQUIRED", says("PENDING_VALIDATION", "awaiting_evidence_revalidation"))
        .when(~state.isin(*USABLE), says("UNSUPPORTED", F.concat(F.lit("evidence_"), F.lower(state))))
        .when(F.col("uncovered").isNotNull(), says("PARTIALLY_SUPPORTED", F.concat(F.lit("does_not_address_constraint:"), F.col("uncovered"))))
        .otherwise(says("SUPPORTED", "verbatim_in_valid_evidence"))
    )
    return rows.select(*KEY, "version", verdict.alias("v")).select(*KEY, "version", "v.status", "v.reason")
