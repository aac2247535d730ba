"""Metadata and validity predicates.  All are plain column expressions placed before any ranking, so scans prune on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Authority of a document by status and by type.
STATUS_WEIGHT = {"current": 1.0, "active": 1.0, "draft": 0.4, "superseded": 0.2, "archived": 0.2, "expired": 0.2}
TYPE_WEIGHT = {"policy": 1.0, "annex": 0.9, "catalogue": 0.8, "notice": 0.7, "bulletin": 0.6}
DEMOTED = ("superseded", "archived", "expired")


def metadata_allows(value: Column, allowed: list[str]) -> Column:
    """Case-insensitive, comma lists; a missing value or "all" passes."""
    wanted = F.array(*[F.lit(a.lower()) for a in allowed])
    given = F.split(F.trim(F.lower(value)), r"\s*,\s*")
    return value.isNull() | F.array_contains(given, "all") | F.arrays_overlap(given, wanted)


def valid_in(start: Column, end: Column, at: Column, to: Column | None = None) -> Column:
    """TRUE or FALSE when the document carries dates, NULL when it carries none; open ends are unbounded."""
    upper = at if to is None else F.coalesce(to, at)
    inside = (start.isNull() | (start <= upper)) & (end.isNull() | (end >= at))
    return F.when(at.isNotNull() & (start.isNotNull() | end.isNotNull()), inside)


def passes_validity(start: Column, end: Column, at: Column, to: Column | None = None) -> Column:
    """Unknown validity passes."""
    return F.coalesce(valid_in(start, end, at, to), F.lit(True))


def _weights(column: Column, table: dict[str, float]) -> Column:
    lookup = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(lookup, F.lower(column)), F.lit(1.0))


def authority(status: Column, doc_type: Column, superseded: Column) -> Column:
    """Status weight times type weight; an agreed supersession caps the status weight."""
    weight = _weights(status, STATUS_WEIGHT)
    capped = F.when(superseded, F.least(weight, F.lit(STATUS_WEIGHT["superseded"]))).otherwise(weight)
    return F.round(capped * _weights(doc_type, TYPE_WEIGHT), 4)


def agreed_supersession(docs: DataFrame, key: str = "document_id") -> DataFrame:
    """(old, new): a claim to supersede counts only when the old document is demoted or ended before the new one starts.

    ``docs`` has key, supersedes (comma list), status, start, end.  The last claimant in key order wins.
    """
    claims = docs.select(
        F.col(key).alias("new"),
        F.col("start").alias("new_start"),
        F.explode(F.split("supersedes", r"\s*,\s*")).alias("old"),
    ).where(F.col("old") != F.col("new").cast("string"))
    old = docs.select(F.col(key).cast("string").alias("old"), F.col("status").alias("old_status"), F.col("end").alias("old_end"))
    agrees = F.col("old_status").isin(*DEMOTED) | F.coalesce(F.col("old_end") < F.col("new_start"), F.lit(False))
    return claims.join(old, "old").where(agrees).groupBy("old").agg(F.max("new").alias("new"))


def id_filter(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose document, citation or bare section is asked for (one equality per alternative, so each can hash-join)."""
    keys = F.explode(F.array("document_id", "citation", "section_id"))
    hit = rows.select("row_id", keys.alias("wanted")).join(wanted.select("wanted").distinct(), "wanted", "left_semi")
    return rows.join(hit.select("row_id").distinct(), "row_id", "left_semi")
