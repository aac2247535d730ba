"""The claim register over order lines: a part group is a need, a supplier its evidence, a year one version of the need."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.operators import register
from quarrymark.plans.registry import named
from quarrymark.session import written

_OBSERVED = (
    "ob AS (SELECT l_partkey % 100 AS lineage, l_suppkey AS evidence, 10 * l_linenumber AS start, 10 * l_linenumber + l_partkey % 3 AS \"end\", "
    "CAST(year(l_shipdate) AS BIGINT) AS \"at\", l_quantity AS relevance, l_returnflag AS flag FROM lineitem)"
)
_HISTORY = (
    f"{_OBSERVED}, on1 AS (SELECT lineage, evidence, start, \"end\", \"at\", max(relevance) AS relevance FROM ob GROUP BY ALL), "
    "hi AS (SELECT *, row_number() OVER w AS version, lead(\"at\") OVER w AS until, min(\"at\") OVER (PARTITION BY lineage, evidence, start, \"end\") AS created "
    "FROM on1 WINDOW w AS (PARTITION BY lineage, evidence, start, \"end\" ORDER BY \"at\"))"
)


def observations(t):
    return t.lineitem.select(
        (F.col("l_partkey") % 100).alias("lineage"),
        F.col("l_suppkey").alias("evidence"),
        (10 * F.col("l_linenumber")).alias("start"),
        (10 * F.col("l_linenumber") + F.col("l_partkey") % 3).alias("end"),
        F.year("l_shipdate").cast("long").alias("at"),
        F.col("l_quantity").alias("relevance"),
        F.col("l_returnflag").alias("flag"),
    )


@named(
    "claim_register",
    f"WITH {_HISTORY} SELECT lineage, evidence, start AS start_at, \"end\" AS end_at, version, \"at\", until, created, relevance FROM hi",
)
def claim_register(t):
    """The years one by one: each merges into the register of the years before."""
    seen = written(observations(t), "observed")
    bounds = seen.agg(F.min("at"), F.max("at")).first()
    found = None
    for year in range(bounds[0], bounds[1] + 1):
        batch = seen.where(F.col("at") == year)
        found = written(register.history(batch) if found is None else register.merged(found, batch), "register")
    return found.withColumnsRenamed({"start": "start_at", "end": "end_at"})


@named(
    "claim_revalidation",
    f"WITH {_HISTORY}, cu AS (SELECT * FROM hi WHERE until IS NULL), te AS (SELECT lineage, evidence, start, \"end\", list(DISTINCT flag) AS terms FROM ob GROUP BY ALL), "
    "li AS (SELECT lineage, max(\"at\") AS latest FROM ob GROUP BY lineage), ev AS (SELECT s_suppkey AS evidence, CASE WHEN s_acctbal < 0 THEN 'REMOVED' WHEN s_acctbal < 2000 THEN 'REVALIDATION_REQUIRED' ELSE 'VALID' END AS es FROM supplier WHERE s_suppkey % 11 <> 0), "
    "r AS (SELECT cu.*, latest, es, CASE WHEN list_contains(terms, 'R') OR lineage % 7 <> 0 THEN NULL ELSE lineage END AS open FROM cu JOIN te USING (lineage, evidence, start, \"end\") JOIN li USING (lineage) LEFT JOIN ev USING (evidence)) "
    "SELECT lineage, evidence, start AS start_at, \"end\" AS end_at, version, CASE WHEN lineage % 10 = 0 THEN 'SUPERSEDED' WHEN lineage % 10 = 1 OR \"at\" < latest THEN 'STALE' WHEN es = 'REVALIDATION_REQUIRED' THEN 'PENDING_VALIDATION' "
    "WHEN es IS NULL OR es = 'REMOVED' THEN 'UNSUPPORTED' WHEN open IS NOT NULL THEN 'PARTIALLY_SUPPORTED' ELSE 'SUPPORTED' END AS status, "
    "CASE WHEN lineage % 10 = 0 THEN 'intent_superseded' WHEN lineage % 10 = 1 THEN 'intent_removed' WHEN \"at\" < latest THEN 'not_selected_for_version' WHEN es = 'REVALIDATION_REQUIRED' THEN 'awaiting_evidence_revalidation' "
    "WHEN es IS NULL THEN 'evidence_missing' WHEN es = 'REMOVED' THEN 'evidence_removed' WHEN open IS NOT NULL THEN 'does_not_address_constraint:' || open ELSE 'verbatim_in_valid_evidence' END AS reason FROM r",
)
def claim_revalidation(t):
    """Every claim's last version against the state of its need, its supplier and the constraint that every seventh need has."""
    seen = written(observations(t), "observed")
    terms = seen.groupBy(*register.KEY).agg(F.collect_set("flag").alias("terms"))
    claims = register.current(register.history(seen)).join(terms, list(register.KEY))
    state = F.when(F.col("lineage") % 10 == 0, "SUPERSEDED").when(F.col("lineage") % 10 == 1, "REMOVED").otherwise("ACTIVE")
    lineages = seen.groupBy("lineage").agg(F.max("at").alias("latest")).withColumn("state", state)
    balance = F.col("s_acctbal")
    evidence = t.supplier.where("s_suppkey % 11 <> 0").select(
        F.col("s_suppkey").alias("evidence"),
        F.when(balance < 0, "REMOVED").when(balance < 2000, "REVALIDATION_REQUIRED").otherwise("VALID").alias("evidence_state"),
    )
    asked = lineages.where("lineage % 7 = 0").select("lineage", F.col("lineage").alias("constraint"), F.array(F.lit("R")).alias("terms"))
    return register.revalidated(claims, lineages, evidence, asked).withColumnsRenamed({"start": "start_at", "end": "end_at"})
