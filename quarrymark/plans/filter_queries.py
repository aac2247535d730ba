"""Filters, joins and reports over the star schema.

Orders stand for dated documents: the order date starts their validity, the priority is their type, the order status their
state, the customer's market segment and nation their metadata.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymark.operators import filters
from quarrymark.operators.ordered import Split
from quarrymark.operators.rank import top_k
from quarrymark.plans.registry import named

DATED = (
    "dated AS (SELECT o_orderkey AS document_id, o_custkey, CAST(o_orderdate AS DATE) AS start, "
    "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_orderdate AS DATE) + 90 END AS e, "
    "CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'P' THEN 'draft' ELSE 'current' END AS status, "
    "CASE left(o_orderpriority, 1) WHEN '1' THEN 'policy' WHEN '2' THEN 'annex' WHEN '3' THEN 'catalogue' WHEN '4' THEN 'notice' ELSE 'bulletin' END AS doc_type FROM orders)"
)


def dated(t):
    start = F.col("o_orderdate").cast("date")
    priority = F.left("o_orderpriority", F.lit(1))
    return t.orders.select(
        F.col("o_orderkey").alias("document_id"),
        "o_custkey",
        start.alias("start"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(start, 90)).alias("end"),
        F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "P", "draft").otherwise("current").alias("status"),
        F.when(priority == "1", "policy")
        .when(priority == "2", "annex")
        .when(priority == "3", "catalogue")
        .when(priority == "4", "notice")
        .otherwise("bulletin")
        .alias("doc_type"),
    )


@named(
    "metadata_filter_all_passes",
    "WITH m AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN NULL WHEN c_nationkey % 5 = 1 THEN 'all' WHEN c_nationkey % 5 = 2 THEN c_mktsegment || ', ' || n_name ELSE c_mktsegment END AS v FROM customer JOIN nation ON n_nationkey = c_nationkey) "
    "SELECT c_custkey, v AS value FROM m WHERE v IS NULL OR list_contains(string_split_regex(lower(v), '\\s*,\\s*'), 'all') OR list_has_any(string_split_regex(lower(v), '\\s*,\\s*'), ['building', 'machinery'])",
)
def metadata_filter_all_passes(t):
    kind = F.pmod("c_nationkey", F.lit(5))
    value = (
        F.when(kind == 0, F.lit(None))
        .when(kind == 1, F.lit("all"))
        .when(kind == 2, F.concat_ws(", ", "c_mktsegment", "n_name"))
        .otherwise(F.col("c_mktsegment"))
    )
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", value.alias("value"))
    return rows.where(filters.metadata_allows(F.col("value"), ["BUILDING", "machinery"]))


@named(
    "validity_asof",
    f"WITH {DATED} SELECT status, doc_type, count(*) AS n, count(*) FILTER (WHERE start <= DATE '1997-06-30' AND (e IS NULL OR e >= DATE '1997-01-01')) AS n_valid FROM dated GROUP BY ALL",
)
def validity_asof(t):
    at, to = F.lit("1997-01-01").cast("date"), F.lit("1997-06-30").cast("date")
    ok = filters.passes_validity(F.col("start"), F.col("end"), at, to)
    return dated(t).groupBy("status", "doc_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_valid"))


@named(
    "validity_three_valued",
    f"WITH {DATED}, v AS (SELECT document_id, CASE WHEN document_id % 3 = 0 THEN NULL ELSE start END AS s, CASE WHEN document_id % 3 = 0 THEN NULL ELSE e END AS e FROM dated) "
    "SELECT CASE WHEN s IS NULL AND e IS NULL THEN 'unknown' WHEN (s IS NULL OR s <= DATE '1996-01-01') AND (e IS NULL OR e >= DATE '1996-01-01') THEN 'valid' ELSE 'invalid' END AS verdict, count(*) AS n FROM v GROUP BY ALL",
)
def validity_three_valued(t):
    known = F.col("document_id") % 3 != 0
    rows = dated(t).select(F.when(known, F.col("start")).alias("s"), F.when(known, F.col("end")).alias("e"))
    v = filters.valid_in(F.col("s"), F.col("e"), F.lit("1996-01-01").cast("date"))
    verdict = F.when(v.isNull(), "unknown").when(v, "valid").otherwise("invalid")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


# An order claims to replace the customer's previous order.
_CLAIMS = (
    f"{DATED}, c AS (SELECT *, lag(document_id) OVER (PARTITION BY o_custkey ORDER BY start, document_id) AS old FROM dated), "
    "agreed AS (SELECT c.old, max(c.document_id) AS new FROM c JOIN dated o ON o.document_id = c.old WHERE o.status IN ('superseded', 'archived', 'expired') OR o.e < c.start GROUP BY c.old)"
)


def order_claims(t):
    split = Split(["o_custkey"], ["start", "document_id"], F.trunc("start", "month"))
    return split.lag(dated(t), old="document_id").withColumn("supersedes", F.col("old").cast("string"))


@named("supersession_agreed", f"WITH {_CLAIMS} SELECT CAST(old AS VARCHAR) AS old, new FROM agreed")
def supersession_agreed(t):
    return filters.agreed_supersession(order_claims(t).where(F.col("supersedes").isNotNull() | F.col("status").isNotNull()))


@named(
    "authority_rank",
    f"WITH {_CLAIMS}, a AS (SELECT d.document_id, d.o_custkey, round((CASE WHEN g.old IS NULL THEN CASE d.status WHEN 'draft' THEN 0.4 WHEN 'archived' THEN 0.2 ELSE 1.0 END ELSE least(0.2, CASE d.status WHEN 'draft' THEN 0.4 WHEN 'archived' THEN 0.2 ELSE 1.0 END) END) "
    "* CASE d.doc_type WHEN 'policy' THEN 1.0 WHEN 'annex' THEN 0.9 WHEN 'catalogue' THEN 0.8 WHEN 'notice' THEN 0.7 ELSE 0.6 END, 4) AS authority FROM dated d LEFT JOIN agreed g ON g.old = d.document_id) "
    "SELECT o_custkey, document_id, CAST(authority AS DOUBLE) AS authority FROM a",
)
def authority_rank(t):
    agreed = filters.agreed_supersession(order_claims(t)).select(F.col("old").cast("long").alias("document_id"), F.lit(True).alias("gone"))
    rows = dated(t).join(agreed, "document_id", "left")
    score = filters.authority(F.col("status"), F.col("doc_type"), F.coalesce("gone", F.lit(False)))
    return rows.select("o_custkey", "document_id", score.alias("authority"))


@named(
    "id_filter",
    "WITH w AS (SELECT DISTINCT p_brand AS x FROM part WHERE p_size >= 49 UNION SELECT DISTINCT p_type FROM part WHERE p_retailprice > 1900) "
    "SELECT p_partkey FROM part WHERE p_brand IN (SELECT x FROM w) OR p_type IN (SELECT x FROM w) OR p_name IN (SELECT x FROM w)",
)
def id_filter(t):
    wanted = (
        t.part.where("p_size >= 49").select(F.col("p_brand").alias("wanted"))
        .union(t.part.where("p_retailprice > 1900").select("p_type"))
    )
    rows = t.part.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_name").alias("document_id"),
        F.col("p_brand").alias("section_id"),
        F.col("p_type").alias("citation"),
    )
    return filters.id_filter(rows, wanted).select(F.col("row_id").alias("p_partkey"))


# --- join kinds -------------------------------------------------------------------------------------------------


@named(
    "semi_join_report",
    "SELECT c_mktsegment, count(*) AS n_active FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY c_mktsegment",
)
def semi_join_report(t):
    big = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_active"))


@named("anti_unused", "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)")
def anti_unused(t):
    used = t.lineitem.where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.select("p_partkey", "p_brand").join(used, "p_partkey", "left_anti")


@named(
    "left_defaults",
    "SELECT c.c_custkey, coalesce(o.n, 0) AS n_orders, round(coalesce(o.total, 0), 2) AS total FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey",
)
def left_defaults(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total")
    )


@named(
    "asof_latest",
    "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, max(o.o_orderkey) AS asof_order FROM lineitem l JOIN orders me ON me.o_orderkey = l.l_orderkey "
    "JOIN orders o ON o.o_custkey = me.o_custkey AND (o.o_orderdate, o.o_orderkey) = (SELECT (max((x.o_orderdate, x.o_orderkey))) FROM orders x WHERE x.o_custkey = me.o_custkey AND x.o_orderdate <= l.l_shipdate) GROUP BY ALL",
)
def asof_latest(t):
    """The customer's latest order at each ship date: facts and probes share one ordered stream per customer, and the last
    order seen so far is carried across month borders, so neither side is multiplied."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    events = orders.select(
        F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.lit(0).alias("kind"), "o_orderkey",
        *[F.lit(None).cast(c).alias(n) for n, c in (("l_orderkey", "long"), ("l_linenumber", "int"), ("l_partkey", "long"))],
    )
    probes = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("k"), F.col("l_shipdate").alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("o_orderkey"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )
    rows = events.unionByName(probes).withColumn("b", F.date_trunc("month", "ts"))
    # order rows keep their key, probe rows take the latest key before them; ties at one instant see the order
    key = F.struct("ts", "o_orderkey")
    seen = F.when(F.col("kind") == 0, key)
    local = Window.partitionBy("k", "b").orderBy("ts", "kind", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    tail = rows.where("kind = 0").groupBy("k", "b").agg(F.max(key).alias("tail"))
    months = rows.select("k", "b").distinct().join(tail, ["k", "b"], "left")
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = months.select("k", "b", F.max("tail").over(before).alias("carry"))
    found = rows.withColumn("seen", F.max(seen).over(local)).join(carry, ["k", "b"], "left")
    return (
        found.where("kind = 1")
        .select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("seen", "carry")["o_orderkey"].alias("asof_order"))
        .where("asof_order IS NOT NULL")
        .groupBy("l_orderkey", "l_linenumber", "l_partkey")
        .agg(F.max("asof_order").alias("asof_order"))
    )


# --- grouped reports --------------------------------------------------------------------------------------------


@named(
    "describe_groups",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem GROUP BY ALL",
)
def describe_groups(t):
    from quarrymark.operators.stats import describe

    return describe(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice")


@named(
    "percentile_gates",
    "SELECT o_custkey, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, CASE WHEN count(*) >= 10 THEN round(quantile_cont(o_totalprice, 0.9), 4) END AS p90, "
    "CASE WHEN count(*) >= 20 THEN round(quantile_cont(o_totalprice, 0.95), 4) END AS p95, CASE WHEN count(*) >= 100 THEN round(quantile_cont(o_totalprice, 0.99), 4) END AS p99 FROM orders GROUP BY o_custkey",
)
def percentile_gates(t):
    from quarrymark.operators.stats import gated_percentiles

    return gated_percentiles(t.orders, ["o_custkey"], "o_totalprice")


@named(
    "grouping_sets_report",
    "SELECT o_orderstatus AS status, o_orderpriority AS priority, GROUPING(o_orderstatus, o_orderpriority) AS level, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())",
)
def grouping_sets_report(t):
    sets = [["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], ["o_orderpriority"], []]
    return (
        t.orders.groupingSets(sets, "o_orderstatus", "o_orderpriority")
        .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))
        .withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"})
    )


@named("strategy_share", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def strategy_share(t):
    total = t.events.agg(F.count(F.lit(1))).scalar()
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


@named(
    "status_histogram",
    "SELECT o_orderpriority AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY o_orderpriority",
)
def status_histogram(t):
    wide = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("priority", *[F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in "FOP"])


@named(
    "argbest",
    "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey",
)
def argbest(t):
    return t.orders.groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("dearest"),
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"),
        F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"),
    )


@named(
    "set_coverage",
    "SELECT l_orderkey, bool_and(l_quantity >= 10) AS every_line, bool_or(l_discount > 0.05) AS any_discount, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY l_orderkey",
)
def set_coverage(t):
    return t.lineitem.groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_quantity") >= 10).alias("every_line"),
        F.bool_or(F.col("l_discount") > 0.05).alias("any_discount"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
    )


@named(
    "set_operations",
    "SELECT 'both' AS side, s AS suppkey FROM ((SELECT l_suppkey AS s FROM lineitem WHERE l_quantity >= 49) INTERSECT (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1)) UNION ALL "
    "SELECT 'only_first', s FROM ((SELECT l_suppkey AS s FROM lineitem WHERE l_quantity >= 49) EXCEPT (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1))",
)
def set_operations(t):
    a = t.lineitem.where("l_quantity >= 49").select("l_suppkey")
    b = t.lineitem.where("l_discount >= 0.1").select("l_suppkey")
    tag = lambda df, name: df.select(F.lit(name).alias("side"), F.col("l_suppkey").alias("suppkey"))
    return tag(a.intersect(b), "both").unionAll(tag(a.subtract(b), "only_first"))
