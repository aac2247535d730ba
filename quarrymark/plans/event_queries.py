"""Event-stream analytics over the event log: a user is a session, event kinds stand for the stages of a turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.operators import events as ev
from quarrymark.operators.ordered import Split
from quarrymark.plans.registry import named

E = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"
W = "(PARTITION BY user_id ORDER BY us, event_id)"


def log(t):
    return t.events.select("event_id", "user_id", "event_type", "value", ev.micros(F.col("ts")).alias("us"))


_SESSIONS = (
    f"{E}, g AS (SELECT *, lag(us) OVER {W} AS p FROM e), s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > 1800000000 THEN 1 ELSE 0 END) "
    f"OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"
)
GAP = 1_800_000_000


@named(
    "utterance_sessions",
    f"WITH {_SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events FROM s GROUP BY ALL",
)
def utterance_sessions(t):
    return ev.session_spans(log(t), "user_id", GAP)


@named(
    "session_windows",
    f"WITH {_SESSIONS} SELECT user_id, count(*) AS n_sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id",
)
def session_windows(t):
    """Sessions per user; each user's events are cut into hours, so a busy user is many tasks."""
    spans = ev.session_spans(log(t), "user_id", GAP)
    return spans.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n_events").alias("longest"))


@named(
    "quiet_ticks",
    f"WITH {E}, g AS (SELECT *, lead(us) OVER {W} AS nxt FROM e) SELECT user_id, count(*) FILTER (WHERE nxt IS NULL OR nxt - us > 600000000) AS n_ticks, count(*) FILTER (WHERE nxt - us > 3000000000) AS n_endpoints FROM g GROUP BY user_id",
)
def quiet_ticks(t):
    """A timer fires when nothing follows in time; a later event of the key cancels it."""
    rows = ev.hourly(["user_id"], ["us", "event_id"]).lead(log(t), nxt="us")
    wait = F.col("nxt") - F.col("us")
    return rows.groupBy("user_id").agg(
        F.count_if(F.col("nxt").isNull() | (wait > 600_000_000)).alias("n_ticks"),
        F.count_if(wait > 3_000_000_000).alias("n_endpoints"),
    )


@named(
    "late_events",
    f"WITH {E}, h AS (SELECT *, max(us) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT event_id, user_id, us - CASE WHEN event_id % 7 = 0 THEN 7200000000 ELSE 0 END AS us FROM e)) "
    "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE us < seen) AS out_of_order, count(*) FILTER (WHERE us < seen - 3600000000) AS rejected FROM h GROUP BY user_id",
)
def late_events(t):
    """Arrival order against event time: every seventh event carries a two-hour-old stamp; more than an hour late is rejected
    with a count, never dropped silently."""
    delayed = F.col("us") - F.when(F.col("event_id") % 7 == 0, 7_200_000_000).otherwise(0)
    rows = log(t).select("event_id", "user_id", delayed.alias("us"))
    bucket = F.floor(F.col("event_id") / 4096)
    cut = rows.withColumn("b", bucket)
    from pyspark.sql import Window

    local = Window.partitionBy("user_id", "b").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy("user_id", "b").agg(F.max("us").alias("top"))
    before = Window.partitionBy("user_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select("user_id", "b", F.max("top").over(before).alias("carry"))
    seen = cut.withColumn("local", F.max("us").over(local)).join(carry, ["user_id", "b"], "left")
    high = F.greatest("local", "carry")
    return seen.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("us") < high).alias("out_of_order"),
        F.count_if(F.col("us") < high - 3_600_000_000).alias("rejected"),
    )


@named(
    "milestones",
    f"WITH {E} SELECT user_id, min(us) FILTER (WHERE event_type = 'view') - min(us) AS to_view, min(us) FILTER (WHERE event_type = 'click') - min(us) AS to_click, min(us) FILTER (WHERE event_type = 'purchase') - min(us) AS to_purchase FROM e GROUP BY user_id",
)
def milestones(t):
    kinds = {f"to_{k}": F.col("event_type") == k for k in ("view", "click", "purchase")}
    return ev.first_after(log(t), ["user_id"], F.lit(True), kinds)


@named(
    "update_gaps",
    f"WITH {E}, g AS (SELECT user_id, us - lag(us) OVER {W} AS gap FROM e) SELECT user_id, count(gap) AS n_gaps, round(avg(gap), 3) AS mean_gap, max(gap) AS longest FROM g GROUP BY user_id",
)
def update_gaps(t):
    return ev.gaps(log(t), "user_id").groupBy("user_id").agg(
        F.count("gap_us").alias("n_gaps"), F.round(F.avg("gap_us"), 3).alias("mean_gap"), F.max("gap_us").alias("longest")
    )


@named(
    "ordering_errors",
    f"WITH {E}, g AS (SELECT user_id, value, lag(value) OVER {W} AS prev FROM e) SELECT user_id, count(*) FILTER (WHERE value <= prev) AS n_errors, round(count(*) FILTER (WHERE value <= prev) / nullif(count(prev), 0), 6) AS rate FROM g GROUP BY user_id",
)
def ordering_errors(t):
    """The value plays the sequence number: it must grow."""
    rows = ev.hourly(["user_id"], ["us", "event_id"]).lag(log(t), prev="value")
    bad = F.count_if(F.col("value") <= F.col("prev"))
    return rows.groupBy("user_id").agg(
        bad.alias("n_errors"), F.round(bad / F.nullif(F.count("prev"), F.lit(0)), 6).alias("rate")
    )


@named(
    "stale_rate",
    f"WITH {E}, g AS (SELECT user_id, event_type, us, lead(us) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS nxt FROM e) SELECT event_type, count(*) AS n, count(*) FILTER (WHERE nxt - us < 86400000000) AS n_stale, round(avg(CASE WHEN nxt - us < 86400000000 THEN 1 ELSE 0 END), 6) AS rate FROM g GROUP BY event_type",
)
def stale_rate(t):
    """A result is stale when the next one of its kind arrives within a day."""
    rows = ev.hourly(["user_id", "event_type"], ["us", "event_id"]).lead(log(t), nxt="us")
    stale = F.coalesce(F.col("nxt") - F.col("us") < 86_400_000_000, F.lit(False))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(stale).alias("n_stale"), F.round(F.avg(stale.cast("int")), 6).alias("rate")
    )


@named(
    "utterance_stats",
    f"WITH {_SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, min(us) FILTER (WHERE event_type = 'click') - min(us) AS first_click, max(us) FILTER (WHERE event_type = 'purchase') - max(us) AS last_purchase, count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(DISTINCT event_type) AS n_kinds FROM s GROUP BY ALL",
)
def utterance_stats(t):
    rows = ev.sessions(log(t), "user_id", GAP)
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("us"))
    return rows.groupBy("user_id", "session").agg(
        (F.min(at("click")) - F.min("us")).alias("first_click"),
        (F.max(at("purchase")) - F.max("us")).alias("last_purchase"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
        F.countDistinct("event_type").alias("n_kinds"),
    )


@named(
    "conditional_rates",
    "SELECT user_id, count(*) FILTER (WHERE event_type = 'click' AND value > 10) AS n_early, round(avg(CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 10 THEN 1 ELSE 0 END END), 6) AS useful_rate, round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS mean_error FROM events GROUP BY user_id",
)
def conditional_rates(t):
    """NULL, not zero, where nothing applies."""
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(
        F.count_if((kind == "click") & (F.col("value") > 10)).alias("n_early"),
        F.round(F.avg(F.when(kind == "purchase", (F.col("value") > 10).cast("int"))), 6).alias("useful_rate"),
        F.round(F.avg(F.when(kind == "error", F.col("value"))), 6).alias("mean_error"),
    )


@named(
    "rolling_cost",
    f"WITH {E} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS expected FROM e",
)
def rolling_cost(t):
    """Mean of the last twenty.  Prefix sums over hours give the frame total, the position gives its size."""
    split = ev.hourly(["user_id"], ["us", "event_id"])
    cents = F.round(F.col("value") * 100).cast("long")
    rows = split.position(split.running_sum(log(t), "total", cents), "pos")
    back = rows.select("user_id", (F.col("pos") + 20).alias("pos"), F.col("total").alias("before"))
    return rows.join(back, ["user_id", "pos"], "left").select(
        "event_id",
        F.round((F.col("total") - F.coalesce("before", F.lit(0))) / 100 / F.least("pos", F.lit(20)), 6).alias("expected"),
    )


# every event points to an earlier one; ids that are multiples of 97 point to nothing that exists
_TREE = "tree AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN -event_id - 1 WHEN event_id % 11 = 0 THEN NULL ELSE event_id - event_id % 11 + (event_id % 11) // 2 END AS parent FROM events)"


def trace_tree(t):
    i = F.col("event_id")
    parent = (
        F.when(i % 97 == 0, -i - 1).when(i % 11 == 0, F.lit(None).cast("long")).otherwise(i - i % 11 + F.floor((i % 11) / 2))
    )
    return t.events.select("event_id", parent.alias("parent"))


@named("trace_orphans", f"WITH {_TREE} SELECT event_id, parent FROM tree WHERE parent IS NOT NULL AND parent NOT IN (SELECT event_id FROM events)")
def trace_orphans(t):
    return ev.orphans(trace_tree(t), "event_id", "parent").select("event_id", "parent")


@named(
    "trace_roots",
    f"WITH RECURSIVE {_TREE}, walk AS (SELECT event_id, event_id AS root, 0 AS hops, parent FROM tree UNION ALL SELECT w.event_id, w.parent, w.hops + 1, p.parent FROM walk w LEFT JOIN tree p ON p.event_id = w.parent WHERE w.parent IS NOT NULL) "
    "SELECT event_id, arg_max(root, hops) AS root, max(hops) AS hops FROM walk GROUP BY event_id",
)
def trace_roots(t):
    return ev.roots(trace_tree(t), "event_id", "parent")


@named(
    "max_concurrency_sweep",
    f"WITH {E}, s AS (SELECT event_type, us AS a, us + CAST(round(value * 100) AS BIGINT) * 10000000 AS b FROM e), p AS (SELECT event_type, a AS us, 1 AS o, 1 AS d FROM s UNION ALL SELECT event_type, b, 0, -1 FROM s), "
    "r AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY us, o ROWS UNBOUNDED PRECEDING) AS n_open FROM p) SELECT event_type, CAST(max(n_open) AS BIGINT) AS peak FROM r GROUP BY event_type",
)
def max_concurrency_sweep(t):
    spans = log(t).select("event_type", F.col("us").alias("start_us"), (F.col("us") + F.round(F.col("value") * 100).cast("long") * 10_000_000).alias("end_us"))
    return ev.peak_concurrency(spans, ["event_type"])


@named(
    "waste_accounting",
    f"WITH {E}, g AS (SELECT *, lead(event_type) OVER {W} AS nxt FROM e) SELECT event_type, round(sum(value), 2) AS total, round(coalesce(sum(value) FILTER (WHERE nxt = 'error'), 0), 2) AS wasted FROM g GROUP BY event_type",
)
def waste_accounting(t):
    """Work whose outcome was superseded: here, work directly followed by an error of the same user."""
    rows = ev.hourly(["user_id"], ["us", "event_id"]).lead(log(t), nxt="event_type")
    return rows.groupBy("event_type").agg(
        F.round(F.sum("value"), 2).alias("total"),
        F.round(F.coalesce(F.sum(F.when(F.col("nxt") == "error", F.col("value"))), F.lit(0.0)), 2).alias("wasted"),
    )


@named(
    "replay_state",
    f"WITH {E} SELECT user_id, arg_max(props, (us, event_id)) AS last_props, arg_max(event_type, (us, event_id)) AS last_type, count(*) AS version FROM e GROUP BY user_id",
)
def replay_state(t):
    """Session state rebuilt from events only."""
    at = F.struct(ev.micros(F.col("ts")), F.col("event_id"))
    return t.events.groupBy("user_id").agg(
        F.max_by("props", at).alias("last_props"), F.max_by("event_type", at).alias("last_type"), F.count(F.lit(1)).alias("version")
    )


@named("replay_compare", "SELECT event_id FROM events WHERE false")
def replay_compare(t):
    """Replaying every user's first event and the gaps after it gives back the recorded log: the symmetric difference is empty."""
    recorded = log(t).select("event_id", "user_id", "event_type", "us")
    steps = ev.gaps(recorded, "user_id")
    replayed = ev.hourly(["user_id"], ["us", "event_id"]).running_sum(steps, "again", F.coalesce("gap_us", "us"))
    again = replayed.select("event_id", "user_id", "event_type", F.col("again").alias("us"))
    return recorded.exceptAll(again).unionAll(again.exceptAll(recorded)).select("event_id")


@named(
    "safe_projection",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'searching' WHEN 'click' THEN 'evidence' WHEN 'purchase' THEN 'answer' END AS shown, event_type || ' #' || event_id || ' user=' || user_id AS line FROM events WHERE event_type IN ('view', 'click', 'purchase')",
)
def safe_projection(t):
    """What a reader may see: internal kinds are hidden, the rest is renamed and formatted."""
    kind = F.col("event_type")
    shown = F.when(kind == "view", "searching").when(kind == "click", "evidence").when(kind == "purchase", "answer")
    line = F.format_string("%s #%d user=%d", kind, F.col("event_id"), F.col("user_id"))
    return t.events.where(kind.isin("view", "click", "purchase")).select("event_id", shown.alias("shown"), line.alias("line"))


@named(
    "retry_delays",
    "SELECT event_id, CAST(least(1000.0, 50.0 * power(2, event_id % 8)) AS DOUBLE) AS delay_ms, least(value * 100, 1500 - 50 * (event_id % 8)) AS deadline_ms FROM events",
)
def retry_delays(t):
    """Capped exponential back-off, and the tighter of the own deadline and the turn's remaining budget."""
    attempt = F.col("event_id") % 8
    return t.events.select(
        "event_id",
        F.least(F.lit(1000.0), 50.0 * F.pow(F.lit(2.0), attempt)).alias("delay_ms"),
        F.least(F.col("value") * 100, (1500 - 50 * attempt).cast("double")).alias("deadline_ms"),
    )


@named(
    "priority_order",
    f"WITH {E} SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END - us / 1e15 AS priority FROM e",
)
def priority_order(t):
    """Priority minus waiting bonus of every event; ordering by it is left to the reader."""
    kind = F.col("event_type")
    base = F.when(kind == "error", 0).when(kind == "purchase", 1).otherwise(2)
    return log(t).select("user_id", "event_id", (base - F.col("us") / 1e15).alias("priority"))
