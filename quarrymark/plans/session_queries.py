"""Turn-level changes over conversations, events and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.operators import events as ev
from quarrymark.operators import matching, sessions
from quarrymark.operators.joins import attach
from quarrymark.operators.ordered import Split
from quarrymark.plans.event_queries import _SESSIONS, GAP, log
from quarrymark.plans.metric_queries import match_scores
from quarrymark.plans.registry import named
from quarrymark.plans.state_queries import TURNS, session_queries, turn_bucket

_POS = f"{TURNS}, v AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, lag(terms) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM q)"


def versions(t):
    """(conv_id, turn, terms, pos, old): every turn with its place and the terms of the turn before."""
    split = Split(["conv_id"], ["turn"], turn_bucket())
    return split.lag(split.position(session_queries(t), "pos"), old="terms")


@named(
    "net_changes",
    f"WITH {_POS}, c AS (SELECT conv_id, pos // 3 AS block, unnest(list_filter(terms, lambda x: NOT list_contains(coalesce(old, []), x))) AS term, 1 AS a, 0 AS r FROM v UNION ALL "
    "SELECT conv_id, pos // 3, unnest(list_filter(coalesce(old, []), lambda x: NOT list_contains(terms, x))), 0, 1 FROM v), n AS (SELECT conv_id, block, term, sum(a) AS a, sum(r) AS r FROM c GROUP BY ALL) "
    "SELECT conv_id, block, CASE WHEN a > 0 THEN 'added' ELSE 'retracted' END AS change, count(*) AS n FROM n WHERE NOT (a > 0 AND r > 0) GROUP BY ALL",
)
def net_changes(t):
    """Three turns are one utterance revised twice: a term that came and went inside it leaves no trace."""
    old = F.coalesce("old", F.array().cast("array<string>"))
    rows = versions(t).withColumn("block", F.floor(F.col("pos") / 3))
    side = lambda terms, kind: rows.select("conv_id", "block", F.explode(terms).alias("term"), F.lit(kind).alias("change"))
    changes = side(F.array_except("terms", old), "added").unionByName(side(F.array_except(old, F.col("terms")), "retracted"))
    net = sessions.net_changes(changes, ["conv_id", "block"], "term")
    return net.groupBy("conv_id", "block", "change").agg(F.count(F.lit(1)).alias("n"))


@named(
    "delta_query",
    f"WITH {_POS}, s AS (SELECT conv_id, turn, list_sort(terms) AS w, list_sort(coalesce(old, [])) AS p FROM v) SELECT conv_id, turn, sha1(array_to_string(list_concat(list_filter(p, lambda x: list_contains(w, x)), list_filter(w, lambda x: NOT list_contains(p, x))), ' ')) AS digest, len(list_filter(p, lambda x: list_contains(w, x))) AS n_kept FROM s",
)
def delta_query(t):
    old = F.array_sort(F.coalesce("old", F.array().cast("array<string>")))
    wanted = F.array_sort("terms")
    return versions(t).select(
        "conv_id",
        "turn",
        F.sha1(F.array_join(sessions.delta_terms(old, wanted), " ")).alias("digest"),
        F.size(F.array_intersect(old, wanted)).alias("n_kept"),
    )


@named(
    "context_selection",
    "WITH o AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM conversations) SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE rk <= 6 AND role <> 'system') AS n_included, count(*) FILTER (WHERE rk > 6) AS n_too_old, count(*) FILTER (WHERE rk <= 6 AND role = 'system') AS n_by_role, round(sum(CASE WHEN rk <= 6 AND role <> 'system' THEN n ELSE 0 END) / nullif(sum(n), 0), 6) AS kept_share FROM o GROUP BY conv_id",
)
def context_selection(t):
    """The last six turns without system text; what is left out is counted by reason."""
    rows = t.conversations.select("conv_id", "turn", "role", F.length("text").alias("n"))
    placed = Split(["conv_id"], ["turn"], turn_bucket()).position(rows, "pos")
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"))
    old = F.col("n_turns") - F.col("pos") >= 6
    chosen = ~old & (F.col("role") != "system")
    return attach(placed, sizes, ["conv_id"], count="n_turns").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(chosen).alias("n_included"),
        F.count_if(old).alias("n_too_old"),
        F.count_if(~old & (F.col("role") == "system")).alias("n_by_role"),
        F.round(F.sum(F.when(chosen, F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0)), 6).alias("kept_share"),
    )


@named(
    "search_guards",
    f"WITH {_SESSIONS}, k AS (SELECT user_id, session, us, event_id, row_number() OVER (PARTITION BY user_id, session ORDER BY us, event_id) AS pos, us - lag(us) OVER (PARTITION BY user_id, session ORDER BY us, event_id) AS gap FROM s) "
    "SELECT event_id, pos, CASE WHEN pos > 3 THEN 'budget' WHEN gap IS NOT NULL AND gap < 300000000 THEN 'cooldown' ELSE 'retrieve' END AS verdict FROM k",
)
def search_guards(t):
    """Every event asks for a search: at most three per session, five minutes apart."""
    rows = ev.sessions(log(t), "user_id", GAP)
    split = ev.hourly(["user_id", "session"], ["us", "event_id"])
    placed = split.lag(split.position(rows, "pos"), before="us")
    verdict = sessions.guard(F.col("pos"), F.col("us") - F.col("before"), budget=3, cooldown_us=300_000_000)
    return placed.select("event_id", "pos", verdict.alias("verdict"))


@named("intent_tracking")
def intent_tracking(t):
    """Needs of a request against those of the request before it."""
    scored = match_scores(t).select("uid", "a", "b", (F.col("jaccard") + F.col("containment")).alias("score"))
    pairs = matching.greedy_matching(scored.where("score > 0"))
    needs = t.benchmark.select(F.floor(F.col("item_id") / 3).alias("uid"), F.col("item_id").alias("need"))
    last = needs.agg(F.max("uid")).scalar()
    earlier = needs.where(F.col("uid") < last).select((F.col("uid") + 1).alias("uid"), "need")
    return sessions.tracked(needs, earlier, pairs)
