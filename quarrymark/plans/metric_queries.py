"""Evaluation: ranking metrics of the lexical run, paired statistics, gates, error analysis.

Gold for a passage are the documents that contain it word for word.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymark.functions import text as tx
from quarrymark.functions.sets import containment, jaccard, term_f1
from quarrymark.operators import dense, lexical, matching, metrics, stats
from quarrymark.plans.dense_queries import PROTO, prototypes
from quarrymark.plans.fusion_queries import RRF, fused, vector_lists
from quarrymark.plans.lexical_queries import passages
from quarrymark.plans.registry import named
from quarrymark.plans.sql_parts import BM25, ranked, sql_terms
from quarrymark.session import written
from quarrymark.sources.tables import spread

GOLD = "gold AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(t):
    docs = spread(t.documents.select("doc_id", "text"), "doc_id")
    return metrics.containing(docs, passages(t))


def run(t, k: int = 10):
    return lexical.bm25_top(t.index, passages(t), k=k).select("qid", "doc_id", "rank")


def _scores(source: str) -> str:
    return (
        f"h AS (SELECT r.qid, count(*) AS n, min(r.rank) AS best, sum(1 / log2(r.rank + 1)) AS gain FROM {source} r JOIN gold g USING (qid, doc_id) WHERE r.rank <= 10 GROUP BY r.qid), "
        "g AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid), m AS (SELECT b.item_id AS qid, coalesce(g.n_gold, 0) AS n_gold, "
        "CASE WHEN g.n_gold IS NOT NULL THEN round(coalesce(h.n, 0) / g.n_gold, 6) END AS recall, CASE WHEN g.n_gold IS NOT NULL THEN round(coalesce(h.n, 0) / 10, 6) END AS precision, "
        "CASE WHEN g.n_gold IS NOT NULL THEN CAST(coalesce(h.n, 0) > 0 AS INTEGER) END AS success, CASE WHEN g.n_gold IS NOT NULL THEN round(coalesce(1.0 / h.best, 0), 6) END AS mrr, "
        "CASE WHEN g.n_gold IS NOT NULL THEN round(least(1.0, coalesce(h.gain, 0) / list_sum(list_transform(range(1, least(g.n_gold, 10) + 1), lambda i: 1 / log2(i + 1)))), 6) END AS ndcg "
        "FROM benchmark b LEFT JOIN g ON g.qid = b.item_id LEFT JOIN h ON h.qid = b.item_id)"
    )


METRICS = f"{BM25}, {ranked(10)}, {GOLD}, {_scores('ranked')}"


def scored(t):
    return metrics.ranking(run(t), written(gold(t), "gold"), passages(t), k=10)


@named("gold_containment", f"WITH {GOLD} SELECT qid, doc_id FROM gold")
def gold_containment(t):
    return gold(t)


@named("recall_precision_at_k", f"WITH {METRICS} SELECT qid, n_gold, recall, precision, success FROM m")
def recall_precision_at_k(t):
    return scored(t).select("qid", "n_gold", "recall", "precision", "success")


@named("mrr", f"WITH {METRICS} SELECT qid, CAST(mrr AS DOUBLE) AS mrr FROM m")
def mrr(t):
    return scored(t).select("qid", "mrr")


@named("ndcg", f"WITH {METRICS} SELECT qid, ndcg FROM m")
def ndcg(t):
    return scored(t).select("qid", "ndcg")


@named(
    "harness_report",
    f"WITH {RRF}, {GOLD}, runs AS (SELECT 'lexical' AS mode, qid, doc_id, rank FROM ranked WHERE rank <= 10 UNION ALL SELECT 'vector', qid, doc_id, rank FROM vranked WHERE rank <= 10 UNION ALL SELECT 'hybrid', qid, doc_id, rank FROM hybrid WHERE rank <= 10), "
    "g AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid), modes AS (SELECT DISTINCT mode FROM runs), "
    "h AS (SELECT r.mode, r.qid, count(*) AS n, min(r.rank) AS best FROM runs r JOIN gold USING (qid, doc_id) GROUP BY ALL), "
    "s AS (SELECT m.mode, g.qid, round(coalesce(h.n, 0) / g.n_gold, 6) AS recall, round(coalesce(1.0 / h.best, 0), 6) AS mrr FROM modes m CROSS JOIN g LEFT JOIN h ON h.mode = m.mode AND h.qid = g.qid) "
    "SELECT mode, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM s GROUP BY GROUPING SETS ((mode), ())",
)
def harness_report(t):
    """Three retrieval modes side by side, with the total."""
    wanted = written(gold(t), "gold")
    lexical_list, vector_list = written(run(t, k=50), "lexical-list"), written(vector_lists(t, k=50), "vector-list")
    top = lambda ranked_list: ranked_list.where("rank <= 10")
    lists = {"lexical": top(lexical_list), "vector": top(vector_list), "hybrid": fused(lexical_list, vector_list)}
    parts = [
        metrics.ranking(r.select("qid", "doc_id", "rank"), wanted, passages(t), k=10).select(F.lit(m).alias("mode"), "recall", "mrr")
        for m, r in lists.items()
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("recall").isNotNull())
    return rows.groupingSets([["mode"], []], "mode").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr")
    )


@named(
    "evidence_metrics",
    f"WITH {BM25}, {ranked(10)}, {GOLD}, g AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY qid), e AS (SELECT r.qid, count(*) AS n, count(x.doc_id) AS n_good, count(DISTINCT d.source) AS n_sources, max(coalesce(l.toxic, 0)) AS contradictory "
    "FROM ranked r JOIN documents d USING (doc_id) LEFT JOIN gold x ON x.qid = r.qid AND x.doc_id = r.doc_id LEFT JOIN labels l ON l.doc_id = r.doc_id GROUP BY r.qid) "
    "SELECT e.qid, round(n_good / n_gold, 6) AS evidence_recall, CASE WHEN n_gold IS NOT NULL THEN round(n_good / n, 6) END AS evidence_precision, round(n_sources / n, 6) AS diversity, contradictory FROM e LEFT JOIN g USING (qid)",
)
def evidence_metrics(t):
    """A document labelled toxic counts as contradictory evidence here."""
    bad = t.labels.select("doc_id", F.col("toxic").alias("bad"))
    listed = run(t).join(t.documents.select("doc_id", "source"), "doc_id").join(bad, "doc_id", "left")
    return metrics.list_evidence(listed, gold(t))


@named(
    "redundancy_pairs",
    f"WITH {PROTO}, top AS (SELECT qid, vec_id FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM sims) WHERE rank <= 10), v AS (SELECT t.qid, t.vec_id, CAST(e.embedding AS DOUBLE[]) AS x FROM top t JOIN embeddings e USING (vec_id)) "
    "SELECT a.qid, count(*) AS n_pairs, round(avg(list_inner_product(a.x, b.x)), 6) AS redundancy FROM v a JOIN v b ON a.qid = b.qid AND a.vec_id < b.vec_id GROUP BY a.qid",
)
def redundancy_pairs(t):
    top = dense.search(t.embeddings, prototypes(t), k=10).select("qid", "vec_id")
    return metrics.mean_pairwise(top.join(t.embeddings, "vec_id"), "qid", "vec_id", "embedding")


@named(
    "hallucinated_values",
    "WITH n AS (SELECT conv_id, turn, role, list_distinct(list_transform(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*'), lambda x: replace(x, ',', '.'))) AS ns FROM conversations), p AS (SELECT *, lag(ns) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM n) "
    "SELECT conv_id, turn, len(ns) AS n_values, len(list_filter(ns, lambda x: NOT list_contains(coalesce(q, []), x))) AS n_invented FROM p WHERE role = 'assistant'",
)
def hallucinated_values(t):
    """Numbers of a reply that the turn before it does not state."""
    from quarrymark.operators.ordered import Split

    ns = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\d+(?:[.,]\d+)*"), 0), lambda x: F.translate(x, ",", ".")))
    rows = t.conversations.select("conv_id", "turn", "role", ns.alias("ns"))
    prev = Split(["conv_id"], ["turn"], F.floor(F.col("turn") / 64)).lag(rows, q="ns").where("role = 'assistant'")
    asked = F.coalesce("q", F.array().cast("array<string>"))
    return prev.select("conv_id", "turn", F.size("ns").alias("n_values"), F.size(F.array_except("ns", asked)).alias("n_invented"))


# --- statistics -------------------------------------------------------------------------------------------------


def labelled(t):
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")


@named(
    "prf_micro",
    "WITH x AS (SELECT lang, n_chars > 1000 AS p, quality = 1 AS a FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn FROM x GROUP BY lang) "
    "SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c",
)
def prf_micro(t):
    return stats.precision_recall(labelled(t), ["lang"], F.col("n_chars") > 1000, F.col("quality") == 1)


def _paired_sql(source: str, key: str) -> str:
    return (
        f"WITH p AS ({source}), d AS (SELECT {key}, b - a AS d FROM p), z AS (SELECT {key}, round(d, 9) AS d FROM d WHERE round(d, 9) <> 0), "
        f"r AS (SELECT {key}, d, rank() OVER (PARTITION BY {key} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {key}, abs(d)) - 1) / 2.0 AS r FROM z), "
        f"s AS (SELECT {key}, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS rp, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS rn FROM r GROUP BY {key}) "
        f"SELECT d.{key}, count(*) AS n, round(avg(d.d), 6) AS mean_diff, round(quantile_cont(d.d, 0.5), 6) AS median_diff, round(avg(d.d) / nullif(stddev_samp(d.d), 0), 6) AS d_z, "
        f"count(*) FILTER (WHERE d.d > 0) AS n_better, count(*) FILTER (WHERE d.d < 0) AS n_worse, round((any_value(s.rp) - any_value(s.rn)) / nullif(any_value(s.rp) + any_value(s.rn), 0), 6) AS rank_biserial FROM d LEFT JOIN s USING ({key}) GROUP BY d.{key}"
    )


@named(
    "paired_effects",
    _paired_sql("SELECT lang, CAST(quality AS DOUBLE) AS a, CAST(1 - toxic AS DOUBLE) AS b FROM labels JOIN documents USING (doc_id)", "lang"),
)
def paired_effects(t):
    pairs = labelled(t).select("lang", F.col("quality").cast("double").alias("a"), (1 - F.col("toxic")).cast("double").alias("b"))
    return stats.paired_effects(pairs, ["lang"], "a", "b")


@named("paired_effects_continuous", _paired_sql("SELECT l_shipmonth AS g, l_tax AS a, l_discount AS b FROM (SELECT month(l_shipdate) AS l_shipmonth, * FROM lineitem)", "g"))
def paired_effects_continuous(t):
    pairs = t.lineitem.select(F.month("l_shipdate").alias("g"), F.col("l_tax").alias("a"), F.col("l_discount").alias("b"))
    return stats.paired_effects(pairs, ["g"], "a", "b")


@named(
    "mcnemar_exact",
    "WITH c AS (SELECT source, count(*) FILTER (WHERE quality < 1 - toxic) AS better, count(*) FILTER (WHERE quality > 1 - toxic) AS worse FROM labels JOIN documents USING (doc_id) GROUP BY source) "
    "SELECT source, better, worse, CASE WHEN better + worse > 0 THEN round(least(1.0, 2 * list_sum(list_transform(range(0, least(better, worse) + 1), lambda i: exp(lgamma(better + worse + 1) - lgamma(i + 1) - lgamma(better + worse - i + 1) - (better + worse) * ln(2))))), 6) END AS p FROM c",
)
def mcnemar_exact(t):
    rows = labelled(t).groupBy("source").agg(
        F.count_if(F.col("quality") < 1 - F.col("toxic")).alias("better"),
        F.count_if(F.col("quality") > 1 - F.col("toxic")).alias("worse"),
    )
    return rows.withColumn("p", stats.mcnemar_p(F.col("better"), F.col("worse")))


@named("wilcoxon")
def wilcoxon(t):
    pairs = t.lineitem.select(F.month("l_shipdate").alias("g"), (F.col("l_discount") - F.col("l_tax")).alias("diff"))
    return stats.wilcoxon_p(pairs, ["g"])


@named("bootstrap_ci")
def bootstrap_ci(t):
    return stats.bootstrap_ci(labelled(t).select("lang", F.col("quality").cast("double").alias("v")), ["lang"], "v")


_HALVES = (
    "h AS (SELECT event_type, round(avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16'), 6) AS before, round(avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16'), 6) AS after, event_type <> 'error' AS up FROM events GROUP BY event_type)"
)


@named(
    "regression_compare",
    f"WITH {_HALVES} SELECT event_type, before, after, CASE WHEN before IS NULL OR after IS NULL THEN 'missing' WHEN (CASE WHEN up THEN after - before ELSE before - after END) < -greatest(0.05, 0.02 * abs(before)) THEN 'regression' "
    "WHEN (CASE WHEN up THEN after - before ELSE before - after END) > greatest(0.05, 0.02 * abs(before)) THEN 'improvement' ELSE 'ok' END AS verdict FROM h",
)
def regression_compare(t):
    """Mean value per kind in the first and the second half of the month; for errors, lower is better."""
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    means = lambda cond: t.events.where(cond).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("value"))
    base = means(half).withColumn("higher_is_better", F.col("event_type") != "error")
    done = stats.regression(base, means(~half), ["event_type"], absolute=0.05, relative=0.02)
    return done.select("event_type", "before", "after", "verdict")


@named(
    "gates",
    f"WITH {METRICS} SELECT qid, CASE WHEN recall IS NULL THEN 'NOT MEASURED' WHEN recall >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS recall_gate, CASE WHEN mrr IS NULL THEN 'NOT MEASURED' WHEN mrr >= 0.3 THEN 'PASS' ELSE 'FAIL' END AS mrr_gate FROM m",
)
def gates(t):
    return scored(t).select(
        "qid",
        stats.gate(F.col("recall"), F.lit(0.5)).alias("recall_gate"),
        stats.gate(F.col("mrr"), F.lit(0.3)).alias("mrr_gate"),
    )


@named(
    "null_aware_means",
    f"WITH {METRICS} SELECT qid % 4 AS category, count(*) AS n, count(recall) AS n_measured, round(avg(recall), 6) AS recall, round(avg(CAST(mrr AS DOUBLE)), 6) AS mrr FROM m GROUP BY ALL",
)
def null_aware_means(t):
    return scored(t).groupBy((F.col("qid") % 4).alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("recall").alias("n_measured"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg("mrr"), 6).alias("mrr"),
    )


@named(
    "error_categories",
    f"WITH {METRICS}, e AS (SELECT qid, list_filter([CASE WHEN n_gold > 0 AND recall = 0 THEN 'RETRIEVAL_FAILURE' END, CASE WHEN recall > 0 AND recall < 1 THEN 'EVIDENCE_FAILURE' END, CASE WHEN success = 1 AND mrr < 0.5 THEN 'RANKING_FAILURE' END, CASE WHEN n_gold = 0 THEN 'NOT_ANSWERABLE' END], lambda x: x IS NOT NULL) AS labels FROM m) "
    "SELECT qid, array_to_string(labels, ',') AS labels FROM e",
)
def error_categories(t):
    rules = [
        ("RETRIEVAL_FAILURE", (F.col("n_gold") > 0) & (F.col("recall") == 0)),
        ("EVIDENCE_FAILURE", (F.col("recall") > 0) & (F.col("recall") < 1)),
        ("RANKING_FAILURE", (F.col("success") == 1) & (F.col("mrr") < 0.5)),
        ("NOT_ANSWERABLE", F.col("n_gold") == 0),
    ]
    return scored(t).select("qid", F.array_join(metrics.error_labels(rules), ",").alias("labels"))


@named(
    "difficulty_points",
    f"WITH {GOLD}, g AS (SELECT qid, count(*) AS n FROM gold GROUP BY qid), f AS (SELECT b.item_id AS qid, greatest(coalesce(g.n, 0) - 1, 0) + CASE WHEN regexp_matches(b.text, '\\d') THEN 1 ELSE 0 END + CASE WHEN g.n IS NULL THEN 1 ELSE 0 END + CASE WHEN len(regexp_extract_all(b.text, '[\\p{{L}}\\p{{N}}_]+')) > 40 THEN 2 ELSE 0 END AS points FROM benchmark b LEFT JOIN g ON g.qid = b.item_id) "
    "SELECT qid, points, CASE WHEN points = 0 THEN 'EASY' WHEN points = 1 THEN 'MEDIUM' WHEN points <= 3 THEN 'HARD' ELSE 'VERY_HARD' END AS difficulty FROM f",
)
def difficulty_points(t):
    n = gold(t).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    rows = passages(t).join(n, "qid", "left")
    flag = lambda cond, p: F.when(cond, p).otherwise(0)
    points = (
        F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0))
        + flag(F.col("query").rlike(r"\d"), 1)
        + flag(F.col("n").isNull(), 1)
        + flag(F.regexp_count("query", F.lit(r"[\p{L}\p{N}_]+")) > 40, 2)
    )
    return rows.select("qid", points.alias("points")).withColumn("difficulty", metrics.difficulty(F.col("points")))


@named(
    "leakage_ngrams",
    "WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM benchmark), d AS (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM documents), "
    "z AS (SELECT DISTINCT least(len(ws), 8) AS n FROM b WHERE len(ws) > 0), "
    "bs AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(ws) - least(len(ws), 8) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 8) - 1], ' ')))) AS s FROM b WHERE len(ws) > 0), "
    "ds AS (SELECT DISTINCT unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS s FROM d CROSS JOIN z WHERE len(ws) >= n), "
    "l AS (SELECT bs.item_id, bs.s IN (SELECT s FROM ds) AS seen FROM bs) "
    "SELECT b.item_id, count(l.seen) AS n_runs, count(*) FILTER (WHERE l.seen) AS n_seen FROM b LEFT JOIN l USING (item_id) GROUP BY b.item_id",
)
def leakage_ngrams(t):
    """Eight-word runs of every passage that also occur in the documents; a shorter passage is one run."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0).alias("ws")
    items = t.benchmark.select("item_id", words).withColumn("n", F.least(F.size("ws"), F.lit(8)))

    def runs(n):
        return F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice(F.col("ws"), i, n), " "))

    wanted = items.where("n > 0").select("item_id", F.explode(F.array_distinct(runs(F.col("n")))).alias("s"))
    lengths = items.where("n > 0").select("n").distinct()  # eight rows at most
    docs = metrics.needed(spread(t.documents.select("doc_id", "text"), "doc_id").select(words), lengths, 8).where(F.size("ws") >= F.col("n"))
    seen = docs.select(F.explode(runs(F.col("n"))).alias("s")).join(wanted.select("s").distinct(), "s", "left_semi").distinct()
    marked = wanted.join(seen.withColumn("seen", F.lit(True)), "s", "left")
    counts = marked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("seen").alias("n_seen"))
    zero = F.lit(0).cast("long")
    return items.join(counts, "item_id", "left").select(
        "item_id", F.coalesce("n_runs", zero).alias("n_runs"), F.coalesce("n_seen", zero).alias("n_seen")
    )


# --- matching of needs ------------------------------------------------------------------------------------------


def need_pairs(t):
    """Pairs of needs of neighbouring requests: three needs on each side."""
    rows = t.benchmark.select(
        F.floor(F.col("item_id") / 3).alias("uid"), F.col("item_id").alias("item"), tx.terms(F.col("text")).alias("ts")
    )
    earlier = rows.select((F.col("uid") + 1).alias("uid"), F.col("item").alias("b"), F.col("ts").alias("tb"))
    return rows.select("uid", F.col("item").alias("a"), F.col("ts").alias("ta")).join(earlier, "uid")


@named(
    "match_scores",
    f"WITH n AS (SELECT item_id // 3 AS uid, item_id AS item, list_distinct({sql_terms('text')}) AS ts FROM benchmark), p AS (SELECT x.uid, x.item AS a, y.item AS b, len(list_intersect(x.ts, y.ts)) AS i, len(x.ts) AS la, len(y.ts) AS lb FROM n x JOIN n y ON y.uid + 1 = x.uid) "
    "SELECT uid, a, b, round(i / (la + lb - i), 6) AS jaccard, round(i / lb, 6) AS containment, round(2 * i / (la + lb), 6) AS f1 FROM p",
)
def match_scores(t):
    a, b = F.col("ta"), F.col("tb")
    return need_pairs(t).select(
        "uid",
        "a",
        "b",
        F.round(jaccard(a, b), 6).alias("jaccard"),
        F.round(containment(b, a), 6).alias("containment"),
        F.round(term_f1(a, b), 6).alias("f1"),
    )


@named("greedy_match")
def greedy_match(t):
    pairs = match_scores(t)
    return matching.greedy_matching(pairs.select("uid", "a", "b", (F.col("jaccard") + F.col("containment")).alias("score")))


@named("hungarian_match")
def hungarian_match(t):
    return matching.optimal_matching(match_scores(t).withColumnRenamed("f1", "score"))
