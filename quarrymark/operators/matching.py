"""One-to-one matching inside each request."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymark.session import durable

SCHEMA = "uid long, a long, b long, score double"


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """Best score first (then smaller a, then smaller b), each side used once.

    A pair that is the best of both its sides is in the result whatever happens elsewhere; taking all such pairs at once and
    dropping what they block gives the same matching as going through the list, for all requests together.
    """
    left = durable(pairs.select("uid", "a", "b", F.col("score").cast("double").alias("score")).distinct())
    order = [F.col("score").desc(), F.col("a"), F.col("b")]
    found: DataFrame | None = None
    while not left.isEmpty():
        ranked = left.withColumns(
            {
                "of_a": F.row_number().over(Window.partitionBy("uid", "a").orderBy(*order)),
                "of_b": F.row_number().over(Window.partitionBy("uid", "b").orderBy(*order)),
            }
        )
        chosen = durable(ranked.where("of_a = 1 AND of_b = 1").select("uid", "a", "b", "score"))
        found = chosen if found is None else found.unionByName(chosen)
        free = left.join(chosen.select("uid", "a"), ["uid", "a"], "left_anti")
        left = durable(free.join(chosen.select("uid", "b"), ["uid", "b"], "left_anti").select("uid", "a", "b", "score"))
    return left if found is None else found


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of largest total gain, by shortest augmenting paths over reduced costs (cubic in the longer side)."""
    n, m = gain.shape
    if n > m:
        return [(r, c) for c, r in assignment(gain.T)]
    cost = gain.max() - gain
    row_price, column_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)  # the last column is where each new row starts
    for row in range(n):
        owner[m] = row
        at = m
        slack, came = np.full(m, np.inf), np.full(m, m)
        used = np.zeros(m + 1, bool)
        while owner[at] >= 0:
            used[at] = True
            reduced = cost[owner[at]] - row_price[owner[at]] - column_price[:m]
            better = ~used[:m] & (reduced < slack)
            slack[better], came[better] = reduced[better], at
            step_to = int(np.argmin(np.where(used[:m], np.inf, slack)))
            step = slack[step_to]
            row_price[owner[used]] += step
            column_price[used] -= step
            slack[~used[:m]] -= step
            at = step_to
        while at != m:
            owner[at], at = owner[came[at]], came[at]
        owner[m] = -1
    return [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]


def _optimal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Largest total score among one request's pairs; pairs that are not listed are no pairs."""
    table = pdf.pivot_table(index="a", columns="b", values="score", aggfunc="max")
    chosen = [(table.index[i], table.columns[j]) for i, j in assignment(table.fillna(0.0).to_numpy(float)) if pd.notna(table.iat[i, j])]
    rows = [(pdf["uid"].iloc[0], a, b, table.at[a, b]) for a, b in chosen]
    return pd.DataFrame(rows, columns=["uid", "a", "b", "score"])


def optimal_matching(pairs: DataFrame) -> DataFrame:
    """Scores are positive; a pair with score zero adds nothing and is left out."""
    slim = pairs.select("uid", "a", "b", "score").where("score > 0")
    return slim.groupBy("uid").applyInPandas(_optimal, SCHEMA)
