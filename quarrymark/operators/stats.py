"""Descriptive and paired statistics.  Groups too small for a figure give NULL, never 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymark.operators.ordered import Split

# How many samples a percentile needs, how many pairs a test needs, the resampling seed.
PERCENTILE_GATES = {"p50": (0.5, 1), "p90": (0.9, 10), "p95": (0.95, 20), "p99": (0.99, 100)}
MIN_PAIRS = 20
MIN_NONZERO = 6
SEED = 20261004
RESAMPLES = 10_000
RANGES = 64


def exact_percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, n, one column per percentile), linearly interpolated at (n - 1) p.

    Equal values are counted in every task first.  The running count over the distinct values is cut into value ranges, so
    even a group that holds most of the rows is ordered by many tasks.
    """
    v = F.col(value).cast("double")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # range edges at equal shares of the distinct values, so no range holds much more than its share
    shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    edges = counted.agg(F.percentile_approx("_v", shares, F.lit(100 * RANGES))).scalar()
    below = F.size(F.filter("_edges", lambda e: e <= F.col("_v")))
    counted = counted.withColumn("_edges", edges).withColumn("_range", below).drop("_edges")
    split = Split(keys, ["_v"], F.col("_range"))
    running = split.running_sum(counted, "_upto", F.col("_c"))
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("n"))
    placed = running.join(sizes, keys)

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("_upto") > index, F.col("_v")))

    picks = []
    for name, p in wanted.items():
        position = (F.col("n") - 1) * F.lit(p)
        picks += [at(F.floor(position)).alias(f"_lo_{name}"), at(F.ceil(position)).alias(f"_hi_{name}")]
    found = placed.groupBy(*keys, "n").agg(*picks)

    def between(name: str, p: float) -> Column:
        position = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (position - F.floor(position))).alias(name)

    return found.select(*keys, "n", *[between(name, p) for name, p in wanted.items()])


def describe(df: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """n, mean, median and sample deviation."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(
        F.round(F.avg(v), digits).alias("mean"),
        F.round(F.stddev_samp(v), digits).alias("std"),
    )
    middle = exact_percentiles(df, keys, value, {"median": 0.5})
    return base.join(middle, keys).select(*keys, "n", "mean", F.round("median", digits).alias("median"), "std")


def gated_percentiles(df: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """Percentiles, each only from its minimum sample size on."""
    every = exact_percentiles(df, keys, value, {name: p for name, (p, _) in PERCENTILE_GATES.items()})
    columns = [
        F.when(F.col("n") >= least, F.round(name, digits)).alias(name) for name, (_, least) in PERCENTILE_GATES.items()
    ]
    return every.select(*keys, "n", *columns)


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """NULL on a zero denominator."""
    return F.round(a / F.nullif(b, F.lit(0)), digits)


def precision_recall(df: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Micro counts and ratios of two boolean columns."""
    counts = df.groupBy(*keys).agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *keys,
        "tp",
        "fp",
        "fn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def ranked_differences(pairs: DataFrame, keys: list[str], diff: str = "diff", digits: int = 9) -> DataFrame:
    """Per distinct absolute non-zero difference: signed counts and the average rank of its tie group.

    Differences are counted per value first (combined in every task), so the ordered pass sees one row per distinct value.
    """
    d = F.round(F.col(diff), digits)
    tie = (
        pairs.where(d != 0)
        .groupBy(*keys, F.abs(d).alias("size"))
        .agg(F.count_if(d > 0).alias("pos"), F.count_if(d < 0).alias("neg"))
        .withColumn("n", F.col("pos") + F.col("neg"))
    )
    upto = Split(keys, ["size"], F.floor(F.log1p("size") * 16)).running_sum(tie, "upto", F.col("n"))
    return upto.withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2.0)


def paired_effects(pairs: DataFrame, keys: list[str], a: str, b: str, digits: int = 6) -> DataFrame:
    """Mean and median difference, d_z, rank-biserial correlation, discordant counts."""
    rows = pairs.withColumn("diff", F.col(b) - F.col(a))
    d = F.col("diff")
    base = rows.groupBy(*keys).agg(
        F.round(F.avg(d), digits).alias("mean_diff"),
        F.round(F.avg(d) / F.nullif(F.stddev_samp(d), F.lit(0.0)), digits).alias("d_z"),
        F.count_if(d > 0).alias("n_better"),
        F.count_if(d < 0).alias("n_worse"),
    )
    ranks = ranked_differences(rows, keys).groupBy(*keys).agg(
        F.sum(F.col("rank") * F.col("pos")).alias("r_pos"),
        F.sum(F.col("rank") * F.col("neg")).alias("r_neg"),
    )
    biserial = F.round((F.col("r_pos") - F.col("r_neg")) / (F.col("r_pos") + F.col("r_neg")), digits)
    middle = exact_percentiles(rows, keys, "diff", {"median_diff": 0.5})
    return (
        base.join(middle, keys)
        .join(ranks, keys, "left")
        .select(*base.columns, "n", F.round("median_diff", digits).alias("median_diff"), biserial.alias("rank_biserial"))
    )


def mcnemar_p(better: Column, worse: Column, digits: int = 6) -> Column:
    """Two-sided exact binomial on the discordant pairs: log-space sum of C(n, i) / 2^n up to the smaller count."""
    n = (better + worse).cast("int")
    m = F.least(better, worse).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("lp"), F.lit(0.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        lp = F.when(i == 0, acc["lp"]).otherwise(acc["lp"] + F.log((n - i + 1) / F.greatest(i, F.lit(1))))
        return F.struct(lp.alias("lp"), (acc["s"] + F.exp(lp)).alias("s"))

    tail = F.aggregate(F.sequence(F.lit(0), m), start, step, lambda acc: acc["s"])
    return F.when(n > 0, F.round(F.least(F.lit(1.0), 2 * tail), digits))


def wilcoxon_p(pairs: DataFrame, keys: list[str], diff: str = "diff", digits: int = 6) -> DataFrame:
    """(keys, n_nonzero, w, p): signed-rank statistic with the tie-corrected normal approximation; too few pairs give NULL.

    The error function comes from numpy on one row per group.
    """
    ties = ranked_differences(pairs, keys, diff)
    per = ties.groupBy(*keys).agg(
        F.sum("n").alias("n_nonzero"),
        F.sum(F.col("rank") * F.col("pos")).alias("r_pos"),
        F.sum(F.col("rank") * F.col("neg")).alias("r_neg"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("tie"),
    )
    n = F.col("n_nonzero").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48
    w = F.least("r_pos", "r_neg")
    z = (w - n * (n + 1) / 4) / F.sqrt(var)
    return per.select(
        *keys,
        "n_nonzero",
        w.alias("w"),
        F.when((n >= MIN_NONZERO) & (var > 0), F.round(F.least(F.lit(1.0), normal_two_sided(z)), digits)).alias("p"),
    )


@F.pandas_udf(T.DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    from math import erfc, sqrt

    return z.map(lambda v: None if v is None or np.isnan(v) else erfc(abs(v) / sqrt(2.0)))


def normal_two_sided(z: Column) -> Column:
    return _normal_two_sided(z)


def bootstrap_ci(
    df: DataFrame, keys: list[str], value: str, resamples: int = RESAMPLES, block: int = 4096, digits: int = 4
) -> DataFrame:
    """Percentile interval of the mean over seeded multinomial resamples.

    The distinct values of a group are hashed into blocks.  A resample first draws how many samples fall into each block, then
    every block draws its own values; that is the same multinomial, but no task holds more than one block of values and one
    slice of the resamples.  The number of blocks follows the number of distinct values, ``block`` of them each.
    """
    slices = 8
    per = -(-resamples // slices)
    take = [min(per, max(resamples - per * i, 0)) for i in range(slices)]
    v = F.col(value).cast("double")
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    blocks = counted.agg(F.ceil(F.greatest(F.count(F.lit(1)), F.lit(1)) / block)).scalar()
    placed = counted.withColumn("block", F.pmod(F.xxhash64("v"), blocks).cast("int"))
    sizes = placed.groupBy(*keys, "block").agg(
        F.sum("c").alias("size"), F.array_sort(F.collect_list(F.struct("v", "c"))).alias("d")
    )
    shares = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "size"))).alias("shares"))
    work = shares.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(*keys, "slice")
    types = {f.name: f.dataType.simpleString() for f in sizes.schema.fields}
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def allot(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                size = np.array([x["size"] for x in row.shares], dtype=np.int64)
                rng = np.random.default_rng([SEED, int(row.slice)])
                drawn = rng.multinomial(size.sum(), size / size.sum(), size=take[int(row.slice)])
                yield pd.DataFrame(
                    {
                        **{k: getattr(row, k) for k in keys},
                        "slice": row.slice,
                        "block": [x["block"] for x in row.shares],
                        "n": int(size.sum()),
                        "draws": list(drawn.T),
                    }
                )

    allotted = work.select(*keys, "slice", "shares").mapInPandas(
        allot, f"{head}, slice int, block int, n long, draws array<long>"
    )

    def draw(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                values = np.array([x["v"] for x in row.d])
                counts = np.array([x["c"] for x in row.d], dtype=np.float64)
                rng = np.random.default_rng([SEED, int(row.slice), int(row.block)])
                sums = rng.multinomial(np.asarray(row.draws), counts / counts.sum()) @ values
                yield pd.DataFrame(
                    {**{k: getattr(row, k) for k in keys}, "slice": row.slice, "r": range(len(sums)), "part": sums / row.n}
                )

    joined = allotted.join(sizes.select(*keys, "block", "d"), [*keys, "block"])
    parts = joined.select(*keys, "slice", "block", "n", "draws", "d").mapInPandas(draw, f"{head}, slice int, r int, part double")
    means = parts.groupBy(*keys, "slice", "r").agg(F.sum("part").alias("mean"))
    return means.groupBy(*keys).agg(
        F.round(F.percentile("mean", F.lit(0.025)), digits).alias("ci_low"),
        F.round(F.percentile("mean", F.lit(0.975)), digits).alias("ci_high"),
        F.count(F.lit(1)).alias("n_resamples"),
    )


def regression(base: DataFrame, current: DataFrame, keys: list[str], absolute: float, relative: float) -> DataFrame:
    """ok / improvement / regression / missing per metric; the tolerance is max(absolute, relative x |baseline|)."""
    both = base.withColumnRenamed("value", "before").join(current.withColumnRenamed("value", "after"), keys, "full_outer")
    delta = F.when(F.col("higher_is_better"), F.col("after") - F.col("before")).otherwise(F.col("before") - F.col("after"))
    slack = F.greatest(F.lit(absolute), relative * F.abs("before"))
    verdict = (
        F.when(F.col("before").isNull() | F.col("after").isNull(), "missing")
        .when(delta < -slack, "regression")
        .when(delta > slack, "improvement")
        .otherwise("ok")
    )
    return both.withColumn("verdict", verdict)


def gate(value: Column, least: Column) -> Column:
    return F.when(value.isNull(), "NOT MEASURED").when(value >= least, "PASS").otherwise("FAIL")
