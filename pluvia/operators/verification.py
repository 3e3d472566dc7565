"""Forecast against observation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.config import WET_FORECAST, WET_OBSERVED
from pluvia.functions import units


def compare_outer(forecast: DataFrame, obs: DataFrame, *keys: str) -> DataFrame:
    """Both series on one axis; a day only one of them has keeps NULL for the other."""
    left = forecast.select(*keys, units.known(F.col("mm")).alias("forecast"))
    right = obs.withColumnRenamed("obs_date", "valid_date").select(
        *keys, units.known(F.col("mm")).alias("observed")
    )
    return left.join(right, list(keys), "full_outer")


def pairs(forecast: DataFrame, obs: DataFrame) -> DataFrame:
    """Forecast and observation of the same station and day; NaN counts as missing."""
    left = forecast.select("location", "valid_date", units.known(F.col("mm")).alias("operational"))
    right = obs.select(
        "location", F.col("obs_date").alias("valid_date"),
        units.known(F.col("mm")).alias("registro"),
    )
    return left.join(right, ["location", "valid_date"])


def contingency(
    paired: DataFrame, *keys: str, tol_forecast: float = WET_FORECAST,
    tol_observed: float = WET_OBSERVED,
) -> DataFrame:
    """Hits, misses, false alarms and correct negatives.

    A forecast exactly at the threshold of a wet day is neither hit nor miss. Pairs with a
    NULL are left out and counted.
    """
    f, o = F.col("operational"), F.col("registro")
    wet = o > tol_observed
    return paired.groupBy(*keys).agg(
        F.count_if((f > tol_forecast) & wet).alias("n_hit"),
        F.count_if((f < tol_forecast) & wet).alias("n_miss"),
        F.count_if((f > tol_forecast) & ~wet).alias("n_fa"),
        F.count_if((f <= tol_forecast) & ~wet).alias("n_cn"),
        F.count_if(f.isNull() | o.isNull()).alias("n_excluded"),
    )


def skill_scores(table: DataFrame, *keys: str) -> DataFrame:
    """Six scores of a contingency table; NULL where the divisor is 0."""
    hit, miss, fa, cn = (F.col(c) for c in ("n_hit", "n_miss", "n_fa", "n_cn"))
    return table.select(
        *keys,
        F.try_divide(hit + cn, hit + miss + fa + cn).alias("accuracy"),
        F.try_divide(hit + fa, hit + miss).alias("bias_score"),
        F.try_divide(hit, hit + miss).alias("hit_rate"),
        F.try_divide(fa, hit + fa).alias("fa_ratio"),
        F.try_divide(fa, cn + fa).alias("fa_rate"),
        F.try_divide(hit, hit + fa).alias("success_ratio"),
    )


def continuous_scores(paired: DataFrame, *keys: str) -> DataFrame:
    """Mean, root mean square, absolute and percentage errors (observation - forecast).

    The percentages leave out days observed as 0, where they have no value.
    """
    e = F.col("registro") - F.col("operational")
    share = F.try_divide(e * 100.0, F.col("registro"))
    return paired.groupBy(*keys).agg(
        F.avg(e).alias("me"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(share).alias("mpe"),
        F.avg(F.abs(share)).alias("mape"),
    )


def ecdf(sample: DataFrame, *keys: str, bins: int = 64) -> DataFrame:
    """Empirical distribution function at each distinct value of ``mm``.

    Equal values are counted before the shuffle. Each key's distinct values are cut at its own
    quantiles into about ``bins`` ranges of like size, whatever their scale; counts run within a
    range and are shifted by the ranges below, so even one key with most rows spreads over tasks.
    """
    mm = units.known(F.col("mm"))
    group = ("group_", *keys)  # joins need a column even where there is one group only
    known = sample.filter(mm.isNotNull()).withColumn("group_", F.lit(0))
    counts = known.groupBy(*group, "mm").agg(F.count("*").alias("n"))
    shares = [i / bins for i in range(1, bins)]
    cuts = counts.groupBy(*group).agg(F.percentile_approx("mm", shares, 1000).alias("cuts"))
    at = F.size(F.filter("cuts", lambda c: c < F.col("mm")))
    placed = counts.join(cuts, list(group)).withColumn("bin", at).drop("cuts")
    by_bin = Window.partitionBy(*group).orderBy("bin")
    up_to = Window.unboundedPreceding, Window.currentRow
    sizes = placed.groupBy(*group, "bin").agg(F.sum("n").alias("in_bin"))
    sizes = sizes.select(
        *group, "bin",
        (F.sum("in_bin").over(by_bin.rowsBetween(*up_to)) - F.col("in_bin")).alias("below"),
        F.sum("in_bin").over(Window.partitionBy(*group)).alias("total"),
    )
    inside = Window.partitionBy(*group, "bin").orderBy("mm").rowsBetween(*up_to)
    running = placed.withColumn("running", F.sum("n").over(inside))
    share = (F.col("below") + F.col("running")) / F.col("total")
    return running.join(sizes, [*group, "bin"]).select(*keys, "mm", share.alias("f"))


def labelled_ecdf(samples: dict[str, DataFrame], *keys: str) -> DataFrame:
    """Distribution functions of several samples (``keys``, ``mm``) under a ``sample`` label."""
    stacked = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(name).alias("sample"), *keys, "mm") for name, df in samples.items()],
    )
    return ecdf(stacked, "sample", *keys)


#: Size of a sketch. Its rank error is below ``sketch_error`` for 99 of 100 ranks asked.
SKETCH_SIZE = 800


def sketch_error(size: int = SKETCH_SIZE) -> float:
    """The error of a rank, as a share of the sample, that one in a hundred exceeds (a fixed property of
    this kind of sketch: 2.296 / size ** 0.9021). Samples of up to ``size`` values are exact."""
    return 2.296 / size**0.9021


def batch_sketches(sample: DataFrame, batch: Column, *keys: str, size: int = SKETCH_SIZE) -> DataFrame:
    """A quantile sketch of ``mm`` for each key and batch, a few kilobytes whatever the sample's size.

    The sketches of a key's batches merge, so the distribution of all history costs one row a batch.
    NULL and NaN are left out. Sketches draw at random: two of one sample may differ within the error.
    """
    known = sample.withColumn("mm", units.known(F.col("mm"))).filter("mm IS NOT NULL")
    return known.groupBy(*keys, batch.cast("string").alias("batch")).agg(
        F.kll_sketch_agg_double("mm", F.lit(size)).alias("sketch")
    )


def merged_sketches(sketches: DataFrame, *keys: str, size: int = SKETCH_SIZE) -> DataFrame:
    """One sketch a key from those of any batches."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, *keys: str, shares: tuple[float, ...]) -> DataFrame:
    """``share, n, mm``: the value that this share of each key's sample does not exceed, about."""
    asked = [float(x) for x in shares]
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, asked)))
    pairs = F.arrays_zip(F.array(*map(F.lit, asked)).alias("share"), found.alias("mm"))
    return sketches.select(
        *keys, F.kll_sketch_get_n_double("sketch").alias("n"), F.explode(pairs).alias("q")
    ).select(*keys, "q.share", "n", "q.mm")


def sketch_cdf(sketches: DataFrame, values: DataFrame, *keys: str, steps: int = 1000) -> DataFrame:
    """``values`` (keys, ``mm``) with ``f``, the share of the key's sample that is not larger, about: the
    sketch's error and one of ``steps`` steps."""
    ranks = F.array(*[F.lit(i / steps) for i in range(1, steps + 1)])
    curves = sketches.select(*keys, F.kll_sketch_get_quantile_double("sketch", ranks).alias("curve_"))
    upto = F.size(F.filter("curve_", lambda q: q <= F.col("mm"))) / float(steps)
    return values.join(curves, list(keys)).withColumn("f", upto).drop("curve_")
