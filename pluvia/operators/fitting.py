"""Gamma parameters per key and what is drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions import gamma
from pluvia.operators import climatology
from pluvia.sources import writers


SUMS = ("n", "total", "total_log", "max_mm")


def gamma_fit(sample: DataFrame, *keys: str, lower: float = 0.0) -> DataFrame:
    """Maximum likelihood shape and scale of ``mm`` (> 0) per key, both at or above ``lower``.

    The sample is reduced to three averages per key before any shuffle; the iteration then
    runs on one row per key. Below two values, or if all are equal, both are NULL.
    """
    return fit_of_stats(climatology.stats(sample, *keys), *keys, lower=lower)


def batch_sums(sample: DataFrame, batch: Column, *keys: str) -> DataFrame:
    """What a fit needs of a sample, a row for each key and batch: ``n, total, total_log, max_mm``.

    Rows of one key add up to those of its batches together, so they can be stored and merged.
    """
    return sample.groupBy(*keys, batch.cast("string").alias("batch")).agg(
        F.count("mm").alias("n"), F.sum("mm").alias("total"),
        F.sum(F.ln("mm")).alias("total_log"), F.max("mm").alias("max_mm"),
    )


def merged(sums: DataFrame, *keys: str) -> DataFrame:
    """``batch_sums`` of any batches as the statistics of their samples together."""
    added = sums.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS[:3]], F.max("max_mm").alias("max_mm")
    )
    return added.filter("n > 0").select(
        *keys, "n", (F.col("total") / F.col("n")).alias("mean"),
        (F.col("total_log") / F.col("n")).alias("mean_log"), "max_mm",
    )


def store_sums(sample: DataFrame, batch: Column, path: str, *keys: str) -> None:
    """Adds the batches of a sample to the stored sums. A batch that is there already is replaced, so a
    replay changes nothing; a batch must come whole."""
    writers.stage(batch_sums(sample, batch, *keys), path, "batch")


def stored_sums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def refit(spark: SparkSession, path: str, *keys: str, lower: float = 0.0) -> DataFrame:
    """``gamma_fit`` of all stored batches, from one row a key and batch; no history is read."""
    return fit_of_stats(merged(stored_sums(spark, path), *keys), *keys, lower=lower)


def compact_sums(spark: SparkSession, path: str, out: str, batch: str, *keys: str) -> None:
    """All stored batches as one, in another folder to which later ones can be added."""
    sums = stored_sums(spark, path)
    added = sums.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in SUMS[:3]], F.max("max_mm").alias("max_mm")
    )
    writers.stage(added.withColumn("batch", F.lit(batch)), out, "batch", whole=True)


def fit_of_stats(stats: DataFrame, *keys: str, lower: float = 0.0) -> DataFrame:
    """``gamma_fit`` from the size, mean and mean logarithm of each key."""
    gap = F.ln("mean") - F.col("mean_log")
    fit = (
        stats.withColumn("gap", F.when((F.col("n") >= 2) & (gap > 1e-12), gap))
        .withColumn("shape", gamma.mle_shape("gap"))
        .withColumn("scale", F.col("mean") / F.col("shape"))
    )
    if lower > 0:
        fit = _into_box(fit, float(lower))
    return fit.select(*keys, "n", "shape", "scale")


def _into_box(fit: DataFrame, lower: float) -> DataFrame:
    """The best shape and scale at or above ``lower``, from the free maximum.

    The likelihood is concave in (shape, 1/scale): if the free maximum is outside the box,
    the best point lies on one of its two faces. Each step is a column of its own, so none
    is computed twice.
    """
    outside = (F.col("shape") < lower) | (F.col("scale") < lower)
    faces = (
        fit.withColumn("bound", F.when(outside, F.lit(lower)))
        .withColumn("face_scale", F.greatest(F.lit(lower), F.col("mean") / F.col("bound")))
        .withColumn("target", F.col("mean_log") - F.ln("bound"))
        .withColumn("root", gamma.inverse_digamma("target"))
        .withColumn("face_shape", F.greatest(F.lit(lower), F.col("root")))
    )
    at_shape = gamma.mean_log_likelihood("bound", "face_scale", "mean", "mean_log")
    at_scale = gamma.mean_log_likelihood("face_shape", "bound", "mean", "mean_log")
    wins = F.col("shape_wins")
    return faces.withColumn("shape_wins", at_shape >= at_scale).withColumns(
        {
            "shape": F.when(F.col("bound").isNull(), F.col("shape"))
            .when(wins, F.col("bound"))
            .otherwise(F.col("face_shape")),
            "scale": F.when(F.col("bound").isNull(), F.col("scale"))
            .when(wins, F.col("face_scale"))
            .otherwise(F.col("bound")),
        }
    )


def params_table(observed: DataFrame, model: DataFrame) -> DataFrame:
    """Both fits under one label column."""
    return observed.withColumn("source", F.lit("Observado")).unionByName(
        model.withColumn("source", F.lit("Reforecast")), allowMissingColumns=True
    )


def gamma_sample(params: DataFrame, *keys: str, n: int = 10_000, seed: int = 0) -> DataFrame:
    """``n`` draws from each fit.

    The uniform numbers are hashes of key and draw number, so a task that runs again
    draws the same values.
    """
    draws = params.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys],
                               F.col("draw").cast("string")))
    bits = F.conv(digest.substr(1, 13), 16, 10).cast("double")  # 13 hex digits, 52 bits
    uniform = (bits + 0.5) / float(2**52)
    mm = gamma.gamma_quantile(uniform, F.col("shape"), F.col("scale"))
    return draws.select(*keys, "draw", mm.alias("mm"))


def cdf_curve(params: DataFrame, limits: DataFrame, *keys: str, step: float = 0.1) -> DataFrame:
    """Distribution function of each fit on 0, step, 2 step ... up to the key's ``max_mm``."""
    count = F.floor(F.col("max_mm") / step + 1e-10)
    curve = params.join(limits, list(keys)).withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("bigint"), count))
    )
    curve = curve.withColumn("x", F.col("i") * step)
    f = gamma.gamma_cdf(F.col("x"), F.col("shape"), F.col("scale"))
    return curve.select(*keys, "source", "i", "x", f.alias("f"))
