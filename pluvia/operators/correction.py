"""Bias correction of station forecasts by quantile mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions.gamma import gamma_quantile_map


def quantile_map(
    series: DataFrame, model: DataFrame, observed: DataFrame, month: int | None = None
) -> DataFrame:
    """Map forecasts (``location, cell_id, valid_date, mm``) onto the observed distribution.

    ``model`` holds fits by (cell_id, month), ``observed`` by (location, month). With ``month``
    every day uses that month's fits, otherwise each day those of its own month. A dry day
    stays 0; a day without both fits is NULL.
    """
    fit_month = F.month("valid_date") if month is None else F.lit(month)
    rows = series.withColumn("month", fit_month)
    model = model.select(
        "cell_id", "month", F.col("shape").alias("m_shape"), F.col("scale").alias("m_scale")
    )
    observed = observed.select(
        "location", "month", F.col("shape").alias("o_shape"), F.col("scale").alias("o_scale")
    )
    if month is not None:
        model, observed = (df.filter(F.col("month") == month) for df in (model, observed))
    joined = rows.join(model, ["cell_id", "month"], "left").join(
        observed, ["location", "month"], "left"
    )
    mapped = gamma_quantile_map(F.col("mm"), "m_shape", "m_scale", "o_shape", "o_scale")
    return joined.select("location", "valid_date", "mm", mapped.alias("mm_corrected"))
