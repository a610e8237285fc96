"""Load forecast per service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86_400}
# 2020-01-01: units are counted from a time near the data, which keeps the sums exact.
ORIGIN = 1_577_836_800


def service_load_trend(df: DataFrame, unit: str = "hour", horizon: int = 1) -> DataFrame:
    """Linear trend of the records per unit of time, by service.

    Units without a record count as 0. They add nothing to the sums over the
    counts, and the sums over the unit numbers 0..n-1 are known, so no calendar
    has to be generated. Gives the forecast ``horizon`` units past the last one,
    its change against the mean load in percent, and r2 as the confidence.
    """
    seconds = UNIT_SECONDS[unit]
    since = F.unix_seconds(F.col("timestamp").cast("timestamp")) - ORIGIN
    unit_number = F.floor(since / seconds)
    counts = df.groupBy("service", unit_number.alias("unit")).agg(F.count("*").alias("logs"))
    # Unit numbers are taken from a fixed origin first and moved to the first
    # unit of the service after the sums, which keeps it to one aggregation.
    # Squares of large counts overflow a BIGINT, hence doubles.
    u, y = F.col("unit"), F.col("logs").cast("double")
    sums = counts.groupBy("service").agg(
        F.min("unit").alias("first"),
        (F.max("unit") - F.min("unit") + 1).alias("n"),
        F.sum(y).alias("sy"),
        F.sum(y * y).alias("syy"),
        F.sum(u * y).alias("suy"),
    )
    n, sy, syy = F.col("n").cast("double"), F.col("sy"), F.col("syy")
    sxy = F.col("suy") - F.col("first") * sy
    sx = n * (n - 1) / 2
    sxx = n * (n - 1) * (2 * n - 1) / 6
    fitted = sums.select(
        "service",
        n.alias("n"),
        (sy / n).alias("mean_load"),
        F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx).alias("slope"),
        (n * sxy - sx * sy).alias("cov"),
        (n * sxx - sx * sx).alias("var_x"),
        (n * syy - sy * sy).alias("var_y"),
    )
    last = F.col("n") - 1
    forecast = F.col("mean_load") + F.col("slope") * (last / 2 + horizon)
    r2 = F.try_divide(F.col("cov") * F.col("cov"), F.col("var_x") * F.col("var_y"))
    return fitted.select(
        "service",
        F.col("n").cast("bigint").alias("units"),
        "mean_load",
        "slope",
        forecast.alias("predicted_load"),
        (F.try_divide(forecast, F.col("mean_load")) * 100 - 100).alias("change_pct"),
        r2.alias("confidence"),
    )
