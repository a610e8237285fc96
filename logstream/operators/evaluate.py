"""Quality of a flag against a label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row of counts and ratios, in one pass.

    Rows without a label are left out; a ratio with an empty base is 0.
    """
    truth, found = F.col(label), F.col(prediction)

    def share(part, base):
        return F.coalesce(F.try_divide(part, base), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = F.col("precision"), F.col("recall")
    return (
        df.agg(
            F.count_if(truth & found).alias("tp"),
            F.count_if(~truth & found).alias("fp"),
            F.count_if(truth & ~found).alias("fn"),
            F.count_if(~truth & ~found).alias("tn"),
        )
        .withColumns(
            {
                "accuracy": share(tp + tn, tp + fp + fn + tn),
                "precision": share(tp, tp + fp),
                "recall": share(tp, tp + fn),
                "anomaly_rate": share(tp + fn, tp + fp + fn + tn),
            }
        )
        .withColumn("f1_score", share(2 * precision * recall, precision + recall))
    )
