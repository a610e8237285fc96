"""A train and test split that does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_split(
    df: DataFrame, key: str = "trace_id", share: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the first byte of the md5 of ``key``; without one, of the whole row."""
    limit = f"{round(share * 256):02x}"
    identity = F.coalesce(F.col(key).cast("string"), F.to_json(F.struct(*df.columns)))
    first_byte = F.substring(F.md5(identity), 1, 2)
    in_train = (first_byte < limit) if limit != "100" else F.lit(True)
    return df.where(in_train), df.where(~in_train)
