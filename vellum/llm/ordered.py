"""Global order without a single sorting task: rows go to buckets of consecutive ids, one partition each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(df: DataFrame, column: str, parts: int) -> np.ndarray:
    """At most parts - 1 ascending ids that split the rows about evenly; one pass over this column."""
    if parts < 2:
        return np.zeros(0, np.int64)
    found = df.select(F.percentile_approx(column, [k / parts for k in range(1, parts)], 100 * parts).alias("q")).first()["q"]
    return np.unique(np.array(found or [], np.int64))


def parts_for(df: DataFrame) -> int:
    """As many buckets as the session shuffles into."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, bucket: str, parts: int, *order: str) -> DataFrame:
    """Bucket k in partition k, sorted within."""
    return df.repartitionById(parts, F.col(bucket)).sortWithinPartitions(bucket, *order)
