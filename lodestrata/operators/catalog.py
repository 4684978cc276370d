"""Tables that are looked up again and again by the same key: bucketed, so that lookups need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(df: DataFrame, keys: list[str], what: str, buckets: int | None = None) -> DataFrame:
    """df as a table of the warehouse, dealt out by keys once: joins and groupings by them read it as it lies.

    Tables that are to meet need the same number of buckets (that of shuffle partitions, if it is not given) and keys in the same order. The exchange
    before the write makes one file a bucket. The table stays in the catalog, under a name of its own that begins with what.
    """
    n = buckets or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    name = f"{what}_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def lookups(refs: DataFrame, targets: dict[str, DataFrame], ref: str, key: str) -> DataFrame:
    """refs with a boolean column for each target that tells whether it holds the ordinal; all targets are bucketed by key, refs by ref."""
    out = refs
    for name, target in targets.items():
        out = out.join(target.select(F.col(key).alias(f"_{name}"), F.lit(True).alias(name)), F.col(ref) == F.col(f"_{name}"), "left")
        out = out.withColumn(name, F.coalesce(name, F.lit(False))).drop(f"_{name}")
    return out
