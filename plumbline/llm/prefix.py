"""Distributed prefix sums: order rows globally without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import common


def prefix_sums(scratch: common.Scratch, df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], name: str = "") -> DataFrame:
    """Add, for each {name: value}, the sum of value over the rows before in `order`, by `keys`.

    Rows are range-partitioned by keys and order, so a key that holds most rows
    is cut over many partitions. Each partition's totals are summed by key (a
    row for each partition and key), their running sums become the offsets of
    the partitions, and only then is a running sum taken within each partition.
    Rows that tie in all of `order` are taken in any order; pass enough columns.
    `name` tells the calls of one scratch folder apart.
    """
    # null keys get a text of their own, so that joins and windows below share one partitioning
    named = {k: F.when(F.col(k).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(k).cast("string"))) for k in keys}
    # written first: the range partitioning reads its input twice, once for a sample
    narrow = scratch.keep(df, f"{name}narrow")
    ranged = narrow.withColumns({f"_k_{k}": c for k, c in named.items()}).repartitionByRange(common.partitions(df.sparkSession), *[f"_k_{k}" for k in keys], *order)
    rows = scratch.keep(ranged.withColumn("_part", F.spark_partition_id()), f"{name}ranged")
    by = [f"_k_{k}" for k in keys]
    totals = rows.groupBy("_part", *by).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *by, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(offsets, ["_part", *by])
    return joined.select(*df.columns, *[(F.col(f"_b_{n}") + F.sum(v).over(own) - F.col(v)).alias(n) for n, v in sums.items()])
