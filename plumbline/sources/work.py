"""Working tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a temporary folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="plumbline-work-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


class Work:
    """Tables of one run. Writing a table and reading it back ends its lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/plumbline-run/{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(conf).delete(p, True)


def numbered(work: Work, df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """df with consecutive numbers in a total order.

    Rows are range-partitioned and sorted; the partitions' counts (a row each)
    give every partition its first number, so no single task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = work.keep(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, at = [], start
    for p in sorted(counts):
        first.append((p, at))
        at += counts[p]
    firsts = df.sparkSession.createDataFrame(first, "__p long, __first long")
    return placed.join(F.broadcast(firsts), part == F.col("__p"), "left").withColumn(name, (F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__at", "__p", "__first")
