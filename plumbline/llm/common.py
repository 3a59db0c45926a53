"""Plumbing shared by the training-data operators.

Shared scratch space, shipping of this package to executors, and the few
column conventions that all operators agree on (a null text counts as empty,
a document's own columns are found by name, other columns are ignored).
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; long documents make larger batches costly.
ARROW_ROWS = 1024

_shipped: set[str] = set()
_local_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Where that is unset a temporary folder is
    made, which is right in local mode alone; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return _local_root[0]


class Scratch:
    """A folder of one operator call in the shared space.

    Results are lazy and read from it, so nothing is removed on its own;
    ``release`` removes it once the caller has stored the result.
    """

    live: list["Scratch"] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/plumbline/{name}-{uuid.uuid4().hex[:12]}"
        prepare(spark)
        Scratch.live.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def folder(self, name: str) -> str:
        """A folder for files that tasks write by themselves."""
        fs, p = filesystem(self.path(name))
        fs.create_dir(p, recursive=True)
        return self.path(name)

    def keep(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write df as a table here and read it back: lineage ends, and executors may be lost."""
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        fs, p = filesystem(self.path(name))
        if fs.get_file_info(p).type != pafs.FileType.NotFound:
            fs.delete_dir(p)

    def release(self) -> None:
        fs, p = filesystem(self.root)
        if fs.get_file_info(p).type != pafs.FileType.NotFound:
            fs.delete_dir(p)
        if self in Scratch.live:
            Scratch.live.remove(self)


def release_all() -> None:
    """Remove the scratch folders of all operator calls so far."""
    for scratch in list(Scratch.live):
        scratch.release()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors once, and keep Arrow batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():
        folder = os.path.realpath(tempfile.mkdtemp(prefix="plumbline-ship-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = f"{folder}/plumbline_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, str(Path(package.name) / p.relative_to(package)))
        spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns that say where a row stands: its file and its number in the file.
FILE, PLACE = "__file", "__place"


def placed(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """docs with FILE and PLACE, the same in every reading.

    A table read from Parquet files has them already; any other is written first.
    """
    at = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(PLACE)]
    try:
        return docs.select("*", *at)
    except AnalysisException:
        return scratch.keep(docs, "placed").select("*", *at)


def without(scratch: Scratch, docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs of placed() without the rows at the places of `dropped`.

    The dropped places are stored by file, and each reader of a file looks its
    rows up there, so texts are not shuffled. A list has a number for each
    dropped row of one file.
    """
    folder = scratch.folder("dropped")

    def name(file: str) -> str:
        return hashlib.sha256(file.encode()).hexdigest()

    def store(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fs, p = filesystem(f"{folder}/{name(key[0])}")
        fs.create_dir(p, recursive=True)
        rows = np.unique(pdf[PLACE].to_numpy("<i8"))
        with fs.open_output_stream(f"{p}/{attempt_name()}") as out:
            out.write(np.array([len(rows)], "<i8").tobytes() + rows.tobytes())
        return pdf[:0][[FILE]]

    scratch.keep(dropped.select(FILE, PLACE).groupBy(FILE).applyInPandas(store, f"{FILE} string"), "stored")

    def load(file: str) -> np.ndarray:
        """Attempts of one task write the same; a file that was cut off is passed over."""
        fs, p = filesystem(f"{folder}/{name(file)}")
        for x in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)):
            with fs.open_input_stream(x.path) as f:
                data = np.frombuffer((raw := f.read())[: len(raw) // 8 * 8], "<i8")
            if len(data) and len(data) == data[0] + 1 and len(raw) % 8 == 0:
                return data[1:]
        return np.zeros(0, "<i8")

    def task(batches):
        known: tuple[str, np.ndarray] = ("", np.zeros(0, "<i8"))
        for batch in batches:
            files, places = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            gone = np.zeros(batch.num_rows, bool)
            of = np.array(files.to_pylist(), object)
            for file in dict.fromkeys(of.tolist()):
                if known[0] != file:
                    known = (file, load(file))
                gone |= (of == file) & np.isin(places, known[1])
            rest = batch.filter(pa.array(~gone))
            yield pa.RecordBatch.from_arrays(rest.columns[2:], schema=pa.schema(list(rest.schema)[2:]))

    columns = [c for c in docs.columns if c not in (FILE, PLACE)]
    kept = docs.select(*columns).schema
    return docs.select(FILE, PLACE, *[F.col(f"`{c}`") for c in columns]).mapInArrow(task, kept)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def part_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def attempt_name() -> str:
    """A file stem no other attempt of the same task uses."""
    return f"{part_id():07d}-{uuid.uuid4().hex[:8]}"


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def spread(df: DataFrame, n: int, key: str) -> DataFrame:
    """About one row a task, for a table of n rows that each name a file: cut at the quantiles of a key that tells them apart."""
    return df.repartitionByRange(max(1, n), key)


#: Most rows that are broadcast; their number is known where this is asked.
SMALL_ROWS = 50_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df marked for a broadcast if its known number of rows is small; else Spark's joins decide."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores added until no column is called so (Spark takes names without regard to case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key, folds: int, fold: int):
    """crc32 of the id as text, modulo folds, equals fold; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
