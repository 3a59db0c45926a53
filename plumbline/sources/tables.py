"""Delivered tables: frames, Parquet, CSV, JDBC and catalog tables."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = (",", ";", "\t", "|", ":", " ")
#: Code points that Windows-1252 leaves undefined, and the characters of its others from 0x80 to 0x9F (fixed values).
UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
DEFINED = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}
#: Stands for a quoted empty cell while a CSV is read, so that it differs from an empty one.
EMPTY = "\u0001"


def from_bytes_text(c: Column) -> Column:
    """A cell read as ISO-8859-1: UTF-8 where its bytes are, else Windows-1252 unless it holds an undefined byte."""
    raw = F.encode(c, "ISO-8859-1")
    utf8 = F.is_valid_utf8(raw.cast("string"))
    windows = F.translate(c, "".join(map(chr, DEFINED)), "".join(DEFINED.values()))
    undefined = c.rlike("[" + "".join(f"\\x{{{x:02X}}}" for x in UNDEFINED) + "]")
    return F.when(utf8, F.decode(raw, "UTF-8")).when(undefined, c).otherwise(windows)


def separator_of(header: str) -> str:
    """The separator that cuts the first line into most cells."""
    return max(SEPARATORS, key=lambda s: (header.count(s), -SEPARATORS.index(s)))


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A CSV as text: an empty cell is null, a quoted empty one is "". Rows of a wrong length stop the reading.

    The header is the first line and the last byte ends a line; both are read on
    the driver, through Spark, from the file's ends.
    """
    first = spark.read.option("lineSep", "\n").option("encoding", "ISO-8859-1").text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    header = first[0].rstrip("\r").removeprefix("ï»¿")
    separator = separator or separator_of(header)
    names = next(__import__("csv").reader([header], delimiter=separator))
    if len(set(names)) < len(names):
        raise ValueError(f"{path}: columns named twice")
    _check_end(path)
    names = [n.encode("ISO-8859-1").decode("utf-8", "replace") for n in names]
    schema = ", ".join(f"`{n}` string" for n in names)
    df = spark.read.schema(schema).csv(path, header=True, enforceSchema=True, sep=separator, mode="FAILFAST", multiLine=True, escape='"', emptyValue=EMPTY, nullValue="", encoding="ISO-8859-1")
    return df.select(*[F.when(F.col(f"`{n}`") == EMPTY, "").otherwise(from_bytes_text(F.col(f"`{n}`"))).alias(n) for n in names])


def _check_end(path: str) -> None:
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        with open(local, "rb") as f:
            f.seek(max(0, os.path.getsize(local) - 1))
            if f.read(1) != b"\n":
                raise ValueError(f"{path}: the last line does not end")


def stamp(path: str) -> dict:
    """Name, size, time and SHA-256 of a local file, which must not change while it is read."""
    local = path.removeprefix("file://")
    before = os.stat(local)
    digest = hashlib.sha256()
    with open(local, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    after = os.stat(local)
    if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
        raise ValueError(f"{path} changed while it was read")
    return {"file": os.path.basename(local), "bytes": after.st_size, "mtime_ns": after.st_mtime_ns, "sha256": digest.hexdigest()}


def read_jdbc(spark: SparkSession, url: str, names: list[str], table_map: dict[str, str] | None = None, properties: dict[str, str] | None = None, columns: dict[str, tuple[str, int, int, int]] | None = None) -> dict[str, DataFrame]:
    """The specification's tables of a database; a table that is not there is left out.

    columns gives (column, lower, upper, partitions) for tables to be read in parallel.
    """
    out = {}
    for name in names:
        source = (table_map or {}).get(name, name)
        try:
            if columns and name in columns:
                c, lo, hi, n = columns[name]
                out[name] = spark.read.jdbc(url, source, column=c, lowerBound=lo, upperBound=hi, numPartitions=n, properties=properties or {})
            else:
                out[name] = spark.read.jdbc(url, source, properties=properties or {})
        except Exception as e:
            if not any(x in str(e).lower() for x in ("does not exist", "no such table", "not found", "doesn't exist")):
                raise
    return out


def read_catalog(spark: SparkSession, names: list[str], table_map: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The specification's tables of Spark's catalog; one that is not there is left out."""
    wanted = {n: (table_map or {}).get(n, n) for n in names}
    return {n: spark.table(t) for n, t in wanted.items() if spark.catalog.tableExists(t)}


def read_tables(spark: SparkSession, tables: dict[str, DataFrame | str], spec_tables: list[str] | None = None) -> tuple[dict[str, DataFrame], set[str]]:
    """Frames as they are, paths by their ending; returns the tables and the names of those that are all text."""
    if not isinstance(tables, dict) or not all(isinstance(k, str) and k for k in tables):
        raise ValueError("tables are given by name")
    out, text = {}, set()
    for name, x in tables.items():
        if isinstance(x, DataFrame):
            out[name] = x
        elif x.endswith((".csv", ".txt", ".tsv")):
            out[name] = read_csv(spark, x)
            text.add(name)
        elif x.endswith(".orc"):
            out[name] = spark.read.orc(x)
        else:
            out[name] = spark.read.parquet(x)
    order = [n for n in spec_tables or [] if n in out]
    return {n: out[n] for n in [*order, *[k for k in out if k not in order]]}, text


def read_delivery(spark: SparkSession, folder: str, spec_tables: list[str]) -> tuple[dict[str, DataFrame], set[str], list[dict]]:
    """All Parquet and CSV tables of a folder, in the specification's order, with their stamps."""
    found, stamps = {}, []
    for f in sorted(os.listdir(folder)):
        stem, ending = os.path.splitext(f)
        if ending in (".parquet", ".csv", ".orc"):
            found[stem] = os.path.join(folder, f)
            if os.path.isfile(found[stem]):
                stamps.append({"table_name": stem, **stamp(found[stem])})
    tables, text = read_tables(spark, found, spec_tables)
    return tables, text, stamps
