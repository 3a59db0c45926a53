"""Run folders: tables as Parquet, metadata as CSV; written once, read back typed."""

from __future__ import annotations

import csv
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.record import CORRECTIONS, issues_columns, results_columns
from plumbline.plans.registry import KEY_STATUS, REASONS


@dataclass
class Stored:
    results: DataFrame
    issues: DataFrame
    corrections: DataFrame
    metadata: dict[str, list[dict]]


def problems(results: DataFrame, issues: DataFrame) -> list[str]:
    """What is wrong with a run's tables: unknown words, counts without a cause, repeated numbers."""
    out = []

    def refuse(df, condition, text):
        if not df.filter(condition).isEmpty():
            out.append(text)

    refuse(results, ~F.col("status").isin("pass", "fail", "not_run"), "a result's status is unknown")
    refuse(results, (F.col("status") == "not_run") != F.col("not_run_reason").isNotNull(), "a result is not run without a reason, or has one and ran")
    refuse(results, F.col("not_run_reason").isNotNull() & ~F.col("not_run_reason").isin(*REASONS), "a reason is unknown")
    refuse(results, (F.col("status") == "fail") != (F.col("n_fail") > 0), "a result fails without a failure, or has one and does not")
    refuse(issues, ~F.col("status").isin("open", "not_evaluated", "acknowledged"), "an issue's status is unknown")
    refuse(issues, (F.col("status") == "not_evaluated") & F.col("root_issue_id").isNull(), "an issue that was not evaluated has no root")
    refuse(issues, (F.col("level") == "column") != F.col("n_records").isNotNull(), "a column-level issue has no count, or a record's has one")
    refuse(issues, F.col("provider_key_status").isNotNull() & ~F.col("provider_key_status").isin(*KEY_STATUS), "a provider key's status is unknown")
    refuse(issues.groupBy("issue_id").count(), "count > 1", "an issue's number is used twice")
    return out


def write_run(run, folder: str) -> str:
    """<folder>/<run_id>/{tables,metadata}; refuses a folder that holds something."""
    found = problems(run.results, run.issues)
    if found:
        raise ValueError("; ".join(found))
    root = os.path.join(folder, run.run_id)
    if os.path.isdir(root) and os.listdir(root):
        raise FileExistsError(root)
    for name, df in (("results", run.results), ("issues", run.issues), ("corrections", run.outcome.corrections)):
        df.write.mode("errorifexists").parquet(os.path.join(root, "tables", name))
    write_metadata(run.metadata, root)
    return root


def write_metadata(metadata: dict[str, list[dict]], root: str) -> None:
    """One CSV for each metadata table; a run that stopped may write some of them."""
    os.makedirs(os.path.join(root, "metadata"), exist_ok=True)
    for name, rows in metadata.items():
        columns = list(dict.fromkeys(k for r in rows for k in r))
        with open(os.path.join(root, "metadata", f"{name}.csv"), "w", encoding="utf-8", newline="") as f:
            w = csv.DictWriter(f, columns, lineterminator="\n", quoting=csv.QUOTE_ALL)
            w.writeheader()
            w.writerows(rows)


def read_run(spark: SparkSession, root: str) -> Stored:
    metadata = {}
    for f in sorted(os.listdir(os.path.join(root, "metadata"))):
        with open(os.path.join(root, "metadata", f), encoding="utf-8", newline="") as x:
            metadata[f[:-4]] = list(csv.DictReader(x))
    run = metadata["run"][0]
    groups = [g for g in run["group_cols"].split("; ") if g]
    read = lambda name, schema: spark.read.schema(schema).parquet(os.path.join(root, "tables", name))
    return Stored(read("results", results_columns(groups)), read("issues", issues_columns(groups, run["key_col"] or None)), read("corrections", CORRECTIONS), metadata)


def bind_results(x: Stored, y: Stored) -> Stored:
    """y's rows after x's, y's issue numbers moved beyond x's."""
    last = x.issues.agg(F.coalesce(F.max("issue_id"), F.lit(0))).first()[0]
    issues = y.issues.withColumns({"issue_id": F.col("issue_id") + last, "root_issue_id": F.col("root_issue_id") + last})
    moved = F.array_join(F.transform(F.split("related_issue_ids", "; "), lambda i: (i.cast("long") + last).cast("string")), "; ")
    corrections = y.corrections.withColumns({"issue_id": F.col("issue_id") + last, "related_issue_ids": moved})
    return Stored(x.results.unionByName(y.results), x.issues.unionByName(issues), x.corrections.unionByName(corrections), {k: [*x.metadata.get(k, []), *y.metadata.get(k, [])] for k in {**x.metadata, **y.metadata}})
