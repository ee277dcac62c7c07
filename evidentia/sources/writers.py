"""Writers of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import columns as C


def write_findings_csv(findings: DataFrame, path: str, separator: str = " | ") -> None:
    """A worksheet: lists are joined, and texts that a spreadsheet would take for formulas are quoted."""
    cells = []
    for name, kind in findings.dtypes:
        cell = F.array_join(name, separator) if kind.startswith("array") else F.col(name)
        cells.append((C.csv_safe(cell) if kind == "string" or kind.startswith("array") else cell).alias(name))
    findings.select(*cells).write.csv(path, header=True, escape='"', quoteAll=True)


def write_scan_results(results: DataFrame, path: str, per_file: int = 10_000) -> None:
    """SARIF: documents of one run of one tool, of about ``per_file`` results each, one a line of JSON."""
    counts = results.groupBy("tool").agg(F.ceil(F.count("*") / per_file).alias("parts"))
    region = F.struct(F.col("line").alias("startLine"), F.col("end_line").alias("endLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    one = F.struct(F.col("rule_id").alias("ruleId"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    part = F.pmod(F.xxhash64("path", "line", "rule_id", "message"), F.col("parts"))
    runs = results.join(counts, "tool").groupBy("tool", part.alias("part")).agg(F.collect_list(one).alias("results"))
    run = F.struct(F.struct(F.struct(F.col("tool").alias("name")).alias("driver")).alias("tool"), "results")
    runs.select(F.lit("2.1.0").alias("version"), F.array(run).alias("runs")).write.json(path)


def write_evidence(table: DataFrame, path: str) -> None:
    """Parquet by baseline; only the baselines written are replaced."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("baseline_id").parquet(path)
