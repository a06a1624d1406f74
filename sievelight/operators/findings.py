"""What is done with findings: union, first-wins dedupe, roll-ups, gates and top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.functions.tables import placed
from sievelight.schema import OWASP_TOP_10, SEVERITIES, as_findings, severity_rank


def union_detectors(*found: DataFrame) -> DataFrame:
    """All findings in one table; columns that a detector lacks are null."""
    return reduce(DataFrame.unionByName, map(as_findings, found))


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """Of findings with one repo, file, line (none counts as 0) and id, the first by detector and sequence.

    The key has many values, so its shuffle is even. A minimum over a struct keeps it to one row a key and task.
    """
    first = F.min_by(F.struct(*findings.columns), F.struct("detector_rank", "seq"))
    return findings.groupBy("repo", "file", F.coalesce("line", F.lit(0)).alias("_line"), "id").agg(first.alias("f")).select("f.*")


def count_by_severity(findings: DataFrame, key: str = "repo") -> DataFrame:
    """One row per repository with a count for each severity, zero where there are none."""
    return findings.groupBy(key).agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES])


def owasp_rollup(findings: DataFrame) -> DataFrame:
    """Findings of each Top-10 category; categories without any are kept, other values are dropped."""
    counted = findings.filter(F.col("owasp").isin(OWASP_TOP_10)).groupBy("owasp").agg(F.count(F.lit(1)).alias("n"))
    dimension = findings.sparkSession.createDataFrame([(c,) for c in OWASP_TOP_10], "owasp string")
    return dimension.join(F.broadcast(counted), "owasp", "left").select("owasp", F.coalesce("n", F.lit(0)).alias("n"))


def severity_gate(findings: DataFrame, fail_on: str) -> DataFrame:
    """repo, worst (rank 0 to 3), failed: whether the worst finding reaches fail_on; a level that is unknown fails none."""
    threshold = SEVERITIES.index(fail_on.lower()) if fail_on.lower() in SEVERITIES else None
    worst = findings.groupBy("repo").agg(F.max(severity_rank(F.col("severity"))).alias("worst"))
    return worst.withColumn("failed", F.coalesce(F.col("worst") >= threshold, F.lit(False)) if threshold is not None else F.lit(False))


def headline_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("severity").isin("critical", "high"), 1)).alias("serious"))


def top_findings_per_severity(findings: DataFrame, n: int = 10) -> DataFrame:
    """The first n findings of each repository and severity, with their place and how many more there are.

    Tasks drop what is beyond their own first n before the shuffle, and counts are combined before theirs, so a
    repository with very many findings does not meet in one task.
    """
    order = Window.partitionBy("repo", "severity").orderBy("detector_rank", "seq", "file", "line", "id")
    first = findings.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    counts = findings.groupBy("repo", "severity").agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return first.join(counts, ["repo", "severity"]).select(*findings.columns, "place", "more")


def severity_sorted_report(findings: DataFrame) -> DataFrame:
    """Findings with their place in the report of their repository: worst first, then as they were found.

    The findings of a repository are numbered by ranges, so that one with very many is spread over tasks.
    """
    return placed(findings, ["repo"], [severity_rank(F.col("severity")).desc(), *map(F.col, ("detector_rank", "seq", "file", "line", "id"))], "place")


def coverage_matrix(rules: DataFrame) -> DataFrame:
    """language by rule title: how many rules each language has of a title (language, title)."""
    return rules.groupBy("language").pivot("title").agg(F.count(F.lit(1))).fillna(0)


def rule_coverage_gap(required: DataFrame, rules: DataFrame) -> DataFrame:
    """Required (language, title) pairs that no rule has."""
    return required.join(rules, ["language", "title"], "left_anti")


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def finding_location(file: Column, line: Column, column: Column) -> Column:
    """file, file:line or file:line:column; a column without a line is left out, and so are zeros."""
    at = F.nullif(line, F.lit(0))
    return F.concat_ws(":", file, at.cast("string"), F.when(at.isNotNull(), F.nullif(column, F.lit(0))).cast("string"))
