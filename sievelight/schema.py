"""Schemas and fixed dimensions of the scan jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0.0"

#: Severities from low to high, and the OWASP Top 10 of 2021.
SEVERITIES = ["low", "medium", "high", "critical"]
OWASP_TOP_10 = [
    "A01:2021 Broken Access Control",
    "A02:2021 Cryptographic Failures",
    "A03:2021 Injection",
    "A04:2021 Insecure Design",
    "A05:2021 Security Misconfiguration",
    "A06:2021 Vulnerable and Outdated Components",
    "A07:2021 Identification and Authentication Failures",
    "A08:2021 Software and Data Integrity Failures",
    "A09:2021 Security Logging and Monitoring Failures",
    "A10:2021 Server-Side Request Forgery",
]

_S, _I = T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FINDING = _struct(
    repo=_S, file=_S, line=_I, column=_I, id=_S, severity=_S, title=_S, description=_S, owasp=_S, category=_S, packageName=_S, packageVersion=_S, cveId=_S,
    riskScore=T.DoubleType(), recommendation=_S, simulation=_struct(payload=_S, impact=_S), detector_rank=_I, seq=T.LongType(),
)
ADVISORY = _struct(
    id=_S, package=_S, ecosystem=_S, affectedRange=_S, fixedVersion=_S, severity=_S, cvssScore=T.DoubleType(), description=_S, references=T.ArrayType(_S), exploitability=_S, privilegeRequired=_S,
)

#: Order in which detectors speak: of two findings alike, the earlier detector's stays.
RANKS = {"taint_js": 1, "patterns_js": 2, "line": 3, "infra": 4, "tool": 5, "taint_native": 6, "dependency": 7, "model": 8}


def severity_rank(severity: Column) -> Column:
    """0 to 3; null for a severity that is none of the four."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - F.lit(1)


def as_findings(df: DataFrame) -> DataFrame:
    """df with exactly the columns of FINDING; those it lacks are null."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING.fields])
