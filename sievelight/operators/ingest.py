"""Reports of other tools, model replies and saved results, made into findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.paths import normalize_path
from sievelight.schema import FINDING, RANKS, as_findings


def extract_embedded_json(out: Column, err: Column | None = None) -> Column:
    """JSON text in noisy output: one stream as a whole if it parses, else what lies from the first to the last bracket of both."""
    whole = lambda c: F.when(F.try_parse_json(F.trim(c)).isNotNull() & (F.trim(c) != ""), F.trim(c))
    both = out if err is None else F.concat_ws("\n", out, err)
    inner = F.nullif(F.regexp_extract(both, r"(?s)[\[{].*[}\]]", 0), F.lit(""))
    return F.coalesce(whole(out), *([] if err is None else [whole(err)]), whole(inner))


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _level(c: Column, levels: dict[str, list[str]], other: str) -> Column:
    out = None
    for severity, names in levels.items():
        hit = _lower(c).isin(names)
        out = F.when(hit, severity) if out is None else out.when(hit, severity)
    return out.otherwise(other)


def _findings(rows: DataFrame, root: str, **columns: Column) -> DataFrame:
    file = normalize_path(F.coalesce(columns.pop("file"), F.lit("")), root)
    seq = F.col("k").cast("long")
    return as_findings(rows.select("repo", file.alias("file"), *[c.alias(n) for n, c in columns.items()], F.lit("code").alias("category"), F.lit(RANKS["tool"]).alias("detector_rank"), seq.alias("seq")))


def _items(reports: DataFrame, schema: str, *fields: str) -> DataFrame:
    """repo, k, i: items of the first of the fields that is there; reports have repo and report text."""
    parsed = F.from_json(extract_embedded_json(F.col("report")), schema)
    return reports.select("repo", parsed.alias("p")).select("repo", F.posexplode(F.coalesce(*[F.col(f"p.{f}") for f in fields])).alias("k", "i"))


def _line(c: Column) -> Column:
    return F.nullif(c.try_cast("int"), F.lit(0))


def normalize_bandit(reports: DataFrame, root: str = "/work") -> DataFrame:
    item = "struct<test_id:string,issue_severity:string,test_name:string,issue_text:string,filename:string,line_number:string>"
    rows = _items(reports, f"struct<results:array<{item}>>", "results")
    return _findings(
        rows, root, id=F.coalesce("i.test_id", F.lit("bandit")), severity=_level(F.col("i.issue_severity"), {"high": ["high"], "medium": ["medium"]}, "low"),
        title=F.coalesce("i.test_name", "i.issue_text", F.lit("Bandit issue")), description=F.coalesce("i.issue_text", F.lit("Bandit issue detected.")),
        file=F.col("i.filename"), line=_line(F.col("i.line_number")),
    )


def normalize_gosec(reports: DataFrame, root: str = "/work") -> DataFrame:
    item = "array<struct<rule_id:string,rule:string,severity:string,details:string,what:string,file:string,filename:string,line:string>>"
    parsed = extract_embedded_json(F.col("report"))
    # Field names match without regard to case, so the two spellings are read one after the other by path.
    found = F.coalesce(F.get_json_object(parsed, "$.Issues"), F.get_json_object(parsed, "$.issues"))
    rows = reports.select("repo", F.posexplode(F.from_json(found, item)).alias("k", "i"))
    text = F.coalesce("i.details", "i.what")
    return _findings(
        rows, root, id=F.coalesce("i.rule_id", "i.rule", F.lit("gosec")), severity=_level(F.col("i.severity"), {"high": ["high"], "medium": ["medium"]}, "low"),
        title=F.coalesce(text, F.lit("gosec issue")), description=F.coalesce(text, F.lit("gosec issue detected.")), file=F.coalesce("i.file", "i.filename"), line=_line(F.col("i.line")),
    )


def normalize_brakeman(reports: DataFrame, root: str = "/work") -> DataFrame:
    item = "struct<warning_code:string,warning_type:string,confidence:string,message:string,file:string,line:string>"
    rows = _items(reports, f"struct<warnings:array<{item}>>", "warnings")
    return _findings(
        rows, root, id=F.coalesce("i.warning_code", "i.warning_type", F.lit("brakeman")), severity=_level(F.col("i.confidence"), {"high": ["high"], "medium": ["medium"], "low": ["low"]}, "medium"),
        title=F.coalesce("i.warning_type", "i.message", F.lit("Brakeman warning")), description=F.coalesce("i.message", F.lit("Brakeman warning detected.")), file=F.col("i.file"), line=_line(F.col("i.line")),
    )


def normalize_semgrep(reports: DataFrame, root: str = "/work") -> DataFrame:
    item = "struct<check_id:string,path:string,start:struct<line:string,col:string>,extra:struct<severity:string,message:string>>"
    rows = _items(reports, f"struct<results:array<{item}>>", "results")
    levels = {"critical": ["critical"], "high": ["error", "high"], "medium": ["warning", "medium"]}
    return _findings(
        rows, root, id=F.coalesce("i.check_id", F.lit("semgrep")), severity=_level(F.col("i.extra.severity"), levels, "low"), title=F.coalesce("i.extra.message", "i.check_id", F.lit("Semgrep issue")),
        description=F.coalesce("i.extra.message", F.lit("Semgrep issue detected.")), file=F.col("i.path"), line=_line(F.col("i.start.line")), column=_line(F.col("i.start.col")) + 1,
    )


_REPLY = "struct<findings:array<struct<id:string,severity:string,title:string,description:string,file:string,line:int>>>"


def parse_model_replies(replies: DataFrame) -> DataFrame:
    """Findings of replies(repo, file, chunk, reply): JSON from the first to the last brace; bad JSON gives none."""
    parsed = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), _REPLY)
    rows = replies.select("repo", "file", "chunk", F.posexplode(parsed["findings"]).alias("k", "i"))
    found = rows.select("repo", F.coalesce("i.file", "file").alias("file"), "i.id", "i.severity", "i.title", "i.description", "i.line", F.lit("code").alias("category"), F.lit(RANKS["model"]).alias("detector_rank"), (F.col("chunk").cast("long") * 10_000 + F.col("k")).alias("seq"))
    return as_findings(found)


def parse_scan_results(saved: DataFrame) -> DataFrame:
    """Findings of saved reports(repo, report); blank text, `No findings.` and bad JSON give none."""
    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in FINDING.fields if f.name not in ("repo", "detector_rank", "seq"))
    text = F.trim("report")
    parsed = F.from_json(F.when((text != "") & (text != "No findings."), text), f"struct<findings:array<struct<{fields}>>>")
    rows = saved.select("repo", F.posexplode(parsed["findings"]).alias("k", "i"))
    return as_findings(rows.select("repo", "i.*", F.lit(0).alias("detector_rank"), F.col("k").cast("long").alias("seq")))
