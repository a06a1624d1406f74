"""Sources: text files of repositories, advisories, rule tables, saved scan caches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.paths import filter_globs, is_text_file, normalize_path
from sievelight.schema import ADVISORY

MATCHER = "matcher struct<callee:string,calleePrefix:string,calleePattern:string>"
ENDPOINTS = f"array<struct<id:string,name:string,{MATCHER}>>"
PACK = (
    f"language string, rules array<struct<id:string,title:string,severity:string,owasp:string,kind:string,sources:{ENDPOINTS},sinks:{ENDPOINTS},sanitizers:{ENDPOINTS},callee:string,calleePrefix:string,calleePattern:string,literalPattern:string>>"
)
MATCHERS = "language string, rule_id string, title string, severity string, owasp string, rule_kind string, rule_no int, role string, endpoint_no int, endpoint_name string, kind string, value string"


#: A file of more bytes is listed and not read: it would be one row.
LONGEST_FILE = 256 << 20


def list_files(spark: SparkSession, path: str, repo: str = "local", include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """repo, file (relative to path), place, length of the text files below path that the globs let through (by default: all). No content is read; empty files are not listed."""
    rows = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path).select("path", "length")
    plain = F.coalesce(F.try_url_decode(F.regexp_replace("path", r"\+", "%2B")), "path")
    bare = F.regexp_replace(plain, "^[a-z]+:/+", "/")
    root = "/" + path.split(":", 1)[-1].lstrip("/") if ":" in path else path
    named = rows.select(F.lit(repo).alias("repo"), normalize_path(bare, root).alias("file"), plain.alias("place"), "length")
    return filter_globs(named, include, [] if exclude is None else exclude).filter(is_text_file(F.col("file")))


def read_files(spark: SparkSession, path: str, repo: str = "local", include: list[str] | None = None, exclude: list[str] | None = None, longest: int = LONGEST_FILE) -> DataFrame:
    """repo, file, content of the files that list_files gives and that have at most `longest` bytes.

    A first pass lists names and lengths; the second reads the files left, so that no byte of a binary or an over-long
    file is read. The driver holds the names of these files, as it does for any listing. Bytes that are no UTF-8
    become U+FFFD.
    """
    listed = list_files(spark, path, repo, include, exclude).filter(F.col("length") <= longest)
    places = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["place"]) for r in listed.select("place").collect()]
    if not places:
        return spark.createDataFrame([], "repo string, file string, content string")
    rows = spark.read.format("binaryFile").load(places)
    plain = F.coalesce(F.try_url_decode(F.regexp_replace("path", r"\+", "%2B")), "path")
    root = "/" + path.split(":", 1)[-1].lstrip("/") if ":" in path else path
    return rows.select(F.lit(repo).alias("repo"), normalize_path(F.regexp_replace(plain, "^[a-z]+:/+", "/"), root).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of advisories."""
    return spark.read.schema(ADVISORY).json(path, multiLine=True)


def _values(field: str) -> str:
    """Strings of a matcher field that is one string or a JSON array of them, as text."""
    return f"CASE WHEN {field} LIKE '[%' THEN from_json({field}, 'array<string>') WHEN {field} IS NULL THEN array() ELSE array({field}) END"


def matcher_rows(rules: DataFrame) -> DataFrame:
    """One row for each value of each matcher of rules(language, rule struct, rule_no): see MATCHERS. The rules are read once."""
    fields = (("exact", "callee"), ("prefix", "calleePrefix"), ("glob", "calleePattern"))
    ends = [f"transform(rule.{role}s, (e, i) -> struct('{role}' as role, i as endpoint_no, e.name as endpoint_name, e.matcher as matcher))" for role in ("source", "sink", "sanitizer")]
    ends.append("CASE WHEN rule.kind = 'direct' THEN array(struct('direct' as role, 0 as endpoint_no, rule.id as endpoint_name, struct(rule.callee, rule.calleePrefix, rule.calleePattern) as matcher)) END")
    ends.append("array(struct('literal' as role, 0 as endpoint_no, rule.id as endpoint_name, null as matcher))")
    base = ["language", "rule.id as rule_id", "rule.title", "rule.severity", "rule.owasp", "rule.kind as rule_kind", "rule_no", "rule.literalPattern as literal"]
    rows = rules.selectExpr(*base, f"explode(concat({', '.join(f'coalesce({e}, array())' for e in ends)})) as e")
    values = [f"transform({_values(f'e.matcher.{field}')}, v -> struct('{kind}' as kind, v as value))" for kind, field in fields]
    values.append("CASE WHEN e.role = 'literal' AND literal IS NOT NULL THEN array(struct('regex' as kind, literal as value)) END")
    out = rows.selectExpr("*", f"inline(concat({', '.join(f'coalesce({v}, array())' for v in values)}))").selectExpr("* except(e)", "e.role", "e.endpoint_no", "e.endpoint_name")
    # Facts write every kind of member access as a dot, and so must the names that are looked for.
    value = F.when(F.col("kind") == "regex", F.col("value")).otherwise(F.regexp_replace("value", r"->|::|\?\.", "."))
    return out.withColumn("value", value).select(*[f.split()[0] for f in MATCHERS.split(", ")])


def load_native_rules(spark: SparkSession, path: str) -> DataFrame:
    """Matcher rows of JSON packs, one file per language or several; a language without a pack has no rows.

    A file is read by one task, so a language of very many rules should have several; each numbers its own rules.
    """
    # The JSON source seeks in the file for every field that is an array where a string is declared; from_json has the text at hand.
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    packs = text.select(F.inline(F.from_json("value", f"array<struct<{PACK}>>")))
    return matcher_rows(packs.selectExpr("language", "posexplode(rules) as (rule_no, rule)"))


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Matcher rows of the JavaScript rules: the default ones, or a JSON array of rules in path; anything else is an error."""
    if path is None:
        from sievelight.rules.defaults import default_matchers

        return default_matchers(spark)
    text = spark.read.text(path, wholetext=True)
    if text.filter(~F.rlike("value", F.lit(r"^\s*\["))).head(1):
        raise ValueError(f"{path}: rules must be a JSON array")
    kind = PACK.split("rules ", 1)[1].replace("title:string,", "title:string,name:string,", 1)
    rows = text.select(F.posexplode(F.from_json("value", kind)).alias("rule_no", "r"))
    rule = F.col("r").withField("title", F.coalesce("r.title", "r.name")).withField("kind", F.coalesce("r.kind", F.lit("taint"))).dropFields("name")
    return matcher_rows(rows.select(F.lit("javascript").alias("language"), rule.alias("rule"), "rule_no"))


def save_cache(cache: DataFrame, path: str) -> None:
    """cache(repo, file, hash, ...) as Parquet in folders by bucket of repositories."""
    cache.withColumn("bucket", F.pmod(F.xxhash64("repo"), F.lit(64)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def load_cache(spark: SparkSession, path: str, schema: str = "repo string, file string, hash string") -> DataFrame:
    """A saved cache; one that does not exist is empty."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop("bucket")
