"""Queries over findings, dependencies, reports of tools and models, chunks, caches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.operators import deps, detect, findings as ops, incremental, ingest, model_prep
from sievelight.functions.tables import written
from sievelight.operators.scan import CACHED, scan_changed
from sievelight.plans.common import Registry, scratch
from sievelight.plans.inputs import derived, duck, table
from sievelight.plans.scan_queries import DOC_LINES, LINE_HITS, LINE_TESTS, MODULES, SCAN_SQL, _quoted, docs_as_files, whole_files
from sievelight.schema import OWASP_TOP_10, SEVERITIES, as_findings
from sievelight.sources import readers, reports
from sievelight.sources.cache import ScanCache

R = Registry()
FILES, DEPS, ADVS, FINDS = duck("files"), duck("dependencies"), duck("advisories"), duck("findings")
RANK = "CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END"
SORT = "detector_rank, seq"


def _findings(spark, sf_dir) -> DataFrame:
    return as_findings(derived(spark, sf_dir, "findings").withColumnRenamed("col", "column"))


# Findings --------------------------------------------------------------------------------------------------

DEDUPED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, file, coalesce(line, 0), id ORDER BY {SORT}) AS rn FROM ({FINDS}) f) g WHERE rn = 1"


@R.query(f"SELECT repo, file, line, id, severity, description, detector_rank, seq FROM ({DEDUPED}) d")
def dedupe_findings(spark, sf_dir):
    return ops.dedupe_findings(_findings(spark, sf_dir)).select("repo", "file", "line", "id", "severity", "description", "detector_rank", "seq")


@R.query(f"SELECT repo, file, line, id, detector_rank FROM ({FINDS}) f WHERE detector_rank <= 3 UNION ALL SELECT repo, file, line, id, 3 AS detector_rank FROM ({LINE_HITS.format(cols='id', lines=DOC_LINES, tests=LINE_TESTS)}) h")
def union_detectors(spark, sf_dir):
    found = _findings(spark, sf_dir)
    parts = [found.filter(F.col("detector_rank") == n).drop("simulation", "cveId") for n in (1, 2, 3)]
    return ops.union_detectors(*parts, detect.line_patterns(docs_as_files(spark, sf_dir))).select("repo", "file", "line", "id", "detector_rank")


@R.query("SELECT repo, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES) + f" FROM ({FINDS}) f GROUP BY repo")
def count_by_severity(spark, sf_dir):
    return ops.count_by_severity(_findings(spark, sf_dir))


@R.query("SELECT o.owasp, count(f.seq) AS n FROM (VALUES " + ", ".join(f"('{o}')" for o in OWASP_TOP_10) + f") AS o(owasp) LEFT JOIN ({FINDS}) f ON f.owasp = o.owasp GROUP BY o.owasp")
def owasp_rollup(spark, sf_dir):
    return ops.owasp_rollup(_findings(spark, sf_dir))


@R.query(f"SELECT repo, max({RANK}) AS worst, max({RANK}) >= 3 AS failed FROM ({FINDS}) f GROUP BY repo")
def severity_gate(spark, sf_dir):
    return ops.severity_gate(_findings(spark, sf_dir), "Critical")


@R.query(f"SELECT repo, count(*) AS total, count(*) FILTER (severity IN ('critical', 'high')) AS serious FROM ({FINDS}) f GROUP BY repo")
def headline_counts(spark, sf_dir):
    return ops.headline_counts(_findings(spark, sf_dir))


@R.query(f"""SELECT repo, severity, seq, CAST(place AS INTEGER) AS place, more FROM (SELECT *, row_number() OVER (PARTITION BY repo, severity ORDER BY {SORT}) AS place, greatest(count(*) OVER (PARTITION BY repo, severity) - 10, 0) AS more FROM ({FINDS}) f) g WHERE place <= 10""")
def top_findings_per_severity(spark, sf_dir):
    return ops.top_findings_per_severity(_findings(spark, sf_dir)).select("repo", "severity", "seq", "place", "more")


@R.query(f"SELECT repo, seq, CAST(row_number() OVER (PARTITION BY repo ORDER BY {RANK} DESC, {SORT}) AS INTEGER) AS place FROM ({FINDS}) f")
def severity_sorted_report(spark, sf_dir):
    return ops.severity_sorted_report(_findings(spark, sf_dir)).select("repo", "seq", "place")


RULES_SQL = "SELECT DISTINCT p_brand AS language, p_type AS title FROM part"


@R.query("SELECT p_brand AS language, count(*) FILTER (p_type = t.a) AS first_title, count(*) FILTER (p_type = t.b) AS last_title FROM part, (SELECT min(p_type) AS a, max(p_type) AS b FROM part) t GROUP BY p_brand")
def coverage_matrix(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(F.col("p_brand").alias("language"), F.col("p_type").alias("title"))
    matrix = ops.coverage_matrix(rules)
    titles = sorted(c for c in matrix.columns if c != "language")
    return matrix.select("language", F.col(f"`{titles[0]}`").alias("first_title"), F.col(f"`{titles[-1]}`").alias("last_title"))


@R.query("SELECT l.language, t.title FROM (SELECT DISTINCT p_brand AS language FROM part) l, (SELECT DISTINCT p_type AS title FROM part) t WHERE (l.language, t.title) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size <= 4)")
def rule_coverage_gap(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    required = part.select(F.col("p_brand").alias("language")).distinct().join(F.broadcast(part.agg(F.collect_set("p_type").alias("t"))), F.lit(True)).select("language", F.explode("t").alias("title"))
    rules = part.filter("p_size <= 4").select(F.col("p_brand").alias("language"), F.col("p_type").alias("title"))
    return ops.rule_coverage_gap(required, rules)


@R.query(f"SELECT seq, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level FROM ({FINDS}) f")
def sarif_level(spark, sf_dir):
    return _findings(spark, sf_dir).select("seq", ops.sarif_level(F.col("severity")).alias("level"))


PLACE_SQL = "concat(file, CASE WHEN line IS NULL THEN '' ELSE concat(':', CAST(line AS STRING), CASE WHEN col IS NULL THEN '' ELSE concat(':', CAST(col AS STRING)) END) END)"


@R.query(f"SELECT seq, {PLACE_SQL} AS place FROM ({FINDS}) f")
def finding_location(spark, sf_dir):
    return _findings(spark, sf_dir).select("seq", ops.finding_location(F.col("file"), F.col("line"), F.col("column")).alias("place"))


# Reports: whole documents are compared by their digests -----------------------------------------------------

def _js(name: str, expr: str | None = None, number: bool = False) -> str:
    value = f"CAST({expr or name} AS STRING)" if number else f"concat('\"', {expr or name}, '\"')"
    return f"CASE WHEN {expr or name} IS NULL THEN NULL ELSE concat('\"{name}\":', {value}) END"


JSON_ITEM = "concat('{', concat_ws(',', " + ", ".join([_js("file"), _js("line", number=True), _js("column", "col", True), *map(_js, ("id", "severity", "title", "description", "owasp", "category", "packageName", "packageVersion", "recommendation"))]) + "), '}')"


@R.query(f"SELECT repo, md5(concat('{{\"schemaVersion\":\"1.0.0\",\"findings\":[', string_agg({JSON_ITEM}, ',' ORDER BY {SORT}), ']}}')) AS digest FROM ({FINDS}) f GROUP BY repo")
def write_json_report(spark, sf_dir):
    return reports.to_json_report(_findings(spark, sf_dir)).select("repo", F.md5("report").alias("digest"))


REGION = "CASE WHEN line IS NULL THEN '' ELSE concat(',\"region\":{\"startLine\":', CAST(line AS STRING), CASE WHEN col IS NULL THEN '' ELSE concat(',\"startColumn\":', CAST(col AS STRING)) END, '}') END"
SARIF_ITEM = f"concat('{{\"ruleId\":\"', id, '\",\"level\":\"', CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END, '\",\"message\":{{\"text\":\"', title, ' — ', description, '\"}},\"locations\":[{{\"physicalLocation\":{{\"artifactLocation\":{{\"uri\":\"', file, '\"}}', {REGION}, '}}}}]}}')"


@R.query(f"""SELECT repo, md5(concat('{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"sievelight","version":"1.0.0"}}}},"results":[', string_agg({SARIF_ITEM}, ',' ORDER BY {SORT}), ']}}]}}')) AS digest FROM ({FINDS}) f GROUP BY repo""")
def write_sarif_report(spark, sf_dir):
    return reports.to_sarif(_findings(spark, sf_dir)).select("repo", F.md5("report").alias("digest"))


PACKAGE = "CASE WHEN packageVersion IS NULL THEN coalesce(packageName, 'unknown') ELSE concat(packageName, '@', packageVersion) END"
TEXT_ITEM = f"""concat_ws(chr(10), concat('- [', id, '] ', title, CASE WHEN owasp IS NULL THEN '' ELSE concat(' ', owasp) END, ' (', {PLACE_SQL}, ')'), concat('  ', description),
    CASE WHEN category = 'dependency' THEN concat('  package: ', {PACKAGE}) END, CASE WHEN recommendation IS NULL THEN NULL ELSE concat('  recommendation: ', recommendation) END)"""


@R.query(f"""SELECT repo, md5(string_agg(section, chr(10) || chr(10) ORDER BY r DESC)) AS digest FROM (
    SELECT repo, {RANK} AS r, concat(upper(severity), ' (', CAST(count(*) AS STRING), ')', chr(10), string_agg({TEXT_ITEM}, chr(10) ORDER BY {SORT})) AS section FROM ({FINDS}) f GROUP BY repo, severity) s GROUP BY repo""")
def write_text_report(spark, sf_dir):
    return reports.to_text(_findings(spark, sf_dir)).select("repo", F.md5("report").alias("digest"))


MD_ITEM = f"""concat('- **', title, '** (`', file, CASE WHEN line IS NULL THEN '' ELSE concat(':', CAST(line AS STRING)) END, '`)', CASE WHEN owasp IS NULL THEN '' ELSE concat(' — ', owasp) END,
    CASE WHEN category = 'dependency' THEN concat(' `', {PACKAGE}, '`') ELSE '' END, chr(10), '  ', description, CASE WHEN recommendation IS NULL THEN '' ELSE concat(chr(10), '    > ', recommendation) END)"""
MD_SECTION = f"""SELECT repo, severity, {RANK} AS r, count(*) AS n, concat('### ', upper(severity), ' (', CAST(count(*) AS STRING), ')', chr(10), chr(10), string_agg(item, chr(10) ORDER BY {SORT}) FILTER (place <= 10),
    CASE WHEN count(*) > 10 THEN concat(chr(10), chr(10), '<details><summary>…and ', CAST(count(*) - 10 AS STRING), ' more ', severity, ' finding', CASE WHEN count(*) > 11 THEN 's' ELSE '' END, '</summary>', chr(10), chr(10),
      string_agg(item, chr(10) ORDER BY {SORT}) FILTER (place > 10), chr(10), chr(10), '</details>') ELSE '' END) AS section
  FROM (SELECT *, {MD_ITEM} AS item, row_number() OVER (PARTITION BY repo, severity ORDER BY {SORT}) AS place FROM ({FINDS}) f) g GROUP BY repo, severity"""


@R.query(f"""SELECT repo, md5(concat('## Scan Results', chr(10), chr(10), CASE WHEN serious > 0 THEN concat('> **', CAST(serious AS STRING), ' critical/high severity issue', CASE WHEN serious > 1 THEN 's' ELSE '' END, ' to look at first.**')
      ELSE concat('> **', CAST(total AS STRING), ' finding', CASE WHEN total > 1 THEN 's' ELSE '' END, ', none of them critical or high.**') END,
    chr(10), chr(10), '### Summary', chr(10), chr(10), '| Severity | Count |', chr(10), '|----------|-------|', chr(10), lines, chr(10), chr(10), sections)) AS digest
  FROM (SELECT repo, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (r >= 2), 0) AS BIGINT) AS serious, string_agg(concat('| ', upper(severity), ' | ', CAST(n AS STRING), ' |'), chr(10) ORDER BY r DESC) AS lines, string_agg(section, chr(10) || chr(10) ORDER BY r DESC) AS sections FROM ({MD_SECTION}) s GROUP BY repo) t""")
def write_markdown_report(spark, sf_dir):
    return reports.to_markdown(_findings(spark, sf_dir)).select("repo", F.md5("report").alias("digest"))


@R.query(f"SELECT repo, file, line, id, severity, title, description FROM ({FINDS}) f")
def parse_scan_results(spark, sf_dir):
    """Reports written and read again, beside blank and broken ones."""
    saved = reports.to_json_report(_findings(spark, sf_dir))
    odd = saved.select("repo", F.explode(F.array(F.lit("No findings."), F.lit("  "), F.lit('{"findings": [oops'))).alias("report"))
    return ingest.parse_scan_results(saved.unionByName(odd)).select("repo", "file", "line", "id", "severity", "title", "description")


# Dependencies ----------------------------------------------------------------------------------------------

def _deps(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "dependencies").withColumn("reported", F.col("version"))


PART = r"CAST(coalesce(nullif(regexp_extract({v}, '^([0-9]+)(\.([0-9]+))?(\.([0-9]+))?', {i}), ''), '0') AS BIGINT)"


def _key(v: str) -> str:
    """A list that compares in version order: a release is above its pre-releases, and post-releases are above it."""
    parts = ", ".join(PART.format(v=v, i=i) for i in (1, 3, 5))
    return f"[{parts}, CASE WHEN contains({v}, '-') THEN 0 ELSE 1 END, CASE WHEN contains({v}, 'post') THEN 1 ELSE 0 END]"


@R.query(f"SELECT DISTINCT ecosystem, version, {PART.format(v='version', i=1)} AS major, {PART.format(v='version', i=3)} AS minor, {PART.format(v='version', i=5)} AS patch, CASE WHEN contains(version, '-') THEN 0 ELSE 1 END AS is_release, CASE WHEN ecosystem = 'pypi' THEN CASE WHEN contains(version, 'post') THEN 1 ELSE -1 END END AS post FROM ({DEPS}) d")
def version_key(spark, sf_dir):
    keys = _deps(spark, sf_dir).select("ecosystem", "version", deps.version_key(F.col("version"), F.col("ecosystem")).alias("k"))
    return keys.select("ecosystem", "version", "k.major", "k.minor", "k.patch", "k.is_release", F.when(F.col("ecosystem") == "pypi", F.get(F.col("k.pre"), F.lit(1))["number"].cast("int")).alias("post")).distinct()


V = "1 + p_size % 7"
#: The intervals that the seven forms of affectedRange stand for; above a pypi version means above its post-releases too.
INTERVALS = f"""
SELECT a.*, '1.0.0' AS lo, true AS lo_inc, concat(CAST({V} AS STRING), '.', CAST(p_size AS STRING), '.1') AS hi, false AS hi_inc FROM ({ADVS}) a WHERE p_partkey % 7 = 0
UNION ALL SELECT a.*, concat(CAST({V} AS STRING), '.', CAST(p_size AS STRING), '.0'), true, concat(CAST({V} + 1 AS STRING), '.0.0-'), false FROM ({ADVS}) a WHERE p_partkey % 7 = 1
UNION ALL SELECT a.*, concat(CAST({V} AS STRING), '.', CAST(p_size AS STRING), '.2'), true, concat(CAST({V} AS STRING), '.', CAST(p_size + 1 AS STRING), '.0-'), false FROM ({ADVS}) a WHERE p_partkey % 7 = 2
UNION ALL SELECT a.*, NULL, true, '2.5.0', true FROM ({ADVS}) a WHERE p_partkey % 7 = 3
UNION ALL SELECT a.*, concat(CAST(3 + p_size % 4 AS STRING), '.', CAST(p_size AS STRING), '.0', CASE WHEN ecosystem = 'pypi' THEN '.post' ELSE '' END), false, NULL, false FROM ({ADVS}) a WHERE p_partkey % 7 = 3
UNION ALL SELECT a.*, NULL, true, concat(CAST({V} AS STRING), '.0.0'), false FROM ({ADVS}) a WHERE p_partkey % 7 = 4
UNION ALL SELECT a.*, '1.0.0', true, concat(CAST({V} AS STRING), '.', CAST(p_size AS STRING), '.0'), false FROM ({ADVS}) a WHERE p_partkey % 7 = 5
UNION ALL SELECT a.*, concat(CAST({V} AS STRING), '.', CAST(p_size AS STRING), '.0'), false, '9.0.0', false FROM ({ADVS}) a WHERE p_partkey % 7 = 5
UNION ALL SELECT a.*, concat(CAST({V} AS STRING), '.', CAST(p_size AS STRING), '.2'), true, concat(CAST({V} AS STRING), '.', CAST(p_size + 1 AS STRING), '.0-'), false FROM ({ADVS}) a WHERE p_partkey % 7 = 6"""


def _shown(c: str):
    return F.when(F.col(c).isNotNull(), F.concat_ws(".", f"{c}.major", f"{c}.minor", f"{c}.patch", F.when(F.col(f"{c}.is_release") == 1, F.lit(None)).otherwise("pre")))


def _shown_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE replace(replace({c}, '.0-', '.0.pre'), '.post', '') END"


@R.query(f"SELECT id, {_shown_sql('lo')} AS lo, lo_inc, {_shown_sql('hi')} AS hi, hi_inc FROM ({INTERVALS}) i")
def range_intervals(spark, sf_dir):
    return deps.range_intervals(derived(spark, sf_dir, "advisories")).select("id", _shown("lo").alias("lo"), "lo_inc", _shown("hi").alias("hi"), "hi_inc")


MATCHED = f"""SELECT DISTINCT d.repo, d.source, d.ecosystem, d.name, d.version, i.id, i.severity, i.cvssScore, i.fixedVersion, i.description, i.exploitability, i.privilegeRequired
  FROM (SELECT *, {_key('version')} AS v FROM ({DEPS}) d0) d JOIN (SELECT *, CASE WHEN lo IS NULL THEN NULL ELSE {_key('lo')} END AS l, CASE WHEN hi IS NULL THEN NULL ELSE {_key('hi')} END AS h FROM ({INTERVALS}) i0) i
    ON d.ecosystem = i.ecosystem AND d.name = i.package AND (l IS NULL OR v > l OR (lo_inc AND v = l)) AND (h IS NULL OR v < h OR (hi_inc AND v = h))"""


def _matched(spark, sf_dir, *wanted: str) -> DataFrame:
    """Matches, repeated ones dropped: of matches, as these are fewer than dependencies. Their shuffle leaves Spark free to split skewed packages."""
    found = deps.cve_range_join(_deps(spark, sf_dir).drop("l_orderkey", "l_linenumber"), deps.range_intervals(derived(spark, sf_dir, "advisories")))
    return found.select(*(wanted or ["*"])).repartition("repo", "source").distinct()


@R.query(f"SELECT repo, source, name, version, id FROM ({MATCHED}) m")
def cve_range_join(spark, sf_dir):
    return _matched(spark, sf_dir, "repo", "source", "name", "version", "id")


RISK = """round(greatest(0.0, least(100.0, coalesce(cvssScore * 10, CASE severity WHEN 'low' THEN 20.0 WHEN 'medium' THEN 45.0 WHEN 'high' THEN 75.0 WHEN 'critical' THEN 95.0 END, 45.0)
    + CASE exploitability WHEN 'high' THEN 10 WHEN 'low' THEN -10 ELSE 0 END + CASE privilegeRequired WHEN 'none' THEN 5 WHEN 'high' THEN -5 ELSE 0 END + {s})), 1)"""
RISK_LEVEL = "CASE WHEN {r} >= 90 THEN 'critical' WHEN {r} >= 70 THEN 'high' WHEN {r} >= 40 THEN 'medium' ELSE 'low' END"


@R.query(f"SELECT id, CAST(r AS DOUBLE) AS score, {RISK_LEVEL.format(r='r')} AS level FROM (SELECT id, {RISK.format(s='10')} AS r FROM ({ADVS}) a) b")
def risk_score(spark, sf_dir):
    score = F.round(deps.risk_score(F.col("cvssScore"), F.col("severity"), F.col("exploitability"), F.col("privilegeRequired"), F.lit("high")), 1)
    return derived(spark, sf_dir, "advisories").select("id", score.alias("score")).withColumn("level", deps.risk_severity(F.col("score")))


DEP_FINDINGS = f"""SELECT repo, source AS file, id, {RISK_LEVEL.format(r='r')} AS severity, concat('Dependency ', name, ' vulnerable') AS title, coalesce(description, concat('Vulnerability in ', name)) AS description, name AS packageName, version AS packageVersion, CAST(r AS DOUBLE) AS riskScore,
    CASE WHEN fixedVersion IS NULL THEN concat('No fixed version of ', name, ' is known; consider a replacement.') ELSE concat('Upgrade ', name, ' to ', fixedVersion, ' or later.') END AS recommendation FROM (SELECT *, {RISK.format(s='0')} AS r FROM ({MATCHED}) m) n"""


@R.query(DEP_FINDINGS)
def dependency_findings(spark, sf_dir):
    found = deps.dependency_findings(_matched(spark, sf_dir))
    return found.select("repo", "file", "id", "severity", "title", "description", "packageName", "packageVersion", "riskScore", "recommendation")


@R.query(f"SELECT repo, file, id, concat('Crafted input reaching ', packageName, '@', packageVersion) AS payload, CASE WHEN severity IN ('critical', 'high') THEN 'May allow code execution or data exposure.' ELSE 'May degrade availability or leak limited data.' END AS impact FROM ({DEP_FINDINGS}) d")
def simulate_payload(spark, sf_dir):
    return deps.dependency_findings(_matched(spark, sf_dir), simulate=True).select("repo", "file", "id", "simulation.payload", "simulation.impact")


@R.query(f"""SELECT CAST(p_partkey % 64 AS BIGINT) AS bucket, id, package, affectedRange, cvssScore, fixedVersion FROM ({ADVS}) a""")
def read_advisories(spark, sf_dir):
    """Advisories written as JSON arrays, one for each bucket of packages, and read as a folder."""
    path = scratch(spark, "advisories")
    rows = derived(spark, sf_dir, "advisories").withColumn("bucket", F.col("p_partkey") % 64)
    arrays = rows.groupBy("bucket").agg(F.to_json(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("bucket", "p_partkey", "p_size")]))).alias("value"))
    arrays.repartition("bucket").write.partitionBy("bucket").text(path)
    out = readers.read_advisories(spark, path + "/*")
    return out.select((F.regexp_extract("package", "([0-9]+)$", 1).cast("long") % 64).alias("bucket"), "id", "package", "affectedRange", "cvssScore", "fixedVersion")


@R.query("""SELECT p_brand AS language, concat('rule', CAST(p_partkey AS STRING)) AS rule_id, CASE WHEN p_size % 2 = 0 THEN 'sink' ELSE 'source' END AS role, CASE p_size % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' ELSE 'glob' END AS kind, unnest(CASE WHEN p_size % 3 = 1 THEN [p_type] ELSE [p_type, p_name] END) AS value FROM part""")
def read_rules(spark, sf_dir):
    """Rule packs written as JSON, one or more for each brand, and read as matcher rows; a field is one string or an array of them."""
    path = scratch(spark, "packs")
    part = table(spark, sf_dir, "part")
    write_packs(part, path, -(-part.count() // PACK_RULES))
    return readers.load_native_rules(spark, path + "/*").select("language", "rule_id", "role", "kind", "value")


#: Rules that a pack holds, about, if they are all of one language.
PACK_RULES = 100_000


def write_packs(part: DataFrame, path: str, packs: int) -> None:
    """Each brand's rules as JSON packs, at most so many of a brand; a pack is a file, so none grows with the table."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    field = F.when(F.col("p_size") % 3 == 0, "callee").when(F.col("p_size") % 3 == 1, "calleePrefix").otherwise("calleePattern")
    value = F.when(F.col("p_size") % 3 == 1, quoted("p_type")).otherwise(F.concat(F.lit("["), quoted("p_type"), F.lit(","), quoted("p_name"), F.lit("]")))
    role = F.when(F.col("p_size") % 2 == 0, "sinks").otherwise("sources")
    rule = F.concat(F.lit('{"id":"rule'), F.col("p_partkey").cast("string"), F.lit('","title":"t","severity":"high","owasp":"o","kind":"taint","'), role, F.lit('":[{"id":"e","name":"n","matcher":{"'), field, F.lit('":'), value, F.lit("}}]}"))
    split = part.groupBy("p_brand", F.pmod(F.xxhash64("p_partkey"), F.lit(max(packs, 1))).alias("no")).agg(F.array_join(F.collect_list(rule), ",").alias("rules"))
    text = split.select(F.concat(F.lit('{"language":"'), "p_brand", F.lit('","rules":['), "rules", F.lit("]}")).alias("value"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "").alias("b"))
    text.write.option("maxRecordsPerFile", 1).partitionBy("b").text(path)


MANIFESTS = f"SELECT repo, source, name, CASE WHEN l_linenumber % 2 = 0 THEN concat('^', version) ELSE version END AS spec, version, l_linenumber, ecosystem FROM (SELECT *, row_number() OVER (PARTITION BY repo, source, name ORDER BY version) AS rn FROM ({DEPS}) d) e WHERE rn = 1"


def _manifests(spark, sf_dir) -> DataFrame:
    """package.json of every source with all its packages; a lock file with the packages of even lines; requirements of the pypi ones."""
    # Dealt by their source once, rows are grouped twice without moving again.
    rows = _deps(spark, sf_dir).repartition("repo", "source").groupBy("repo", "source", "name").agg(F.min(F.struct("version", "l_linenumber", "ecosystem")).alias("x")).select("repo", "source", "name", "x.*")
    entry = lambda key, value: F.concat(F.lit('"'), key, F.lit('":'), value)
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    spec = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("^"), "version")).otherwise(F.col("version"))
    nested = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("node_modules/outer/node_modules/"), "name")).otherwise(F.concat(F.lit("node_modules/"), "name"))
    lock = entry(nested, F.concat(F.lit('{"version":'), text(F.concat("version", F.lit("-l"))), F.lit("}")))
    cells = {"package.json": entry(F.col("name"), text(spec)), "package-lock.json": F.when(F.col("l_linenumber") % 2 == 0, lock), "requirements.txt": F.when(F.col("ecosystem") == "pypi", F.concat("name", F.lit("=="), "version"))}
    around = {"package.json": ('{"name":"x","dependencies":{', ",", "}}"), "package-lock.json": ('{"packages":{"":{"version":"0.0.0"},', ",", "}}"), "requirements.txt": ("# pins\n", "\n", "")}
    sources = rows.groupBy("repo", "source").agg(*[F.collect_list(c).alias(name) for name, c in cells.items()])
    made = [F.when(F.size(f"`{n}`") > 0, F.struct(F.regexp_replace("source", "package.json", n).alias("file"), F.concat(F.lit(a), F.array_join(f"`{n}`", by), F.lit(z)).alias("content"))) for n, (a, by, z) in around.items()]
    return sources.select("repo", F.inline(F.array_compact(F.array(*made))))


@R.query(f"""WITH m AS ({MANIFESTS}) SELECT repo, source, 'npm' AS ecosystem, name, CAST(NULL AS STRING) AS version, spec, 'manifest' AS kind FROM m
    UNION ALL SELECT repo, replace(source, 'package.json', 'package-lock.json'), 'npm', name, concat(version, '-l'), NULL, 'lock' FROM m WHERE l_linenumber % 2 = 0
    UNION ALL SELECT repo, replace(source, 'package.json', 'requirements.txt'), 'pypi', name, version, concat('==', version), 'manifest' FROM m WHERE ecosystem = 'pypi'""")
def parse_manifests(spark, sf_dir):
    return deps.parse_manifests(_manifests(spark, sf_dir))


@R.query(f"""WITH m AS ({MANIFESTS}), l AS (SELECT repo, name, max_by(concat(version, '-l'), {_key("concat(version, '-l')")}) AS locked FROM m WHERE l_linenumber % 2 = 0 GROUP BY repo, name)
    SELECT m.repo, m.source, m.name, coalesce(l.locked, regexp_extract(m.spec, '[0-9].*')) AS version, coalesce(l.locked, m.spec) AS reported FROM m LEFT JOIN l USING (repo, name)""")
def resolve_versions(spark, sf_dir):
    rows = deps.parse_manifests(_manifests(spark, sf_dir)).filter("ecosystem = 'npm'")
    return deps.resolve_versions(rows).select("repo", "source", "name", "version", "reported")


# Reports of tools and replies of models --------------------------------------------------------------------

def _tool(spark, sf_dir, item, head: str, tail: str = "]}") -> DataFrame:
    """One noisy report for each user: items in order of their events."""
    events = table(spark, sf_dir, "events")
    cells = F.array_sort(F.collect_list(F.struct("event_id", item.alias("t"))))
    return events.groupBy(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repo")).agg(F.concat(F.lit("INFO start\n" + head), F.array_join(F.transform(cells, lambda c: c["t"]), ","), F.lit(tail + "\ndone")).alias("report"))


def _field(name: str, value, keep=None):
    text = F.concat(F.lit(f'"{name}":"'), value, F.lit('",'))
    return text if keep is None else F.when(keep, text).otherwise("")


NUM = "CAST(event_id % 90 AS STRING)"
E = F.col
LEVELS = "CASE event_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Medium' WHEN 2 THEN 'low' WHEN 3 THEN 'ERROR' ELSE 'critical' END"


def _level_col():
    return F.expr(LEVELS)


def _mapped(levels: dict[str, list[str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({LEVELS}) IN ({', '.join(repr(n) for n in names)}) THEN '{s}'" for s, names in levels.items()) + f" ELSE '{other}' END"


HM = {"high": ["high"], "medium": ["medium"]}


@R.query(f"""SELECT concat('r', CAST(user_id AS STRING)) AS repo, CASE WHEN event_id % 3 = 0 THEN 'bandit' ELSE concat('B', CAST(event_id AS STRING)) END AS id, {_mapped(HM, 'low')} AS severity, concat('text ', event_type) AS title, concat('text ', event_type) AS description, concat('src/', event_type, '.py') AS file, nullif(CAST(event_id % 90 AS INTEGER), 0) AS line FROM events""")
def normalize_bandit(spark, sf_dir):
    item = F.concat(F.lit("{"), _field("test_id", F.concat(F.lit("B"), E("event_id").cast("string")), E("event_id") % 3 != 0), _field("issue_severity", _level_col()), _field("issue_text", F.concat(F.lit("text "), "event_type")), _field("filename", F.concat(F.lit("/work/src/"), "event_type", F.lit(".py"))), F.lit('"line_number":'), F.expr(NUM), F.lit("}"))
    return ingest.normalize_bandit(_tool(spark, sf_dir, item, '{"results":[')).select("repo", "id", "severity", "title", "description", "file", "line")


@R.query(f"""SELECT concat('r', CAST(user_id AS STRING)) AS repo, CASE WHEN event_id % 3 = 0 THEN 'gosec' ELSE concat('G', CAST(event_id AS STRING)) END AS id, {_mapped(HM, 'low')} AS severity, concat('what ', event_type) AS title, concat('cmd/', event_type, '.go') AS file, nullif(CAST(event_id % 90 AS INTEGER), 0) AS line FROM events""")
def normalize_gosec(spark, sf_dir):
    item = F.concat(F.lit("{"), _field("rule", F.concat(F.lit("G"), E("event_id").cast("string")), E("event_id") % 3 != 0), _field("severity", _level_col()), _field("what", F.concat(F.lit("what "), "event_type")), _field("filename", F.concat(F.lit("cmd/"), "event_type", F.lit(".go"))), F.lit('"line":"'), F.expr(NUM), F.lit('"}'))
    both = _tool(spark, sf_dir, item, '{"Issues":[').withColumn("report", F.when(F.xxhash64("repo") % 2 == 0, F.regexp_replace("report", "Issues", "issues")).otherwise(F.col("report")))
    return ingest.normalize_gosec(both).select("repo", "id", "severity", "title", "file", "line")


@R.query(f"""SELECT concat('r', CAST(user_id AS STRING)) AS repo, concat('type ', event_type) AS id, {_mapped({**HM, 'low': ['low']}, 'medium')} AS severity, concat('type ', event_type) AS title, concat('msg ', CAST(event_id AS STRING)) AS description, concat('app/', event_type, '.rb') AS file, nullif(CAST(event_id % 90 AS INTEGER), 0) AS line FROM events""")
def normalize_brakeman(spark, sf_dir):
    item = F.concat(F.lit("{"), _field("warning_type", F.concat(F.lit("type "), "event_type")), _field("confidence", _level_col()), _field("message", F.concat(F.lit("msg "), E("event_id").cast("string"))), _field("file", F.concat(F.lit("app/"), "event_type", F.lit(".rb"))), F.lit('"line":'), F.expr(NUM), F.lit("}"))
    return ingest.normalize_brakeman(_tool(spark, sf_dir, item, '{"warnings":[')).select("repo", "id", "severity", "title", "description", "file", "line")


@R.query(f"""SELECT concat('r', CAST(user_id AS STRING)) AS repo, concat('check.', event_type) AS id, {_mapped({'critical': ['critical'], 'high': ['error', 'high'], 'medium': ['warning', 'medium']}, 'low')} AS severity, concat('msg ', CAST(event_id AS STRING)) AS title, concat('a/', event_type, '.java') AS file, nullif(CAST(event_id % 90 AS INTEGER), 0) AS line, nullif(CAST(event_id % 7 AS INTEGER), 0) + 1 AS col FROM events""")
def normalize_semgrep(spark, sf_dir):
    item = F.concat(F.lit("{"), _field("check_id", F.concat(F.lit("check."), "event_type")), _field("path", F.concat(F.lit("a/"), "event_type", F.lit(".java"))), F.lit('"start":{"line":'), F.expr(NUM), F.lit(',"col":'), (E("event_id") % 7).cast("string"), F.lit('},"extra":{'), _field("severity", _level_col()), F.lit('"message":"msg '), E("event_id").cast("string"), F.lit('"}}'))
    return ingest.normalize_semgrep(_tool(spark, sf_dir, item, '{"results":[')).select("repo", "id", "severity", "title", "file", "line", F.col("column").alias("col"))


@R.query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN concat('[', props, ']') ELSE NULL END AS found FROM events")
def extract_embedded_json(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    noisy = F.when(E("event_id") % 4 == 0, E("props")).when(E("event_id") % 4 == 1, F.concat(F.lit("warn: x\n"), "props", F.lit("\nbye"))).when(E("event_id") % 4 == 2, F.concat(F.lit("out ["), "props", F.lit("] end"))).otherwise("nothing here")
    return events.select("event_id", ingest.extract_embedded_json(noisy, F.lit("")).alias("found"))


REPLY = "SELECT concat('c', CAST(conv_id AS STRING)) AS repo, concat('t', CAST(turn AS STRING), '.ts') AS file, CAST(turn AS INTEGER) AS chunk, conv_id, turn FROM conversations"


@R.query(f"""SELECT repo, CASE WHEN k = 0 THEN file ELSE 'other.ts' END AS file, concat('m', CAST(k AS STRING)) AS id, 'high' AS severity, CAST(turn + k AS INTEGER) AS line FROM ({REPLY}) r, (VALUES (0), (1)) AS n(k) WHERE (conv_id + turn) % 3 = 0""")
def parse_model_replies(spark, sf_dir):
    """Two findings in every third turn's reply; the other replies are the turns' own text, which holds no JSON."""
    rows = table(spark, sf_dir, "conversations")
    made = F.concat(F.lit('Sure. {"findings":[{"id":"m0","severity":"high","title":"t","line":'), E("turn").cast("string"), F.lit('},{"id":"m1","severity":"high","title":"t","file":"other.ts","line":'), (E("turn") + 1).cast("string"), F.lit("}]} That is all."))
    replies = rows.select(F.concat(F.lit("c"), E("conv_id").cast("string")).alias("repo"), F.concat(F.lit("t"), E("turn").cast("string"), F.lit(".ts")).alias("file"), E("turn").cast("int").alias("chunk"), F.when((E("conv_id") + E("turn")) % 3 == 0, made).otherwise(E("text")).alias("reply"))
    return ingest.parse_model_replies(replies).select("repo", "file", "id", "severity", "line")


# What goes to a model --------------------------------------------------------------------------------------

@R.query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", model_prep.estimate_tokens(F.col("text")).alias("tokens"))


@R.query("SELECT source AS repo, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, sum(ceil(length(text) / 4.0)) > 30000 AS refused FROM documents GROUP BY source")
def token_budget(spark, sf_dir):
    return model_prep.token_budget(docs_as_files(spark, sf_dir), 30_000)


@R.query(f"SELECT repo, module, count(*) AS n_files FROM ({MODULES}) m GROUP BY repo, module")
def module_sizes(spark, sf_dir):
    return model_prep.module_sizes(derived(spark, sf_dir, "files"))


@R.query(f"SELECT repo, module, CAST(b AS INTEGER) AS batch_no, string_agg(file, ',' ORDER BY file) AS files FROM (SELECT *, floor((row_number() OVER (PARTITION BY repo, module ORDER BY file) - 1) / 3) AS b FROM ({MODULES}) m) x GROUP BY repo, module, b")
def file_batches(spark, sf_dir):
    return model_prep.file_batches(derived(spark, sf_dir, "files"), size=3).withColumn("files", F.array_join("files", ","))


CHUNKS = "SELECT repo, file, CAST(i + 1 AS INTEGER) AS chunk_no, CAST(n AS INTEGER) AS n_chunks, substr(content, i * {m} + 1, {m}) AS chunk FROM (SELECT *, unnest(range(0, n)) AS i FROM (SELECT source AS repo, CAST(doc_id AS STRING) AS file, text AS content, CAST(greatest(1, ceil(length(text) / {m}.0)) AS BIGINT) AS n FROM documents) a) b"


@R.query(f"SELECT repo, file, chunk_no, md5(chunk) AS chunk FROM ({CHUNKS.format(m=1000)}) c")
def chunk_text(spark, sf_dir):
    return model_prep.chunks(docs_as_files(spark, sf_dir), 1000).select("repo", "file", "chunk_no", F.md5("chunk").alias("chunk"))


@R.query(f"SELECT repo, file, chunk_no, n_chunks FROM ({CHUNKS.format(m=4000)}) c")
def chunk_numbering(spark, sf_dir):
    return model_prep.chunks(docs_as_files(spark, sf_dir)).select("repo", "file", "chunk_no", "n_chunks")


@R.query()
def chunk_code(spark, sf_dir):
    """Chunks of code and prose at statement boundaries; the tests hold them against the text."""
    code = whole_files(spark, sf_dir).unionByName(docs_as_files(spark, sf_dir))
    return model_prep.chunk_code(code).select("repo", "file", "chunk_no", "n_chunks", F.md5("chunk").alias("chunk"))


HEAD = model_prep.INSTRUCTION + "\n\n"


@R.query(f"""SELECT repo, file, chunk_no, md5(concat({_quoted(HEAD)}, CASE WHEN CAST(file AS BIGINT) >= 0 THEN concat('Context Summary:', chr(10), 'Top-level: ', repo, chr(10), chr(10)) END, 'Schema:', chr(10), {_quoted(model_prep.SCHEMA_LINE)}, chr(10), chr(10),
    'File ', file, ', chunk ', CAST(chunk_no AS STRING), '/', CAST(n_chunks AS STRING), ':', chr(10), chunk)) AS prompt FROM ({CHUNKS.format(m=4000)}) c""")
def build_prompts(spark, sf_dir):
    docs = docs_as_files(spark, sf_dir)
    context = docs.select("repo").distinct().withColumn("context", F.concat(F.lit(" Top-level: "), "repo", F.lit(" ")))
    return model_prep.build_prompts(model_prep.chunks(docs), context).select("repo", "file", "chunk_no", F.md5("prompt").alias("prompt"))


README = "SELECT source AS repo, string_agg(text, chr(10) ORDER BY doc_id) AS content FROM documents GROUP BY source"


def first_lines(docs: DataFrame, n: int) -> DataFrame:
    """repo, content: of the texts of each source, by doc_id, the first n lines that are not blank. Whole texts are never shuffled."""
    texts = docs.filter("text is not null").select(F.col("source").alias("repo"), "doc_id", "text")
    lines = F.slice(F.filter(F.split(F.concat("text", F.lit("\n")), r"\r?\n"), lambda x: F.trim(x) != ""), 1, n)
    rows = texts.select("repo", "doc_id", F.xxhash64("text").alias("key"), F.posexplode(lines).alias("no", "line"))
    place = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("doc_id").asc_nulls_last(), "key", "no"))
    cells = F.array_sort(F.collect_list(F.struct("place", "line")))
    kept = rows.withColumn("place", place).filter(F.col("place") <= n).groupBy("repo").agg(F.array_join(F.transform(cells, lambda c: c["line"]), "\n").alias("content"))
    return texts.select("repo").distinct().join(kept, "repo", "left").select("repo", F.coalesce("content", F.lit("\n")).alias("content"))


@R.query(rf"""WITH f AS ({FILES}), t AS (SELECT DISTINCT repo, concat(regexp_extract(file, '^[^/]+', 0), CASE WHEN contains(file, '/') THEN '/' ELSE '' END) AS entry FROM f),
  k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY entry) AS n FROM t WHERE NOT regexp_matches(entry, '^(\.git|node_modules|dist|build|coverage)/?$')),
  top AS (SELECT repo, concat('Top-level: ', string_agg(entry, ', ' ORDER BY entry)) AS top FROM k WHERE n <= 30 GROUP BY repo),
  r AS (SELECT repo, concat('README:', chr(10), array_to_string(list_filter(string_split_regex(content, '\r?\n'), lambda x: trim(x) != '')[1:12], chr(10))) AS readme FROM ({README}) q)
  SELECT repo, md5(concat_ws(chr(10), readme, concat('package.json: ', repo, ' | 1.0.0'), top)) AS context FROM top JOIN r USING (repo)""")
def repo_context(spark, sf_dir):
    """READMEs made of the documents of each source, a package.json for each, and the derived files."""
    files = derived(spark, sf_dir, "files").select("repo", "file", "content")
    docs = table(spark, sf_dir, "documents")
    readme = first_lines(docs, 12).withColumn("file", F.lit("README.md"))
    package = docs.select(F.col("source").alias("repo")).distinct().withColumn("content", F.concat(F.lit('{"name":"'), "repo", F.lit('","version":"1.0.0"}'))).withColumn("file", F.lit("package.json"))
    extra = readme.unionByName(package)
    context = model_prep.repo_context(files.unionByName(extra), unlisted=("README.md", "package.json"))
    return context.select("repo", F.md5("context").alias("context"))


# Rescans ---------------------------------------------------------------------------------------------------

HASHED = f"SELECT repo, file, sha256(concat('text|', content)) AS hash FROM ({FILES}) f"


def _hashed(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "files").select("repo", "file", incremental.content_hash(F.col("content"), "text").alias("hash"))


@R.query("SELECT doc_id, sha256(concat('provider|', lang, '|', text)) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", incremental.content_hash(F.col("text"), "provider", F.col("lang")).alias("hash"))


@R.query(f"SELECT DISTINCT repo, trim(file) AS file FROM ({duck('changes')}) c WHERE trim(file) != ''")
def changed_file_set(spark, sf_dir):
    return incremental.changed_file_set(derived(spark, sf_dir, "changes"))


@R.query(f"SELECT repo, file, doc_id FROM ({FILES}) f WHERE (repo, file) IN (SELECT repo, trim(file) FROM ({duck('changes')}) c)")
def changed_files_semi(spark, sf_dir):
    return incremental.changed_files_semi(derived(spark, sf_dir, "files"), incremental.changed_file_set(derived(spark, sf_dir, "changes"))).select("repo", "file", "doc_id")


@R.query(f"SELECT h.repo, h.file, h.hash FROM ({HASHED}) h JOIN ({duck('cache')}) c USING (repo, file, hash)")
def cache_hits(spark, sf_dir):
    return incremental.cache_hits(_hashed(spark, sf_dir), derived(spark, sf_dir, "cache"))


@R.query(f"SELECT h.repo, h.file, h.hash FROM ({HASHED}) h ANTI JOIN ({duck('cache')}) c USING (repo, file, hash)")
def cache_misses(spark, sf_dir):
    return incremental.cache_misses(_hashed(spark, sf_dir), derived(spark, sf_dir, "cache"))


@R.query(f"SELECT repo, file, hash FROM ({duck('cache')}) c")
def scan_cache_store(spark, sf_dir):
    """A first version with other hashes and files that go; then an upsert with the files of the cache, and the rest deleted."""
    cache = ScanCache(spark, scratch(spark, "cache"), {"hashes": "repo string, file string, hash string"})
    files, wanted = derived(spark, sf_dir, "files").select("repo", "file"), derived(spark, sf_dir, "cache")
    cache.upsert({"hashes": files.withColumn("hash", F.lit("old"))}, files, 1)
    cache.upsert({"hashes": wanted}, files, 2)
    cache.upsert({"hashes": files.withColumn("hash", F.lit("again"))}, files, 2)  # a batch that is played again
    cache.vacuum(1)
    return cache.read("hashes").select("repo", "file", "hash")


def _stream(spark, sf_dir, path: str) -> DataFrame:
    """Documents as files that arrive: every seventh comes twice. The event time follows the id."""
    docs = table(spark, sf_dir, "documents")
    times = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1)))
    docs.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"), times.alias("ts"), copies.alias("copy")).write.parquet(path)
    return spark.readStream.schema("repo string, file string, content string, ts timestamp, copy int").parquet(path)


@R.query(LINE_HITS.format(cols="id, severity", lines=DOC_LINES, tests=LINE_TESTS))
def stream_scan(spark, sf_dir):
    from sievelight.streaming.scan import stream_scan as start

    path = scratch(spark, "stream")
    start(_stream(spark, sf_dir, path + "/in"), path + "/out", path + "/state", delay="3650 days").awaitTermination()
    return spark.read.schema(as_findings(spark.createDataFrame([], "repo string")).schema).parquet(path + "/out").select("repo", "file", "line", "id", "severity")


@R.query(LINE_HITS.format(cols="id, severity", lines=DOC_LINES, tests=LINE_TESTS))
def stream_cache_upsert(spark, sf_dir):
    """Documents arrive twice, a third of them first with another text: only what their last text gives stays."""
    from sievelight.streaming.scan import stream_cache_upsert as start

    path = scratch(spark, "upsert")
    cache = ScanCache(spark, path + "/cache", CACHED)
    docs = table(spark, sf_dir, "documents")
    file = [F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("file")]
    for turn, text in ((1, F.when(F.col("doc_id") % 3 == 0, F.lit("md5(x)\nos.system(y)\n\n\neval(z)")).otherwise(F.col("text"))), (2, F.col("text"))):
        docs.select(*file, text.alias("content"), F.timestamp_seconds(F.lit(1_700_000_000 + turn)).alias("ts")).write.mode("append").parquet(path + "/in")
        arriving = spark.readStream.schema("repo string, file string, content string, ts timestamp").parquet(path + "/in")
        start(arriving, cache, path + "/state").awaitTermination()
    return cache.read("findings").select("repo", "file", "line", "id", "severity")


#: A manifest in each repository of the files of snippets, with packages that advisories name.
PINNED = "SELECT concat('r', CAST(p_partkey % 20 AS STRING)) AS repo, concat('pkg', CAST(p_partkey AS STRING)) AS name, concat(CAST(1 + p_size % 5 AS STRING), '.', CAST(p_size AS STRING), '.3') AS version FROM part WHERE p_partkey % 4 != 0"
PINNED_FOUND = f"""SELECT DISTINCT repo, 'package.json' AS file, CAST(NULL AS INTEGER) AS line, id, {RISK_LEVEL.format(r='r')} AS severity FROM (SELECT p.repo, i.id, {RISK.format(s='0')} AS r
  FROM (SELECT *, {_key('version')} AS v FROM ({PINNED}) p0) p JOIN (SELECT *, CASE WHEN lo IS NULL THEN NULL ELSE {_key('lo')} END AS l, CASE WHEN hi IS NULL THEN NULL ELSE {_key('hi')} END AS h FROM ({INTERVALS}) i0) i
    ON i.ecosystem = 'npm' AND p.name = i.package AND (l IS NULL OR v > l OR (lo_inc AND v = l)) AND (h IS NULL OR v < h OR (hi_inc AND v = h))) m"""
OTHER_FOUND = "SELECT DISTINCT concat('r', CAST(user_id % 20 AS STRING)) AS repo, 'b.py' AS file, CAST(event_id % 50 + 1 AS INTEGER) AS line, concat('B', CAST(event_id % 7 AS STRING)) AS id, 'low' AS severity FROM events WHERE event_id % 11 = 0"


@R.query(f"SELECT * FROM ({SCAN_SQL}) s UNION ALL {PINNED_FOUND} UNION ALL {OTHER_FOUND}")
def rescan(spark, sf_dir):
    """A scan of files of which the cache knows an older state: some changed since, some are new, some are gone; it equals a whole scan."""
    files = whole_files(spark, sf_dir)
    pinned = spark.sql(PINNED.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    entry = F.concat(F.lit('"'), "name", F.lit('":"'), "version", F.lit('"'))
    manifests = pinned.groupBy("repo").agg(F.concat(F.lit('{"dependencies":{'), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}}")).alias("content")).select("repo", F.lit("package.json").alias("file"), "content")
    files = written(files.unionByName(manifests), "rescan-files")
    tools = spark.sql(OTHER_FOUND.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")).withColumn("detector_rank", F.lit(5)).withColumn("seq", F.lit(1))
    part = F.pmod(F.xxhash64("repo", "file"), F.lit(4))
    older = files.filter(part != 0).withColumn("content", F.when(part == 1, F.concat("content", F.lit("\neval(getUserInput())"))).otherwise(F.col("content")))
    gone = files.limit(5).select("repo", F.concat(F.lit("old/"), "file").alias("file"), F.lit("md5(x)").alias("content"))
    cache = ScanCache(spark, scratch(spark, "rescan"), CACHED)
    scan_changed(older.unionByName(gone), cache)
    return scan_changed(files, cache, advisories=derived(spark, sf_dir, "advisories"), others=(tools,)).select("repo", "file", "line", "id", "severity")
