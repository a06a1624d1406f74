"""Queries over files and lines: selection, detectors, secrets, call facts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import paths
from sievelight.operators import detect, facts
from sievelight.operators.findings import dedupe_findings
from sievelight.plans.common import Registry, scratch
from sievelight.plans.inputs import derived, duck, table
from sievelight.rules.defaults import default_matchers, native_matchers
from sievelight.sources import readers

R = Registry()
#: Bytes of a file that are one row on their way to its digest.
SLICE = 16384
FILES, LINES = duck("files"), duck("lines")
BASE = "regexp_extract(file, '([^/]*)$', 1)"
EXT = f"lower(regexp_extract({BASE}, '^.+(\\.[^.]*)$', 1))"
WHOLE = f"SELECT repo, file, string_agg(line_text, chr(10) ORDER BY line_no) AS content FROM ({LINES}) l GROUP BY repo, file"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of snippets, one for each user, lines in order."""
    lines = derived(spark, sf_dir, "lines")
    cells = F.array_sort(F.collect_list(F.struct("line_no", "line_text")))
    return lines.groupBy("repo", "file").agg(F.array_join(F.transform(cells, lambda c: c["line_text"]), "\n").alias("content"))


# Selection -------------------------------------------------------------------------------------------------

@R.query("SELECT source AS file, md5(concat(string_agg(text, chr(10) ORDER BY doc_id), chr(10))) AS digest FROM documents GROUP BY source")
def read_files(spark, sf_dir):
    """Writes the documents of each source as text files by ranges of doc_id, and reads the folder as files."""
    path = scratch(spark, "files")
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    write_ranges(docs, path)
    return digest_sources(readers.read_files(spark, path))


def write_ranges(docs: DataFrame, path: str, rows: int = 256) -> None:
    """Text files of at most so many documents. A source of many rows is split over tasks; names sort as (source, doc_id)."""
    order = [F.col("source"), F.col("doc_id").asc_nulls_last()]
    docs.repartitionByRange(*order).sortWithinPartitions(*order).select("source", "text").write.option("maxRecordsPerFile", rows).partitionBy("source").text(path)


def digest_sources(files: DataFrame) -> DataFrame:
    """file (the source), digest: MD5 over the files of each source in order, a file at a time; no value holds a whole source."""

    def digests(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, md5, done = None, None, []
        for batch in frames:
            for name, content in zip(batch.column(0), batch.column(1)):
                if md5 is None or name.as_py() != source:
                    done += [(source, md5.hexdigest())] if md5 else []
                    source, md5 = name.as_py(), hashlib.md5()
                md5.update(content.as_buffer())
        done += [(source, md5.hexdigest())] if md5 else []
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["file", "digest"])

    name = r"source=([^/]*)/part-([0-9]+)-.*[.-]c([0-9]+)"
    place = [F.regexp_extract("path", name, 2).cast("long"), F.regexp_extract("path", name, 3).cast("long")]
    parts = files.filter(F.contains("file", F.lit("/part-"))).select(F.regexp_extract("file", name, 1).alias("file"), F.col("file").alias("path"), F.col("content").cast("binary").alias("content"))
    # Slices keep what one Arrow batch holds bounded: its size is a number of rows.
    slices = F.transform(F.sequence(F.lit(0), F.floor(F.length("content") / SLICE).cast("int")), lambda i: F.substr(F.col("content"), i * SLICE + 1, F.lit(SLICE)))
    rows = parts.select("file", *[p.alias(k) for p, k in zip(place, ("part", "chunk"))], F.posexplode(slices).alias("no", "content"))
    return rows.repartition("file").sortWithinPartitions("file", "part", "chunk", "no").select("file", "content").mapInArrow(digests, "file string, digest string")


GLOB_SQL = r"regexp_matches(file, '^src/.*\.ts$') OR regexp_matches(file, '\.(py|go)$')"
SKIP_SQL = r"regexp_matches(file, '(^|/)(node_modules|dist)/')"


@R.query(f"SELECT repo, file FROM ({FILES}) f WHERE ({GLOB_SQL}) AND NOT {SKIP_SQL}")
def filter_globs(spark, sf_dir):
    out = paths.filter_globs(derived(spark, sf_dir, "files"), ["src/**/*.ts", "**/*.{py,go}"], ["**/node_modules/**", "**/dist/**"])
    return out.select("repo", "file")


@R.query(rf"SELECT repo, file FROM ({FILES}) f WHERE NOT regexp_matches(file, '(^|/)(\.git|node_modules|dist|build|coverage)(/|$)')")
def match_listing(spark, sf_dir):
    return paths.match_listing(derived(spark, sf_dir, "files"))


@R.query(f"SELECT repo, file, {EXT} IN {_in(paths.CODE_EXTENSIONS)} AS code FROM ({FILES}) f")
def is_code_file(spark, sf_dir):
    return derived(spark, sf_dir, "files").select("repo", "file", paths.is_code_file(F.col("file")).alias("code"))


@R.query(f"SELECT repo, file, {EXT} NOT IN {_in(paths.BINARY_EXTENSIONS)} AS is_text FROM ({FILES}) f")
def is_text_file(spark, sf_dir):
    return derived(spark, sf_dir, "files").select("repo", "file", paths.is_text_file(F.col("file")).alias("is_text"))


@R.query(rf"""SELECT repo, file, lower({BASE}) = 'dockerfile' OR regexp_matches(lower({BASE}), '\.(dockerfile|tf|tfvars|yaml|yml)$')
    OR contains(file, '/k8s/') OR contains(file, '/kubernetes/') OR contains(file, '/helm/') AS infra FROM ({FILES}) f""")
def is_infra_file(spark, sf_dir):
    return derived(spark, sf_dir, "files").select("repo", "file", paths.is_infra_file(F.col("file")).alias("infra"))


LANG_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f"ends_with(lower(file), '{e}')" for e in ext)} THEN '{lang}'" for lang, ext in paths.LANGUAGE_EXTENSIONS.items()) + " END"


@R.query(f"SELECT repo, file, {LANG_SQL} AS lang FROM ({FILES}) f")
def detect_language(spark, sf_dir):
    return derived(spark, sf_dir, "files").select("repo", "file", paths.detect_language(F.col("file")).alias("lang"))


TOOL_ROWS = " UNION ALL ".join(f"SELECT '{tool}' AS tool, '{e}' AS ext" for tool, ext in paths.TOOL_EXTENSIONS.items() if tool != "brakeman" for e in ext)


@R.query(rf"SELECT repo, file, tool FROM ({FILES}) f JOIN ({TOOL_ROWS}) t ON lower(regexp_extract(file, '(\.[^.]*)$', 1)) = t.ext")
def select_tool_files(spark, sf_dir):
    out = derived(spark, sf_dir, "files").select("repo", "file", F.explode(paths.tools_of(F.col("file"), [" Bandit", "gosec", "semgrep "])).alias("tool"))
    return out


@R.query(f"SELECT repo, file FROM ({FILES}) f WHERE file = 'src/auth' OR starts_with(file, 'src/auth/')")
def target_path_filter(spark, sf_dir):
    return paths.target_path_filter(derived(spark, sf_dir, "files"), "src/auth/").select("repo", "file")


@R.query(f"SELECT repo, file AS relative FROM ({FILES}) f")
def normalize_path(spark, sf_dir):
    absolute = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/work/"), "file")).otherwise(F.translate("file", "/", "\\"))
    return derived(spark, sf_dir, "files").select("repo", paths.normalize_path(absolute, "/work").alias("relative"))


MODULE_SQL = """CASE WHEN dirs[1] = 'src' AND len(dirs) > 1 THEN array_to_string(dirs[1:3], '/') WHEN dirs[1] IN ('packages', 'apps') AND len(dirs) > 1 THEN array_to_string(dirs[1:2], '/')
    WHEN len(dirs) > 1 THEN dirs[1] ELSE 'root' END"""
MODULES = f"SELECT *, {MODULE_SQL} AS module FROM (SELECT *, CASE WHEN contains(parts[-1], '.') THEN parts[1:len(parts) - 1] ELSE parts END AS dirs FROM (SELECT *, string_split(file, '/') AS parts FROM ({FILES}) f0) f1) f2"


@R.query(f"SELECT repo, file, module FROM ({MODULES}) m")
def module_key(spark, sf_dir):
    return derived(spark, sf_dir, "files").select("repo", "file", paths.module_key(F.col("file")).alias("module"))


@R.query(rf"""WITH f AS ({FILES}), n AS (SELECT repo, count(*) AS k FROM f GROUP BY repo)
    SELECT DISTINCT repo, CASE WHEN k > 45 THEN CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) ELSE '.' END ELSE file END AS target FROM f JOIN n USING (repo)""")
def unique_dirs(spark, sf_dir):
    return paths.unique_dirs(derived(spark, sf_dir, "files"), limit=45)


# Detectors -------------------------------------------------------------------------------------------------

def _rule_rows(rules) -> str:
    return " UNION ALL ".join(f"SELECT {no} AS rule_no, '{r.id}' AS id, '{r.severity}' AS severity, {_quoted('(?i)' + r.pattern)} AS pattern" for no, r in enumerate(rules))


DOC_LINES = r"SELECT source AS repo, CAST(doc_id AS STRING) AS file, unnest(string_split_regex(text, '\r?\n')) AS t, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS line FROM documents"
LINE_HITS = f"SELECT repo, file, CAST(line AS INTEGER) AS line, " + "{cols} FROM ({lines}) l, (" + _rule_rows(detect.LINE_RULES) + ") r WHERE {tests}"
# One condition for each rule: RE2 takes constant patterns.
LINE_TESTS = " OR ".join(f"(rule_no = {no} AND regexp_matches(t, {_quoted('(?i)' + r.pattern)}))" for no, r in enumerate(detect.LINE_RULES))


def docs_as_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))


@R.query(LINE_HITS.format(cols="id, severity", lines=DOC_LINES, tests=LINE_TESTS))
def line_patterns(spark, sf_dir):
    return detect.line_patterns(docs_as_files(spark, sf_dir)).select("repo", "file", "line", "id", "severity")


@R.query(LINE_HITS.format(cols="id, severity", lines=f"SELECT repo, file, line_no AS line, line_text AS t FROM ({LINES}) x", tests=LINE_TESTS))
def line_patterns_code(spark, sf_dir):
    return detect.line_patterns(whole_files(spark, sf_dir)).select("repo", "file", "line", "id", "severity")


def _infra_arm(no: int, rule) -> str:
    p = _quoted("(?i)" + rule.pattern)
    nl = lambda s: f"(length({s}) - length(replace({s}, chr(10), '')))"
    before = f"list_sum(list_transform(pieces[1:k], lambda x: {nl('x')})) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: {nl('x')})), 0)"
    return f"""SELECT repo, file, CAST(1 + {before} AS INTEGER) AS line, '{rule.id}' AS id FROM (
        SELECT repo, file, pieces, found, unnest(range(1, len(found) + 1)) AS k FROM (SELECT repo, file, string_split_regex(content, {p}) AS pieces, regexp_extract_all(content, {p}, 0) AS found FROM w WHERE regexp_matches(content, {p})) x) y"""


@R.query(f"WITH w AS (SELECT * FROM ({WHOLE}) w0 WHERE regexp_matches(file, '\\.(tf|yaml)$')) " + " UNION ALL ".join(_infra_arm(no, r) for no, r in enumerate(detect.INFRA_RULES)))
def infra_patterns(spark, sf_dir):
    return detect.infra_patterns(whole_files(spark, sf_dir)).select("repo", "file", "line", "id")


LITERAL_RE = r"""([A-Za-z_$][A-Za-z0-9_$-]*)["']?\s*[:=]\s*("[^"\n]*"|'[^'\n]*'|`[^`$\n]*`)"""
LITERALS = f"""SELECT repo, file, CAST(line_no AS INTEGER) AS line,
    CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x))) + list_sum(list_transform(found[1:k], lambda x: length(x))) - length(quoted[k]) + 1 AS INTEGER) AS col, names[k] AS name, quoted[k][2:length(quoted[k]) - 1] AS value
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (SELECT repo, file, line_no, string_split_regex(line_text, {_quoted(LITERAL_RE)}) AS pieces, regexp_extract_all(line_text, {_quoted(LITERAL_RE)}, 0) AS found,
    regexp_extract_all(line_text, {_quoted(LITERAL_RE)}, 1) AS names, regexp_extract_all(line_text, {_quoted(LITERAL_RE)}, 2) AS quoted FROM ({LINES}) l) a) b"""


@R.query(LITERALS)
def assigned_literals(spark, sf_dir):
    return detect.assigned_literals(whole_files(spark, sf_dir)).withColumnRenamed("column", "col")


VALUE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(value, {_quoted(p)}) THEN '{rule}'" for rule, _, p in detect.SECRET_VALUES) + " END"
ENTROPY_SQL = "(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / CAST(length(value) AS DOUBLE) AS p FROM (SELECT unnest(string_split(value, '')) AS c) q GROUP BY c) q2)"
SECRET_SQL = f"""SELECT repo, file, line, col, name, CASE WHEN v IS NOT NULL THEN 'value' WHEN regexp_matches(name, '{detect.SECRET_NAME}') THEN 'name' WHEN round(h, 6) >= 3.7 THEN 'entropy' END AS reason, coalesce(v, 'hardcoded-secret') AS secret_id
  FROM (SELECT *, {VALUE_SQL} AS v, {ENTROPY_SQL} AS h FROM ({LITERALS}) l WHERE length(value) >= 16) s"""


def _secrets(reason: str):
    def run(spark, sf_dir):
        found = detect.classify_secrets(detect.assigned_literals(whole_files(spark, sf_dir))).filter(F.col("reason") == reason)
        return found.select("repo", "file", "line", F.col("column").alias("col"), "name", "secret_id")

    return run


for _name, _reason in (("secret_value_patterns", "value"), ("secret_key_names", "name"), ("secret_entropy", "entropy")):
    R.query(f"SELECT repo, file, line, col, name, secret_id FROM ({SECRET_SQL}) z WHERE reason = '{_reason}'", _name)(_secrets(_reason))

# Call facts ------------------------------------------------------------------------------------------------

CALL_RE = r"([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)\s*\("
#: A member of what a call gives has no name in JavaScript; what comes before it does.
MEMBER_RE = r"\)\s*\.\s*[A-Za-z_$][A-Za-z0-9_$.]*\s*\("
CALLS = f"SELECT repo, file, CAST(line_no AS INTEGER) AS line, name, arg0 FROM (SELECT *, unnest(regexp_extract_all(regexp_replace(line_text, '{MEMBER_RE}', ')(', 'g'), '{CALL_RE}', 1)) AS name, nullif(regexp_extract(line_text, '\\(\"([^\"]*)\"\\s*[,)]', 1), '') AS arg0 FROM ({LINES}) l WHERE regexp_matches(file, '\\.(js|ts)$')) c"


def js_facts(spark, sf_dir):
    return facts.extract_call_facts(whole_files(spark, sf_dir)).filter("lang = 'javascript'")


@R.query(f"SELECT repo, file, line, name, arg0 FROM ({CALLS}) c")
def extract_call_facts(spark, sf_dir):
    return js_facts(spark, sf_dir).filter("kind = 'call'").select("repo", "file", "line", "name", "arg0")


def _calls(f, condition: str, name: str):
    @R.query(f"SELECT repo, file, line, name, arg0 FROM ({CALLS}) c WHERE {condition}", name)
    def run(spark, sf_dir):
        return f(js_facts(spark, sf_dir)).select("repo", "file", "line", "name", "arg0")


_calls(facts.weak_hash_calls, "name IN ('createHash', 'crypto.createHash') AND lower(arg0) IN ('md5', 'sha1', 'md4')", "weak_hash_calls")
_calls(facts.insecure_random_calls, f"name IN {_in(facts.RANDOM_CALLS)}", "insecure_random_calls")
_calls(facts.insecure_cipher_api, "name IN ('createCipher', 'crypto.createCipher', 'createDecipher', 'crypto.createDecipher')", "insecure_cipher_api")
_calls(facts.weak_cipher_calls, "name IN ('createCipheriv', 'crypto.createCipheriv', 'createDecipheriv', 'crypto.createDecipheriv') AND regexp_matches(lower(arg0), 'des|3des|rc2|rc4|bf|blowfish|idea|-ecb|ecb$')", "weak_cipher_calls")
_calls(facts.deserialization_calls, f"name IN {_in(facts.DESERIALIZERS)}", "deserialization_calls")


@R.query(f"""SELECT repo, file, CAST(line_no AS INTEGER) AS line, name, 'py-weak-crypto' AS rule_id FROM (SELECT *, unnest(regexp_extract_all(line_text, '{CALL_RE}', 1)) AS name FROM ({LINES}) l WHERE ends_with(file, '.py')) c
    WHERE regexp_matches(name, 'md5|sha1')
    UNION ALL SELECT repo, file, CAST(line_no AS INTEGER) AS line, name, 'go-weak-crypto' AS rule_id FROM (SELECT *, unnest(regexp_extract_all(line_text, '{CALL_RE}', 1)) AS name FROM ({LINES}) l WHERE ends_with(file, '.go')) c WHERE regexp_matches(name, 'md5|sha1')""")
def native_direct_rules(spark, sf_dir):
    found = facts.native_direct_rules(facts.extract_call_facts(whole_files(spark, sf_dir)), native_matchers(spark))
    return found.select("repo", "file", "line", "name", "rule_id")


SECRET_LITERAL_SQL = r"""(?i)(api|secret|token|password|passwd|pwd|key)[^\n\r]{0,20}["''][A-Za-z0-9_\-]{8,}["'']"""


@R.query(f"SELECT repo, file, CAST(line_no AS INTEGER) AS line, CASE WHEN ends_with(file, '.py') THEN 'py' ELSE 'go' END || '-hardcoded-secret' AS rule_id FROM ({LINES}) l WHERE regexp_matches(file, '\\.(py|go)$') AND regexp_matches(line_text, '{SECRET_LITERAL_SQL}')")
def native_secret_rules(spark, sf_dir):
    return facts.native_secret_rules(whole_files(spark, sf_dir), native_matchers(spark))


NAMES = "SELECT DISTINCT concat('a', CAST(user_id % 9 AS STRING), '.', event_type, '.', CASE event_id % 8 WHEN 0 THEN 'query' WHEN 1 THEN 'fetch' WHEN 2 THEN 'db.query' WHEN 3 THEN 'eval' WHEN 4 THEN 'escape' WHEN 5 THEN 'prompt' ELSE 'other' END) AS name FROM events"


def _names(spark, sf_dir):
    return spark.sql(NAMES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


@R.query(f"SELECT name, array_to_string(list_distinct(list_transform(range(1, len(string_split(name, '.')) + 1), lambda i: array_to_string(string_split(name, '.')[i:], '.'))).list_sort(), '|') AS variants FROM ({NAMES}) n")
def callee_variants(spark, sf_dir):
    return _names(spark, sf_dir).select("name", F.array_join(F.array_sort(facts.callee_variants(F.col("name"))), "|").alias("variants"))


def _matcher_sql() -> str:
    from sievelight.rules.defaults import JS_RULES

    rows = [f"('{rule.id}', '{role}', {at}, '{v}')" for rule in JS_RULES for role, ends in (("source", rule.sources), ("sink", rule.sinks), ("sanitizer", rule.sanitizers)) for at, (_, _, values) in enumerate(ends) for v in values]
    return "(VALUES " + ", ".join(rows) + ") AS m(rule_id, role, endpoint_no, value)"


@R.query(f"""SELECT name, rule_id, role, CAST(min(endpoint_no) AS INTEGER) AS endpoint_no FROM (SELECT name, unnest(list_transform(range(1, len(string_split(name, '.')) + 1), lambda i: array_to_string(string_split(name, '.')[i:], '.'))) AS variant FROM ({NAMES}) n) v
    JOIN {_matcher_sql()} ON variant = value GROUP BY name, rule_id, role""")
def match_callees(spark, sf_dir):
    names = _names(spark, sf_dir).select(F.lit("javascript").alias("lang"), "name")
    return facts.match_callees(names, default_matchers(spark)).select("name", "rule_id", "role", "endpoint_no")


def event_facts(spark, sf_dir):
    """Facts made of events: one expression each, with one name read or called."""
    rows = derived(spark, sf_dir, "facts")
    text = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    expr = F.struct(text("ref").alias("refs"), text("called").alias("calls"))
    none = F.lit(None).cast("int")
    return rows.select("repo", "file", F.lit("javascript").alias("lang"), "scope_id", "pos", F.lit(1).alias("line"), F.lit(1).alias("column"), "kind", "name", F.array(expr).alias("args"), none.alias("within"), none.alias("within_arg"), F.col("pos").alias("root"))


FACTS = duck("facts")
ASOF = f"SELECT u.repo, u.file, u.scope_id, u.ref AS name, u.pos AS use_pos, max(d.pos) AS def_pos FROM f u LEFT JOIN f d ON d.kind = 'assign' AND d.file = u.file AND d.scope_id = u.scope_id AND d.name = u.ref AND d.pos {{op}} u.pos WHERE u.ref IS NOT NULL GROUP BY ALL"


@R.query(f"WITH f AS ({FACTS}) {ASOF.format(op='<')}")
def def_use_asof(spark, sf_dir):
    return facts.def_use_asof(event_facts(spark, sf_dir))


@R.query(f"WITH f AS ({FACTS}) SELECT * FROM ({ASOF.format(op='<=')}) a WHERE def_pos IS NOT NULL")
def data_flow_edges(spark, sf_dir):
    return facts.data_flow_edges(event_facts(spark, sf_dir))


TAINT_SQL = f"""WITH RECURSIVE f AS ({FACTS}), e AS ({ASOF.format(op='<')}),
  bad(file, scope_id, pos) AS (
    SELECT file, scope_id, pos FROM f WHERE kind = 'assign' AND called = '{{source}}'
    UNION SELECT f.file, f.scope_id, f.pos FROM bad b JOIN e ON e.file = b.file AND e.scope_id = b.scope_id AND e.def_pos = b.pos JOIN f ON f.file = e.file AND f.scope_id = e.scope_id AND f.pos = e.use_pos WHERE f.kind = 'assign')
  SELECT f.repo, f.file, '{{rule}}' AS rule_id, f.pos FROM f JOIN e ON e.file = f.file AND e.scope_id = f.scope_id AND e.use_pos = f.pos JOIN bad b ON b.file = e.file AND b.scope_id = e.scope_id AND b.pos = e.def_pos WHERE f.kind = 'call' AND f.name = '{{sink}}'"""


@R.query(f"SELECT * FROM ({TAINT_SQL.format(rule='js-eval-injection', sink='eval', source='getUserInput')}) a UNION ALL SELECT * FROM ({TAINT_SQL.format(rule='js-command-injection', sink='child_process.exec', source='getUserInput')}) b")
def taint_js(spark, sf_dir):
    from sievelight.operators.taint import taint_js as run

    return run(event_facts(spark, sf_dir), default_matchers(spark)).select("repo", "file", "rule_id", F.col("pos").cast("long").alias("pos"))


NATIVE_NAMES = {"getUserInput": "request.args.get", "sanitize": "clean", "unknown": "strip", "eval": "os.system", "child_process.exec": "open"}


@R.query(f"SELECT * FROM ({TAINT_SQL.format(rule='py-cmd', sink='eval', source='getUserInput')}) a UNION ALL SELECT * FROM ({TAINT_SQL.format(rule='py-path', sink='child_process.exec', source='getUserInput')}) b")
def taint_native(spark, sf_dir):
    """The same facts under Python's names: the rules for commands and paths share their sources."""
    from sievelight.operators.taint import taint_native as run

    renamed = F.create_map(*[F.lit(x) for pair in NATIVE_NAMES.items() for x in pair])
    new = lambda n: F.coalesce(renamed[n], n)
    args = F.transform("args", lambda e: F.struct(e["refs"].alias("refs"), F.transform(e["calls"], new).alias("calls")))
    rows = event_facts(spark, sf_dir).withColumn("lang", F.lit("python")).withColumn("args", args).withColumn("name", new(F.col("name")))
    return run(rows, native_matchers(spark)).select("repo", "file", "rule_id", F.col("pos").cast("long").alias("pos"))


@R.query(f"SELECT DISTINCT repo, file, 'os' AS module FROM ({LINES}) l WHERE line_text = 'import os' AND regexp_matches(file, '\\.(js|ts|py|go)$')")
def import_edges(spark, sf_dir):
    return facts.import_edges(facts.extract_call_facts(whole_files(spark, sf_dir)))


#: Functions made of lines: each snippet stands in a function named after its line; snippets with a brace would close or open others.
def function_files(spark, sf_dir):
    lines = derived(spark, sf_dir, "lines").filter("(file like '%.js' or file like '%.ts') and line_text not like '%{%'")
    body = F.concat(F.when(F.col("line_no") % 2 == 0, "async ").otherwise(""), F.lit("function fn"), F.col("line_no").cast("string"), F.lit("(a, b) {\n  "), "line_text", F.lit("\n}"))
    cells = F.array_sort(F.collect_list(F.struct("line_no", body.alias("t"))))
    return lines.groupBy("repo", "file").agg(F.array_join(F.transform(cells, lambda c: c["t"]), "\n").alias("content"))


FUNCTION_LINES = f"SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS nth FROM ({LINES}) l WHERE regexp_matches(file, '\\.(js|ts)$') AND NOT contains(line_text, '{{')"


@R.query(f"""SELECT repo, file, concat(file, ':fn', CAST(line_no AS STRING), ':', CAST(nth * 3 - 2 AS STRING)) AS id, 'a,b' AS params, line_no % 2 = 0 AS is_async, 'function' AS func_kind FROM ({FUNCTION_LINES}) x
    UNION ALL SELECT DISTINCT repo, file, concat(file, ':<module>:0'), '', false, 'module' FROM ({FUNCTION_LINES}) x""")
def function_map(spark, sf_dir):
    found = facts.function_map(facts.extract_call_facts(function_files(spark, sf_dir)))
    return found.select("repo", "file", "id", F.array_join("params", ",").alias("params"), "is_async", "func_kind")


@R.query(f"SELECT DISTINCT repo, file, concat('fn', CAST(line_no AS STRING)) AS caller, unnest(regexp_extract_all(regexp_replace(line_text, '{MEMBER_RE}', ')(', 'g'), '{CALL_RE}', 1)) AS callee FROM ({FUNCTION_LINES}) x")
def call_edges(spark, sf_dir):
    return facts.call_edges(facts.extract_call_facts(function_files(spark, sf_dir)))


WEAK_NATIVE = f"SELECT repo, file, line_no AS line, CASE WHEN ends_with(file, '.py') THEN 'py' ELSE 'go' END || '-weak-crypto' AS id, 'medium' AS severity FROM (SELECT *, unnest(regexp_extract_all(line_text, '{CALL_RE}', 1)) AS name FROM ({LINES}) l WHERE regexp_matches(file, '\\.(py|go)$')) c WHERE regexp_matches(name, 'md5|sha1')"
SECRET_NATIVE = f"SELECT repo, file, line_no AS line, CASE WHEN ends_with(file, '.py') THEN 'py' ELSE 'go' END || '-hardcoded-secret' AS id, 'medium' AS severity FROM ({LINES}) l WHERE regexp_matches(file, '\\.(py|go)$') AND regexp_matches(line_text, '{SECRET_LITERAL_SQL}')"
CRYPTO_CALLS = """(name IN ('createHash', 'crypto.createHash') AND lower(arg0) IN ('md5', 'sha1', 'md4')) OR name IN ('Math.random', 'crypto.pseudoRandomBytes', 'pseudoRandomBytes')
    OR name IN ('createCipher', 'crypto.createCipher', 'createDecipher', 'crypto.createDecipher')
    OR (name IN ('createCipheriv', 'crypto.createCipheriv', 'createDecipheriv', 'crypto.createDecipheriv') AND regexp_matches(lower(arg0), 'des|3des|rc2|rc4|bf|blowfish|idea|-ecb|ecb$'))"""
SCAN_SQL = f"""WITH w AS (SELECT * FROM ({WHOLE}) w0 WHERE regexp_matches(file, '\\.(tf|yaml)$'))
  SELECT DISTINCT repo, file, CAST(line AS INTEGER) AS line, id, severity FROM (
    {LINE_HITS.format(cols='id, severity', lines=f"SELECT repo, file, line_no AS line, line_text AS t FROM ({LINES}) x", tests=LINE_TESTS)}
    UNION ALL SELECT i.repo, i.file, i.line, i.id, s.severity FROM ({" UNION ALL ".join(_infra_arm(no, r) for no, r in enumerate(detect.INFRA_RULES))}) i JOIN ({_rule_rows(detect.INFRA_RULES)}) s USING (id)
    UNION ALL SELECT repo, file, line, 'insecure-crypto', 'high' FROM ({CALLS}) c WHERE {CRYPTO_CALLS}
    UNION ALL SELECT repo, file, line, 'unsafe-deserialization', 'high' FROM ({CALLS}) c WHERE name IN {_in(facts.DESERIALIZERS)}
    UNION ALL SELECT repo, file, line, secret_id, 'high' FROM ({SECRET_SQL}) z WHERE reason IS NOT NULL AND regexp_matches(file, '\\.(js|ts)$')
    UNION ALL SELECT repo, file, line_no, CASE WHEN regexp_matches(file, '\\.(js|ts)$') THEN 'js-eval-injection' WHEN ends_with(file, '.py') THEN 'py-cmd' ELSE 'go-cmd' END, 'high' FROM ({LINES}) t
      WHERE (regexp_matches(file, '\\.(js|ts)$') AND line_text = 'const q = getUserInput(); eval(q);') OR (ends_with(file, '.py') AND line_text = 'os.system(input())') OR (ends_with(file, '.go') AND line_text = 'exec.Command(r.FormValue(q))')
    UNION ALL {WEAK_NATIVE} UNION ALL {SECRET_NATIVE}) u"""


@R.query(SCAN_SQL)
def scan_all(spark, sf_dir):
    """All detectors over the files of snippets."""
    from sievelight.operators.scan import scan_all as run

    return run(whole_files(spark, sf_dir)).select("repo", "file", "line", "id", "severity")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievelight.operators.findings import count_by_severity

    return count_by_severity(dedupe_findings(detect.line_patterns(docs_as_files(spark, sf_dir))))


R.query(
    "SELECT repo, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical "
    f"FROM ({LINE_HITS.format(cols='id, severity', lines=DOC_LINES, tests=LINE_TESTS)}) h GROUP BY repo",
    "flagship",
)(flagship)
