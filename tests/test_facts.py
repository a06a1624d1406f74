"""Call facts of any text in linear time, rule matching by equal values, taint over nested calls."""

import random
import time

import pytest

from sievelight.operators import facts, taint
from sievelight.rules.defaults import native_matchers
from sievelight.sources.readers import MATCHERS


def calls(code, lang="javascript"):
    return [(r[8], r[15]) for r in facts.file_facts("r", "a", lang, code) if r[7] == "call"]


@pytest.mark.parametrize(
    "code, rows",
    [("f(" * 100_000 + "x" + ")" * 100_000, 100_000), ("{" * 200_000, 0), ("function f(" * 50_000, 50_000), ("(a => " * 50_000, 50_000), ("a" * 1_000_000, 0), ("/* x\n" * 100_000, 0), ("function a() {" * 50_000, 50_000),
     ("f(" + "(" * 50_000 + "g()," * 50_000, 50_001), ("a()" + ".b()" * 100_000, 1), ("x = {a: [" * 50_000, 50_000), ("\"'`" * 100_000, 0), ("a b c " * 50_000, 0)],
    ids=["calls", "braces", "unclosed", "arrows", "name", "comments", "functions", "brackets", "chain", "literals", "quotes", "words"],
)
def test_any_nesting_takes_linear_time(code, rows):
    began = time.time()
    assert len(facts.file_facts("r", "a.js", "javascript", code)) == rows and time.time() - began < 20


def test_random_text_never_fails():
    rng = random.Random(3)
    pieces = ["f(", ")", "{", "}", "[", "]", "\n", ";", "=", "=>", "x", "async ", "function ", "def ", ".", ",", "'", '"', "`", "/*", "*/", "//", "#", "a.b", "->", "::", "é", " ", "\\", "import x", ":"]
    for lang in ("javascript", "python", "ruby", "kotlin"):
        for _ in range(300):
            facts.file_facts("r", "a", lang, "".join(rng.choices(pieces, k=rng.randint(0, 60))))


def test_a_file_that_cannot_be_read_gives_a_row(spark, monkeypatch):
    assert facts._rows_of("r", "a.js", "javascript", None)[0][7:9] == ("error", "TypeError")
    df = spark.createDataFrame([("r", "a.js", "f(x)"), ("r", "b.js", None)], "repo string, file string, content string")
    found = facts.extract_call_facts(df)
    assert facts.unread_files(found).count() == 0 and found.filter("kind = 'call'").count() == 1


def test_places_of_nested_calls():
    rows = facts.file_facts("r", "a.js", "javascript", "y = f(g(x, 'k'), h());")
    assert [(r[7], r[8], r[4], r[15], r[16], r[17]) for r in rows] == [("assign", "y", 0, None, None, 0), ("call", "f", 1, 0, 0, 0), ("call", "g", 2, 1, 0, 0), ("call", "h", 3, 1, 1, 0)]
    assert rows[1][9] == [{"refs": [], "calls": ["g"]}, {"refs": [], "calls": ["h"]}] and rows[2][9][0]["refs"] == ["x"]


def test_names_of_chained_calls():
    assert [c for c, _ in calls("Runtime.getRuntime().exec(cmd)")] == ["Runtime.getRuntime"]
    assert [c for c, _ in calls('q = r.URL.Query().Get("x").Trim()', "go")] == ["r.URL.Query", "r.URL.Query().Get", "Get().Trim"]


def table(spark, rows):
    return spark.createDataFrame([("js", rule, "t", "low", "o", "taint", 0, "source", 0, rule, kind, value) for rule, kind, value in rows], MATCHERS)


def test_globs_and_prefixes_meet_by_equal_values(spark):
    import re

    rng = random.Random(5)
    names = sorted({".".join(rng.choices(["a", "ab", "b", "query", "Get()", "x/y", "md5"], k=rng.randint(1, 4))) for _ in range(150)})
    globs = ["*", "a*", "*b", "*a*b*", "*.query", "a.*.b", "*md5*", "x/*", "*/y", "ab", "a*a", "**b", "*x/y*"]
    rules = [(g, "glob", g) for g in globs] + [(f"p{p}", "prefix", p) for p in ("a", "a.b", "query", "x/", "zz")]
    got = {(r["name"], r["rule_id"]) for r in facts.match_callees(spark.createDataFrame([("js", n) for n in names], "lang string, name string"), table(spark, rules)).collect()}
    want = set()
    for n in names:
        variants = [n.split(".", i)[-1] for i in range(n.count(".") + 1)]
        want |= {(n, g) for g in globs if any(re.fullmatch(re.escape(g).replace(r"\*", "[^/]*"), v) for v in variants)}
        want |= {(n, f"p{p}") for p in ("a", "a.b", "query", "x/", "zz") if any(v.startswith(p) for v in variants)}
    assert got == want


def test_many_rules_join_without_patterns(spark):
    rules = table(spark, [(f"r{i}", ("exact", "prefix", "glob")[i % 3], f"mod{i}.call" + ("*" if i % 3 == 2 else "")) for i in range(100_000)])
    names = spark.createDataFrame([("js", f"mod{i}.call{'ed' if i % 3 else ''}") for i in range(50)], "lang string, name string")
    found = facts.match_callees(names, rules)
    plan = found._jdf.queryExecution().toString()
    assert {r["rule_id"] for r in found.collect()} == {f"r{i}" for i in range(50)}
    assert "RLIKE" not in plan.upper() and "NestedLoop" not in plan and "Cartesian" not in plan


def rule(matchers, rule_id, role):
    return {(r["kind"], r["value"]) for r in matchers.filter(f"rule_id = '{rule_id}' and role = '{role}'").collect()}


def test_values_of_the_packs(spark):
    m = native_matchers(spark)
    flask = {("prefix", "request.args.get"), ("prefix", "request.form.get"), ("prefix", "request.values.get")}
    assert rule(m, "py-cmd", "source") == flask | {("exact", "input"), ("exact", "raw_input")}
    for other in ("py-path", "py-ssrf", "py-deser", "py-xss-template"):
        assert rule(m, other, "source") == flask
    for one in ("sqli", "cmd", "path", "ssrf", "deser", "xss-template"):
        assert rule(m, f"go-{one}", "source") == {("glob", "*.Query"), ("glob", "*.Query().Get"), ("glob", "*.FormValue")}
        assert rule(m, f"rb-{one}", "source") == {("glob", "params.*"), ("glob", "params[]")}
    assert rule(m, "kt-deser", "sink") == {("glob", x) for x in ("ObjectInputStream.readObject", "*.readObject", "ObjectMapper.readValue", "*.readValue", "Gson.fromJson", "*.fromJson")}
    assert rule(m, "rb-weak-crypto", "direct") == {("glob", x) for x in ("*MD5*", "*SHA1*", "Digest.MD5", "Digest.SHA1")}
    assert m.filter("rule_id = 'go-cmd' and role = 'source'").first()["endpoint_name"] == "r.URL.Query"
    assert m.select("rule_id").distinct().count() == 84


def hits(spark, rows):
    df = spark.createDataFrame([(f"r{i}", f, c) for i, (f, c) in enumerate(rows)], "repo string, file string, content string")
    found = taint.taint_native(facts.extract_call_facts(df), native_matchers(spark)).collect()
    return [{h["rule_id"] for h in found if h["repo"] == f"r{i}"} for i in range(len(rows))]


def test_taint_of_nested_native_calls(spark):
    deep = "strip(" * 2_000 + "x" + ")" * 2_000
    got = hits(spark, [
        ("a.go", 'q := r.URL.Query().Get("q")\nexec.Command(trim(q))'),
        ("a.rb", "x = params[:id]\nsystem(x)"),
        ("a.py", "x = input()\nopen(x)"),
        ("a.py", f"x = input()\nos.system({deep})"),
        ("a.py", "x = input()\nx = os.system(x)"),
        ("a.py", "x = input()\nx = x + os.system(x)"),
        ("a.py", "x = input()\ncur.execute(f(x))"),
        ("a.py", "x = input()\nos.system(g(cur.execute(q), x))"),
    ])
    assert got == [{"go-cmd"}, {"rb-cmd"}, set(), {"py-cmd"}, {"py-cmd"}, {"py-cmd"}, {"py-sqli"}, {"py-cmd"}]


def test_a_large_scope_is_streamed(spark):
    """A chain of 100,000 assignments in one scope; batches cut it anywhere."""
    n = 100_000
    code = "x0 = input()\n" + "".join(f"x{i} = x{i - 1}\n" for i in range(1, n)) + f"os.system(x{n - 1})\nos.system(y)"
    assert hits(spark, [("a.py", code)]) == [{"py-cmd"}]
