import hashlib

from sievelight.plans import finding_queries, scan_queries
from sievelight.sources import readers


def test_readme_is_taken_from_rows(spark):
    rows = [(2, "s", "c\r\n \r\nd\r"), (1, "s", "a\n\nb"), (3, "s", None), (4, "s", "\n".join("efghijklmnop")), (5, "t", " "), (6, "u", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = finding_queries.first_lines(docs, 6)
    assert {r["repo"]: r["content"] for r in got.collect()} == {"s": "a\nb\nc\nd\ne\nf", "t": "\n"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_files_of_a_source_are_bounded(spark, tmp_path):
    rows = [(n * 7 % 1000, "s" if n % 3 else "t", f"{n * 7 % 1000} é\n" + "x" * (n * 37 % 20_000)) for n in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    scan_queries.write_ranges(docs, str(tmp_path / "f"), rows=50)
    files = readers.read_files(spark, str(tmp_path / "f"))
    assert max(r["n"] for r in files.selectExpr("length(content) n").collect()) < 50 * 20_010
    want = {s: hashlib.md5("".join(t + "\n" for _, k, t in sorted(rows) if k == s).encode()).hexdigest() for s in "st"}
    assert {r["file"]: r["digest"] for r in scan_queries.digest_sources(files).collect()} == want
