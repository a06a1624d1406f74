"""Caches that are replaced file by file, files read in two passes, places by ranges, scans of what has changed."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.functions.tables import placed
from sievelight.operators.scan import CACHED, scan_all, scan_changed
from sievelight.sources import readers
from sievelight.sources.cache import ScanCache

SCHEMAS = {"found": "repo string, file string, line int", "hashes": "repo string, file string, hash string"}


def files(spark, *names):
    return spark.createDataFrame([("r", f) for f in names], "repo string, file string")


def found(spark, *rows):
    return spark.createDataFrame([("r", *r) for r in rows], SCHEMAS["found"])


def lines(cache, version=None):
    return sorted((r["file"], r["line"]) for r in cache.read("found", version).collect())


def test_upsert_replaces_deletes_and_takes_a_batch_once(spark, tmp_path):
    cache = ScanCache(spark, str(tmp_path / "c"), SCHEMAS, buckets=4)
    assert lines(cache) == [] and cache.versions() == []
    assert cache.upsert({"found": found(spark, ("a", 1), ("a", 2), ("b", 1))}, files(spark, "a", "b"), 0)
    assert cache.upsert({"found": found(spark, ("a", 7), ("x", 9))}, files(spark, "a", "c"), 1)  # x is not among the files seen
    assert lines(cache) == [("a", 7), ("b", 1)]
    assert not cache.upsert({"found": found(spark, ("a", 8))}, files(spark, "a"), 1) and lines(cache) == [("a", 7), ("b", 1)]
    assert cache.upsert({}, files(spark, "b"), 2) and lines(cache) == [("a", 7)] and lines(cache, 1) == [("a", 1), ("a", 2), ("b", 1)]
    assert cache.vacuum(1) > 0 and cache.versions() == [3] and lines(cache) == [("a", 7)]


def test_a_version_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    cache = ScanCache(spark, str(tmp_path / "c"), SCHEMAS)
    cache.upsert({"found": found(spark, ("a", 1))}, files(spark, "a"), 0)
    with monkeypatch.context() as m:
        m.setattr(cache, "_publish", lambda manifest: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            cache.upsert({"found": found(spark, ("a", 2))}, files(spark, "a"), 1)
    assert lines(cache) == [("a", 1)]
    assert cache.upsert({"found": found(spark, ("a", 3))}, files(spark, "a"), 1) and lines(cache) == [("a", 3)]
    stale = cache.manifest() | {"version": 2}
    with pytest.raises(RuntimeError):
        cache._publish(stale)


def test_untouched_buckets_stay_where_they_are(spark, tmp_path):
    cache = ScanCache(spark, str(tmp_path / "c"), SCHEMAS, buckets=16)
    names = [f"f{i}" for i in range(60)]
    cache.upsert({"found": found(spark, *[(n, 1) for n in names])}, files(spark, *names), 0)
    before = cache.manifest()["tables"]["found"]
    cache.upsert({"found": found(spark, ("f1", 2))}, files(spark, "f1"), 1)
    after = cache.manifest()["tables"]["found"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(lines(cache)) == 60


def test_places_of_one_large_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 50 == 0, "b").when(F.col("id") % 51 == 0, None).otherwise("a").alias("g"), F.pmod(F.col("id") * 7919, F.lit(5003)).alias("k"), "id")
    out = placed(df, ["g"], [F.col("k").desc()], "place", parts=7)
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("k"))))
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.select(*out.columns).collect()))
    assert placed(df.limit(0), ["g"], [F.col("k")], "place").count() == 0


def test_files_are_listed_before_they_are_read(spark, tmp_path):
    (tmp_path / "[a]{b}").mkdir()
    (tmp_path / "[a]{b}" / "x*.py").write_text("a = 1")
    (tmp_path / "latin.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "logo.png").write_bytes(bytes(range(256)))
    (tmp_path / "long.js").write_text("x" * 5000)
    (tmp_path / "LICENSE").write_text("")
    got = {r["file"]: r["content"] for r in readers.read_files(spark, str(tmp_path), longest=4999).collect()}
    assert got == {"[a]{b}/x*.py": "a = 1", "latin.txt": "�"}  # Spark lists no empty files, and they hold nothing to find
    listed = {r["file"]: r["length"] for r in readers.list_files(spark, str(tmp_path)).collect()}
    assert listed["long.js"] == 5000 and "logo.png" not in listed
    # No content is read for a listing, and the second pass names no file that is left out.
    assert "content" not in readers.list_files(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("Project")[-1].split("Relation")[0]
    assert not [f for f in readers.read_files(spark, str(tmp_path), longest=4999).inputFiles() if "logo" in f or "long" in f]
    assert readers.read_files(spark, str(tmp_path), longest=-1).count() == 0


def test_a_scan_of_what_has_changed_equals_a_whole_one(spark, tmp_path):
    make = lambda **f: spark.createDataFrame([("r", n.replace("_", "."), c) for n, c in f.items()], "repo string, file string, content string")
    advisories = spark.createDataFrame([("CVE-1", "left-pad", "npm", "!=1.3.1", "1.3.1", "high", 7.5, None, None, None)], "id string, package string, ecosystem string, affectedRange string, fixedVersion string, severity string, cvssScore double, description string, exploitability string, privilegeRequired string")
    first = make(a_js="eval(getUserInput())", b_py="import os\nos.system(input())", c_py="hashlib.md5(x)", package_json='{"dependencies":{"left-pad":"1.3.0"}}')
    second = make(a_js="eval(1)", b_py="import os\nos.system(input())", d_py="x = input()\nopen(x)\nos.system(x)", package_json='{"dependencies":{"left-pad":"1.3.0"}}')
    cache = ScanCache(spark, str(tmp_path / "c"), CACHED)
    shown = lambda df: sorted((r["file"], r["line"] or 0, r["id"], r["detector_rank"]) for r in df.collect())
    assert shown(scan_changed(first, cache, advisories=advisories)) == shown(scan_all(first, advisories=advisories))
    got = shown(scan_changed(second, cache, advisories=advisories))
    assert got == shown(scan_all(second, advisories=advisories)) and ("b.py", 2, "py-cmd", 6) in got and ("package.json", 0, "CVE-1", 7) in got
    assert {r["file"] for r in cache.read("hashes").collect()} == {"a.js", "b.py", "d.py", "package.json"} and "c.py" not in {r["file"] for r in cache.read("findings").collect()}


def test_languages_that_are_allowed(spark):
    from sievelight.functions.paths import detect_language

    df = spark.createDataFrame([("a.py",), ("b.go",), ("c.h",), ("d.txt",)], "f string")
    shown = lambda allowed: [r[0] for r in df.select(detect_language(F.col("f"), allowed)).collect()]
    assert shown([" Python", "C"]) == ["python", None, "c", None] and shown([]) == shown(None) == ["python", "go", "c", None] and shown([" "]) == [None] * 4


def test_a_scan_reads_its_files_once(spark):
    """Detectors share the text that is read, so what makes the files (a join, a listing) runs once."""
    read = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            read.add(frame.num_rows)
            yield frame

    files = spark.createDataFrame([("r", "a.js", "eval(getUserInput())"), ("r", "b.py", "hashlib.md5(x)"), ("r", "c.tf", 'acl = "public-read"')], "repo string, file string, content string")
    found = {r["id"] for r in scan_all(files.mapInArrow(count, files.schema)).collect()}
    assert {"js-eval-injection", "py-weak-crypto", "terraform-public-s3-acl"} <= found and read.value == 3
