"""Version order and ranges of both ecosystems, with intervals written by hand."""

import pytest
from pyspark.sql import functions as F

from sievelight.operators import deps

#: In order, each below the next; those in one row are equal.
PYPI = [["1.0.dev1"], ["1.0a1.dev2"], ["1.0a1", "1.0.alpha-1"], ["1.0b2"], ["1.0rc1", "1.0c1", "1.0-RC.1"], ["1.0", "1", "v1.0.0", "1.0.0.0"], ["1.0+abc"], ["1.0+5"], ["1.0.post1.dev3"], ["1.0.post1", "1.0-1"], ["1.0.1"], ["1.0.1.2"], ["1.1.dev0"], ["1.9"], ["1.10"], ["2"], ["1!0.5"]]
NPM = [["1.0.0-alpha"], ["1.0.0-alpha.1"], ["1.0.0-beta"], ["1.0.0-beta.2"], ["1.0.0-beta.11"], ["1.0.0", "v1.0.0", "1.0.0+build"], ["1.0.1"], ["1.10.0"]]

#: (ecosystem, range, versions inside, versions outside)
RANGES = [
    ("pypi", "<1.0", ["0.9", "1.0rc1", "0.9.post1"], ["1.0", "1.0.post1", "1.0+local"]),
    ("pypi", ">=1.0", ["1.0", "1.0.post1", "1.0+x", "1!0"], ["1.0rc1", "0.9"]),
    ("pypi", ">1.0", ["1.0.1", "1.1"], ["1.0", "1.0.post1", "1.0+x"]),
    ("pypi", ">1.0.post1", ["1.0.post2", "1.0.1"], ["1.0.post1", "1.0.post1+x", "1.0"]),
    ("pypi", "<=1.0", ["1.0", "1.0+x", "0.1"], ["1.0.post1", "1.0.1"]),
    ("pypi", "==1.0", ["1", "1.0.0", "1.0+x"], ["1.0.post1", "1.0.1", "1.0rc1"]),
    ("pypi", "==1.4.*", ["1.4", "1.4.9", "1.4rc1", "1.4.post1"], ["1.5", "1.3.9", "1.5.dev1"]),
    ("pypi", "~=1.4", ["1.4", "1.9", "1.4.post1"], ["2.0", "1.3", "2.0rc1"]),
    ("pypi", "~=1.4.2", ["1.4.2", "1.4.9"], ["1.5", "1.4.1"]),
    ("pypi", ">=1.0,!=1.5,<2.0", ["1.0", "1.4", "1.5.1", "1.6"], ["1.5", "1.5.0", "1.5+x", "2.0"]),
    ("pypi", "!=1.4.*,!=1.4.2,!=2.0", ["1.3", "1.5", "2.0.1"], ["1.4", "1.4.2", "1.4.3", "2.0"]),
    ("pypi", "1.2 || >=1!0", ["1.2", "1!3"], ["1.2.1", "9"]),
    ("npm", "!=1.0.0", ["1.1.0", "0.9.0", "1.0.0-rc1"], ["1.0.0"]),
    ("npm", ">=1.0.0 !=1.2.x <2.0.0", ["1.0.0", "1.1.9", "1.3.0"], ["1.2.0", "1.2.9", "2.0.0"]),
    ("npm", "!=1.0.0 !=1.0.0 || 1.0.0", ["1.0.0", "2.0.0"], []),
    ("npm", ">=2.0.0 !=2.0.0 <=2.0.0", [], ["2.0.0"]),
    ("npm", "~>1.2.3", ["1.2.9"], ["1.3.0"]),
]


@pytest.mark.parametrize("ecosystem, rows", [("pypi", PYPI), ("npm", NPM)])
def test_order(spark, ecosystem, rows):
    versions = [(i, v) for i, row in enumerate(rows) for v in row]
    df = spark.createDataFrame(versions, "place int, version string").withColumn("k", deps.version_key(F.col("version"), F.lit(ecosystem)))
    pairs = df.alias("a").join(df.alias("b")).select("a.version", "b.version", "a.place", "b.place", F.expr("case when a.k < b.k then -1 when a.k = b.k then 0 else 1 end").alias("got")).collect()
    wrong = [tuple(r) for r in pairs if r["got"] != (r[2] > r[3]) - (r[2] < r[3])]
    assert not wrong


def test_no_versions(spark):
    df = spark.createDataFrame([("x",), ("",), (None,), ("1.0-l",), ("1..2",)], "version string")
    assert df.filter(deps.version_key(F.col("version"), F.lit("pypi")).isNotNull()).count() == 0


def inside(spark, rows, **how):
    advisories = spark.createDataFrame([(f"A{i}", f"p{i}", e, r) for i, (e, r, _, _) in enumerate(rows)], "id string, package string, ecosystem string, affectedRange string")
    versions = spark.createDataFrame([(e, f"p{i}", v) for i, (e, _, yes, no) in enumerate(rows) for v in [*yes, *no]], "ecosystem string, name string, version string")
    return {(int(r["name"][1:]), r["version"]) for r in deps.cve_range_join(versions, deps.range_intervals(advisories), **how).collect()}


def test_ranges(spark):
    assert inside(spark, RANGES) == {(i, v) for i, (_, _, yes, _) in enumerate(RANGES) for v in yes}


def test_pre_releases_by_the_managers_rule(spark):
    rows = [("npm", "<2.0.0", ["1.9.0"], ["2.0.0-rc1", "1.0.0-a"]), ("npm", ">=1.0.0-a <2.0.0", ["1.0.0-b", "1.5.0"], ["1.5.0-b", "2.0.0-a"]), ("pypi", "<1.0", ["0.9", "0.9.post1"], ["1.0rc1", "0.9rc1"]), ("pypi", ">=1.0rc1", ["1.0rc2", "1.0", "1.1"], ["1.1rc1"])]
    assert inside(spark, rows, named_only=True) == {(i, v) for i, (_, _, yes, _) in enumerate(rows) for v in yes}


def test_intervals_by_hand(spark):
    df = spark.createDataFrame([("A", "p", "pypi", ">=1.0,!=1.5.*,<2.0")], "id string, package string, ecosystem string, affectedRange string")
    got = sorted((r["lo"]["minor"], r["lo"]["is_release"], r["lo_inc"], r["hi"]["major"], r["hi"]["minor"], r["hi"]["is_release"], r["hi_inc"]) for r in deps.range_intervals(df).collect())
    assert got == [(0, 1, True, 1, 5, 0, False), (6, 0, True, 2, 0, 1, False)]
