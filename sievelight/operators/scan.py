"""One scan of a table of files by all detectors, whole or of what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.paths import is_code_file, is_text_file
from sievelight.functions.tables import written
from sievelight.operators import deps, detect, facts, taint
from sievelight.operators.findings import dedupe_findings, union_detectors
from sievelight.operators.incremental import cache_hits, cache_misses, content_hash
from sievelight.rules.defaults import default_matchers, native_matchers
from sievelight.schema import FINDING
from sievelight.sources.cache import ScanCache

#: Schemas of the tables that scan_changed keeps.
CACHED = {"findings": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in FINDING.fields), "hashes": "repo string, file string, hash string"}


def scan_files(files: DataFrame, js_rules: DataFrame | None = None, native_rules: DataFrame | None = None) -> DataFrame:
    """Findings of each of files(repo, file, content) by what the file itself says, duplicates kept.

    Text files and their call facts are written to the shared folder once for the detectors that read them, as files may
    come from a join or a listing.
    """
    spark = files.sparkSession
    js_rules = default_matchers(spark) if js_rules is None else js_rules
    native_rules = native_matchers(spark) if native_rules is None else native_rules
    files = written(files.select("repo", "file", "content").filter(is_text_file(F.col("file"))), "text-files")
    called = written(facts.extract_call_facts(files), "facts")
    return union_detectors(
        taint.taint_findings(taint.taint_js(called, js_rules), js_rules, False),
        facts.call_findings(called),
        detect.secret_findings(detect.assigned_literals(files.filter(is_code_file(F.col("file"))))),
        detect.line_patterns(files),
        detect.infra_patterns(files),
        taint.taint_findings(taint.taint_native(called, native_rules), native_rules, True),
        facts.native_findings(called, files, native_rules),
    )


def scan_dependencies(files: DataFrame, advisories: DataFrame, **how) -> DataFrame:
    """Findings of the manifests and locks among files: a repository's lock decides over its manifests, so they are read together."""
    named = F.substring_index("file", "/", -1).isin(*deps.MANIFESTS)
    # Large manifests may lie together in a file; they are dealt out to be parsed.
    manifests = files.select("repo", "file", "content").filter(named).repartition("repo", "file")
    wanted = written(deps.resolve_versions(deps.parse_manifests(manifests)), "dependencies")
    return deps.dependency_findings(deps.cve_range_join(wanted, deps.range_intervals(advisories)), **how)


def scan_all(files: DataFrame, js_rules: DataFrame | None = None, native_rules: DataFrame | None = None, *, advisories: DataFrame | None = None, others: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Findings of files by all detectors, duplicates dropped first-wins by the detectors' ranks.

    With advisories, dependencies are matched too; others are findings that come from elsewhere: tools' reports, models' replies.
    """
    found = [scan_files(files, js_rules, native_rules), *others]
    if advisories is not None:
        found.append(scan_dependencies(files, advisories))
    return dedupe_findings(union_detectors(*found))


def scan_changed(files: DataFrame, cache: ScanCache, js_rules: DataFrame | None = None, native_rules: DataFrame | None = None, *, advisories: DataFrame | None = None, others: tuple[DataFrame, ...] = (), batch: int | None = None) -> DataFrame:
    """What scan_all gives, of which only files whose content the cache does not have are scanned; cache has the tables of CACHED.

    Hashes and names alone meet the cache; content is joined back for what is to be scanned. The cache then holds these
    files' findings, and no longer those of files that are gone. Dependencies are matched anew, as advisories change while
    files do not; only manifests are read for that. A content hash says nothing of rules: other rules need another cache.
    """
    hashed = written(files.select("repo", "file", content_hash(F.col("content"), "scan").alias("hash")), "hashed")
    hashes = cache.read("hashes")
    again = written(cache_misses(hashed, hashes), "changed")
    gone = written(hashes.select("repo", "file").join(hashed, ["repo", "file"], "left_anti"), "gone")
    kept = cache.read("findings").join(cache_hits(hashed, hashes).select("repo", "file"), ["repo", "file"], "left_semi")
    new = written(scan_files(files.join(again.select("repo", "file"), ["repo", "file"], "left_semi"), js_rules, native_rules), "changed-findings")
    found = [written(kept, "kept-findings"), new, *others]
    if advisories is not None:
        found.append(scan_dependencies(files, advisories))
    cache.upsert({"findings": new, "hashes": again}, again.select("repo", "file").unionByName(gone), batch)
    return dedupe_findings(union_detectors(*found))
