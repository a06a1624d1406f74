"""Dependencies of repositories, advisories about them, and the join on version ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.functions.tables import by_distinct, small
from sievelight.schema import RANKS, as_findings

PRE = "array<struct<word:int,number:bigint,text:string>>"

_SEMVER = r"^[vV=\s]*([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:\.[0-9]+)*(?:[-.]?([A-Za-z][0-9A-Za-z.-]*|-[0-9A-Za-z.-]+))?"
#: Epoch, release, pre-release letter and number, post-release (by a hyphen or a word), dev release, local version.
_PYPI = r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|rc|c)[-_.]?([0-9]*))?(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
#: Above every number of a post-release, and the part that stands above all local versions.
_LAST = 1 << 62


def _key(epoch: Column, release: list[Column], more: Column, is_release: Column, pre: Column) -> Column:
    named = zip(("major", "minor", "patch"), release)
    return F.struct(epoch.cast("long").alias("epoch"), *[c.cast("long").alias(k) for k, c in named], more.cast("array<bigint>").alias("more"), is_release.cast("int").alias("is_release"), pre.cast(PRE).alias("pre"))


def _part(word: Column, number: Column, text: Column | None = None) -> Column:
    return F.struct(word.cast("int").alias("word"), number.cast("long").alias("number"), (F.lit("") if text is None else text).alias("text"))


def _number(x: Column) -> Column:
    return F.when(F.rlike(x, F.lit("^[0-9]{1,18}$")), x.try_cast("long"))


def _semver_key(version: Column) -> Column:
    plain = F.substring_index(F.trim(version), "+", 1)
    part = lambda i: F.coalesce(F.regexp_extract(plain, _SEMVER, i).try_cast("long"), F.lit(0))
    pre = F.regexp_replace(F.regexp_extract(plain, _SEMVER, 4), "^-", "")
    parts = F.transform(F.filter(F.split(pre, r"\."), lambda x: x != ""), lambda x: _part(_number(x).isNull(), F.coalesce(_number(x), F.lit(0)), F.when(_number(x).isNull(), x).otherwise("")))
    key = _key(F.lit(0), [part(1), part(2), part(3)], F.array(), F.when(pre == "", 1).otherwise(0), parts)
    return F.when(F.rlike(plain, F.lit(r"^[vV=\s]*[0-9]")), key)


def _pypi_key(version: Column) -> Column:
    low = F.lower(F.trim(version))
    group = lambda i: F.regexp_extract(low, _PYPI, i)
    number = lambda i: F.coalesce(_number(group(i)), F.lit(0))
    release = F.transform(F.split(group(2), r"\."), lambda x: F.coalesce(_number(x), F.lit(0)))
    at = lambda i: F.coalesce(F.get(release, F.lit(i)), F.lit(0))
    beyond = F.slice(release, 4, F.greatest(F.size(release), F.lit(1)))
    kept = F.coalesce(F.array_max(F.transform(beyond, lambda x, i: F.when(x != 0, i + 1).otherwise(0))), F.lit(0))
    has_post, has_dev, letter = (group(5) != "") | (group(6) != ""), group(8) != "", group(3)
    stage = F.when(letter.isin("a", "alpha"), 1).when(letter.isin("b", "beta"), 2).when(letter != "", 3).when(has_dev & ~has_post, 0).otherwise(4)
    post = F.when(group(5) != "", number(5)).when(group(6) != "", number(7)).otherwise(-1)
    local = F.transform(F.filter(F.split(group(10), "[-_.]"), lambda x: x != ""), lambda x: _part(_number(x).isNotNull(), F.coalesce(_number(x), F.lit(0)), F.when(_number(x).isNull(), x).otherwise("")))
    tail = F.concat(F.array(_part(stage, number(4)), _part(F.lit(0), post), _part((~has_dev), number(9))), local)
    return F.when(F.rlike(low, F.lit(_PYPI)), _key(number(1), [at(0), at(1), at(2)], F.slice(beyond, 1, kept), F.when(stage == 4, 1).otherwise(0), tail))


def version_key(version: Column, ecosystem: Column | None = None) -> Column:
    """epoch, major, minor, patch, more, is_release (1 above 0), pre: structs that compare in the version order of the ecosystem.

    pypi: an epoch; release parts of any number, zeros at the end aside; dev, alpha, beta and candidate releases before the
    release, post-releases after it, a dev release before what it leads to, local versions after what they are made from.
    Others (and where no ecosystem is given): of pre-release parts, numbers compare as numbers and stand before words, and
    fewer parts before more; missing parts of a version count as 0 and build metadata is dropped. Text that is no version
    gives null.
    """
    return _semver_key(version) if ecosystem is None else F.when(ecosystem == "pypi", _pypi_key(version)).otherwise(_semver_key(version))


def _bumped(key: Column, level: Column) -> Column:
    """The place before all versions of the next major (0), minor (1) or patch (2) after key."""
    major = F.when(level == 0, key["major"] + 1).otherwise(key["major"])
    minor = F.when(level == 0, F.lit(0)).when(level == 1, key["minor"] + 1).otherwise(key["minor"])
    patch = F.when(level <= 1, F.lit(0)).otherwise(key["patch"] + 1)
    return _key(key["epoch"], [major, minor, patch], F.array(), F.lit(0), F.array())


def _before_all(key: Column) -> Column:
    """The place before all pre-releases of a version."""
    return key.withField("is_release", F.lit(0)).withField("pre", F.array().cast(PRE))


def _with_locals(key: Column) -> Column:
    """The place after all local versions of a version."""
    return key.withField("pre", F.concat(key["pre"], F.array(_part(F.lit(2), F.lit(0)))))


def _after_posts(key: Column) -> Column:
    """The place after all post-releases of a version that is none itself."""
    return F.when(F.get(key["pre"], F.lit(1))["number"] >= 0, _with_locals(key)).otherwise(key.withField("pre", F.array(key["pre"][0], _part(F.lit(0), F.lit(_LAST)))))


#: Names of the files that parse_manifests reads.
MANIFESTS = ("package.json", "package-lock.json", "requirements.txt")

_OPERATORS = r"===?|!==?|>=|<=|~=|~>?|>|<|=|\^|"


def _semver_bounds(t: Column) -> Column:
    v, partial = t["v"], (t["parts"] < 3) | t["star"]
    caret = _bumped(v, F.when((v["major"] > 0) | (t["parts"] < 2), 0).when((v["minor"] > 0) | partial, 1).otherwise(2))
    after = _bumped(v, t["parts"] - 1)
    tilde = _bumped(v, F.when(t["parts"] < 2, 0).otherwise(1))
    exact = t["op"].isin("", "=", "==", "===", "!=")
    low = F.when((t["op"] == ">") & partial, after.withField("is_release", F.lit(1))).when(t["op"].isin(">", ">=", "^", "~", "~=") | exact, v)
    high = F.when((exact | (t["op"] == "<=")) & partial, after).when(t["op"].isin("<", "<=") | exact, v).when(t["op"] == "^", caret).when(t["op"].isin("~", "~="), tilde)
    return F.struct(low.alias("lo"), ((t["op"] != ">") | partial).alias("lo_inc"), high.alias("hi"), ((exact | (t["op"] == "<=")) & ~partial).alias("hi_inc"))


def _pypi_bounds(t: Column) -> Column:
    v, op = t["v"], t["op"]
    exact = op.isin("", "=", "==", "===", "!=")
    low = F.when(exact & t["star"], _before_all(v)).when(op == ">", _after_posts(v)).when(op.isin(">=", "~=") | exact, v)
    high = F.when(exact & t["star"], _bumped(v, t["parts"] - 1)).when(exact | (op == "<="), _with_locals(v)).when(op == "<", v).when((op == "~=") & (t["parts"] > 1), _bumped(v, F.least(t["parts"], F.lit(4)) - 2))
    return F.struct(low.alias("lo"), (op != ">").alias("lo_inc"), high.alias("hi"), ((exact & ~t["star"]) | (op == "<=")).alias("hi_inc"))


def range_intervals(advisories: DataFrame) -> DataFrame:
    """Rows lo, lo_inc, hi, hi_inc (null bound: open) for each alternative of affectedRange, and named.

    Alternatives are split at ||; comparators inside one, parted by spaces or commas, are joined: `>=a <b`, `a - b`, `^`,
    `~`, `=`, a bare version, `*`. What `!=` excludes is cut out of an alternative, which then gives one row for
    each interval that is left. Versions may be partial or end in x or *: `1.2` and `1.2.x` are all of 1.2, `>1` begins at
    2.0.0, `<=1.2` ends before 1.3.0. For pypi a version is itself unless it ends in `.*`, with its local versions; `>1.0`
    has no post-releases of 1.0; `~=1.4` is `>=1.4` and below 2. Versions are in the order of the advisory's ecosystem.
    Pre-releases lie in an interval by their order alone: 2.0.0-rc1 is in `<2.0.0`, as it lacks what 2.0.0 mends. named
    lists the releases of which an alternative's comparators name a pre-release, for those who want the
    package managers' rule (see cve_range_join). Ranges that many advisories share are read once.
    """
    return by_distinct(advisories, [c for c in ("ecosystem", "affectedRange") if c in advisories.columns], _intervals)


def _intervals(advisories: DataFrame) -> DataFrame:
    is_pypi = F.col("ecosystem") == "pypi" if "ecosystem" in advisories.columns else F.lit(False)
    parts = advisories.select("*", F.explode(F.split("affectedRange", r"\|\|")).alias("_alt"))
    hyphens = F.regexp_replace("_alt", r"(\S+)\s+-\s+(\S+)", ">=$1 <=$2")
    found = F.regexp_extract_all(hyphens, F.lit(rf"({_OPERATORS})\s*[vV]?([0-9*xX](?:[0-9A-Za-z.*+_-]|!(?!=))*)"), F.lit(0))
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"^[!>=<^~\sv]+", ""), r"\.[xX*].*$", "")
    given = lambda t: F.size(F.split(F.regexp_extract(F.regexp_replace(bare(t), "^[0-9]+!", ""), r"^[0-9]+(?:\.[0-9]+)*", 0), r"\."))
    operator = lambda t: F.regexp_replace(F.regexp_extract(t, rf"^({_OPERATORS})", 1), "^!==$|^~>$", "!=")
    tokens = F.transform(found, lambda t: F.struct(F.when(F.startswith(t, F.lit("~>")), "~").otherwise(operator(t)).alias("op"), F.when(is_pypi, _pypi_key(bare(t))).otherwise(_semver_key(bare(t))).alias("v"), F.least(given(t), F.when(is_pypi, 9).otherwise(3)).alias("parts"), F.rlike(t, F.lit(r"\.[xX*]")).alias("star")))
    rows = parts.withColumn("_tokens", F.filter(tokens, lambda t: t["v"].isNotNull()))
    bounds = lambda t: F.when(is_pypi & ~t["op"].isin("^", "~"), _pypi_bounds(t)).otherwise(_semver_bounds(t))
    rows = rows.withColumn("_b", F.transform(F.filter("_tokens", lambda t: t["op"] != "!="), bounds))
    out = F.transform(F.filter("_tokens", lambda t: t["op"] == "!="), bounds)
    rows = rows.withColumn("_out", F.array_sort(F.transform(out, lambda b: F.struct(b["lo"].alias("lo"), F.struct(b["hi"].alias("v"), b["hi_inc"].alias("x")).alias("hi")))))
    # Between two exclusions a gap begins at the furthest end of those before it, and ends where the next one begins.
    gap = lambda i: F.struct(F.array_max(F.transform(F.slice("_out", F.lit(1), i), lambda o: o["hi"])).alias("from"), F.get(F.col("_out"), i)["lo"].alias("to"))
    rows = rows.withColumn("_gap", F.explode(F.transform(F.sequence(F.lit(0), F.size("_out")), gap)))
    # The tightest bounds hold: an exclusive one is tighter than an inclusive one at the same version.
    lows = F.transform(F.filter("_b", lambda b: b["lo"].isNotNull()), lambda b: F.struct(b["lo"].alias("v"), (~b["lo_inc"]).alias("x")))
    highs = F.transform(F.filter("_b", lambda b: b["hi"].isNotNull()), lambda b: F.struct(b["hi"].alias("v"), b["hi_inc"].alias("x")))
    ends = F.when(F.col("_gap.to").isNotNull(), F.struct(F.col("_gap.to").alias("v"), F.lit(False).alias("x")))
    usable = (F.size("_tokens") > 0) | F.rlike(F.trim(F.col("_alt")), F.lit(r"^[*xX]?$"))
    cut = rows.filter(usable).withColumn("_lo", F.array_max(F.concat(lows, F.array_compact(F.array("_gap.from"))))).withColumn("_hi", F.array_min(F.concat(highs, F.array_compact(F.array(ends)))))
    whole = F.col("_lo").isNull() | F.col("_hi").isNull() | (F.col("_lo.v") < F.col("_hi.v")) | ((F.col("_lo.v") == F.col("_hi.v")) & ~F.col("_lo.x") & F.col("_hi.x"))
    release = lambda v: F.struct(v["epoch"].alias("epoch"), v["major"].alias("major"), v["minor"].alias("minor"), v["patch"].alias("patch"))
    named = F.transform(F.filter("_tokens", lambda t: t["v"]["is_release"] == 0), lambda t: release(t["v"]))
    # An alternative that excludes nothing keeps its one row even where its bounds leave nothing.
    return cut.filter((F.size("_out") == 0) | whole).select(*advisories.columns, F.col("_lo.v").alias("lo"), F.coalesce(~F.col("_lo.x"), F.lit(True)).alias("lo_inc"), F.col("_hi.v").alias("hi"), F.coalesce("_hi.x", F.lit(False)).alias("hi_inc"), named.alias("named"))


def parse_manifests(files: DataFrame) -> DataFrame:
    """Dependency rows (repo, source, ecosystem, name, version, spec, kind) of package.json, package-lock.json and requirements.txt.

    kind is manifest or lock. The lock's root entry is skipped; a nested path names what follows its last
    node_modules/. Lines of requirements that name no package are skipped. Broken JSON gives no rows. The files are read once.
    """
    base = F.substring_index("file", "/", -1)
    none = F.lit(None).cast("string")
    row = lambda eco, name, version, spec, kind: F.struct(F.lit(eco).alias("ecosystem"), name.alias("name"), version.alias("version"), spec.alias("spec"), F.lit(kind).alias("kind"))
    plain = F.map_entries(F.from_json("content", "struct<dependencies:map<string,string>>")["dependencies"])
    plain = F.transform(plain, lambda e: row("npm", e["key"], none, e["value"], "manifest"))
    locked = F.map_entries(F.from_json("content", "struct<packages:map<string,struct<version:string>>>")["packages"])
    locked = F.transform(F.filter(locked, lambda e: e["key"] != ""), lambda e: row("npm", F.regexp_extract(e["key"], r"^(?:.*node_modules/)?(.+)$", 1), e["value"]["version"], none, "lock"))
    lines = F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s*(#|;).*$", "")))
    lines = F.filter(lines, lambda x: F.rlike(x, F.lit("^[A-Za-z0-9]")))
    spec = lambda x: F.trim(F.regexp_extract(x, r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?\s*(.*)$", 1))
    pins = F.transform(lines, lambda x: row("pypi", F.lower(F.regexp_extract(x, r"^([A-Za-z0-9._-]+)", 1)), F.nullif(F.regexp_extract(spec(x), r"^==\s*([^,\s]+)$", 1), F.lit("")), F.nullif(spec(x), F.lit("")), "manifest"))
    found = F.when(base == "package.json", plain).when(base == "package-lock.json", locked).when(base == "requirements.txt", pins)
    return files.select("repo", F.col("file").alias("source"), F.inline(found))


def resolve_versions(dependencies: DataFrame) -> DataFrame:
    """Manifest rows with the version that the lock has for them; version falls back to the spec's lower bound for matching.

    reported is what a finding shows (lock's version, else the pin, else the spec). Of several locked versions of a (repo,
    ecosystem, name) the greatest counts; only where there are several are they compared.
    """
    same = Window.partitionBy("repo", "ecosystem", "name")
    named = F.col("repo").isNotNull() & F.col("ecosystem").isNotNull() & F.col("name").isNotNull()
    rows = dependencies.withColumn("_locks", F.collect_set(F.when((F.col("kind") == "lock") & named, F.col("version"))).over(same)).filter("kind = 'manifest'")
    greatest = F.array_max(F.transform("_locks", lambda v: F.struct(version_key(v, F.col("ecosystem")).alias("k"), v.alias("v"))))["v"]
    locked = F.when(F.size("_locks") < 2, F.get("_locks", F.lit(0))).otherwise(greatest)
    lower = F.nullif(F.regexp_extract(F.coalesce("spec", F.lit("")), r"([0-9][0-9A-Za-z.+-]*)", 1), F.lit(""))
    return rows.withColumn("_locked", locked).select("repo", "source", "ecosystem", "name", "spec", F.coalesce("_locked", "version", lower).alias("version"), F.coalesce("_locked", "version", "spec").alias("reported"))


def cve_range_join(dependencies: DataFrame, intervals: DataFrame, *, advisory_columns: list[str] | None = None, named_only: bool = False) -> DataFrame:
    """Dependencies (ecosystem, name, version, ...) with each advisory whose range holds their version, once an advisory.

    Keys are made of distinct versions where these are few, as fleets repeat them. An advisory's intervals are one row, so it
    meets a dependency once, and the dependencies move once: beside equi keys on (ecosystem, name), where Spark splits
    skewed packages, or not at all if the advisories' counted bytes are few enough to broadcast. With named_only a
    pre-release is in a range only if the range names a pre-release of the same release, as package managers have it;
    else by its order.
    """
    keyed = by_distinct(dependencies, ["ecosystem", "version"], lambda d: d.withColumn("v", version_key(F.col("version"), F.col("ecosystem")))).filter("v is not null")
    inner = ("package", "ecosystem", "affectedRange", "lo", "lo_inc", "hi", "hi_inc", "named")
    columns = advisory_columns or [c for c in intervals.columns if c not in inner]
    more = [c for c in columns if c != "id"]
    rows = intervals.select(F.col("ecosystem").alias("_eco"), F.col("package").alias("_name"), "id", F.struct(*more).alias("_more"), F.struct("lo", "lo_inc", "hi", "hi_inc", "named").alias("_at"))
    side = small(rows.groupBy("_eco", "_name", "id").agg(F.min("_more").alias("_more"), F.collect_list("_at").alias("_ranges")))
    v = F.col("v")

    def inside(r: Column) -> Column:
        after = r["lo"].isNull() | (v > r["lo"]) | (r["lo_inc"] & (v == r["lo"]))
        before = r["hi"].isNull() | (v < r["hi"]) | (r["hi_inc"] & (v == r["hi"]))
        named = (v["is_release"] == 1) | F.array_contains(r["named"], F.struct(*[v[k].alias(k) for k in ("epoch", "major", "minor", "patch")]))
        return after & before & named if named_only else after & before

    hit = keyed.join(side, (F.col("ecosystem") == F.col("_eco")) & (F.col("name") == F.col("_name")) & F.exists("_ranges", inside))
    return hit.select(*dependencies.columns, *[F.col("id") if c == "id" else F.col(f"_more.{c}") for c in columns])


def risk_score(cvss: Column, severity: Column, exploitability: Column, privilege: Column, sensitivity: Column) -> Column:
    """0 to 100: ten times the CVSS score, or a base for the severity, adjusted by how easy and how grave."""
    base = F.coalesce(cvss * 10, F.when(severity == "low", 20.0).when(severity == "medium", 45.0).when(severity == "high", 75.0).when(severity == "critical", 95.0), F.lit(45.0))
    step = lambda c, up, down, by: F.when(c == up, by).when(c == down, -by).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), base + step(exploitability, "high", "low", 10) + step(privilege, "none", "high", 5) + step(sensitivity, "high", "low", 10)))


def risk_severity(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def simulate_payload(name: Column, version: Column, severity: Column) -> Column:
    """What an attempt against the dependency would look like, as text; nothing is run."""
    impact = F.when(severity.isin("critical", "high"), "May allow code execution or data exposure.").otherwise("May degrade availability or leak limited data.")
    return F.struct(F.concat(F.lit("Crafted input reaching "), name, F.lit("@"), F.coalesce(version, F.lit("unknown"))).alias("payload"), impact.alias("impact"))


def dependency_findings(matched: DataFrame, *, sensitivity: str = "medium", simulate: bool = False) -> DataFrame:
    """Findings of cve_range_join's rows, with risk and recommendation."""
    score = F.round(risk_score(F.col("cvssScore"), F.col("severity"), F.col("exploitability"), F.col("privilegeRequired"), F.lit(sensitivity)), 1)
    rows = matched.withColumn("riskScore", score).withColumn("risk", risk_severity(F.col("riskScore")))
    advice = F.when(F.col("fixedVersion").isNotNull(), F.concat(F.lit("Upgrade "), "name", F.lit(" to "), "fixedVersion", F.lit(" or later."))).otherwise(F.concat(F.lit("No fixed version of "), "name", F.lit(" is known; consider a replacement.")))
    found = rows.select(
        "repo", F.col("source").alias("file"), "id", F.col("risk").alias("severity"), F.concat(F.lit("Dependency "), "name", F.lit(" vulnerable")).alias("title"),
        F.coalesce("description", F.concat(F.lit("Vulnerability in "), "name")).alias("description"), F.lit("dependency").alias("category"), F.col("name").alias("packageName"),
        F.coalesce("reported", "version").alias("packageVersion"), F.col("id").alias("cveId"), "riskScore", advice.alias("recommendation"),
        (simulate_payload(F.col("name"), F.col("version"), F.col("risk")) if simulate else F.lit(None)).alias("simulation"),
        F.lit(RANKS["dependency"]).alias("detector_rank"), F.pmod(F.xxhash64("name", "reported", "id"), F.lit(1 << 40)).alias("seq"),
    )
    return as_findings(found)
