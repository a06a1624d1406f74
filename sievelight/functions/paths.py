"""Which files are read, by what, and how they group: columns over a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.regex import glob_regex

#: What is scanned by default, and extensions by use.
DEFAULT_INCLUDE = ["**/*"]
DEFAULT_EXCLUDE = ["**/.git/**", "**/node_modules/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/.sievelight.json", "**/.sievelight-cache.json", "**/.sievelight/model-cache.json", "**/.sievelight/native-taint-cache.json"]
CODE_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".ico", ".svg",
    ".zip", ".gz", ".tgz", ".rar", ".7z",
    ".pdf", ".mp3", ".mp4", ".mov", ".avi", ".mkv",
    ".woff", ".woff2", ".ttf", ".otf",
    ".bin", ".exe", ".dmg", ".iso",
]
LANGUAGE_EXTENSIONS = {
    "python": [".py", ".pyw"],
    "go": [".go"],
    "java": [".java"],
    "csharp": [".cs"],
    "ruby": [".rb"],
    "php": [".php", ".phtml", ".php5", ".php7", ".phps"],
    "rust": [".rs"],
    "kotlin": [".kt", ".kts"],
    "swift": [".swift"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp", ".cc", ".cxx", ".hh", ".hxx"],
}
TOOL_EXTENSIONS = {
    "bandit": LANGUAGE_EXTENSIONS["python"],
    "gosec": LANGUAGE_EXTENSIONS["go"],
    "brakeman": LANGUAGE_EXTENSIONS["ruby"],
    "semgrep": [*(e for lang in ("java", "csharp", "php", "rust", "kotlin", "swift", "c", "cpp") for e in LANGUAGE_EXTENSIONS[lang]), ".m", ".mm"],
}


def normalize_path(path: Column, root: str) -> Column:
    """Relative to root, with forward slashes; a path outside root stays as it is."""
    slashes = F.regexp_replace(path, r"\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.regexp_replace(F.when(F.startswith(slashes, F.lit(base)), F.substr(slashes, F.lit(len(base) + 1))).otherwise(slashes), r"^(?:\./)+", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case, with its dot; empty for names without one and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def is_code_file(path: Column) -> Column:
    return extension(path).isin(CODE_EXTENSIONS)


def is_text_file(path: Column) -> Column:
    return ~extension(path).isin(BINARY_EXTENSIONS)


def is_infra_file(path: Column) -> Column:
    name = F.lower(base_name(path))
    folders = F.contains(path, F.lit("/k8s/")) | F.contains(path, F.lit("/kubernetes/")) | F.contains(path, F.lit("/helm/"))
    return name.rlike(r"^dockerfile$|\.dockerfile$|\.tf$|\.tfvars$|\.yaml$|\.yml$") | folders


def detect_language(path: Column, allowed: list[str] | None = None) -> Column:
    """The first language in the list of which the path ends in an extension; null for others, and for languages that are not allowed.

    allowed is trimmed and lower-cased; an empty list means all, and one of blanks none.
    """
    wanted = {a.strip().lower() for a in allowed} if allowed else set(LANGUAGE_EXTENSIONS)
    low = F.lower(path)
    choice = F.when(F.lit(False), F.lit(None).cast("string"))
    for lang, extensions in LANGUAGE_EXTENSIONS.items():
        fits = F.lit(False)
        for e in extensions:
            fits = fits | F.endswith(low, F.lit(e))
        choice = choice.when(fits, lang if lang in wanted else F.lit(None))
    return choice


def tools_of(path: Column, allowed: list[str] | None = None) -> Column:
    """Array of the external tools that take the file; allowed is trimmed and lower-cased, empty means all."""
    wanted = {a.strip().lower() for a in allowed or [] if a.strip()}
    last = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    named = [F.when(last.isin(ext), F.lit(tool)) for tool, ext in TOOL_EXTENSIONS.items() if not wanted or tool in wanted]
    return F.filter(F.array(*named), lambda t: t.isNotNull()) if named else F.array().cast("array<string>")


def filter_globs(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files that an include glob matches (none given: all) and no exclude glob does, themselves or by a directory above."""
    include = include or DEFAULT_INCLUDE
    exclude = DEFAULT_EXCLUDE if exclude is None else exclude
    kept = F.rlike("file", F.lit("|".join(map(glob_regex, include))))
    if exclude:
        # A directory that matches takes what is below it along.
        above = [glob_regex(g)[:-1] + "(?:/.*)?$" for g in exclude] + [glob_regex(g[:-3])[:-1] + "/.*$" for g in exclude if g.endswith("/**")]
        kept = kept & ~F.rlike("file", F.lit("|".join(above)))
    return files.filter(kept)


def target_path_filter(files: DataFrame, target: str) -> DataFrame:
    """One file, or all below one directory; `.` and the empty path mean everything."""
    target = target.strip().rstrip("/").removeprefix("./")
    if target in ("", "."):
        return files
    return files.filter((F.col("file") == target) | F.startswith("file", F.lit(target + "/")))


def module_key(path: Column, depth: int = 2) -> Column:
    """Group of a file: below src by up to depth directories, a package, an app, else the first of two directories or more, else root."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    is_file = F.contains(F.element_at(parts, -1), F.lit("."))
    dirs = F.when(is_file, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    first = F.get(dirs, F.lit(0))
    return (
        F.when((first == "src") & (F.size(dirs) > 1), F.array_join(F.slice(dirs, 1, depth + 1), "/"))
        .when(first.isin("packages", "apps") & (F.size(dirs) > 1), F.array_join(F.slice(dirs, 1, 2), "/"))
        .when(F.size(dirs) > 1, first)
        .otherwise("root")
    )


def match_listing(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The files a scan would read, by repository and path."""
    return filter_globs(files, include, exclude).select("repo", "file").orderBy("repo", "file")


def unique_dirs(files: DataFrame, limit: int = 200) -> DataFrame:
    """What is handed to a tool for each repository: its files, or the distinct directories where it has over limit files."""
    counts = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"))
    folder = F.regexp_replace(F.regexp_extract("file", "^(.*/)?[^/]*$", 1), "/$", "")
    target = F.when(F.col("n_files") > limit, F.when(folder == "", ".").otherwise(folder)).otherwise(F.col("file"))
    return files.join(counts, "repo").select("repo", target.alias("target")).distinct()
