"""What goes to a model: chunks, batches, budgets, prompts and context. The model itself is not called here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.functions.paths import module_key

#: Sizes and limits by default.
MAX_CHARS, CHARS_PER_TOKEN, TOKEN_LIMIT, BATCH_FILES, MODULE_DEPTH = 4000, 4, 50_000, 25, 2

INSTRUCTION = "Look for security weaknesses in the part of a source file below. Answer with one JSON object and nothing around it."
SCHEMA_LINE = "The object has a list `findings`; each has id, severity (low, medium, high or critical), title, description, file and line."


def estimate_tokens(content: Column) -> Column:
    return F.ceil(F.length(content) / CHARS_PER_TOKEN).cast("long")


def token_budget(files: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """repo, tokens, refused: whether a repository's files are over the limit. Partial sums make skew harmless."""
    return files.groupBy("repo").agg(F.sum(estimate_tokens(F.col("content"))).alias("tokens")).withColumn("refused", F.col("tokens") > limit)


def module_sizes(files: DataFrame, depth: int = MODULE_DEPTH) -> DataFrame:
    return files.groupBy("repo", module_key(F.col("file"), depth).alias("module")).agg(F.count(F.lit(1)).alias("n_files"))


def file_batches(files: DataFrame, size: int = BATCH_FILES, depth: int = MODULE_DEPTH) -> DataFrame:
    """repo, module, batch_no (from 0), files: consecutive batches inside each module, by path. Only paths are shuffled."""
    rows = files.select("repo", module_key(F.col("file"), depth).alias("module"), "file")
    place = F.row_number().over(Window.partitionBy("repo", "module").orderBy("file")) - 1
    return rows.withColumn("batch_no", F.floor(place / size).cast("int")).groupBy("repo", "module", "batch_no").agg(F.array_sort(F.collect_list("file")).alias("files"))


def chunk_text(content: Column, max_chars: int = MAX_CHARS) -> Column:
    """Slices of at most max_chars; a short or empty text is one slice."""
    n = F.greatest(F.lit(1), F.ceil(F.length(content) / max_chars)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(content, i * max_chars + 1, F.lit(max_chars)))


def chunks(files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """repo, file, chunk_no (from 1), n_chunks, chunk."""
    rows = files.select("repo", "file", chunk_text(F.col("content"), max_chars).alias("c"))
    return rows.select("repo", "file", F.size("c").alias("n_chunks"), F.posexplode("c").alias("p", "chunk")).select("repo", "file", (F.col("p") + 1).alias("chunk_no"), "n_chunks", "chunk")


def _boundaries(code: str) -> list[str]:
    """Statements at brace depth 0. Strings and comments do not count; a statement ends at `;`, a closing brace, or a blank line."""
    out, start, depth, i, n = [], 0, 0, 0, len(code)
    while i < n:
        c = code[i]
        if c in "\"'`":
            i += 1
            while i < n and code[i] != c and (c == "`" or code[i] != "\n"):
                i += 2 if code[i] == "\\" else 1
        elif code.startswith("//", i):
            end = code.find("\n", i)
            i = n if end < 0 else end
            continue
        elif code.startswith("/*", i):
            end = code.find("*/", i)
            i = n if end < 0 else end + 1
        elif c in "{([":
            depth += 1
        elif c in "})]":
            depth = max(0, depth - 1)
        ends = depth == 0 and (c == ";" or (c == "}" and code[i + 1 : i + 2] not in (";", ",", ")", ".")) or code.startswith("\n\n", i))
        if ends and i < n:
            out.append(code[start : i + 1])
            start = i + 1
        i += 1
    out.append(code[start:])
    return [s.strip() for s in out if s.strip()]


def chunk_code(files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """repo, file, chunk_no (from 1), n_chunks, chunk: one chunk a top-level statement or function, long ones sliced.

    Boundaries are lexical. Text without a statement is chunked as text. Nothing is shuffled.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for repo, file, content in frame.itertuples(index=False):
                content = content or ""
                parts = [p[i : i + max_chars] for p in _boundaries(content) or [content] for i in range(0, max(1, len(p)), max_chars)]
                rows += [(repo, file, no + 1, len(parts), p) for no, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["repo", "file", "chunk_no", "n_chunks", "chunk"])

    return files.select("repo", "file", "content").mapInPandas(batches, "repo string, file string, chunk_no int, n_chunks int, chunk string")


def build_prompts(chunked: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """repo, file, chunk_no, prompt; context(repo, context) adds a summary block where it is not blank."""
    rows = chunked if context is None else chunked.join(context.select("repo", "context"), "repo", "left")
    summary = F.lit(None).cast("string") if context is None else F.when(F.trim("context") != "", F.concat(F.lit("Context Summary:\n"), F.trim("context"), F.lit("\n")))
    lines = F.array(
        F.lit(INSTRUCTION), F.lit(""),
        summary, F.lit("Schema:"), F.lit(SCHEMA_LINE), F.lit(""),
        F.concat(F.lit("File "), "file", F.lit(", chunk "), F.col("chunk_no").cast("string"), F.lit("/"), F.col("n_chunks").cast("string"), F.lit(":")), F.col("chunk"),
    )
    return rows.select("repo", "file", "chunk_no", F.array_join(lines, "\n").alias("prompt"))


def repo_context(files: DataFrame, readme_lines: int = 12, entries: int = 30, unlisted: tuple[str, ...] = ()) -> DataFrame:
    """repo, context: the first lines of README.md that are not blank, package.json's name, version and description, and top-level entries.

    Files named in unlisted are read, and neither listed nor counted among the entries.
    """
    readme = F.array_join(F.slice(F.filter(F.split("content", r"\r?\n"), lambda x: F.trim(x) != ""), 1, readme_lines), "\n")
    about = F.from_json("content", "struct<name:string,version:string,description:string>")
    package = F.when(F.try_parse_json("content").isNull(), "(unreadable)").otherwise(F.concat_ws(" | ", F.nullif(about["name"], F.lit("")), F.nullif(about["version"], F.lit("")), F.nullif(about["description"], F.lit(""))))
    one = files.filter(F.col("file").isin("README.md", "package.json")).groupBy("repo").agg(
        F.max(F.when((F.col("file") == "README.md") & (F.col("content") != ""), F.concat(F.lit("README:\n"), readme))).alias("readme"),
        F.max(F.when((F.col("file") == "package.json") & (F.col("content") != ""), F.concat(F.lit("package.json: "), package))).alias("package"),
    )
    first = F.regexp_extract("file", "^[^/]+", 0)
    top = files.filter(~F.col("file").isin(*unlisted)).select("repo", F.concat(first, F.when(F.contains("file", F.lit("/")), "/").otherwise("")).alias("entry")).filter(~first.isin(".git", "node_modules", "dist", "build", "coverage")).distinct()
    listed = top.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("entry"))).filter(F.col("n") <= entries)
    listed = listed.groupBy("repo").agg(F.concat(F.lit("Top-level: "), F.array_join(F.array_sort(F.collect_list("entry")), ", ")).alias("top"))
    return listed.join(one, "repo", "full_outer").select("repo", F.concat_ws("\n", "readme", "package", "top").alias("context"))
