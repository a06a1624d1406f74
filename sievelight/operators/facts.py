"""Call facts of source files, rule matching on callee names, and code graphs.

Facts come from a lexical extractor; facts from a real parser can take their place in all other functions.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.functions.paths import detect_language, is_code_file
from sievelight.functions.tables import BROADCAST_BYTES, small
from sievelight.schema import RANKS, as_findings

#: refs and calls of an expression, without what is inside the arguments of its calls: these are facts of their own.
EXPR = "struct<refs:array<string>,calls:array<string>>"
#: within is the pos of the call or assignment whose argument (within_arg) or right side holds a call, root that of the outermost one (its own if none).
FACTS = f"repo string, file string, lang string, scope_id int, pos int, line int, `column` int, kind string, name string, args array<{EXPR}>, arg0 string, own_scope_id int, params array<string>, is_async boolean, func_kind string, within int, within_arg int, root int"
#: Facts of a file that travel together, and the kinds of their columns.
BATCH = 10_000
_ARROW = [*[pa.string()] * 3, *[pa.int32()] * 4, *[pa.string()] * 2, pa.list_(pa.struct([("refs", pa.list_(pa.string())), ("calls", pa.list_(pa.string()))])), pa.string(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.string(), *[pa.int32()] * 3]
COLUMNS = [f.strip().split(" ")[0].strip("`") for f in FACTS.replace(EXPR, "").split(",")]

_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*+"
_DOTTED = rf"{_NAME}(?:(?:\.|->|::|\?\.){_NAME})*+"
_TOKEN = re.compile(rf"({_DOTTED})|=>|[()\[\]{{}};,\n]")
_CALLED, _BLANK, _LITERAL = re.compile(r"!?\s*+\("), re.compile(r"\s*+"), re.compile(r"\s*+([\"'`])(\s*+)\1\s*+(?:[,)]|\Z)")
_LINE = re.compile(r"\n([ \t]*+)(?=[^\s])")
_ASSIGN = re.compile(rf"^\s*(?:(?:export|const|let|var|val|final|auto|static|my|mut|public|private)\s+)*(?:[A-Za-z_][\w<>\[\],.*&]*\s+[*&]?)?({_DOTTED})\s*(?::[^=;(){{}}]+)?(?::=|[+\-*/|.]?=)(?![=>])")
_KEYWORD = re.compile(r"(?<![\w$.])(?:(async)\s++)?(function\*?|def|func|fun|fn|sub)(?![\w$])")
_HEAD = re.compile(rf"\s*+(?:\([^()]*+\)\s*+)?({_NAME})?\s*+\(")
_PARAMETER = re.compile(r"\s*+([^:=,()]*+)")
_WORDS = frozenset("if for while switch return catch function def func fun fn sub new await async const let var val in of else elif and or not typeof throw yield import from class public private static final true false null None True False nil self this void int".split())
_IMPORT = re.compile(r"""^\s*(?:import\s+(?:[^'"\n;]*?\sfrom\s+)?['"]([^'"]+)['"]|(?:const|let|var)?[^=\n;]*=?\s*require\s*\(\s*['"]([^'"]+)['"]\s*\)|from\s+([\w.]+)\s+import\b|import\s+([\w.]+)|#include\s*[<"]([^>"]+)[>"]|use\s+([\w:\\]+))""")
_MAY_IMPORT = re.compile(r"import|from|#include|use|.*require", re.S)


def _mask(code: str, hash_comments: bool) -> str:
    """The code with comments blanked and the inside of strings too, at unchanged places; what is not closed goes to the end."""
    mark = r"#[^\n]*|" if hash_comments else ""
    found = re.compile(rf"{mark}//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*+\"|'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\])*+(?:`|\Z)", re.S)

    def blank(m: re.Match) -> str:
        s = m[0]
        if s[0] in "\"'`" and len(s) > 1:
            return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]
        return re.sub(r"[^\n]", " ", s)

    return found.sub(blank, code)


def _tidy(name: str) -> str:
    return re.sub(r"->|::|\?\.", ".", name)


@dataclass
class _Function:
    """A definition: where its header begins and ends, where it is a value, its parameters' brackets (or the one parameter)."""

    start: int
    value: int
    end: int
    name: str
    opens: int | None
    single: str | None
    is_async: bool
    arrow: bool
    params: list[str] = field(default_factory=list)


@dataclass
class _Call:
    start: int
    name: str | None
    opens: int
    holder: object  # the call or assignment that it is within, and which argument
    holder_arg: int | None
    args: list[dict] = field(default_factory=lambda: [{"refs": [], "calls": []}])
    literal: str | None = None
    root: object = None  # the outermost call or the assignment that it is within, or itself
    pos: int = -1


class _Source:
    """One file's masked text with its names, brackets and functions, each found in one pass."""

    def __init__(self, code: str, lang: str):
        self.code, self.lang = code, lang
        self.masked = _mask(code, lang in ("python", "ruby", "php"))
        self.tokens = [(m.start(), m[1] or m[0]) for m in _TOKEN.finditer(self.masked)]
        self.closing, self.opening, stack = {}, {}, []
        for at, token in self.tokens:
            if token in ("(", "[", "{"):
                stack.append(at)
            elif token in (")", "]", "}") and stack:
                self.closing[stack[-1]] = at
                self.opening[at] = stack.pop()
        self.name_ends = {at + len(token): at for at, token in self.tokens if token[0].isalpha() or token[0] in "_$"}
        self.breaks = [(at, token) for at, token in self.tokens if token in ("{", ";", "}")]
        self.functions = sorted([*self._keyword_functions(), *self._arrows()], key=lambda f: f.start)
        self.headers = {f.opens: f for f in self.functions if f.opens is not None}
        self.values = {f.value for f in self.functions}

    def _back(self, at: int) -> int:
        """The place of the last character before `at` that is no white space, or -1."""
        while at > 0 and self.masked[at - 1].isspace():
            at -= 1
        return at - 1

    def _keyword_functions(self) -> Iterator[_Function]:
        for m in _KEYWORD.finditer(self.masked):
            head = _HEAD.match(self.masked, m.end())
            spaced = self.masked[m.end() : m.end() + 1].isspace()
            if head and (spaced or m[2].startswith("func")):
                opens = head.end() - 1
                yield _Function(m.start(), m.start(), self.closing.get(opens, len(self.masked) - 1) + 1, head[1] or "<anonymous>", opens, None, bool(m[1]), False)

    def _arrows(self) -> Iterator[_Function]:
        for at, token in self.tokens:
            if token != "=>":
                continue
            last = self._back(at)
            opens = self.opening.get(last) if last >= 0 and self.masked[last] == ")" else None
            begin = opens if opens is not None else self.name_ends.get(last + 1)
            if begin is None:
                continue
            single = None if opens is not None else re.split(r"\W+", self.masked[begin : last + 1])[-1]
            before = self._back(begin)
            is_async = self.masked[self.name_ends.get(before + 1, before + 1) : before + 1] == "async"
            value = self.name_ends[before + 1] if is_async else begin
            before = self._back(value)
            named = self.name_ends.get(self._back(before) + 1) if before >= 0 and self.masked[before] in ":=" else None
            name = re.split(r"[.>:]", self.masked[named : self._back(before) + 1])[-1] if named is not None else "<anonymous>"
            yield _Function(value if named is None else self._back(before) + 1 - len(name), value, at + 2, name, opens, single, is_async, True)

    def bodies(self) -> list[int]:
        """Where each function ends: at the brace that closes it, or where lines are no longer indented deeper, or at the line's end."""
        text, ends = self.masked, []
        if self.lang in ("python", "ruby"):
            ends, stack, at = [len(text)] * len(self.functions), [], 0
            for m in _LINE.finditer(text):
                while at < len(self.functions) and self.functions[at].end <= m.start():
                    begin = text.rfind("\n", 0, self.functions[at].start) + 1
                    stack.append((len(re.match(r"[ \t]*", text[begin : self.functions[at].start])[0]), at))
                    at += 1
                while stack and len(m[1]) <= stack[-1][0]:
                    ends[stack.pop()[1]] = m.start()
            return ends
        for f in self.functions:
            first = bisect.bisect_left(self.breaks, (f.end, ""))
            brace = self.breaks[first][0] if first < len(self.breaks) and self.breaks[first][1] == "{" else None
            if f.arrow and brace is not None and _BLANK.match(text, f.end).end() != brace:
                brace = None
            line = text.find("\n", f.end)
            ends.append(self.closing.get(brace, len(text)) if brace is not None else len(text) if line < 0 else line)
        return ends

    def statements(self) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, first token, last token) of statements: they end at `;`, at braces, and at line ends outside brackets."""
        start, first, depths = 0, 0, [0]
        for i, (at, token) in enumerate(self.tokens):
            if token in ("(", "["):
                depths[-1] += 1
            elif token in (")", "]"):
                depths[-1] = max(0, depths[-1] - 1)
            elif token in (";", "{", "}") or (token == "\n" and depths[-1] == 0):
                yield start, at, first, i
                start, first = at + 1, i + 1
                if token == "{":
                    depths.append(0)
                elif token == "}" and len(depths) > 1:
                    depths.pop()
        yield start, len(self.masked), first, len(self.tokens)

    def calls_of(self, end: int, first: int, last: int, assign: object, value_at: int, value: dict) -> list[_Call]:
        """Calls of one statement; names on the right side of its assignment go to value. A stack of open brackets tells what is within what."""
        text, found, stack, closed = self.masked, [], [], None
        here, inside = None, None  # the expression that names belong to, and the named call that it is an argument of
        awaited: _Call | None = None
        for at, token in self.tokens[first:last]:
            if not stack and at >= value_at:
                here = value
            if token in ("(", "["):
                call = awaited if awaited and awaited.opens == at else None
                header = self.headers.get(at)
                stack.append((call, here, inside))
                awaited = None
                here = call.args[0] if call else None if header else here
                inside = call if call and call.name is not None else inside
            elif token in (")", "]"):
                if stack:
                    call, here, inside = stack.pop()
                    if call:
                        self._end(call, at)
                        closed = (at, call)
            elif token == ",":
                if stack and stack[-1][0]:
                    stack[-1][0].args.append({"refs": [], "calls": []})
                    here = stack[-1][0].args[-1]
            elif token not in ("\n", "=>", "{", "}", ";") and token not in _WORDS:
                opens = _CALLED.match(text, at + len(token))
                joined = at > 0 and text[at - 1] == "."
                if opens and opens.end() - 1 not in self.headers:
                    name = _tidy(token)
                    if joined and closed and text[closed[0] + 1 : at - 1].strip() in ("", "?"):
                        # A member of what a call gives: no name in JavaScript, else the name of that call stands before it.
                        name = None if self.lang == "javascript" else f"{(closed[1].name or '').split('().')[-1]}().{name}"
                    elif joined and self.lang == "javascript":
                        name = None
                    right = assign if at >= value_at else None
                    holder = (inside, len(inside.args) - 1) if inside else (right, 0) if right else (None, None)
                    awaited = _Call(at, name, opens.end() - 1, *holder)
                    awaited.root = right or (inside.root if inside else awaited)
                    if name is not None:
                        found.append(awaited)
                        if here is not None:
                            here["calls"].append(name)
                elif here is not None and not (at > 0 and text[at - 1] in "\"'`.0123456789"):
                    here["refs"].append(_tidy(token))
                    if self.lang == "ruby" and text[at + len(token) : at + len(token) + 1] == "[":
                        here["refs"].append(f"{_tidy(token)}[]")
        for call, _, _ in stack:
            if call:
                self._end(call, end)
        return found

    def _end(self, call: _Call, at: int) -> None:
        if len(call.args) == 1 and _BLANK.match(self.masked, call.opens + 1, at).end() == at:
            call.args = []
        m = _LITERAL.match(self.masked, call.opens + 1, at + 1)
        call.literal = self.code[m.start(2) : m.end(2)] if m else None


@dataclass
class _Assign:
    start: int
    name: str
    pos: int = -1


def _parameters(source: _Source) -> None:
    """Names of each function's parameters, or <pattern> for what is no plain name; read at the commas of its own bracket."""
    begun: dict[int, list[int]] = {}
    stack: list[int] = []
    for at, token in source.tokens:
        if token in ("(", "[", "{"):
            stack.append(at)
            if at in source.headers:
                begun[at] = [at + 1]
        elif token in (")", "]", "}"):
            if stack:
                stack.pop()
        elif token == "," and stack and stack[-1] in begun:
            begun[stack[-1]].append(at + 1)
    for f in source.functions:
        starts = [] if f.opens is None else begun[f.opens]
        names = [f.single] if f.single else [_PARAMETER.match(source.masked, at)[1].strip().split(" ")[-1] for at in starts]
        blank = f.opens is not None and len(names) == 1 and _BLANK.match(source.masked, f.opens + 1).end() >= f.end - 1 - 2 * f.arrow
        f.params = [] if blank else [n if re.fullmatch(_NAME, n) else "<pattern>" for n in names]


def _owners(functions: list[_Function], ends: list[int]) -> tuple[list[int], list[int]]:
    """Places where the innermost function changes, and the scope from each on: starts and ends in order, the open ones in a heap."""
    marks, owners, open_, over = [-1], [0], [], set()
    events = sorted([(f.end, 1, i) for i, f in enumerate(functions) if f.end < ends[i]] + [(ends[i], 0, i) for i, f in enumerate(functions) if f.end < ends[i]])
    for at, starts, i in events:
        if starts:
            heapq.heappush(open_, (-functions[i].end, -i))
        else:
            over.add(i)
        while open_ and -open_[0][1] in over:
            heapq.heappop(open_)
        marks.append(at)
        owners.append(-open_[0][1] + 1 if open_ else 0)
    return marks, owners


def file_facts(repo: str, file: str, lang: str, code: str) -> list[tuple]:
    """Rows of FACTS for one file; scope 0 is the module. Time grows with the length of the text, however deep it is nested.

    A call in an assignment's right side comes after the assignment, which takes effect before it.
    """
    source = _Source(code, lang)
    _parameters(source)
    marks, owners = _owners(source.functions, source.bodies())
    lines = [m.start() for m in re.finditer("\n", code)]
    events = []  # (order, kind, place, row's values, record)
    for i, f in enumerate(source.functions):
        events.append(((f.start, 0, 0), "func", f.start, (f.name, [], None, i + 1, f.params, f.is_async, "arrow" if f.arrow else "function"), None))
    for start, end, first, last in source.statements():
        begin = _BLANK.match(source.masked, start, end).end()
        if begin == end:
            continue
        text = source.masked[start:end]
        target = _IMPORT.match(code[begin:end].rstrip()) if _MAY_IMPORT.match(source.masked, begin, end) else None
        if target:
            events.append(((begin, 0, 0), "import", begin, (next(g for g in target.groups() if g), [], None, None, None, None, None), None))
        assigned = _ASSIGN.match(text) if "=" in text else None
        value, value_at, assign = {"refs": [], "calls": []}, end, None
        if assigned and _BLANK.match(source.masked, start + assigned.end(), end).end() not in source.values:
            value_at, assign = start + assigned.end(), _Assign(start + assigned.start(1), _tidy(assigned[1]))
            events.append(((assign.start, 1, 0), "assign", assign.start, (assign.name, [value], None, None, None, None, None), assign))
        for c in source.calls_of(end, first, last, assign, value_at, value):
            order = (assign.start, 2, c.start) if assign and c.start > assign.start else (c.start, 0, 0)
            events.append((order, "call", c.start, (c.name, c.args, c.literal, None, None, None, None), c))
    events.sort(key=lambda e: (e[0], e[1]))
    for pos, (*_, record) in enumerate(events):
        if record is not None:
            record.pos = pos
    rows = []
    for pos, (_, kind, at, values, record) in enumerate(events):
        n = bisect.bisect_left(lines, at)
        scope = owners[bisect.bisect_right(marks, at) - 1]
        holder, root = (record.holder, record.root.pos) if isinstance(record, _Call) else (None, pos)
        rows.append((repo, file, lang, scope, pos, n + 1, at - (lines[n - 1] if n else -1), kind, *values, holder.pos if holder else None, record.holder_arg if holder else None, root))
    return rows


def _rows_of(repo: str, file: str, lang: str, code: str) -> list[tuple]:
    """The file's facts, or one row of kind `error` that names what went wrong: no file ends a job."""
    try:
        return file_facts(repo, file, lang, code)
    except Exception as e:
        return [(repo, file, lang, 0, 0, 1, 1, "error", type(e).__name__, [], None, None, None, None, None, None, None, 0)]


def extract_call_facts(files: DataFrame) -> DataFrame:
    """FACTS of all files in a known language (JavaScript and TypeScript count as javascript); nothing is shuffled.

    A file that cannot be read gives one row of kind `error`; unread_files lists them.
    """
    lang = F.when(is_code_file(F.col("file")), "javascript").otherwise(detect_language(F.col("file")))
    rows = files.select("repo", "file", lang.alias("lang"), F.coalesce("content", F.lit("")).alias("content")).filter("lang is not null")

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in zip(*(frame.column(i) for i in range(4))):
                found = _rows_of(*(x.as_py() for x in row))
                for at in range(0, len(found), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*found[at : at + BATCH]), _ARROW)], COLUMNS)

    return rows.mapInArrow(batches, FACTS)


def unread_files(facts: DataFrame) -> DataFrame:
    """repo, file, reason of files whose text the extractor could not read."""
    return facts.filter("kind = 'error'").select("repo", "file", F.col("name").alias("reason"))


def callee_variants(name: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(name, r"\.")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".")))


def _pieces(glob: Column) -> Column:
    """What a glob has between its stars; the first and the last piece are tied to the ends."""
    return F.split(glob, r"\*", -1)


def _follows(name: Column, pieces: Column) -> Column:
    """Whether name is the pieces in order, with any runs without a slash between them."""
    first, last = pieces[0], F.element_at(pieces, -1)
    inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
    # Each inner piece is taken where it first comes up; -1 if it does not.
    after = F.aggregate(inner, F.length(first), lambda at, p: F.when(at < 0, at).when(F.position(p, name, at + 1) == 0, -1).otherwise(F.position(p, name, at + 1) - 1 + F.length(p)))
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    fits = F.startswith(name, first) & F.endswith(name, last) & (after >= 0) & (after + F.length(last) <= F.length(name))
    fits = F.when(F.size(pieces) == 1, name == first).otherwise(fits)
    return fits & (slashes(name) == slashes(F.array_join(pieces, "")))


def _runs(name: Column, k: int) -> Column:
    """All parts of a name with k characters; null for a name that is shorter."""
    n = F.length(name)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.when(n >= k, F.substr(name, i, F.lit(k))))


def match_callees(names: DataFrame, matchers: DataFrame) -> DataFrame:
    """(lang, name, rule_id, role, endpoint_no, endpoint_name) for names(lang, name) that a matcher fits.

    Any variant may fit: exactly, by prefix, or by a glob. Of one rule and role the first endpoint counts. Distinct
    names are matched, and all joins are on equal values: an exact matcher on the variant, a prefix on the beginning of the
    variant that is as long, a glob on its longest piece between stars and every part of the variant that is as long.
    Globs met so are verified piece by piece. The rule table is broadcast where its counted bytes are small.
    """
    distinct = names.select("lang", "name").distinct().withColumn("variant", F.explode(callee_variants(F.col("name"))))
    rules = matchers.select(F.col("language").alias("lang"), "rule_id", "role", "endpoint_no", "endpoint_name", "kind", "value")
    longest = F.aggregate(_pieces(F.col("value")), F.lit(""), lambda a, p: F.when(F.length(p) > F.length(a), p).otherwise(a))
    rules = rules.withColumn("part", F.when(F.col("kind") == "glob", longest).otherwise(F.col("value")))
    # Lengths are as many as the longest matcher has characters at most.
    texts = F.octet_length(F.concat("rule_id", "endpoint_name", "value", "part"))
    counted = rules.groupBy("kind", F.length("part").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.sum(texts).alias("bytes")).collect()
    lengths = {kind: sorted(r["n"] for r in counted if r["kind"] == kind) for kind in ("prefix", "glob")}
    sizes = {kind: sum(3 * 160 * r["rows"] + 2 * r["bytes"] for r in counted if r["kind"] == kind) for kind in ("exact", "prefix", "glob")}
    n = F.length("variant")
    begins = [F.when(n >= k, F.substring("variant", 1, k)) for k in lengths["prefix"]]
    within = [_runs(F.col("variant"), k) for k in lengths["glob"]]
    parts = {"exact": F.array("variant"), "prefix": F.array(*begins) if begins else None, "glob": F.array_distinct(F.flatten(F.array(*within))) if within else None}
    keep, found = ["lang", "name", "rule_id", "role", "endpoint_no", "endpoint_name"], None
    for kind, part in parts.items():
        if part is None:
            continue
        looked_up = distinct.withColumn("part", F.explode(part)).filter("part is not null")
        side = rules.filter(F.col("kind") == kind).drop("kind")
        hits = looked_up.join(F.broadcast(side) if sizes[kind] <= BROADCAST_BYTES else side, ["lang", "part"])
        hits = hits.filter(_follows(F.col("variant"), _pieces(F.col("value")))) if kind == "glob" else hits
        found = hits.select(*keep) if found is None else found.unionByName(hits.select(*keep))
    return found.groupBy("lang", "name", "rule_id", "role").agg(F.min(F.struct("endpoint_no", "endpoint_name")).alias("e")).select("lang", "name", "rule_id", "role", "e.endpoint_no", "e.endpoint_name")


def def_use_asof(facts: DataFrame) -> DataFrame:
    """repo, file, scope_id, name, use_pos, def_pos: for each use of a variable the latest assignment before it in its scope.

    A right side is read before its own assignment. Uses without an earlier assignment have no def_pos.
    """
    key = ["repo", "file", "scope_id"]
    uses = facts.select(*key, "pos", F.explode(F.array_distinct(F.flatten("args.refs"))).alias("name"))
    events = uses.withColumn("is_def", F.lit(0)).unionByName(facts.filter("kind = 'assign'").select(*key, "pos", "name", F.lit(1).alias("is_def")))
    before = Window.partitionBy(*key, "name").orderBy("pos", "is_def").rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("def_pos", F.last(F.when(F.col("is_def") == 1, F.col("pos")), ignorenulls=True).over(before))
    return seen.filter("is_def = 0").select(*key, "name", F.col("pos").alias("use_pos"), "def_pos")


def data_flow_edges(facts: DataFrame) -> DataFrame:
    """Like def_use_asof, but a definition is recorded before its right side is read, and uses without one are dropped."""
    key = ["repo", "file", "scope_id"]
    uses = facts.select(*key, "pos", F.explode(F.array_distinct(F.flatten("args.refs"))).alias("name"))
    events = uses.withColumn("is_def", F.lit(0)).unionByName(facts.filter("kind = 'assign'").select(*key, "pos", "name", F.lit(1).alias("is_def")))
    before = Window.partitionBy(*key, "name").orderBy("pos", F.desc("is_def")).rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("def_pos", F.last(F.when(F.col("is_def") == 1, F.col("pos")), ignorenulls=True).over(before))
    return seen.filter("is_def = 0 and def_pos is not null").select(*key, "name", "def_pos", F.col("pos").alias("use_pos"))


def import_edges(facts: DataFrame) -> DataFrame:
    return facts.filter("kind = 'import'").select("repo", "file", F.col("name").alias("module")).distinct()


def function_map(facts: DataFrame) -> DataFrame:
    """Functions by id file:name:line, and a <module> row for each file."""
    ids = F.concat_ws(":", "file", "name", F.col("line").cast("string"))
    own = facts.filter("kind = 'func'").select("repo", "file", ids.alias("id"), "name", "line", "params", "is_async", "func_kind", F.col("own_scope_id").alias("scope_id"))
    module = facts.select("repo", "file").distinct().select("repo", "file", F.concat_ws(":", "file", F.lit("<module>"), F.lit("0")).alias("id"), F.lit("<module>").alias("name"), F.lit(0).alias("line"), F.array().cast("array<string>").alias("params"), F.lit(False).alias("is_async"), F.lit("module").alias("func_kind"), F.lit(0).alias("scope_id"))
    return own.unionByName(module)


def call_edges(facts: DataFrame) -> DataFrame:
    """repo, file, caller (name of the enclosing function, or <module>), callee: distinct."""
    owners = function_map(facts).select("repo", "file", "scope_id", F.col("name").alias("caller"))
    return facts.filter("kind = 'call'").join(owners, ["repo", "file", "scope_id"]).select("repo", "file", "caller", F.col("name").alias("callee")).distinct()


#: Calls that are findings by themselves. Full names are compared, never a part.
WEAK_HASHES = ["md5", "sha1", "md4"]
WEAK_CIPHERS = ["des", "3des", "rc2", "rc4", "bf", "blowfish", "idea"]
RANDOM_CALLS = ["Math.random", "crypto.pseudoRandomBytes", "pseudoRandomBytes"]
DESERIALIZERS = ["unserialize", "deserialize", "serialize.unserialize", "serialize.deserialize", "yaml.load", "YAML.load", "jsyaml.load"]


def _either(name: Column, *bare: str) -> Column:
    return name.isin([f"{p}{b}" for b in bare for p in ("", "crypto.")])


def weak_hash_calls(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "call").filter(_either(F.col("name"), "createHash") & F.lower("arg0").isin(WEAK_HASHES))


def insecure_random_calls(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "call").filter(F.col("name").isin(RANDOM_CALLS))


def insecure_cipher_api(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "call").filter(_either(F.col("name"), "createCipher", "createDecipher"))


def weak_cipher_calls(facts: DataFrame) -> DataFrame:
    weak = F.rlike(F.lower("arg0"), F.lit("|".join([*WEAK_CIPHERS, "-ecb", "ecb$"])))
    return facts.filter(F.col("kind") == "call").filter(_either(F.col("name"), "createCipheriv", "createDecipheriv") & weak)


def deserialization_calls(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("kind") == "call").filter(F.col("name").isin(DESERIALIZERS))


def native_direct_rules(facts: DataFrame, matchers: DataFrame) -> DataFrame:
    """Calls whose name a `direct` rule of their language fits: repo, file, line, column, name, rule_id."""
    calls = facts.filter("kind = 'call'")
    hits = match_callees(calls, matchers.filter("role = 'direct'")).select("lang", "name", "rule_id")
    return calls.join(hits, ["lang", "name"]).select("repo", "file", "line", "column", "name", "rule_id")


def native_secret_rules(files: DataFrame, matchers: DataFrame) -> DataFrame:
    """Lines that a `literal` rule of the file's language fits, case-insensitive: repo, file, line, rule_id."""
    lang = detect_language(F.col("file"))
    numbered = F.transform(F.split("content", r"\r?\n", -1), lambda text, i: F.struct((i + 1).cast("int").alias("line"), text.alias("text")))
    literal = matchers.filter("role = 'literal'")
    # Lines are told by the rules' own patterns before they become rows; the patterns are bounded by the packs.
    patterns = sorted(r["value"] for r in literal.select("value").distinct().collect())
    if not patterns:
        return files.select("repo", "file", F.lit(0).alias("line"), F.lit("").alias("rule_id")).limit(0)
    any_rule = F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    lines = files.withColumn("lang", lang).filter(F.col("lang").isNotNull() & F.rlike("content", any_rule)).select("repo", "file", "lang", F.explode(F.filter(numbered, lambda x: F.rlike(x["text"], any_rule))).alias("l"))
    fitting = F.array_compact(F.array(*[F.when(F.rlike("l.text", F.lit(f"(?i){p}")), F.lit(p)) for p in patterns]))
    met = lines.select("repo", "file", "lang", "l.line", F.explode(fitting).alias("pattern"))
    rules = small(literal.select(F.col("language").alias("lang"), "rule_id", F.col("value").alias("pattern")))
    return met.join(rules, ["lang", "pattern"]).select("repo", "file", "line", "rule_id")


#: Ids, titles and categories of the call detectors' findings; all are high.
CRYPTO, INTEGRITY = "A02:2021 Cryptographic Failures", "A08:2021 Software and Data Integrity Failures"
CALL_DETECTORS = [
    (weak_hash_calls, "insecure-crypto", "Weak Hash Function", CRYPTO, "arg0"),
    (insecure_random_calls, "insecure-crypto", "Insecure Randomness", CRYPTO, "name"),
    (insecure_cipher_api, "insecure-crypto", "Insecure Cipher API", CRYPTO, "name"),
    (weak_cipher_calls, "insecure-crypto", "Weak Cipher Algorithm", CRYPTO, "arg0"),
    (deserialization_calls, "unsafe-deserialization", "Unsafe Deserialization", INTEGRITY, "name"),
]


def call_findings(facts: DataFrame, detectors: list[tuple] = CALL_DETECTORS) -> DataFrame:
    """Findings of the call detectors over JavaScript facts: id, severity, title, category and place of each call."""
    found = None
    for no, (detect, rule, title, owasp, about) in enumerate(detectors):
        text = F.concat(F.lit(f"{title}: "), F.coalesce(F.col(about), F.col("name")), F.lit(f" [{owasp}]"))
        rows = detect(facts.filter("lang = 'javascript'")).select(
            "repo", "file", "line", "column", F.lit(rule).alias("id"), F.lit("high").alias("severity"), F.lit(title).alias("title"), text.alias("description"),
            F.lit(owasp).alias("owasp"), F.lit("code").alias("category"), F.lit(RANKS["patterns_js"]).alias("detector_rank"), (F.col("pos").cast("long") * 8 + no).alias("seq"),
        )
        found = as_findings(rows) if found is None else found.unionByName(as_findings(rows))
    return found


def native_findings(facts: DataFrame, files: DataFrame, matchers: DataFrame) -> DataFrame:
    """Findings of the `direct` and `literal` rules of the other languages, with the rules' titles, severities and categories."""
    rules = small(matchers.select("rule_id", "title", "severity", "owasp").distinct())
    direct = native_direct_rules(facts.filter("lang != 'javascript'"), matchers).select("repo", "file", "line", "column", "rule_id")
    literal = native_secret_rules(files, matchers).select("repo", "file", "line", F.lit(None).cast("int").alias("column"), "rule_id")
    rows = direct.unionByName(literal).join(rules, "rule_id")
    return as_findings(rows.select(
        "repo", "file", "line", "column", F.col("rule_id").alias("id"), "severity", "title", F.concat("title", F.lit(" ["), "owasp", F.lit("]")).alias("description"), "owasp",
        F.lit("code").alias("category"), F.lit(RANKS["taint_native"]).alias("detector_rank"), (F.col("line").cast("long") * (1 << 31) + F.coalesce("column", F.lit(0))).alias("seq"),
    ))
