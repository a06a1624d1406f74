"""Taint: from sources through variables to sinks, by rule and scope."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sievelight.functions.tables import small
from sievelight.operators.facts import match_callees
from sievelight.schema import RANKS, as_findings

HITS = "repo string, file string, rule_id string, endpoint_name string, line int, `column` int, pos int"
KEY = ["repo", "file", "lang", "scope_id"]
#: What a name in an argument says of it: a rule's source or sanitizer, a rule's sink by the call's own name, or the assignment it reads.
MARK = "struct<arg:int,role:string,rule_id:string,endpoint_name:string,def_pos:int,own:boolean>"
NOTHING: frozenset = frozenset()


def _mark(arg: Column, **given: Column) -> Column:
    kinds = {"role": "string", "rule_id": "string", "endpoint_name": "string", "def_pos": "int", "own": "boolean"}
    return F.struct(arg.alias("arg"), *[given.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()])


def _read_assignments(variables: DataFrame) -> DataFrame:
    """Uses of variables(key, pos, root, arg, what, name) with def_pos, the latest assignment of the name before the statement, and
    own: whether the statement itself assigns it, so that its calls read what it assigns."""
    is_def = F.col("what") == "def"
    earlier = Window.partitionBy(*KEY, "name").orderBy("pos", is_def.cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    seen = variables.withColumn("previous", F.last(F.when(is_def, F.col("pos")), ignorenulls=True).over(earlier))
    latest = F.last(F.when(is_def, F.struct("pos", "previous")), ignorenulls=True).over(earlier)
    read = seen.withColumn("latest", latest).filter("what = 'ref' and latest is not null")
    own = F.col("latest.pos") == F.col("root")
    return read.select(*KEY, "pos", "arg", F.when(own, F.col("latest.previous")).otherwise(F.col("latest.pos")).alias("def_pos"), own.alias("own"))


class _Scope:
    """Which assignments of one scope are tainted, and by which rules. Only tainted ones are held."""

    def __init__(self, through_calls: bool):
        self.through_calls, self.bad = through_calls, {}

    def statement(self, root: int, rows: list[tuple]) -> Iterator[tuple[tuple, str, str]]:
        """Takes a statement's rows (pos, is_assign, within, within_arg, line, column, marks, args), outer ones first; gives (row, rule, sink)."""
        held, changes = self._values(rows, None)
        if rows[0][1]:
            value, safe = held.get((root, 0), (NOTHING, NOTHING))
            if value - safe:
                self.bad[root] = value - safe
        if changes:
            # Calls on the right side read what the statement has assigned.
            held, _ = self._values(rows, root)
        for row in rows:
            for m in row[6]:
                if m["role"] == "sink":
                    reached = (held.get((row[0], arg), (NOTHING, NOTHING)) for arg in row[7])
                    if any(m["rule_id"] in value and m["rule_id"] not in safe for value, safe in reached):
                        yield row, m["rule_id"], m["endpoint_name"]

    def _values(self, rows: list[tuple], assigned: int | None) -> tuple[dict, bool]:
        """(pos, arg) -> (rules that taint it, rules that make it safe), inner calls first; and whether a call reads its own statement's assignment."""
        held: dict = {}
        changes = False
        for row in reversed(rows):
            pos, is_assign, within, within_arg, marks = row[0], row[1], row[2], row[3], row[6]
            for m in marks:
                at = (pos, m["arg"])
                value, safe = held.get(at, (NOTHING, NOTHING))
                if m["role"] == "source":
                    held[at] = (value | {m["rule_id"]}, safe)
                elif m["role"] == "sanitizer":
                    held[at] = (value, safe | {m["rule_id"]})
                elif m["role"] is None:
                    now = m["own"] and not is_assign
                    changes = changes or now
                    tainted = self.bad.get(assigned if now and assigned is not None else m["def_pos"], NOTHING)
                    if tainted:
                        held[at] = (value | tainted, safe)
            if self.through_calls and within is not None and row[7]:
                up = (within, within_arg)
                value, safe = held.get(up, (NOTHING, NOTHING))
                for arg in row[7]:
                    more, also = held.get((pos, arg), (NOTHING, NOTHING))
                    value, safe = value | more, safe | also
                held[up] = (value, safe)
        return held, changes


def _scan(batches: Iterator[pa.RecordBatch], through_calls: bool) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by scope and pos; a scope or a statement may go on from one batch to the next."""
    key, scope, root, held, found = None, None, None, [], []

    def flush() -> None:
        if held:
            found.extend((key[0], key[1], rule, sink, row[4], row[5], row[0]) for row, rule, sink in scope.statement(root, held))
            held.clear()

    def out() -> pa.RecordBatch:
        kinds = [*[pa.string()] * 4, *[pa.int32()] * 3]
        batch = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["repo", "file", "rule_id", "endpoint_name", "line", "column", "pos"])
        found.clear()
        return batch

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for repo, file, lang, scope_id, at, pos, is_assign, within, within_arg, line, column, n_args, marks in zip(*columns):
            now = (repo, file, lang, scope_id)
            if now != key or at != root:
                flush()
                root = at
                if now != key:
                    key, scope = now, _Scope(through_calls)
            held.append((pos, is_assign, within, within_arg, line, column, marks or [], set(range(n_args))))
        if found:
            yield out()
    flush()
    yield out()


def taint(facts: DataFrame, matchers: DataFrame, *, through_calls: bool) -> DataFrame:
    """HITS: one row for each rule and sink call that tainted data reaches.

    Names are matched to rules by joins over distinct names, and only scopes with both a source and a sink of one rule
    are looked at. Windows find the assignment that each use of a variable reads, with spills where a scope is large. A
    task streams the calls and assignments of its scopes in order of place, marked with what their names mean, and holds
    which assignments of one scope are tainted and the rows of one statement; no scope is gathered. An expression is safe if
    a sanitizer is called in it, else tainted by a source or a tainted variable. What is inside a call's arguments
    counts for the calls around it only if through_calls.
    """
    acts = facts.filter("kind in ('assign', 'call')")
    # One row for each name of a fact: its own (a call's is looked up as a sink), those called and those read in its arguments.
    said = lambda arg, what, name: F.struct(arg.alias("arg"), F.lit(what).alias("what"), name.alias("name"))
    inner = F.flatten(F.transform("args", lambda e, i: F.concat(F.transform(F.array_distinct(e["calls"]), lambda c: said(i, "call", c)), F.transform(F.array_distinct(e["refs"]), lambda r: said(i, "ref", r)))))
    own = F.struct(F.lit(-1).alias("arg"), F.when(F.col("kind") == "call", "own").otherwise("def").alias("what"), F.col("name").alias("name"))
    names = acts.select(*KEY, "pos", "root", F.inline(F.array_append(inner, own)).alias("arg", "what", "name"))
    roles_of = F.when(F.col("what") == "call", F.array(F.lit("source"), F.lit("sanitizer"))).when(F.col("what") == "own", F.array(F.lit("sink")))
    if through_calls:  # a bare name can be a source as well
        roles_of = roles_of.when(F.col("what") == "ref", F.array(F.lit("source")))
    named = names.withColumn("roles", roles_of).filter("roles is not null")
    matched = match_callees(named.select("lang", "name"), matchers.filter("role in ('source', 'sink', 'sanitizer')"))
    roles = named.join(matched, ["lang", "name"]).filter(F.array_contains("roles", F.col("role"))).select(*KEY, "pos", "arg", "rule_id", "role", "endpoint_name")
    of_rule = Window.partitionBy(*KEY, "rule_id")
    ends = [F.max((F.col("role") == role).cast("int")).over(of_rule).alias(role) for role in ("source", "sink")]
    both = roles.select("*", *ends).filter("source = 1 and sink = 1")
    scopes = both.select(*KEY).distinct()
    variables = names.filter("what in ('ref', 'def')").join(scopes, KEY, "left_semi")
    if not through_calls:  # a member is tainted if its object is
        whole_and_object = F.when(F.col("what") == "ref", F.array_distinct(F.array("name", F.substring_index("name", ".", 1)))).otherwise(F.array("name"))
        variables = variables.withColumn("name", F.explode(whole_and_object))
    read = _read_assignments(variables)
    marks = both.select(*KEY, "pos", _mark(F.col("arg"), role=F.col("role"), rule_id=F.col("rule_id"), endpoint_name=F.col("endpoint_name")).alias("mark"))
    marks = marks.unionByName(read.select(*KEY, "pos", _mark(F.col("arg"), def_pos=F.col("def_pos"), own=F.col("own")).alias("mark")))
    marks = marks.groupBy(*KEY, "pos").agg(F.collect_set("mark").alias("marks"))
    rows = acts.join(scopes, KEY, "left_semi").select(*KEY, "root", "pos", (F.col("kind") == "assign").alias("is_assign"), "within", "within_arg", "line", "column", F.size("args").alias("n_args"))
    # Without marks a call only hands on what is inside it.
    rows = rows.join(marks, [*KEY, "pos"], "left" if through_calls else "inner").select(*KEY, "root", "pos", "is_assign", "within", "within_arg", "line", "column", "n_args", "marks")
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "pos").mapInArrow(lambda batches: _scan(batches, through_calls), HITS)


def taint_js(facts: DataFrame, matchers: DataFrame) -> DataFrame:
    """JavaScript: a call to an unknown function is clean whatever its arguments; a member is tainted if its object is."""
    return taint(facts.filter("lang = 'javascript'"), matchers, through_calls=False)


def taint_native(facts: DataFrame, matchers: DataFrame) -> DataFrame:
    """The other languages: a call with a tainted argument is itself tainted; dotted names are looked up as they are."""
    return taint(facts.filter("lang != 'javascript'"), matchers, through_calls=True)


def taint_findings(hits: DataFrame, matchers: DataFrame, native: bool) -> DataFrame:
    """Findings of hits; titles and severities come from the rule table."""
    rules = small(matchers.select("rule_id", "title", "severity", "owasp").distinct())
    rows = hits.join(rules, "rule_id")
    message = F.concat("title", F.lit(": Tainted data reaches sink "), "endpoint_name", F.lit(" ["), "owasp", F.lit("]"))
    found = rows.select("repo", "file", "line", "column", F.col("rule_id").alias("id"), "severity", "title", message.alias("description"), "owasp", F.lit("code").alias("category"), F.lit(RANKS["taint_native" if native else "taint_js"]).alias("detector_rank"), F.col("pos").cast("long").alias("seq"))
    return as_findings(found)
